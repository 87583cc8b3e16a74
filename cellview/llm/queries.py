"""Registered queries of the operators over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellview.llm import conversation_trie, decontaminate, licenses, mixing, suffix_dedup, vector_codes
from cellview.llm.common import fold_of, table


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.projection_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.schedule(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return placed.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), "source_block", "slot", "block_offset")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm import class_lm

    docs = table(spark, sf_dir, "documents")
    return class_lm.score(docs, *class_lm.fit(docs))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("redacted")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm import toxicity

    plan = toxicity.Ftrl()
    judged = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), plan)
    return judged.withColumn("held_out", fold_of("doc_id", plan.folds) == plan.held_out)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm import language

    plan = language.Discrimination()
    found = language.identify(table(spark, sf_dir, "documents"), plan)
    return found.withColumn("held_out", fold_of("doc_id", plan.folds) == plan.held_out)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.suffix_dedup import cut

    done = cut(table(spark, sf_dir, "documents"), bytes_too=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellview.llm.conversation_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_class_lm, op2_embedding_dedup, op3_decontaminate, op4_secrets, op5_html_text, op6_licenses, op7_toxicity, op8_mixing, op9_language,
        op10_minhash_dedup, op11_vector_codes, op12_suffix_dedup,
        op13_conversation_trie, pipeline,
    )
}
ORACLE_SQL = {
    "op3_decontaminate": decontaminate.oracle_sql(), "op6_licenses": licenses.oracle_sql(), "op8_mixing": mixing.oracle_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(), "op12_suffix_dedup": suffix_dedup.oracle_sql(),
    "op13_conversation_trie": conversation_trie.oracle_sql(),
}
