"""Training-data pipeline: five stages, each a table of documents written for the next.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of ``documents``.  The functions see the session's shared
folder only through the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellview.llm import decontaminate, language, minhash_dedup, mixing, secrets
from cellview.llm.common import store, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; ``lang`` becomes the predicted one.

    Null texts and texts without a letter go; a null lang is predicted like others; repeated
    rows share their fate.  An empty table stays empty.
    """
    found = language.identified(docs).where("lang_pred <> 'und'")
    named = {"lang": F.col("lang_pred").cast(docs.schema["lang"].dataType)}
    return found.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Different texts under the kept doc_id stay, equal ones once; rows with a null doc_id stay, and so
    do texts without words, which link with nothing.
    """
    return minhash_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts, and all texts if there is no item, stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, null texts as they are."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place in the mix: source_block, slot, block_offset.

    Every row gets a place of its own, repeated ones too; a null source is one of its own.
    Columns with the names of the three results are replaced.
    """
    return mixing.schedule(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # language machines and decoded secrets have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
