"""The five stages on odd rows: clashing columns, repeated ids, nulls, an empty table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellview.llm.common import store

NAMES = [
    "row", "score", "lang_pred", "text_", "spans", "redacted", "n_hex", "found", "kept_id", "text_key", "key", "key_", "component", "rep", "mix_source", "mix_part",
    "mix_key", "mix_row", "place", "turn", "round", "slot",
]


def prose(seed, n, words):
    return " ".join(np.random.default_rng(seed).choice(words, n))


@pytest.fixture(scope="module")
def rows(spark, sf):
    """Documents of the table, and a few odd ones, with extra columns named like everything the stages make."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    english = [w for r in docs.where("lang = 'en'").limit(20).collect() for w in r.text.split()]
    one, two = prose(1, 80, english), prose(2, 90, english)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra = [
        (900_001, one, "en", None, 1), (900_001, two, "en", "a", 1), (900_001, one, "en", None, 1), (900_002, one + " more", "en", "a", 1),
        (900_003, None, "en", "a", 0), (900_004, "", "en", "a", 0), (None, prose(3, 70, english), None, None, None), (None, prose(4, 70, english), "en", "b", 2),
        (900_005, prose(5, 60, english), "en", "b", 3), (900_005, f"{prose(6, 30, english)} {item} {prose(7, 30, english)}", "en", "b", 3),
    ]
    every = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    return every.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce("text", F.lit("-"))).alias(n) for n in NAMES]), one, two


def test_stages_keep_columns_and_rows(spark, sf, rows):
    docs, one, two = rows
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, sf), name)
        if name != "mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("substring(score, 7) <> substring(key, 5) OR substring(score, 7) <> substring(place, 7)").count() == 0, name
        docs = out
    assert docs.where("text = '' OR text IS NULL").count() == 0
    texts = {(r.doc_id, r.text) for r in docs.where("doc_id >= 900000").collect()}
    assert {t for i, t in texts if i == 900_001} == {one, two} and not [i for i, _ in texts if i == 900_002]
    assert len([i for i, _ in texts if i == 900_005]) == 1 and docs.where("doc_id IS NULL").count() == 2
    assert docs.select("slot", "block_offset").distinct().count() == docs.count()


def test_stages_of_an_empty_table(spark, sf, rows):
    docs = rows[0].where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf), name)
        assert docs.count() == 0, name
