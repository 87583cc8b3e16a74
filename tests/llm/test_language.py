"""What language identification sends to its tasks, and that this does not change the results."""

import pytest
from pyspark.sql import functions as F

from cellview.llm import language


def sent(df):
    """Columns that reach the Python tasks of the prediction."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    return node.children().head().schema().catalogString()


@pytest.fixture(scope="module")
def docs(spark):
    said = {"en": "the house of the other man was there with them {}", "de": "das haus und der andere mann war nicht mit ihnen {}", "fr": "la maison de l'autre homme est avec les femmes {}"}
    rows = [(10 * k + j, text.format(k), lang, "s") for k in range(40) for j, (lang, text) in enumerate(said.items())]
    odd = [(1001, None, "en", "s"), (1002, "", "en", None), (1003, "12 34", None, "s"), (None, said["de"].format("x"), None, None), (5, said["fr"].format("y"), None, "s"), (5, said["fr"].format("y"), None, "s")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")


def test_each_text_is_sent_once_and_other_columns_only_if_kept(docs):
    assert sent(language.identify(docs)) == "struct<row:struct<doc_id:bigint>,text:string>"
    assert sent(language.identified(docs)) == "struct<row:struct<doc_id:bigint,text:string,lang:string,source:string>>"


def test_same_result_however_the_text_comes(docs):
    key = lambda rows: sorted((repr(r.doc_id), r.lang_pred) for r in rows)
    alone = language.identify(docs).collect()
    whole = language.identified(docs).select("row.*", "lang_pred", "score").collect()
    beside = language.identified(docs.withColumnRenamed("text", "Text")).select("row.doc_id", "lang_pred", "score").collect()
    binary = language.identified(docs.withColumn("text", F.col("text").cast("binary"))).select("row.doc_id", "lang_pred", "score").collect()
    assert key(alone) == key(whole) == key(beside) == key(binary) and len(alone) == docs.count()
    assert all(sorted(x.score for x in alone) == pytest.approx(sorted(x.score for x in y), abs=1e-4) for y in (whole, beside, binary))
    assert {(r.doc_id, r.text, r.lang, r.source) for r in whole} == {tuple(r) for r in docs.collect()}
    assert all(r.lang_pred == ("en", "de", "fr")[r.doc_id % 10] for r in alone if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 5)
    assert {r.doc_id: r.lang_pred for r in alone if r.doc_id is None or r.doc_id > 1000 or r.doc_id == 5} == {1001: "und", 1002: "und", 1003: "und", None: "de", 5: "fr"}
