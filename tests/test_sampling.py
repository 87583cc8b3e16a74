"""Synthetic records: codes against a plain search, draws rounded like Spark's, cells and queries read once."""

import hashlib
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from cellview.catalog import answers
from cellview.catalog.base import LI3
from cellview.functions import noise
from cellview.plans import network as N

LEVELS = {"a": N.Hierarchy.flat(5), "b": N.Hierarchy.flat(3)}
MODEL = [N.Family("a", ()), N.Family("b", (("a", 0),))]
# equal bounds are codes that nothing draws; draws beyond the last bound take the last code
BOUNDS = {("a", -1): [0.1, 0.1, 0.4, 0.4, 1.0], **{("b", a): sorted([0.0, a / 4, 0.9]) for a in range(5)}}


def counted(df, column, seen):
    """``df``, with a count of the rows that are computed."""
    return df.withColumn(column, F.udf(lambda v: (seen.add(1), v)[1], "long").asNondeterministic()(column))


def test_records_find_their_codes(spark):
    rows = [(c, p, -1, x, hi) for (c, p), his in BOUNDS.items() for x, hi in enumerate(his)]
    distributions = spark.createDataFrame(rows, "child string, p_a int, p_b int, x int, cdf_hi double")
    ids = spark.createDataFrame([(i,) for i in [*range(2000), 7, None]], "rid long")
    records = N.ancestral_sample(ids, "rid", distributions, MODEL, LEVELS, "s")

    def code(child, p, rid):
        key = "|".join(["s", "record", "0", child] + [str(rid)] * (rid is not None))
        u = round((int(hashlib.sha256(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52, 9)
        return min(bisect_right(BOUNDS[child, p], u), len(BOUNDS[child, p]) - 1)

    want = [(r.rid, a := code("a", -1, r.rid), code("b", a, r.rid)) for r in ids.collect()]
    assert sorted(map(repr, map(tuple, records.collect()))) == sorted(map(repr, want))
    # no pass over all bounds of a distribution for each record
    assert "lambda" not in records._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_rounded_like_text(spark):
    ties = spark.range(20_000).selectExpr("(id * 49999 + 0.5D) / 1e9 + (id % 7 - 3) * 1.1e-16 AS u")
    draws = ties.unionAll(spark.range(20_000).select(noise.unit("s", F.col("id")).alias("u"))).where("u > 0")
    both = draws.select(F.round("u", 9).alias("slow"), noise.rounded(F.col("u"), 9).alias("fast"))
    assert both.count() > 39_000 and not both.where("slow <> fast OR fast IS NULL").count()
    with pytest.raises(ValueError):
        noise.rounded(F.col("u"), 12)


def test_synthesis_reads_the_cells_once(spark):
    seen = spark.sparkContext.accumulator(0)
    cells = counted(spark.createDataFrame([(a, b, 10 * a + b + 1) for a in range(5) for b in range(3)], "a int, b int, v long"), "v", seen)
    N.synthesize(cells, spark.range(50).withColumnRenamed("id", "rid"), "rid", LEVELS, 400, 1.0).collect()
    assert seen.value == 15


def test_comparison_counts_lineitem_and_draws_queries_once(spark, sf, monkeypatch):
    cells = spark.createDataFrame([(q, d, r, q + d + r + 1) for q in range(6) for d in range(3) for r in range(2)], "q int, d int, r int, v long")
    queries = spark.createDataFrame([(i, a, 0, i) for i in range(4) for a in LI3.attrs[:2]], "query_id long, attr string, lo int, hi long")
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]
    monkeypatch.setattr(answers, "lineitem_cells", lambda *_: counted(cells, "v", seen[0]))
    monkeypatch.setattr(answers, "customer_queries", lambda *_, **__: counted(queries, "hi", seen[1]).withColumn("hi", F.col("hi").cast("int")))
    assert answers.comparison(spark, sf, answers.CHEAP, 2, "t").count() == 2
    assert [s.value for s in seen] == [36, 8]
