"""Small exact checks: numbering, selection, sampling, noise, domains, sinks."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellview.catalog.base import KEYS, LI3, lineitem_codes
from cellview.domain import Domain, grid
from cellview.functions import noise
from cellview.operators import answer as A
from cellview.operators import cells as C
from cellview.operators import clean as K
from cellview.operators import discretize as Z
from cellview.operators import mechanisms as M
from cellview.operators import workload as W
from cellview.operators.layout import attach, mark_smallest, number_rows, running_sum
from cellview.sources import generate as G
from cellview.sources import sampling as S
from cellview.sources import tables as T


def test_numbering_equals_a_global_sort(spark, sf):
    rows = lineitem_codes(spark, sf).select(*KEYS)
    got = number_rows(rows, KEYS, "n").collect()
    want = sorted((r.l_orderkey, r.l_linenumber) for r in rows.collect())
    assert [(r.l_orderkey, r.l_linenumber) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(len(want)))


def test_running_sum_is_cumulative(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("w"))
    got = {r.id: r.s for r in running_sum(rows, ["id"], F.col("w"), "s").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1000, 5000])
def test_exact_sample_size(spark, n):
    rows = spark.range(1000)
    got = {r.id for r in S.sample_n(rows, n, ["id"], "x").collect()}
    drawn = rows.select("id", noise.unit("x", "sample", F.col("id")).alias("u")).orderBy("u", "id").collect()
    assert got == {r.id for r in drawn[:n]}


def test_selection_survives_ties_in_the_draw(spark):
    rows = spark.range(100)
    got = mark_smallest(rows, F.lit(0.5), ["id"], lambda m: F.lit(30), "in").filter("in").collect()
    assert sorted(r.id for r in got) == list(range(30))


def test_split_is_exact_and_whole(spark, sf):
    rows = lineitem_codes(spark, sf).select(*KEYS)
    n = rows.count()
    parts = {r.part: r["count"] for r in S.train_test_split(rows, KEYS, "s").groupBy("part").count().collect()}
    assert parts["test"] == math.ceil(n * 0.1) and sum(parts.values()) == n


def test_attach_is_a_join_at_any_size(spark, monkeypatch):
    from cellview.operators import layout

    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "k", how).select("id", "k", "w").collect()), key=repr)
        assert sorted(map(tuple, attach(big, small, ["k"], 40, how).select("id", "k", "w").collect()), key=repr) == want
        with monkeypatch.context() as m:
            m.setattr(layout, "BROADCAST_ROWS", 1)
            m.setattr(layout, "HOT_ROWS", 100)
            got = attach(big, small, ["k"], 40, how).select("id", "k", "w")
            assert sorted(map(tuple, got.collect()), key=repr) == want


# ------------------------------------------------------------------ deviation


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(1, 60)), min_size=0, max_size=20))
def test_deviation_and_cuts_equal_dense_brute_force(spark, drawn):
    domain = Domain({"a": 5, "b": 4})
    dense = [[0] * 4 for _ in range(5)]
    for a, b, v in drawn:
        dense[a][b] = v
    rows = [(a, b, v) for a in range(5) for b in range(4) if (v := dense[a][b])]
    cells = spark.createDataFrame(rows, "a int, b int, v bigint")

    def dev(values):
        mean = sum(values) / len(values)
        return sum(abs(v - mean) for v in values)

    frontier = C.root_block(cells, domain)
    stats = C.cut_statistics(
        C.code_histogram(cells.withColumn("block", F.lit("0")), frontier, domain), C.candidate_cuts(frontier, domain), 100
    ).collect()
    assert len(stats) == 4 + 3
    for s in stats:
        left = [dense[a][b] for a in range(5) for b in range(4) if (a if s.attr == "a" else b) <= s.cut]
        right = [dense[a][b] for a in range(5) for b in range(4) if (a if s.attr == "a" else b) > s.cut]
        assert s.total_l == sum(left) and s.total_r == sum(right)
        assert s.ae_l == pytest.approx(dev(left), abs=1e-9) and s.ae_r == pytest.approx(dev(right), abs=1e-9)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("ab"), st.integers(-3, 9), st.integers(-3, 9)), min_size=1, max_size=12))
def test_range_counts_equal_brute_force(spark, conditions):
    """Negative, reversed, repeated and outside bounds included."""
    domain, rng = Domain({"a": 6, "b": 5}), random.Random(3)
    table = {(a, b): rng.randint(1, 9) for a in range(6) for b in range(5) if rng.random() < 0.6}
    cells = spark.createDataFrame([(a, b, v) for (a, b), v in table.items()], "a int, b int, v bigint")
    queries = spark.createDataFrame(conditions, "query_id int, attr string, lo int, hi int")
    want = {}
    for q in {c[0] for c in conditions}:
        mine = [c for c in conditions if c[0] == q]
        want[q] = sum(v for (a, b), v in table.items() if all(lo <= (a if at == "a" else b) <= hi for _, at, lo, hi in mine))
    got = {r.query_id: r.total for r in C.answer_ranges(cells, queries, domain).collect()}
    assert got == want
    boxes = cells.selectExpr("a AS lo_a", "a AS hi_a", "b AS lo_b", "b AS hi_b", "double(v) AS value")
    est = {r.query_id: r.estimate for r in A.view_range_count(boxes, queries, domain).collect()}
    assert est == pytest.approx(want)


# ---------------------------------------------------------------------- noise


def test_laplace_moments(spark):
    row = spark.range(50_000).select(noise.laplace(3.0, "m", F.col("id")).alias("x")).agg(F.avg("x"), F.var_samp("x")).first()
    assert abs(row[0]) < 0.1 and row[1] == pytest.approx(18.0, rel=0.05)


def test_other_moments(spark):
    e = F.col("id")
    row = spark.range(50_000).select(
        noise.gaussian(1.0, 2.0, "m", e).alias("g"), noise.geometric(0.25, "m", e).alias("k"),
        noise.discrete_laplace(2.0, "m", e).alias("d"), noise.exponential(4.0, "m", e).alias("x"), noise.sign("m", e).alias("s"),
    ).agg(F.avg("g"), F.stddev("g"), F.avg("k"), F.avg("d"), F.avg(F.abs("d")), F.avg("x"), F.avg("s")).first()
    alpha = math.exp(-0.5)
    assert row[0] == pytest.approx(1.0, abs=0.05) and row[1] == pytest.approx(2.0, rel=0.02)
    assert row[2] == pytest.approx(3.0, rel=0.03)
    assert abs(row[3]) < 0.06 and row[4] == pytest.approx(2 * alpha / (1 - alpha**2), rel=0.03)
    assert row[5] == pytest.approx(0.25, rel=0.03) and abs(row[6]) < 0.02


def test_exponential_mechanism_frequencies(spark):
    scores = [0.0, 1.0, 2.0]
    rows = spark.range(20_000).selectExpr("id AS g", "inline(array(struct(0 AS c, 0D AS q), struct(1 AS c, 1D AS q), struct(2 AS c, 2D AS q)))")
    picks = M.exponential_mechanism(rows, ["g"], ["c"], "q", 0.7, 1.0, ("f",), order=["c"]).groupBy("c").count().collect()
    weights = [math.exp(0.7 * s / 2) for s in scores]
    for r in picks:
        assert r["count"] / 20_000 == pytest.approx(weights[r.c] / sum(weights), abs=0.015)
    flat = M.exponential_mechanism(rows, ["g"], ["c"], "q", 0.7, 0.0, ("f0",), order=["c"]).groupBy("c").count().collect()
    assert all(r["count"] / 20_000 == pytest.approx(1 / 3, abs=0.015) for r in flat)


def test_weighted_sample_uses_all_positive_items(spark):
    items = spark.createDataFrame([(1, 3.0), (2, -5.0), (3, 1.0), (4, 0.0)], "item int, w double")
    draws = spark.range(20_000)
    got = {r.item: r["count"] for r in M.weighted_sample(items, ["item"], "w", draws, noise.unit("w", F.col("id"))).groupBy("item").count().collect()}
    assert set(got) == {1, 3} and sum(got.values()) == 20_000
    assert got[1] / 20_000 == pytest.approx(0.75, abs=0.015)
    flat = items.withColumn("w", F.lit(-1.0))
    even = M.weighted_sample(flat, ["item"], "w", draws, noise.unit("w", F.col("id"))).groupBy("item").count().collect()
    assert len(even) == 4 and sum(r["count"] for r in even) == 20_000


def test_range_counts_of_many_attribute_sets(spark):
    names = [f"a{i}" for i in range(40)]
    domain = Domain({n: 3 + i % 4 for i, n in enumerate(names)})
    codes = [[(7 * r * r + 3 * i * r + i) % domain[n] for i, n in enumerate(names)] for r in range(3)]
    cells = spark.createDataFrame([(*c, r + 1) for r, c in enumerate(codes)], ", ".join(f"{n} int" for n in names) + ", v bigint")
    sets = [(i, j, k) for i in range(40) for j in range(i) for k in range(j)][:4200]
    queries = spark.createDataFrame([(q, names[a], 1, 2) for q, s in enumerate(sets) for a in s], "query_id int, attr string, lo int, hi int")
    want = {q: sum(r + 1 for r, c in enumerate(codes) if all(1 <= c[a] <= 2 for a in s)) for q, s in enumerate(sets)}
    assert {r.query_id: r.total for r in C.answer_ranges(cells, queries, domain).select("query_id", "total").collect()} == want
    view = cells.select(*[F.col(n).alias(f"{s}_{n}") for n in names for s in ("lo", "hi")], F.col("v").cast("double").alias("value"))
    few = queries.filter("query_id < 60")
    assert {r.query_id: r.estimate for r in A.view_range_count(view, few, domain).collect()} == {q: want[q] for q in range(60)}


def test_weighted_sample_takes_one_item_per_draw(spark):
    n = 100_000
    items = spark.range(n).selectExpr("id AS item", "pow(10D, pmod(id * 7919, 13) - 6) / 3 AS w")
    draws = spark.range(4 * n).withColumnRenamed("id", "draw")
    got = M.weighted_sample(items, ["item"], "w", draws, noise.unit("one", F.col("draw"))).agg(F.count(F.lit(1)), F.countDistinct("draw")).first()
    assert tuple(got) == (4 * n, 4 * n)
    edges = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 0.5), (3, 0.75)], "draw int, at double")
    even = spark.range(4).selectExpr("cast(id AS int) AS item", "1D AS w")
    assert all(r.item == r.draw for r in M.weighted_sample(even, ["item"], "w", edges, F.col("at")).collect())


def test_normalized_weights(spark):
    rows = spark.createDataFrame([(0, 1.5), (1, 0.3), (2, -0.8)], "i int, x double")
    got = [r.share for r in M.shift_weights(rows, "x", "share").orderBy("i").collect()]
    assert got == pytest.approx([0.67647059, 0.32352941, 0.0])


# ------------------------------------------------- domains, coding, generators


def test_domain_algebra():
    a, b = Domain({"a": 10, "b": 20}), Domain({"b": 20, "c": 30})
    assert a.merge(b) == Domain({"a": 10, "b": 20, "c": 30})
    assert a.drop(["a"]) == Domain({"b": 20}) and a.keep(["b", "a"]).attrs == ["b", "a"]
    assert Domain.from_json(a.to_json()) == a and a.cells() == 200
    with pytest.raises(ValueError):
        a.merge(Domain({"a": 11}))
    with pytest.raises(ValueError):
        Domain({"a": 0})


def test_grid_is_row_major(spark):
    rows = grid(spark, Domain({"a": 2, "b": 3})).orderBy("idx").collect()
    assert [(r.a, r.b) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


def test_missing_attribute_is_refused(spark, sf):
    with pytest.raises(ValueError):
        T.select_domain(lineitem_codes(spark, sf), Domain({"q": 50, "nope": 2}))


def test_grid_codes_clamp(spark):
    rows = spark.createDataFrame([(-5.0,), (0.0,), (99.9,), (100.0,), (400.0,)], "x double")
    got = [r.c for r in rows.select(Z.encode_grid(F.col("x"), 0.0, 100.0).alias("c")).collect()]
    assert got == [0, 0, 15, 15, 15]


def test_unseen_values_are_null_or_clamped(spark):
    a = spark.createDataFrame([("x", 1, 0.0), ("y", 5, 10.0)], "k string, i int, f double")
    b = spark.createDataFrame([("y", 9, -3.0), ("z", 1, 99.0)], "k string, i int, f double")
    fits = Z.fit(a, 10)
    assert [(f.kind, f.size) for f in fits] == [("category", 2), ("offset", 5), ("width", 10)]
    assert sorted(map(tuple, Z.apply_codes(b, fits, a).collect()), key=repr) == [(1, 4, 0), (None, 0, 9)]


def test_epoch_ignores_the_session_zone(spark):
    row = spark.createDataFrame([("2024-03-10 02:30:00",)], "s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for z in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            seen.add(row.select(K.parse_epoch(F.col("s"), "yyyy-MM-dd HH:mm:ss")).first()[0])
        assert seen == {1710037800}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_random_cells_are_distinct_and_exact(spark):
    small = Domain({"a": 4, "b": 5})
    for n in (1, 13, 20):
        rows = G.random_cells(spark, small, n, "c").collect()
        assert len(rows) == n and len({(r.a, r.b) for r in rows}) == n
    with pytest.raises(ValueError):
        G.random_cells(spark, small, 21, "c")


def test_sequential_cells_of_a_huge_domain(spark):
    huge = Domain({f"a{i}": 1000 for i in range(12)})
    rows = G.sequential_cells(spark, huge, 1500).orderBy("idx").collect()
    assert (rows[1234]["a10"], rows[1234]["a11"], rows[1234]["a0"]) == (1, 234, 0)


def test_permutation_is_a_bijection(spark):
    rows = G.permutation(spark, "a", 200, "p").collect()
    assert sorted(r.code for r in rows) == list(range(200)) == sorted(r.other for r in rows)


def test_workload_rows_and_answers_agree(spark, sf):
    """Whole-workload answers equal the same queries asked one by one."""
    domain = LI3.keep(["d", "r"])
    cells = C.count_table(lineitem_codes(spark, sf), domain)
    rows = W.to_query_rows(W.all_range_workload(domain.frame(spark), 2))
    direct = sorted(r.total for r in C.answer_ranges(cells, rows, domain).collect())
    whole = sorted(r.answer for r in W.all_range_answers_2d(cells, domain, "d", "r").collect())
    assert direct == whole and len(whole) == 66 * 6


def test_marginal_of_a_marginal(spark, sf):
    cells = C.count_table(lineitem_codes(spark, sf), LI3)
    assert sorted(map(tuple, C.marginal(C.marginal(cells, ["q", "d"]), ["d"]).collect())) == sorted(
        map(tuple, C.marginal(cells, ["d"]).collect())
    )


# ---------------------------------------------------------------- scratch, sinks


def test_views_are_pruned_by_partition(spark, sf):
    from cellview.catalog.base import tiled_view
    from cellview.session import fresh_path

    root = fresh_path(spark, "store")
    for trial in range(2):
        T.save_view(tiled_view(spark, sf), root, "tiles", 1.0, trial)
    one = T.load_views(spark, root, "tiles", 1.0, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
    assert one.count() == tiled_view(spark, sf).count()


def test_scratch_tables_are_only_removed_below_the_root(spark):
    from cellview.session import discard, materialize, scratch_root

    with pytest.raises(ValueError):
        discard(spark, "/somewhere/else")
    df = materialize(spark.range(5), "t")
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert path.startswith(scratch_root(spark))
    discard(spark, path)


# ---------------------------------------------------------------- cut scores


def _stats(cells, domain, codes):
    frontier = C.root_block(cells, domain)
    histogram = C.code_histogram(cells.withColumn("block", F.lit("0")), frontier, domain)
    return C.cut_statistics(histogram, C.candidate_cuts(frontier, domain), sum(domain.sizes.values()), codes=codes)


def test_dyadic_cut_statistics_equal_the_direct_ones(spark):
    domain = Domain({"a": 45, "b": 7})
    cells = spark.range(120).selectExpr("int(id * id % 45) AS a", "int(id % 7) AS b", "1 + id % 5 * (id % 3) AS v").groupBy("a", "b").agg(F.sum("v").alias("v"))
    direct = sorted(map(tuple, _stats(cells, domain, 0).collect()))
    before, C.DIRECT_CODES = C.DIRECT_CODES, 1
    try:
        dyadic = sorted(map(tuple, _stats(cells, domain, 45).collect()))
    finally:
        C.DIRECT_CODES = before
    assert len(direct) == 50 and dyadic == direct


def test_cuts_of_a_hundred_thousand_codes_are_scored(spark):
    domain = Domain({"a": 100_000, "b": 2})
    cells = spark.range(100_000).selectExpr("int(id) AS a", "int(id % 2) AS b", "1 + id % 11 AS v")
    stats = _stats(cells, domain, 100_000)
    assert stats.filter("pos = 0").count() == 99_999
    row = stats.filter("pos = 0 AND cut = 49999").first()
    half = cells.filter("a <= 49999").agg(F.sum("v")).first()[0]
    mean = half / row.size_l
    brute = cells.filter("a <= 49999").agg(F.sum(F.abs(F.col("v") - mean)), F.count("*")).first()
    assert row.total_l == half
    assert row.ae_l == pytest.approx(brute[0] + (row.size_l - brute[1]) * mean)
