"""Invariants of releases that no oracle row shows."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from cellview.catalog.base import LI3, LI5, fixed_queries, lineitem_cells
from cellview.catalog.networks import NET3, NET5, grid_cells
from cellview.domain import Domain
from cellview.operators import answer as A
from cellview.operators import cells as C
from cellview.operators import evaluate as E
from cellview.plans import bisection as B
from cellview.plans import dense as D
from cellview.plans import halving as H
from cellview.plans import network as N
from cellview.plans import settle as S


def tiles(leaves, domain):
    """Boxes cover the domain and none overlaps another."""
    rows = leaves.select(*domain.ranges()).collect()
    seen = set()
    for r in rows:
        spans = [range(r[f"lo_{a}"], r[f"hi_{a}"] + 1) for a in domain.attrs]
        for cell in itertools.product(*spans):
            assert cell not in seen
            seen.add(cell)
    return len(seen) == domain.cells()


def test_whole_bisection_tiles_and_counts(spark, sf):
    cells = lineitem_cells(spark, sf)
    n = cells.agg(F.sum("v")).first()[0]
    leaves = B.bisection_leaves(cells, LI3, seed="t1").persist()
    assert tiles(leaves, LI3)
    assert leaves.agg(F.sum("total")).first()[0] == n
    # the statistics gathered while splitting equal a fresh range join
    again = C.block_deviation(C.value_histogram(C.label_cells(cells, leaves, LI3, 100_000)), leaves, LI3)
    gap = again.join(leaves.selectExpr("block", "total AS t0", "ae AS ae0"), "block").filter(
        "total <> t0 or abs(ae - ae0) > 1e-6"
    )
    assert gap.count() == 0


def test_bisection_past_the_scored_levels(spark, sf):
    """With a tiny beta most cuts are random; the tree must still be exact."""
    cells = lineitem_cells(spark, sf)
    plan = B.BisectionPlan(beta=0.15)
    assert plan.scored_levels(LI3) == 2 and plan.last_scored_depth(LI3) == 1
    leaves = B.bisection_leaves(cells, LI3, plan, seed="t2", max_depth=5).persist()
    assert tiles(leaves, LI3)
    assert leaves.agg(F.max("depth")).first()[0] > 2
    again = C.block_deviation(C.value_histogram(C.label_cells(cells, leaves, LI3, 100_000)), leaves, LI3)
    assert again.join(leaves.selectExpr("block", "total AS t0", "ae AS ae0"), "block").filter(
        "total <> t0 or abs(ae - ae0) > 1e-6"
    ).count() == 0


def test_tree_tiles_and_counts(spark, sf):
    cells = lineitem_cells(spark, sf)
    leaves = H.halving_leaves(cells, LI3, seed="t3").persist()
    assert tiles(leaves, LI3)
    assert leaves.agg(F.sum("total")).first()[0] == cells.agg(F.sum("v")).first()[0]
    turn = H.halving_leaves(cells, LI3, seed="t4", cut_max=1).persist()
    assert tiles(turn, LI3)


def test_wide_tree_needs_a_cut_limit():
    wide = Domain({f"a{i}": 4 for i in range(13)})
    with pytest.raises(ValueError):
        H.rotating_targets(wide, None, 0)
    assert H.rotating_targets(wide, 3, 0) == {0, 1, 2}
    assert H.rotating_targets(wide, 3, 4) == {12, 0, 1}


def test_results_do_not_depend_on_partitioning(spark, sf):
    cells = lineitem_cells(spark, sf)
    one = B.bisection_view(cells.coalesce(1), LI3, seed="p", max_depth=3)
    many = B.bisection_view(cells.repartition(13), LI3, seed="p", max_depth=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_nearly_noise_free_view_answers_aligned_queries(spark, sf):
    """At a huge budget every leaf-aligned query is answered exactly."""
    cells = lineitem_cells(spark, sf)
    view = B.bisection_view(cells, LI3, B.BisectionPlan(epsilon=1e9), seed="e", max_depth=3).persist()
    queries = view.select(
        F.col("block").alias("query_id"),
        F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"lo_{a}").alias("lo"), F.col(f"hi_{a}").alias("hi")) for a in LI3.attrs])),
    )
    est = {r.query_id: r.estimate for r in A.view_range_count(view, queries, LI3).collect()}
    for r in view.select("block", "total").collect():
        assert est[r.block] == pytest.approx(r.total, abs=1e-3)


def test_large_frontiers_take_the_shuffled_path(spark, sf, monkeypatch):
    """Without broadcasts, and with every key treated as hot, rows stay equal."""
    from cellview.operators import layout

    cells = lineitem_cells(spark, sf)

    def everything():
        view = B.bisection_view(cells, LI3, seed="s", max_depth=4)
        answers = A.view_range_count(view, fixed_queries(spark), LI3)
        truths = C.answer_ranges(cells, fixed_queries(spark), LI3)
        tree = H.halving_view(cells, LI3, seed="s", max_depth=3)
        out = []
        for df in (view, tree, truths, answers.withColumn("estimate", F.round("estimate", 3))):
            out.append(sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr))
        return out

    usual = everything()
    monkeypatch.setattr(layout, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "SMALL_CELLS", 5)
    monkeypatch.setattr(layout, "HOT_ROWS", 7)
    assert everything() == usual


def test_buckets_cover_the_vector(spark, sf):
    cells = lineitem_cells(spark, sf)
    rows = D.l1_buckets(cells, LI3, 1.0, 0.5, "b").orderBy("first").collect()
    assert rows[0]["first"] == 0 and rows[-1]["last"] == LI3.cells() - 1
    for a, b in zip(rows, rows[1:]):
        assert b["first"] == a["last"] + 1


def test_buckets_follow_flat_and_steep_data(spark):
    """Costs with noise far below the price of a bucket: two flat halves, two buckets."""
    domain = Domain({"x": 16})
    cells = spark.createDataFrame([(i, 5 if i < 8 else 900) for i in range(16)], "x int, v bigint")
    rows = D.l1_buckets(cells, domain, 1e3, 0.999, "f").orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in rows] == [(0, 7), (8, 15)]


def test_dense_release_is_guarded(spark):
    big = Domain({f"a{i}": 1000 for i in range(5)})
    empty = spark.createDataFrame([], ", ".join(f"a{i} int" for i in range(5)) + ", v bigint")
    with pytest.raises(ValueError):
        D.laplace_histogram(empty, big, 1.0, "g")


def test_sparse_wide_domain_never_needs_a_grid(spark, sf):
    """1.5 million cells, few of them filled: the view still tiles by volume."""
    domain = Domain({"p": 100, "w": 100, "q": 50, "r": 3})
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "int(least(floor(l_extendedprice / 1100), 99)) AS p", "int(l_orderkey % 100) AS w", "int(l_quantity) - 1 AS q",
        "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r",
    )
    cells = C.count_table(rows, domain)
    leaves = B.bisection_leaves(cells, domain, seed="w", max_depth=5).persist()
    assert leaves.agg(F.sum("size")).first()[0] == domain.cells()
    assert leaves.agg(F.sum("total")).first()[0] == rows.count()


# ------------------------------------------------------------------- networks


def brute_maximal(placed, child, levels, bound):
    """All feasible parent sets without a feasible refinement, by enumeration."""
    tau = bound / levels[child].sizes[0]
    options = [[None, *range(levels[a].depth)] for a in placed]
    fits = []
    for pick in itertools.product(*options):
        width = math.prod(levels[a].sizes[lvl] for a, lvl in zip(placed, pick) if lvl is not None)
        if tau >= 1 and width <= tau:
            fits.append(pick)

    def covers(big, small):
        return big != small and all(s is None or (b is not None and b <= s) for b, s in zip(big, small))

    best = {p for p in fits if not any(covers(q, p) for q in fits)}
    return best or {tuple(None for _ in placed)}


@pytest.mark.parametrize("bound", [1.0, 17.0, 120.0, 800.0, 5000.0])
def test_parent_sets_are_the_maximal_ones(spark, bound):
    placed, free = ["q", "d", "r"], ["t", "s"]
    got = {}
    for r in N.parent_candidates(spark, placed, free, NET5, bound).collect():
        pick = tuple(None if r[f"lv_{a}"] < 0 else r[f"lv_{a}"] for a in placed)
        got.setdefault(r.child, set()).add(pick)
    for child in free:
        assert got[child] == brute_maximal(placed, child, NET5, bound)


def test_joint_bound_is_halved_when_scoring_is_too_costly():
    assert N.joint_bound(1000, 5, 1.0, 4.0) == pytest.approx(12.5)
    n = 10**9
    assert N.joint_bound(n, 40, 1.0, 4.0) == pytest.approx(n / 640)
    reduced = N.joint_bound(n, 40, 1.0, 4.0, work=2e12)
    k = int(math.log2(reduced))
    assert reduced < n / 640 and n * math.comb(40, k) <= 2e12


def test_synthesis_keeps_marginals_at_a_large_budget(spark, sf):
    cells = grid_cells(spark, sf, NET3)
    total = cells.agg(F.sum("v")).first()[0]
    rows = spark.range(total).withColumnRenamed("id", "rid")
    synthetic = N.synthesize(cells, rows, "rid", NET3, total, 1e6, seed="y")
    domain = Domain({"q": 16, "t": 16, "r": 3})
    distance = E.kway_distance(cells, C.count_table(synthetic, domain), domain, 1).first()
    assert distance.marginals == 3 and distance.tvd < 0.05


def test_mutual_information_variant_learns_a_network(spark, sf):
    cells = grid_cells(spark, sf, NET3)
    total = cells.agg(F.sum("v")).first()[0]
    model = N.learn_structure(cells, NET3, total, 1.0, seed="mi", score="information")
    assert sorted(f.child for f in model) == sorted(NET3)
    assert model[0].parents == ()


def test_taxonomy_levels_lift_to_the_first_covering_segment():
    tax = N.Hierarchy.taxonomy([[0, 1, 2, 3, 4], [1, 4]])
    assert tax.sizes == (5, 2)
    assert tax.lift("c", 1) == "array(0, 0, 1, 1, 1)[`c`]"
