"""Private releases: bisection, half-split trees, histograms and buckets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellview.catalog.base import (
    BOX_SQL, LI3, LI5, Q10_SQL, U, cells_sql, fixed_queries, inside_sql, laplace, lineitem_cells, query, rounded, settle, size_sql,
    tiled_view, uniform_int, utility, wide_sql,
)
from cellview.catalog.blocks import brute_cuts_sql, grid_cte
from cellview.functions import noise
from cellview.operators import answer as A
from cellview.operators.layout import number_rows
from cellview.plans import bisection as B
from cellview.plans import dense as D
from cellview.plans import halving as H
from cellview.session import fresh_path
from cellview.sources import tables as T

PLAN = B.BisectionPlan()
# levels that the SQL is unrolled to; the Spark side has no such bound, so a tree that
# grows deeper shows as a difference
SQL_DEPTH = 26


# ------------------------------------------------------------ bisection in SQL


def stop_sql(ae: str, size: str, depth: str, child: str, seed: str, trial: int) -> str:
    """Noisy test that a child stays open."""
    floor = PLAN.threshold + 2 - PLAN.depth_discount
    biased = settle(f"greatest({ae} - {PLAN.depth_discount!r}::DOUBLE * ({depth}), {floor!r}::DOUBLE)")
    draw = laplace(PLAN.stop_scale, f"'{seed}'", "'stop'", str(trial), child)
    return f"({size} > 1 AND {biased} + {draw} > {PLAN.threshold!r}::DOUBLE)"


def bisection_sql(domain, depth: int, seed: str, trial: int = 0) -> str:
    """CTE ``leaves`` from ``cells``: the level loop unrolled to ``depth`` levels."""
    ranges = ", ".join(domain.ranges())
    start = ", ".join(f"0 AS lo_{a}, {n - 1} AS hi_{a}" for a, n in domain.sizes.items())
    attrs = ", ".join(domain.attrs)
    out = [f"f0 AS (SELECT '0' AS block, 0 AS depth, {start})", f"c0 AS (SELECT '0' AS block, {attrs}, v FROM cells)"]
    for i in range(depth):
        sens = "2::DOUBLE * (2::DOUBLE - 2::DOUBLE / size)"
        z = utility("score", PLAN.epsilon_cut(domain), sens, f"'{seed}'", "'cut'", str(trial), "block", "attr", "cut")
        last = i + 1 == depth
        if i <= PLAN.last_scored_depth(domain):
            pick = [
                f"""best{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY z DESC, pos, cut) AS rn
                  FROM (SELECT *, {z} AS z FROM scored_{i})) WHERE rn = 1)"""
            ]
        else:
            spans = ", ".join(f"{{'attr': '{a}', 'lo': lo_{a}, 'hi': hi_{a}}}" for a in domain.attrs)
            where, cut = ((f"'{seed}'", "'random-cut'", str(trial), "block", part) for part in ("'attr'", "'cut'"))
            pick = [
                f"spans{i} AS (SELECT block, list_filter([{spans}], lambda x: x.lo < x.hi) AS spans FROM f{i})",
                f"turn{i} AS (SELECT block, spans[1 + {uniform_int('0', 'len(spans)', *where)}] AS e FROM spans{i})",
                f"chosen{i} AS (SELECT block, e.attr AS attr, {uniform_int('e.lo', 'e.hi', *cut)} AS cut FROM turn{i})",
                f"best{i} AS (SELECT s.* FROM scored_{i} s JOIN chosen{i} USING (block, attr, cut))",
            ]
        opens = [
            "FALSE" if last else stop_sql(f"ae_{s}", f"size_{s}", "depth + 1", f"block || '{s.upper()}'", seed, trial) for s in "lr"
        ]
        kids = []
        for s in "lr":
            cols = []
            for j, a in enumerate(domain.attrs):
                lo, hi = f"f.lo_{a}", f"f.hi_{a}"
                if s == "l":
                    hi = f"CASE WHEN pos = {j} THEN cut ELSE {hi} END"
                else:
                    lo = f"CASE WHEN pos = {j} THEN cut + 1 ELSE {lo} END"
                cols.append(f"{lo} AS lo_{a}, {hi} AS hi_{a}")
            kids.append(
                f"SELECT p.block || '{s.upper()}' AS block, p.depth + 1 AS depth, {', '.join(cols)}, total_{s} AS total, size_{s} AS size,"
                f" open_{s} AS open FROM p{i} p JOIN f{i} f ON f.block = p.block"
            )
        out += [
            brute_cuts_sql(domain, f"f{i}", f"c{i}", f"_{i}"),
            *pick,
            f"p{i} AS MATERIALIZED (SELECT *, {opens[0]} AS open_l, {opens[1]} AS open_r FROM best{i})",
            f"k{i} AS MATERIALIZED ({' UNION ALL '.join(kids)})",
            f"f{i + 1} AS (SELECT block, depth, {ranges} FROM k{i} WHERE open)",
            f"c{i + 1} AS MATERIALIZED (SELECT f.block, {', '.join('c.' + a for a in domain.attrs)}, c.v FROM cells c JOIN f{i + 1} f ON {inside_sql(domain, 'c', 'f')})",
        ]
    leaves = " UNION ALL ".join(f"SELECT block, depth, {ranges}, total, size FROM k{i} WHERE NOT open" for i in range(depth))
    return ",\n".join(out) + f",\nleaves AS MATERIALIZED ({leaves})"


def released_sql(scale: float, *key: str) -> str:
    """CTE ``view``: the leaves with noise and released value."""
    return f"""noisy AS (SELECT *, total / size AS mean, {laplace(scale, *key, 'block')} AS noise FROM leaves),
    view AS (SELECT *, mean + noise / size AS value FROM noisy)"""


VIEW = ["block", "depth", *LI3.ranges(), "total", "size", "noise", "value"]
BISECTION = f"{cells_sql()}, {bisection_sql(LI3, SQL_DEPTH, 'bv')}, {released_sql(1 / PLAN.epsilon_leaf, chr(39) + 'bv' + chr(39), chr(39) + 'leaf' + chr(39), '0')}"


def whole_bisection(spark, sf):
    return B.bisection_view(lineitem_cells(spark, sf), LI3, PLAN, seed="bv")


@query("bisect_view", f"WITH {BISECTION} SELECT {', '.join(VIEW)} FROM view")
def bisect_view(spark, sf):
    return whole_bisection(spark, sf).select(*VIEW)


def estimate_sql(source: str, domain, queries: str = "wq", digits: int | None = 3) -> str:
    """Brute-force range counts on the boxes of ``source``."""
    parts = " * ".join(
        f"greatest(least(w.hi_{a}, b.hi_{a}) - greatest(w.lo_{a}, b.lo_{a}) + 1, 0)::DOUBLE" for a in domain.attrs
    )
    total = f"coalesce(sum({parts} * b.value), 0)"
    return f"SELECT w.query_id, {total if digits is None else settle(total, digits)} AS estimate FROM {queries} w CROSS JOIN {source} b GROUP BY w.query_id"


@query("bisect_view_answers", f"WITH {BISECTION}, {Q10_SQL}, {wide_sql(LI3)} {estimate_sql('view', LI3)}")
def flagship(spark, sf):
    view = B.published(whole_bisection(spark, sf), LI3)
    return rounded(A.view_range_count(view, fixed_queries(spark), LI3), "estimate")


@query(
    "bisect_view_open",
    f"""WITH {cells_sql()}, {bisection_sql(LI3, SQL_DEPTH, 'bo')}, {released_sql(1 / PLAN.epsilon_leaf, "'bo'", "'leaf'", '0')}
    SELECT {', '.join(VIEW)} FROM view""",
)
def bisect_view_open(spark, sf):
    """The whole tree: levels until every block is closed."""
    return B.bisection_view(lineitem_cells(spark, sf), LI3, PLAN, seed="bo").select(*VIEW)


@query(
    "stop_test",
    f"""WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS block, o_totalprice / 5000 AS ae, 1::DOUBLE + o_orderkey % 3 AS size, CAST(o_custkey % 9 AS INTEGER) AS depth FROM orders)
    SELECT block, NOT {stop_sql('ae', 'size', 'depth', 'block', 'st', 0)} AS leaf FROM k""",
)
def stop_test(spark, sf):
    blocks = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "string(o_orderkey) AS block", "o_totalprice / 5000 AS ae", "1.0D + o_orderkey % 3 AS size", "int(o_custkey % 9) AS depth"
    )
    stays = B.keeps_open(F.col("ae"), F.col("size"), F.col("depth"), PLAN, "st", "stop", 0, F.col("block"))
    return blocks.select("block", (~stays).alias("leaf"))


@query(
    "order_leaves",
    f"WITH {cells_sql()}, {BOX_SQL} SELECT {', '.join(LI3.ranges())}, row_number() OVER (ORDER BY {', '.join(LI3.ranges())}) AS rank FROM view",
)
def order_leaves(spark, sf):
    return number_rows(tiled_view(spark, sf).select(*LI3.ranges()), LI3.ranges(), "rank", start=1)


@query(
    "perturb_leaves",
    f"""WITH {cells_sql()}, {BOX_SQL}, leaves AS (SELECT lo_q || '-' || lo_d || '-' || lo_r AS block, CAST(tot AS BIGINT) AS total, {size_sql(LI3)} AS size FROM view),
    {released_sql(10.0, "'pl'").replace('view AS', 'released AS')} SELECT block, noise, value FROM released""",
)
def perturb_leaves(spark, sf):
    leaves = tiled_view(spark, sf).selectExpr("concat_ws('-', lo_q, lo_d, lo_r) AS block", "tot AS total", *LI3.ranges())
    return B.perturb_leaves(leaves.withColumn("size", LI3.size_column()), 10.0, "pl").select("block", "noise", "value")


# ------------------------------------------------------------------ half splits


def halves_sql(domain, source: str, targets: set[int]) -> str:
    """SELECT of the children of ``source`` nodes."""
    joins, digits, cols = [], [], []
    for i, a in enumerate(domain.attrs):
        if i not in targets:
            cols.append(f"lo_{a}, hi_{a}")
            continue
        joins.append(f"JOIN (VALUES (0), (1)) h{i}(s{i}) ON s{i} = 0 OR lo_{a} < hi_{a}")
        digits.append(f"s{i}")
        mid = f"(lo_{a} + hi_{a}) // 2"
        cols.append(f"CASE WHEN s{i} = 1 THEN {mid} + 1 ELSE lo_{a} END AS lo_{a}, CASE WHEN s{i} = 0 AND lo_{a} < hi_{a} THEN {mid} ELSE hi_{a} END AS hi_{a}")
    return f"SELECT block || '/' || {' || '.join(digits)} AS block, depth + 1 AS depth, {', '.join(cols)} FROM {source} {' '.join(joins)}"


def tree_sql(domain, depth: int, epsilon: float, seed: str, cut_max=None, trial: int = 0) -> str:
    """CTE ``leaves``: the tree loop unrolled."""
    fanout = 2 ** len(H.rotating_targets(domain, cut_max, 0))
    scale = H.tree_scale(fanout, epsilon)
    discount = scale * math.log(fanout)
    start = ", ".join(f"0 AS lo_{a}, {n - 1} AS hi_{a}" for a, n in domain.sizes.items())
    ranges = ", ".join(domain.ranges())
    out = [f"n0 AS (SELECT '0' AS block, 0 AS depth, {start})"]
    for i in range(depth + 1):
        biased = settle(f"greatest(total - {discount * i!r}::DOUBLE, {-discount!r}::DOUBLE)")
        draw = laplace(scale, f"'{seed}'", "'tree'", str(trial), "block")
        test = "FALSE" if i == depth else f"{biased} + {draw} > 0 AND size > 1"
        out += [
            f"""t{i} AS (SELECT n.block, n.depth, {', '.join('n.' + c for c in domain.ranges())}, coalesce(CAST(sum(v) AS BIGINT), 0) AS total, any_value({size_sql(domain, 'n')}) AS size
              FROM n{i} n LEFT JOIN cells c ON {inside_sql(domain, 'c', 'n')} GROUP BY n.block, n.depth, {', '.join('n.' + c for c in domain.ranges())})""",
            f"j{i} AS MATERIALIZED (SELECT *, {test} AS open FROM t{i})",
        ]
        if i < depth:
            out += [f"o{i} AS (SELECT * FROM j{i} WHERE open)", f"n{i + 1} AS ({halves_sql(domain, f'o{i}', H.rotating_targets(domain, cut_max, i))})"]
    leaves = " UNION ALL ".join(f"SELECT block, depth, {ranges}, total, size FROM j{i} WHERE NOT open" for i in range(depth + 1))
    return ",\n".join(out) + f",\nleaves AS MATERIALIZED ({leaves})"


@query(
    "tree_view",
    f"""WITH {cells_sql()}, {tree_sql(LI3, 6, 1.0, 'tv')}, {released_sql(2.0, "'tv'", "'tree-leaf'", '0')} SELECT {', '.join(VIEW)} FROM view""",
)
def tree_view(spark, sf):
    return H.halving_view(lineitem_cells(spark, sf), LI3, 1.0, seed="tv").select(*VIEW)


@query(
    "tree_view_round_robin",
    f"""WITH {cells_sql()}, {tree_sql(LI3, 12, 1.0, 'tr', 2)}, {released_sql(2.0, "'tr'", "'tree-leaf'", '0')} SELECT {', '.join(VIEW)} FROM view""",
)
def tree_view_round_robin(spark, sf):
    return H.halving_view(lineitem_cells(spark, sf), LI3, 1.0, seed="tr", cut_max=2).select(*VIEW)


@query(
    "tree_view_open",
    # fifty codes halve at most six times, so depth six is the whole tree
    f"""WITH {cells_sql()}, {tree_sql(LI3, 6, 1.0, 'to')}, {released_sql(2.0, "'to'", "'tree-leaf'", '0')} SELECT {', '.join(VIEW)} FROM view""",
)
def tree_view_open(spark, sf):
    """The whole tree: levels until no node splits."""
    return H.halving_view(lineitem_cells(spark, sf), LI3, 1.0, seed="to").select(*VIEW)


NODES = "SELECT lo_q || '-' || lo_d || '-' || lo_r AS block, 0 AS depth, lo_q, hi_q, lo_d, hi_d, lo_r, hi_r FROM view"


def box_nodes(spark, sf):
    return tiled_view(spark, sf).selectExpr("concat_ws('-', lo_q, lo_d, lo_r) AS block", "0 AS depth", *LI3.ranges())


@query("half_split", f"WITH {cells_sql()}, {BOX_SQL}, nodes AS ({NODES}) {halves_sql(LI3, 'nodes', {0, 1, 2})}")
def half_split(spark, sf):
    return H.half_split(box_nodes(spark, sf), LI3)


@query(
    "half_split_round_robin",
    f"WITH {cells_sql()}, {BOX_SQL}, nodes AS ({NODES}), once AS ({halves_sql(LI3, 'nodes', {0})}) {halves_sql(LI3, 'once', {1})}",
)
def half_split_round_robin(spark, sf):
    once = H.half_split(box_nodes(spark, sf), LI3, cut_max=1, depth=0)
    return H.half_split(once, LI3, cut_max=1, depth=1)


# ------------------------------------------------------------- dense releases


def vector_sql(domain) -> str:
    cols = ", ".join(domain.attrs)
    return f"{cells_sql(domain)}, {grid_cte(domain)}, vec AS (SELECT idx, {cols}, coalesce(v, 0) AS v FROM grid LEFT JOIN cells USING ({cols}))"


def histogram_sql(seed: str, trial: int = 0) -> str:
    """CTE ``hist``: the noisy dense histogram of (q, d, r)."""
    draw = laplace(1.0, f"'{seed}'", "'histogram'", str(trial), "idx")
    return f"{vector_sql(LI3)}, hist AS (SELECT idx, q, d, r, v, {settle(f'v + {draw}')} AS y FROM vec)"


@query("laplace_histogram", f"WITH {histogram_sql('lh')} SELECT * FROM hist")
def laplace_histogram(spark, sf):
    return D.laplace_histogram(lineitem_cells(spark, sf), LI3, 1.0, "lh")


def marginals_sql(seed: str) -> str:
    """CTE ``marg``: released projections (q) and (d, r)."""
    draw = laplace(2.0, f"'{seed}'", "'marginal'", "0", "proj", "idx")
    return f"""{vector_sql(LI3)}, proj AS (SELECT 'q' AS proj, CAST(q AS BIGINT) AS idx, CAST(sum(v) AS BIGINT) AS v FROM vec GROUP BY q
      UNION ALL SELECT 'd,r', CAST(d * 3 + r AS BIGINT), CAST(sum(v) AS BIGINT) FROM vec GROUP BY d, r),
    marg AS (SELECT proj, idx, v, {settle(f'v + {draw}')} AS y FROM proj)"""


@query("laplace_marginals", f"WITH {marginals_sql('lm')} SELECT * FROM marg")
def laplace_marginals(spark, sf):
    return D.laplace_marginals(lineitem_cells(spark, sf), LI3, [["q"], ["d", "r"]], 1.0, "lm")


def buckets_sql(domain, epsilon: float, ratio: float, seed: str, trial: int = 0) -> str:
    """CTE ``buckets``: dyadic costs from the definition, then the best cover."""
    levels, n = D.heap_levels(domain), domain.cells()
    width = 1 << levels
    scale, price = 2.0 * levels / (ratio * epsilon), 1.0 / ((1 - ratio) * epsilon)
    draw = laplace(scale, f"'{seed}'", "'interval'", str(trial), "h")
    cost = f"coalesce(dev, 0) + CASE WHEN h < {width} THEN {draw} ELSE 0 END + {price!r}::DOUBLE"
    out = [
        f"padded AS (SELECT range AS idx, coalesce(v, 0) AS v FROM range({width}) LEFT JOIN vec ON vec.idx = range)",
        f"lvl AS (SELECT (({width} + idx) >> up) AS h, v FROM padded CROSS JOIN (SELECT CAST(range AS INTEGER) AS up FROM range({levels + 1})))",
        "mean AS (SELECT h, avg(v) AS m FROM lvl GROUP BY h)",
        "devs AS (SELECT h, sum(abs(v - m)) AS dev FROM lvl JOIN mean USING (h) GROUP BY h)",
        f"costs AS MATERIALIZED (SELECT h, {settle(cost)} AS cost FROM devs)",
        f"best0 AS (SELECT h, cost AS best, TRUE AS keep FROM costs WHERE h >= {width})",
    ]
    for up in range(1, levels + 1):
        out.append(
            f"""best{up} AS MATERIALIZED (SELECT c.h, least(cost, below) AS best, cost <= below AS keep FROM costs c
            JOIN (SELECT h >> 1 AS h, {settle('sum(best)')} AS below FROM best{up - 1} GROUP BY 1) b ON b.h = c.h)"""
        )
    kept = " UNION ALL ".join(f"SELECT h, {up} AS up FROM best{up} WHERE keep" for up in range(levels + 1))
    above = f"SELECT k.h FROM kept k CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(1, {levels + 1})) JOIN kept a ON a.h = (k.h >> j)"
    out += [
        f"kept AS MATERIALIZED ({kept})",
        f"""buckets AS MATERIALIZED (SELECT h, (h << up) - {width} AS first, least(((h + 1) << up) - {width} - 1, {n - 1}) AS last
        FROM kept WHERE h NOT IN ({above}) AND (h << up) - {width} < {n})""",
    ]
    return ",\n".join(out)


def bucket_means_sql(seed: str, trial: int = 0) -> str:
    """CTE ``rel``: every bucket of ``buckets`` with its released mean ``y``."""
    draw = laplace(2.0, f"'{seed}'", "'bucket'", str(trial), "first")
    return f"""tot AS (SELECT first, last, CAST(sum(v) AS BIGINT) AS total FROM buckets JOIN vec ON idx BETWEEN first AND last GROUP BY first, last),
    rel AS (SELECT first, last, total / (last - first + 1)::DOUBLE + {draw} / (last - first + 1)::DOUBLE AS y FROM tot)"""


BUCKETS = f"{vector_sql(LI3)}, {buckets_sql(LI3, 1.0, 0.5, 'lb')}"


@query("l1_buckets", f"WITH {BUCKETS} SELECT h, first, last FROM buckets")
def l1_buckets(spark, sf):
    return D.l1_buckets(lineitem_cells(spark, sf), LI3, 1.0, 0.5, "lb")


@query(
    "bucket_release",
    f"""WITH {BUCKETS}, {bucket_means_sql('lb')} SELECT idx, y FROM rel JOIN vec ON idx BETWEEN first AND last""",
)
def bucket_release(spark, sf):
    cells = lineitem_cells(spark, sf)
    buckets = D.l1_buckets(cells, LI3, 1.0, 0.5, "lb")
    return D.bucket_release(cells, buckets, LI3, 1.0, 0.5, "lb")


# ---------------------------------------------------------------- stored views


@query(
    "view_store",
    f"""WITH {cells_sql()}, {BOX_SQL}, stored AS (SELECT v.*, eps, trial FROM view v CROSS JOIN (VALUES (0.5::DOUBLE, 0), (1.0::DOUBLE, 0), (1.0::DOUBLE, 1)) e(eps, trial))
    SELECT 'tiles' AS method, eps, trial, count(*) AS leaves, round(sum(value * ({size_sql(LI3)})), 3) AS total FROM stored WHERE eps = 1.0 GROUP BY eps, trial""",
)
def view_store(spark, sf):
    root, view = fresh_path(spark, "views"), tiled_view(spark, sf).drop("tot")
    for eps, trial in ((0.5, 0), (1.0, 0), (1.0, 1)):
        T.save_view(view, root, "tiles", eps, trial)
    stored = T.load_views(spark, root, "tiles", 1.0)
    return stored.groupBy("method", "eps", "trial").agg(
        F.count(F.lit(1)).alias("leaves"), F.round(F.sum(F.col("value") * LI3.size_column()), 3).alias("total")
    )
