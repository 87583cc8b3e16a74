"""Queries on releases, sampling from views, and measured utility."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cellview.catalog.base import (
    BOX_SQL, LI3, Q10_SQL, U, cells_sql, fixed_queries, inside_sql, lineitem_cells, query, random_ranges_sql, rounded, settle,
    size_sql, table, tiled_view, uniform_int, wide_sql,
)
from cellview.catalog.networks import THETA as N_THETA
from cellview.catalog.networks import conditionals_sql, families_sql, sampling_sql, structure_sql
from cellview.catalog.releases import (
    PLAN, SQL_DEPTH, bisection_sql, bucket_means_sql, buckets_sql, estimate_sql, histogram_sql, marginals_sql, released_sql, tree_sql, vector_sql,
)
from cellview.catalog.workloads import marginals_sql as kway_sql
from cellview.domain import grid
from cellview.functions import noise
from cellview.operators import answer as A
from cellview.operators import cells as C
from cellview.operators import evaluate as E
from cellview.operators import mechanisms as M
from cellview.operators import workload as W
from cellview.plans import bisection as B
from cellview.plans import dense as D
from cellview.plans import halving as H
from cellview.plans import network as N
from cellview.session import fresh_path, materialize
from cellview.sources import tables as T

VIEW_SQL = f"{cells_sql()}, {BOX_SQL}"
CUSTOMERS = "SELECT c_custkey AS query_id FROM customer"


def customer_queries(spark, sf, k=2, seed="vq"):
    return W.random_ranges(table(spark, sf, "customer").selectExpr("c_custkey AS query_id"), LI3, k, seed)


@query("view_range_count", f"WITH {VIEW_SQL}, {random_ranges_sql(CUSTOMERS, LI3, 2, 'vq')}, {wide_sql(LI3)} {estimate_sql('view', LI3)}")
def view_range_count(spark, sf):
    return rounded(A.view_range_count(tiled_view(spark, sf), customer_queries(spark, sf), LI3), "estimate")


@query("view_range_count_fixed", f"WITH {VIEW_SQL}, {Q10_SQL}, {wide_sql(LI3)} {estimate_sql('view', LI3)}")
def view_range_count_fixed(spark, sf):
    return rounded(A.view_range_count(tiled_view(spark, sf), fixed_queries(spark), LI3), "estimate")


@query(
    "view_marginal",
    f"""WITH {VIEW_SQL}, pt AS (SELECT CAST(range AS INTEGER) AS x FROM range(50))
    SELECT a.x AS q, b.x AS d, {settle("sum(value * (" + size_sql(LI3) + ") / ((hi_q - lo_q + 1) * (hi_d - lo_d + 1)))", 3)} AS y
    FROM view JOIN pt a ON a.x BETWEEN lo_q AND hi_q JOIN pt b ON b.x BETWEEN lo_d AND hi_d GROUP BY a.x, b.x""",
)
def view_marginal(spark, sf):
    return rounded(A.view_marginal(tiled_view(spark, sf), LI3, ["q", "d"]), "y")


@query("histogram_marginal", f"WITH {histogram_sql('hm')} SELECT d, r, {settle('sum(y)')} AS y FROM hist GROUP BY d, r")
def histogram_marginal(spark, sf):
    return A.histogram_marginal(D.laplace_histogram(lineitem_cells(spark, sf), LI3, 1.0, "hm"), ["d", "r"])


@query("stored_marginal", f"WITH {marginals_sql('sm')} SELECT idx, y FROM marg WHERE proj = 'd,r'")
def stored_marginal(spark, sf):
    released = D.laplace_marginals(lineitem_cells(spark, sf), LI3, [["q"], ["d", "r"]], 1.0, "sm")
    return A.stored_marginal(released, ["d", "r"])


def sample_sql(weight: str, source: str = "view") -> str:
    points = ", ".join(
        f"CAST(lo_{a} + floor({U(chr(39) + 'vs' + chr(39), chr(39) + 'point' + chr(39), chr(39) + a + chr(39), 'o_orderkey')} * (hi_{a} - lo_{a} + 1)) AS INTEGER) AS {a}"
        for a in LI3.attrs
    )
    order = ", ".join(LI3.ranges())
    return f"""w AS (SELECT *, {weight} AS w FROM {source}), ends AS (SELECT *, sum(w) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS hi FROM w),
    cum AS (SELECT *, lag(hi, 1, 0) OVER (ORDER BY {order}) AS before FROM ends), t AS (SELECT max(hi) AS total FROM cum), dr AS (SELECT o_orderkey, {U("'vs'", "'box'", 'o_orderkey')} AS u FROM orders)
    SELECT o_orderkey, {points} FROM dr CROSS JOIN t JOIN cum ON w > 0 AND u >= before / total AND u < hi / total"""


@query("view_sample", f"WITH {VIEW_SQL}, {sample_sql(f'greatest({settle(f'value * ({size_sql(LI3)})')}, 0)')}")
def view_sample(spark, sf):
    return A.view_sample(tiled_view(spark, sf), table(spark, sf, "orders"), "o_orderkey", LI3, "vs")


@query(
    "view_sample_shift",
    f"""WITH {VIEW_SQL}, x AS (SELECT *, {settle(f'value * ({size_sql(LI3)})')} AS x FROM view), m AS (SELECT min(x) AS lo, sum(x) - count(*) * min(x) AS mass FROM x),
    {sample_sql('(x - lo) / mass', '(SELECT * FROM x CROSS JOIN m)')}""",
)
def view_sample_shift(spark, sf):
    return A.view_sample(tiled_view(spark, sf), table(spark, sf, "orders"), "o_orderkey", LI3, "vs", mode="shift")


@query(
    "normalize_weights",
    f"SELECT c_custkey, {settle('(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT sum(c_acctbal) - count(*) * min(c_acctbal) FROM customer)', 9)} AS share FROM customer",
)
def normalize_weights(spark, sf):
    shares = M.shift_weights(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "share")
    return shares.select("c_custkey", noise.settle(F.col("share"), 9).alias("share"))


@query(
    "view_size",
    f"""WITH {VIEW_SQL}, s AS (SELECT lo_r AS trial, count(*) AS leaves, CAST(count(*) * 40 AS BIGINT) AS bytes FROM view GROUP BY lo_r)
    SELECT trial, leaves, bytes, {4 * LI3.cells() + 96}::DOUBLE AS dense_bytes, CASE WHEN bytes < 1024 THEN printf('%.2f', bytes::DOUBLE) || ' B'
    WHEN bytes < 1048576 THEN printf('%.2f', bytes / 1024::DOUBLE) || ' KB' ELSE printf('%.2f', bytes / 1048576::DOUBLE) || ' MB' END AS size_text FROM s""",
)
def view_size(spark, sf):
    # the tiles of one flag value stand for one stored view
    return A.view_size(tiled_view(spark, sf).withColumn("trial", F.col("lo_r")), ["trial"], LI3)


@query(
    "view_size_stored",
    f"""WITH {VIEW_SQL}, stored AS (SELECT t.trial, v.* FROM view v CROSS JOIN (VALUES (0), (1), (2)) t(trial) WHERE lo_r >= t.trial)
    SELECT trial, count(*) AS leaves, CAST(count(*) * 40 AS BIGINT) AS bytes, TRUE AS has_files, TRUE AS grows FROM stored GROUP BY trial""",
)
def view_size_stored(spark, sf):
    """Three stored views of falling size: leaves, formula, and whether their files follow."""
    root, view = fresh_path(spark, "views"), tiled_view(spark, sf).drop("tot")
    for trial in range(3):
        T.save_view(view.where(F.col("lo_r") >= trial), root, "tiles", 1.0, trial)
    sizes = A.stored_sizes(T.load_views(spark, root, "tiles", 1.0), ["trial"], LI3)
    smaller = sizes.select((F.col("trial") - 1).alias("trial"), F.col("stored_bytes").alias("less"))
    return sizes.join(smaller, "trial", "left").select(
        "trial", "leaves", "bytes", (F.col("files") > 0).alias("has_files"), (F.col("stored_bytes") > F.coalesce("less", F.lit(0))).alias("grows")
    )


@query(
    "leaf_rectangles",
    f"WITH {VIEW_SQL} SELECT CAST(lo_q - 0.5 AS DOUBLE) AS x0, CAST(hi_q + 0.5 AS DOUBLE) AS x1, CAST(lo_d - 0.5 AS DOUBLE) AS y0, CAST(hi_d + 0.5 AS DOUBLE) AS y1 FROM view",
)
def leaf_rectangles(spark, sf):
    rects = A.leaf_rectangles(tiled_view(spark, sf), "q", "d")
    return rects.select(*[F.col(c).cast("double").alias(c) for c in rects.columns])


# -------------------------------------------------------------------- utility

TRUTH_SQL = f"""truth AS (SELECT w.query_id, coalesce(CAST(sum(c.v) AS BIGINT), 0) AS truth FROM wq w LEFT JOIN cells c ON {inside_sql(LI3, 'c', 'w')} GROUP BY w.query_id)"""
ERRORS_SQL = f"""{random_ranges_sql(CUSTOMERS, LI3, 2, 'vq')}, {wide_sql(LI3)}, {TRUTH_SQL}, est AS ({estimate_sql('view', LI3, digits=None)}),
errors AS (SELECT query_id, estimate, truth, abs(estimate - truth) AS abs_err, (estimate - truth) * (estimate - truth) AS sq_err FROM est JOIN truth USING (query_id))"""


def tile_errors(spark, sf):
    queries = customer_queries(spark, sf)
    truths = C.answer_ranges(lineitem_cells(spark, sf), queries, LI3).selectExpr("query_id", "total AS truth")
    return E.query_errors(A.view_range_count(tiled_view(spark, sf), queries, LI3), truths)


@query("query_errors", f"WITH {VIEW_SQL}, {ERRORS_SQL} SELECT query_id, {settle('estimate', 3)} AS estimate, truth, {settle('abs_err', 3)} AS abs_err, {settle('sq_err', 3)} AS sq_err FROM errors")
def query_errors(spark, sf):
    return rounded(tile_errors(spark, sf), "estimate", "abs_err", "sq_err")


SUMMARY = f"""count(*) AS times, {settle('avg(mae)')} AS mae, {settle('stddev_pop(mae)')} AS mae_std, {settle('avg(rmse)')} AS rmse,
{settle('stddev_pop(rmse)')} AS rmse_std, {settle('avg(leaves)')} AS leaves, {settle('stddev_pop(leaves)')} AS leaves_std"""
METHODS = ("bisection", "halving", "histogram", "buckets", "network")
CHEAP = ("halving", "histogram")
FLAT: N.Levels = {a: N.Hierarchy.flat(n) for a, n in LI3.sizes.items()}
LINE_KEY = "l_orderkey * 8 + l_linenumber"


def release_sql(method: str, seed: str, trial: int) -> tuple[str, str]:
    """CTEs of a release of (q, d, r), and its boxes with their values."""
    ranges = ", ".join(LI3.ranges())
    points = ", ".join(f"{a} AS lo_{a}, {a} AS hi_{a}" for a in LI3.attrs)
    key = f"'{seed}'"
    if method == "bisection":
        leaf = released_sql(1 / PLAN.epsilon_leaf, key, "'leaf'", str(trial))
        return f"{cells_sql()}, {bisection_sql(LI3, SQL_DEPTH, seed, trial)}, {leaf}", f"SELECT {ranges}, value FROM view"
    if method == "halving":
        leaf = released_sql(2.0, key, "'tree-leaf'", str(trial))
        return f"{cells_sql()}, {tree_sql(LI3, 6, 1.0, seed, trial=trial)}, {leaf}", f"SELECT {ranges}, value FROM view"
    if method == "histogram":
        return histogram_sql(seed, trial), f"SELECT {points}, y AS value FROM hist"
    if method == "buckets":
        body = f"{vector_sql(LI3)}, {buckets_sql(LI3, 1.0, 0.5, seed, trial)}, {bucket_means_sql(seed, trial)}"
        return body, f"SELECT {points}, y AS value FROM rel JOIN vec ON idx BETWEEN first AND last"
    source = f"{cells_sql()}, nn AS (SELECT count(*) AS n FROM lineitem), lines AS (SELECT {LINE_KEY} AS rid FROM lineitem)"
    body = f"""{structure_sql(FLAT, seed, trial, source)}, {families_sql(FLAT, seed, trial)}, {conditionals_sql(FLAT)},
    {sampling_sql(FLAT, seed, trial, 'lines', 'rid')}"""
    cols = ", ".join(LI3.attrs)
    return body, f"SELECT {points}, count(*)::DOUBLE AS value FROM s{len(LI3.attrs)} GROUP BY {cols}"


def release(spark, sf, cells, method: str, seed: str, trials: tuple[int, ...]):
    """Releases of (q, d, r) as boxes, one per trial: ``method, trial, lo_*, hi_*, value``."""
    points = [F.col(a).alias(f"{s}_{a}") for a in LI3.attrs for s in ("lo", "hi")]
    if method == "bisection":
        view = B.bisection_views(cells, LI3, seed=seed, trials=trials)
    elif method == "halving":
        view = H.halving_views(cells, LI3, seed=seed, trials=trials)
    elif method == "histogram":
        view = D.laplace_histograms(cells, LI3, 1.0, seed, trials).select("trial", *points, F.col("y").alias("value"))
    else:
        view = None
        for trial in trials:
            if method == "buckets":
                means = D.bucket_release(cells, D.l1_buckets(cells, LI3, 1.0, 0.5, seed, trial), LI3, 1.0, 0.5, seed, trial)
                one = grid(spark, LI3).join(means, "idx").select(F.lit(trial).alias("trial"), *points, F.col("y").alias("value"))
            else:
                synthetic = network_records(spark, sf, cells, seed, trial)
                one = C.count_table(synthetic, LI3).select(F.lit(trial).alias("trial"), *points, F.col("v").cast("double").alias("value"))
            view = one if view is None else view.unionAll(one)
    return view.select(F.lit(method).alias("method"), "trial", *LI3.ranges(), "value")


def network_records(spark, sf, cells, seed: str, trial: int = 0):
    """Synthetic (q, d, r) records of a learned network, one per line item."""
    lines = table(spark, sf, "lineitem").selectExpr(f"{LINE_KEY} AS rid")
    return N.synthesize(cells, lines, "rid", FLAT, lines.count(), 1.0, N_THETA, seed, trial)


def comparison_sql(methods, trials: int, seed: str) -> str:
    """Summary of several trials of each method on one random workload."""
    arms = []
    for trial in range(trials):
        for method in methods:
            body, boxes = release_sql(method, seed, trial)
            arms.append(f"SELECT '{method}' AS method, {trial} AS trial, * FROM (WITH {body} {boxes})")
    parts = " * ".join(
        f"greatest(least(w.hi_{a}, b.hi_{a}) - greatest(w.lo_{a}, b.lo_{a}) + 1, 0)::DOUBLE" for a in LI3.attrs
    )
    return f"""WITH {cells_sql()}, {random_ranges_sql(CUSTOMERS, LI3, 2, seed)}, {wide_sql(LI3)}, {TRUTH_SQL},
    views AS MATERIALIZED ({' UNION ALL '.join(arms)}),
    est AS (SELECT method, trial, query_id, sum({parts} * b.value) AS estimate FROM wq w CROSS JOIN views b GROUP BY ALL),
    gaps AS (SELECT method, trial, estimate - truth AS gap FROM est JOIN truth USING (query_id)),
    per AS (SELECT method, trial, avg(abs(gap)) AS mae, sqrt(avg(gap * gap)) AS rmse FROM gaps GROUP BY method, trial),
    parts AS (SELECT method, trial, count(*) AS leaves FROM views GROUP BY method, trial)
    SELECT method, {SUMMARY} FROM per JOIN parts USING (method, trial) GROUP BY method"""


def comparison(spark, sf, methods, trials: int, seed: str):
    cells = materialize(lineitem_cells(spark, sf), "cells")  # every release and the truths read them
    queries = materialize(customer_queries(spark, sf, seed=seed), "queries")
    truths = C.answer_ranges(cells, queries, LI3).selectExpr("query_id", "total AS truth")
    views = None
    for method in methods:
        view = release(spark, sf, cells, method, seed, tuple(range(trials)))
        views = view if views is None else views.unionAll(view)
    return E.compare_views(views, queries, truths, LI3)


def saved(results):
    """``results`` written to a sink and read back."""
    path = fresh_path(results.sparkSession, "results")
    T.save_results(results, path)
    return results.sparkSession.read.schema(results.schema).json(path)


@query("trial_summary", comparison_sql(CHEAP, 3, "ts"))
def trial_summary(spark, sf):
    return comparison(spark, sf, CHEAP, 3, "ts")


@query("result_sink", comparison_sql(CHEAP, 2, "rs"))
def result_sink(spark, sf):
    return saved(comparison(spark, sf, CHEAP, 2, "rs"))


@query("compare_methods", comparison_sql(METHODS, 2, "cm"))
def compare_methods(spark, sf):
    """One random workload, five releases, two trials each: one result table."""
    return saved(comparison(spark, sf, METHODS, 2, "cm"))


# every workload of a method comparison: (name, kind, number of attributes)
WORKLOADS = [("range-1", "range", 1), ("marginal-2", "marginal", 2), ("marginal-3", "marginal", 3), ("prefix-2", "prefix", 2), ("prefix-3", "prefix", 3)]
RANDOM = [("random-2", 2), ("random-3", 3)]


def workloads(spark, sf):
    """``(workload, query_id, attr, lo, hi)`` of all workloads over (q, d, r)."""
    frame, make = LI3.frame(spark), {"range": W.all_range_workload, "marginal": W.marginal_workload, "prefix": W.prefix_workload}
    out = None
    for name, kind, k in WORKLOADS:
        part = W.to_query_rows(make[kind](frame, k)).select(F.lit(name).alias("workload"), "query_id", "attr", "lo", "hi")
        out = part if out is None else out.unionAll(part)
    for name, k in RANDOM:
        drawn = customer_queries(spark, sf, k, name)
        out = out.unionAll(drawn.select(F.lit(name).alias("workload"), F.concat(F.lit(f"{name}:"), "query_id").alias("query_id"), "attr", "lo", "hi"))
    return out


def workloads_sql() -> str:
    """CTE ``wq(workload, query_id, lo_*, hi_*)``, one row per query of every workload."""
    arms, ctes = [], []
    pick = {"range": ("l.range", "h.range", "JOIN range({n}) h ON h.range >= l.range"), "marginal": ("l.range", "l.range", ""), "prefix": ("0", "l.range", "")}
    for name, kind, k in WORKLOADS:
        lo, hi, more = pick[kind]
        for s in combinations(LI3.attrs, k):
            sides = [f"(SELECT {lo} AS lo_{a}, {hi} AS hi_{a} FROM range({LI3[a]}) l {more.format(n=LI3[a])})" for a in s]
            cols = ", ".join(f"{f'lo_{a}' if a in s else 0} AS lo_{a}, {f'hi_{a}' if a in s else n - 1} AS hi_{a}" for a, n in LI3.sizes.items())
            arms.append(f"SELECT '{name}' AS workload, {cols} FROM {' CROSS JOIN '.join(sides)}")
    for name, k in RANDOM:
        tag = name.replace("-", "")
        ctes += [random_ranges_sql(CUSTOMERS, LI3, k, name, name=f"qs_{tag}"), wide_sql(LI3, f"qs_{tag}", f"wq_{tag}")]
        arms.append(f"SELECT '{name}' AS workload, {', '.join(LI3.ranges())} FROM wq_{tag}")
    return ", ".join(ctes) + f", wq AS (SELECT row_number() OVER () AS query_id, * FROM ({' UNION ALL '.join(arms)}))"


def all_workloads_sql(methods, trials: int, seed: str) -> str:
    arms = []
    for trial in range(trials):
        for method in methods:
            body, boxes = release_sql(method, seed, trial)
            arms.append(f"SELECT '{method}' AS method, {trial} AS trial, * FROM (WITH {body} {boxes})")
    parts = " * ".join(f"greatest(least(w.hi_{a}, b.hi_{a}) - greatest(w.lo_{a}, b.lo_{a}) + 1, 0)::DOUBLE" for a in LI3.attrs)
    return f"""WITH {cells_sql()}, {workloads_sql()}, {TRUTH_SQL},
    views AS MATERIALIZED ({' UNION ALL '.join(arms)}),
    est AS (SELECT workload, method, trial, query_id, sum({parts} * b.value) AS estimate FROM wq w CROSS JOIN views b GROUP BY ALL),
    gaps AS (SELECT workload, method, trial, estimate - truth AS gap FROM est JOIN truth USING (query_id)),
    per AS (SELECT workload, method, trial, avg(abs(gap)) AS mae, sqrt(avg(gap * gap)) AS rmse FROM gaps GROUP BY ALL),
    parts AS (SELECT method, trial, count(*) AS leaves FROM views GROUP BY method, trial)
    SELECT workload, method, {SUMMARY} FROM per JOIN parts USING (method, trial) GROUP BY workload, method"""


@query("compare_workloads", all_workloads_sql(CHEAP, 10, "cw"))
def compare_workloads(spark, sf):
    """Ten trials of two releases, built together, on every workload."""
    cells, views = materialize(lineitem_cells(spark, sf), "cells"), None
    for method in CHEAP:
        view = release(spark, sf, cells, method, "cw", tuple(range(10)))
        views = view if views is None else views.unionAll(view)
    return E.compare_on_workloads(views, workloads(spark, sf), cells, LI3)


def network_records_sql(seed: str) -> tuple[str, str]:
    """CTEs of a learned network's records, and the last one's name."""
    return release_sql("network", seed, 0)[0], f"s{len(LI3.attrs)}"


RECORDS_SQL, RECORDS = network_records_sql("sy")


@query(
    "range_count_synthetic",
    f"""WITH {RECORDS_SQL}, {Q10_SQL}, {wide_sql(LI3)}
    SELECT w.query_id, count(l.q) AS total FROM wq w LEFT JOIN {RECORDS} l ON {inside_sql(LI3, 'l', 'w')} GROUP BY w.query_id""",
)
def range_count_synthetic(spark, sf):
    """Range counts on the records that a private network generates."""
    records = network_records(spark, sf, lineitem_cells(spark, sf), "sy")
    return C.answer_ranges_on_records(records, fixed_queries(spark), LI3).select("query_id", "total")


def kway_distance_sql(k: int) -> str:
    cols = ", ".join(LI3.attrs)
    on = " AND ".join(f"a.{c} = b.{c}" for c in LI3.attrs)
    gid = " + ".join(f"CASE WHEN {c} < 0 THEN {1 << i} ELSE 0 END" for i, c in enumerate(LI3.attrs))
    return f"""{RECORDS_SQL}, syn_cells AS (SELECT {cols}, count(*) AS v FROM {RECORDS} GROUP BY {cols}),
    a AS ({kway_sql(LI3, k)}), b AS ({kway_sql(LI3, k, 'syn_cells')}), n AS (SELECT count(*) AS n FROM lineitem),
    j AS (SELECT {', '.join(f'coalesce(a.{c}, b.{c}) AS {c}' for c in LI3.attrs)}, abs(coalesce(a.answer, 0) / n::DOUBLE - coalesce(b.answer, 0) / n::DOUBLE) AS gap FROM a FULL OUTER JOIN b ON {on} CROSS JOIN n),
    s AS (SELECT {gid} AS gid, sum(gap) / 2 AS tvd FROM j GROUP BY 1) SELECT count(*) AS marginals, {settle('avg(tvd)')} AS tvd FROM s"""


@query("kway_tvd", f"WITH {kway_distance_sql(2)}")
def kway_tvd(spark, sf):
    """How far the marginals of a private network's records are from the truth."""
    cells = lineitem_cells(spark, sf)
    return E.kway_distance(cells, C.count_table(network_records(spark, sf, cells, "sy"), LI3), LI3, 2)
