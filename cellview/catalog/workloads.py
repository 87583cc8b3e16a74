"""Workloads as query tables and answers of whole workloads.

The domain of a workload is fitted on lineitem (largest code + 1 per attribute),
so the workloads follow the data.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cellview.catalog.base import (
    BOX_SQL, LI3, LI5, LI_SQL, cells_sql, lineitem_cells, lineitem_codes, query, random_ranges_sql, rounded, settle, size_sql, table, tiled_view, wide_sql,
)
from cellview.catalog.blocks import grid_cte
from cellview.domain import Domain
from cellview.operators import answer as A
from cellview.operators import cells as C
from cellview.operators import evaluate as E
from cellview.operators import workload as W


def fitted(spark, sf, attrs):
    """Domain table ``(attr, pos, size)`` of the coded columns, fitted on Spark."""
    aggs = [F.max(a).alias(a) for a in attrs]
    rows = ", ".join(f"'{a}', {i}, {a} + 1" for i, a in enumerate(attrs))
    return lineitem_codes(spark, sf).agg(*aggs).selectExpr(f"stack({len(attrs)}, {rows}) AS (attr, pos, size)")


def fitted_sql(attrs) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS attr, {i} AS pos, max({a}) + 1 AS size FROM li" for i, a in enumerate(attrs))
    return f"{LI_SQL}, dom AS ({rows})"


@query(
    "workload_attr_sets",
    f"WITH {fitted_sql(LI5.attrs)} SELECT a.attr || ',' || b.attr || ',' || c.attr AS aset, a.size AS n1, b.size AS n2, c.size AS n3 FROM dom a JOIN dom b ON b.pos > a.pos JOIN dom c ON c.pos > b.pos",
)
def workload_attr_sets(spark, sf):
    return W.attribute_sets(fitted(spark, sf, LI5.attrs), 3).selectExpr("aset", "sizes[0] AS n1", "sizes[1] AS n2", "sizes[2] AS n3")


PAIR = "FROM dom a JOIN dom b ON b.pos > a.pos"


@query(
    "workload_all_range",
    f"""WITH {fitted_sql(['d', 'r', 't'])} SELECT a.attr || ',' || b.attr AS aset, l1.x AS lo1, h1.x AS hi1, l2.x AS lo2, h2.x AS hi2 {PAIR}
    JOIN (SELECT CAST(range AS INTEGER) AS x FROM range(64)) l1 ON l1.x < a.size JOIN (SELECT CAST(range AS INTEGER) AS x FROM range(64)) h1 ON h1.x < a.size AND h1.x >= l1.x
    JOIN (SELECT CAST(range AS INTEGER) AS x FROM range(64)) l2 ON l2.x < b.size JOIN (SELECT CAST(range AS INTEGER) AS x FROM range(64)) h2 ON h2.x < b.size AND h2.x >= l2.x""",
)
def workload_all_range(spark, sf):
    out = W.all_range_workload(fitted(spark, sf, ["d", "r", "t"]), 2)
    return out.selectExpr("aset", "los[0] AS lo1", "his[0] AS hi1", "los[1] AS lo2", "his[1] AS hi2")


@query(
    "workload_marginals",
    f"""WITH {fitted_sql(LI5.attrs)}, pt AS (SELECT CAST(range AS INTEGER) AS x FROM range(64))
    SELECT a.attr || ',' || b.attr AS aset, p1.x AS x1, p2.x AS x2 {PAIR} JOIN pt p1 ON p1.x < a.size JOIN pt p2 ON p2.x < b.size
    UNION ALL SELECT attr, x, NULL FROM dom JOIN pt ON x < size""",
)
def workload_marginals(spark, sf):
    out = W.marginal_workload(fitted(spark, sf, LI5.attrs), 2, smaller=True)
    return out.selectExpr("aset", "los[0] AS x1", "get(his, 1) AS x2")


@query(
    "workload_prefix",
    f"""WITH {fitted_sql(LI5.attrs)}, pt AS (SELECT CAST(range AS INTEGER) AS x FROM range(64))
    SELECT a.attr || ',' || b.attr AS aset, 0 AS lo1, p1.x AS hi1, 0 AS lo2, p2.x AS hi2 {PAIR} JOIN pt p1 ON p1.x < a.size JOIN pt p2 ON p2.x < b.size""",
)
def workload_prefix(spark, sf):
    out = W.prefix_workload(fitted(spark, sf, LI5.attrs), 2)
    return out.selectExpr("aset", "los[0] AS lo1", "his[0] AS hi1", "los[1] AS lo2", "his[1] AS hi2")


def query_ids(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS query_id")


IDS = "SELECT o_orderkey AS query_id FROM orders"


@query("workload_random_range", f"WITH {random_ranges_sql(IDS, LI5, 3, '0')} SELECT query_id, attr, lo, hi FROM qs")
def workload_random_range(spark, sf):
    return W.random_ranges(query_ids(spark, sf), LI5, 3, "0")


@query("workload_random_marginal", f"WITH {random_ranges_sql(IDS, LI5, 2, '1', marginal=True)} SELECT query_id, attr, lo, hi FROM qs")
def workload_random_marginal(spark, sf):
    return W.random_ranges(query_ids(spark, sf), LI5, 2, "1", marginal=True)


# ------------------------------------------------------- answers of workloads


@query(
    "answer_prefix",
    f"""WITH {cells_sql()}, {grid_cte(LI3.keep(['q', 'd']))} SELECT g.q, g.d, coalesce(CAST(sum(v) AS BIGINT), 0) AS answer FROM grid g
    LEFT JOIN cells c ON c.q <= g.q AND c.d <= g.d GROUP BY g.q, g.d""",
)
def answer_prefix(spark, sf):
    return W.prefix_answers(lineitem_cells(spark, sf), LI3, ["q", "d"])


@query(
    "answer_prefix_3d",
    f"""WITH {cells_sql()}, {grid_cte(LI3)} SELECT g.q, g.d, g.r, coalesce(CAST(sum(v) AS BIGINT), 0) AS answer FROM grid g
    LEFT JOIN cells c ON c.q <= g.q AND c.d <= g.d AND c.r <= g.r GROUP BY g.q, g.d, g.r""",
)
def answer_prefix_3d(spark, sf):
    return W.prefix_answers(lineitem_cells(spark, sf), LI3, ["q", "d", "r"])


@query(
    "answer_all_range",
    f"""WITH {cells_sql()}, pt AS (SELECT CAST(range AS INTEGER) AS x FROM range(50))
    SELECT a.x AS lo, b.x AS hi, coalesce(CAST(sum(v) AS BIGINT), 0) AS answer FROM pt a JOIN pt b ON b.x >= a.x LEFT JOIN cells ON q BETWEEN a.x AND b.x GROUP BY a.x, b.x""",
)
def answer_all_range(spark, sf):
    return W.all_range_answers(lineitem_cells(spark, sf), LI3, "q")


@query(
    "answer_all_range_2d",
    f"""WITH {cells_sql()}, pt AS (SELECT CAST(range AS INTEGER) AS x FROM range(11)), m AS (SELECT d, r, sum(v) AS v FROM cells GROUP BY d, r)
    SELECT a.x AS lo_1, b.x AS hi_1, c.x AS lo_2, e.x AS hi_2, coalesce(CAST(sum(v) AS BIGINT), 0) AS answer FROM pt a JOIN pt b ON b.x >= a.x JOIN pt c ON c.x < 3 JOIN pt e ON e.x < 3 AND e.x >= c.x
    LEFT JOIN m ON d BETWEEN a.x AND b.x AND r BETWEEN c.x AND e.x GROUP BY ALL""",
)
def answer_all_range_2d(spark, sf):
    return W.all_range_answers_2d(lineitem_cells(spark, sf), LI3, "d", "r")


def ranges_sql(attrs) -> str:
    """Every range of each attribute, as ``lo_i, hi_i``."""
    return " CROSS JOIN ".join(
        f"(SELECT CAST(l.range AS INTEGER) AS lo_{i}, CAST(h.range AS INTEGER) AS hi_{i} FROM range({LI5[a]}) l JOIN range({LI5[a]}) h ON h.range >= l.range)"
        for i, a in enumerate(attrs, 1)
    )


@query(
    "answer_all_range_3d",
    f"""WITH {cells_sql(LI5)}, m AS (SELECT d, r, t, sum(v) AS v FROM cells GROUP BY d, r, t), g AS (SELECT * FROM {ranges_sql(['d', 'r', 't'])})
    SELECT lo_1, hi_1, lo_2, hi_2, lo_3, hi_3, coalesce(CAST(sum(v) AS BIGINT), 0) AS answer FROM g
    LEFT JOIN m ON d BETWEEN lo_1 AND hi_1 AND r BETWEEN lo_2 AND hi_2 AND t BETWEEN lo_3 AND hi_3 GROUP BY ALL""",
)
def answer_all_range_3d(spark, sf):
    return W.all_range_answers_k(lineitem_cells(spark, sf, LI5), LI5, ["d", "r", "t"])


@query(
    "answer_all_range_view",
    f"""WITH {cells_sql()}, {BOX_SQL}, pd AS (SELECT CAST(range AS INTEGER) AS d FROM range(11)),
    m AS (SELECT d, r.lo_r AS r, sum(value * ({size_sql(LI3)}) / (hi_d - lo_d + 1)) AS y FROM view r JOIN pd ON d BETWEEN lo_d AND hi_d GROUP BY ALL),
    g AS (SELECT * FROM {ranges_sql(['d', 'r'])})
    SELECT lo_1, hi_1, lo_2, hi_2, {settle('coalesce(sum(y), 0)', 3)} AS answer FROM g LEFT JOIN m ON d BETWEEN lo_1 AND hi_1 AND r BETWEEN lo_2 AND hi_2 GROUP BY ALL""",
)
def answer_all_range_view(spark, sf):
    """The whole range workload of two attributes on a released view."""
    released = A.view_marginal(tiled_view(spark, sf), LI3, ["d", "r"])
    return rounded(W.all_range_answers_k(released, LI3, ["d", "r"], "y"), "answer")


def marginals_sql(domain, k: int, source: str = "cells") -> str:
    arms = []
    for s in combinations(domain.attrs, k):
        cols = ", ".join(a if a in s else f"-1 AS {a}" for a in domain.attrs)
        arms.append(f"SELECT {cols}, CAST(sum(v) AS BIGINT) AS answer FROM {source} GROUP BY {', '.join(s)}")
    return " UNION ALL ".join(arms)


@query("answer_marginals", f"WITH {cells_sql(LI5)} {marginals_sql(LI5, 2)}")
def answer_marginals(spark, sf):
    return W.marginal_answers(lineitem_cells(spark, sf, LI5), LI5, 2)


# -------------------------------------------------------------- analytic error


@query(
    "analytic_rmse",
    f"""WITH {random_ranges_sql(IDS, LI5, 2, '0')}, {wide_sql(LI5)}
    SELECT 'random-2' AS workload, {settle("sqrt(2.0::DOUBLE / 0.25::DOUBLE * avg(" + ' * '.join(f'CAST(hi_{a} - lo_{a} + 1 AS DOUBLE)' for a in LI5.attrs) + "))")} AS rmse FROM wq""",
)
def analytic_rmse(spark, sf):
    wide = C.widen_queries(W.random_ranges(query_ids(spark, sf), LI5, 2, "0"), LI5).withColumn("workload", F.lit("random-2"))
    return E.analytic_rmse(wide, LI5, 0.5, ["workload"])


def prefix_size_sql() -> str:
    """Average cells per query of all 2-D prefixes over the declared domain."""
    arms = []
    for s in combinations(LI5.attrs, 2):
        rest = 1
        for a in LI5.attrs:
            if a not in s:
                rest *= LI5[a]
        arms.append(f"SELECT (a.range + 1) * (b.range + 1) * {rest}::DOUBLE AS c FROM range({LI5[s[0]]}) a, range({LI5[s[1]]}) b")
    return " UNION ALL ".join(arms)


@query("analytic_rmse_prefix", f"SELECT 'prefix-2' AS workload, {settle('sqrt(2.0::DOUBLE * avg(c))')} AS rmse FROM ({prefix_size_sql()})")
def analytic_rmse_prefix(spark, sf):
    rows = W.to_query_rows(W.prefix_workload(fitted(spark, sf, LI5.attrs), 2))
    wide = C.widen_queries(rows, LI5).withColumn("workload", F.lit("prefix-2"))
    return E.analytic_rmse(wide, LI5, 1.0, ["workload"])
