"""Count tables, blocks, range counts and private selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellview.catalog.base import (
    LI3, LI5, LI_SQL, Q10_SQL, U, cells_sql, fixed_queries, inside_sql, lineitem_cells, lineitem_codes, query,
    random_ranges_sql, settle, size_sql, table, uniform_int, utility, wide_sql,
)
from cellview.functions import noise
from cellview.operators import cells as C
from cellview.operators import mechanisms as M
from cellview.operators import workload as W


@query("count_table", f"WITH {cells_sql(LI5)} SELECT * FROM cells")
def count_table(spark, sf):
    return lineitem_cells(spark, sf, LI5)


@query("count_table_from_counts", f"WITH {cells_sql()} SELECT * FROM cells")
def count_table_from_counts(spark, sf):
    parts = lineitem_codes(spark, sf).groupBy("q", "d", "r", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    return C.count_table_from_counts(parts, LI3, "c")


@query("marginal", f"WITH {cells_sql(LI5)} SELECT d, t, CAST(sum(v) AS BIGINT) AS v FROM cells GROUP BY d, t")
def marginal(spark, sf):
    return C.marginal(lineitem_cells(spark, sf, LI5), ["d", "t"])


def grid_cte(domain, name="grid"):
    rest, cols = domain.cells(), []
    for a, n in domain.sizes.items():
        rest //= n
        cols.append(f"CAST((range // {rest}) % {n} AS INTEGER) AS {a}")
    return f"{name} AS (SELECT range AS idx, {', '.join(cols)} FROM range({domain.cells()}))"


@query(
    "dense_vector",
    f"WITH {cells_sql(LI5)}, {grid_cte(LI5)} SELECT idx, q, d, r, t, s, coalesce(v, 0) AS v FROM grid LEFT JOIN cells USING (q, d, r, t, s)",
)
def dense_vector(spark, sf):
    return C.dense_vector(lineitem_cells(spark, sf, LI5), LI5)


@query(
    "block_stats",
    f"WITH {cells_sql(LI5)} SELECT 29700::DOUBLE AS size, count(*) AS nonempty, 29700::DOUBLE - count(*) AS zeros, CAST(sum(v) AS BIGINT) AS total FROM cells",
)
def block_stats(spark, sf):
    return C.block_stats(lineitem_cells(spark, sf, LI5), LI5)


# ---------------------------------------------------------------- range counts


def answers_sql(source: str, domain) -> str:
    """Brute force over ``source`` cells for the wide queries ``wq``."""
    size = " * ".join(f"CAST(hi_{a} - lo_{a} + 1 AS DOUBLE)" for a in domain.attrs)
    return f"""SELECT w.query_id, coalesce(CAST(sum(c.v) AS BIGINT), 0) AS total, count(c.v) AS nonempty,
    any_value({size}) AS size, any_value({size}) - count(c.v) AS zeros
    FROM wq w LEFT JOIN {source} c ON {inside_sql(domain, 'c', 'w')} GROUP BY w.query_id"""


@query(
    "range_count_records",
    f"""WITH {LI_SQL}, {random_ranges_sql('SELECT s_suppkey AS query_id FROM supplier', LI3, 2, 'rr')}, {wide_sql(LI3)}
    SELECT w.query_id, count(l.q) AS total FROM wq w LEFT JOIN li l ON {inside_sql(LI3, 'l', 'w')} GROUP BY w.query_id""",
)
def range_count_records(spark, sf):
    ids = table(spark, sf, "supplier").selectExpr("s_suppkey AS query_id")
    queries = W.random_ranges(ids, LI3, 2, "rr")
    return C.answer_ranges_on_records(lineitem_codes(spark, sf), queries, LI3).select("query_id", "total")


@query("range_count_fixed", f"WITH {cells_sql()}, {Q10_SQL}, {wide_sql(LI3)} {answers_sql('cells', LI3)}")
def range_count_fixed(spark, sf):
    """Ten fixed queries: unconditional, reversed, beyond the domain, single cells."""
    return C.answer_ranges(lineitem_cells(spark, sf), fixed_queries(spark), LI3)


@query(
    "range_count_cells",
    f"""WITH {cells_sql(LI5)}, {random_ranges_sql('SELECT c_custkey AS query_id FROM customer', LI5, 3, 'rc')}, {wide_sql(LI5)}
    {answers_sql('cells', LI5)}""",
)
def range_count_cells(spark, sf):
    ids = table(spark, sf, "customer").selectExpr("c_custkey AS query_id")
    return C.answer_ranges(lineitem_cells(spark, sf, LI5), W.random_ranges(ids, LI5, 3, "rc"), LI5)


@query(
    "clip_range",
    """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) - 10 AS lo, CAST(l_quantity AS INTEGER) + l_linenumber - 8 AS hi,
      10 AS dom_lo, 29 AS dom_hi FROM lineitem),
    k AS (SELECT *, greatest(lo, dom_lo) AS a, least(hi, dom_hi) AS b FROM c)
    SELECT l_orderkey, l_linenumber, CASE WHEN a > b THEN 0 ELSE a END AS clip_lo, CASE WHEN a > b THEN -1 ELSE b END AS clip_hi,
    CAST(greatest(b - a + 1, 0) AS BIGINT) AS size FROM k""",
)
def clip_range(spark, sf):
    conditions = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "int(l_quantity) - 10 AS lo", "int(l_quantity) + l_linenumber - 8 AS hi",
        "10 AS dom_lo", "29 AS dom_hi",
    )
    return C.clip_ranges(conditions).select("l_orderkey", "l_linenumber", "clip_lo", "clip_hi", "size")


# --------------------------------------------------------------------- blocks

B4 = [
    ("a", 2, 0, 24, 0, 4, 0, 2), ("b", 2, 0, 24, 5, 10, 0, 2), ("c", 2, 25, 49, 0, 10, 0, 0), ("d", 2, 25, 49, 0, 10, 1, 2),
]
B4_SQL = "b4(block, depth, lo_q, hi_q, lo_d, hi_d, lo_r, hi_r) AS (VALUES " + ", ".join(str(b) for b in B4) + ")"


def four_blocks(spark):
    return spark.createDataFrame(B4, "block string, depth int, lo_q int, hi_q int, lo_d int, hi_d int, lo_r int, hi_r int")


@query(
    "block_cells",
    f"WITH {cells_sql()}, {B4_SQL} SELECT block, q, d, r, v FROM cells JOIN b4 ON {inside_sql(LI3, 'cells', 'b4')}",
)
def block_cells(spark, sf):
    return C.label_cells(lineitem_cells(spark, sf), four_blocks(spark), LI3, rows=len(B4))


# the textbook definition: every cell counts, empty ones at |0 - mean|
DEVIATION_SQL = f"""lab AS (SELECT block, v FROM cells JOIN b4 ON {inside_sql(LI3, 'cells', 'b4')}),
sized AS (SELECT block, {size_sql(LI3)} AS size FROM b4),
means AS (SELECT s.block, size, count(v) AS nonempty, coalesce(CAST(sum(v) AS BIGINT), 0) AS total, coalesce(sum(v), 0) / size AS mean
  FROM sized s LEFT JOIN lab USING (block) GROUP BY s.block, size),
devs AS (SELECT block, size, nonempty, total, round(mean, 6) AS mean,
  round((SELECT coalesce(sum(abs(lab.v - means.mean)), 0) FROM lab WHERE lab.block = means.block) + mean * (size - nonempty), 6) AS ae FROM means)"""


@query("block_deviation", f"WITH {cells_sql()}, {B4_SQL}, {DEVIATION_SQL} SELECT block, ae FROM devs")
def block_deviation(spark, sf):
    labelled = C.label_cells(lineitem_cells(spark, sf), four_blocks(spark), LI3, rows=len(B4))
    out = C.block_deviation(C.value_histogram(labelled), four_blocks(spark), LI3)
    return out.select("block", noise.settle(F.col("ae")).alias("ae"))


@query("block_mean_ae", f"WITH {cells_sql()}, {B4_SQL}, {DEVIATION_SQL} SELECT block, size, nonempty, total, mean, ae FROM devs")
def block_mean_ae(spark, sf):
    labelled = C.label_cells(lineitem_cells(spark, sf), four_blocks(spark), LI3, rows=len(B4))
    out = C.block_deviation(C.value_histogram(labelled), four_blocks(spark), LI3)
    return out.select("block", "size", "nonempty", "total", noise.settle(F.col("mean")).alias("mean"), noise.settle(F.col("ae")).alias("ae"))


def brute_cuts_sql(domain, frontier: str, cells: str, tag: str = "") -> str:
    """CTE ``scored<tag>``: both sides of every cut of every block, by definition."""
    arms = []
    for i, a in enumerate(domain.attrs):
        arms.append(
            f"SELECT block, depth, {i} AS pos, '{a}' AS attr, lo_{a} AS lo, hi_{a} AS hi, CAST(unnest(range(lo_{a}, hi_{a})) AS INTEGER) AS cut,"
            f" {size_sql(domain)} AS size FROM {frontier}"
        )
    code = "CASE pos " + " ".join(f"WHEN {i} THEN c.{a}" for i, a in enumerate(domain.attrs)) + " END"
    return f"""cuts{tag} AS ({' UNION ALL '.join(arms)}),
both{tag} AS (SELECT k.*, c.v, CASE WHEN {code} <= cut THEN 'l' ELSE 'r' END AS side FROM cuts{tag} k LEFT JOIN {cells} c USING (block)),
sums{tag} AS (SELECT block, pos, cut, any_value(depth) AS depth, any_value(attr) AS attr, any_value(size) AS size,
  any_value(size / (hi - lo + 1) * (cut - lo + 1)) AS size_l, any_value(size / (hi - lo + 1) * (hi - cut)) AS size_r,
  coalesce(CAST(sum(v) FILTER (side = 'l') AS BIGINT), 0) AS total_l, coalesce(CAST(sum(v) FILTER (side = 'r') AS BIGINT), 0) AS total_r,
  count(v) FILTER (side = 'l') AS n_l, count(v) FILTER (side = 'r') AS n_r FROM both{tag} GROUP BY block, pos, cut),
dev{tag} AS (SELECT b.block, b.pos, b.cut,
  coalesce(sum(abs(v - total_l / size_l)) FILTER (side = 'l'), 0) AS d_l, coalesce(sum(abs(v - total_r / size_r)) FILTER (side = 'r'), 0) AS d_r
  FROM both{tag} b JOIN sums{tag} USING (block, pos, cut) GROUP BY b.block, b.pos, b.cut),
scored{tag} AS MATERIALIZED (SELECT s.*, d_l + (size_l - n_l) * (total_l / size_l) AS ae_l, d_r + (size_r - n_r) * (total_r / size_r) AS ae_r,
  {settle('-(d_l + (size_l - n_l) * (total_l / size_l) + d_r + (size_r - n_r) * (total_r / size_r))')} AS score
  FROM sums{tag} s JOIN dev{tag} USING (block, pos, cut))"""


LABELLED_SQL = f"lc AS (SELECT block, q, d, r, v FROM cells JOIN b4 ON {inside_sql(LI3, 'cells', 'b4')})"


def labelled_blocks(spark, sf):
    """The four blocks with their totals, and their cells."""
    labelled = C.label_cells(lineitem_cells(spark, sf), four_blocks(spark), LI3, rows=len(B4))
    totals = labelled.groupBy("block").agg(F.sum("v").alias("total"))
    frontier = four_blocks(spark).join(totals, "block", "left").withColumn("total", F.expr("coalesce(total, 0L)"))
    return labelled, frontier


@query(
    "cut_scores",
    f"""WITH {cells_sql()}, {B4_SQL}, {LABELLED_SQL}, {brute_cuts_sql(LI3, 'b4', 'lc', '_b4')}
    SELECT block, attr, cut, total_l, total_r, score FROM scored_b4""",
)
def cut_scores(spark, sf):
    from cellview.plans.bisection import score_cuts

    labelled, frontier = labelled_blocks(spark, sf)
    stats = C.cut_statistics(C.code_histogram(labelled, frontier, LI3), C.candidate_cuts(frontier, LI3), rows=len(B4) * 64)
    return score_cuts(stats).select("block", "attr", "cut", "total_l", "total_r", "score")


def halves_sql() -> str:
    """Each of the four blocks cut at the middle of its attribute ``depth % 3``."""
    return f"""cutat AS (SELECT *, CASE block WHEN 'a' THEN 'q' WHEN 'b' THEN 'd' WHEN 'c' THEN 'q' ELSE 'r' END AS attr FROM b4),
    sliced AS (SELECT *, CASE attr WHEN 'q' THEN (lo_q + hi_q) // 2 WHEN 'd' THEN (lo_d + hi_d) // 2 ELSE (lo_r + hi_r) // 2 END AS cut FROM cutat),
    kids AS (SELECT block || 'L' AS block, depth + 1 AS depth, lo_q, CASE attr WHEN 'q' THEN cut ELSE hi_q END AS hi_q, lo_d,
      CASE attr WHEN 'd' THEN cut ELSE hi_d END AS hi_d, lo_r, CASE attr WHEN 'r' THEN cut ELSE hi_r END AS hi_r FROM sliced
    UNION ALL SELECT block || 'R', depth + 1, CASE attr WHEN 'q' THEN cut + 1 ELSE lo_q END, hi_q, CASE attr WHEN 'd' THEN cut + 1 ELSE lo_d END, hi_d,
      CASE attr WHEN 'r' THEN cut + 1 ELSE lo_r END, hi_r FROM sliced)"""


@query(
    "split_blocks",
    f"""WITH {cells_sql()}, {B4_SQL}, {halves_sql()} SELECT k.*, count(v) AS nonempty, coalesce(CAST(sum(v) AS BIGINT), 0) AS total
    FROM kids k LEFT JOIN cells ON {inside_sql(LI3, 'cells', 'k')} GROUP BY ALL""",
)
def split_blocks(spark, sf):
    labelled, frontier = labelled_blocks(spark, sf)
    picks = frontier.selectExpr(
        "*", "CASE block WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 0 ELSE 2 END AS pos"
    ).selectExpr(
        "*", "int(CASE pos WHEN 0 THEN (lo_q + hi_q) div 2 WHEN 1 THEN (lo_d + hi_d) div 2 ELSE (lo_r + hi_r) div 2 END) AS cut",
        "true AS open_l", "true AS open_r",
    )
    children = C.split_blocks(picks, LI3)
    moved = C.relabel_cells(labelled, picks, LI3, rows=len(B4))
    sums = moved.groupBy("block").agg(F.count(F.lit(1)).alias("nonempty"), F.sum("v").alias("total"))
    return children.join(sums, "block", "left").select(
        *children.columns, F.expr("coalesce(nonempty, 0L) AS nonempty"), F.expr("coalesce(total, 0L) AS total")
    )


# --------------------------------------------------------- selection, sampling


@query(
    "exp_mechanism",
    f"""WITH z AS (SELECT p_brand, p_partkey, p_retailprice,
      {utility('p_retailprice', 1.0, '50::DOUBLE', "'m'", 'p_brand', 'p_partkey')} AS z FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY z DESC, p_partkey) AS rn FROM z)
    SELECT p_brand, p_partkey, p_retailprice, z FROM r WHERE rn = 1""",
)
def exp_mechanism(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return M.exponential_mechanism(parts, ["p_brand"], ["p_partkey"], "p_retailprice", 1.0, 50.0, ("m",), order=["p_partkey"])


# one block per order: ranges as wide as the order's own line items
ORDER_BLOCKS = """SELECT CAST(l_orderkey AS VARCHAR) AS block, 0 AS depth, min(q) AS lo_q, max(q) AS hi_q, min(d) AS lo_d, max(d) AS hi_d,
min(r) AS lo_r, max(r) AS hi_r FROM li GROUP BY l_orderkey"""


@query(
    "random_cut",
    f"""WITH {LI_SQL}, b AS ({ORDER_BLOCKS}),
    s AS (SELECT *, list_filter([{{'attr': 'q', 'lo': lo_q, 'hi': hi_q}}, {{'attr': 'd', 'lo': lo_d, 'hi': hi_d}}, {{'attr': 'r', 'lo': lo_r, 'hi': hi_r}}],
      lambda x: x.lo < x.hi) AS spans FROM b),
    c AS (SELECT block, spans[1 + {uniform_int('0', 'len(spans)', "'k'", 'block', "'attr'")}] AS e FROM s WHERE len(spans) > 0)
    SELECT block, e.attr AS attr, {uniform_int('e.lo', 'e.hi', "'k'", 'block', "'cut'")} AS cut FROM c""",
)
def random_cut(spark, sf):
    bounds = [f(a).alias(f"{n}_{a}") for a in LI3.attrs for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = lineitem_codes(spark, sf).groupBy(F.expr("string(l_orderkey) AS block")).agg(F.lit(0).alias("depth"), *bounds)
    return M.random_cut(blocks, LI3, ("k",)).select("block", "attr", "cut")


@query(
    "weighted_sample",
    f"""WITH w AS (SELECT c_custkey, greatest(c_acctbal, 0) AS w FROM customer),
    ends AS (SELECT c_custkey, w, sum(w) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS hi FROM w),
    cum AS (SELECT *, lag(hi, 1, 0) OVER (ORDER BY c_custkey) AS lo FROM ends), t AS (SELECT max(hi) AS total FROM cum),
    d AS (SELECT o_orderkey, {U("'ws'", 'o_orderkey')} AS u FROM orders)
    SELECT o_orderkey, c_custkey FROM d CROSS JOIN t JOIN cum ON u >= lo / total AND u < hi / total AND w > 0""",
)
def weighted_sample(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    draws = table(spark, sf, "orders").select("o_orderkey")
    return M.weighted_sample(customers, ["c_custkey"], "c_acctbal", draws, noise.unit("ws", F.col("o_orderkey"))).select(
        "o_orderkey", "c_custkey"
    )
