"""Sparse count tables: one row per non-empty cell, zeros implicit.

A cell table has one integer column per attribute and the count ``v``.  Cells
may carry a ``block`` column; a block table (frontier) has ``block``, ``depth``
and inclusive ranges ``lo_<attr>``, ``hi_<attr>``.

The sum of absolute deviations of a block from its mean ``m`` equals
``2 * sum(v - m)`` over the cells with ``v > m``: positive and negative parts
cancel, and an empty cell is never above a mean of counts.  Deviations are
therefore computed from non-empty cells only, and from a histogram of their
values, so no task ever receives all cells of one block.  Only whole numbers
are summed (counts, and cells above the mean), which makes the results
independent of partitioning to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellview.domain import Domain, flat_index, grid
from cellview.operators import ranges as R
from cellview.operators.lattice import roll_up
from cellview.operators.layout import attach
from cellview.operators.ranges import label_cells  # noqa: F401  part of this module's interface

# ---------------------------------------------------------------- count tables


def count_table(records: DataFrame, domain: Domain) -> DataFrame:
    return records.groupBy(*domain.attrs).agg(F.count(F.lit(1)).alias("v"))


def count_table_from_counts(counts: DataFrame, domain: Domain, count_col: str = "v") -> DataFrame:
    return counts.groupBy(*domain.attrs).agg(F.sum(count_col).cast("bigint").alias("v"))


def marginal(cells: DataFrame, attrs: list[str]) -> DataFrame:
    return cells.groupBy(*attrs).agg(F.sum("v").cast("bigint").alias("v"))


def dense_vector(cells: DataFrame, domain: Domain) -> DataFrame:
    """Count of every cell of a bounded domain, zeros included."""
    indexed = cells.select(flat_index(domain).alias("idx"), "v")
    return (
        grid(cells.sparkSession, domain)
        .join(indexed, "idx", "left")
        .withColumn("v", F.coalesce("v", F.lit(0)).cast("bigint"))
    )


def block_stats(cells: DataFrame, domain: Domain) -> DataFrame:
    n = float(domain.cells())
    return cells.agg(
        F.lit(n).alias("size"),
        F.count(F.lit(1)).alias("nonempty"),
        (F.lit(n) - F.count(F.lit(1))).alias("zeros"),
        F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("total"),
    )


# --------------------------------------------------------------- range queries


def widen_queries(queries: DataFrame, domain: Domain) -> DataFrame:
    """Long ``(query_id, attr, lo, hi)`` rows to one row per query.

    Several conditions on one attribute intersect, absent attributes get the full
    range.  Ranges are clipped to the domain; a disjoint condition becomes the
    empty range (0, -1).  A row with a null ``attr`` is an unconditional query.
    """
    aggs = []
    for a, n in domain.sizes.items():
        here = F.col("attr") == F.lit(a)
        aggs.append(F.max(F.when(here, F.greatest("lo", F.lit(0)))).alias(f"_lo_{a}"))
        aggs.append(F.min(F.when(here, F.least("hi", F.lit(n - 1)))).alias(f"_hi_{a}"))
    wide = queries.groupBy("query_id").agg(*aggs)
    cols = [F.col("query_id")]
    for a, n in domain.sizes.items():
        lo, hi = F.coalesce(f"_lo_{a}", F.lit(0)), F.coalesce(f"_hi_{a}", F.lit(n - 1))
        empty = lo > hi
        cols.append(F.when(empty, F.lit(0)).otherwise(lo).cast("int").alias(f"lo_{a}"))
        cols.append(F.when(empty, F.lit(-1)).otherwise(hi).cast("int").alias(f"hi_{a}"))
    return wide.select(*cols)


def answer_ranges(cells: DataFrame, queries: DataFrame, domain: Domain) -> DataFrame:
    """Exact answer of every conjunctive range count, and its cell numbers.

    Cells are summed to one marginal per attribute set of the workload, and every
    query reads the corners of its box off prefix sums (``operators.ranges``); no
    query meets a cell.  Empty answers stay as zeros.
    Returns ``query_id, total, nonempty, size, zeros``; ``nonempty`` counts
    non-empty cells of the full table.
    """
    asked = R.canonical(queries, domain)
    sets = R.RangeSets.of(asked, domain)
    base = cells.select(F.array(*[F.col(a).cast("int") for a in domain.attrs]).alias("codes"), "v", F.lit(1).cast("bigint").alias("n"))
    points = roll_up(base, sets.sets, list(domain.sizes.values()), ["v", "n"])
    return R.corner_sums(points, asked, sets, ["v", "n"]).selectExpr("query_id", "v AS total", "n AS nonempty", "size", "size - n AS zeros")


def answer_ranges_on_records(records: DataFrame, queries: DataFrame, domain: Domain) -> DataFrame:
    """Range counts straight from records: count cells first, then as above."""
    return answer_ranges(count_table(records, domain), queries, domain)


def clip_ranges(conditions: DataFrame) -> DataFrame:
    """Intersect ``[lo, hi]`` with ``[dom_lo, dom_hi]``; disjoint gives (0, -1)."""
    lo, hi = F.greatest("lo", "dom_lo"), F.least("hi", "dom_hi")
    return conditions.withColumn("clip_lo", F.when(lo > hi, F.lit(0)).otherwise(lo).cast("int")).withColumn(
        "clip_hi", F.when(lo > hi, F.lit(-1)).otherwise(hi).cast("int")
    ).withColumn("size", (F.col("clip_hi") - F.col("clip_lo") + F.lit(1)).cast("bigint"))


# --------------------------------------------------------------------- blocks


def value_histogram(labelled: DataFrame) -> DataFrame:
    """Per block: how many cells hold each count."""
    return labelled.groupBy("block", "v").agg(F.count(F.lit(1)).alias("n"))


def block_deviation(histogram: DataFrame, blocks: DataFrame, domain: Domain) -> DataFrame:
    """``block, size, nonempty, total, mean, ae`` of every block, empty ones too.

    The window holds the distinct counts of one block: at most the square root
    of twice the number of records, never the cells themselves.
    """
    sized = blocks.select("block", domain.size_column().alias("size"))
    totals = Window.partitionBy("block")
    return (
        sized.join(histogram, "block", "left")
        .select("block", "size", "v", "n", F.coalesce(F.sum(F.expr("v * n")).over(totals), F.lit(0)).alias("total"))
        .groupBy("block", "size", "total")
        .agg(
            F.expr("coalesce(sum(n), 0L) AS nonempty"),
            F.expr("coalesce(sum(if(v > total / size, v * n, 0)), 0L) AS _sum"),
            F.expr("coalesce(sum(if(v > total / size, n, 0)), 0L) AS _num"),
        )
        .selectExpr(
            "block", "size", "nonempty", "total", "total / size AS mean", "2.0D * (_sum - _num * (total / size)) AS ae"
        )
    )


def root_block(cells: DataFrame, domain: Domain) -> DataFrame:
    """One-row frontier: the whole domain with its exact total."""
    cols = [F.lit("0").alias("block"), F.lit(0).alias("depth")]
    for a, n in domain.sizes.items():
        cols += [F.lit(0).alias(f"lo_{a}"), F.lit(n - 1).alias(f"hi_{a}")]
    total = cells.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("total"))
    return total.select(*cols, "total")


def candidate_cuts(frontier: DataFrame, domain: Domain, size: Column | None = None) -> DataFrame:
    """Every ``(block, pos, cut)``: left keeps codes up to ``cut``."""
    spans = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(a).alias("attr"),
            F.col(f"lo_{a}").alias("lo"),
            F.col(f"hi_{a}").alias("hi"),
        )
        for i, a in enumerate(domain.attrs)
    ]
    return (
        frontier.select(
            "block", "depth", "total", (domain.size_column() if size is None else size).alias("size"), F.inline(F.array(*spans))
        )
        .filter("lo < hi")
        .withColumn("cut", F.expr("explode(sequence(lo, hi - 1))"))
    )


def code_histogram(cells: DataFrame, frontier: DataFrame, domain: Domain) -> DataFrame:
    """``(block, pos, code, v, n)``: cells of a block with a code and a count.

    Each open block adds a row of weight zero per attribute, so that blocks
    without any cell still reach the scores.
    """
    spread = [F.struct(F.lit(i).alias("pos"), F.col(a).alias("code")) for i, a in enumerate(domain.attrs)]
    starts = [F.struct(F.lit(i).alias("pos"), F.col(f"lo_{a}").alias("code")) for i, a in enumerate(domain.attrs)]
    full = cells.select("block", "v", F.lit(1).cast("bigint").alias("n"), F.inline(F.array(*spread)))
    void = frontier.select(
        "block", F.lit(0).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("n"), F.inline(F.array(*starts))
    )
    return full.unionAll(void).groupBy("block", "pos", "code", "v").agg(F.sum("n").alias("n"))


SIDES = [
    "total_l",
    "total - total_l AS total_r",
    "size / (hi - lo + 1) * (cut - lo + 1) AS size_l",
    "size / (hi - lo + 1) * (hi - cut) AS size_r",
]
DEVIATIONS = [
    "2.0D * (sum_l - num_l * (total_l / size_l)) AS ae_l",
    "2.0D * (sum_r - num_r * (total_r / size_r)) AS ae_r",
]
CUT = ["block", "depth", "total", "size", "pos", "attr", "lo", "hi", "cut"]


DIRECT_CODES = 256


def _sums_above_mean(histogram: DataFrame, sided: DataFrame, codes: int) -> DataFrame:
    """Cells above the mean, and their counts, on both sides of every cut.

    Codes are summed into dyadic nodes (level, code >> level).  Either side of a cut
    is one node per set bit of its length, and asks each of them for the counts
    above its mean: questions and counts are sorted together and read off running
    sums.  The work is (histogram rows + cuts) times log2(codes).
    """
    bits = codes.bit_length()
    node = ["block", "pos", "lvl", "node"]
    counted = (
        histogram.selectExpr("block", "pos", "code", "v", "n", f"explode(sequence(0, {bits - 1})) AS lvl")
        .groupBy("block", "pos", "lvl", F.expr("shiftright(code, lvl) AS node"), "v").agg(F.sum("n").alias("n"))
        .selectExpr(*node, "double(v) AS at", "1 AS kind", "v * n AS s", "n", "int(null) AS cut", "false AS left")
    )
    asked = (
        sided.selectExpr(
            "block", "pos", "cut",
            f"inline(array(struct(true AS left, total_l / size_l AS at, cut + 1 AS x), struct(false AS left, total_r / size_r AS at, {1 << bits} - cut - 1 AS x)))",
        )
        .selectExpr("*", f"explode(filter(sequence(0, {bits - 1}), b -> (shiftright(x, b) & 1) = 1)) AS lvl")
        .selectExpr(
            "block", "pos", "lvl", f"if(left, shiftright(x, lvl) - 1, shiftright({1 << bits}, lvl) - shiftright(x, lvl)) AS node",
            "at", "0 AS kind", "0L AS s", "0L AS n", "cut", "left",
        )
    )
    above = Window.partitionBy(*node).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counted.unionAll(asked)
        .select("block", "pos", "cut", "left", "kind", F.sum("s").over(above).alias("s"), F.sum("n").over(above).alias("n"))
        .filter("kind = 0")
        .groupBy("block", "pos", "cut")
        .agg(
            F.expr("sum(if(left, s, 0L)) AS sum_l"), F.expr("sum(if(left, n, 0L)) AS num_l"),
            F.expr("sum(if(left, 0L, s)) AS sum_r"), F.expr("sum(if(left, 0L, n)) AS num_r"),
        )
    )


def cut_statistics(histogram: DataFrame, cuts: DataFrame, rows: int, all_cuts: bool = True, codes: int = 0) -> DataFrame:
    """Sizes, totals and deviations of both sides of every candidate cut.

    ``codes`` is the number of codes of the widest attribute.  Up to
    ``DIRECT_CODES`` every cut meets the histogram rows of its block and attribute;
    with more codes, sums over dyadic nodes keep the work linear up to a
    logarithm.  Both give the same whole numbers.
    ``rows`` bounds the number of candidates.  With ``all_cuts`` the side
    totals are a running sum over the codes of an attribute; otherwise (one cut
    per block) they come from the histogram.  The histogram is read twice:
    persist it.
    """
    if all_cuts:
        # candidates and sums meet in one aggregation instead of a join
        carried = [c for c in CUT if c not in ("block", "pos", "cut")]
        nothing = [F.lit(None).cast(cuts.schema[c].dataType).alias(c) for c in carried]
        sums = histogram.select("block", "pos", F.col("code").alias("cut"), *nothing, F.expr("v * n AS s"))
        asked = cuts.select("block", "pos", "cut", *carried, F.expr("0L AS s"))
        sided = (
            asked.unionAll(sums)
            .groupBy("block", "pos", "cut")
            .agg(F.sum("s").alias("s"), *[F.max(c).alias(c) for c in carried])
            .select(*CUT, F.expr("sum(s) over (partition by block, pos order by cut) AS total_l"))
            .filter("size is not null")
        )
    else:
        sided = (
            attach(histogram, cuts, ["block", "pos"], rows)
            .groupBy(*CUT)
            .agg(F.expr("sum(if(code <= cut, v * n, 0)) AS total_l"))
        )
    sided = sided.selectExpr(*CUT, *SIDES)
    if all_cuts and codes > DIRECT_CODES:
        sums = sided.join(_sums_above_mean(histogram, sided, codes), ["block", "pos", "cut"])
        return sums.selectExpr(*sided.columns, *DEVIATIONS)
    # whole numbers are summed, so the result does not depend on row order
    above = "v > if(code <= cut, total_l / size_l, total_r / size_r)"
    return (
        attach(histogram, sided, ["block", "pos"], rows)
        .groupBy(*sided.columns)
        .agg(
            F.expr(f"sum(if(code <= cut and {above}, v * n, 0)) AS sum_l"),
            F.expr(f"sum(if(code <= cut and {above}, n, 0)) AS num_l"),
            F.expr(f"sum(if(code > cut and {above}, v * n, 0)) AS sum_r"),
            F.expr(f"sum(if(code > cut and {above}, n, 0)) AS num_r"),
        )
        .selectExpr(*sided.columns, *DEVIATIONS)
    )


def split_blocks(picks: DataFrame, domain: Domain, carry: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Two children per picked cut; ``carry`` lists ``(name, left, right)`` columns.

    Children are named by their path from the root, one letter per level, which
    stays unique at any depth.
    """
    sides = []
    for letter, other in (("L", 1), ("R", 2)):
        fields = [
            F.concat("block", F.lit(letter)).alias("block"),
            (F.col("depth") + 1).cast("int").alias("depth"),
        ]
        for i, a in enumerate(domain.attrs):
            cut_here = F.col("pos") == F.lit(i)
            lo, hi = F.col(f"lo_{a}"), F.col(f"hi_{a}")
            if letter == "L":
                hi = F.when(cut_here, F.col("cut")).otherwise(hi)
            else:
                lo = F.when(cut_here, F.col("cut") + 1).otherwise(lo)
            fields += [lo.cast("int").alias(f"lo_{a}"), hi.cast("int").alias(f"hi_{a}")]
        for entry in carry:
            fields.append(F.col(entry[other]).alias(entry[0]))
        sides.append(F.struct(*fields))
    return picks.select(F.inline(F.array(*sides)))


def relabel_cells(cells: DataFrame, picks: DataFrame, domain: Domain, rows: int) -> DataFrame:
    """Move cells to the children of their block; cells of closed children leave."""
    code = F.element_at(F.array(*[F.col(a) for a in domain.attrs]), F.col("pos") + 1)
    moved = attach(cells, picks.select("block", "pos", "cut", "open_l", "open_r"), ["block"], rows)
    left = code <= F.col("cut")
    return moved.filter(F.when(left, F.col("open_l")).otherwise(F.col("open_r"))).select(
        F.concat("block", F.when(left, F.lit("L")).otherwise(F.lit("R"))).alias("block"), *domain.attrs, "v"
    )
