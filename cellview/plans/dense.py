"""Releases that list every cell of a bounded domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellview.domain import Domain, flat_index, require_dense
from cellview.functions import noise
from cellview.operators import cells as C
from cellview.session import materialize


def laplace_histograms(cells: DataFrame, domain: Domain, epsilon: float, seed: str, trials: tuple[int, ...] = (0,)) -> DataFrame:
    """Every cell of the domain plus independent Laplace noise, once per ``trial``; counted once."""
    draw = noise.laplace(1.0 / epsilon, seed, "histogram", F.col("trial"), F.col("idx"))
    listed = C.dense_vector(cells, domain).withColumn("trial", F.explode(F.array(*map(F.lit, trials))))
    return listed.withColumn("y", noise.settle(F.col("v") + draw))


def laplace_histogram(cells: DataFrame, domain: Domain, epsilon: float, seed: str, trial: int = 0) -> DataFrame:
    """The histogram of one trial."""
    return laplace_histograms(cells, domain, epsilon, seed, (trial,)).drop("trial")


def laplace_marginals(
    cells: DataFrame, domain: Domain, projections: list[list[str]], epsilon: float, seed: str, trial: int = 0
) -> DataFrame:
    """Several projections, each with its share of the budget.

    Rows are ``(proj, idx, y)`` with the row-major index inside the projection.
    All projections are counted in one grouping-sets pass.
    """
    spark = cells.sparkSession
    scale = len(projections) / epsilon
    attrs = domain.attrs
    counted = cells.groupingSets(
        [[F.col(a) for a in p] for p in projections], *[F.col(a) for a in attrs]
    ).agg(F.sum("v").cast("bigint").alias("v"), F.grouping_id().alias("gid"))
    grids, name, index = None, F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for p in projections:
        part, label = domain.keep(p), ",".join(p)
        require_dense(part)
        here = F.col("gid") == sum(1 << (len(attrs) - 1 - i) for i, a in enumerate(attrs) if a not in p)
        name = F.when(here, F.lit(label)).otherwise(name)
        index = F.when(here, flat_index(part)).otherwise(index)
        cells_of = spark.range(part.cells()).select(F.lit(label).alias("proj"), F.col("id").alias("idx"))
        grids = cells_of if grids is None else grids.unionAll(cells_of)
    sums = counted.select(name.alias("proj"), index.alias("idx"), "v")
    out = grids.join(sums, ["proj", "idx"], "left").select("proj", "idx", F.expr("coalesce(v, 0L) AS v"))
    draw = noise.laplace(scale, seed, "marginal", trial, F.col("proj"), F.col("idx"))
    return out.withColumn("y", noise.settle(F.col("v") + draw))


def heap_levels(domain: Domain) -> int:
    """Levels of the binary tree over the row-major vector, padded to 2**levels."""
    return (domain.cells() - 1).bit_length()


def interval_costs(cells: DataFrame, domain: Domain, epsilon: float, ratio: float, seed: str, trial: int = 0) -> DataFrame:
    """Noisy cost of every aligned dyadic interval of the row-major vector.

    Intervals are heap numbers: 1 is the whole vector, ``h`` has the halves
    ``2h`` and ``2h+1``, and ``2**levels + idx`` is a single cell.  The cost is
    the L1 deviation plus noise, plus the price of one more noisy bucket; a
    single cell has deviation zero and needs no noise.
    """
    require_dense(domain)
    spark, levels = cells.sparkSession, heap_levels(domain)
    width = 1 << levels
    scale = 2.0 * max(1, levels) / (ratio * epsilon)
    price = 1.0 / ((1.0 - ratio) * epsilon)
    spread = cells.select((flat_index(domain) + F.lit(width)).alias("leaf"), "v").selectExpr(
        "v", f"explode(sequence(1, {levels})) AS up", "leaf"
    ) if levels else cells.select(F.lit(1).alias("leaf"), "v").selectExpr("v", "0 AS up", "leaf").limit(0)
    histogram = spread.groupBy(F.expr("shiftright(leaf, up) AS h"), "up", "v").agg(F.count(F.lit(1)).alias("n"))
    deviation = (
        histogram.select("h", "up", "v", "n", F.sum(F.expr("v * n")).over(Window.partitionBy("h")).alias("total"))
        .selectExpr("h", "v", "n", "total / pow(2.0D, up) AS m")
        .groupBy("h", "m")
        .agg(F.expr("sum(if(v > m, v * n, 0)) AS _sum"), F.expr("sum(if(v > m, n, 0)) AS _num"))
        .selectExpr("h", "2.0D * (_sum - _num * m) AS dev")
    )
    nodes = spark.range(1, 2 * width).withColumnRenamed("id", "h")
    inner = F.col("h") < F.lit(width)
    draw = F.when(inner, noise.laplace(scale, seed, "interval", trial, F.col("h"))).otherwise(F.lit(0.0))
    return nodes.join(deviation, "h", "left").select(
        "h", noise.settle(F.coalesce("dev", F.lit(0.0)) + draw + F.lit(price)).alias("cost")
    )


def l1_buckets(cells: DataFrame, domain: Domain, epsilon: float, ratio: float = 0.5, seed: str = "seed", trial: int = 0) -> DataFrame:
    """Cheapest partition of the vector into aligned intervals.

    Bottom-up, an interval stays whole if it costs no more than the best of its
    halves.  The chosen buckets are the kept intervals without a kept ancestor.
    Returns ``h, first, last`` (inclusive row-major indices, clipped).
    """
    levels, n = heap_levels(domain), domain.cells()
    costs = materialize(interval_costs(cells, domain, epsilon, ratio, seed, trial), "costs")
    best = costs.filter(F.col("h") >= (1 << levels)).selectExpr("h", "cost AS best", "true AS keep")
    kept = best
    for up in range(1, levels + 1):
        first, end = 1 << (levels - up), 1 << (levels - up + 1)
        own = costs.filter((F.col("h") >= first) & (F.col("h") < end)).selectExpr("h", "cost", "0.0D AS below")
        halves = best.selectExpr("shiftright(h, 1) AS h", "cast(null AS double) AS cost", "best AS below")
        best = (
            own.unionAll(halves).groupBy("h")
            .agg(F.max("cost").alias("cost"), noise.settle(F.sum("below")).alias("below"))
            .selectExpr("h", "least(cost, below) AS best", "cost <= below AS keep")
        )
        if up % 8 == 0:
            best = materialize(best, "best")
        kept = kept.unionAll(best)
    kept = materialize(kept.filter("keep").select("h"), "kept")
    ancestors = kept.selectExpr("h", f"explode(sequence(1, {max(1, levels)})) AS up").selectExpr(
        "h", "shiftright(h, up) AS above"
    ).filter("above > 0")
    covered = ancestors.join(kept.withColumnRenamed("h", "above"), "above", "left_semi").select("h").distinct()
    up = f"{levels} - length(bin(h)) + 1"
    return (
        kept.join(covered, "h", "left_anti")
        .selectExpr("h", f"shiftleft(h, {up}) - {1 << levels} AS first", f"shiftleft(h + 1, {up}) - {(1 << levels) + 1} AS last")
        .filter(F.col("first") < n)
        .selectExpr("h", "first", f"least(last, {n - 1}L) AS last")
    )


def bucket_totals(cells: DataFrame, buckets: DataFrame, domain: Domain) -> DataFrame:
    """Exact total of every bucket: a cell finds its bucket among its ancestors."""
    levels = heap_levels(domain)
    leaves = cells.select((flat_index(domain) + F.lit(1 << levels)).alias("leaf"), "v")
    climbs = leaves.selectExpr("v", f"explode(sequence(0, {levels})) AS up", "leaf").selectExpr(
        "shiftright(leaf, up) AS h", "v"
    )
    sums = climbs.groupBy("h").agg(F.sum("v").alias("s"))
    return buckets.join(sums, "h", "left").selectExpr("h", "first", "last", "coalesce(s, 0L) AS total")


PIECE = 1 << 16


def bucket_release(
    cells: DataFrame, buckets: DataFrame, domain: Domain, epsilon: float, ratio: float = 0.5, seed: str = "seed", trial: int = 0
) -> DataFrame:
    """Per cell: bucket mean plus the bucket's one noise draw over its length."""
    draw = noise.laplace(1.0 / ((1.0 - ratio) * epsilon), seed, "bucket", trial, F.col("first"))
    length = F.expr("last - first + 1")
    released = bucket_totals(cells, buckets, domain).select(
        "first", "last", (F.col("total") / length + draw / length).alias("y")
    )
    # one bucket may hold most of the vector: list it in pieces, spread the pieces
    pieces = released.selectExpr("y", "last", f"explode(sequence(first, last, {PIECE}L)) AS start").repartition("start")
    return pieces.selectExpr(f"explode(sequence(start, least(start + {PIECE - 1}, last))) AS idx", "y")
