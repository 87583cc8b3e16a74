"""Queries on released views and histograms, and sampling from views.

A view is a table of disjoint boxes ``lo_<attr>, hi_<attr>, value`` that tile
the domain; ``value`` is the released count of every single cell in the box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.operators import ranges as R
from cellview.operators.mechanisms import shift_weights, weighted_sample


def view_range_count(view: DataFrame, queries: DataFrame, domain: Domain, by: list[str] = ()) -> DataFrame:
    """Estimated count of every range query.

    ``by`` names columns that tell several views in one table apart (method,
    trial); all of them are answered in one job, from one list of views.

    A box enters the prefix sums of each attribute set as its signed corners, and
    a query reads its own corners (``operators.ranges``): boxes and queries never meet in pairs.
    """
    by = list(by)
    asked = R.canonical(queries, domain)
    sets = R.RangeSets.of(asked, domain)
    arrays = [F.array(*[F.col(f"{s}_{a}").cast("int") for a in domain.attrs]).alias(f"{s}s") for s in ("lo", "hi")]
    boxes = view.select(*by, *arrays, (F.col("value") * domain.size_column()).alias("_total"))
    # the total of a box spreads evenly over its projection
    area = "aggregate(picks, 1D, (a, p) -> a * (his[p] - los[p] + 1))"
    impulses = (
        boxes.withColumn("_book", sets.list_of(view.sparkSession)).select(*by, "los", "his", "_total", F.inline("_book"))
        .selectExpr(*by, "sid", "los", "his", "picks", "dims", f"_total / {area} AS _density", "explode(sequence(0L, shiftleft(1L, size(picks)) - 1L)) AS _c")
        .selectExpr(*by, "sid", "dims", "transform(picks, (p, i) -> if((shiftright(_c, i) & 1) = 1, his[p] + 1, los[p])) AS codes", "if(bit_count(_c) % 2 = 0, 1D, -1D) * _density AS w")
        .where("forall(zip_with(codes, dims, (c, n) -> c < n), x -> x)")
    )
    views, n_views = None, 1
    if by:
        views = view.agg(F.collect_set(F.struct(*by)).alias("l")).scalar()
        n_views = view.select(*by).distinct().count()
    hits = R.corner_sums(impulses.select(*by, "sid", "codes", "w"), asked, sets, ["w"], by, polynomial=True, views=views, n_views=n_views)
    # corner sums cancel, which leaves a trace in the last digits
    return hits.select(*by, "query_id", noise.settle(F.col("w"), 9).alias("estimate"))


PIECE = 1 << 16  # cells that one row lists


def view_marginal(view: DataFrame, domain: Domain, attrs: list[str]) -> DataFrame:
    """Released marginal: every box spreads its total over its projected cells.

    Boxes with the same projection are summed before they are spread out.
    """
    part = domain.keep(attrs)
    out = (
        view.withColumn("_tot", F.col("value") * domain.size_column())
        .groupBy(*part.ranges()).agg(F.sum("_tot").alias("_tot"))
        .withColumn("_y", F.col("_tot") / part.size_column())
    )
    # a box may hold most of the grid: number its cells, list them in pieces and spread the pieces
    widths = [f"(hi_{a} - lo_{a} + 1L)" for a in attrs]
    pieces = out.selectExpr(
        "*", f"{' * '.join(widths)} AS _n", f"explode(sequence(0L, ({' * '.join(widths)} - 1L) div {PIECE}L)) AS _piece"
    ).repartition(*part.ranges(), "_piece")
    listed = pieces.selectExpr("*", f"explode(sequence(_piece * {PIECE}L, least((_piece + 1L) * {PIECE}L, _n) - 1L)) AS _i")
    codes = []
    for i, a in enumerate(attrs):
        later = " * ".join(widths[i + 1 :]) or "1L"
        codes.append(f"int(lo_{a} + (_i div ({later})) % {widths[i]}) AS `{a}`")
    return listed.selectExpr(*codes, "_y").groupBy(*attrs).agg(F.sum("_y").alias("y"))


def histogram_marginal(histogram: DataFrame, attrs: list[str]) -> DataFrame:
    """Sum a released dense histogram over the other attributes."""
    return histogram.groupBy(*attrs).agg(noise.settle(F.sum("y")).alias("y"))


def stored_marginal(marginals: DataFrame, attrs: list[str]) -> DataFrame:
    """Look up a projection that was released on its own."""
    return marginals.filter(F.col("proj") == ",".join(attrs)).select("idx", "y")


def view_sample(view: DataFrame, draws: DataFrame, key: str, domain: Domain, seed: str, mode: str = "clamp") -> DataFrame:
    """One synthetic point per row of ``draws``: a box by weight, then uniform.

    ``mode='clamp'`` gives boxes with a negative total no weight; ``'shift'``
    subtracts the smallest total from all of them.
    """
    boxes = view.select(*domain.ranges(), noise.settle(F.col("value") * domain.size_column()).alias("_w"))
    if mode == "shift":
        boxes = shift_weights(boxes, "_w", "_n").drop("_w").withColumnRenamed("_n", "_w")
    u = noise.unit(seed, "box", F.col(key))
    placed = weighted_sample(boxes.withColumnRenamed("_w", "weight"), domain.ranges(), "weight", draws.select(key), u)
    points = [
        (F.col(f"lo_{a}") + F.floor(noise.unit(seed, "point", a, F.col(key)) * (F.col(f"hi_{a}") - F.col(f"lo_{a}") + 1)))
        .cast("int").alias(a)
        for a in domain.attrs
    ]
    return placed.select(key, *points)


LEAF_OVERHEAD, CELL_BYTES, TENSOR_HEADER = 16, 4, 96  # fixed values: bytes


def readable_size(size: str) -> str:
    """SQL text of a byte count: the largest unit that leaves at least one, two decimals."""
    arms = " ".join(
        f"WHEN {size} >= {1 << (10 * k)} THEN concat(format_string('%.2f', {size} / {float(1 << (10 * k))!r}D), ' {name}')"
        for k, name in ((6, "EB"), (5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B"))
    )
    return f"CASE {arms} ELSE '0B' END"


def view_size(views: DataFrame, by: list[str], domain: Domain) -> DataFrame:
    """Bytes of a view (bounds, value and depth per leaf) against a dense tensor."""
    leaf = 8 * len(domain) + LEAF_OVERHEAD
    dense = float(CELL_BYTES * domain.cells() + TENSOR_HEADER)
    return (
        views.groupBy(*by).agg(F.count(F.lit(1)).alias("leaves"))
        .withColumn("bytes", (F.col("leaves") * leaf).cast("bigint"))
        .withColumn("dense_bytes", F.lit(dense))
        .withColumn("size_text", F.expr(readable_size("bytes")))
    )


def stored_sizes(views: DataFrame, by: list[str], domain: Domain) -> DataFrame:
    """Bytes that stored views take, from the metadata of their files, next to the formula of ``view_size``.

    ``views`` is a table read from files, such as ``load_views``; a file counts once.
    """
    files = views.select(*by, "_metadata.file_path", "_metadata.file_size").distinct().groupBy(*by)
    stored = files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("stored_bytes"))
    return view_size(views, by, domain).join(stored, by)


def leaf_rectangles(view: DataFrame, x: str, y: str) -> DataFrame:
    """Boxes of a two-attribute view as drawable rectangles."""
    return view.select(
        (F.col(f"lo_{x}") - 0.5).alias("x0"), (F.col(f"hi_{x}") + 0.5).alias("x1"),
        (F.col(f"lo_{y}") - 0.5).alias("y0"), (F.col(f"hi_{y}") + 0.5).alias("y1"),
    )
