"""Sums over ranges of attribute sets, without pairing queries with data.

A range sum is a signed sum of ``2**k`` prefix sums, one per corner.  Prefix sums
of a set come from

* a *summed-area table*, if the grid of the set is small: one running sum per
  attribute, and every corner is one lookup; or
* *dyadic nodes* beyond that: a point counts for the node of each level above
  it, a prefix is one node per set bit of its length, and the two meet by
  equality of nodes.

Boxes are handled by the same sums: a box is its ``2**k`` corners as impulses, and
its overlap with a prefix is a running sum of a running sum (grids) or a
polynomial in the corner whose coefficients are node sums (dyadic).  So the work is linear in
points, boxes and queries, whatever their widths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.operators.layout import BROADCAST_ROWS, attach, listed, small_table

DENSE_CELLS = 1 << 18  # grids up to this size get a summed-area table
NODE_ROWS = 4096  # nodes that one point may stand for; attributes beyond are compared after the join


def canonical(queries: DataFrame, domain: Domain) -> DataFrame:
    """Long ``(query_id, attr, lo, hi)`` rows to ``(query_id, aset, los, his, possible)``.

    ``aset`` has the positions of the attributes used, in domain order.  Several conditions
    on one attribute intersect, ranges are clipped to the domain, and a query with a
    disjoint condition is not ``possible``.  A null or unknown ``attr`` asks nothing.
    """
    rows = [(a, i, n) for i, (a, n) in enumerate(domain.sizes.items())]
    frame = small_table(queries.sparkSession, rows, "attr string, pos int, _n int")
    placed = queries.select("query_id", "attr", "lo", "hi").join(F.broadcast(frame), "attr", "left")
    condition = "struct(pos, int(coalesce(greatest(lo, 0), 0)) AS lo, int(coalesce(least(hi, _n - 1), _n - 1)) AS hi)"
    # one row per query: its few conditions, no more than it was given
    parts = placed.groupBy("query_id").agg(F.expr(f"collect_list(if(pos IS NULL, NULL, {condition})) AS c"))
    picked = parts.selectExpr("query_id", "c", "array_sort(array_distinct(transform(c, x -> x.pos))) AS aset").selectExpr(
        "query_id", "aset", "transform(aset, p -> array_max(transform(filter(c, x -> x.pos = p), x -> x.lo))) AS los",
        "transform(aset, p -> array_min(transform(filter(c, x -> x.pos = p), x -> x.hi))) AS his",
    )
    return picked.withColumn("possible", F.expr("forall(zip_with(los, his, (l, h) -> l <= h), x -> x)"))


@dataclass(frozen=True)
class RangeSets:
    """The attribute sets of a workload, numbered."""

    domain: Domain
    sets: list[tuple[int, ...]]
    books: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(asked: DataFrame, domain: Domain) -> "RangeSets":
        return RangeSets(domain, sorted(map(tuple, asked.agg(F.collect_set("aset")).first()[0])))

    def dims(self, s) -> list[int]:
        sizes = list(self.domain.sizes.values())
        return [sizes[i] for i in s]

    def is_dense(self, s) -> bool:
        return math.prod(self.dims(s)) <= DENSE_CELLS

    def covered(self, s) -> int:
        """How many attributes get nodes, so that a point stands for at most ``NODE_ROWS`` of them."""
        rows = 1
        for k, n in enumerate(self.dims(s)):
            rows *= n.bit_length()
            if rows > NODE_ROWS:
                return max(1, k)
        return len(s)

    def rows(self) -> list[tuple]:
        whole, out = self.domain.cells(), []
        for sid, s in enumerate(self.sets):
            dims = self.dims(s)
            grid, dense = math.prod(dims), self.is_dense(s)
            strides = [math.prod(dims[j + 1 :]) if dense else 0 for j in range(len(dims))]
            out.append((sid, list(s), list(s), len(s), dims, strides, grid if dense else 0, dense, self.covered(s), float(whole // grid)))
        return out

    def book(self, spark) -> DataFrame:
        """``sid, aset, picks, k, dims, strides, grid, dense, covered, rest``: one row per set."""
        if spark not in self.books:
            self.books[spark] = small_table(
                spark, self.rows(),
                "sid int, aset array<int>, picks array<int>, k int, dims array<int>, strides array<bigint>, grid bigint, dense boolean, covered int, rest double",
            )
        return self.books[spark]

    def list_of(self, spark) -> Column:
        """The sets with their attributes and sizes as one array."""
        rows = [(r[0], r[2], r[4]) for r in self.rows()]
        return listed(self.book(spark).select("sid", "picks", "dims"), rows, ["sid", "picks", "dims"], ["int", "array<int>", "array<int>"])

    def with_sets(self, df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
        return attach(df, self.book(df.sparkSession).select(*keys, *columns), keys, len(self.sets))


INDEX = "aggregate(zip_with({codes}, strides, (c, s) -> c * s), 0L, (a, x) -> a + x)"


def corners(asked: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``2**k`` signed corners ``xs`` per query, without those before the first code.

    An impossible query asks for the first code with sign 0, so that every query has a row.
    """
    every = asked.selectExpr("*", "explode(sequence(0L, if(possible, shiftleft(1L, k) - 1L, 0L))) AS _c")
    placed = every.selectExpr(
        "query_id", "sid", "dims", "strides", "dense", "covered", *keep,
        "transform(his, (h, j) -> if(not possible, 0, if((shiftright(_c, j) & 1) = 1, los[j] - 1, h))) AS xs",
        "if(not possible, 0, if(bit_count(_c) % 2 = 0, 1, -1)) AS sign",
    )
    return placed.where("forall(xs, x -> x >= 0)")


def summed_area(points: DataFrame, sets: RangeSets, by: list[str], weights: list[str], times: int, views: Column | None) -> DataFrame:
    """``(by, sid, idx, weights)``: prefix sums, ``times`` over, of every cell of the small grids."""
    spark = points.sparkSession
    kinds = {w: points.schema[w].dataType for w in weights}
    keys = [*by, "sid", "idx"]
    indexed = sets.with_sets(points, ["sid"], "dims", "strides").select(*by, "sid", F.expr(INDEX.format(codes="codes") + " AS idx"), "dims", "strides", *weights)
    zeros = sets.book(spark).where("dense").selectExpr("sid", "explode(sequence(0L, grid - 1)) AS idx", "dims", "strides")
    if by:
        zeros = zeros.withColumn("_views", views).select("sid", "idx", "dims", "strides", F.inline("_views"))
    zeros = zeros.select(*keys, "dims", "strides", *[F.lit(0).cast(kinds[w]).alias(w) for w in weights])
    table = indexed.unionByName(zeros)
    for j in range(max((len(s) for s in sets.sets), default=0)):
        table = table.selectExpr("*", f"coalesce(idx div get(strides, {j}) % get(dims, {j}), 0L) AS _at").selectExpr(
            "*", f"idx - _at * coalesce(get(strides, {j}), 0L) AS _line"
        )
        if not j:  # the lines of the first attribute are brought together before cells are merged, so both take one shuffle
            table = table.repartition(*by, "sid", "_line").groupBy(*by, "sid", "_line", "_at", "idx").agg(
                F.first("dims").alias("dims"), F.first("strides").alias("strides"), *[F.sum(w).alias(w) for w in weights]
            )
        line = Window.partitionBy(*by, "sid", "_line").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for _ in range(times):
            table = table.withColumns({w: F.when(F.size("dims") > j, F.sum(w).over(line)).otherwise(F.col(w)) for w in weights})
        table = table.drop("_at", "_line")
    if all(not s for s in sets.sets):
        table = table.groupBy(*keys).agg(*[F.sum(w).alias(w) for w in weights])
    return table.select(*by, "sid", "idx", *weights)


def _spread(df: DataFrame, sets: RangeSets, each: str) -> DataFrame:
    """Rows once per combination of nodes of the covered attributes; ``each`` lists the nodes of attribute {j}."""
    df = df.withColumn("nodes", F.expr("cast(array() AS array<bigint>)"))
    for j in range(max(sets.covered(s) for s in sets.sets)):
        listed = f"explode(if({j} < covered, {each.format(j=j)}, array(0L))) AS _node"
        df = df.selectExpr("*", listed).withColumn("nodes", F.expr("array_append(nodes, _node)")).drop("_node")
    return df


# a node is numbered like a heap: one bit for its level, then its place in the level
BITS = "length(bin(dims[{j}]))"
POINT_NODES = f"transform(sequence(0, {BITS} - 1), b -> shiftleft(1L, {BITS} - b) | shiftright(codes[{{j}}], b))"
PREFIX_NODES = (
    f"transform(filter(sequence(0, {BITS} - 1), b -> (shiftright(xs[{{j}}] + 1, b) & 1) = 1),"
    f" b -> shiftleft(1L, {BITS} - b) | (shiftright(xs[{{j}}] + 1, b) - 1))"
)


def node_sums(points: DataFrame, sets: RangeSets, by: list[str], weights: list[str]) -> DataFrame:
    """``(by, sid, nodes, others, weights)``: sums per combination of nodes; ``others`` are codes without nodes."""
    spread = _spread(sets.with_sets(points, ["sid"], "dims", "covered"), sets, POINT_NODES)
    rest = F.expr("slice(codes, covered + 1, size(codes))")
    return spread.select(*by, "sid", "nodes", rest.alias("others"), *weights).groupBy(*by, "sid", "nodes", "others").agg(*[F.sum(w).alias(w) for w in weights])


def corner_sums(
    points: DataFrame, asked: DataFrame, sets: RangeSets, weights: list[str], by: list[str] = (), polynomial: bool = False, views: Column | None = None, n_views: int = 1
) -> DataFrame:
    """``(by, query_id, size, weights)``: sum of the points ``(by, sid, codes, weights)`` inside every query.

    ``asked`` comes from ``canonical``; ``size`` is the number of cells asked for.  With
    ``polynomial`` the single weight is of an impulse, and a prefix sums ``weight * product(x - code + 1)``
    over the impulses before x.
    """
    by = list(by)
    size = "if(possible, aggregate(zip_with(los, his, (l, h) -> double(h - l + 1)), rest, (a, x) -> a * x), 0D) AS size"
    sized = sets.with_sets(asked, ["aset"], "sid", "k", "dims", "strides", "dense", "covered", "rest").selectExpr("*", size)
    meant = corners(sized, ["size"])
    flags = [sets.is_dense(s) for s in sets.sets]
    parts = []
    if any(flags):
        mine = points if all(flags) else sets.with_sets(points, ["sid"], "dense").where("dense").drop("dense")
        table = summed_area(mine, sets, by, weights, 2 if polynomial else 1, views)
        cells = sum(math.prod(sets.dims(s)) for s in sets.sets if sets.is_dense(s)) * n_views
        looked = meant.where("dense").select("query_id", "size", "sign", "sid", F.expr(INDEX.format(codes="xs") + " AS idx"))
        # every corner has a cell in the table, in each view
        parts.append(attach(looked, table, ["sid", "idx"], cells).select(*by, "query_id", "size", *[(F.col("sign") * F.col(w)).alias(w) for w in weights]))
    if not all(flags):
        mine = sets.with_sets(points, ["sid"], "dense").where("NOT dense").drop("dense")
        terms, width = {w: [()] for w in weights}, max(len(s) for s in sets.sets)
        if polynomial:  # product(x + 1 - code): one coefficient per choice of attributes that give x + 1
            (w,) = weights
            terms = {w: [tuple(j for j in range(width) if c >> j & 1) for c in range(1 << width)]}
            less = lambda t: " * ".join(f"(-coalesce(get(codes, {j}), 0D))" for j in range(width) if j not in t) or "1D"
            mine = mine.select(*by, "sid", "codes", *[F.expr(f"`{w}` * {less(t)}").alias(f"_{k}") for k, t in enumerate(terms[w])])
            columns = {w: [f"_{k}" for k in range(len(terms[w]))]}
        else:
            columns = {w: [w] for w in weights}
        sums = node_sums(mine, sets, by, [c for cs in columns.values() for c in cs])
        sparse = meant.where("NOT dense")
        looked = _spread(sparse, sets, PREFIX_NODES).selectExpr("query_id", "size", "sign", "sid", "nodes", "xs", "slice(xs, covered + 1, size(xs)) AS limits")
        met = attach(looked, sums, ["sid", "nodes"], BROADCAST_ROWS + 1).where("forall(zip_with(others, limits, (c, x) -> c <= x), y -> y)")
        grown = lambda t: " * ".join(f"(coalesce(get(xs, {j}), 0) + 1D)" for j in t) or "1"
        total = {w: " + ".join(f"`{c}` * ({grown(t)})" for c, t in zip(columns[w], terms[w], strict=True)) for w in weights}
        parts.append(met.select(*by, "query_id", "size", *[F.expr(f"sign * ({total[w]})").alias(w) for w in weights]))
        # a query that meets no node still has its row, in each view
        alone = sized.where("NOT dense").select("query_id", "size", *[F.lit(0).cast(points.schema[w].dataType).alias(w) for w in weights])
        if by:
            alone = alone.withColumn("_views", views).select(F.inline("_views"), "query_id", "size", *weights)
        parts.append(alone.select(*by, "query_id", "size", *weights))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*by, "query_id").agg(F.first("size").alias("size"), *[F.sum(w).alias(w) for w in weights])


def interval_nodes(lo: str, hi: str, n: int) -> str:
    """SQL list of the dyadic nodes that tile ``[lo, hi]``; a range up to the last code needs no small nodes there."""
    bits = (n - 1).bit_length()
    end = f"if({hi} >= {n - 1}, {(1 << bits) - 1}, {hi})"
    left, right = f"shiftright({lo} + shiftleft(1, b) - 1, b)", f"shiftright({end} + 1, b)"
    node = lambda at: f"(shiftleft(1L, {bits} - b) | ({at}))"
    first = f"if({left} < {right} AND ({left} & 1) = 1, {node(left)}, NULL)"
    second = f"if({right} - 1 >= {left} + ({left} & 1) AND ({right} & 1) = 1, {node(f'{right} - 1')}, NULL)"
    return f"filter(flatten(transform(sequence(0, {bits}), b -> array({first}, {second}))), x -> x IS NOT NULL)"


def label_cells(cells: DataFrame, blocks: DataFrame, domain: Domain, rows: int) -> DataFrame:
    """Give every cell the blocks that contain it; ``rows`` bounds the number of blocks.

    A block is tiled by products of dyadic intervals, one per attribute, and a cell looks up its
    own node at each combination of levels that some block uses.  Nodes of a block do not
    overlap, so a cell meets a block once.  Only if the product of all attributes' nodes
    could pass ``NODE_ROWS`` are the narrowest attributes compared instead.
    """
    order, most, used = sorted(domain.attrs, key=lambda a: -domain[a]), 1, []
    for a in order:
        pieces = max(1, 2 * ((domain[a] - 1).bit_length() - 1))
        if used and most * pieces > NODE_ROWS:
            continue
        used, most = [*used, a], most * pieces
    others = [a for a in domain.attrs if a not in used]
    bits = {a: (domain[a] - 1).bit_length() for a in used}
    tiled = blocks.select("block", *domain.ranges(), F.expr("cast(array() AS array<bigint>)").alias("nodes"))
    for a in used:
        tiled = tiled.selectExpr("*", f"explode({interval_nodes(f'lo_{a}', f'hi_{a}', domain[a])}) AS _node").withColumn("nodes", F.expr("array_append(nodes, _node)")).drop("_node")
    tiled = tiled.select("block", "nodes", *[f"{s}_{a}" for a in others for s in ("lo", "hi")])
    # a node's level is told by the length of its number
    tops = ", ".join(f"{bits[a]}" for a in used)
    levels = tiled.selectExpr(f"transform(zip_with(nodes, array({tops}), (x, t) -> t - length(bin(x)) + 1), l -> int(l)) AS levels").agg(F.collect_set("levels").alias("l")).scalar()
    own = [f"(shiftleft(1L, {bits[a]} - _l[{i}]) | shiftright(`{a}`, _l[{i}]))" for i, a in enumerate(used)]
    looking = cells.withColumn("_levels", levels).withColumn("_l", F.explode("_levels")).selectExpr(*[f"`{a}`" for a in domain.attrs], "v", f"array({', '.join(own)}) AS nodes")
    met = attach(looking, tiled, ["nodes"], rows * most)
    for a in others:
        met = met.where(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    return met.select("block", *domain.attrs, "v")
