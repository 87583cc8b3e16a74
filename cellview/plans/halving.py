"""Half-split tree view: every cut goes through the middle.

A node splits all attributes (or a rotating few) in half at once, so the whole
way of a cell down the tree follows from its codes: one path code, one digit per
halved attribute and level.  Cells are never moved or relabelled; the totals of all nodes of several
levels come from one aggregation over prefixes of the path codes, for all trials at once.  The level loop
then works on nodes only, and nodes with few cells are finished inside tasks (``plans.settle``).
Empty children are nodes too and take part in the noisy test.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.operators import cells as C
from cellview.operators.layout import attach
from cellview.plans import settle
from cellview.session import fresh_path

FANOUT_LIMIT = 12
BAND = 8  # levels whose totals are counted in one aggregation


def tree_scale(fanout: int, epsilon: float) -> float:
    return (2 * fanout - 1) / (fanout - 1) * (2 / epsilon)


def rotating_targets(domain: Domain, cut_max: int | None, depth: int) -> set[int]:
    """Attributes cut at a depth: all, or ``cut_max`` of them in turn."""
    d = len(domain)
    if cut_max is None:
        if d > FANOUT_LIMIT:
            raise ValueError(f"more than {FANOUT_LIMIT} attributes need cut_max: a node would have 2**{d} children")
        return set(range(d))
    if not 1 <= cut_max <= d:
        raise ValueError("cut_max must be between 1 and the number of attributes")
    return {(depth * cut_max + i) % d for i in range(cut_max)}


def half_split(nodes: DataFrame, domain: Domain, cut_max: int | None = None, depth: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Children of every node; ``block`` grows by one half digit per attribute; ``keep`` columns are passed on."""
    targets = rotating_targets(domain, cut_max, depth)
    out = nodes.selectExpr(*keep, "concat(block, '/') AS block", "depth + 1 AS depth", *domain.ranges())
    for i, a in enumerate(domain.attrs):
        if i not in targets:
            continue
        lo, hi = f"lo_{a}", f"hi_{a}"
        halves = (
            f"inline(if({lo} < {hi},"
            f" array(struct({lo} AS _l, ({lo} + {hi}) div 2 AS _h, '0' AS _s),"
            f" struct(({lo} + {hi}) div 2 + 1 AS _l, {hi} AS _h, '1' AS _s)),"
            f" array(struct({lo} AS _l, {hi} AS _h, '0' AS _s))))"
        )
        rest = [c for c in domain.ranges() if c not in (lo, hi)]
        out = out.selectExpr(*keep, "block", "depth", *rest, halves).selectExpr(
            *keep, "concat(block, _s) AS block", "depth", *rest, f"int(_l) AS {lo}", f"int(_h) AS {hi}"
        )
    return out.select(*keep, "block", "depth", *domain.ranges())


def half_digits(attr: str, n: int) -> str:
    """SQL text of the digits of a code: which half it falls into, halving after halving."""
    steps = (n - 1).bit_length()
    if not steps:
        return "''"
    down = (
        f"if(z.lo = z.hi, named_struct('lo', z.lo, 'hi', z.hi, 's', concat(z.s, '0')),"
        f" if(`{attr}` > (z.lo + z.hi) div 2, named_struct('lo', int((z.lo + z.hi) div 2 + 1), 'hi', z.hi, 's', concat(z.s, '1')),"
        f" named_struct('lo', z.lo, 'hi', int((z.lo + z.hi) div 2), 's', concat(z.s, '0'))))"
    )
    return f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {n - 1}, 's', ''), (z, i) -> {down}, z -> z.s)"


def path_codes(cells: DataFrame, domain: Domain, cut_max: int | None, first: int, last: int) -> tuple[DataFrame, list[int]]:
    """``(path, attrs, v)``: the path of every cell down to depth ``last``, and the lengths of its prefixes
    for the depths ``first .. last``."""
    attrs, cuts, parts, length, lengths = domain.attrs, [0] * len(domain), ["'0'"], 1, []
    for depth in range(last + 1):
        if depth >= first:
            lengths.append(length)
        targets = sorted(rotating_targets(domain, cut_max, depth))
        if depth < last:
            parts.append("'/'")
            for i in targets:
                cuts[i] += 1
                # an attribute with one code left stays in its lower half
                parts.append("'0'" if cuts[i] > (domain[attrs[i]] - 1).bit_length() else f"substring(_h{i}, {cuts[i]}, 1)")
            length += 1 + len(targets)
    halved = cells.selectExpr(*[f"{half_digits(a, n)} AS _h{i}" for i, (a, n) in enumerate(domain.sizes.items())], *attrs, "v")
    return halved.selectExpr(f"concat({', '.join(parts)}) AS path", *attrs, "v"), lengths


def halving_leaves(
    cells: DataFrame,
    domain: Domain,
    epsilon: float = 1.0,
    theta: float = 0.0,
    fanout: int | None = None,
    cut_max: int | None = None,
    seed: str = "seed",
    trials: tuple[int, ...] = (0,),
    max_depth: int | None = None,
) -> DataFrame:
    """Leaves of one tree per trial with exact totals; ``fanout`` defaults to 2**d."""
    spark, ranges = cells.sparkSession, domain.ranges()
    fanout = fanout or 2 ** len(rotating_targets(domain, cut_max, 0))
    scale = tree_scale(fanout, epsilon)
    discount = scale * math.log(fanout)
    base = fresh_path(spark, "halving")

    def written(df: DataFrame, name: str, count: str):
        seen = Observation()
        path = f"{base}/{name}"
        df.observe(seen, F.expr(f"coalesce({count}, 0L) AS n")).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def judge(nodes: DataFrame, depth: int) -> DataFrame:
        biased = F.greatest(F.col("total") - F.lit(discount * depth), F.lit(theta - discount))
        noisy = noise.settle(biased) + noise.laplace(scale, seed, "tree", F.col("trial"), F.col("block"))
        split = F.lit(False) if depth == max_depth else (noisy > F.lit(theta)) & (F.col("size") > 1)
        return nodes.select("*", domain.size_column().alias("size")).select("*", split.alias("open"))

    def totals(below, depth: int):
        """Stored totals and cell numbers of all nodes with cells at depths ``depth .. depth + BAND - 1``, and their number."""
        paths, lengths = path_codes(stored, domain, cut_max, max(depth - 1, 0), depth + BAND - 1)
        if below is not None:  # only cells under nodes that still split in some trial
            at, *lengths = lengths
            open_now, n = below
            paths = attach(paths.withColumn("block", F.substring("path", 1, at)), open_now.select("block").distinct(), ["block"], n).drop("block")
        prefixes = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col("path"), F.lit(1), n))
        summed = paths.select(F.explode(prefixes).alias("block"), "v").groupBy("block").agg(
            F.sum("v").cast("bigint").alias("total"), F.count(F.lit(1)).alias("cells")
        )
        return written(summed, f"totals{depth:04d}", "count(1)")

    def hand_over(small: DataFrame, depth: int, n: int) -> None:
        """Nodes with few cells, and their cells, for the tasks that finish them."""
        named = small.select(F.concat_ws("#", "trial", "block").alias("name"), "block", "depth", *ranges)
        paths, (length,) = path_codes(stored, domain, cut_max, depth, depth)
        inside = attach(paths.withColumn("block", F.substring("path", 1, length)), named.select("name", "block"), ["block"], n)
        rows = named.select(F.col("name").alias("block"), "depth", *ranges)
        cells_of = inside.select(F.col("name").alias("block"), *domain.attrs, "v")
        rows.unionByName(cells_of, allowMissingColumns=True).write.parquet(f"{base}/small/level={depth:04d}")

    stored, n_cells = written(C.count_table_from_counts(cells, domain), "cells", "count(1)")
    whole = [c for a, n in domain.sizes.items() for c in (F.lit(0).alias(f"lo_{a}"), F.lit(n - 1).alias(f"hi_{a}"))]
    children = spark.range(1).select(F.explode(F.array(*map(F.lit, trials))).alias("trial"), F.lit("0").alias("block"), F.lit(0).alias("depth"), *whole)
    depth, handed, out = 0, 0, None
    if n_cells <= settle.SMALL_CELLS:
        hand_over(children, 0, len(trials))
        handed = len(trials)
    else:
        counted, n_counted = totals(None, 0)
        while True:
            known = attach(children, counted, ["block"], n_counted, "left").select(
                "trial", "block", "depth", *ranges, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("cells", F.lit(0)).alias("cells")
            )
            level, n_small = written(known, f"known{depth:04d}", f"sum(int(cells <= {settle.SMALL_CELLS}))")
            if n_small:
                hand_over(level.where(F.col("cells") <= settle.SMALL_CELLS), depth, n_small)
                handed += n_small
            nodes, n_open = written(judge(level.where(F.col("cells") > settle.SMALL_CELLS).drop("cells"), depth), f"nodes/level={depth:04d}", "sum(int(open))")
            if not n_open:
                break
            split = nodes.filter("open")
            children = half_split(split, domain, cut_max, depth, ("trial",))
            depth += 1
            if depth % BAND == 0:
                counted, n_counted = totals((split, n_open), depth)
        out = spark.read.schema(nodes.schema).parquet(f"{base}/nodes/level=*").filter("not open").drop("open")
    if handed:
        tree = settle.LocalHalves(partial(rotating_targets, domain, cut_max), scale, discount, theta, seed, max_depth)
        done = settle.settle_blocks(spark.read.parquet(f"{base}/small").drop("level"), domain, tree, "total long, size double")
        done, _ = written(done, "settled", "count(1)")
        named = done.withColumn("trial", F.substring_index("block", "#", 1).cast("int")).withColumn("block", F.substring_index("block", "#", -1))
        named = named.select("trial", "block", "depth", *ranges, "total", "size")
        out = named if out is None else out.unionByName(named)
    return out


def halving_views(cells: DataFrame, domain: Domain, epsilon: float = 1.0, seed: str = "seed", trials: tuple[int, ...] = (0,), **kw) -> DataFrame:
    """Released tree views, told apart by ``trial``: block means plus Laplace noise of scale 2/epsilon."""
    from cellview.plans.bisection import perturb_leaves

    leaves = halving_leaves(cells, domain, epsilon=epsilon, seed=seed, trials=trials, **kw)
    return perturb_leaves(leaves, 2 / epsilon, seed, "tree-leaf", F.col("trial"))


def halving_view(cells: DataFrame, domain: Domain, epsilon: float = 1.0, seed: str = "seed", trial: int = 0, **kw) -> DataFrame:
    """The view of one trial."""
    return halving_views(cells, domain, epsilon, seed, (trial,), **kw).drop("trial")
