"""Adaptive bisection view: private cuts until blocks look uniform.

All open blocks of a tree level, of all trials, are processed together.  A level
reads the cells of its large blocks once, shuffles only histograms and stores the
picks, one row per open block with the statistics of both children, which are a
by-product of scoring the cuts.  Blocks with few cells leave the loop and are grown to
their leaves inside tasks (``plans.settle``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.operators import cells as C
from cellview.operators.layout import attach
from cellview.operators.mechanisms import best_per_group, random_cut
from cellview.plans import settle
from cellview.session import discard, fresh_path


@dataclass(frozen=True)
class BisectionPlan:
    """Budget split and thresholds for one domain size."""

    epsilon: float = 1.0
    ratio: float = 0.9
    alpha: float = 1.6
    beta: float = 1.2
    gamma: float = 0.9
    theta: float | None = None
    # Spend the cut budget on depths 0..kappa-1, which adds up to exactly its
    # share; False also scores at depth kappa, one level over the budget.
    strict_budget: bool = True

    @property
    def epsilon_split(self) -> float:
        return self.epsilon * self.ratio

    @property
    def epsilon_leaf(self) -> float:
        return self.epsilon * (1 - self.ratio)

    @property
    def threshold(self) -> float:
        return 1 / self.epsilon_leaf if self.theta is None else self.theta

    @property
    def stop_scale(self) -> float:
        return ((2 * self.alpha - 1) / (self.alpha - 1) + 1) * (2 / (self.gamma * self.epsilon_split))

    @property
    def depth_discount(self) -> float:
        return self.stop_scale * math.log(self.alpha)

    def scored_levels(self, domain: Domain) -> int:
        return math.ceil(math.log2(domain.cells()) * self.beta)

    def epsilon_cut(self, domain: Domain) -> float:
        return (1 - self.gamma) * self.epsilon_split / max(1, self.scored_levels(domain))

    def last_scored_depth(self, domain: Domain) -> int:
        return self.scored_levels(domain) - (1 if self.strict_budget else 0)


def keeps_open(ae: Column, size: Column, depth: Column, plan: BisectionPlan, *key) -> Column:
    """Noisy test that a block is still worth cutting; single cells never are."""
    floor = F.lit(plan.threshold + 2 - plan.depth_discount)
    biased = F.greatest(ae - F.lit(plan.depth_discount) * depth, floor)
    return (size > 1) & (noise.settle(biased) + noise.laplace(plan.stop_scale, *key) > F.lit(plan.threshold))


def score_cuts(stats: DataFrame) -> DataFrame:
    """Score of a cut: minus the deviation left in both sides."""
    return stats.withColumn("score", noise.settle(-(F.col("ae_l") + F.col("ae_r"))))


def _trial() -> Column:
    return F.substring_index("block", "#", 1)


def _path() -> Column:
    return F.substring_index("block", "#", -1)


class _Draws:
    """Keyed columns of the level loop; the same for every level and trial, built once."""

    def __init__(self, domain: Domain, plan: BisectionPlan, seed):
        self.domain, self.plan, self.key = domain, plan, (seed, "random-cut", _trial())
        self.size = domain.size_column()
        self.score = noise.settle(-(F.col("ae_l") + F.col("ae_r"))).alias("score")
        sensitivity = F.expr("2.0D * (2.0D - 2.0D / size)")
        self.utility = noise.utility(
            F.col("score"), plan.epsilon_cut(domain), sensitivity, seed, "cut", _trial(), _path(), F.col("attr"), F.col("cut")
        )
        depth = F.col("depth") + 1
        self.stays = [
            keeps_open(
                F.col(f"ae_{side}"), F.col(f"size_{side}"), depth, plan, seed, "stop", _trial(), F.concat(_path(), F.lit(letter)),
            ).alias(f"open_{side}")
            for side, letter in (("l", "L"), ("r", "R"))
        ]
        self.closed = [F.lit(False).alias("open_l"), F.lit(False).alias("open_r")]

    def picks(self, histogram, frontier, depth: int, rows: int, last: bool) -> DataFrame:
        """One cut per open block, with both sides' statistics and stop tests."""
        if depth <= self.plan.last_scored_depth(self.domain):
            cuts = C.candidate_cuts(frontier, self.domain, self.size)
            bound = rows * sum(self.domain.sizes.values())
            stats = C.cut_statistics(histogram, cuts, bound, codes=max(self.domain.sizes.values())).select("*", self.score)
            chosen = best_per_group(stats.select("*", self.utility.alias("z")), ["block"], "z", ["pos", "cut"])
        else:
            cuts = random_cut(frontier.select("*", self.size.alias("size")), self.domain, self.key, _path())
            chosen = C.cut_statistics(histogram, cuts.select(*C.CUT), rows, all_cuts=False)
        return chosen.select("*", *(self.closed if last else self.stays))


CARRY = [
    ("total", "total_l", "total_r"),
    ("ae", "ae_l", "ae_r"),
    ("size", "size_l", "size_r"),
    ("open", "open_l", "open_r"),
]


def _written(df: DataFrame, path: str, **counts: str) -> tuple[DataFrame, dict]:
    """``df`` stored, and what was counted on the way."""
    seen = Observation()
    df.observe(seen, *[F.expr(f"coalesce({e}, 0L)").alias(n) for n, e in counts.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def bisection_leaves(
    cells: DataFrame,
    domain: Domain,
    plan: BisectionPlan = BisectionPlan(),
    seed: str = "seed",
    trials: tuple[int, ...] = (0,),
    max_depth: int | None = None,
) -> DataFrame:
    """Grow one tree per trial, all at once; returns ``trial`` and the leaves with their exact totals.

    The root is always cut once.  ``max_depth`` closes all blocks at that depth.
    Blocks of at most ``settle.SMALL_CELLS`` cells leave the level loop and are
    finished inside tasks, so the number of jobs is bounded by the large blocks.  The driver only
    learns how many blocks of either kind are open.
    """
    spark = cells.sparkSession
    if domain.cells() < 2:
        raise ValueError("a domain of one cell cannot be cut")
    base, attrs, ranges = fresh_path(spark, "bisection"), domain.attrs, domain.ranges()
    counted, seen = _written(C.count_table_from_counts(cells, domain), f"{base}/cells", n="count(1)", total="sum(v)")
    roots = [(f"{t}#0", 0, *[x for n in domain.sizes.values() for x in (0, n - 1)], seen["total"], seen["n"]) for t in trials]
    frontier = spark.createDataFrame(roots, "block string, depth int, " + ", ".join(f"{r} int" for r in ranges) + ", total long, cells long")
    current = counted.select(F.explode(F.array(*[F.lit(r[0]) for r in roots])).alias("block"), *attrs, "v")
    small_rows, big_rows = (len(trials), 0) if seen["n"] <= settle.SMALL_CELLS else (0, len(trials))
    draws, depth, handed = _Draws(domain, plan, seed), 0, 0
    while small_rows or big_rows:
        if small_rows:
            small = frontier.where(F.col("cells") <= settle.SMALL_CELLS).select("block", "depth", *ranges)
            inside = attach(current, small.select("block"), ["block"], small_rows)
            small.unionByName(inside, allowMissingColumns=True).write.parquet(f"{base}/small/level={depth:04d}")
            handed += small_rows
        if not big_rows:
            break
        if small_rows:
            frontier = frontier.where(F.col("cells") > settle.SMALL_CELLS)
            current = attach(current, frontier.select("block"), ["block"], big_rows)
        last = max_depth is not None and depth + 1 >= max_depth
        frontier = frontier.drop("cells")
        histogram = C.code_histogram(current, frontier, domain).persist()
        picks = draws.picks(histogram, frontier, depth, big_rows, last)
        picks = attach(picks, frontier.select("block", *ranges), ["block"], big_rows)
        level, seen = _written(picks, f"{base}/picks/level={depth:04d}", n="sum(int(open_l) + int(open_r))")
        histogram.unpersist()
        still_open = seen["n"]
        if not still_open:
            break
        moved = C.relabel_cells(current, level, domain, big_rows)
        depth += 1
        current, _ = _written(moved, f"{base}/open{depth}", n="count(1)")
        if depth > 1:
            discard(spark, f"{base}/open{depth - 1}")
        children = C.split_blocks(level, domain, CARRY).filter("open").drop("ae", "size", "open")
        sizes = current.groupBy("block").agg(F.count(F.lit(1)).alias("cells"))
        frontier = children.join(sizes, "block", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
        frontier, seen = _written(frontier, f"{base}/frontier{depth}", small=f"sum(int(cells <= {settle.SMALL_CELLS}))")
        small_rows, big_rows = seen["small"], still_open - seen["small"]
    out = None
    if depth or not handed:
        every = spark.read.parquet(f"{base}/picks")
        out = C.split_blocks(every, domain, CARRY).filter(~F.col("open")).drop("open")
    if handed:
        tree = settle.LocalTree(domain, plan, seed, max_depth)
        done = settle.settle_blocks(spark.read.parquet(f"{base}/small").drop("level"), domain, tree, "total long, ae double, size double")
        done, _ = _written(done, f"{base}/settled", n="count(1)")
        out = done if out is None else out.unionByName(done)
    return out.select(_trial().cast("int").alias("trial"), _path().alias("block"), *[c for c in out.columns if c != "block"])


def perturb_leaves(leaves: DataFrame, scale: float, *key) -> DataFrame:
    """Add one Laplace draw to each block total: value = mean + noise / size."""
    return (
        leaves.withColumn("mean", F.col("total") / F.col("size"))
        .withColumn("noise", noise.laplace(scale, *key, F.col("block")))
        .withColumn("value", F.col("mean") + F.col("noise") / F.col("size"))
    )


def bisection_views(
    cells: DataFrame,
    domain: Domain,
    plan: BisectionPlan = BisectionPlan(),
    seed: str = "seed",
    trials: tuple[int, ...] = (0,),
    max_depth: int | None = None,
) -> DataFrame:
    """Leaves of every trial with released values, told apart by ``trial``.  Exact columns (total,
    mean, ae, noise) are for the curator; ``published`` drops them."""
    leaves = bisection_leaves(cells, domain, plan, seed, trials, max_depth)
    return perturb_leaves(leaves, 1 / plan.epsilon_leaf, seed, "leaf", F.col("trial"))


def bisection_view(
    cells: DataFrame, domain: Domain, plan: BisectionPlan = BisectionPlan(), seed: str = "seed", trial: int = 0, max_depth: int | None = None
) -> DataFrame:
    """The view of one trial."""
    return bisection_views(cells, domain, plan, seed, (trial,), max_depth).drop("trial")


def published(view: DataFrame, domain: Domain) -> DataFrame:
    """The part of a view that may leave the curator."""
    return view.select(*domain.ranges(), "depth", "size", "value")
