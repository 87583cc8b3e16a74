"""Synthetic tables from a noisy Bayesian network.

Attributes have levels of detail (level 0 is the code itself).  The network is
grown one attribute per step: all maximal parent sets within a cell bound are
scored in one job, and the exponential mechanism picks one.  The model, one row
per attribute, is metadata and lives on the driver; data never does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellview.domain import Domain, grid
from cellview.functions import noise
from cellview.operators.lattice import roll_up
from cellview.operators.layout import attach, small_table
from cellview.operators.mechanisms import exponential_mechanism
from cellview.session import materialize


@dataclass(frozen=True)
class Hierarchy:
    """Number of codes per level and, for categories, the upper codes of each
    level's segments (empty for numeric grids, which halve per level)."""

    sizes: tuple[int, ...]
    uppers: tuple[tuple[int, ...], ...] = field(default=())

    @staticmethod
    def numeric(depth: int = 4) -> "Hierarchy":
        return Hierarchy(tuple(2 ** (depth - lvl) for lvl in range(depth)))

    @staticmethod
    def flat(n: int) -> "Hierarchy":
        return Hierarchy((n,))

    @staticmethod
    def taxonomy(uppers: list[list[int]]) -> "Hierarchy":
        return Hierarchy(tuple(len(u) for u in uppers), tuple(tuple(u) for u in uppers))

    @property
    def depth(self) -> int:
        return len(self.sizes)

    def lift(self, code: str, lvl: int) -> str:
        """SQL expression of a level-0 code at ``lvl``."""
        if lvl == 0:
            return f"`{code}`"
        if not self.uppers:
            return f"shiftright(`{code}`, {lvl})"
        segment = []
        for c in range(self.sizes[0]):
            segment.append(next(i for i, u in enumerate(self.uppers[lvl]) if u >= self.uppers[0][c]))
        return f"array({', '.join(map(str, segment))})[`{code}`]"


Levels = dict[str, Hierarchy]


def joint_bound(n: int, d: int, epsilon: float, theta: float, work: float | None = None) -> float:
    """Cells a family may have; with ``work`` given, halved while rows times subsets exceed it."""
    bound = epsilon * n / (4.0 * d * theta)
    if bound <= 0:
        return 0.0
    k = int(math.log2(bound)) if bound >= 1 else 0
    while work is not None and k > 0 and n * math.comb(d, k) > work:
        k, bound = k - 1, bound / 2
    return bound


def _case(attr: str, levels: Levels, of, otherwise: str) -> str:
    """``CASE lv_<attr> WHEN level THEN of(level) ... ELSE otherwise END``"""
    arms = " ".join(f"WHEN {lvl} THEN {of(lvl)}" for lvl in range(levels[attr].depth))
    return f"CASE lv_{attr} {arms} ELSE {otherwise} END"


def name_candidates(candidates: DataFrame, attrs: list[str]) -> DataFrame:
    """Add ``cand``, a readable key such as ``q<-d@1,r@0``."""
    parts = [f"if(lv_{a} >= 0, concat('{a}@', lv_{a}), null)" for a in attrs]
    return candidates.selectExpr(f"concat(child, '<-', concat_ws(',', {', '.join(parts)})) AS cand", "*")


def parent_candidates(spark: SparkSession, placed: list[str], free: list[str], levels: Levels, bound: float) -> DataFrame:
    """Maximal parent sets for every unplaced child.

    A set is feasible if the product of its level sizes is within
    ``bound / size(child)``, and maximal if neither adding an attribute at its
    coarsest level nor refining a member by one level stays feasible.  Widths
    grow along such steps, so looking one step ahead is enough.  A child that
    affords no cell at all keeps the empty set.
    """
    attrs = list(levels)
    rows = [(c, bound / levels[c].sizes[0]) for c in free]
    out = spark.createDataFrame(rows, "child string, tau double").withColumn("width", F.lit(1.0))
    for a in attrs:
        if a not in placed:
            out = out.withColumn(f"lv_{a}", F.lit(-1))
            continue
        size = _case(a, levels, lambda lvl: f"{levels[a].sizes[lvl]}D", "1.0D")
        out = (
            out.withColumn(f"lv_{a}", F.expr(f"explode(sequence(-1, {levels[a].depth - 1}))"))
            .withColumn("width", F.expr(f"width * {size}"))
            .filter(f"lv_{a} < 0 or (tau >= 1 and width <= tau)")
        )
    for a in placed:
        sizes = levels[a].sizes
        add = f"width * {float(sizes[-1])}D > tau"
        refine = _case(a, levels, lambda lvl: "true" if lvl == 0 else f"width * {sizes[lvl - 1] / sizes[lvl]}D > tau", add)
        out = out.filter(f"tau < 1 or ({refine})")
    return name_candidates(out.select("child", *[f"lv_{a}" for a in attrs]), attrs)


def _finest_sets(candidates: DataFrame, attrs: list[str]) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Candidates with the number ``sid`` of their attribute set, and the sets: metadata, a few integers each."""
    used = ", ".join(f"if(child = '{a}' OR lv_{a} >= 0, {i}, NULL)" for i, a in enumerate(attrs))
    keyed = candidates.withColumn("_set", F.expr(f"array_compact(array({used}))"))
    sets = sorted(tuple(r[0]) for r in keyed.select("_set").distinct().collect())
    book = small_table(candidates.sparkSession, [(list(s), k) for k, s in enumerate(sets)], "_set array<int>, sid int")
    return attach(keyed, book, ["_set"], len(sets)).drop("_set"), sets


def leveled_marginals(cells: DataFrame, candidates: DataFrame, levels: Levels) -> DataFrame:
    """Joint counts of child and generalized parents, for all candidates at once.

    Marginals of finest codes, one per attribute set that some candidate uses, are rolled up
    along the lattice of sets (``operators.lattice``); a marginal then meets the
    candidates on its own set.  A set with many cells and candidates is dealt over tasks.
    Absent parents have code -1.
    """
    attrs = list(levels)
    asked, sets = _finest_sets(candidates, attrs)
    sizes = [levels[a].sizes[0] for a in attrs]
    base = cells.select(F.array(*[F.col(a).cast("int") for a in attrs]).alias("codes"), "v")
    finest = roll_up(base, sets, sizes, ["v"])
    book = small_table(cells.sparkSession, [(k, [s.index(i) if i in s else -1 for i in range(len(attrs))]) for k, s in enumerate(sets)], "sid int, at array<int>")
    placed = attach(finest, book, ["sid"], len(sets)).select("sid", "v", *[F.expr(f"get(codes, at[{i}])").alias(a) for i, a in enumerate(attrs)])
    parents = [
        f"{_case(a, levels, lambda lvl, a=a: levels[a].lift(a, lvl), '-1')} AS p_{a}" for a in attrs
    ]
    child = "CASE child " + " ".join(f"WHEN '{a}' THEN `{a}`" for a in attrs) + " END AS x"
    return (
        attach(placed, asked, ["sid"], candidates.count())
        .selectExpr("cand", "child", *parents, child, "v")
        .groupBy("cand", "child", *[f"p_{a}" for a in attrs], "x")
        .agg(F.sum("v").cast("bigint").alias("n"))
    )


def _with_margins(joint: DataFrame, levels: Levels, rows: int) -> DataFrame:
    """Joint counts with the parents' and the child's own totals.

    The joint counts are stored first: they are read three times, and counting
    them again would scan the cells each time.
    """
    joint = materialize(joint, "joint")
    parents = ["cand", *[f"p_{a}" for a in levels]]
    by_parent = joint.groupBy(*parents).agg(F.sum("n").alias("np"))
    by_child = joint.groupBy("cand", "x").agg(F.sum("n").alias("nx"))
    # few rows per parent key, but one child code may hold most of a candidate
    return attach(joint.join(by_parent, parents), by_child, ["cand", "x"], rows)


def dependence_scores(joint: DataFrame, levels: Levels, total: int, rows: int) -> DataFrame:
    """L1 distance of child and parents from independence, per candidate.

    The deviations cancel, so only cells above the product count, twice.
    """
    n = float(total)
    gap = f"2.0D * greatest(n / {n}D - (np / {n}D) * (nx / {n}D), 0.0D)"
    return _with_margins(joint, levels, rows).groupBy("cand", "child").agg(
        noise.settle(F.sum(F.expr(gap))).alias("score")
    )


def information_scores(joint: DataFrame, levels: Levels, total: int, rows: int) -> DataFrame:
    """Mutual information of child and parents in bits, per candidate."""
    n = float(total)
    return _with_margins(joint, levels, rows).groupBy("cand", "child").agg(
        noise.settle(F.sum(F.expr(f"n / {n}D * log2(n * {n}D / (double(np) * double(nx)))"))).alias("score")
    )


@dataclass(frozen=True)
class Family:
    child: str
    parents: tuple[tuple[str, int], ...]

    def row(self, attrs: list[str]) -> tuple:
        chosen = dict(self.parents)
        return (self.child, *[chosen.get(a, -1) for a in attrs])

    def name(self, attrs: list[str]) -> str:
        """The key that ``name_candidates`` gives."""
        chosen = dict(self.parents)
        return f"{self.child}<-" + ",".join(f"{a}@{chosen[a]}" for a in attrs if a in chosen)


def model_frame(spark: SparkSession, model: list[Family]) -> DataFrame:
    rows = [(i, f.child, [(a, lvl) for a, lvl in f.parents]) for i, f in enumerate(model)]
    return spark.createDataFrame(rows, "step int, child string, parents array<struct<col: string, lvl: int>>")


def family_candidates(spark: SparkSession, model: list[Family], levels: Levels) -> DataFrame:
    attrs = list(levels)
    schema = "child string, " + ", ".join(f"lv_{a} int" for a in attrs)
    return name_candidates(spark.createDataFrame([f.row(attrs) for f in model], schema), attrs)


def learn_structure(
    cells: DataFrame, levels: Levels, total: int, epsilon: float, theta: float = 4.0, seed: str = "seed", trial: int = 0,
    score: str = "l1",
) -> list[Family]:
    """Greedy network with half of ``epsilon``; the first pick is free.

    A candidate is counted and scored once; later steps read its stored score.
    """
    spark, attrs, d = cells.sparkSession, list(levels), len(levels)
    bound = joint_bound(total, d, epsilon, theta)
    if score == "l1":
        sensitivity = 6.0 / total
    else:
        sensitivity = 2 / total * math.log2((total + 1) / 2) + (total - 1) / total * math.log2((total + 1) / (total - 1))
    model: list[Family] = []
    known: DataFrame | None = None
    for step in range(d):
        placed = [a for a in attrs if a in {f.child for f in model}]
        free = [a for a in attrs if a not in placed]
        options = parent_candidates(spark, placed, free, levels, bound)
        if step == 0:
            scored = options.withColumn("score", F.lit(0.0))
            share, sens = 0.0, 0.0
        else:
            options = materialize(options, "candidates")
            fresh = options if known is None else materialize(options.join(known, "cand", "left_anti"), "unscored")
            rows = fresh.count() * max(h.sizes[0] for h in levels.values())
            rate = dependence_scores if score == "l1" else information_scores
            new = materialize(rate(leveled_marginals(cells, fresh, levels), levels, total, rows).select("cand", "score"), "scores")
            known = new if known is None else known.unionAll(new)
            scored = known.join(options, "cand")
            share, sens = 0.5 * epsilon / (d - 1), sensitivity
        chosen = exponential_mechanism(
            scored.withColumn("step", F.lit(step)), ["step"], ["cand"], "score", share, sens, (seed, "structure", trial)
        ).collect()[0]
        parents = tuple((a, chosen[f"lv_{a}"]) for a in attrs if chosen[f"lv_{a}"] >= 0)
        model.append(Family(chosen["child"], parents))
    return model


def family_grid(spark: SparkSession, model: list[Family], levels: Levels) -> DataFrame:
    """Every cell of every family's joint grid, each family a distributed range."""
    attrs, out = list(levels), None
    for f in model:
        chosen = dict(f.parents)
        sizes = {f"p_{a}": levels[a].sizes[lvl] for a, lvl in chosen.items()} | {"x": levels[f.child].sizes[0]}
        parents = [F.col(f"p_{a}") if a in chosen else F.lit(-1).alias(f"p_{a}") for a in attrs]
        cells = grid(spark, Domain(sizes), limit=None).select(F.lit(f.name(attrs)).alias("cand"), F.lit(f.child).alias("child"), *parents, "x")
        out = cells if out is None else out.unionAll(cells)
    return out


def noisy_families(
    cells: DataFrame, model: list[Family], levels: Levels, epsilon: float, seed: str = "seed", trial: int = 0
) -> DataFrame:
    """Every cell of every family's joint grid, with noise of scale 4d/epsilon."""
    spark, attrs = cells.sparkSession, list(levels)
    counted = leveled_marginals(cells, family_candidates(spark, model, levels), levels)
    keys = ["cand", "child", *[f"p_{a}" for a in attrs], "x"]
    draw = noise.laplace(2.0 * len(attrs) / (0.5 * epsilon), seed, "family", trial, *[F.col(k) for k in keys if k != "cand"])
    return family_grid(spark, model, levels).join(counted, keys, "left").select(
        *keys, F.expr("coalesce(n, 0L) AS n"), noise.settle(F.expr("coalesce(n, 0L)") + draw).alias("y")
    )


def conditionals(families: DataFrame, levels: Levels) -> DataFrame:
    """Distribution of the child per parent cell: cumulative ``[cdf_lo, cdf_hi)``.

    Negative weights clamp to zero; if nothing is positive the child is uniform.
    One window holds the codes of one child, never more.
    """
    key = ["cand", "child", *[f"p_{a}" for a in levels]]
    group = Window.partitionBy(*key)
    upto = group.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = (
        families.withColumn("_w", F.greatest("y", F.lit(0.0)))
        .withColumn("_t", F.sum("_w").over(group))
        .withColumn("_w", F.when(F.col("_t") > 0, F.col("_w")).otherwise(F.lit(1.0)))
        .withColumn("_t", F.sum("_w").over(group))
        .withColumn("_c", F.sum("_w").over(upto))
    )
    return weighed.select(
        *key, "x",
        noise.settle((F.col("_c") - F.col("_w")) / F.col("_t"), 9).alias("cdf_lo"),
        noise.settle(F.col("_c") / F.col("_t"), 9).alias("cdf_hi"),
    )


def ancestral_sample(
    rows: DataFrame, row_key: str, distributions: DataFrame, model: list[Family], levels: Levels, seed: str = "seed", trial: int = 0
) -> DataFrame:
    """One synthetic record per row of ``rows``.

    Each parent cell is one row with the upper bounds of its child's codes, so
    a record finds its distribution by an equi-join and its code inside it, by halving.
    """
    attrs = list(levels)
    key = ["child", *[f"p_{a}" for a in attrs]]
    tables = materialize(
        distributions.groupBy(*key).agg(F.expr("array_sort(collect_list(cdf_hi)) AS cdf")), "conditionals"
    )
    out = rows.select(row_key)
    for f in model:
        mine = tables.filter(F.col("child") == f.child)
        if not f.parents:
            out = out.withColumn("_cdf", mine.select("cdf").scalar())
        else:
            on = [f"p_{a}" for a, _ in f.parents]
            lifted = [f"{levels[a].lift(a, lvl)} AS p_{a}" for a, lvl in f.parents]
            # a row holds one number per code of the child, so the bound counts numbers
            cells = math.prod(levels[a].sizes[lvl] for a, lvl in f.parents) * levels[f.child].sizes[0]
            out = attach(out.selectExpr("*", *lifted), mine.select(*on, F.col("cdf").alias("_cdf")), on, cells).drop(*on)
        u = noise.unit(seed, "record", trial, f.child, F.col(row_key))
        # bounds up to the draw are counted by halving, one step per projection: Spark keeps them apart
        # and compiles them; a count is never null, so joins need no extra filter
        out = out.withColumn("_u", u).withColumns({"_u": noise.rounded(F.col("_u"), 9), f.child: F.lit(0)})
        step = 1 << (levels[f.child].sizes[0].bit_length() - 1)
        while step:
            more = f"if(coalesce(get(_cdf, `{f.child}` + {step - 1}) <= _u, false), {step}, 0)"
            out, step = out.withColumn(f.child, F.expr(f"`{f.child}` + {more}")), step // 2
        out = out.withColumn(f.child, F.expr(f"least(`{f.child}`, size(_cdf) - 1)")).drop("_u", "_cdf")
    return out.select(row_key, *attrs)


def synthesize(
    cells: DataFrame, rows: DataFrame, row_key: str, levels: Levels, total: int, epsilon: float, theta: float = 4.0,
    seed: str = "seed", trial: int = 0,
) -> DataFrame:
    """Structure, noisy marginals and sampling with one budget; the cells, read at every step, are counted once."""
    cells = materialize(cells, "cells")
    model = learn_structure(cells, levels, total, epsilon, theta, seed, trial)
    families = noisy_families(cells, model, levels, epsilon, seed, trial)
    return ancestral_sample(rows, row_key, conditionals(families, levels), model, levels, seed, trial)
