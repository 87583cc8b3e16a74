"""Marginals of many attribute sets, each derived from a small counted superset.

A set is a tuple of attribute positions.  The sets of a workload or a model are
metadata (a few integers each), so their order of derivation is planned on the
driver; sets are told apart by their number, so any number of attributes will do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.operators.layout import attach, listed, small_table
from cellview.session import materialize


@dataclass(frozen=True)
class Derivation:
    """One marginal: its number, attribute positions, the number it is derived from (-1: the cells), wanted or a step."""

    number: int
    attrs: tuple[int, ...]
    parent: int
    wanted: bool

    def picks(self, parent: tuple[int, ...]) -> list[int]:
        return [parent.index(a) for a in self.attrs]


def plan_lattice(sets: list[tuple[int, ...]], sizes: list[int]) -> list[list[Derivation]]:
    """Derivations by round: a round reads the marginals of the round before, the first one the cells.

    Sets with common beginnings are merged into a step in between while the grid of their union
    is at most half of all cells, so the cells are read once per merged group, not once per set.
    Every set comes from its smallest counted superset.
    """
    everything = math.prod(sizes)
    grid = lambda s: math.prod(sizes[i] for i in s)
    wanted = {s: k for k, s in enumerate(sets)}
    groups, current = [], None
    for s in sorted(sets):
        union = s if current is None else tuple(sorted({*current, *s}))
        if current is not None and 2 * grid(union) > everything:
            groups.append(current)
            union = s
        current = union
    groups += [current] if current is not None else []
    number = dict(wanted)
    for g in groups:
        number.setdefault(g, len(number))
    roots = set(groups)
    by_size = sorted(number, key=lambda s: (grid(s), s))
    members = {s: set(s) for s in number}
    holders: dict[int, list[tuple[int, ...]]] = {}
    for s in by_size:
        for a in s:
            holders.setdefault(a, []).append(s)
    parent: dict[tuple[int, ...], tuple[int, ...] | None] = {}
    for s in number:
        if s in roots:
            parent[s] = None
            continue
        nearby = min((holders[a] for a in s), key=len) if s else by_size
        parent[s] = next((t for t in nearby if t != s and members[s] < members[t]), None)

    depth: dict[tuple[int, ...], int] = {}

    def level(s) -> int:
        if s not in depth:
            depth[s] = 0 if parent[s] is None else 1 + level(parent[s])
        return depth[s]

    rounds: list[list[Derivation]] = [[] for _ in range(1 + max(map(level, number), default=-1))]
    for s, n in number.items():
        rounds[level(s)].append(Derivation(n, s, -1 if parent[s] is None else number[parent[s]], s in wanted))
    return rounds


def roll_up(cells: DataFrame, sets: list[tuple[int, ...]], sizes: list[int], sums: list[str]) -> DataFrame:
    """``(sid, codes, sums...)`` of every set, ``sid`` its place in ``sets``; cells have all their codes in ``codes``."""
    spark = cells.sparkSession
    added = [F.sum(c).cast("bigint").alias(c) for c in sums]
    rounds = plan_lattice(sets, sizes)
    attrs = {d.number: d.attrs for r in rounds for d in r}
    above, out = cells.withColumn("sid", F.lit(-1)), None
    for k, derived in enumerate(rounds):
        rows = [(d.parent, d.number, list(d.attrs) if d.parent < 0 else d.picks(attrs[d.parent])) for d in derived]
        book = small_table(spark, rows, "sid int, child int, picks array<int>")
        if k:
            spread = attach(above, book, ["sid"], len(rows))
        else:  # every cell is repeated once per first-round set
            sets_of_cell = listed(book.select("child", "picks"), [r[1:] for r in rows], ["child", "picks"], ["int", "array<int>"])
            spread = cells.withColumn("_book", sets_of_cell).select("codes", *sums, F.inline("_book"))
        summed = spread.select(F.col("child").alias("sid"), F.expr("transform(picks, i -> codes[i]) AS codes"), *sums).groupBy("sid", "codes").agg(*added)
        if k + 1 < len(rounds):
            summed = materialize(summed, "marginals")
        above = summed
        steps = [d.number for d in derived if not d.wanted]
        kept = summed.where(~F.col("sid").isin(steps)) if steps else summed
        out = kept if out is None else out.unionByName(kept)
    return out if out is not None else cells.select(F.lit(0).alias("sid"), "codes", *sums).where("false")
