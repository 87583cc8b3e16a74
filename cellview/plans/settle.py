"""Small blocks of a tree, grown to their leaves inside one task.

A block with few non-empty cells is cheaper to finish on the spot than to carry
through one job per level.  Spark deals the blocks over tasks; a task sees one
block's cells at a time, at most ``SMALL_CELLS`` of them.  Scores, keyed draws
and rounding are those of the level passes, so the same tree comes out.
"""

from __future__ import annotations

import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellview.domain import Domain

SMALL_CELLS = 2048
COMPARED = 1 << 22  # pairs of cut and cell compared at once


def unit(*key) -> float:
    """The draw of ``noise.unit``."""
    return (int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0


def settle(x: np.ndarray) -> np.ndarray:
    """The rounding of ``noise.settle``: six decimals, halves of the written number away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x) + 0.0
    for i in np.flatnonzero((scaled > 1e15) | (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0
    return out


def laplace(scale: float, *key) -> float:
    x = unit(*key) - 0.5
    return float(settle(np.array([-scale * math.copysign(1.0, x) * math.log(1.0 - 2.0 * abs(x)) if x else 0.0]))[0])


class LocalTree:
    """Grows one block; ``trial`` and the block's name are part of every draw."""

    def __init__(self, domain: Domain, plan, seed: str, max_depth: int | None):
        self.attrs, self.plan, self.seed, self.max_depth = domain.attrs, plan, seed, max_depth
        self.epsilon, self.last_scored = plan.epsilon_cut(domain), plan.last_scored_depth(domain)

    def sides(self, v, code, lo, hi, size, cuts):
        """Totals, sizes and deviations of both sides of cuts of one attribute."""
        order = np.argsort(code, kind="stable")
        v = v[order]
        sums = np.concatenate([[0], np.cumsum(v)])
        left = np.searchsorted(code[order], cuts, "right")
        total = sums[left], sums[-1] - sums[left]
        each = size / float(hi - lo + 1)
        wide = each * (cuts - lo + 1), each * (hi - cuts)
        mean = total[0] / wide[0], total[1] / wide[1]
        above = np.zeros((4, len(cuts)), np.int64)
        place = np.arange(len(v))
        step = max(1, COMPARED // max(1, len(v)))
        for at in range(0, len(cuts), step):
            part = slice(at, at + step)
            before = place[None, :] < left[part, None]
            for s, here in enumerate((before, ~before)):
                hit = here & (v[None, :] > mean[s][part, None])
                above[2 * s, part], above[2 * s + 1, part] = np.where(hit, v[None, :], 0).sum(1), hit.sum(1)
        ae = [2.0 * (above[2 * s] - above[2 * s + 1] * mean[s]) for s in (0, 1)]
        return total, wide, ae

    def pick(self, trial, block, depth, lo, hi, size, codes, v):
        """``pos, cut`` and both sides' total, size and deviation."""
        open_attrs = [i for i in range(len(lo)) if lo[i] < hi[i]]
        if depth > self.last_scored:
            i = open_attrs[math.floor(unit(self.seed, "random-cut", trial, block, "attr") * len(open_attrs))]
            cut = lo[i] + math.floor(unit(self.seed, "random-cut", trial, block, "cut") * (hi[i] - lo[i]))
            return i, cut, *self.sides(v, codes[:, i], lo[i], hi[i], size, np.array([cut])), 0
        best, sensitivity = None, 2.0 * (2.0 - 2.0 / size)
        for i in open_attrs:
            cuts = np.arange(lo[i], hi[i])
            total, wide, ae = self.sides(v, codes[:, i], lo[i], hi[i], size, cuts)
            score = settle(-(ae[0] + ae[1]))
            weight = self.epsilon * score / (2.0 * sensitivity) if sensitivity > 0 else np.zeros(len(cuts))
            draws = np.array([-math.log(-math.log(unit(self.seed, "cut", trial, block, self.attrs[i], c))) for c in cuts.tolist()])
            z = settle(weight + draws)
            k = int(np.argmax(z))
            if best is None or z[k] > best[0]:
                best = z[k], (i, int(cuts[k]), total, wide, ae, k)
        return best[1]

    def stays(self, trial, block, depth, ae, size) -> bool:
        plan = self.plan
        if size <= 1 or (self.max_depth is not None and depth >= self.max_depth):
            return False
        biased = max(ae - plan.depth_discount * depth, plan.threshold + 2 - plan.depth_discount)
        return float(settle(np.array([biased]))[0]) + laplace(plan.stop_scale, self.seed, "stop", trial, block) > plan.threshold

    def leaves(self, trial: int, block: str, depth: int, lo: list[int], hi: list[int], codes: np.ndarray, v: np.ndarray):
        """Rows ``(block, depth, lo, hi, total, ae, size)`` of the leaves below an open block."""
        todo = [(block, depth, lo, hi, codes, v)]
        while todo:
            block, depth, lo, hi, codes, v = todo.pop()
            size = 1.0
            for a, b in zip(lo, hi, strict=True):
                size *= float(b - a + 1)
            i, cut, total, wide, ae, k = self.pick(trial, block, depth, lo, hi, size, codes, v)
            left = codes[:, i] <= cut
            for s, (letter, mine) in enumerate((("L", left), ("R", ~left))):
                low, high = list(lo), list(hi)
                if s:
                    low[i] = cut + 1
                else:
                    high[i] = cut
                name = block + letter
                if self.stays(trial, name, depth + 1, float(ae[s][k]), float(wide[s][k])):
                    todo.append((name, depth + 1, low, high, codes[mine], v[mine]))
                else:
                    yield name, depth + 1, low, high, int(total[s][k]), float(ae[s][k]), float(wide[s][k])


class LocalHalves:
    """Grows one node of a half-split tree.  ``targets`` gives the attributes cut at a depth."""

    def __init__(self, targets, scale: float, discount: float, theta: float, seed: str, max_depth: int | None):
        self.targets, self.scale, self.discount, self.theta = targets, scale, discount, theta
        self.seed, self.max_depth = seed, max_depth

    def leaves(self, trial: int, block: str, depth: int, lo: list[int], hi: list[int], codes: np.ndarray, v: np.ndarray):
        """Rows ``(block, depth, lo, hi, total, size)`` of the leaves at or below a node."""
        todo = [(block, depth, lo, hi, codes, v)]
        while todo:
            block, depth, lo, hi, codes, v = todo.pop()
            size, total = 1.0, int(v.sum())
            for a, b in zip(lo, hi, strict=True):
                size *= float(b - a + 1)
            biased = float(settle(np.array([max(total - self.discount * depth, self.theta - self.discount)]))[0])
            if size <= 1 or depth == self.max_depth or biased + laplace(self.scale, self.seed, "tree", trial, block) <= self.theta:
                yield block, depth, lo, hi, total, size
                continue
            kids = [(block + "/", lo, hi, codes, v)]
            for i in sorted(self.targets(depth)):
                halved = []
                for name, low, high, c, w in kids:
                    if low[i] == high[i]:
                        halved.append((name + "0", low, high, c, w))
                        continue
                    mid = (low[i] + high[i]) // 2
                    left = c[:, i] <= mid
                    halved.append((name + "0", low, [*high[:i], mid, *high[i + 1 :]], c[left], w[left]))
                    halved.append((name + "1", [*low[:i], mid + 1, *low[i + 1 :]], high, c[~left], w[~left]))
                kids = halved
            todo += [(name, depth + 1, low, high, c, w) for name, low, high, c, w in kids]


def _blocks(batches):
    """The rows of one block after the other, from batches sorted by block."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), table.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            part = table.slice(s, e - s)
            if held and held[0].column("block")[0] != part.column("block")[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def settle_blocks(blocks: DataFrame, domain: Domain, tree, totals: str) -> DataFrame:
    """Leaves below blocks, from rows ``(block, depth, lo_*, hi_*, attrs, v)``; ``totals`` lists what ``tree`` adds to a leaf.

    A block is one row with its depth and ranges and null codes, and one row per cell with a null
    depth.  Names are ``trial#path``.
    """
    attrs, ranges = domain.attrs, domain.ranges()
    schema = "block string, depth int, " + ", ".join(f"{r} int" for r in ranges) + ", " + totals
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def grow(batches):
        for table in _blocks(batches):
            flags = table.column("depth").is_valid().to_numpy()
            head = table.filter(pa.array(flags)).slice(0, 1).to_pylist()[0]
            body = table.filter(pa.array(~flags))
            codes = np.stack([body.column(a).to_numpy() for a in attrs], axis=1).astype(np.int64)
            trial, path = head["block"].split("#")
            found = tree.leaves(int(trial), path, head["depth"], [head[f"lo_{a}"] for a in attrs], [head[f"hi_{a}"] for a in attrs], codes, body.column("v").to_numpy().astype(np.int64))
            rows = [(f"{trial}#{b}", d, *[x for pair in zip(lo, hi, strict=True) for x in pair], *more) for b, d, lo, hi, *more in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(grow, schema)
