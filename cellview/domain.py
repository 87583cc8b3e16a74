"""Declared domain: ordered attributes and their number of codes.

A domain is schema metadata (one entry per column), so it lives on the driver.
The codes of an attribute of size n are 0 .. n-1.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    sizes: dict[str, int]

    def __post_init__(self):
        bad = [a for a, n in self.sizes.items() if n < 1]
        if bad:
            raise ValueError(f"attributes without codes: {bad}")

    @property
    def attrs(self) -> list[str]:
        return list(self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, attr: str) -> int:
        return self.sizes[attr]

    def cells(self) -> int:
        """Number of cells of the full grid (exact, any size)."""
        return math.prod(self.sizes.values())

    def keep(self, attrs) -> "Domain":
        return Domain({a: self.sizes[a] for a in attrs})

    def drop(self, attrs) -> "Domain":
        return Domain({a: n for a, n in self.sizes.items() if a not in set(attrs)})

    def merge(self, other: "Domain") -> "Domain":
        """Union of attributes, this side first."""
        clash = [a for a in self.sizes if a in other.sizes and self.sizes[a] != other.sizes[a]]
        if clash:
            raise ValueError(f"attributes of different size: {clash}")
        return Domain({**self.sizes, **other.sizes})

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a, i, n) for i, (a, n) in enumerate(self.sizes.items())]
        return spark.createDataFrame(rows, "attr string, pos int, size int")

    def to_json(self) -> str:
        return json.dumps(self.sizes)

    @staticmethod
    def from_json(text: str) -> "Domain":
        return Domain({a: int(n) for a, n in json.loads(text).items()})

    @staticmethod
    def from_frame(frame: DataFrame) -> "Domain":
        """From ``(attr, pos, size)``; one row per column, so it fits the driver."""
        rows = frame.select("attr", "pos", "size").orderBy("pos").collect()
        return Domain({r.attr: int(r["size"]) for r in rows})

    def size_column(self) -> Column:
        """Cells of a block given by ``lo_*``/``hi_*`` columns, as a double."""
        out = F.lit(1.0)
        for a in self.attrs:
            out = out * (F.col(f"hi_{a}") - F.col(f"lo_{a}") + F.lit(1)).cast("double")
        return out

    def ranges(self) -> list[str]:
        return [c for a in self.attrs for c in (f"lo_{a}", f"hi_{a}")]


GRID_LIMIT = 1 << 31


def require_dense(domain: Domain, limit: int | None = GRID_LIMIT) -> None:
    """Dense releases list every cell, so their grid must stay bounded, unless ``limit`` is None."""
    if limit is not None and domain.cells() > limit:
        raise ValueError(f"a dense grid of {domain.cells()} cells is over the limit of {limit}")


def grid(spark: SparkSession, domain: Domain, limit: int | None = GRID_LIMIT) -> DataFrame:
    """All cells of the domain with their row-major index ``idx``.

    Built from one distributed range by mixed-radix digits, not by cross joins.
    """
    require_dense(domain, limit)
    total = domain.cells()
    out, rest = spark.range(total).withColumnRenamed("id", "idx"), total
    for a, n in domain.sizes.items():
        rest //= n
        out = out.withColumn(a, F.expr(f"cast((idx div {rest}) % {n} as int)"))
    return out


def flat_index(domain: Domain) -> Column:
    """Row-major index of a cell, as a bigint."""
    out = F.lit(0).cast("bigint")
    for a, n in domain.sizes.items():
        out = out * F.lit(n) + F.col(a)
    return out
