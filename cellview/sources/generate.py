"""Synthetic tables and cells, one keyed draw per row and attribute.

Generators take the frame of row keys, so the caller decides how many rows
there are and Spark how they are spread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.sources.sampling import sample_n
from cellview.operators.layout import attach, number_rows


@dataclass(frozen=True)
class Spec:
    """How to draw one attribute."""

    cardinality: int
    dist: str = "uniform"  # uniform | geometric | gauss
    p: float = 0.05
    shuffle: bool = False


def uniform_codes(rows: DataFrame, key: list[str], domain: Domain, seed: str) -> DataFrame:
    parts = [F.col(c) for c in key]
    return rows.select(
        *key, *[noise.uniform_int(0, n, seed, "uniform", a, *parts).alias(a) for a, n in domain.sizes.items()]
    )


def raw_draw(spec: Spec, seed: str, attr: str, parts: list[Column]) -> Column:
    if spec.dist == "geometric":
        return (noise.geometric(spec.p, seed, "geometric", attr, *parts) + F.lit(1)).cast("double")
    if spec.dist == "gauss":
        return noise.gaussian(0.0, 1.0, seed, "gauss", attr, *parts)
    if spec.dist == "uniform":
        return noise.uniform_int(0, spec.cardinality, seed, "uniform", attr, *parts).cast("double")
    raise ValueError(f"unknown distribution: {spec.dist}")


def edge_code(x: Column, low: Column, high: Column, n: int) -> Column:
    """Number of the last of ``n`` even edges from ``low`` to ``high`` at or below x."""
    if n == 1:
        return F.lit(0)
    width = (high - low) / F.lit(float(n - 1))
    spot = F.when(high > low, F.floor(F.round((x - low) / width, 9))).otherwise(F.lit(n - 1))
    return F.greatest(F.lit(0), F.least(spot, F.lit(n - 1))).cast("int")


def permutation(spark, attr: str, n: int, seed: str) -> DataFrame:
    """Random relabeling ``(code, other)`` of the codes of one attribute: ranks of keyed draws."""
    drawn = spark.range(n).select(F.col("id").cast("int").alias("code")).withColumn(
        "_u", noise.unit(seed, "permute", attr, F.col("code"))
    )
    return number_rows(drawn, ["_u", "code"], "other").select("code", F.col("other").cast("int").alias("other"))


def permute_codes(df: DataFrame, attr: str, n: int, seed: str) -> DataFrame:
    labels = permutation(df.sparkSession, attr, n, seed).withColumnRenamed("code", attr)
    moved = attach(df, labels, [attr], n, "left")
    return moved.select(*[F.col("other").alias(c) if c == attr else F.col(c) for c in df.columns])


def generate_table(rows: DataFrame, key: list[str], schema: dict[str, Spec], seed: str) -> DataFrame:
    """Independent attributes; non-uniform draws are binned between their extremes."""
    parts = [F.col(c) for c in key]
    raw = rows.select(*key, *[raw_draw(s, seed, a, parts).alias(a) for a, s in schema.items()])
    binned = [a for a, s in schema.items() if s.dist != "uniform"]
    bounds = {}
    if binned:
        # one row of extremes, used as scalars; draws are keyed, so both reads agree
        facts = raw.agg(*[f(a).alias(f"{n}_{a}") for a in binned for n, f in (("lo", F.min), ("hi", F.max))])
        bounds = {c: facts.select(c).scalar() for c in facts.columns}
    cols = []
    for a, s in schema.items():
        if s.dist == "uniform":
            cols.append(F.col(a).cast("int").alias(a))
        else:
            cols.append(edge_code(F.col(a), bounds[f"lo_{a}"], bounds[f"hi_{a}"], s.cardinality).alias(a))
    out = raw.select(*key, *cols)
    for a, s in schema.items():
        if s.shuffle:
            out = permute_codes(out, a, s.cardinality, seed)
    return out


def sequential_cells(spark, domain: Domain, n: int) -> DataFrame:
    """The first ``n`` cells in row-major order, any radix per attribute."""
    if n > domain.cells():
        raise ValueError("more cells than the domain has")
    out, rest = spark.range(n).withColumnRenamed("id", "idx"), domain.cells()
    for a, size in domain.sizes.items():
        rest //= size
        # a place value beyond 64 bits is beyond any index, so its digit is 0
        digit = f"cast((idx div {rest}L) % {size} as int)" if rest < 2**62 else "0"
        out = out.withColumn(a, F.expr(digit))
    return out


def first_tries(n: int, total: int) -> int:
    """Draws that most likely hold ``n`` distinct of ``total`` equal cells."""
    taken = min(n / total, 1.0 - 0.5 / total)
    missing = math.log1p(-taken) if taken < 1.0 else math.log(0.5) - math.log(total)
    return int(-1.5 * total * missing) + 64


def random_cells(spark, domain: Domain, n: int, seed: str) -> DataFrame:
    """Exactly ``n`` distinct uniform cells.

    Draws come in rounds of growing size until enough distinct cells exist; the
    surplus is cut by the order of first draw, so the result is reproducible.
    """
    from cellview.session import materialize

    if n > domain.cells():
        raise ValueError("more cells than the domain has")
    tries = first_tries(n, domain.cells())
    while True:
        drawn = spark.range(tries).select(
            "id", *[noise.uniform_int(0, s, seed, "cell", a, F.col("id")).alias(a) for a, s in domain.sizes.items()]
        )
        distinct = materialize(drawn.groupBy(*domain.attrs).agg(F.min("id").alias("first")), "cells")
        if distinct.count() >= n:
            break
        tries *= 2
    # first draws are distinct numbers below `tries`, so their order is a bounded histogram
    from cellview.operators.layout import mark_smallest

    spot = F.col("first") / F.lit(float(tries))
    picked = mark_smallest(distinct, spot, ["first"], lambda m: F.least(m, F.lit(n)), "_in")
    return picked.filter("_in").select(*domain.attrs)


def sparse_cells(draws: DataFrame, key: list[str], domain: Domain, rate: float, p: float, seed: str) -> DataFrame:
    """Count table with a fraction ``rate`` of its cells filled, summing to the number of ``draws`` rows.

    Every filled cell counts one to begin with; the rest of the rows, an exact
    sample, draw geometric numbers, whose histogram in as many even bins is
    added.  Cells are the first in row-major order.
    """
    cells, size = int(domain.cells() * rate), draws.count()
    if not 1 <= cells <= size:
        raise ValueError(f"{size} rows cannot fill {cells} cells")
    draws = sample_n(draws.select(*key), size - cells, key, seed)
    parts = [F.col(c) for c in key]
    x = draws.select(noise.geometric(p, seed, "sparse", *parts).alias("x"))
    low = x.agg(F.min("x")).scalar()
    high = x.agg(F.max("x")).scalar()
    width = (high - low) / F.lit(float(cells))
    spot = F.when(high > low, F.floor(F.round((F.col("x") - low) / width, 9))).otherwise(F.lit(0))
    bins = x.select(F.least(spot, F.lit(cells - 1)).cast("bigint").alias("idx")).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n")
    )
    return sequential_cells(draws.sparkSession, domain, cells).join(bins, "idx", "left").select(
        *domain.attrs, F.expr("coalesce(n, 0L) + 1 AS v")
    )


def sparsity(records: DataFrame, domain: Domain) -> DataFrame:
    """Distinct cells over domain size."""
    return records.select(*domain.attrs).distinct().agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) / F.lit(float(domain.cells()))).alias("rate")
    )
