"""Exact splits and samples by a keyed draw per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.functions import noise
from cellview.operators.layout import mark_smallest


def train_test_split(df: DataFrame, key: list[str], seed: str, test_fraction: float = 0.1) -> DataFrame:
    """Add ``part``: exactly ``ceil(fraction * n)`` rows are ``test``."""
    draw = noise.unit(seed, "split", *[F.col(c) for c in key])
    marked = mark_smallest(df, draw, key, lambda n: F.ceil(n * F.lit(test_fraction)), "_test")
    return marked.withColumn("part", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def sample_n(df: DataFrame, n: int, key: list[str], seed: str) -> DataFrame:
    """Exactly ``n`` rows (or all of them) without replacement."""
    draw = noise.unit(seed, "sample", *[F.col(c) for c in key])
    marked = mark_smallest(df, draw, key, lambda total: F.least(total, F.lit(n)), "_in")
    return marked.filter("_in").drop("_in")
