"""Cleaning steps: thin names over Spark projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellview.operators.layout import attach, number_rows


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip blanks on both sides; all string columns by default."""
    chosen = columns or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.select(*[F.trim(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


def recode(df: DataFrame, column: str, mapping: dict[str, str], otherwise: str | None = None) -> DataFrame:
    """Replace labels; unmapped ones stay, or all become ``otherwise``."""
    out = F.col(column) if otherwise is None else F.lit(otherwise)
    for old, new in mapping.items():
        out = F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def union_parts(*parts: DataFrame) -> DataFrame:
    """Bag union by position, with the first part's names."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.toDF(*out.columns))
    return out


def drop_nulls(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def filter_sentinel(df: DataFrame, columns: list[str], sentinel: str = "?") -> DataFrame:
    """Drop rows holding the sentinel, then read the columns as doubles."""
    for c in columns:
        df = df.filter(F.col(c) != F.lit(sentinel))
    return df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in columns else F.col(c) for c in df.columns])


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, read as UTC."""
    plain = ts.cast("timestamp_ntz")
    day = F.unix_date(plain.cast("date")).cast("bigint") * F.lit(86400)
    return day + F.hour(plain) * F.lit(3600) + F.minute(plain) * F.lit(60) + F.second(plain)


def parse_epoch(text: Column, form: str) -> Column:
    """Text to epoch seconds; the result does not depend on the session zone."""
    return epoch_seconds(F.to_timestamp_ntz(text, F.lit(form)))


def replace_chars(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def fixed6(c: Column) -> Column:
    return F.format_string("%.6f", c.cast("double"))


def rename_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def value_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Dictionary of a column: distinct values in byte order, numbered from 0.

    The numbering runs in parallel, so a column with very many values is fine.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return number_rows(values, [column], code).withColumn(code, F.col(code).cast("int"))


def replace_by_code(df: DataFrame, column: str, codes: DataFrame, code: str, rows: int | None = None) -> DataFrame:
    """Swap a column's values for the codes of a dictionary ``(column, code)``.

    Values the dictionary lacks become null.  The dictionary's size decides
    between a broadcast and a shuffle that deals hot values over many tasks.
    """
    entries = codes.select(F.col(column), F.col(code).alias("_code"))
    joined = attach(df, entries, [column], entries.count() if rows is None else rows, "left")
    return joined.select(*[F.col("_code").alias(c) if c == column else F.col(c) for c in df.columns])


def dense_code(df: DataFrame, column: str) -> DataFrame:
    """Replace a column by the rank of its value."""
    return replace_by_code(df, column, value_codes(df, column, "_rank"), "_rank")
