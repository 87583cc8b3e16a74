"""Domain derivation, discretization, grids and taxonomies.

Fitting reads bounds and categories from the data and is therefore not private;
declare a public domain where that matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.operators.clean import replace_by_code, value_codes

TEXT = {"string", "boolean"}
WHOLE = {"byte", "short", "integer", "long"}


@dataclass(frozen=True)
class Fitted:
    """What one pass over the table learned about a column."""

    attr: str
    kind: str  # category | offset | width
    low: float | None
    high: float | None
    size: int


def fit(df: DataFrame, limit: int) -> list[Fitted]:
    """Kind, bounds and cardinality of every column, in one aggregation.

    Text and booleans are categories; whole numbers with a span within
    ``limit`` keep one code per value; everything else gets ``limit`` bins.
    One row returns to the driver.
    """
    aggs = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in TEXT:
            aggs.append(F.count_distinct(f.name).alias(f"n_{f.name}"))
        else:
            aggs += [F.min(f.name).alias(f"lo_{f.name}"), F.max(f.name).alias(f"hi_{f.name}")]
    facts, out = df.agg(*aggs).collect()[0], []
    for f in df.schema:
        kind, c = f.dataType.typeName(), f.name
        if kind in TEXT:
            out.append(Fitted(c, "category", None, None, int(facts[f"n_{c}"])))
            continue
        lo, hi = facts[f"lo_{c}"], facts[f"hi_{c}"]
        if kind in WHOLE and hi - lo <= limit:
            out.append(Fitted(c, "offset", lo, hi, int(hi - lo) + 1))
        else:
            out.append(Fitted(c, "width", lo, hi, limit))
    return out


def fitted_domain(fits: list[Fitted]) -> Domain:
    return Domain({f.attr: f.size for f in fits})


def fit_domain(df: DataFrame, limit: int) -> DataFrame:
    """The fitted domain as rows ``(attr, kind, size)``, all on Spark."""
    aggs, rows = [], []
    for f in df.schema:
        kind, c = f.dataType.typeName(), f.name
        if kind in TEXT:
            aggs.append(F.count_distinct(c).alias(f"n_{c}"))
            rows.append(f"'{c}', 'category', n_{c}")
        elif kind in WHOLE:
            aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
            span = f"hi_{c} - lo_{c}"
            rows.append(
                f"'{c}', if({span} <= {limit}, 'offset', 'width'), if({span} <= {limit}, bigint({span}) + 1, {limit}L)"
            )
        else:
            rows.append(f"'{c}', 'width', {limit}L")
            aggs.append(F.count(F.lit(1)).alias(f"c_{c}"))
    return df.agg(*aggs).selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (attr, kind, size)")


def offset_code(c: Column, low) -> Column:
    return (c - F.lit(low)).cast("int")


def width_code(c: Column, low, high, limit: int) -> Column:
    """Equal-width bin; the 0.1 keeps the maximum inside the last bin."""
    return F.floor(F.lit(float(limit)) * (c - F.lit(low)) / (F.lit(high) + F.lit(0.1) - F.lit(low))).cast("int")


def apply_codes(df: DataFrame, fits: list[Fitted], source: DataFrame) -> DataFrame:
    """Encode ``df`` with bounds fitted on ``source``.

    Numbers outside the fitted bounds are clamped; unseen categories are null.
    """
    cols, out = [], df
    for f in fits:
        c = F.col(f.attr)
        if f.kind == "category":
            out = replace_by_code(out, f.attr, value_codes(source, f.attr, "_rank"), "_rank", f.size)
            cols.append(c)
            continue
        code = offset_code(c, f.low) if f.kind == "offset" else width_code(c, f.low, f.high, f.size)
        cols.append(F.greatest(F.lit(0), F.least(code, F.lit(f.size - 1))).alias(f.attr))
    return out.select(*[x for x in df.columns if x not in {f.attr for f in fits}], *cols)


def discretize(df: DataFrame, limit: int) -> tuple[DataFrame, Domain]:
    fits = fit(df, limit)
    return apply_codes(df, fits, df), fitted_domain(fits)


# ------------------------------------------------------------- numeric grids

GRID_DEPTH = 4
GRID_NUDGE = 1e-8  # fixed value: keeps the maximum inside the last grid cell


def grid_step(low: float, high: float, depth: int = GRID_DEPTH) -> float:
    return (high - low) / 2**depth


def encode_grid(c: Column, low: float, high: float, depth: int = GRID_DEPTH) -> Column:
    """Code on a grid of ``2**depth`` cells, clamped to the declared bounds."""
    raw = F.floor((c - F.lit(float(low))) / F.lit(grid_step(low, high, depth) + GRID_NUDGE))
    return F.greatest(F.lit(0), F.least(raw, F.lit(2**depth - 1))).cast("int")


def decode_grid(code: Column, low: float, high: float, depth: int = GRID_DEPTH) -> Column:
    """Midpoint of the grid cell."""
    return (code + F.lit(0.5)) * F.lit(grid_step(low, high, depth)) + F.lit(float(low))


def generalize_grid(code: Column, lvl: int) -> Column:
    return F.shiftright(code, lvl)


def specialize_grid(code: Column, lvl: int) -> tuple[Column, Column]:
    """Half-open range of level-0 codes below a level-``lvl`` code."""
    return F.shiftleft(code, lvl), F.shiftleft(code + F.lit(1), lvl)


# --------------------------------------------------------------- taxonomies
# A taxonomy is a table (value, code, lvl, segment): the leaf code of a value in
# declared order and, per level, the segment that holds it.


def _swap(df: DataFrame, column: str, taxonomy: DataFrame, lvl: int, old: str, new: str) -> DataFrame:
    entries = taxonomy.filter(F.col("lvl") == lvl).select(F.col(old).alias(column), F.col(new).alias("_new"))
    return replace_by_code(df, column, entries, "_new")


def encode_taxonomy(df: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    """Replace values by leaf codes; undeclared values become null."""
    return _swap(df, column, taxonomy, 0, "value", "code")


def decode_taxonomy(df: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    return _swap(df, column, taxonomy, 0, "code", "value")


def generalize_taxonomy(df: DataFrame, column: str, lvl: int, taxonomy: DataFrame) -> DataFrame:
    return _swap(df, column, taxonomy, lvl, "code", "segment")


def specialize_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Half-open leaf range of every segment at every level."""
    return taxonomy.groupBy("lvl", "segment").agg(
        F.min("code").alias("first"), (F.max("code") + F.lit(1)).alias("past")
    )
