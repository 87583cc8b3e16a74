"""Registry, table access, coded fixtures and the SQL twins of keyed draws."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellview.domain import Domain


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        if name in REGISTRY:
            raise ValueError(f"registered twice: {name}")
        REGISTRY[name] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------- fixtures

LI5 = Domain({"q": 50, "d": 11, "r": 3, "t": 9, "s": 2})
LI3 = LI5.keep(["q", "d", "r"])
KEYS = ["l_orderkey", "l_linenumber"]

LI_SQL = """li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) - 1 AS q,
  CAST(round(l_discount * 100) AS INTEGER) AS d,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS r,
  CAST(round(l_tax * 100) AS INTEGER) AS t,
  CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS s FROM lineitem)"""


def lineitem_codes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem under its declared domain (quantity, discount, flag, tax, status)."""
    return table(spark, sf, "lineitem").selectExpr(
        *KEYS,
        "int(l_quantity) - 1 AS q",
        "int(round(l_discount * 100)) AS d",
        "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS r",
        "int(round(l_tax * 100)) AS t",
        "CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS s",
    )


def lineitem_cells(spark: SparkSession, sf: str, domain: Domain = LI3) -> DataFrame:
    from cellview.operators.cells import count_table

    return count_table(lineitem_codes(spark, sf), domain)


def cells_sql(domain: Domain = LI3, name: str = "cells") -> str:
    """CTEs ``li`` and the count table ``name``."""
    cols = ", ".join(domain.attrs)
    return f"{LI_SQL}, {name} AS (SELECT {cols}, count(*) AS v FROM li GROUP BY {cols})"


def size_sql(domain: Domain, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return " * ".join(f"CAST({p}hi_{a} - {p}lo_{a} + 1 AS DOUBLE)" for a in domain.attrs)


def inside_sql(domain: Domain, cell: str, box: str) -> str:
    return " AND ".join(f"{cell}.{a} BETWEEN {box}.lo_{a} AND {box}.hi_{a}" for a in domain.attrs)


# fixed queries on (q, d, r): (id, attr, lo, hi)
Q10 = [
    ("q01", "q", 0, 24), ("q02", "q", 10, 19), ("q02", "d", 0, 4), ("q03", "d", 5, 5), ("q04", "r", 1, 1),
    ("q05", "q", 40, 49), ("q05", "d", 8, 10), ("q05", "r", 2, 2), ("q06", None, None, None),
    ("q07", "q", 30, 60), ("q08", "q", 20, 10), ("q09", "d", 11, 15), ("q10", "q", 0, 0), ("q10", "r", 0, 1),
]
Q10_SQL = "qs(query_id, attr, lo, hi) AS (VALUES " + ", ".join(
    f"('{i}', {repr(a) if a else 'NULL'}, {'NULL' if lo is None else lo}, {'NULL' if hi is None else hi})"
    for i, a, lo, hi in Q10
) + ")"


def fixed_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(Q10, "query_id string, attr string, lo int, hi int")


def wide_sql(domain: Domain, source: str = "qs", name: str = "wq") -> str:
    """CTE of one row per query with clipped ranges of every attribute."""
    cols = []
    for a, n in domain.sizes.items():
        lo = f"coalesce(max(CASE WHEN attr = '{a}' THEN greatest(lo, 0) END), 0)"
        hi = f"coalesce(min(CASE WHEN attr = '{a}' THEN least(hi, {n - 1}) END), {n - 1})"
        cols += [
            f"CASE WHEN {lo} > {hi} THEN 0 ELSE {lo} END AS lo_{a}",
            f"CASE WHEN {lo} > {hi} THEN -1 ELSE {hi} END AS hi_{a}",
        ]
    return f"{name} AS (SELECT query_id, {', '.join(cols)} FROM {source} GROUP BY query_id)"


# ------------------------------------------------- SQL twins of keyed columns


def U(*parts: str) -> str:
    """Keyed uniform; parts are SQL expressions."""
    key = f"concat_ws('|', {', '.join(parts)})"
    return f"((CAST(CAST('0x' || substr(sha256({key}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def settle(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0::DOUBLE)"


def laplace(scale: float, *parts: str) -> str:
    x = f"({U(*parts)} - 0.5::DOUBLE)"
    return settle(f"-({scale!r}::DOUBLE) * sign({x}) * ln(1::DOUBLE - 2::DOUBLE * abs({x}))")


def gumbel(*parts: str) -> str:
    return f"(-ln(-ln({U(*parts)})))"


def uniform_int(low: str, high: str, *parts: str) -> str:
    return f"CAST({low} + floor({U(*parts)} * ({high} - ({low}))) AS INTEGER)"


def utility(score: str, epsilon: float, sensitivity: str, *parts: str) -> str:
    return settle(
        f"CASE WHEN ({sensitivity}) > 0 THEN {epsilon!r}::DOUBLE * {score} / (2::DOUBLE * ({sensitivity})) ELSE 0::DOUBLE END"
        f" + {gumbel(*parts)}"
    )


def random_ranges_sql(ids: str, domain: Domain, k: int, seed: str, marginal: bool = False, name: str = "qs") -> str:
    """CTEs down to ``name(query_id, attr, lo, hi)``; ``ids`` selects query_id."""
    sets = list(combinations(domain.attrs, k))
    rows = ", ".join(f"({i}, '{a}', {domain[a]})" for i, s in enumerate(sets) for a in s)
    hi = "lo" if marginal else "lo + len - 1"
    return f"""{name}_sets(sid, attr, n) AS (VALUES {rows}),
{name}_ids AS ({ids}),
{name}_drawn AS (SELECT query_id, {uniform_int('0', str(len(sets)), f"'{seed}'", "'set'", 'query_id')} AS sid FROM {name}_ids),
{name}_sized AS (SELECT query_id, attr, n, {uniform_int('1', 'n + 1', f"'{seed}'", "'length'", 'query_id', 'attr')} AS len
  FROM {name}_drawn JOIN {name}_sets USING (sid)),
{name}_start AS (SELECT *, {uniform_int('0', 'n - len + 1', f"'{seed}'", "'start'", 'query_id', 'attr')} AS lo FROM {name}_sized),
{name} AS (SELECT query_id, attr, lo, {hi} AS hi FROM {name}_start)"""


def rounded(df: DataFrame, *columns: str, digits: int = 3) -> DataFrame:
    """Round summed estimates, whose last digits depend on the order of addition."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---------------------------------------------------- boxes that tile li (q,d)

BOX_SQL = f"""boxes AS (SELECT (q // 7) * 7 AS lo_q, least((q // 7) * 7 + 6, 49) AS hi_q,
  (d // 4) * 4 AS lo_d, least((d // 4) * 4 + 3, 10) AS hi_d, r AS lo_r, r AS hi_r, sum(v) AS tot
  FROM cells GROUP BY ALL),
view AS (SELECT *, round(tot / ({size_sql(LI3)}), 6) AS value FROM boxes)"""


def tiled_view(spark: SparkSession, sf: str) -> DataFrame:
    """A noise-free view of boxes 7 x 4 x 1 over (q, d, r), derived from lineitem."""
    boxes = (
        lineitem_cells(spark, sf)
        .selectExpr("(q div 7) * 7 AS bq", "(d div 4) * 4 AS bd", "r AS br", "v")
        .groupBy("bq", "bd", "br").agg(F.sum("v").alias("tot"))
        .selectExpr(
            "int(bq) AS lo_q", "int(least(bq + 6, 49)) AS hi_q", "int(bd) AS lo_d", "int(least(bd + 3, 10)) AS hi_d",
            "br AS lo_r", "br AS hi_r", "tot",
        )
    )
    return boxes.withColumn("value", F.round(F.col("tot") / LI3.size_column(), 6))
