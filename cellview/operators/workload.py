"""Workloads as query tables, and answers of whole workloads on marginals.

A query is a set of rows ``(query_id, attr, lo, hi)``; both ends are inclusive.
Whole workloads (every prefix, every range) are answered from cumulative sums
of a marginal instead of query by query.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellview.domain import Domain, grid
from cellview.functions import noise
from cellview.operators.layout import running_sum


def attribute_sets(domain: DataFrame, k: int) -> DataFrame:
    """All k-subsets of the attributes of a domain table, in declared order."""
    # the whole schema is one array value: one entry per column
    schema = domain.agg(F.expr("array_sort(collect_list(struct(pos, attr, size))) AS s")).scalar()
    out = domain.selectExpr("pos AS last", "array(attr) AS attrs", "array(size) AS sizes")
    for _ in range(k - 1):
        out = out.withColumn("_all", schema).selectExpr(
            "attrs", "sizes", "inline(filter(_all, x -> x.pos > last)) AS (last, attr, size)"
        ).selectExpr("last", "array_append(attrs, attr) AS attrs", "array_append(sizes, size) AS sizes")
    return out.selectExpr("concat_ws(',', attrs) AS aset", "attrs", "sizes")


def _ranges(domain: DataFrame, k: int, per_attribute: str, upto: str | None = None) -> DataFrame:
    """Product over the k attributes of a set of the ranges of each."""
    out = attribute_sets(domain, k).selectExpr("aset", "attrs", "sizes", "array() AS los", "array() AS his")
    out = out.withColumn("los", F.expr("cast(los AS array<int>)")).withColumn("his", F.expr("cast(his AS array<int>)"))
    for i in range(k):
        out = out.selectExpr("aset", "attrs", "sizes", "los", "his", f"sizes[{i}] AS n")
        out = out.selectExpr("*", per_attribute)
        if i == 0:  # the first attribute's codes spread what the others multiply
            out = out.repartition("aset", out.columns[-1])
        if upto:
            out = out.selectExpr("*", upto)
        out = out.selectExpr("aset", "attrs", "sizes", "array_append(los, lo) AS los", "array_append(his, hi) AS his")
    return out.selectExpr("aset", "attrs", "los", "his")


def all_range_workload(domain: DataFrame, k: int) -> DataFrame:
    """Every ``lo <= hi`` on each attribute of each k-set."""
    return _ranges(domain, k, "explode(sequence(0, n - 1)) AS lo", "explode(sequence(lo, n - 1)) AS hi")


def marginal_workload(domain: DataFrame, k: int, smaller: bool = False) -> DataFrame:
    """Point queries on each k-set; ``smaller`` adds all smaller sets."""
    out = None
    for size in range(1 if smaller else k, k + 1):
        part = _ranges(domain, size, "explode(sequence(0, n - 1)) AS lo", "lo AS hi")
        out = part if out is None else out.unionAll(part)
    return out


def prefix_workload(domain: DataFrame, k: int) -> DataFrame:
    """``[0, x]`` on each attribute of each k-set."""
    return _ranges(domain, k, "explode(sequence(0, n - 1)) AS hi", "0 AS lo")


def to_query_rows(workload: DataFrame) -> DataFrame:
    """``(aset, attrs, los, his)`` to ``(query_id, attr, lo, hi)``."""
    named = workload.selectExpr(
        "concat(aset, ':', concat_ws(',', transform(los, x -> string(x))), ':',"
        " concat_ws(',', transform(his, x -> string(x)))) AS query_id",
        "inline(arrays_zip(attrs, los, his))",
    )
    return named.toDF("query_id", "attr", "lo", "hi")


def unranked(rank: str, domain: Domain, k: int) -> str:
    """SQL list of ``(attr, size)``: the k-set of a rank in the order of ``attribute_sets``.

    The combinatorial number system: walk over the attributes and skip as many sets as
    begin with the attribute at hand, until the rank lies inside.  The plan holds d times k
    numbers, not the sets.
    """
    d = len(domain)
    if not 1 <= k <= d or math.comb(d, k) >= 1 << 31:
        raise ValueError(f"{k} of {d} attributes: no set, or more sets than an int numbers")
    begins = ", ".join("array(" + ", ".join(f"{math.comb(d - p - 1, need - 1)}" for need in range(1, k + 1)) + ")" for p in range(d))
    entries = ", ".join(f"named_struct('attr', '{a}', 'n', {n})" for a, n in domain.sizes.items())
    state = "named_struct('r', {r}, 'need', {need}, 'out', {out})"
    step = (
        f"if(z.need = 0, z, if(z.r < _begins[p][z.need - 1], {state.format(r='z.r', need='z.need - 1', out='array_append(z.out, p)')},"
        f" {state.format(r='z.r - _begins[p][z.need - 1]', need='z.need', out='z.out')}))"
    )
    start = state.format(r=f"int({rank})", need=f"{k}", out="cast(array() AS array<int>)")
    walk = f"aggregate(sequence(0, {d - 1}), {start}, (z, p) -> {step}, z -> z.out)".replace("_begins", f"array({begins})")
    return f"transform({walk}, p -> array({entries})[p])"


def random_ranges(ids: DataFrame, domain: Domain, k: int, seed: str = "0", marginal: bool = False) -> DataFrame:
    """One random query per row of ``ids(query_id)``.

    A uniform k-set; per attribute a uniform length in ``1..n`` and a uniform
    start that fits.  ``marginal`` keeps the start only.
    """
    drawn = ids.withColumn("_set", noise.uniform_int(0, math.comb(len(domain), k), seed, "set", F.col("query_id"))).selectExpr(
        "query_id", f"inline({unranked('_set', domain, k)}) AS (attr, n)"
    )
    sized = drawn.withColumn("_len", noise.uniform_int(1, F.col("n") + 1, seed, "length", F.col("query_id"), F.col("attr")))
    start = noise.uniform_int(0, F.col("n") - F.col("_len") + 1, seed, "start", F.col("query_id"), F.col("attr"))
    return sized.withColumn("lo", start).selectExpr(
        "query_id", "attr", "lo", "lo AS hi" if marginal else "lo + _len - 1 AS hi"
    )


# ------------------------------------------------------- answers of workloads


def dense_marginal(cells: DataFrame, domain: Domain, attrs: list[str], value: str = "v") -> DataFrame:
    """Marginal with its zeros; the grid is the size of the answer."""
    part = domain.keep(attrs)
    sums = cells.groupBy(*attrs).agg(F.sum(value).alias(value))
    zero = F.lit(0).cast(sums.schema[value].dataType)
    return grid(cells.sparkSession, part).drop("idx").join(sums, attrs, "left").withColumn(value, F.coalesce(value, zero))


def prefix_answers(cells: DataFrame, domain: Domain, attrs: list[str], value: str = "v") -> DataFrame:
    """All prefix counts of a marginal: one cumulative window per attribute.

    Each window runs along one attribute only, so it holds at most its codes;
    a single attribute is summed over ranges of its codes in parallel.
    """
    out = dense_marginal(cells, domain, attrs, value)
    if len(attrs) == 1:
        return running_sum(out, attrs, F.col(value), "answer").select(*attrs, "answer")
    for a in attrs:
        line = Window.partitionBy(*[b for b in attrs if b != a]).orderBy(a)
        out = out.withColumn(value, F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.select(*attrs, F.col(value).alias("answer"))


def range_differences(table: DataFrame, attr: str, n: int, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Prefix sums along one attribute to all its ranges: every code lists the ends that a range starting
    after it may have, and the table joins on that end."""
    zero = F.lit(0).cast(table.schema["answer"].dataType)
    starts = table.select(*keys, (F.col(attr) + 1).alias(lo), F.col("answer").alias("_before")).filter(F.col(lo) < n)
    zeros = table.filter(F.col(attr) == 0).select(*keys, F.lit(0).alias(lo), zero.alias("_before"))
    ranges = starts.unionAll(zeros).withColumn(hi, F.expr(f"explode(sequence({lo}, {n - 1}))"))
    return ranges.join(table.withColumnRenamed(attr, hi), [*keys, hi]).select(*keys, lo, hi, (F.col("answer") - F.col("_before")).alias("answer"))


def all_range_answers_k(cells: DataFrame, domain: Domain, attrs: list[str], value: str = "v") -> DataFrame:
    """All range counts of any number of attributes: differences of prefixes, one attribute after the other.

    Returns ``lo_1, hi_1, .. lo_k, hi_k, answer``.  ``cells`` may be cells or a released marginal
    over ``attrs`` with its counts in ``value``.
    """
    out, done = prefix_answers(cells, domain, attrs, value), []
    for i, a in enumerate(attrs, 1):
        out = range_differences(out, a, domain[a], [*attrs[i:], *done], f"lo_{i}", f"hi_{i}")
        done += [f"lo_{i}", f"hi_{i}"]
    return out.select(*done, "answer")


def all_range_answers(cells: DataFrame, domain: Domain, attr: str, value: str = "v") -> DataFrame:
    """All range counts of one attribute, as ``lo, hi, answer``."""
    return all_range_answers_k(cells, domain, [attr], value).toDF("lo", "hi", "answer")


def all_range_answers_2d(cells: DataFrame, domain: Domain, first: str, second: str, value: str = "v") -> DataFrame:
    """All range counts of two attributes."""
    return all_range_answers_k(cells, domain, [first, second], value)


def marginal_answers(cells: DataFrame, domain: Domain, k: int, value: str = "v") -> DataFrame:
    """All k-way marginals in one grouping-sets pass; absent attributes are -1."""
    attrs = domain.attrs
    sets = [[F.col(a) for a in s] for s in combinations(attrs, k)]
    sums = cells.groupingSets(sets, *[F.col(a) for a in attrs]).agg(F.sum(value).alias("answer"))
    return sums.select(*[F.coalesce(a, F.lit(-1)).alias(a) for a in attrs], "answer")
