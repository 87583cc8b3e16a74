"""Private selection and weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.operators.layout import running_sum
from cellview.session import materialize


def best_per_group(df: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Row with the largest ``value`` per group; ties go to the smallest ``order``."""
    rank = F.struct(F.col(value), *[(-F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)])
    payload = F.struct(*[c for c in df.columns if c not in group])
    return df.groupBy(*group).agg(F.max_by(payload, rank).alias("_p")).select(*group, "_p.*")


def exponential_mechanism(
    candidates: DataFrame,
    group: list[str],
    identity: list[str],
    score: str,
    epsilon,
    sensitivity,
    key: tuple,
    order: list[str] | None = None,
) -> DataFrame:
    """Pick one candidate per group with weight ``exp(eps * q / (2 * sens))``.

    The arg-max of a Gumbel-perturbed score has exactly that distribution, so
    the pick is one map-side combined ``max_by``.  ``identity`` names the
    columns that make a candidate's noise key unique.  Ties go to the smallest
    numeric ``order`` columns.  All columns of the pick come back, with its
    noisy utility ``z``.
    """
    z = noise.utility(F.col(score), epsilon, sensitivity, *key, *[F.col(c) for c in group + identity])
    return best_per_group(candidates.withColumn("z", z), group, "z", order or [])


def random_cut(frontier: DataFrame, domain: Domain, key: tuple, name: Column | None = None) -> DataFrame:
    """Uniform attribute with more than one code, then a uniform cut of it.

    Row-local: no shuffle.  Blocks of a single cell have no cut and drop out.
    ``name`` is what the draws call a block, its ``block`` column by default.
    """
    name = F.col("block") if name is None else name
    spans = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(a).alias("attr"),
                F.col(f"lo_{a}").alias("lo"),
                F.col(f"hi_{a}").alias("hi"),
            )
            for i, a in enumerate(domain.attrs)
        ]
    )
    open_spans = F.filter(spans, lambda s: s["lo"] < s["hi"])
    chosen = frontier.withColumn("_spans", open_spans).filter(F.size("_spans") > 0)
    pick = F.get("_spans", noise.uniform_int(0, F.size("_spans"), *key, name, "attr"))
    return (
        chosen.withColumn("_s", pick)
        .select(*frontier.columns, "_s.*")
        .withColumn("cut", noise.uniform_int(F.col("lo"), F.col("hi"), *key, name, "cut"))
    )


def clamp_weights(weights: DataFrame, weight: str) -> DataFrame:
    """Negative weights become 0; if none is positive all weigh the same."""
    total = weights.agg(F.coalesce(F.sum(F.greatest(weight, F.lit(0.0))), F.lit(0.0)).alias("t")).scalar()
    return weights.withColumn(
        "_w", F.when(total > 0, F.greatest(F.col(weight), F.lit(0.0))).otherwise(F.lit(1.0)).cast("double")
    )


def shift_weights(weights: DataFrame, weight: str, name: str) -> DataFrame:
    """``(x - min) / sum(x - min)`` over the whole table."""
    facts = weights.agg(F.min(weight).alias("m"), F.sum(weight).alias("s"), F.count(weight).alias("n"))
    low = facts.select("m").scalar()
    mass = facts.select(F.col("s") - F.col("n") * F.col("m")).scalar()
    return weights.withColumn(name, (F.col(weight) - low) / mass)


def weighted_sample(weights: DataFrame, order_by: list[str], weight: str, draws: DataFrame, u: Column) -> DataFrame:
    """One item per row of ``draws``, with replacement, by clamped weight.

    Items stand at the end of their interval of the cumulative weight, draws at
    their own number, both range-partitioned by that place: a draw takes the next
    item after it.  An interval begins where the one before it ends, so every
    draw takes exactly one item.  One row per partition carries the first item
    over to the partitions before it.
    """
    placed = running_sum(clamp_weights(weights, weight), order_by, F.col("_w"), "_hi").filter(F.col("_w") > 0)
    total = placed.agg(F.max("_hi").alias("t")).scalar()
    items = placed.select((F.col("_hi") / total).alias("_at"), F.struct(*weights.columns).alias("_item"))
    thrown = draws.select(u.alias("_at"), F.struct(*draws.columns).alias("_draw"))
    marks = materialize(
        items.unionByName(thrown, allowMissingColumns=True).repartitionByRange("_at").withColumn("_part", F.spark_partition_id()),
        "marks",
    )
    keys = [F.col("_item")[c] for c in order_by]
    # backwards; a draw at the very end of an interval belongs to the next one
    back = Window.partitionBy("_part").orderBy(F.desc("_at"), F.col("_item").isNotNull(), *[k.desc() for k in keys])
    taken = F.last("_item", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min_by("_item", F.when(F.col("_item").isNotNull(), F.struct("_at", *keys)))
    onward = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    carried = marks.groupBy("_part").agg(first.alias("_first")).select(
        "_part", F.first("_first", ignorenulls=True).over(onward).alias("_next")
    )
    return (
        marks.withColumn("_taken", taken).filter(F.col("_draw").isNotNull()).join(carried, "_part")
        .withColumn("_taken", F.coalesce("_taken", "_next")).filter(F.col("_taken").isNotNull())
        .select("_draw.*", "_taken.*")
    )
