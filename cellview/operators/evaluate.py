"""Utility of a release: errors against the truth, summaries, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.domain import Domain
from cellview.functions import noise
from cellview.operators.answer import view_range_count
from cellview.operators.cells import answer_ranges
from cellview.session import materialize


def query_errors(estimates: DataFrame, truths: DataFrame) -> DataFrame:
    """Per query: estimate, truth, absolute and squared error."""
    gap = F.col("estimate") - F.col("truth")
    return estimates.join(truths, "query_id").select("*", F.abs(gap).alias("abs_err"), (gap * gap).alias("sq_err"))


def trial_summary(errors: DataFrame, by: list[str], partitions: DataFrame | None = None) -> DataFrame:
    """MAE and RMSE per trial, then mean and population deviation over trials.

    ``partitions`` adds the number of leaves per trial ``(trial, leaves)`` and those of ``by`` that it has.
    """
    per_trial = errors.groupBy(*by, "trial").agg(
        F.avg("abs_err").alias("mae"), F.sqrt(F.avg("sq_err")).alias("rmse")
    )
    aggs = [F.count(F.lit(1)).alias("times")]
    for c in ("mae", "rmse"):
        aggs += [noise.settle(F.avg(c)).alias(c), noise.settle(F.stddev_pop(c)).alias(f"{c}_std")]
    if partitions is not None:
        per_trial = per_trial.join(partitions, [c for c in (*by, "trial") if c in partitions.columns], "left")
        aggs += [
            noise.settle(F.avg("leaves")).alias("leaves"),
            noise.settle(F.stddev_pop("leaves")).alias("leaves_std"),
        ]
    return per_trial.groupBy(*by).agg(*aggs)


def compare_views(views: DataFrame, queries: DataFrame, truths: DataFrame, domain: Domain) -> DataFrame:
    """One result row per method from views tagged ``method`` and ``trial``.

    All methods and trials answer the workload in one job.
    """
    tag = ["method", "trial"]
    stored = materialize(views.select(*tag, *domain.ranges(), "value"), "views")
    errors = query_errors(view_range_count(stored, queries, domain, tag), truths)
    leaves = stored.groupBy(*tag).agg(F.count(F.lit(1)).alias("leaves"))
    return trial_summary(errors, ["method"], leaves)


def compare_on_workloads(views: DataFrame, queries: DataFrame, cells: DataFrame, domain: Domain) -> DataFrame:
    """One result row per workload and method.

    ``queries`` has ``(workload, query_id, attr, lo, hi)``; a query may be in several
    workloads and is answered once.  All workloads, methods and trials are answered in one job.
    """
    tag = ["method", "trial"]
    stored = materialize(views.select(*tag, *domain.ranges(), "value"), "views")
    members = materialize(queries.select("workload", "query_id").distinct(), "members")
    asked = materialize(queries.drop("workload").distinct(), "queries")
    truths = answer_ranges(cells, asked, domain).select("query_id", F.col("total").alias("truth"))
    errors = query_errors(view_range_count(stored, asked, domain, tag), truths).join(members, "query_id")
    leaves = stored.groupBy(*tag).agg(F.count(F.lit(1)).alias("leaves"))
    return trial_summary(errors, ["workload", "method"], leaves)


def analytic_rmse(wide_queries: DataFrame, domain: Domain, epsilon: float, by: list[str]) -> DataFrame:
    """Expected RMSE of the Laplace histogram: variance 2/eps^2 per cell read."""
    per_cell = F.lit(2.0 / epsilon**2)
    return wide_queries.groupBy(*by).agg(
        noise.settle(F.sqrt(per_cell * F.avg(domain.size_column()))).alias("rmse")
    )


def marginal_tables(cells: DataFrame, domain: Domain, k: int) -> DataFrame:
    """All k-way marginals keyed by grouping id, each normalized to sum one."""
    from itertools import combinations

    attrs = domain.attrs
    sets = [[F.col(a) for a in s] for s in combinations(attrs, k)]
    total = cells.agg(F.sum("v").alias("t")).scalar()
    counted = cells.groupingSets(sets, *[F.col(a) for a in attrs]).agg(
        F.sum("v").alias("v"), F.grouping_id().alias("gid")
    )
    return counted.select("gid", *[F.coalesce(a, F.lit(-1)).alias(a) for a in attrs], (F.col("v") / total).alias("_p"))


def kway_distance(true_cells: DataFrame, other_cells: DataFrame, domain: Domain, k: int) -> DataFrame:
    """Mean total variation distance over all k-way marginals (counts >= 0)."""
    keys = ["gid", *domain.attrs]
    a = marginal_tables(true_cells, domain, k)
    b = marginal_tables(other_cells, domain, k).withColumnRenamed("_p", "_q")
    gap = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))
    per_set = a.join(b, keys, "full_outer").groupBy("gid").agg((F.sum(gap) / 2).alias("tvd"))
    return per_set.agg(F.count(F.lit(1)).alias("marginals"), noise.settle(F.avg("tvd")).alias("tvd"))


def model_information(cells: DataFrame, model, levels, total: int) -> DataFrame:
    """Sum over a network's families of their mutual information with the data."""
    from cellview.plans import network as N

    families = N.family_candidates(cells.sparkSession, model, levels)
    rows = len(model) * max(h.sizes[0] for h in levels.values())
    joint = N.leveled_marginals(cells, families, levels)
    return N.information_scores(joint, levels, total, rows).agg(
        F.count(F.lit(1)).alias("families"), noise.settle(F.sum("score")).alias("mutual_info")
    )
