"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Quick queries run three times and report the median; view
builds run once, after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from cellview.catalog.base import LI3, LI5, lineitem_cells, lineitem_codes
from cellview.catalog.networks import NET3, NET5, grid_cells
from cellview.operators import answer as A
from cellview.operators import cells as C
from cellview.operators import workload as W
from cellview.plans import bisection as B
from cellview.plans import dense as D
from cellview.plans import halving as H
from cellview.plans import network as N
from cellview.session import local_session, materialize

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def timed(run, times: int) -> float:
    spent = []
    for _ in range(times):
        start = time.perf_counter()
        drain(run())
        spent.append(time.perf_counter() - start)
    return round(statistics.median(spent), 3)


def main() -> None:
    spark = local_session(CPUS)
    cells3, cells5 = lineitem_cells(spark, SF), lineitem_cells(spark, SF, LI5)
    ids = spark.range(3000).withColumnRenamed("id", "query_id")
    queries = W.random_ranges(ids, LI3, 2, "bench")
    many = W.random_ranges(spark.range(100_000).withColumnRenamed("id", "query_id"), LI3, 2, "bench")
    total = lineitem_codes(spark, SF).count()
    view = materialize(B.published(B.bisection_view(cells3, LI3, seed="warm", max_depth=5), LI3), "bench")
    frontier = C.root_block(cells5, LI5)
    in_root = cells5.withColumn("block", F.lit("0"))
    pairs = N.parent_candidates(spark, ["q", "t"], ["r"], NET3, 1000.0)

    def cut_scores():
        histogram = C.code_histogram(in_root, frontier, LI5)
        return B.score_cuts(C.cut_statistics(histogram, C.candidate_cuts(frontier, LI5), rows=64))

    quick = {
        "count_table": lambda: lineitem_cells(spark, SF, LI5),
        "cut_scores": cut_scores,
        "view_range_count_3000": lambda: A.view_range_count(view, queries, LI3),
        "range_count_cells_3000": lambda: C.answer_ranges(cells3, queries, LI3),
        "range_count_cells_100000": lambda: C.answer_ranges(cells3, many, LI3),
        "answer_prefix_2d": lambda: W.prefix_answers(cells5, LI5, ["q", "d"]),
        "answer_marginals_2way": lambda: W.marginal_answers(cells5, LI5, 2),
        "leveled_marginals": lambda: N.leveled_marginals(grid_cells(spark, SF, NET3), pairs, NET3),
        "laplace_histogram": lambda: D.laplace_histogram(cells5, LI5, 1.0, "bench"),
    }
    builds = {
        "bisect_view": lambda: B.bisection_view(cells3, LI3, seed="bench"),
        "tree_view": lambda: H.halving_view(cells3, LI3, seed="bench"),
        "l1_buckets": lambda: D.l1_buckets(cells3, LI3, 1.0, 0.5, "bench"),
        "bisect_view_ten_trials": lambda: B.bisection_views(cells3, LI3, seed="bench", trials=tuple(range(10))),
        "tree_view_ten_trials": lambda: H.halving_views(cells3, LI3, seed="bench", trials=tuple(range(10))),
        "network_synthesis": lambda: N.synthesize(
            grid_cells(spark, SF, NET3), spark.range(total).withColumnRenamed("id", "rid"), "rid", NET3, total, 1.0, seed="bench"
        ),
        "network_synthesis_5": lambda: N.synthesize(
            grid_cells(spark, SF, NET5), spark.range(total).withColumnRenamed("id", "rid"), "rid", NET5, total, 1.0, seed="bench"
        ),
    }
    times = {}
    for name, run in quick.items():
        drain(run())
        times[name] = timed(run, 3)
    for name, run in builds.items():
        times[name] = timed(run, 1)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
