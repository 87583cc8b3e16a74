"""The trie against plain prefix sets; deep conversations, ties, odd rows, conversations over many tasks."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellview.llm.conversation_trie import Trie, rebuilt_trie, running

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, b in built.items():
        ends[b].append(c)
        for d in range(len(b) + 1):
            members[b[:d]].add(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()), key=repr
    )


def check(df, rows, plan=Trie()):
    assert sorted((tuple(r) for r in rebuilt_trie(df, plan).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("band", [2, 16])
def test_trie_equals_prefix_sets(spark, band):
    rng = np.random.default_rng(band)
    rows = [(int(c), int(t), "user", f"é{rng.integers(0, 2)}" * int(t + 1)) for c in range(-7, 60) for t in range(rng.integers(1, 14)) if c % 11]
    rows += [(500, t, "user", f"deep {t}") for t in range(70)] + [(501, t, "user", f"deep {t}") for t in range(50)]
    check(spark.createDataFrame(rows, SCHEMA), rows, Trie(band=band))


def test_odd_rows(spark):
    long = "word " * 20_000
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (2, None, "user", long), (3, 1, None, "b"), (3, 1, None, "a"), (3, 1, "x", None), (None, 1, "user", "lost"),
        (4, 5, "user", "z"), (5, 0, "user", "q"), (6, 0, "user", "q"), (10, 0, "user", "q"), (10, 1, "user", "r"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(9)).withColumn("f1", F.lit("x")).withColumn("seq", F.lit(0)).withColumn("pos", F.lit(1))
    check(df, rows)
    assert rebuilt_trie(df.where("false")).count() == 0
    assert rebuilt_trie(df.where("conv_id IS NULL")).count() == 0


def test_running_totals_over_many_tasks(spark):
    """One group that fills several tasks, and batches smaller than a task."""
    rng = np.random.default_rng(4)
    rows = [(int(g), int(i), int(v), int(w)) for i, (g, v, w) in enumerate(zip(rng.choice([1, 2, 2, 2, 2, 2, 3], 3000), rng.integers(0, 99, 3000), rng.integers(-(1 << 63), 1 << 63, 3000), strict=True))]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(keep, ("13", "false", "50"), strict=True):
        spark.conf.set(k, v)
    df = spark.createDataFrame(rows, "g long, i long, v long, w long").repartition(5)
    got = {r.i: (r.v, r.w) for r in running(df, "g", ["i"], {"v": np.add, "w": np.bitwise_xor}, []).collect()}
    for k, v in keep.items():
        spark.conf.set(k, v)
    for g in (1, 2, 3):
        v = w = 0
        for h, i, dv, dw in rows:
            if h == g:
                v, w = v + dv, w ^ dw
                assert got[i] == (v, w)
