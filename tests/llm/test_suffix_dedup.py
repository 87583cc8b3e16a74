"""Removed bytes against all windows of small texts, bucket edges, odd rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellview.llm.suffix_dedup import Repeats, cut, multikey_order, runs, window_minima

PLAN = Repeats(length=60, gram=16, step=8)


def brute(rows, length):
    """[(id, n_bytes, n_removed, spans, sha)] of (id, text) by counting every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def found(spark, rows, plan):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("o1", F.lit("x"))
    return [(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], r.kept_sha256, hashlib.sha256(r.kept).hexdigest()) for r in cut(df, plan).collect()]


def check(spark, rows, plan):
    want = sorted(map(repr, ((*r, r[4]) for r in brute(rows, plan.length))))
    assert sorted(map(repr, found(spark, rows, plan))) == want


def test_pieces():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 500).astype(np.uint64)
    assert (window_minima(v, 7) == [v[i : i + 7].min() for i in range(494)]).all()
    tokens = [rng.integers(0, 3, 1000) for _ in range(4)]
    assert [tuple(t[i] for t in tokens) for i in multikey_order(tokens)] == sorted(zip(*tokens, strict=True))
    assert runs(np.array([5, 0, 20]), np.array([9, 5, 30])) == [(0, 9), (20, 30)]


@pytest.mark.parametrize("bucket", [200_000, 40])
def test_removed_bytes_equal_all_windows(spark, bucket):
    """Copies, edits, overlaps, a passage in many texts, one byte repeated, long common runs cut at many places."""
    rng = np.random.default_rng(7)
    noise = lambda n: "".join(rng.choice(list("abcdefgh éß"), n))
    passage, base = noise(75), noise(900)
    rows = [(i, noise(int(rng.integers(0, 120))) + passage + noise(int(rng.integers(0, 120)))) for i in range(40)]
    for i in range(40, 70):
        at = sorted(rng.integers(0, 900, 2))
        rows.append((i, noise(30) + base[at[0] : at[1]] + noise(int(rng.integers(0, 70))) + base[at[1] :]))
    rows += [(80, "a" * 400), (81, "ab" * 200), (82, base + base), (83, base[:59]), (84, base[100:160]), (85, noise(61) * 3), (85, base)]
    check(spark, rows, Repeats(60, 16, 8, bucket))


def test_odd_rows(spark):
    base = "".join(np.random.default_rng(3).choice(list("xyz "), 300))
    check(spark, [(1, None), (2, ""), (None, base), (None, None), (3, base), (3, base), (4, base[:80] + "!" + base[80:])], PLAN)
    assert cut(spark.createDataFrame([], "doc_id long, text string"), PLAN).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    """A repeat across the border of two hashed pieces, and texts that repeat only themselves."""
    rng = np.random.default_rng(9)
    raw = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common, n = raw(3000), (1 << 20)
    rows = [(1, raw(n - 1500) + common + raw(900_000)), (2, raw(500) + common), (3, raw(4000))]
    got = {r[0]: r[3] for r in found(spark, rows, Repeats())}
    assert got == {1: [(n - 1500, n + 1500)], 2: [(500, 3500)], 3: []}
