"""Class-based language model against a plain recount of its own classes."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellview.llm import class_lm
from cellview.llm import words as W

PLAN = class_lm.ClassModel(frequent=30, classes=4, local=64)
END = None


def hashes(names):
    return {w: int(next(W.tokens(pa.array([w]))).hash.view(np.int64)[0]) for w in names} | {END: int(np.array([class_lm.END]).view(np.int64)[0])}


@pytest.fixture(scope="module")
def corpus(spark):
    """Two kinds of words take turns; a long tail of rare words stands in for either kind."""
    rng = np.random.default_rng(8)
    first, second = [f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]
    p = 1 / np.arange(1, 151)
    rows = []
    for k in range(300):
        n = int(rng.integers(0, 30))
        rows.append((k, " ".join(str(rng.choice((first, second)[i % 2], p=p / p.sum())) for i in range(n))))
    return spark.createDataFrame([*rows, (300, None), (None, "a1 b1 never-seen-1"), (7, "a1 b2")], "doc_id long, text string")


@pytest.fixture(scope="module")
def fitted(corpus):
    return class_lm.fit(corpus, PLAN)


def sequences(rows):
    return [(r.doc_id, [*(r.text or "").split(), END]) for r in rows]


def held(doc_id):
    return int(W.crc32_of(pa.array([doc_id]))[0]) % 7 == 2


def test_each_sweep_raises_the_likelihood(fitted):
    trace = fitted[0]["trace"]
    assert len(trace) > 2 and all(b > a for a, b in zip(trace, trace[1:], strict=False))


def test_every_training_word_has_a_class(corpus, fitted):
    texts = [s for i, s in sequences(corpus.collect()) if not held(i)]
    count = Counter(w for s in texts for w in s)
    h = hashes(w for w in count if w is not END)
    assert {r.h: r.c for r in fitted[1].collect()} == {h[w]: c for w, c in count.items()}
    assert len(count) > 3 * PLAN.local  # beyond the exchange and beyond what goes to every task


def test_further_words_join_the_likeliest_class():
    rng = np.random.default_rng(3)
    k = 4
    counts = rng.integers(1, 50, (k + 1, k + 1)).astype(float)
    before, behind = (rng.integers(0, 3, (40, k + 1)).astype(float) for _ in range(2))

    def value(r, left, d):
        m = counts.copy()
        m[d] += r
        m[:, d] += left
        return class_lm.likelihood(m)

    got = class_lm._joined_class(before, behind, counts)
    for left, r, d in zip(before, behind, got, strict=True):
        values = [value(r, left, x) for x in range(k)]
        assert values[d] == pytest.approx(max(values))


def test_score_equals_a_recount_by_class(corpus, fitted):
    model, words = fitted
    k, d = PLAN.classes, PLAN.discount
    rows = sequences(corpus.collect())
    h = hashes({w for _, s in rows for w in s if w is not END})
    table = {r.h: (r.c, r.cls) for r in words.collect()}
    cls = {w: table[x][1] for w, x in h.items() if x in table}
    n, v, pairs = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for x, (c, a) in table.items():
        n[a] += c
        v[a] += 1
    for i, s in rows:
        if not held(i):
            for a, b in zip([END, *s], s, strict=False):
                pairs[cls[a], cls[b]] += 1
    share = (n + 1) / (n.sum() + k)
    step = (pairs + k * share) / (pairs.sum(axis=1, keepdims=True) + k)
    freed = (d * v + 1) / (n + 1)
    assert (step.sum(axis=1) == pytest.approx(1)) and (sum((c - d) / (n[a] + 1) for c, a in table.values()) + freed.sum() == pytest.approx(k))
    want = {}
    for i, s in rows:
        total = 0.0
        for a, b in zip([END, *s], s, strict=False):
            p = step[cls.get(a, int(v.argmax()))]
            total += np.log10(p[cls[b]] * (table[h[b]][0] - d) / (n[cls[b]] + 1) if b in cls else (p * freed).sum())
        want.setdefault(i, []).append(total)
    got = class_lm.score(corpus, model, words, PLAN).collect()
    assert len(got) == len(rows) and sum(r.n_tokens - r.n_known for r in got) > 0
    for i, values in want.items():
        assert sorted(r.score for r in got if r.doc_id == i) == pytest.approx(sorted(values))


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(k, "one two") for k in range(40) if held(k)], "doc_id long, text string")
    for table in (docs, docs.limit(0)):
        rows = class_lm.score(table, *class_lm.fit(table)).collect()
        assert all((r.n_known, r.train_tokens, r.score) == (0, 0, 0.0) for r in rows)
