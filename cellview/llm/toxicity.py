"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features: presence of words (value 1), word pairs and pairs with one or two words between
(value ``pair_value``), hashed to one half of ``2 ** bits`` indices each; words are runs of
letters and digits, A-Z lower-cased.
FTRL-proximal keeps a learning rate per coordinate and zeroes weights by its L1 term.

Learning: about ``sample`` labelled documents, drawn by a hash of the doc_id at the
rate sample / labelled rows, dealt over tasks of ``shard_rows``; each runs ``epochs`` passes over
its share and gives its non-zero weights, which are averaged.  Weights are at most
``2 ** bits`` numbers (4 MB), whatever the corpus, and are broadcast.

Defined results: empty and null texts get the score of the bias alone; labels that are
null or contradict each other are not learnt from (contradicting rows: a document counts as toxic if
any of its labels says so); without labels the score is 0.5 less a little and predicted 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm import words as W
from cellview.llm.common import fold_of, store, text_batches


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    sample: int = 24_000
    shard_rows: int = 6_000
    epochs: int = 6
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    pair_value: float = 0.3
    folds: int = 5
    held_out: int = 0


def _features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: rows, feature index and text of each feature occurrence."""
    shift, half = np.uint64(65 - bits), np.uint64(1 << (bits - 1))
    for t in W.tokens(column, W.PUNCTUATION):
        owner, h = t.owner(), t.hash
        index, owners = [h >> shift], [owner]
        for gap in (1, 2, 3):
            pair = W.mix(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] ^ np.uint64(gap)))
            inside = owner[:-gap] == owner[gap:]
            index.append((half + (pair >> shift))[inside])
            owners.append(owner[:-gap][inside])
        yield t.first, t.last, np.concatenate(index).astype(np.int64), np.concatenate(owners)


def _values(plan: Ftrl) -> np.ndarray:
    value = np.ones((1 << plan.bits) + 1)
    value[1 << (plan.bits - 1) : -1] = plan.pair_value
    return value


def learn(labelled: DataFrame, plan: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights by index (times the feature's value) and bias; ``labelled``: text, toxic, draw (hash)."""

    def fit(_, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw", ignore_index=True)
        examples: list[np.ndarray] = []
        for first, last, index, owner in _features(pa.array(rows["text"], pa.string()), plan.bits):
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(1, last - first))
            examples += [np.unique(x).astype(np.int32) for x in np.split(index[order], cuts)]
        y = rows["toxic"].to_numpy()
        z, n = np.zeros((1 << plan.bits) + 1), np.zeros((1 << plan.bits) + 1)
        value = _values(plan)
        bias = np.array([1 << plan.bits], dtype=np.int32)

        def weights(i):
            zi = z[i]
            w = -(zi - np.sign(zi) * plan.l1) / ((plan.beta + np.sqrt(n[i])) / plan.alpha + plan.l2)
            return np.where(np.abs(zi) <= plan.l1, 0.0, w)

        for _ in range(plan.epochs):
            for x, label in zip(examples, y, strict=True):
                i = np.concatenate([x, bias])
                w = weights(i)
                v = value[i]
                g = (1 / (1 + np.exp(-np.clip((w * v).sum(), -35, 35))) - label) * v
                root = np.sqrt(n[i] + g * g)
                z[i] += g - (root - np.sqrt(n[i])) / plan.alpha * w
                n[i] += g * g
        every = np.flatnonzero(n)
        w = weights(every) * value[every]
        return pd.DataFrame({"i": every[w != 0], "w": w[w != 0]})

    shards = max(1, -(-labelled.count() // plan.shard_rows))
    fitted = labelled.withColumn("shard", F.pmod(F.shiftright("draw", 32), F.lit(shards))).groupBy("shard").applyInPandas(fit, "i int, w double")
    w = np.zeros((1 << plan.bits) + 1)
    for r in fitted.groupBy("i").agg((F.sum("w") / shards).alias("w")).toPandas().itertuples():
        w[r.i] = r.w
    if not w.any():
        w[-1] = -1e-6  # nothing learnt: nothing is called toxic
    return w[:-1].astype(np.float32), float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], plan: Ftrl, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        w, bias = shared.value
        for batch in batches:
            for first, last, index, owner in _features(batch.column("text_"), plan.bits):
                live = np.flatnonzero(w[index])
                pairs = np.unique(owner[live] << plan.bits | index[live])  # presence: once per text
                margin = np.bincount(pairs >> plan.bits, weights=w[pairs & ((1 << plan.bits) - 1)], minlength=last - first) + bias
                p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                kept = [batch.column(c)[first:last] for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return text_batches(docs).select(*keep, F.col("text").cast("string").alias("text_")).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, plan: Ftrl = Ftrl(), keep: list[str] | None = None) -> DataFrame:
    """Learn from labelled documents that are not held out, then score every document."""
    marks = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold_of("doc_id", plan.folds) != plan.held_out)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64(F.lit("draw"), "doc_id"))
    )
    drawn = marks.where(F.pmod("draw", F.lit(1 << 30)) < float(1 << 30) * plan.sample / max(marks.count(), 1))
    # about ``sample`` rows of three numbers, so the texts stay where they are
    labelled = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return score(docs, learn(store(labelled.select("text", "toxic", "draw"), "labelled"), plan), plan, keep or ["doc_id"])
