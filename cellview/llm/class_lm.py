"""LM scoring with Brown class-based bigrams.

Every training word has a class.  Exchange clustering assigns the ``frequent`` most
frequent words and the end mark, with all other words as one further unit in a class of
its own: starting from a deal by frequency, each sweep computes for every word, in
parallel, the class that raises the class-bigram likelihood most, and half of the words
that want to move do so (fewer, if the likelihood would not rise).  Every further word of the
training texts then joins the class that its own left and right neighbours make likeliest: counts
of (word, side, class of the neighbour) are gathered over all training texts, so the
model's tables grow with the vocabulary.

A token's probability is P(class | class before) * P(word | class).  Transitions are
counted over all training texts by the final classes of all words and backed off to class
frequencies.  Words use absolute discounting inside their class; the freed mass of all
classes belongs to words never seen, as one symbol, so the sum over the known words and
this symbol is one.  After an unseen word the context is the class that frees most mass.

At most ``local`` of the most frequent words (17 bytes each) go to every task; rarer words of a
document are joined with the word table by hash.  Such a word is at most one training token in
``local``, and one that training never saw is rare too, as folds follow ids, so no key of this join is hot.

Defined results: null text counts as empty and has one token, its end; null ids are keyed
as empty text; repeated rows are learnt from and returned as often as they occur.  Without
training texts every token is the unseen symbol, which then has probability one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm import words as W
from cellview.llm.common import fold_of, store, text_batches

END = np.uint64(0x5DEECE66D1234567)  # hash of the end mark


@dataclass(frozen=True)
class ClassModel:
    frequent: int = 2000
    classes: int = 32  # at most 254
    sweeps: int = 5
    local: int = 1 << 18
    discount: float = 0.6
    folds: int = 7
    held_out: int = 2


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return text_batches(docs).select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _combined(batches, count, names: list[str]):
    """Counts of one or more keys of a task's texts, combined in bounded memory.

    ``count`` gives (hash, second key below 1,024, number) arrays of a slice of texts.
    """
    held: list = []
    size = 0

    def merged():
        h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, back = np.unique(h, return_inverse=True)
        key, at = np.unique(back * 1024 + s, return_inverse=True)
        return words[key // 1024], key % 1024, np.bincount(at, weights=n).astype(np.int64)

    def out(h, s, n):
        columns = {"h": pa.array(h.view(np.int64)), "s": pa.array(s.astype(np.int32)), "n": pa.array(n)}
        for k in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([columns[c][k : k + 100_000] for c in names], names=names)

    for batch in batches:
        for t in W.tokens(batch.column("text")):
            held.append(count(t))
            size += len(held[-1][0])
            if size > 1_500_000:  # bounds a task's memory
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*merged())


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): hash and count of every training token, ends included."""

    def count(t):
        h, n = np.unique(t.hash, return_counts=True)
        return np.append(h, END), np.zeros(len(h) + 1, np.int64), np.append(n, t.rows)

    return train.mapInArrow(lambda batches: _combined(batches, count, ["h", "n"]), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))


class _Units:
    """Units of tokens: rank among the frequent words, or one unit for all others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.rest = len(hashes)

    def __call__(self, t: W.Tokens) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, t.hash), len(self.sorted) - 1)
        return np.where(self.sorted[at] == t.hash, self.order[at], self.rest)

    @property
    def end(self) -> int:
        return int(self.order[np.searchsorted(self.sorted, END)])


def _with_ends(t: W.Tokens, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of words with ``end`` after each text, and the bounds."""
    bounds = t.bounds + np.arange(t.rows + 1)
    out = np.full(bounds[-1], end, dtype=values.dtype)
    out[np.arange(len(values)) + t.owner()] = values
    return out, bounds


def bigram_counts(train: DataFrame, units: _Units) -> DataFrame:
    """(u, v, n): how often unit v follows unit u; a text begins after an end."""
    size = units.rest + 1

    def run(batches):
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for t in W.tokens(batch.column("text")):
                u, bounds = _with_ends(t, units(t), units.end)
                before = np.concatenate([[units.end], u[:-1]])
                pair, n = np.unique(before * size + u, return_counts=True)
                total[pair] += n
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part // size).astype(np.int32)), pa.array((part % size).astype(np.int32)), pa.array(total[part])], names=["u", "v", "n"]
            )

    return train.mapInArrow(run, "u int, v int, n bigint").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(counts: np.ndarray) -> float:
    """What of the class-bigram log likelihood depends on the classes."""
    return float(_f(counts).sum() - _f(counts.sum(axis=1)).sum() - _f(counts.sum(axis=0)).sum())


def exchange(bigrams: DataFrame, plan: ClassModel, rest: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each unit, the class-bigram counts, and the likelihood before and after each sweep.

    Unit ``rest``, all further words, stays alone in the last class.  The table of units is of
    bounded size: at most ``frequent`` rows of as many neighbours.
    """
    spark, k = bigrams.sparkSession, plan.classes + 1
    frequency = np.zeros(rest + 1)
    for r in bigrams.groupBy("v").agg(F.sum("n").alias("n")).collect():
        frequency[r.v] = r.n
    rank = np.argsort(np.argsort(-frequency[:rest], kind="stable"), kind="stable")
    cls = np.append(rank % plan.classes, plan.classes).astype(np.int64)
    # one row per unit with its at most ``units`` neighbours on either side
    after = bigrams.groupBy(F.col("u").alias("unit")).agg(F.collect_list("v").alias("rv"), F.collect_list("n").alias("rn"))
    ahead = bigrams.groupBy(F.col("v").alias("unit")).agg(F.collect_list("u").alias("lv"), F.collect_list("n").alias("ln"))
    rows = store(after.join(ahead, "unit", "full").repartition(16, "unit"), "neighbours")

    def class_counts(cls) -> np.ndarray:
        shared = spark.sparkContext.broadcast(cls)

        def run(frames):
            total = np.zeros((k, k))
            for frame in frames:
                for unit, v, n in zip(frame["unit"], frame["rv"], frame["rn"], strict=True):
                    if v is not None:
                        total[shared.value[unit]] += np.bincount(shared.value[np.asarray(v)], weights=np.asarray(n, float), minlength=k)
            a, b = np.nonzero(total)
            yield pd.DataFrame({"a": a, "b": b, "n": total[a, b]})

        out = np.zeros((k, k))
        for r in rows.select("unit", "rv", "rn").mapInPandas(run, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            out[r.a, r.b] = r.n
        return out

    counts = class_counts(cls)
    trace = [likelihood(counts)]
    for sweep in range(plan.sweeps):
        shared = spark.sparkContext.broadcast((cls, counts))

        def run(frames):
            cls, full = shared.value
            for frame in frames:
                best, gains = [], []
                for unit, rv, rn, lv, ln in frame[["unit", "rv", "rn", "lv", "ln"]].itertuples(index=False):
                    a = cls[unit]
                    sides = []
                    self_n = 0.0
                    for v, n in ((rv, rn), (lv, ln)):
                        v = np.asarray(v if v is not None else [], dtype=np.int64)
                        n = np.asarray(n if n is not None else [], dtype=float)
                        own = v == unit
                        self_n = n[own].sum() if own.any() else self_n
                        sides.append(np.bincount(cls[v[~own]], weights=n[~own], minlength=k))
                    r, left = sides
                    m = full.copy()  # counts without this unit
                    m[a] -= r
                    m[:, a] -= left
                    m[a, a] -= self_n
                    rows_, cols = m.sum(axis=1) + left, m.sum(axis=0) + r  # what stands next to this unit counts, whatever its class
                    d = np.arange(k)
                    gain = (_f(m + r) - _f(m)).sum(axis=1) + (_f(m + left[:, None]) - _f(m)).sum(axis=0)
                    both = m[d, d]
                    gain += _f(both + r + left + self_n) - _f(both + r) - _f(both + left) + _f(both)
                    gain -= _f(rows_ + r.sum() + self_n) - _f(rows_) + _f(cols + left.sum() + self_n) - _f(cols)
                    gain[k - 1] = -np.inf
                    best.append(int(gain.argmax()))
                    gains.append(float(gain.max() - gain[a]))
                yield pd.DataFrame({"unit": frame["unit"], "best": best, "gain": gains})

        wanted = rows.where(F.col("unit") != rest).mapInPandas(run, "unit int, best int, gain double").where("gain > 1e-9").collect()
        for share in (2, 8, 32):  # moves of neighbours at once can undo each other
            moved = cls.copy()
            for r in wanted:
                if ((r.unit * 2654435761 + sweep * 40503) >> 7) % share == 0:
                    moved[r.unit] = r.best
            after = class_counts(moved)
            if likelihood(after) > trace[-1]:
                cls, counts = moved, after
                trace.append(likelihood(after))
                break
        else:
            break
    return cls, counts, trace


def contexts(train: DataFrame, units: _Units, cls: np.ndarray, plan: ClassModel) -> DataFrame:
    """(h, s, n): neighbours of every further word by class, before it (s < k) and behind it (s - k)."""
    k = plan.classes + 1
    shared = train.sparkSession.sparkContext.broadcast((units, cls))

    def count(t):
        units, cls = shared.value
        u, _ = _with_ends(t, units(t), units.end)
        h, _ = _with_ends(t, t.hash, END)
        at = np.flatnonzero(u == units.rest)
        near = cls[np.append(u, units.end)]  # the last token is an end; so is what stands at -1
        return np.tile(h[at], 2), np.concatenate([near[at - 1], near[at + 1] + k]), np.ones(2 * len(at), np.int64)

    return train.mapInArrow(lambda batches: _combined(batches, count, ["h", "s", "n"]), "h bigint, s int, n bigint").groupBy("h", "s").agg(F.sum("n").alias("n"))


def _joined_class(before: np.ndarray, behind: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per word (row) the class that gains most likelihood by taking it in; ties to the lower class."""
    k = counts.shape[0] - 1
    gain = np.zeros((len(before), k))
    for side, other, m in ((behind, before, counts[:k]), (before, behind, counts.T[:k])):
        w, b = np.nonzero(side)
        old = m[:, b].T
        np.add.at(gain, w, _f(old + side[w, b][:, None]) - _f(old))
        total, sums = side.sum(axis=1)[:, None], m.sum(axis=1) + other[:, :k]
        gain -= _f(sums + total) - _f(sums)
    w, d = np.nonzero((before[:, :k] > 0) & (behind[:, :k] > 0))
    m, r, left = counts[d, d], behind[w, d], before[w, d]
    gain[w, d] += _f(m + r + left) - _f(m + r) - _f(m + left) + _f(m)
    return gain.argmax(axis=1)


def join_classes(found: DataFrame, counts: np.ndarray) -> DataFrame:
    """(h, c, cls) of every further word from its ``contexts``."""
    k = counts.shape[0]
    shared = found.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            seen = batch.column("seen")
            flat = seen.flatten()
            size = np.diff(seen.offsets.to_numpy())
            side = np.zeros((batch.num_rows, 2 * k))
            side[np.repeat(np.arange(batch.num_rows), size), flat.field("s").to_numpy()] = flat.field("n").to_numpy()
            cls = _joined_class(side[:, :k], side[:, k:], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(side[:, :k].sum(axis=1).astype(np.int64)), pa.array(cls.astype(np.int32))], names=["h", "c", "cls"])

    # at most two neighbours per class
    lists = found.groupBy("h").agg(F.collect_list(F.struct("s", "n")).alias("seen"))
    return lists.mapInArrow(run, "h bigint, c bigint, cls int")


def fit(docs: DataFrame, plan: ClassModel = ClassModel()) -> tuple[dict, DataFrame]:
    """The model's tables of bounded size and the stored table of all words: h, c, cls."""
    spark = docs.sparkSession
    train = _texts(docs.where(fold_of("doc_id", plan.folds) != plan.held_out))
    top = word_counts(train).orderBy(F.desc("c"), "h").limit(plan.frequent).toPandas()
    chosen = top["h"].to_numpy(np.int64).view(np.uint64)
    times = dict(zip(top["h"], top["c"], strict=True))
    if END not in chosen:
        chosen = np.concatenate([chosen[: plan.frequent - 1], np.array([END], dtype=np.uint64)])
    units = _Units(chosen)
    bigrams = store(bigram_counts(train, units), "bigrams")
    cls, counts, trace = exchange(bigrams, plan, units.rest)
    ends = bigrams.where(F.col("v") == units.end).agg(F.sum("n")).first()[0] or 0
    core = [(int(h), int(times.get(h, ends)), int(a)) for h, a in zip(chosen.view(np.int64), cls, strict=False)]
    core = spark.createDataFrame([r for r in core if r[1]], "h bigint, c bigint, cls int")
    words = store(core.unionByName(join_classes(contexts(train, units, cls, plan), counts)), "words")
    of_class = {r.cls: r for r in words.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    k = plan.classes
    tokens, types = (np.array([of_class[a][x] if a in of_class else 0 for a in range(k)], dtype=float) for x in ("n", "v"))
    # the most frequent words by steps of a sixteenth of a doubling, so that only they reach the driver
    step = F.floor(F.log2("c") * 16).cast("int")
    cut, taken = 0, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        taken += r.n
        cut = r.step if taken <= plan.local else cut
        if taken > plan.local:
            cut = r.step + 1
            break
    near = words.where(step >= cut).toPandas().sort_values("h", key=lambda h: h.to_numpy(np.int64).view(np.uint64), ignore_index=True)
    model = {
        "n": int(tokens.sum()), "v": int(types.sum()), "tokens": tokens, "types": types, "trace": trace, "end": int(cls[units.end]),
        "h": near["h"].to_numpy(np.int64).view(np.uint64), "c": near["c"].to_numpy(np.int64), "cls": near["cls"].to_numpy(np.uint8),
    }
    return model, words


def classified(docs: DataFrame, model: dict, words: DataFrame, plan: ClassModel) -> DataFrame:
    """One row per document, stored: doc_id, held_out, n_tokens, n_known, base, inner and seq.

    ``inner`` sums log10 of the discounted counts of known tokens; ``seq`` holds one byte per token, its class, or
    the number of classes for a token that training never saw.
    """
    unseen, later = plan.classes, 255
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model["h"], model["c"], model["cls"]))

    def near(batches):
        h_, c_, cls_ = shared.value
        for batch in batches:
            for t in W.tokens(batch.column("text")):
                h, bounds = _with_ends(t, t.hash, END)
                owner = np.repeat(np.arange(t.rows), np.diff(bounds))
                if len(h_):
                    at = np.minimum(np.searchsorted(h_, h), len(h_) - 1)
                    known = h_[at] == h
                    count, seq = np.where(known, c_[at], 1), np.where(known, cls_[at], later).astype(np.uint8)
                else:
                    known, count, seq = np.zeros(len(h), bool), np.ones(len(h), np.int64), np.full(len(h), later, np.uint8)
                total = lambda x: np.bincount(owner, weights=x, minlength=t.rows)
                left = np.flatnonzero(~known)
                order = left[np.lexsort((h[left], owner[left]))]  # rare tokens by text and word
                fresh = np.ones(len(order), bool)
                fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                first = np.flatnonzero(fresh)
                cut = np.searchsorted(owner[order][first], np.arange(t.rows + 1))
                which = np.zeros(len(h), np.int32)
                which[order] = np.cumsum(fresh) - 1 - cut[owner[order]]
                lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[t.first : t.last], batch.column("held_out")[t.first : t.last], pa.array(np.diff(bounds)),
                        pa.array(total(known).astype(np.int64)), pa.array(total(np.where(known, np.log10(count + 1.0), 0.0))),
                        pa.array(total(np.where(known, np.log10(count - plan.discount), 0.0))),
                        pa.array([seq[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        lists(cut, h[order][first].view(np.int64)), lists(np.searchsorted(owner[left], np.arange(t.rows + 1)), which[left]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "seq", "rare", "which"],
                )

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base double, inner double, seq binary"
    held = fold_of("doc_id", plan.folds) == plan.held_out
    rows = _texts(docs.select("doc_id", "text", held.alias("held_out")), "doc_id", "held_out").mapInArrow(near, f"{out}, rare array<bigint>, which array<int>")
    rows = store(rows.withColumn("uid", F.monotonically_increasing_id()), "classified")
    rare = rows.select("uid", F.posexplode("rare").alias("at", "h"))
    found = rare.join(words, "h").groupBy("uid").agg(F.collect_list(F.struct("at", "c", "cls")).alias("found"))  # words of one document

    def settle(batches):
        for batch in batches:
            known, base, inner, seqs = [], [], [], []
            for seq, which, found in zip(batch.column("seq"), batch.column("which"), batch.column("found"), strict=True):
                seq, which = np.frombuffer(seq.as_buffer(), np.uint8).copy(), which.values.to_numpy()
                count, cls = np.zeros(which.max(initial=-1) + 1, np.int64), np.full(which.max(initial=-1) + 1, unseen, np.uint8)
                if found.is_valid:
                    at = found.values.field("at").to_numpy()
                    count[at], cls[at] = found.values.field("c").to_numpy(), found.values.field("cls").to_numpy()
                c = count[which]
                seq[seq == later] = cls[which]
                known.append(int((c > 0).sum()))
                base.append(float(np.log10(c + 1.0).sum()))
                inner.append(float(np.log10(c[c > 0] - plan.discount).sum()))
                seqs.append(seq.tobytes())
            add = lambda name, x: pa.array(batch.column(name).to_numpy() + np.array(x, dtype=batch.column(name).to_numpy().dtype))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), add("n_known", known), add("base", base), add("inner", inner), pa.array(seqs, pa.binary())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "seq"],
            )

    return store(rows.drop("rare").join(found, "uid", "left").drop("uid").mapInArrow(settle, out), "class-sequences")


def _pairs(seqs: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all neighbouring tokens of some texts, and the texts' bounds.  A text begins after an end."""
    seqs = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    now = np.frombuffer(seqs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    bounds = offsets - offsets[0]
    before = np.concatenate([[end], now[:-1]])
    before[bounds[:-1]] = end
    return before, now, bounds


def transitions(rows: DataFrame, model: dict, plan: ClassModel) -> np.ndarray:
    """log10 of P(class | class before), with a last column and row for the unseen symbol."""
    k, end = plan.classes, model["end"]

    def run(batches):
        total = np.zeros((k + 1) ** 2, np.int64)
        for batch in batches:
            before, now, _ = _pairs(batch.column("seq"), end)
            total += np.bincount(before * (k + 1) + now, minlength=(k + 1) ** 2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["p", "n"])

    counts = np.zeros((k + 1) ** 2)
    for r in rows.where("NOT held_out").select("seq").mapInArrow(run, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect():
        counts[r.p] = r.n
    counts = counts.reshape(k + 1, k + 1)[:k, :k]
    tokens, types = model["tokens"], model["types"]
    share = (tokens + 1) / (tokens.sum() + k)
    known = (counts + k * share[None, :]) / (counts.sum(axis=1, keepdims=True) + k)
    freed = (plan.discount * types + 1) / (tokens + 1)
    table = np.column_stack([np.log10(known) - np.log10(tokens + 1)[None, :], np.log10(known @ freed)])
    return np.vstack([table, table[int((plan.discount * types).argmax())]])


def score(docs: DataFrame, model: dict, words: DataFrame, plan: ClassModel = ClassModel()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = classified(docs, model, words, plan)
    table, end = transitions(rows, model, plan), model["end"]
    base_low = float(np.log10(model["n"] + model["v"] + 1))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            before, now, bounds = _pairs(batch.column("seq"), end)
            value = np.add.reduceat(table[before, now], bounds[:-1]) + batch.column("inner").to_numpy()
            tokens = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), batch.column("n_known"),
                    pa.array(np.full(batch.num_rows, model_n)), pa.array(batch.column("base").to_numpy() - tokens * base_low), pa.array(value),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    model_n = np.int64(model["n"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
