"""Language ID by hierarchical discrimination.

Texts become frequencies of hashed letter 1-, 2- and 3-grams (bytes, A-Z lower-cased, other
ASCII characters as blanks).  One linear support vector machine per family against the
rest picks the language family; inside it one machine per pair of languages votes.
Families are a table of language codes; a code that is not in it is a family of its own.

Learning: per language about ``sample`` labelled documents, drawn by a hash of id and
text at the rate sample / labelled rows, so that the bound holds at any size.  The
machines are trained in parallel, one task each, on those feature vectors (``sample`` *
languages * ``dims`` numbers).  Scoring adds up weights over all n-grams of whole texts.

The score is the product of the logistic of the family's margin over the next family
and of the weakest pair margin of the chosen language.

Defined results: null text or text without letters is ``und`` with score 0; without any
labelled row everything is ``und``; with one language everything with letters is that
language with score 0.5; null langs never teach; null doc_ids are keyed as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellview.llm import words as W
from cellview.llm.common import fold_of, store, text_batches

# fixed values: language families by ISO 639-1 code
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi bn mr gu pa ur ne si",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


@dataclass(frozen=True)
class Discrimination:
    sample: int = 400  # labelled documents per language, about
    dims: int = 4096
    steps: int = 150
    penalty: float = 1e-3
    folds: int = 5
    held_out: int = 0


_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_FOLDED = W.LOWER.copy()
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _grams(column: pa.Array, dims: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: rows, feature index and text of each n-gram by text, and which texts hold letters."""
    bits = np.uint32(32 - (dims.bit_length() - 1))
    data, offsets = W.texts_of(column)
    for first, last in W.slices(offsets, 1 << 19):
        lo = int(offsets[first])
        raw = data[lo : int(offsets[last])]
        bounds = offsets[first : last + 1] - lo
        owner = np.repeat(np.arange(last - first), np.diff(bounds))
        b = _FOLDED[raw].astype(np.uint32)
        letters = np.zeros(last - first, dtype=bool)
        letters[owner[(b >= 97) & (b <= 122)]] = True
        for i in np.flatnonzero(~letters & (np.diff(bounds) > 0)):
            letters[i] = any(c.isalpha() for c in raw[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
        index, owners = [], []
        code = b
        for n, factor in enumerate(_FACTORS):
            if n:
                code = (code[:-1] << np.uint32(8)) | b[n:]
            inside = owner[: len(code)] == owner[n:] if n else np.ones(len(code), bool)
            index.append(((code * factor) >> bits)[inside])
            owners.append(owner[: len(code)][inside])
        yield first, last, index, owners, letters


def _features(docs: DataFrame, plan: Discrimination) -> DataFrame:
    """lang and dense feature vector of sampled documents."""

    def run(batches):
        for batch in batches:
            for first, last, index, owners, letters in _grams(batch.column("text"), plan.dims):
                n = last - first
                flat = sum(np.bincount(o * plan.dims + i, minlength=n * plan.dims) for i, o in zip(index, owners, strict=True))
                x = flat.reshape(n, plan.dims).astype(np.float32)
                x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
                keep = np.flatnonzero(letters)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * plan.dims + 1, plan.dims, dtype=np.int32)), pa.array(x[keep].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("lang")[first:last].take(pa.array(keep)), vectors], names=["lang", "x"])

    return text_batches(docs).select("lang", "text").mapInArrow(run, "lang string, x array<float>")


def _train(plan: Discrimination):
    """Squared-hinge linear machine by accelerated gradient steps on one task's rows."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "lang"])
        x = np.stack(rows["x"].to_numpy())  # stays at 4 bytes a number
        y = rows["y"].to_numpy().astype(np.float32)
        scale = (1.0 / np.sqrt(x.mean(axis=0) + 1e-6)).astype(np.float32)
        x *= scale
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
        v = np.random.default_rng(1).standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(12):  # largest curvature, for the step
            v = x.T @ (weight * (x @ v))
            v /= np.linalg.norm(v) + 1e-12
        step = 1.0 / (2.2 * float((weight * (x @ v) ** 2).sum()) + plan.penalty)
        w = np.zeros(x.shape[1], np.float32)
        ahead = w
        for k in range(plan.steps):
            loss = np.maximum(0, 1 - y * (x @ ahead))
            new = ahead - step * (plan.penalty * ahead - 2 * x.T @ (weight * y * loss))
            ahead, w = new + k / (k + 3) * (new - w), new
        return pd.DataFrame({"one": [key[0]], "two": [key[1]], "w": [(w[:-1] * scale).tolist()], "bias": [float(w[-1])]})

    return run


def learn(docs: DataFrame, plan: Discrimination = Discrimination()) -> dict:
    """Languages, families and one weight vector per machine; ``docs``: text and lang."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", "draw")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chosen = known.join(F.broadcast(sizes), "lang").where(  # one row per language
        F.pmod(F.col("draw"), F.lit(1 << 30)) < F.lit(float(1 << 30) * plan.sample) / F.col("n")
    )
    sampled = store(_features(chosen.repartition(16), plan), "language-sample")
    langs = sorted(r.lang for r in sampled.select("lang").distinct().collect())
    families = sorted({family_of(lang) for lang in langs})
    machines = [(f, "", lang, 1 if family_of(lang) == f else -1) for f in families for lang in langs if len(families) > 1]
    for f in families:
        for a, b in combinations([lang for lang in langs if family_of(lang) == f], 2):
            machines += [(a, b, a, 1), (a, b, b, -1)]
    model = {"langs": langs, "families": families, "machines": {}}
    if machines:
        plans = docs.sparkSession.createDataFrame(machines, "one string, two string, lang string, y int")
        fitted = sampled.join(F.broadcast(plans), "lang").groupBy("one", "two").applyInPandas(_train(plan), "one string, two string, w array<double>, bias double")
        model["machines"] = {(r.one, r.two): (np.array(r.w, dtype=np.float32), r.bias) for r in fitted.collect()}
    return model


def predict(docs: DataFrame, model: dict, plan: Discrimination, keep: list[str]) -> DataFrame:
    """``row`` with the ``keep`` columns of ``docs``, whatever they are called, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", docs.select(*keep).schema, False), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    inside = "text" in keep and docs.schema["text"].dataType == T.StringType()  # the row brings the text, it is not sent twice
    logistic = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -40, 40)))

    def judged(index, owners, letters):
        m, n = shared.value, len(letters)
        total = np.maximum(sum(np.bincount(o, minlength=n) for o in owners), 1)

        def margins(key):
            w, bias = m["machines"][key]
            return sum(np.bincount(o, weights=w[i], minlength=n) for i, o in zip(index, owners, strict=True)) / total + bias

        langs = m["langs"]
        if not langs:
            return ["und"] * n, np.zeros(n)
        family, sure = np.zeros(n, dtype=int), np.ones(n)
        if len(m["families"]) > 1:
            each = np.stack([margins((f, "")) for f in m["families"]])
            family = each.argmax(axis=0)
            best = np.sort(each, axis=0)
            sure = logistic((best[-1] - best[-2]) / 2)
        votes, weakest = np.zeros((len(langs), n)), np.full((len(langs), n), np.inf)
        for a, b in (k for k in m["machines"] if k[1]):
            x, i, j = margins((a, b)), langs.index(a), langs.index(b)
            votes[i] += x > 0
            votes[j] += x <= 0
            weakest[i], weakest[j] = np.minimum(weakest[i], x), np.minimum(weakest[j], -x)
        inside = np.array([[family_of(lang) == f for lang in langs] for f in m["families"]])
        ranked = np.where(inside[family].T, votes + 0.4 * np.tanh(np.where(np.isinf(weakest), 0, weakest)), -1.0)
        pick = ranked.argmax(axis=0)
        low = weakest[pick, np.arange(n)]
        score = sure * np.where(np.isinf(low), 1.0, logistic(np.where(np.isinf(low), 0, low)))
        if len(langs) == 1:
            score = np.full(n, 0.5)
        return [langs[p] if ok else "und" for p, ok in zip(pick, letters, strict=True)], np.where(letters, score, 0.0)

    def run(batches):
        for batch in batches:
            text = batch.column("row").field("text") if inside else batch.column("text")
            for first, last, index, owners, letters in _grams(text, plan.dims):
                lang, score = judged(index, owners, letters)
                yield pa.RecordBatch.from_arrays([batch.column("row")[first:last], pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    sent = [row] if inside else [row, F.col("text").cast("string").alias("text")]
    return text_batches(docs).select(*sent).mapInArrow(run, schema)


def identified(docs: DataFrame, plan: Discrimination = Discrimination(), keep: list[str] | None = None) -> DataFrame:
    """Learn from the folds that are not held out, then predict every document: ``row`` (all columns, or those in ``keep``), lang_pred, score."""
    marked = docs.select("doc_id", "text", "lang", F.xxhash64(F.lit("draw"), F.col("doc_id").cast("string"), "text").alias("draw"))
    model = learn(marked.where(fold_of("doc_id", plan.folds) != plan.held_out), plan)
    return predict(docs, model, plan, docs.columns if keep is None else keep)


def identify(docs: DataFrame, plan: Discrimination = Discrimination()) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    return identified(docs.select("doc_id", "text", "lang"), plan, ["doc_id"]).select("row.doc_id", "lang_pred", "score")
