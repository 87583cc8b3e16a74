"""Vector code compression: product codes found by equal-average nearest search.

Components become whole numbers ``floor(256 * x)``; a vector is cut into equal
consecutive parts, and each part position has its own codebook of ``entries``
vectors.  Every round assigns all parts to their nearest entry and replaces an
entry by the floored mean of its parts.

The nearest entry is found by *equal-average search*.  Entries are sorted by the
sum of their components.  For a part x and an entry y of dimension k,
``(sum(x) - sum(y))**2 / k`` never exceeds their squared distance, so the search
starts at the part's own sum and goes outward on both sides; a side ends when
that bound strictly exceeds the best distance found.  Equal distances go to the
lower index, which is why the bound has to exceed, not reach, the best.

One pass over the vectors is one scan without a shuffle of rows: a task sends
one partial sum per entry.  The codebooks (``entries * dimension`` numbers, 32 KB
at 64 dimensions) are all that reaches the driver.

Defined results
    Rows whose vector is null or holds a null, NaN or infinite component are dropped.
    The dimension is the most frequent length that is a positive multiple of
    ``parts`` (ties: the longer).  Other lengths keep their row, with null code and error,
    add nothing to label_error and take no part in the codebooks.
    First entries are the smallest vec_ids, null ids last; equal ids by their vectors.
    With fewer rows than entries the codebooks have as many entries as there are rows.
    Integers saturate at +-2**62; error and label_error at the largest long.
    Repeated rows are coded alike, each row for itself.  Columns beyond vec_id, embedding and label
    are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm.common import store
from cellview.operators.layout import attach

SATURATED = 1 << 62
SMALL = 1 << 22  # below it, int64 holds all distances and squared sums of parts of up to 256 components
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class ProductCode:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def _flat(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Whole-number vectors, one per row; Python ints where int64 could overflow."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    with np.errstate(over="ignore"):
        y = np.clip(np.floor(x * scale), -float(SATURATED), float(SATURATED)).astype("i8")
    return y if not y.size or np.abs(y).max() < SMALL else y.astype(object)


class Codebook:
    """Entries of one part position, sorted by their sum."""

    def __init__(self, entries: list[list[int]]):
        big = any(abs(v) >= SMALL for e in entries for v in e)
        rows = np.array(entries, dtype=object if big else "i8")
        sums = rows.sum(axis=1)
        self.index = np.array(sorted(range(len(rows)), key=lambda i: (sums[i], i)))
        self.rows, self.sums = rows[self.index], sums[self.index]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part and its squared distance."""
        n, k = parts.shape
        if parts.dtype == object or self.rows.dtype == object:
            parts = parts.astype(object)
        sums = parts.sum(axis=1)
        start = np.searchsorted(self.sums, sums)
        best = np.full(n, -1, dtype=parts.dtype)
        chosen = np.full(n, len(self.rows))
        for step in (-1, 1):
            at = start - 1 if step < 0 else start.copy()
            live = np.arange(n)
            while len(live):
                live = live[(at[live] >= 0) & (at[live] < len(self.rows))]
                gap = sums[live] - self.sums[at[live]]
                live = live[((best[live] < 0) | (gap * gap <= best[live] * k)).astype(bool)]
                here = at[live]
                away = parts[live] - self.rows[here]
                far = (away * away).sum(axis=1)
                index = self.index[here]
                better = ((best[live] < 0) | (far < best[live]) | ((far == best[live]) & (index < chosen[live]))).astype(bool)
                best[live[better]], chosen[live[better]] = far[better], index[better]
                at[live] += step
        return chosen, best


def _assigned(batch: pa.RecordBatch, books: list[Codebook], dim: int, scale: int):
    """Per part position: the whole-number parts, their entries and distances."""
    y = _flat(batch.column("v"), dim, scale)
    width = dim // len(books)
    for p, book in enumerate(books):
        part = y[:, p * width : (p + 1) * width]
        yield p, part, *book.nearest(part)


def _vectors(embeddings: DataFrame) -> DataFrame:
    """Kept rows: (vec_id, label, v) with v of doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _dimension(kept: DataFrame, parts: int) -> int | None:
    found = (
        kept.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("rows"), F.desc("n")).first()
    )
    return found and found.n


def train(kept: DataFrame, dim: int, plan: ProductCode) -> list[list[list[int]]]:
    """Codebooks by part position: lists of entries, each a list of components."""
    width, scale = dim // plan.parts, plan.scale
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(plan.entries).select("v").collect()
    whole = [_flat(pa.array([r.v]), dim, scale)[0].tolist() for r in first]
    books = [[row[p * width : (p + 1) * width] for row in whole] for p in range(plan.parts)]

    for _ in range(plan.rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sorted_books = [Codebook(b) for b in now]
            size = len(now[0])
            total = np.zeros((plan.parts, size, width), dtype=object)
            count = np.zeros((plan.parts, size), "i8")
            for batch in batches:
                if not batch.num_rows:
                    continue
                for p, part, entry, _ in _assigned(batch, sorted_books, dim, scale):
                    added = np.zeros((size, width), part.dtype)
                    np.add.at(added, entry, part)
                    total[p] += added
                    count[p] += np.bincount(entry, minlength=size)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array([[str(v) for v in total[i, j]] for i, j in zip(p, e, strict=True)], pa.list_(pa.string()))],
                ["part", "entry", "n", "total"],
            )

        partial = kept.mapInArrow(sums, "part int, entry int, n long, total array<string>")
        added = partial.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k].cast("decimal(38,0)")) for k in range(width))).alias("total")
        )
        books = [[list(e) for e in b] for b in now]
        for r in added.collect():
            books[r.part][r.entry] = [int(t) // r.n for t in r.total]
    return books


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def encode(kept: DataFrame, books: list[list[list[int]]], dim: int, plan: ProductCode) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector of the dimension."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_books = [Codebook(b) for b in books]
        for batch in batches:
            codes = np.zeros((batch.num_rows, plan.parts), np.uint8)
            error = np.zeros(batch.num_rows, dtype=object)
            for p, _, entry, far in _assigned(batch, sorted_books, dim, plan.scale) if batch.num_rows else ():
                codes[:, p], error = entry, error + far
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), LONGEST) for e in error], pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(embeddings: DataFrame, plan: ProductCode = ProductCode()) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per kept vector."""
    if not 0 < plan.entries <= 256:
        raise ValueError("an entry index is two hex digits: 1 to 256 entries")
    every = _vectors(embeddings)
    dim = _dimension(every, plan.parts)
    kinds = dict(every.dtypes)
    if dim is None:
        books, coded = [], every.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        kept = every.where(F.size("v") == dim)
        books = train(kept, dim, plan)
        other = every.where(F.size("v") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = encode(kept, books, dim, plan).unionByName(other)
    known = F.col("label").isNotNull()
    name = F.coalesce(F.col("label").cast("string"), F.lit(""))
    stored = store(coded.withColumn("known", known).withColumn("name", name), "codes")
    total = F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0))
    per_label = store(stored.groupBy("known", "name").agg(F.least(total, F.lit(LONGEST)).cast("long").alias("label_error")), "label_errors")
    out = attach(stored, per_label, ["known", "name"], per_label.count())
    return out.select("vec_id", F.col("label").cast(kinds["label"]), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(plan: ProductCode = ProductCode()) -> str:
    """The same codes by comparing every part with every entry."""
    rounds = []
    for r in range(plan.rounds + 1):
        rounds.append(f"""
        near{r} AS (
            SELECT vec_id, p, arg_min(e, far * 1000 + e) AS e, min(far) AS far FROM (
                SELECT vec_id, s.p, b.e, sum((s.x - b.x) * (s.x - b.x)) AS far
                FROM parts s JOIN book{r} b ON s.p = b.p AND s.k = b.k GROUP BY ALL)
            GROUP BY ALL)""")
        if r < plan.rounds:
            rounds.append(f"""
        book{r + 1} AS (
            SELECT b.p, b.e, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
                SELECT n.p, n.e, s.k, CAST(floor(sum(s.x) / count(*)) AS BIGINT) AS x
                FROM near{r} n JOIN parts s ON n.vec_id = s.vec_id AND n.p = s.p GROUP BY ALL) m USING (p, e, k))""")
    last = plan.rounds
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({plan.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (
        SELECT vec_id, (i * {plan.parts}) // len(v) AS p, i % (len(v) // {plan.parts}) AS k, v[i + 1] AS x
        FROM kept, unnest(range(len(v))) AS t(i)),
    firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {plan.entries}),
    book0 AS (SELECT p, e, k, x FROM parts JOIN firsts USING (vec_id)),{",".join(rounds)},
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{last} GROUP BY vec_id)
    SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) FROM book{last}) AS codebooks_sha256
    FROM kept JOIN coded USING (vec_id)"""
