"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

A byte goes if some ``length``-byte string over it (400 by default) starts at
another place too, in any document, overlaps included.  All starts of such
strings are found by sorting suffixes:

1. *Suffixes.*  Two equal strings have equal smallest ``gram``-byte hashes at equal
   places, so a suffix is posted only where the smallest hash of some window
   stands (its *anchor*), about one byte in 170.  It stands for the windows whose
   smallest hash it is: starts ``a - dmax .. a - dmin``.
2. *Sort.*  Sampled splitters (``repartitionByRange``) deal the suffixes into buckets
   by their leading tokens; a bucket is sorted by multikey quicksort: by one token,
   and only runs of equal tokens go on to the next.  The tokens are the first
   eight bytes, a fingerprint of the bytes that all windows of the suffix share,
   and one of the bytes that any of them touches.  Place ends the sort key, so a string
   that holds a third of all rows is split over buckets.
3. *Compare.*  Neighbours with all tokens equal repeat in all their windows.  Neighbours
   with equal leading tokens only are cut into finer suffixes, of 16 windows and
   then of one, and sorted again.  A suffix without an equal neighbour repeats
   nowhere.  The first and last row of each bucket are compared with
   those of the next bucket, which is all the driver sees: two rows per bucket.

Fingerprints are 64-bit polynomial hashes, two independent ones per
suffix (with the eight leading bytes: 192 bits); equal fingerprints count as equal strings.
The work is linear in the bytes, except that a text of one repeated byte posts a suffix at each of them.

Defined results
    A null text is empty.  Texts shorter than ``length`` keep everything.  Repeated rows, even of
    one doc_id, are occurrences of their own, and all of them lose the common bytes.
    A null doc_id is an id like others.  Long texts are hashed in overlapping pieces.
    An empty table gives no rows.  Columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellview.llm.common import forget, store, text_batches

CHUNK = 1 << 20  # bytes hashed at once
PLACE = (1 << 21) - 1  # low bits that hold a place inside a chunk


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    gram: int = 64
    step: int = 16
    bucket_rows: int = 200_000


SUFFIX = "o1 long, o2 long, a int, dmin int, dmax int, lead long, core long, extent long"
NAMES = ["o1", "o2", "a", "dmin", "dmax", "lead", "core", "extent"]


class Rolling:
    """Two polynomial hashes of any span of a buffer, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    bases = (0x9E3779B97F4A7C15 & ~7 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 3)  # 3 or 5 mod 8: few even factors in differences of powers
    tables = np.random.default_rng(20_240_229).integers(0, 1 << 64, (2, 256), dtype=np.uint64)

    @classmethod
    def powers(cls, which: int, n: int):
        if which not in cls._powers or len(cls._powers[which][0]) < n:
            size, base = max(n, CHUNK + 1024), cls.bases[which]
            run = lambda b: np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64)
            cls._powers[which] = run(base), run(pow(base, -1, 1 << 64))
        up, down = cls._powers[which]
        return up[:n], down[:n]

    def __init__(self, buffer: np.ndarray):
        self.n = len(buffer)
        self.sums, self.down = [], []
        for which in (0, 1):
            up, down = self.powers(which, self.n)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.tables[which][buffer] * up, dtype=np.uint64)]))
            self.down.append(down)

    def span(self, which: int, at: np.ndarray, length) -> np.ndarray:
        s = self.sums[which]
        return (s[at + length] - s[at]) * self.down[which][at]

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of the k bytes at every place."""
        s = self.sums[0]
        g = (s[k:] - s[:-k]) * self.down[0][: self.n - k + 1]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        return g


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, in linear time: block prefixes meet block suffixes."""
    n = len(v)
    pad = -n % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def leading(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a long that sorts like them."""
    word = buffer[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
    return (word ^ np.uint64(1 << 63)).view(np.int64)


def _extent(hashed: np.ndarray, dmin: np.ndarray, dmax: np.ndarray) -> np.ndarray:
    shape = (dmin * 65_536 + dmax).astype(np.uint64)
    return (hashed ^ (shape * np.uint64(0x9FB21C651E98DF25))).view(np.int64)


def anchored(pieces: list[tuple[int, int, int, bytes]], plan: Repeats) -> list[np.ndarray]:
    """Suffix rows of text pieces (o1, o2, offset, bytes), each at least ``length`` bytes."""
    buffer = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[3]) for p in pieces])
    begin = ends - np.array([len(p[3]) for p in pieces])
    rolling = Rolling(buffer)
    v = (rolling.grams(plan.gram) & np.uint64(~PLACE & ((1 << 64) - 1))) | np.arange(len(buffer) - plan.gram + 1, dtype=np.uint64)
    least = window_minima(v, plan.length - plan.gram + 1)
    whole = np.ones(len(least), bool)
    for e in ends:
        whole[max(0, e - plan.length + 1) : e] = False
    starts = np.flatnonzero(whole)
    anchor = (least[starts] & np.uint64(PLACE)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    anchor = anchor[np.concatenate([[0], cut])]
    dmin, dmax = anchor - last, anchor - first
    piece = np.searchsorted(begin, anchor, "right") - 1
    o1, o2, offset = (np.array([p[i] for p in pieces])[piece] for i in range(3))
    core = rolling.span(0, anchor, plan.gram).view(np.int64)
    extent = _extent(rolling.span(1, first, last - first + plan.length), dmin, dmax)
    return [o1, o2, anchor - begin[piece] + offset, dmin, dmax, leading(buffer, anchor), core, extent]


def finer(contents: list[bytes], top: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int, plan: Repeats):
    """Cut windows ``lo..hi`` of each content, which begins ``top`` bytes before its anchor, at multiples of ``step``.

    Yields the row of each part and dmin, dmax, lead, core, extent.
    """
    buffer = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.cumsum([0] + [len(c) for c in contents[:-1]])
    rolling = Rolling(buffer)
    parts = hi // step - lo // step + 1
    row = np.repeat(np.arange(len(contents)), parts)
    m = (lo // step)[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    dmin, dmax = np.maximum(m * step, lo[row]), np.minimum(m * step + step - 1, hi[row])
    anchor = begin[row] + top[row]
    at = anchor - m * step
    core = rolling.span(0, at, plan.length - step + 1).view(np.int64)
    extent = _extent(rolling.span(1, anchor - dmax, dmax - dmin + plan.length), dmin, dmax)
    return row, dmin, dmax, leading(buffer, at), core, extent


def _batch(columns, names, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _owned(docs: DataFrame, plan: Repeats) -> DataFrame:
    """(o1, o2, bytes): rows of equal id and text share an owner."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("o1"), F.xxhash64(text, F.col("doc_id").isNull()).alias("o2"), text.cast("binary").alias("bytes"),
        F.col("doc_id"),
    )


def suffixes(owned: DataFrame, plan: Repeats) -> DataFrame:
    """One row per anchor of the texts of at least ``length`` bytes."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            for o1, o2, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                o1, o2, text = o1.as_py(), o2.as_py(), text.as_buffer()
                for at in range(0, text.size - plan.length + 1, CHUNK - plan.length):
                    piece = text[at : at + CHUNK - 1].to_pybytes()
                    if size + len(piece) > CHUNK:
                        yield _batch(anchored(pieces, plan), NAMES, SUFFIX)
                        pieces, size = [], 0
                    pieces.append((o1, o2, at, piece))
                    size += len(piece)
        if pieces:
            yield _batch(anchored(pieces, plan), NAMES, SUFFIX)

    return text_batches(owned.where(F.octet_length("bytes") >= plan.length).select("o1", "o2", "bytes")).mapInArrow(post, SUFFIX)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their tokens: sort by one, and only runs of equal ones by the next."""
    order = np.argsort(tokens[0], kind="stable")
    tied = np.arange(len(order))
    run = np.zeros(len(order), np.int64)
    for depth in range(1, len(tokens)):
        before = tokens[depth - 1][order[tied]]
        fresh = np.concatenate([[True], (before[1:] != before[:-1]) | (run[1:] != run[:-1])]) if len(tied) else np.zeros(0, bool)
        run = np.cumsum(fresh)
        many = np.bincount(run)[run] > 1 if len(tied) else np.zeros(0, bool)
        tied, run = tied[many], run[many]
        rows = order[tied]
        order[tied] = rows[np.lexsort((tokens[depth][rows], run))]
    return order


MARKED = "o1 long, o2 long, a int, dmin int, dmax int, lead long, core long, extent long, whole boolean, part boolean, edge int, bucket int"


def _marks(columns: dict[str, np.ndarray], bucket: int):
    """Marks of one sorted bucket; rows without an equal neighbour go, but for the first and last."""
    order = multikey_order([columns["lead"], columns["core"], columns["extent"]])
    c = {n: v[order] for n, v in columns.items()}
    n = len(order)
    like = np.concatenate([[False], (c["lead"][1:] == c["lead"][:-1]) & (c["core"][1:] == c["core"][:-1])])
    same = like & np.concatenate([[False], c["extent"][1:] == c["extent"][:-1]])
    after = lambda x: np.concatenate([x[1:], [False]])
    whole = same | after(same)
    group = np.cumsum(~like) - 1
    kinds = np.bincount(group, weights=~same)[group]
    edge_group = (group == 0) | (group == group[-1])
    part = ((like | after(like)) & ~whole) | (whole & ~same & ((kinds > 1) | edge_group))
    edge = np.zeros(n, np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    keep = whole | part | (edge > 0)
    return [c[name][keep] for name in NAMES] + [whole[keep], part[keep], edge[keep], np.full(keep.sum(), bucket, np.int32)]


def marked(rows: DataFrame, plan: Repeats) -> DataFrame:
    """Stored suffix rows with ``whole`` (all windows repeat) and ``part`` (look closer)."""
    from pyspark import TaskContext

    buckets = max(1, math.ceil(rows.count() / plan.bucket_rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            columns = {n: table.column(n).to_numpy() for n in NAMES}
            yield _batch(_marks(columns, TaskContext.get().partitionId()), [c.split()[0] for c in MARKED.split(", ")], MARKED)

    dealt = rows.repartitionByRange(buckets, "lead", "core", "extent", "o1", "o2", "a")
    found = store(dealt.mapInArrow(compare, MARKED), "suffixes")
    ends = sorted(found.where("edge > 0").select("bucket", "edge", "lead", "core", "extent").collect(), key=lambda r: (r.bucket, r.edge))
    fixes: dict[tuple[int, int], bool] = {}
    for a, b in zip(ends, ends[1:], strict=False):
        if a.bucket != b.bucket and (a.lead, a.core) == (b.lead, b.core):
            for r in (a, b):
                key = (r.bucket, r.edge)
                fixes[key] = fixes.get(key, False) or a.extent == b.extent
    if not fixes:
        return found
    patch = rows.sparkSession.createDataFrame([(*k, v) for k, v in fixes.items()], "bucket int, edge int, whole_ boolean")
    fixed = found.join(F.broadcast(patch), ["bucket", "edge"], "left")
    out = fixed.withColumn("whole", F.col("whole") | F.coalesce("whole_", F.lit(False))).withColumn("part", F.col("part") | F.col("whole_").isNotNull())
    out.scratch_path = found.scratch_path
    return out


def _spans(found: DataFrame, plan: Repeats) -> DataFrame:
    return found.where("whole").select("o1", "o2", (F.col("a") - F.col("dmax")).alias("start"), (F.col("a") - F.col("dmin") + plan.length).alias("end"))


CONTENT = "o1 long, o2 long, a int, dmin int, dmax int, content binary"


def _contents(found: DataFrame, owned: DataFrame, plan: Repeats) -> DataFrame:
    """The bytes that the windows of each suffix to look at closer touch."""
    asked = found.where("part").groupBy("o1", "o2").agg(F.collect_list(F.struct("a", "dmin", "dmax")).alias("asked"))
    long = owned.where(F.octet_length("bytes") >= plan.length).select("o1", "o2", "bytes")
    both = long.join(asked, ["o1", "o2"]).select("o1", "o2", "bytes", F.explode("asked").alias("x"))
    piece = F.expr(f"substring(bytes, x.a - x.dmax + 1, x.dmax - x.dmin + {plan.length})")
    return both.select("o1", "o2", "x.a", "x.dmin", "x.dmax", piece.alias("content"))


def _finer_rows(contents: DataFrame, step: int, plan: Repeats) -> DataFrame:
    """Suffix rows at multiples of ``step``; contents: o1, o2, a, top, lo, hi, content."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                o1, o2, a, top, lo, hi = (part.column(n).to_numpy().astype(np.int64) for n in ("o1", "o2", "a", "top", "lo", "hi"))
                row, *rest = finer(part.column("content").to_pylist(), top, lo, hi, step, plan)
                yield _batch([o1[row], o2[row], a[row], *rest], NAMES, SUFFIX)

    return contents.select("o1", "o2", "a", "top", "lo", "hi", "content").mapInArrow(post, SUFFIX)


def repeated_spans(docs: DataFrame, plan: Repeats = Repeats()) -> DataFrame:
    """(o1, o2, start, end): spans of starts and their strings that repeat; they overlap."""
    if not 8 <= plan.gram <= plan.length - plan.step + 1 or plan.length < plan.step + 8:
        raise ValueError("gram must fit the strings that all windows of a suffix share, and hold eight bytes")
    owned = _owned(docs, plan)
    posted = store(suffixes(owned, plan), "anchors")
    coarse = marked(posted, plan)
    forget(posted)
    contents = store(_contents(coarse, owned, plan), "contents")
    whole = contents.withColumnsRenamed({"dmin": "lo", "dmax": "hi"}).withColumn("top", F.col("hi"))
    posted = store(_finer_rows(whole, plan.step, plan), "blocks")
    middle = marked(posted, plan)
    forget(posted)
    asked = middle.where("part").select("o1", "o2", "a", F.col("dmin").alias("lo"), F.col("dmax").alias("hi"))
    single = contents.withColumnRenamed("dmax", "top").join(asked, ["o1", "o2", "a"]).where("lo >= dmin AND hi <= top")
    posted = store(_finer_rows(single, 1, plan), "windows")
    fine = marked(posted, plan)
    forget(posted)
    forget(contents)
    return _spans(coarse, plan).unionByName(_spans(middle, plan)).unionByName(_spans(fine, plan))


def runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    last = np.concatenate([fresh[1:] - 1, [len(s) - 1]])
    return list(zip(s[fresh].tolist(), e[last].tolist(), strict=True))


def cut(docs: DataFrame, plan: Repeats = Repeats(), bytes_too: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans [(start, end)], kept_sha256 and, if asked, the kept bytes."""
    owned = _owned(docs, plan)
    spans = repeated_spans(docs, plan).groupBy("o1", "o2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    long = F.octet_length("bytes") >= plan.length
    none = F.lit(None).cast("array<int>")
    short = owned.where(~long).select("doc_id", "bytes", none.alias("starts"), none.alias("ends"))
    both = owned.where(long).join(spans, ["o1", "o2"], "left").select("doc_id", "bytes", "starts", "ends").unionByName(short)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", span), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
    ])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(n) for n in ("bytes", "starts", "ends")), strict=True):
                text = memoryview(text.as_buffer())
                found = runs(np.array(starts.as_py()), np.array(ends.as_py())) if starts.is_valid else []
                digest, kept, at = hashlib.sha256(), [], 0
                for s, e in [*found, (len(text), len(text))]:
                    digest.update(text[at:s])
                    if bytes_too:
                        kept.append(bytes(text[at:s]))
                    at = e
                rows.append((len(text), sum(e - s for s, e in found), [{"start": s, "end": e} for s, e in found], digest.hexdigest(), b"".join(kept) if bytes_too else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), kind, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], out.names)

    done = text_batches(both).mapInArrow(part, out)
    return done if bytes_too else done.drop("kept")


def oracle_sql(plan: Repeats = Repeats()) -> str:
    """The same by the digest of every window."""
    n = plan.length
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT r, i, md5(b[i + 1 : i + {n}]) AS h FROM d, unnest(range(octet_length(b) - {n - 1})) AS t(i)),
    again AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    marks AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again),
    numbered AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM marks),
    gone AS (SELECT r, n, min(i) AS s, max(i) + {n} AS e FROM numbered GROUP BY ALL),
    ends AS (SELECT r, n, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY n) AS before, lead(e) OVER (PARTITION BY r ORDER BY n) AS after FROM gone),
    kept AS (
        SELECT ends.r, count(*) AS n_spans, sum(e - s) AS n_removed,
            string_agg(hex(b[before + 1 : s]) || CASE WHEN after IS NULL THEN hex(b[e + 1 : octet_length(b)]) ELSE '' END, '' ORDER BY n) AS h
        FROM ends JOIN d USING (r) GROUP BY ALL)
    SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
    FROM d LEFT JOIN kept USING (r)"""
