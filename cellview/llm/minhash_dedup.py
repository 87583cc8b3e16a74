"""MinHash near-dedup by an inverted join of signature coordinates.

1. One pass over the texts gives each document its set of word shingles (64-bit
   hashes), a 128-bit fingerprint of the set and a signature of ``coordinates``
   minima.  Documents with equal sets form one class; only its representative
   (smallest doc_id) goes on, so a group of copies costs one row.
2. Representatives are posted under each (coordinate, value).  A document that
   shares fewer than ``matches`` postings with anybody is skipped.  Of the others
   only the rarest postings are merged (prefix): two documents that agree in
   ``matches`` coordinates meet in one of them.
3. Full sets are read for the remaining documents.  A document whose shingles
   occur elsewhere too rarely to reach the similarity is skipped, exactly; parity
   bitmaps of the sets bar pairs that differ too much before they are made.
4. A star round pairs the members of a posting list with the list's most shared
   member; a second round pairs members that are still in different components.
   Pairs that collide in ``matches`` coordinates are confirmed on full sets.

Pairs inside a component need no test, as only components are returned; so a
large group of near copies costs a star, not all its pairs.  The second round
compares what the star round left apart, without a cap.

Signature loss: a pair at the very threshold of 0.85 agrees in fewer than 28 of 48
coordinates with a chance of 2e-6; at 0.9 of 1e-9.

Defined results: null or blank texts have no shingles and link with nothing;
rows with a null doc_id link with nothing, have a null component and are kept;
different texts that share a doc_id are nodes of their own, each with its own component, and
equal ones are one node; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm import words as W
from cellview.llm.common import components, free_name, store, text_batches
from cellview.operators.layout import BROADCAST_ROWS, attach


@dataclass(frozen=True)
class NearDedup:
    shingle_words: int = 3
    percent: int = 85  # 100 * intersection >= percent * union
    coordinates: int = 48
    matches: int = 28


def _sets(plan: NearDedup, batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per slice: first and last row, shingles by text, their bounds, fingerprints."""
    for t in W.tokens(batch.column("text")):
        h, owner = W.distinct(*W.windows(t, plan.shingle_words))
        bounds = np.searchsorted(owner, np.arange(t.rows + 1))
        sums = []
        for seed in (1, 2):
            running = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(W.mix(h + np.uint64(seed)), out=running[1:])
            sums.append((running[bounds[1:]] - running[bounds[:-1]]).view(np.int64))
        yield t.first, t.last, h, bounds, sums


def _signatures(h: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each of ``k`` hash functions per text, 32 bits each; empty texts: 0."""
    out = np.zeros((len(bounds) - 1, k), dtype=np.int32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        starts = bounds[:-1][some]
        for c in range(k):
            # multiply-add, upper half: enough spread on hashes that are mixed already
            factor = np.uint64(int(W.mix(np.array([2 * c + 1], dtype=np.uint64))[0]) | 1)
            value = ((h * factor) ^ (h >> np.uint64(29))) * factor >> np.uint64(32)
            out[some, c] = np.minimum.reduceat(value, starts).astype(np.uint32).view(np.int32)
    return out


def sketches(docs: DataFrame, plan: NearDedup) -> DataFrame:
    """doc_id, n_shingles, fingerprint (fa, fb) and signature of every row."""

    def run(batches):
        for batch in batches:
            for first, last, h, bounds, (fa, fb) in _sets(plan, batch):
                sig = _signatures(h, bounds, plan.coordinates)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, sig.size + 1, plan.coordinates, dtype=np.int32)), pa.array(sig.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array(np.diff(bounds).astype(np.int64)), pa.array(fa), pa.array(fb), flat],
                    names=["doc_id", "n", "fa", "fb", "sig"],
                )

    return text_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, fa bigint, fb bigint, sig array<int>"
    )


PARITY_WORDS = 8
_PARITY = [f"b{i}" for i in range(PARITY_WORDS)]


def full_sets(docs: DataFrame, plan: NearDedup) -> DataFrame:
    """doc_id, fingerprint, its sorted shingle hashes and a parity bitmap of them.

    Each shingle flips one of 512 bits.  Bits in which two bitmaps differ are at most as
    many as shingles that only one document has, so they bound the similarity exactly.
    """

    def run(batches):
        for batch in batches:
            for first, last, h, bounds, (fa, fb) in _sets(plan, batch):
                flat = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                parity = np.zeros((last - first, PARITY_WORDS), dtype=np.uint64)
                slot = W.mix(h + np.uint64(3))
                at = np.repeat(np.arange(last - first), np.diff(bounds)), ((slot >> np.uint64(6)) % np.uint64(PARITY_WORDS)).astype(np.int64)
                np.bitwise_xor.at(parity, at, np.uint64(1) << (slot & np.uint64(63)))
                words = [pa.array(np.ascontiguousarray(parity[:, i]).view(np.int64)) for i in range(PARITY_WORDS)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(fa), pa.array(fb), flat, *words], names=["first_id", "fa", "fb", "shingles", *_PARITY])

    return text_batches(docs).mapInArrow(run, "first_id bigint, fa bigint, fb bigint, shingles array<bigint>, " + ", ".join(f"{b} bigint" for b in _PARITY))


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: NearDedup) -> DataFrame:
    """Pairs (a, b) that collide often enough and reach the similarity on full sets."""
    side = lambda s: sets.select(F.col("rep").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("shingles").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    collisions = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda hit: hit))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    return (
        both.where(collisions >= plan.matches)
        .withColumn("shared", shared)
        .where(F.lit(100) * F.col("shared") >= F.lit(plan.percent) * union)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, plan: NearDedup = NearDedup()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketched = store(sketches(docs, plan), "sketches")
    usable = sketched.where("n > 0 AND doc_id IS NOT NULL")
    # an id that several rows have names no single text: its classes go by a hash of their set instead
    repeated = store(usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("first_id")), "repeated-ids")
    n_repeated = repeated.count()
    grouped = usable.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    if n_repeated:
        marked = attach(grouped, repeated.withColumn("shared_id", F.lit(True)), ["first_id"], n_repeated, "left")
        own = -F.pmod(F.xxhash64("fa", "fb", "n"), F.lit(1 << 62)) - F.lit(2)
        classes = store(marked.withColumn("rep", F.when(F.col("shared_id"), own).otherwise(F.col("first_id"))).drop("shared_id"), "classes")
    else:
        classes = store(grouped.withColumn("rep", F.col("first_id")), "classes")

    # ---- postings under (coordinate, value); only values that occur twice can collide
    posted = classes.select("rep", F.posexplode("sig").alias("coordinate", "value")).select(
        "rep", (F.shiftleft(F.col("coordinate").cast("bigint"), 32) + (F.col("value").cast("bigint") + F.lit(2**31))).alias("key")
    )
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # at most ``coordinates`` postings per document are gathered
    merged = (
        posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"))
        .where(F.size("p") >= plan.matches)
        .select("rep", F.slice("p", 1, F.size("p") - plan.matches + 1).alias("p"))
    )
    merged = store(merged, "prefixes")

    # ---- full sets of what is left, and how many of their shingles occur elsewhere
    asked = merged.join(classes.select("rep", F.col("first_id").alias("doc_id")), "rep").select("doc_id") if n_repeated else merged.select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n_repeated:  # of rows with one id, each text once
        twice = attach(texts, repeated.select(F.col("first_id").alias("doc_id"), F.lit(True).alias("shared_id")), ["doc_id"], n_repeated, "left")
        once = twice.where("shared_id").dropDuplicates(["doc_id", "text"])
        texts = twice.where("shared_id IS NULL").unionByName(once).drop("shared_id")
    chosen = texts.join(asked.distinct(), "doc_id", "left_semi")
    keys = ["first_id", "fa", "fb"]
    found = full_sets(chosen, plan).join(classes.select(*keys, "rep", "sig"), keys).drop(*keys)
    if n_repeated:  # texts under one id may have equal sets
        found = found.dropDuplicates(["rep"])
    sets = store(found, "sets")
    single = sets.select("rep", F.explode("shingles").alias("s"))
    elsewhere = single.groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    lonely = elsewhere.groupBy("rep").agg(F.count(F.lit(1)).alias("lonely"))
    bounds = (
        sets.select("rep", F.size("shingles").alias("n"), *_PARITY).join(lonely, "rep", "left")
        .select("rep", "n", *_PARITY, (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("u"))
        .where(F.lit(100) * F.col("u") >= F.lit(plan.percent) * F.col("n"))
    )
    # partner sizes that a document can reach the similarity with
    p = plan.percent
    lists = store(
        merged.join(bounds, "rep").select("rep", "n", "u", *_PARITY, F.explode("p").alias("p"))
        .select("rep", F.col("p.key").alias("key"), "n", "u", *_PARITY)
        .withColumn("low", F.expr(f"ceil({p} * n / 100)"))
        .withColumn("high", F.expr(f"floor(((100 + {p}) * u - {p} * n) / {p})")),
        "lists",
    )
    reach = "least(u, u_) * 100 >= {p} * (n + n_ - least(u, u_)) AND n_ BETWEEN low AND high".format(p=p)
    differ = " + ".join(f"bit_count({b} ^ {b}_)" for b in _PARITY)
    reach += f" AND {100 + p} * ({differ}) <= {100 - p} * (n + n_)"

    # ---- star round: each list's most shared member against the others
    pivots = lists.groupBy("key").agg(
        F.max(F.struct((F.col("u") / F.col("n")).alias("share"), (-F.col("rep")).alias("rep"), "n", "u", *_PARITY)).alias("x"), F.count(F.lit(1)).alias("c")
    ).where("c > 1").select("key", (-F.col("x.rep")).alias("rep_"), F.col("x.n").alias("n_"), F.col("x.u").alias("u_"), *[F.col(f"x.{b}").alias(f"{b}_") for b in _PARITY])
    starred = (
        lists.join(pivots, "key").where(f"rep <> rep_ AND {reach}")
        .select(F.least("rep", "rep_").alias("a"), F.greatest("rep", "rep_").alias("b")).distinct()
    )
    links = store(_confirmed(starred, sets, plan), "links")
    grouped = components(links)

    # ---- members of a list that are still apart; the list's largest component is one side only
    placed = lists.join(grouped.select(F.col("node").alias("rep"), F.col("component").alias("own")), "rep", "left").withColumn(
        "own", F.coalesce("own", "rep")
    )
    placed = store(placed, "placed")
    counted = placed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most"))
    mixed = counted.groupBy("key").agg(
        F.max(F.struct("c", "own")).alias("top"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least"), F.max("most").alias("most")
    ).where("parts > 1").select("key", F.col("top.own").alias("main"), "least", "most")
    able = placed.join(mixed, "key").where("high >= least AND low <= most")
    other = able.select("key", *[F.col(c).alias(f"{c}_") for c in ("rep", "n", "u", "own", "low", "high", *_PARITY)])
    apart = (
        able.where("own <> main").join(other, "key")
        .where(f"own <> own_ AND {reach} AND n BETWEEN low_ AND high_")
        .select(F.least("rep", "rep_").alias("a"), F.greatest("rep", "rep_").alias("b")).distinct()
    )
    all_links = links.unionByName(_confirmed(apart, sets, plan))
    final = components(all_links)

    placed = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if n_repeated:  # components go by their smallest doc_id again
        least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
        of_class = attach(placed, least, ["component"], BROADCAST_ROWS + 1).select("fa", "fb", "n", "component_id")
    else:
        of_class = placed.select("fa", "fb", "n", F.col("component").alias("component_id"))
    return (
        sketched.join(of_class, ["fa", "fb", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, plan: NearDedup = NearDedup()) -> DataFrame:
    """``docs`` without near copies: of each group the rows with the smallest doc_id stay.

    If several rows have that doc_id, each of their different texts stays once, so no text is
    lost to another under its id.  Rows with a null doc_id stay.  Columns may have any names.
    """
    key, text = free_name(docs, "kept_id"), free_name(docs, "text_key")
    kept = near_duplicates(docs, plan).where("kept").select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    rows = docs.withColumn(key, F.col("doc_id").cast("bigint")).withColumn(text, F.xxhash64("text"))
    named = rows.join(kept, key, "left_semi").dropDuplicates([key, text])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.select(*columns).unionByName(docs.where("doc_id IS NULL"))
