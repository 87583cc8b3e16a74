"""Conversation prefix trie: shared beginnings of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns; the root is the empty sequence.  A
turn is two 64-bit hashes of its role and text, keyed by its position, and a node is the
exclusive-or of its turns' hashes, so a prefix is a running total and its parent is
one exclusive-or away.  Totals run along range-partitioned, sorted rows: a task goes on
from row to row, and only the last row of each task reaches the driver, so one
conversation may span many tasks.

Subtree sums are rolled up by *depth bands*.  A node explodes to its ancestors inside
its band of ``band`` depths only.  Band roots then hold sums of their band, and form a
trie of their own, ``band`` times flatter, whose sums are found in the same way; the
completed totals of band roots go to the nodes of the band above.  So a row explodes to at
most ``band`` rows, and a trie of depth d takes ``2 * log(d) / log(band)`` rounds.  Rows
that go up along one conversation are added before they meet others, and sums combine before
the shuffle, so a first turn that all share is no hot key.

Defined results
    Rows with a null conv_id belong to no conversation and are left out.  Equal turns are ordered
    by role, then text; repeated rows are turns of their own.  An empty table gives no rows, not
    even a root.  Columns beyond conv_id, turn, role and text are ignored, whatever their names.
    Conversation ids are whole numbers; of a negative one, ``c % 5`` has its sign.
    Texts are read once, for their hashes and lengths, so their size does not matter.
    The SHA-256 of one node's ids is one stream by nature: ids are sorted and
    packed in parallel, and one task per node only hashes the packs in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellview.llm.common import store
from cellview.operators.layout import attach

NODE = ["depth", "f1", "f2"]
PACK = 4096


@dataclass(frozen=True)
class Trie:
    band: int = 16
    stride: int = 5  # a conversation begins like the one whose id is the multiple of ``stride`` at or before its own
    borrowed: int = 9  # crc32 of the id modulo this is the number of borrowed turns


def running(rows: DataFrame, group: str, order: list[str], totals: dict[str, np.ufunc], drop: list[str]) -> DataFrame:
    """Stored rows whose ``totals`` columns became running totals inside ``group`` in the given order.

    ``totals`` maps a long column to np.add or np.bitwise_xor; ``drop`` are
    columns of the order that need not be kept.
    """
    from pyspark import TaskContext

    sortable = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).drop(*drop)
    names = sortable.columns
    schema = ", ".join(f"{n} {t}" for n, t in sortable.dtypes) + ", task int, is_last boolean, first_group long"

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, begun, held = None, None, None
        task = TaskContext.get().partitionId()

        def finished(columns, last):
            n = len(columns[names.index(group)])
            flags = np.zeros(n, bool)
            flags[-1] = last
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, task, np.int32)), pa.array(flags), pa.array(np.full(n, begun))], [*names, "task", "is_last", "first_group"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(group).to_numpy()
            fresh = np.concatenate([[True], g[1:] != g[:-1]])
            heads = np.flatnonzero(fresh)
            run = np.cumsum(fresh) - 1
            begun = g[0] if begun is None else begun
            columns = list(batch.columns)
            state = {}
            for name, step in totals.items():
                x = batch.column(name).to_numpy()
                total = step.accumulate(x)
                before = total[heads] - x[heads] if step is np.add else total[heads] ^ x[heads]
                total = total - before[run] if step is np.add else total ^ before[run]
                if carried and carried[0] == g[0]:
                    total = np.where(run == 0, step(total, carried[1][name]), total)
                state[name] = total[-1]
                columns[names.index(name)] = pa.array(total)
            carried = (g[-1], state)
            if held is not None:
                yield finished(held, False)
            held = columns
        if held is not None:
            yield finished(held, True)

    stored = store(sortable.mapInArrow(advance, schema), "running")
    into, carry = [], None  # what enters each task: the group that goes on, and its totals so far
    for r in stored.where("is_last").select("task", "first_group", F.col(group).alias("g"), *totals).orderBy("task").collect():
        entering = carry[1] if carry and carry[0] == r.first_group else None
        if entering:
            into.append((r.task, r.first_group, *entering.values()))
        own = {n: np.int64(r[n]) for n in totals}
        carry = (r.g, {n: int(step(own[n], np.int64(entering[n]))) if entering and r.g == r.first_group else int(own[n]) for n, step in totals.items()})
    if not into:
        return stored.select(*names)
    # one entry per task, found by the task's number: no join
    entry = {r[0]: r for r in into}
    nothing = (None,) * (len(totals) + 1)
    rows_in = [(t, *entry.get(t, (t, *nothing))[1:]) for t in range(max(entry) + 1)]
    listed = rows.sparkSession.createDataFrame(rows_in, "task int, g long, " + ", ".join(f"{n} long" for n in totals))
    out = stored.withColumn("_in", listed.agg(F.sort_array(F.collect_list(F.struct("*")))).scalar()).withColumn("_in", F.get("_in", F.col("task")))
    for n, step in totals.items():
        more = F.when(F.col("_in.g") == F.col(group), F.col(f"_in.{n}"))
        out = out.withColumn(n, F.when(more.isNull(), F.col(n)).otherwise(F.col(n) + more if step is np.add else F.col(n).bitwiseXOR(more)))
    return out.select(*names)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, t1, t2, bytes): turns numbered from 1 inside their conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("seq"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"), F.octet_length(text).alias("bytes"),
    )
    return running(turns, "conv_id", ["turn", "role", "text"], {"seq": np.add}, ["turn", "role", "text"])


def rebuilt(turns: DataFrame, convs: DataFrame, plan: Trie) -> DataFrame:
    """(conv_id, pos, t1, t2, bytes): borrowed first turns, then the conversation's own after as many."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(plan.borrowed))
    lender = F.col("conv_id") - F.col("conv_id") % plan.stride
    lenders = convs.where(F.col("conv_id") % plan.stride == 0).select(F.col("conv_id").alias("lender"), F.col("own").alias("lent"))
    asking = convs.select("conv_id", taken.alias("taken"), lender.alias("lender")).join(lenders, "lender", "left")
    asking = store(asking.withColumn("lent", F.least("taken", F.coalesce("lent", F.lit(0)))), "borrowing")
    heads = turns.where((F.col("conv_id") % plan.stride == 0) & (F.col("seq") < plan.borrowed)).withColumnRenamed("conv_id", "lender")
    lent = asking.where("taken > 0").join(heads, "lender").where("seq <= taken").select("conv_id", F.col("seq").alias("pos"), "t1", "t2", "bytes")
    own = attach(turns, asking.select("conv_id", "taken", "lent"), ["conv_id"], asking.count()).where("seq > taken")
    return lent.unionByName(own.select("conv_id", (F.col("lent") + F.col("seq") - F.col("taken")).alias("pos"), "t1", "t2", "bytes"))


def _up(values: DataFrame, paths: DataFrame, depths: Column) -> DataFrame:
    """Sums of ``values`` at the given ancestor depths of each row, with the smallest id that went up."""
    sums = lambda: (F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    along = values.select("conv_id", F.explode(depths).alias("depth"), "leaves", "saved").groupBy("conv_id", "depth").agg(*sums())
    known = paths.select("conv_id", F.col("pos").alias("depth"), "f1", "f2")
    placed = along.join(known, ["conv_id", "depth"], "left").select("conv_id", "depth", F.coalesce("f1", F.lit(0)).alias("f1"), F.coalesce("f2", F.lit(0)).alias("f2"), "leaves", "saved")
    return placed.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), *sums())


def subtree_sums(values: DataFrame, paths: DataFrame, deepest: int, band: int, stride: int = 1) -> DataFrame:
    """(depth, f1, f2, conv_id, leaves, saved) summed over subtrees, for nodes at multiples of ``stride``."""
    height = stride * band
    depth = F.col("depth")
    inside = _up(values, paths, F.sequence((depth - depth % height).cast("long"), depth.cast("long"), F.lit(stride).cast("long")))
    if deepest < height:
        return inside
    inside = store(inside, "band")
    roots = subtree_sums(inside.where(depth % height == 0), paths, deepest, band, height)
    below = _up(roots.where("depth > 0"), paths, F.sequence((depth - height).cast("long"), (depth - stride).cast("long"), F.lit(stride).cast("long")))
    both = inside.unionByName(below).groupBy(*NODE)
    return store(both.agg(F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "band")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes where conversations end."""
    key = "depth long, f1 long, f2 long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.stack([batch.column(n).to_numpy() for n in NODE])
            ids = batch.column("conv_id").to_pylist()
            fresh = np.flatnonzero(np.concatenate([[True], (node[:, 1:] != node[:, :-1]).any(0)])) if ids else []
            rows = [(*map(int, node[:, s]), ids[s], ",".join(map(str, ids[s:e]))) for s, e in zip(fresh, [*fresh[1:], len(ids)], strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], [*NODE, "first", "pack"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        emit = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"]
        )
        for batch in batches:
            for *here, text in zip(*(batch.column(n).to_pylist() for n in (*NODE, "pack")), strict=True):
                if here != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield emit()
                done = []
        if node:
            done.append((*node, state.hexdigest()))
            yield emit()

    packed = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pack, f"{key}, first long, pack string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, plan: Trie = Trie()) -> DataFrame:
    """One row per node of conversations given as (conv_id, pos, t1, t2, bytes); ``convs`` lists every conv_id."""
    keyed = turns.select(
        "conv_id", "pos", "bytes", F.xxhash64("pos", "t1", "t2").alias("p1"), F.xxhash64("t2", "pos", "t1").alias("p2"),
    ).withColumns({"f1": F.col("p1"), "f2": F.col("p2")})
    paths = running(keyed, "conv_id", ["pos"], {"f1": np.bitwise_xor, "f2": np.bitwise_xor}, [])
    grown = paths.groupBy(F.col("pos").cast("long").alias("depth"), "f1", "f2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").cast("long").alias("bytes"),
        F.min(F.col("f1").bitwiseXOR(F.col("p1"))).alias("up1"), F.min(F.col("f2").bitwiseXOR(F.col("p2"))).alias("up2"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "conv_id", "n_convs", zero.alias("bytes"), none.alias("up1"), none.alias("up2"))
    nodes = store(grown.unionByName(root), "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")).first()

    above = (F.col("depth") - 1).alias("depth"), F.col("up1").alias("f1"), F.col("up2").alias("f2")
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    counted = store(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    values = counted.select("conv_id", *NODE, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = subtree_sums(values, paths, size.deepest or 0, plan.band).select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    # no row of ``paths`` is deeper than a conversation's end
    last = paths.groupBy("conv_id").agg(F.max("pos").cast("long").alias("depth"), F.max_by("f1", "pos").alias("f1"), F.max_by("f2", "pos").alias("f2"))
    ends = convs.select("conv_id").join(last, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in NODE))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("up1"), F.col("f2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    named = attach(counted, parents, ["depth", "up1", "up2"], size.n, "left")
    empty = hashlib.sha256(b"").hexdigest()
    whole = named.join(sums, NODE).join(end_digests(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_trie(conversations: DataFrame, plan: Trie = Trie()) -> DataFrame:
    """The trie of conversations rebuilt with borrowed first turns."""
    turns = numbered_turns(conversations)
    convs = store(turns.groupBy("conv_id").agg(F.max("seq").alias("own")), "conversations")
    return trie(rebuilt(turns, convs, plan), convs, plan)


def oracle_sql(plan: Trie = Trie()) -> str:
    """The same by comparing prefixes as texts; crc32 is spelt out bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    return f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, conv_id - conv_id % {plan.stride} AS lender, ({crc}) % {plan.borrowed} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
        SELECT c.conv_id, 0 AS own, seq, role, text FROM convs c JOIN turns t ON c.lender = t.conv_id AND seq <= h
        UNION ALL SELECT conv_id, 1, seq, role, text FROM convs JOIN turns USING (conv_id) WHERE seq > h),
    keyed AS (SELECT conv_id, own, seq, strlen(text) AS bytes, md5(strlen(role) || ':' || role || text) AS t FROM rebuilt),
    paths AS (
        SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(t, '') OVER w AS key FROM keyed
        WINDOW w AS (PARTITION BY conv_id ORDER BY own, seq)
        UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY ALL),
    children AS (SELECT left(key, (depth - 1) * 32) AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    counted AS (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN children USING (key, depth)),
    sums AS (
        SELECT p.key, p.depth, count(*) FILTER (kids = 0) AS n_leaves, sum((n_convs - 1) * n.bytes) AS saved
        FROM counted n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL),
    tops AS (SELECT conv_id, max(depth) AS depth, max_by(key, depth) AS key FROM paths GROUP BY ALL),
    ends AS (SELECT key, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM tops GROUP BY ALL)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.kids AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
        coalesce(h, sha256('')) AS ends_sha256
    FROM counted n JOIN sums USING (key, depth) LEFT JOIN ends USING (key, depth)
    LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.key = left(n.key, (n.depth - 1) * 32)"""
