"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of a label form one class.  Each class vector gets a sketch: one sign
bit per random hyperplane.  A pass permutes the bits, sorts the sketches of a label
lexicographically by them and compares each with its next ``window`` neighbours;
neighbours whose sketches differ in at most ``most_bits`` bits are candidates.  The
window slides over task borders: the end of a range goes on to the next one.

Candidates of all passes are united into groups.  Inside a group every pair is
verified by cosine in double precision, in tiles of bounded size, so the links of a
group are whole however many members it has; only sums and spanning links leave a
tile.  Components follow from verified links alone.

Recall: a pair at cosine 0.93 differs in one sign of 8.4, a pair at 0.98 in one of
16.  With 16 passes and windows of 64 the chance to miss a pair of two vectors at
0.98 is below 1e-5 in a label of 5,000 vectors and 2e-3 in one of 5 million (one
pass finds it with 0.94 ** log2(rows / 64)).  tests/llm measures it.

Defined results: a vector that is null, empty, all zero or holds null or non-finite
numbers, and one with a null label, links with nothing (component_id = vec_id,
kept).  Vectors of another length than their neighbour's never link with it.  Rows
that share a vec_id are one node of the graph.  A null vec_id gives null
component_id, links with nothing and is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm.common import components, store


@dataclass(frozen=True)
class Passes:
    cosine: float = 0.93
    passes: int = 16
    window: int = 64
    bits: int = 256  # of a sketch, a multiple of 64
    most_bits: int = 56  # expected 30.6 at cosine 0.93, deviation 5.2
    tile: int = 1024
    seed: int = 11


def _planes(plan: Passes, dims: int) -> np.ndarray:
    return np.random.default_rng([plan.seed, dims]).standard_normal((dims, plan.bits)).astype(np.float32)


def _sketches(classes: DataFrame, plan: Passes) -> DataFrame:
    """One row per class and pass: label, dims, sort key, sketch."""

    def run(batches):
        orders = [np.random.default_rng([plan.seed, k]).permutation(plan.bits)[:64] for k in range(plan.passes)]
        for batch in batches:
            lengths = np.array(batch.column("dims").to_pylist(), dtype=np.int64)
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                x = np.array(part.column("embedding").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
                x = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
                signs = x @ _planes(plan, int(dims)) > 0
                sketch = np.packbits(signs, axis=1)
                for k, order in enumerate(orders):
                    key = np.packbits(signs[:, order], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(x), k, np.int32)), part.column("label"), part.column("dims"), part.column("cls"),
                            pa.array([r.tobytes() for r in key], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary()),
                        ],
                        names=["pass", "label", "dims", "cls", "key", "sketch"],
                    )

    return classes.select("label", "dims", "cls", "embedding").mapInArrow(
        run, "pass int, label bigint, dims int, cls bigint, key binary, sketch binary"
    )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b), for 0 .. n - 1."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


_COUNTS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _neighbour_groups(sorted_rows: DataFrame, plan: Passes, borders: bool) -> DataFrame:
    """Edges (a, b) that span the candidates of each task's window run.

    With ``borders`` the first and last ``window`` rows of a task come out too, under
    the number of the seam between it and its neighbour task.
    """

    def run(batches):
        part, rest, left_out = TaskContext.get().partitionId(), None, plan.window
        for batch in batches:
            fresh = batch.to_pandas()
            if not len(fresh):
                continue
            if borders and left_out:
                yield _seam_rows(fresh.head(left_out), part)
                left_out -= min(left_out, len(fresh))
            rows = fresh if rest is None else pd.concat([rest, fresh], ignore_index=True)
            sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
            run_of = rows[["seam", "pass", "label", "dims"]].to_numpy()
            same_run = np.concatenate([[0], np.cumsum((run_of[1:] != run_of[:-1]).any(axis=1))])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, min(plan.window, len(rows) - 1) + 1):
                at = np.flatnonzero(same_run[step:] == same_run[:-step])
                near = _COUNTS[sketch[at] ^ sketch[at + step]].sum(axis=1, dtype=np.int32) <= plan.most_bits
                left.append(at[near])
                right.append(at[near] + step)
            rest = rows.tail(plan.window)
            root = _roots(len(rows), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(rows)))
            ids = rows["cls"].to_numpy()
            out = pd.DataFrame({"seam": None, **{c: None for c in _ORDER}, "sketch": None, "a": ids[moved], "b": ids[root[moved]]})
            yield pa.RecordBatch.from_pandas(out, _ARROW, preserve_index=False)
        if borders and rest is not None:
            yield _seam_rows(rest, part + 1)

    return sorted_rows.mapInArrow(run, _BORDER)


_ORDER = ["pass", "label", "dims", "key", "cls"]
_BORDER = "seam int, pass int, label bigint, dims int, key binary, cls bigint, sketch binary, a bigint, b bigint"
_ARROW = pa.schema(
    [
        ("seam", pa.int32()), ("pass", pa.int32()), ("label", pa.int64()), ("dims", pa.int32()), ("key", pa.binary()),
        ("cls", pa.int64()), ("sketch", pa.binary()), ("a", pa.int64()), ("b", pa.int64()),
    ]
)


def _seam_rows(rows: pd.DataFrame, seam: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(rows.assign(seam=seam, a=None, b=None)[_ARROW.names], _ARROW, preserve_index=False)


def candidate_groups(classes: DataFrame, plan: Passes) -> DataFrame:
    """(node, component) of classes that meet a candidate in some pass."""
    rows = _sketches(classes, plan).withColumn("seam", F.lit(0))
    ranged = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = store(_neighbour_groups(ranged, plan, True), "passes")
    seams = found.where("seam IS NOT NULL").drop("a", "b").repartition("seam").sortWithinPartitions("seam", *_ORDER)
    edges = found.where("a IS NOT NULL").select("a", "b").unionByName(_neighbour_groups(seams, plan, False).select("a", "b"))
    return components(edges)


def _tile_links(plan: Passes):
    """Per member of a tile: copies linked in it; and links that span its verified pairs."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["block", "cls"], ignore_index=True)
        x = np.stack(tile["embedding"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        n, copies = len(tile), tile["copies"].to_numpy()
        linked = x @ x.T >= plan.cosine
        np.fill_diagonal(linked, False)
        cross = tile["ti"].iat[0] != tile["tj"].iat[0]
        if cross:  # pairs inside one block belong to the block's own tile
            block = tile["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        count = linked.astype(np.int64) @ copies
        a, b = np.nonzero(np.triu(linked))
        root = _roots(n, a, b)
        ids = tile["cls"].to_numpy()
        return pd.DataFrame({"cls": ids, "n": count, "root": ids[root]})

    return run


def near_duplicates(vectors: DataFrame, plan: Passes = Passes()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # equal vectors are found by two hashes, so the vectors are shuffled once
    keyed = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64("embedding", "label", F.lit(1)))
    keys = ["label", "h1", "h2"]
    classes = store(
        keyed.where("usable").groupBy(*keys)
        .agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("dims", F.size("embedding")),
        "vector-classes",
    )
    groups = store(candidate_groups(classes, plan), "vector-groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(
        "component", F.ceil(F.col("size") / plan.tile).cast("int").alias("blocks")
    )
    members = (
        classes.join(groups.withColumnRenamed("node", "cls"), "cls").join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "cls", "copies", "embedding")
    )
    tiles = store(
        members.groupBy("component", "ti", "tj").applyInPandas(_tile_links(plan), "cls bigint, n bigint, root bigint"), "tiles"
    )
    counts = tiles.groupBy("cls").agg(F.sum("n").alias("n"))
    joined = components(tiles.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select(*keys, "cls", "copies").join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
        .select(*keys, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    )
    out = keyed.select("vec_id", "usable", *keys).join(of_class.withColumn("usable", F.lit(True)), [*keys, "usable"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
