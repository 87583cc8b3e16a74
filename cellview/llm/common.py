"""Shared pieces: table access, keyed folds, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellview.session import discard, fresh_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of 1,000 rows unless the session sets a size itself.

    Ten thousand documents, Spark's own size, are tens of MB per copy of a batch.
    """
    if df.sparkSession.conf.get(BATCH) == "10000":
        df.sparkSession.conf.set(BATCH, "1000")
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def fold_of(column, folds: int):
    """crc32 of the id's text modulo ``folds``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def forget(stored: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    discard(stored.sparkSession, stored.scratch_path)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: one row ``(node, component)`` per node
    that has an edge, with the smallest node of its component.

    Alternates large-star and small-star steps.  Each is a minimum per node
    (combined before the shuffle) and one join, so a hub is never gathered; the
    forest of each round is stored in the shared folder.  Edges with a null end
    are dropped.  The driver sees two numbers per round.
    """
    e = store(_oriented(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hooks = large.join(small, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = store(_oriented(hooks.unionByName(small.select("a", F.col("m").alias("b")))), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(e)
        e = after
        if state == before or not state[0]:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
