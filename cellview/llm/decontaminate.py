"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, lower-cased.  A mask of span 8 keeps five of
eight neighbouring words and ignores three, so a seed survives substitutions at the
ignored places.  Items and documents are hashed at every word and joined on the hash.
The four masks together hit every window the rule below allows: any one substitution
in 8 or 9 words, any two in 10 to 13 (enumerated in the tests), at any offset in the
document.  Fewer masks of this weight do not.  A hit fixes how the item lies on the
document; along that diagonal the words are compared one by one, and the item counts
as contained if some window of 13 words (or the whole item, if shorter) has at least
80 % equal words.  Substituted words cost no more than their own place.

Seeds of the documents never shuffle while the benchmark has at most
``broadcast_seeds`` seeds (28 bytes each); beyond that the join shuffles both sides.
Only documents with a hit are read again for the comparison.

Defined results: null and empty texts contain nothing; items of fewer than 8 words
are too short for a mask and match nothing; rows with a null doc_id are tested
too and reported under a null doc_id; repeated rows are reported once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellview.llm.common import free_name, store


@dataclass(frozen=True)
class SpacedSeeds:
    masks: tuple[str, ...] = ("11110100", "11101001", "10111001", "01001111")
    stride: int = 1
    window: int = 13
    percent: int = 80
    broadcast_seeds: int = 1_000_000

    @property
    def span(self) -> int:
        return len(self.masks[0])


def row_key(df: DataFrame):
    """Hash of doc_id and text, so that different texts under one id are told apart."""
    return F.xxhash64(df["doc_id"].cast("bigint"), df["text"].cast("string"))


def _words(column):
    """Hashes of the words of a text."""
    parts = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeded(df: DataFrame, plan: SpacedSeeds, stride: int) -> DataFrame:
    """A row per mask and ``stride``-th word of the array ``w``: the other columns, place ``p`` and ``seed``.

    Places are rows before they are hashed: Spark compiles that, but not functions inside arrays.
    """
    kept = [[i for i, c in enumerate(m) if c == "1"] for m in plan.masks]
    n = F.size("w")
    at = F.when(n >= plan.span, F.sequence(F.lit(0), n - plan.span, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    seeds = F.array(*[F.xxhash64(F.lit(k), *[F.get("w", F.col("p") + o) for o in os]) for k, os in enumerate(kept)])
    others = [c for c in df.columns if c != "w"]
    return df.select(*others, "w", F.explode(at).alias("p")).select(*others, "p", F.explode(seeds).alias("seed"))


def contained_items(docs: DataFrame, items: DataFrame, plan: SpacedSeeds = SpacedSeeds()) -> DataFrame:
    """One row per document and item it contains: key, doc_id, item_id, window_equal, equal_words.

    ``window_equal``: most equal words in a window; ``equal_words``: most on one diagonal.
    """
    source = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    item_words = store(items.where("item_id IS NOT NULL").select("item_id", _words(F.col("text").cast("string")).alias("iw")), "items")
    item_seeds = store(
        _seeded(item_words.select("item_id", F.size("iw").alias("item_n"), F.col("iw").alias("w")), plan, 1).select("seed", "item_id", "item_n", F.col("p").alias("ip")),
        "item-seeds",
    )
    small = item_seeds.count() <= plan.broadcast_seeds
    near = F.broadcast if small else (lambda df: df)

    probes = _seeded(source.select("key", _words(F.col("text")).alias("w")), plan, plan.stride)
    hits = (
        probes.join(near(item_seeds), "seed")
        .select("key", "item_id", "item_n", (F.col("p") - F.col("ip")).alias("shift"))
        .distinct()
    )
    hits = store(hits.groupBy("key").agg(F.collect_list(F.struct("item_id", "item_n", "shift")).alias("hits")), "hits")

    # ---- compare along each diagonal
    again = source.join(hits.select("key"), "key", "left_semi").select("key", "doc_id", _words(F.col("text")).alias("w"))
    cut = F.transform(
        "hits",
        lambda h: F.struct(
            h["item_id"].alias("item_id"), h["item_n"].alias("item_n"), F.greatest(-h["shift"], F.lit(0)).alias("skip"),
            F.slice("w", F.greatest(h["shift"], F.lit(0)) + 1, h["item_n"] + F.least(h["shift"], F.lit(0))).alias("part"),
        ),
    )
    laid = again.join(hits, "key").select("key", "doc_id", F.explode(cut).alias("h")).select("key", "doc_id", "h.*").where(F.size("part") > 0)
    same = F.zip_with("part", F.slice("iw", F.col("skip") + 1, F.size("part")), lambda a, b: F.when(a == b, 1).otherwise(0))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    wide = F.least(F.lit(plan.window), F.col("item_n"))
    starts = F.when(F.size("same") >= wide, F.sequence(F.lit(1), F.size("same") - wide + 1)).otherwise(F.array().cast("array<int>"))
    compared = (
        laid.join(near(item_words), "item_id").select("key", "doc_id", "item_id", "item_n", same.alias("same"))
        .select(
            "key", "doc_id", "item_id", wide.alias("wide"), add(F.col("same")).alias("equal_words"),
            F.array_max(F.transform(starts, lambda s: add(F.slice("same", s, wide)))).alias("window_equal"),
        )
        .where(F.col("window_equal") * 100 >= F.col("wide") * plan.percent)
    )
    return compared.groupBy("key", "doc_id", "item_id").agg(
        F.max("window_equal").cast("bigint").alias("window_equal"), F.max("equal_words").cast("bigint").alias("equal_words")
    )


def clean_documents(docs: DataFrame, items: DataFrame, plan: SpacedSeeds = SpacedSeeds()) -> DataFrame:
    """Documents that contain no item, with their columns, whatever these are called.

    A null or empty text contains nothing and stays; different texts under one id are judged apart; repeated rows
    share their fate.
    """
    found = store(contained_items(docs, items, plan).select("key").distinct(), "contaminated")
    key = free_name(docs, "key")
    return docs.withColumn(key, row_key(docs)).join(found.withColumnRenamed("key", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(plan: SpacedSeeds = SpacedSeeds()) -> str:
    """The same rows in DuckDB's SQL; seeds are the words themselves."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

    def seeds(source: str, cols: str, stride: int) -> str:
        parts = []
        for k, m in enumerate(plan.masks):
            word = " || ' ' || ".join(f"w[p + {i + 1}]" for i, c in enumerate(m) if c == "1")
            parts.append(
                f"SELECT {cols}, p, '{k} ' || {word} AS seed FROM (SELECT *, unnest(range(0, len(w) - {plan.span - 1}, {stride})) AS p FROM {source} WHERE len(w) >= {plan.span})"
            )
        return " UNION ALL ".join(parts)

    return f"""WITH d AS (SELECT DISTINCT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS ({seeds('d', 'doc_id, w', plan.stride)}), bs AS ({seeds('i', 'item_id, w', 1)}),
h AS (SELECT DISTINCT ds.doc_id, ds.w AS dw, bs.item_id, bs.w AS iw, ds.p - bs.p AS shift FROM ds JOIN bs USING (seed)),
c AS (SELECT doc_id, item_id, least({plan.window}, len(iw)) AS wide,
  list_transform(range(greatest(-shift, 0), least(len(iw), len(dw) - shift)), lambda j: CASE WHEN iw[j + 1] = dw[j + shift + 1] THEN 1 ELSE 0 END) AS same FROM h),
r AS (SELECT doc_id, item_id, wide, list_sum(same) AS equal_words,
  list_max(list_transform(range(1, len(same) - wide + 2), lambda s: list_sum(list_slice(same, s, s + wide - 1)))) AS window_equal FROM c WHERE len(same) >= wide)
SELECT doc_id, item_id, CAST(max(window_equal) AS BIGINT) AS window_equal, CAST(max(equal_words) AS BIGINT) AS equal_words
FROM r WHERE window_equal * 100 >= wide * {plan.percent} GROUP BY doc_id, item_id"""
