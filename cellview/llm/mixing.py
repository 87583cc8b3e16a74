"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents are put into a keyed order (MD5 of the doc_id) and cut into
blocks.  Target weights are whole units; a round is as many slots as all units
together, and a source with u units owns u blocks of a round of M slots.  Its k-th
block of the round is released at floor(k * M / u) and due at ceil((k + 1) * M / u); the
slots go to the released block with the earliest deadline.  At every slot each source
is then less than one block away from its exact share, in the round and, as every round
is exact, in the whole sequence.

All rounds in which the same sources still have the same number of blocks follow one
pattern.  Patterns change only where a source runs dry (at most twice per source), so
a block's slot follows from its number alone and blocks of all rounds are placed in
parallel.  Once a source has run dry, the others share the slots by their weights.
Every document is placed exactly once.

Numbering: a source is split by the first digits of the key; each part is numbered by
itself and starts where the counts of the parts before it end, so a source with a
third of all rows is spread over ``16 ** digits`` parts.

Without given targets a source's units follow the square root of its size, which
raises small sources; each gets one unit at least.

Defined results: a null source is the source '(none)'; a row with a null doc_id is keyed by its
text; rows that repeat a doc_id get places of their own, equal ones in any order; sources without
documents and given targets take no slots; sources without a target get one unit.  Columns of
``docs`` called source_block, slot or block_offset are replaced; others have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellview.llm.common import store


@dataclass(frozen=True)
class Mix:
    block_rows: int = 16
    round_slots: int = 100  # about; the sum of the units
    digits: int = 2  # of the key, that split a source


def schedule(docs: DataFrame, targets: DataFrame | None = None, plan: Mix = Mix(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those to ``keep``) with source_block, slot and block_offset; ``targets``: (source, units)."""
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns) if c not in ("source_block", "slot", "block_offset")]
    # without an id the text spreads the rows
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    keyed = docs.select(
        F.struct(*kept).alias("row"), F.xxhash64("text").alias("mix_text"), F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("mix_source"),
        F.md5(id_text).alias("mix_key"),
    )
    keyed = keyed.withColumn("mix_part", F.substring("mix_key", 1, plan.digits))

    parts = store(keyed.groupBy("mix_source", "mix_part").agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    earlier = F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("mix_source", "mix_part", F.coalesce(earlier, F.lit(0)).alias("start"))

    sources = parts.groupBy("mix_source").agg(F.sum("n").alias("n"))
    if targets is None:
        total = sources.agg(F.sum(F.sqrt("n")).alias("roots"))
        roots = total.first().roots or 1.0
        sources = sources.withColumn("units", F.greatest(F.lit(1), F.round(F.lit(float(plan.round_slots)) * F.sqrt("n") / F.lit(roots))).cast("bigint"))
    else:
        given = targets.select(F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("mix_source"), F.col("units").cast("bigint").alias("units"))
        sources = sources.join(given.groupBy("mix_source").agg(F.max("units").alias("units")), "mix_source", "left")
        sources = sources.withColumn("units", F.greatest(F.lit(1), F.coalesce("units", F.lit(1))))
    sources = store(sources.withColumn("blocks", F.expr(f"(n + {plan.block_rows - 1}) div {plan.block_rows}")), "mix-sources")

    # ---- rounds in which all sources have the same number of blocks
    # (one row that holds all sources; their number is bounded by the catalogue of sources)
    gathered = (
        sources.agg(F.sort_array(F.collect_list(F.struct("mix_source", "units", "blocks"))).alias("s"))
        .select("s", F.expr("array_distinct(flatten(transform(s, x -> array(0L, x.blocks div x.units, x.blocks div x.units + 1))))").alias("breaks"))
        .select("s", "breaks", F.explode("breaks").alias("round"))
        .select(
            "round",
            F.expr("filter(transform(s, x -> named_struct('mix_source', x.mix_source, 'm', least(x.units, x.blocks - round * x.units))), o -> o.m > 0)").alias("owners"),
            F.expr("aggregate(s, 0L, (n, x) -> n + least(x.blocks, round * x.units))").alias("slots_before"),
            F.expr("array_min(filter(breaks, x -> x > round))").alias("until"),
        )
        .withColumn("slots", F.expr("aggregate(owners, 0L, (n, o) -> n + o.m)"))
        .where("slots > 0")
        .repartition("round")
    )
    fold = """aggregate(sequence(0L, slots - 1),
      named_struct('done', transform(owners, o -> 0L), 'picked', cast(array() AS array<int>)),
      (state, t) -> element_at(transform(array(array_min(filter(transform(owners, (o, i) ->
          CASE WHEN state.done[i] < o.m AND (state.done[i] * slots) div o.m <= t
               THEN named_struct('due', ((state.done[i] + 1) * slots + o.m - 1) div o.m, 'i', i) END), c -> c IS NOT NULL)).i),
        p -> named_struct('done', transform(state.done, (x, i) -> CASE WHEN i = p THEN x + 1 ELSE x END), 'picked', concat(state.picked, array(p)))), 1)).picked"""
    picked = gathered.withColumn("picked", F.expr(fold))
    turn = F.row_number().over(Window.partitionBy("round", "mix_source").orderBy("place")) - 1
    pattern = store(
        picked.select("round", "slots", "slots_before", "until", "owners", F.posexplode("picked").alias("place", "i"))
        .select("round", "slots", "slots_before", F.coalesce("until", F.lit(2**62)).alias("until"), F.expr("owners[i].mix_source").alias("mix_source"), "place")
        .withColumn("turn", turn),
        "mix-pattern",
    )

    # ---- number every document inside its source, then place its block
    numbered = keyed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("mix_source", "mix_part").orderBy("mix_key", "mix_text")) - 1
    )
    small = starts.join(sources.select("mix_source", "units"), "mix_source")
    placed = (
        numbered.join(F.broadcast(small) if _few(parts) else small, ["mix_source", "mix_part"])
        .withColumn("rank", F.col("rank") + F.col("start"))
        .withColumn("source_block", F.expr(f"rank div {plan.block_rows}"))
        .withColumn("block_offset", F.col("rank") % plan.block_rows)
        .withColumn("turn", F.col("source_block") % F.col("units"))
        .withColumn("own_round", F.expr("source_block div units"))
    )
    joined = placed.join(F.broadcast(pattern) if _few(pattern) else pattern, ["mix_source", "turn"]).where("own_round >= round AND own_round < until")
    return joined.select(
        "row.*", F.col("source_block").cast("bigint").alias("source_block"),
        (F.col("slots_before") + (F.col("own_round") - F.col("round")) * F.col("slots") + F.col("place")).cast("bigint").alias("slot"),
        F.col("block_offset").cast("bigint").alias("block_offset"),
    )


def _few(df: DataFrame, most: int = 200_000) -> bool:
    """At most ``most`` rows of about 100 bytes, so that a broadcast is bounded."""
    return df.count() <= most


def oracle_sql(plan: Mix = Mix()) -> str:
    """The same rows in DuckDB's SQL; the slots of a round are handed out by recursion."""
    b = plan.block_rows
    return f"""WITH RECURSIVE keyed AS (SELECT doc_id, coalesce(source, '(none)') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS rnk FROM keyed),
sizes AS (SELECT s, count(*) AS n FROM keyed GROUP BY s),
src AS (SELECT s, CAST(greatest(1, round({float(plan.round_slots)} * sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes))) AS BIGINT) AS units, (n + {b - 1}) // {b} AS blocks FROM sizes),
begins AS (SELECT DISTINCT unnest([0, blocks // units, blocks // units + 1]) AS j FROM src),
own AS (SELECT j, s, least(units, blocks - j * units) AS m FROM begins JOIN src ON j * units < blocks),
tot AS (SELECT j, CAST(sum(m) AS BIGINT) AS slots FROM own GROUP BY j),
bef AS (SELECT j, CAST(sum(least(blocks, j * units)) AS BIGINT) AS before FROM begins, src GROUP BY j),
lists AS (SELECT j, slots, list(s ORDER BY s) AS ss, list(m ORDER BY s) AS ms FROM own JOIN tot USING (j) GROUP BY j, slots),
edf AS (
  SELECT j, slots, ss, ms, CAST(0 AS BIGINT) AS t, list_transform(ms, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick FROM lists
  UNION ALL
  SELECT j, slots, ss, ms, t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(ms) + 1), lambda i: CASE WHEN done[i] < ms[i] AND (done[i] * slots) // ms[i] <= t
      THEN (((done[i] + 1) * slots + ms[i] - 1) // ms[i]) * 1000000 + i END), lambda c: c IS NOT NULL)) % 1000000 AS p
    FROM edf WHERE t < slots)),
pat AS (SELECT j, slots, ss[pick] AS s, t - 1 AS place, row_number() OVER (PARTITION BY j, pick ORDER BY t) - 1 AS turn FROM edf WHERE pick IS NOT NULL),
ends AS (SELECT j, lead(j) OVER (ORDER BY j) AS until FROM begins),
placed AS (SELECT doc_id, s, rnk // {b} AS blk, rnk % {b} AS off, units FROM numbered JOIN src USING (s))
SELECT doc_id, placed.s AS source, CAST(blk AS BIGINT) AS source_block, CAST(before + (blk // units - pat.j) * slots + place AS BIGINT) AS slot, CAST(off AS BIGINT) AS block_offset
FROM placed JOIN pat ON pat.s = placed.s AND pat.turn = blk % units JOIN ends ON ends.j = pat.j JOIN bef ON bef.j = pat.j
WHERE blk // units >= pat.j AND (until IS NULL OR blk // units < until)"""
