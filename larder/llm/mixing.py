"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources share ``budget`` x all words by weight; a target stops at ``most`` x its source's size and the
   excess is reshared by weight until none is above.
2. Quotas: the mix is cut into blocks of ``block_tokens`` words. Sources, then groups of ``group`` shards of each source,
   then the shards of each group get whole blocks by the highest quotients votes / (2 j - 1). A task ranks a group's shards,
   or a source's groups; no task has all shards of a source.
3. Selection: the documents of a shard lie on a ring in seeded hash order. The shard's quota is taken as whole rounds
   plus one seeded run of consecutive blocks, so that every word is taken floor or ceil of quota / size times.

Shards have about ``shard_tokens`` words, so that a source with a third of all rows is spread over many tasks. A document's
shard is a hash of its doc_id and text, so null and equal ids are spread too; rows with equal doc_id and text are dealt out
by their place in the written table of sizes where there are more than ``most_copies`` of them.
Nulls: a null text has size 0 and takes 0 words, as any text without words, without a place on a ring; a null source is a source of its own and comes last, null doc_ids are documents like any
other. Repeated rows are documents of their own; equal
quotients go to the lesser source or shard. Very long texts are one document, of which a run may take a part. No rows give
no rows. Without any word all targets and taken counts are 0. Other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, broadcast_if_small, ranked, saved, with_unique


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """Adds ``target`` to one row a source with ``source_size`` and ``weight``.

    With the level x = money left / weight left, a source is held at its cap when x * weight is above it. The level
    only rises from round to round; two numbers a round come to the driver.
    """
    cap, total = F.col("source_size") * F.lit(float(most)), sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = F.lit(level) * F.col("weight") > cap
        left, weight = sources.agg(F.sum(F.when(held, -cap).otherwise(0.0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))).first()
        new = (budget * total + (left or 0.0)) / weight if weight else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def quotients(rows: DataFrame, votes: str, seats: str, among: list[str]) -> DataFrame:
    """The seats that highest quotients may still decide: at most two a row.

    For any divisor d, sum(round(votes / d)) differs from sum(votes) / d by at most half the number of rows. So the
    divisors total / (seats -+ rows / 2) enclose the right one: ``sure`` seats are won for certain, those in
    sure + 1 .. ``high`` compete.
    """
    w = Window.partitionBy(*among)
    total, n = F.sum(votes).over(w), F.count(F.lit(1)).over(w)
    rows = rows.withColumns({"_total": total.cast("double"), "_n": n})
    seat = lambda d: F.floor(F.col(votes) * d / F.col("_total") + 0.5)
    none = (F.col("_total") <= 0) | (F.col(seats) <= 0)
    low, high = F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0.0)), F.col(seats) + F.col("_n") / 2
    return rows.withColumns({"sure": F.when(none, 0).otherwise(F.when(low > 0, seat(low)).otherwise(0)).cast("long"), "high": F.when(none, 0).otherwise(seat(high)).cast("long")}).drop("_total", "_n")


def competing(rows: DataFrame, votes: str) -> DataFrame:
    up = rows.where("high > sure").withColumn("_j", F.explode(F.expr("sequence(sure + 1, high)")))
    return up.withColumn("_q", F.col(votes) / (2 * F.col("_j") - 1))


def apportioned(rows: DataFrame, votes: str, seats: str, among: list[str], key: str, name: str) -> DataFrame:
    """Adds ``name``: the seats that each row of a group ``among`` gets of the group's ``seats``; ties go to the lesser ``key``."""
    cells = saved(quotients(rows, votes, seats, among), "mix-cells")
    best = Window.partitionBy(*among).orderBy(F.desc("_q"), key, "_j")
    sure = cells.groupBy(*among).agg(F.sum("sure").alias("_sure"))
    won = competing(cells, votes).withColumn("_place", F.row_number().over(best)).join(sure, among)
    won = won.where(F.col("_place") <= F.col(seats) - F.col("_sure")).groupBy(*among, key).agg(F.count(F.lit(1)).alias("_won"))
    return cells.join(won, [*among, key], "left").withColumn(name, F.col("sure") + F.coalesce("_won", F.lit(0))).drop("sure", "high", "_won")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, block_tokens: int = 64, shard_tokens: int = 1 << 18, group: int = 4096, most_copies: int = 1000, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, source_blocks, shard, taken: a row for each row of ``docs``."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    sizes = saved(sizes, "mix-sizes")

    by_source = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"), name="sid")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    sources = saved(source_targets(by_source.withColumn("weight", weight), budget, most), "mix-sources")
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    blocks = round(words / block_tokens)

    # Blocks of each source. Sources are few against documents; still their order comes from a distributed rank.
    n, total = sources.count(), words or 1.0
    low, high = max(blocks - n / 2, 0.0), blocks + n / 2
    bounds = sources.withColumns({"sure": F.floor(F.col("target") * low / total + 0.5) if low > 0 else F.lit(0), "high": F.floor(F.col("target") * high / total + 0.5) if blocks else F.lit(0)})
    bounds = saved(bounds.withColumns({c: F.col(c).cast("long") for c in ("sure", "high")}), "mix-bounds")
    open_seats = max(0, blocks - (bounds.agg(F.sum("sure")).first()[0] or 0))
    won = ranked(competing(bounds, "target").select("sid", "_q", "_j"), F.desc("_q"), F.asc("sid"), F.asc("_j"), name="_place").where(F.col("_place") < open_seats).groupBy("sid").agg(F.count(F.lit(1)).alias("_won"))
    quotas = saved(bounds.join(won, "sid", "left").select("source", "sid", "source_size", "target", (F.col("sure") + F.coalesce("_won", F.lit(0))).alias("source_blocks")), "mix-quotas")

    # Shards of each source in groups, and their blocks.
    by_source = quotas.withColumn("_source", F.struct("source")).drop("source")  # a null source is a source like any other
    dealt = with_unique(sizes.withColumn("_source", F.struct("source")), by_source, "_source").drop("_source")
    same = ["doc_id", "hash"]
    crowded = saved(sizes.groupBy(*same).count().where(F.col("count") > most_copies).select(*(F.col(c).alias(f"_{c}") for c in same)), "mix-copies")
    if crowded.isEmpty():
        copy = F.lit(None).cast("bigint")
    else:
        crowded = broadcast_if_small(crowded.withColumn("_many", F.lit(True)))
        dealt = dealt.join(crowded, dealt["doc_id"].eqNullSafe(crowded["_doc_id"]) & (dealt["hash"] == crowded["_hash"]), "left")
        copy = F.when(F.col("_many"), F.col("row"))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1))
    dealt = dealt.withColumn("_at", F.xxhash64(F.lit(seed), "doc_id", "hash")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "hash", copy), shards))
    dealt = dealt.withColumn("_group", F.floor(F.col("shard") / group))
    groups = dealt.groupBy("sid", "_group").agg(F.sum("size").alias("group_size"), F.first("source_blocks").alias("source_blocks"))
    groups = apportioned(groups, "group_size", "source_blocks", ["sid"], "_group", "group_blocks").select("sid", "_group", "group_blocks")
    cells = dealt.groupBy("sid", "_group", "shard").agg(F.sum("size").alias("cell_size")).join(groups, ["sid", "_group"])
    cells = apportioned(cells, "cell_size", "group_blocks", ["sid", "_group"], "shard", "blocks").select("sid", "shard", "cell_size", "blocks")

    # Seeded selection: whole rounds, then one run of blocks on the ring.
    cells = cells.withColumn("_quota", F.least(F.col("blocks") * block_tokens, F.floor(F.col("cell_size") * F.lit(float(most)))))
    ring = F.greatest("cell_size", F.lit(1))
    cells = cells.withColumn("_rounds", F.floor(F.col("_quota") / ring)).withColumn("_rest", F.col("_quota") - F.col("_rounds") * F.col("cell_size"))
    cells = cells.withColumn("_from", F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), F.ceil(ring / block_tokens)) * block_tokens)
    w = Window.partitionBy("sid", "shard").orderBy("_at", "doc_id", "size")
    # Rows without words take none; they are in no ring, or they would all lie in the few shards that words call for.
    placed = dealt.where("size > 0").withColumn("_end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("size"))
    placed = placed.join(cells, ["sid", "shard"])
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_start"), a))
    stop = F.col("_from") + F.col("_rest")
    taken = F.col("_rounds") * F.col("size") + over(F.col("_from"), stop) + over(F.lit(0), stop - F.col("cell_size"))
    out = ["doc_id", "source", "size", "source_size", "target", "source_blocks", "shard"]
    return placed.select(*out, taken.cast("long").alias("taken")).unionByName(dealt.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))
