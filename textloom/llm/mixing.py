"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Every source gets a target: its weight's share of all words, at most ``max_repeat`` times its own words; what is
   cut off is shared again by weight among the others until no target is above its limit.
2. A source's documents are dealt to shards by a seeded hash, about ``docs_per_shard`` to a shard, so that a source
   with a third of all rows is many shards. The words of a shard, in the seeded order of its documents, are cut into
   equal blocks of about ``block_words`` words.
3. Block seats are given by highest quotient votes / (2 seats + 1), first to the sources, then in each source to its
   shards: integer quotas for every shard that add up exactly to the source's.
4. A shard with ``q`` seats over ``n`` blocks takes each block ``q div n`` times, and ``q mod n`` neighbouring blocks
   from a seeded start, round the end, once more. A document takes the words of its blocks.

Highest quotients need no list of all seats: with n parties, M seats and share s, a party's seats lie between
s (M - n/2) - 1/2 and s (M + n/2) + 1/2. The seats below the lower bound are given outright, and only the few seats
between the bounds are ranked. Everything is DataFrame work, and no row meets all the rows of its source in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, stored, table, word_count

SEED = "mix-1"
#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 32
DOCS_PER_SHARD = 1024
#: Sources that are broadcast, at most (some 10 MB).
BROADCAST_SOURCES = 100_000


def seeded(part: str, *columns: Column) -> Column:
    """A 32-bit number from the MD5 of the seed, a name and the columns; SQL engines agree on it."""
    whole = F.concat_ws("|", F.lit(f"{SEED}:{part}"), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long")


def seats(parties: DataFrame, by: list[str], of: list[str], votes: str, total: str, out: str) -> DataFrame:
    """Sainte-Laguë seats: in each group ``by``, ``total`` seats go to the parties ``of`` by their ``votes``.

    Equal quotients go by the order of ``of``, then of the seat. Parties without votes get none.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(F.when(F.col(votes) > 0, 1)).over(group)
    counted = parties.select(*by, *of, votes, total, n.alias("_n"), F.sum(votes).over(group).alias("_v")).where(F.col(votes) > 0)
    share = F.col(votes) / F.col("_v")
    low = F.greatest(F.lit(0), F.floor(share * (F.col(total) - F.col("_n") / 2) - 1.5)).cast("long")
    high = F.ceil(share * (F.col(total) + F.col("_n") / 2) + 1.5).cast("long")
    bounds = counted.select("*", low.alias("_low"), high.alias("_high"))
    bounds = bounds.withColumn("_rest", F.col(total) - F.sum("_low").over(group))
    ranked = bounds.select("*", F.explode(F.sequence("_low", "_high")).alias("_seat")).withColumn(
        "_rank", F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_seat") + 1)).desc(), *of, "_seat"))
    )
    return ranked.groupBy(*by, *of).agg(
        (F.first("_low") + F.count(F.when(F.col("_rank") <= F.col("_rest"), 1))).alias(out)
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source_key, no_source, source_size, target: one row per source. A source without words has target 0.

    The limits bind for the sources with the smallest limit per weight; a running sum in that order finds them in one
    pass over the sources (one row each).
    """
    order = Window.partitionBy(F.lit(0)).orderBy("no_source", "source_key")
    which = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (which + 1).cast("int")).cast("long"))
    all_, rest = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(
        F.col("source_size") / F.col("weight"), "no_source", "source_key"
    )
    before = rest.rowsBetween(Window.unboundedPreceding, -1)
    summed = weighted.select(
        "*",
        F.sum("source_size").over(all_).alias("_total"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
        F.coalesce(max_repeat * F.sum("source_size").over(before), F.lit(0)).alias("_capped"),
    )
    free = (F.col("_total") - F.col("_capped")) * F.col("weight")
    bound = free >= max_repeat * F.col("source_size") * F.col("_weights")
    # The first source that isn't bound fixes the level of all after it.
    level = summed.select("*", bound.alias("_bound")).select(
        "*",
        F.min(F.when(~F.col("_bound"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), "no_source", "source_key", "_total", "_capped", "_weights"))).over(all_).alias("_first"),
    )
    at = F.struct((F.col("source_size") / F.col("weight")).alias("o"), "no_source", "source_key")
    start = F.struct(F.col("_first.o").alias("o"), F.col("_first.no_source").alias("no_source"), F.col("_first.source_key").alias("source_key"))
    shared = ((F.col("_first._total") - F.col("_first._capped")) * F.col("weight")).cast("double") / F.col("_first._weights")
    target = F.when(F.col("_first").isNull() | (at < start), (max_repeat * F.col("source_size")).cast("double")).otherwise(shared)
    return level.select("source_key", "no_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the part taken once more: extra_from, extra_to (words, from 0).

    docs needs doc_id, source and size (words, null as 0). One row comes back for each row. A null source is a source
    of its own, after all others. Rows alike in doc_id and size may change places, which changes nothing. Documents
    without words take none. An empty table gives an empty table.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("no_source"), size.alias("size"))
    key = ["no_source", "source_key"]
    # One row a source: while those are few, the rows aren't shuffled by source, which may be hot.
    sources = stored(rows.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "sources")
    shards_of = sources.select(*key, F.ceil(F.col("_rows") / docs_per_shard).alias("_shards"))
    few = sources.count() <= BROADCAST_SOURCES
    dealt = rows.join(F.broadcast(shards_of) if few else shards_of, key).select(
        *key, "doc_id", "size", F.pmod(seeded("shard", F.col("doc_id")), F.col("_shards")).alias("shard"), seeded("order", F.col("doc_id")).alias("_order")
    )
    shards = dealt.groupBy(*key, "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("blocks", F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words))).otherwise(0).cast("long"))
    per_source = shards.groupBy(*key).agg(F.sum("blocks").alias("blocks"), F.sum("shard_size").alias("_words"))
    aimed = targets(sources.drop("_rows"), weights, max_repeat)
    # A source's votes are the blocks of its own length that its target holds.
    votes = aimed.join(per_source, key).withColumn("votes", F.when(F.col("_words") > 0, F.col("target") * F.col("blocks") / F.col("_words")).otherwise(0.0))
    votes = votes.withColumn("_seats", F.round(F.sum("votes").over(Window.partitionBy(F.lit(0)))).cast("long"))
    quotas = seats(votes, [], key, "votes", "_seats", "quota").join(per_source, key)
    quotas = quotas.select(*key, F.least(F.col("quota"), max_repeat * F.col("blocks")).alias("quota"))
    by_shard = seats(shards.join(quotas, key), key, ["shard"], "blocks", "quota", "seats")
    plan = shards.join(by_shard, [*key, "shard"]).select(
        *key, "shard", "shard_size", "blocks", F.least(F.col("seats"), max_repeat * F.col("blocks")).alias("seats"),
        F.pmod(seeded("start", F.col("source_key"), F.col("no_source").cast("int"), F.col("shard")), F.col("blocks")).alias("first"),
    )
    edge = lambda block: F.expr(f"(({block}) * shard_size) div blocks")
    plan = plan.select(
        *key, "shard", F.expr("seats div blocks").alias("times"), "shard_size",
        edge("first").alias("from1"), edge("least(blocks, first + seats % blocks)").alias("to1"),
        edge("greatest(0, first + seats % blocks - blocks)").alias("to2"),
    )
    place = Window.partitionBy(*key, "shard").orderBy("_order", "doc_id", "size")
    placed = dealt.withColumn("_end", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("_end") - F.col("size")
    clip = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(begin, a))
    taken = placed.join(plan, [*key, "shard"], "left").select(
        "doc_id", "size", *key, F.coalesce("times", F.lit(0)).alias("times"),
        F.coalesce(clip(F.col("from1"), F.col("to1")) + clip(F.lit(0), F.col("to2")), F.lit(0)).alias("extra"),
    )
    return taken.join(F.broadcast(aimed) if few else aimed, key).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, stored: the texts are read once."""
    return stored(docs.select("doc_id", "source", word_count().alias("size")), "sizes")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns unchanged; a part taken counts from half of a document on.

    Rows that share a doc_id (or have none) come as often as the most taken of them. Documents without words go.
    """
    taken = mix(sized(docs)).where("size > 0").select("doc_id", F.round(F.col("taken") / F.col("size") + 1e-9).cast("int").alias("times"))
    taken = taken.groupBy("doc_id").agg(F.max("times").alias("times")).where("times > 0").select(F.col("doc_id").alias("_id"), "times")
    both = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("_id"))).where(F.coalesce(docs["text"], F.lit("")).rlike(WORD))
    return both.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).drop("_copy")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, see ``mix``."""
    return mix(sized(table(spark, sf_dir, "documents")))
