"""Sharding by longest processing time: groups that stay together go, largest first, to the least loaded shard.

The groups are as many as the distinct texts, so no task and no driver sees them all. Their sizes fall into classes of
1/128 of a power of two, at most some thousands whatever the table's size, and only the classes' counts and sums go to
the driver. There the heap deals whole classes, largest first: groups of one class are of one size, so what the heap
would do with them one by one is known (each shard is filled to a common level, and the last few go one by one). The
result is a quota of groups for each class and shard; groups take their places in it by rank. Ranks and slots are
counted in salted buckets, whose offsets are summed first, so that a class or a shard of any size is many tasks.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored, table, text_of

SHARDS = 40
#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: Size classes for each doubling of the size.
CLASSES = 128
#: Rows in a bucket in which ranks are counted, on average.
BUCKET_ROWS = 4096


def ranked(df: DataFrame, by: list[str], salt: Column, order: list[str], out: str) -> DataFrame:
    """df with the gapless rank from 0 of each row in its group ``by``, in the order of the salt, then of ``order``.

    Each (group, salt) is ranked by itself and starts at the sum of the buckets before it.
    """
    salted = df.withColumn("_salt", salt)
    counts = salted.groupBy(*by, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*by, "_salt").orderBy(*order)
    rows = salted.withColumn("_own", F.row_number().over(own) - 1)
    return rows.join(starts, [*by, "_salt"]).withColumn(out, (F.col("_start") + F.col("_own")).cast("long")).drop("_salt", "_start", "_own")


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, shard, first rank, end rank) of the groups of each class; classes: (class, groups, bytes).

    Classes go largest mean first. Equal groups of mean size m fill the shards to the level that n of them reach: a
    shard of load x gets floor((level - x) / m) of them, and the heap deals those left.
    """
    loads, out = [0.0] * shards, []
    for k, n, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        mean = total / n
        got = [0] * shards
        low, high = min(loads), max(loads) + mean * (n / shards + 2)
        fill = lambda level: [max(0, math.floor((level - x) / mean)) for x in loads]
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(fill(mid)) <= n else (low, mid)
        got = fill(low)
        heap = [(loads[i] + got[i] * mean, i) for i in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (load + mean, i))
        at = 0
        for i in range(shards):
            loads[i] += got[i] * mean
            if got[i]:
                out.append((k, i, at, at + got[i]))
                at += got[i]
    return out


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows with shard (from 0) and slot (gapless from 0 in each shard).

    rows needs group_key, size (long, over 0) and row_key (orders the rows of a shard); rows of one group_key share a
    shard. The table is read several times: pass a stored one. Groups are spread even where one holds most of the bytes
    (its shard then exceeds the mean). Rows alike in all of these may change places. An empty table stays empty.
    """
    spark = rows.sparkSession
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    groups = stored(groups.withColumn("class", F.floor(F.log2(F.col("bytes").cast("double")) * CLASSES).cast("int")), "groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()  # some thousands at most
    dealt = deal([(r["class"], r["n"], r["b"]) for r in histogram], shards)
    quotas = spark.createDataFrame(dealt, "class int, shard int, first long, end long")
    buckets = lambda n: max(1, math.ceil(n / BUCKET_ROWS))
    salt = lambda n, key: F.pmod(F.xxhash64(key), F.lit(buckets(n)))
    n_groups = sum(r["n"] for r in histogram)
    placed = ranked(groups, ["class"], salt(n_groups, "group_key"), ["group_key"], "rank")
    lists = quotas.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    found = F.get(F.filter("ends", lambda x: x["end"] > F.col("rank")), F.lit(0))["shard"]
    home = placed.join(F.broadcast(lists), "class").select("group_key", found.alias("shard"))
    with_shard = rows.join(home, "group_key")
    return ranked(with_shard, ["shard"], salt(rows.count(), "row_key"), ["row_key", "size"], "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row; rows of equal text share a shard. Null texts count as empty.

    A text's key is its 64-bit hash, its CRC and its length. Repeated rows and null ids are rows like others.
    """
    body = F.encode(text_of(), "UTF-8")
    crc, size = F.crc32(body), (F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")) + ROW_BYTES).cast("long")
    key = F.struct(F.xxhash64(text_of()).alias("h"), crc.alias("c"), size.alias("n"))
    slim = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("group_key"), F.struct("doc_id", F.xxhash64(text_of()).alias("h")).alias("row_key"))
    return shard(stored(slim, "sizes"), shards)


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated ids included, see ``shard_documents``: the law is ``bytes``."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
