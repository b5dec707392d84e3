"""Line dedup: lines that an earlier line of any document equals, or nearly equals, are removed.

Lines are sequences of words. A line with a word goes if an earlier line has the same words; a line of MIN_NEAR words or
more (one word is a third of a shorter line) also goes if an earlier line is one word's insertion, deletion or
replacement away. Earlier is by doc_id, then the text's hash, then line number.

Near lines are found by deletion neighbourhoods: a line's variants are the line itself and the line without each of its
words, as hashed keys. A line and another that lacks one of its words share a key; two lines that differ in one word
share a key and the place of the deletion. The first line of a key is the match of all others, so a key of any size
costs no pairs. Matches are verified by edit distance.

Only lines that can have a neighbour emit variants: two lines one word apart share either the first or the last half of
their words, so lines that share neither half with another line are left out first, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import let, partitions, plain_white, scratch, stored, table, text_of

#: Words of a line that near matches are looked for.
MIN_NEAR = 4
#: Ids that are broadcast to filter a table, at most (8 MB); more go through a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents whose lists of lines are broadcast, at most (with 8 lines each on average, some 30 MB); more are joined by a shuffle.
BROADCAST_LISTS = 250_000
BATCH_KEYS = 1 << 18

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def numbered(ids: DataFrame) -> DataFrame:
    """doc_id, text_key, number: the distinct rows of ids (doc_id, text_key), numbered from 0 by both, null ids last.

    Rows are cut into ranges, which are numbered each from the sum of those before.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_key")]
    ranged = ids.distinct().repartitionByRange(partitions(ids.sparkSession), *order).select("*", F.spark_partition_id().alias("part"))
    ranged = stored(ranged, "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(starts), "part").select("doc_id", "text_key", (F.col("start") + F.col("own")).alias("number"))


def placed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with text_key and base: a number that, plus a line's number, orders all lines and is one line's only.

    It is the id times the longest text where every row has an id of its own, else the number among all documents. It
    is a long if the largest one lets it, else a decimal: one pass over ids and lengths decides.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("m"))
    r = by_id.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("n").alias("n"), F.sum("n").alias("all"), F.max("m").alias("m"), F.max(F.col("doc_id").isNull()).alias("nameless")).first()
    most, number, largest = (r["m"] or 0) + 2, F.col("doc_id").cast("long"), max(abs(r["a"] or 0), abs(r["b"] or 0))
    if (r["n"] or 0) > 1 or r["nameless"]:
        numbers = numbered(rows.select("doc_id", "text_key")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "number")
        rows = rows.join(numbers, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_key"] == F.col("_key")))
        number, largest = F.col("number"), r["all"]
    kind = "long" if (largest + 1) * most < 2**62 else "decimal(38,0)"
    return rows.select("doc_id", "text", "text_key", (number.cast(kind) * F.lit(most).cast(kind)).cast(kind).alias("base"))


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, text_key, line_no, place, words of the lines with ``least`` words or more; docs are placed."""
    kind = docs.schema["base"].dataType
    lines = F.posexplode(F.split(plain_white(text_of()), "\n")).alias("line_no", "line")
    split = docs.select("doc_id", "text_key", "base", lines).withColumn("place", (F.col("base") + F.col("line_no")).cast(kind))
    worded = split.select("doc_id", "text_key", "line_no", "place", F.array_remove(F.split("line", " "), "").alias("words"))
    return worded.where(F.size("words") >= least)


def keyed(docs: DataFrame) -> DataFrame:
    """place, key (k1, k2: 128 bits of the words), n, and for lines that take part in near matches their halves' hashes.

    With n words a line shares (n - 1) / 2 words rounded up with one of its length or longer, (n - 2) / 2 with a shorter.
    """
    n = F.size("words")
    half = lambda c, k: F.when(n >= MIN_NEAR, F.xxhash64(F.lit(k), c))
    head, tail = lambda c: F.slice("words", F.lit(1), c), lambda c: F.slice("words", n - c + 1, c)
    one, two = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return lines_of(docs, 1).select(
        "doc_id", "text_key", "line_no", "place", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("b"), "words").alias("k2"),
        F.when(
            n >= MIN_NEAR,
            F.array(
                F.xxhash64(F.lit("head"), n, head(one)), F.xxhash64(F.lit("head"), n - 1, head(two)),
                F.xxhash64(F.lit("tail"), n, tail(one)), F.xxhash64(F.lit("tail"), n - 1, tail(two)),
            ),
        ).alias("halves"),
    )


def variants(words: np.ndarray) -> np.ndarray:
    """The hashes of a line (last) and of the line without its first, second, ... word, from its words' hashes."""
    with np.errstate(over="ignore"):
        n = len(words)
        power = np.empty(n + 1, U)
        power[0] = 1
        power[1:] = np.multiply.accumulate(np.full(n, BASE, U))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(words * power[:n], dtype=U)])
        return np.append(sums[:-1] + (sums[-1] - sums[1:]) * INVERSE, sums[-1])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word's insertion, deletion or replacement makes a into b (or they are equal)."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return True
    k = differ[0]
    return bool(np.array_equal(a[k + 1 :], b[k + 1 :]) if len(a) == len(b) else np.array_equal(a[k:], b[k + 1 :]))


def longs(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pa.compute.list_value_length(column).to_pylist()])
    return [flat[a:b].view(U) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def variant_rows(lines: DataFrame) -> DataFrame:
    """(key, at, place) of each variant of each line (place, hashes, head, tail); at is -1 for the whole line.

    head, tail: whether the line shares its first or last half with another one. Where it shares only one, the words in
    that half stay: a neighbour differs in the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, words, sides = batch.column(0), longs(batch.column(1)), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            keys, at, of, n = [], [], [], 0
            for i, (w, (head, tail)) in enumerate(zip(words, sides, strict=True)):
                same = (len(w) - 1) // 2
                cut = np.arange(0 if tail else same, len(w) if head else len(w) - same)
                keys.append(variants(w)[np.append(cut, -1)])
                at.append(np.append(cut, -1))
                of.append(np.full(len(cut) + 1, i))
                n += len(cut) + 1
                if n >= BATCH_KEYS or i + 1 == len(words):
                    columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), places.take(pa.array(np.concatenate(of)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "place"])
                    keys, at, of, n = [], [], [], 0

    return lines.select("place", "hashes", "head", "tail").mapInArrow(run, lines.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("at"), "place").schema)


def near_matches(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(place, match): the distinct lines of firsts (doc_id, place, halves) that an earlier one nearly equals."""
    halves = firsts.where("halves IS NOT NULL").select("place", F.posexplode("halves").alias("kind", "half"))
    # Of two lines one word apart, one at least has the half as one of its own length's.
    shared = halves.groupBy("half").agg(F.count("*").alias("n"), F.max(F.col("kind") % 2 == 0).alias("own")).where("n > 1 AND own").select((F.col("half") + 0).alias("half"))
    lines = halves.join(shared, "half", "left_semi").groupBy("place").agg(F.max(F.col("kind") < 2).alias("head"), F.max(F.col("kind") >= 2).alias("tail"))
    lines = stored(lines, "lines")
    ids = stored(lines.join(firsts.select((F.col("place") + 0).alias("place"), "doc_id"), "place").select("doc_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    same = docs.doc_id.eqNullSafe(ids.doc_id)
    of_lines = lines_of(docs.join(F.broadcast(ids) if few else ids, same, "left_semi"), MIN_NEAR).select("place", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # The hashes of the lines' words are read twice: for their variants, and to verify matches.
    hashed = stored(of_lines.join(F.broadcast(lines) if lines.count() <= BROADCAST_IDS else lines, "place"), "hashed")
    rows = variant_rows(hashed)
    whole, cut = F.col("at") < 0, F.col("at") >= 0
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(whole, F.col("place"))).alias("whole"), F.min(F.when(cut, F.col("place"))).alias("cut"))
    keys = keys.where("n > 1").select((F.col("key") + 0).alias("key"), "whole", "cut")
    met = stored(rows.join(keys, "key"), "met")
    spots = met.where(cut).groupBy("key", "at").agg(F.min("place").alias("spot")).select((F.col("key") + 0).alias("key"), (F.col("at") + 0).alias("at"), "spot")
    earliest = F.when(whole, F.col("cut")).otherwise(F.least("spot", "whole"))
    found = met.join(spots, ["key", "at"], "left").select("place", earliest.alias("match")).where("match < place")
    found = found.groupBy("place").agg(F.min("match").alias("match"))
    both = found.join(hashed.select("place", F.col("hashes").alias("a")), "place").join(hashed.select(F.col("place").alias("match"), F.col("hashes").alias("b")), "match")
    both = both.select("place", "match", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [near(x, y) for x, y in zip(longs(batch.column(2)), longs(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, found.select("place", "match").schema).groupBy("place").agg(F.min("match").alias("match"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, dead (sorted numbers from 0 of the lines to remove) and n_near of each document with any."""
    docs = placed(docs)
    lines = stored(keyed(docs), "lines")
    firsts = lines.groupBy("k1", "k2").agg(F.min("place").alias("first")).select((F.col("k1") + 0).alias("k1"), (F.col("k2") + 0).alias("k2"), "first")
    tied = lines.select("k1", "k2", "place", "doc_id", "text_key", "line_no").join(firsts, ["k1", "k2"]).drop("k1", "k2")
    tied = stored(tied.select("doc_id", "text_key", "line_no", "place", F.when(F.col("place") != F.col("first"), F.col("first")).alias("first")), "tied")
    distinct = lines.select("place", "doc_id", "halves").where("halves IS NOT NULL").join(tied.where("first IS NULL").select("place").distinct(), "place", "left_semi")
    match = stored(near_matches(docs, distinct.dropDuplicates(["place"])), "match").select(F.col("place").alias("own"), "match")
    exact = F.col("first").isNotNull()
    dead = tied.join(match, F.coalesce("first", "place") == F.col("own"), "left").where(exact | F.col("match").isNotNull())
    dead = dead.select("doc_id", "text_key", "line_no", exact.alias("exact")).distinct()
    return dead.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line_no")).alias("dead"), F.count(F.when(~F.col("exact"), 1)).alias("n_near"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text, and the counts n_lines, n_removed, n_near (long).

    Every row and every other column is kept; columns named like the counts are replaced. Null texts stay null and have
    no lines; a text whose lines all go becomes empty; lines without a word stay. Rows alike in doc_id and text
    are one document (none of them counts as earlier than the other). Rows with one doc_id and different texts are different
    documents, by a hash of their text. Rows without doc_id come last, by a hash of their text.
    """
    added = ["n_lines", "n_removed", "n_near"]
    kept = docs.drop(*added)
    with scratch("dead"):
        dead = repeated_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_dead_id"), F.col("text_key").alias("_dead_key"), F.col("dead").alias("_dead"), F.col("n_near").alias("_near"))
        dead = stored(dead, "dead")
    size = dead.agg(F.count("*").alias("n"), F.sum(F.size("_dead")).alias("m")).first()
    few = size["n"] <= BROADCAST_LISTS and (size["m"] or 0) <= 8 * BROADCAST_LISTS
    both = kept.join(F.broadcast(dead) if few else dead, kept["doc_id"].eqNullSafe(F.col("_dead_id")) & (F.xxhash64(kept["text"]) == F.col("_dead_key")), "left")
    lines = F.split(kept["text"], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dead"))
    text = F.when(F.col("_dead").isNull(), kept["text"]).otherwise(F.array_join(let(lines, lambda x: F.transform(left, lambda i: F.get(x, i))), "\n"))
    n = F.when(kept["text"].isNull(), 0).otherwise(F.size(lines)).cast("long")
    return both.select(
        *[text.alias(c) if c == "text" else kept[c] for c in kept.columns], n.alias("n_lines"),
        F.coalesce(F.size("_dead"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, see ``dedup_lines``."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
