"""Quality rules: repetition rules, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

All of it is DataFrame work, without stored tables. A document's grams are its words and its pairs of neighbouring words (the first word's
neighbour is empty), hashed by CRC-32 to ``N_BUCKETS`` buckets. Two multinomials over the buckets are counted: one over
every document, one over the trusted documents. A document's score is the mean of the smoothed log ratio over its
grams, so that it doesn't depend on its length; every document is compared with one fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WORD, let, table, text_of, words_of

#: Buckets of the multinomials (a power of two); the weights sent to every task are as many floats (256 KB).
N_BUCKETS = 65_536
#: Trusted ids that are broadcast, at most (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Counts that pull a bucket's ratio to 1 where the trusted text has few.
SHRINK = 10.0
#: Documents with a lower mean log ratio are rejected.
THRESHOLD = -0.12


def base_columns() -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines (all long), from the columns body, words and lines (those not empty)."""
    n = lambda c: F.size(c).cast("long")
    full = F.filter("lines", lambda x: x.rlike(WORD))
    return [
        n("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(n("lines") == n(F.array_distinct("lines")), F.lit(0).cast("long")).otherwise(n(full) - n(F.array_distinct(full))).alias("n_dup_lines"),
    ]


def window_hashes(words: Column) -> Column:
    """The hashes of the 5-word windows in text order, each made of its words' hashes."""

    def hashes(x: Column) -> Column:
        at = lambda i, k: F.get(x, i + k)
        windows = F.slice(x, 1, F.greatest(F.size(x) - 4, F.lit(0)))
        return F.when(F.size(x) >= 5, F.transform(windows, lambda w, i: F.xxhash64(w, at(i, 1), at(i, 2), at(i, 3), at(i, 4)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def covered(hashes: Column) -> Column:
    """Words in windows that the text holds twice or more, from the windows' hashes in text order.

    Equal windows meet when the hashes are sorted; a repeated window adds the words up to the next one, 5 at most.
    Texts without a repeated window skip the sort.
    """
    n = F.size(hashes)
    pairs = F.sort_array(F.arrays_zip(hashes.alias("h"), F.transform(hashes, lambda _, i: i).alias("i")))
    once = F.struct(pairs.alias("p"))
    twice = F.transform(
        F.array(once),
        lambda s: F.transform(
            F.filter(
                s["p"],
                lambda x, k: (F.get(s["p"], k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(s["p"], k + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        ),
    )
    places = F.sort_array(F.get(twice, F.lit(0)))
    total = F.transform(
        F.array(F.struct(places.alias("q"))),
        lambda s: F.aggregate(
            F.transform(s["q"], lambda x, k: F.least(F.lit(5), F.coalesce(F.get(s["q"], k + 1) - x, F.lit(5)))),
            F.lit(0),
            lambda a, b: a + b,
        ),
    )
    return F.when(n == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(F.get(total, F.lit(0))).cast("long")


def bucket(checksum: Column) -> Column:
    return checksum.bitwiseAND(F.lit(N_BUCKETS - 1)).cast("int")


def checksum(word: Column, *before: Column) -> Column:
    """CRC-32 of a word, or of the word before it, a space and the word."""
    return F.crc32((F.concat(*before, F.lit(" "), word) if before else word).cast("binary"))


def pairs_of(words: Column) -> Column:
    """The checksums of the words' pairs in text order; the first word's neighbour is empty."""
    before = lambda x, i: F.when(i > 0, F.get(x, i - 1)).otherwise("")
    return let(words, lambda x: F.transform(x, lambda w, i: checksum(w, before(x, i))))


def buckets(texts: DataFrame) -> DataFrame:
    """A row with its bucket for each gram of the column words, and the column good. Compiled code, as there is no lambda in it."""
    i, words = F.col("i"), F.col("words")
    word = texts.select("good", "words", F.posexplode_outer("words").alias("i", "word")).where("word IS NOT NULL")  # not outer, Spark splits texts twice
    pair = checksum(F.col("word"), F.when(i > 0, F.get(words, i - 1)).otherwise(""))
    return word.select("good", F.explode(F.array(bucket(checksum(F.col("word"))), bucket(pair))).alias("bucket"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good (all of their labels are 1)."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select(F.col("doc_id").alias("trusted_id"))


def with_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and text of docs with trusted_id, null for what isn't trusted. Rows without doc_id are dealt by their text."""
    ids = trusted_ids(labels)
    texts, same = docs.select("doc_id", "text"), F.col("doc_id") == F.col("trusted_id")
    if ids.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(ids), same, "left")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    return texts.join(ids.withColumn("of", F.lit(0).cast("long")).hint("shuffle_hash"), same & (spread == F.col("of")), "left").drop("of")


def bucket_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``weights``, the N_BUCKETS smoothed log ratios. 0 for buckets that no text uses and where nothing is trusted."""
    texts = with_trusted(docs, labels).select(F.col("trusted_id").isNotNull().cast("long").alias("good"), words_of().alias("words"))
    counts = buckets(texts).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    unused = docs.sparkSession.range(N_BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good"))
    every = counts.union(unused).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    row = every.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("counts"), F.sum("raw").alias("all_raw"), F.sum("good").cast("double").alias("all_good")
    )
    expected = lambda x: F.coalesce(F.try_divide(x["raw"] * F.col("all_good"), F.col("all_raw")), F.lit(0.0))
    return row.select(F.transform("counts", lambda x: F.log((x["good"] + SHRINK) / (expected(x) + SHRINK)).cast("float")).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score, kept.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. A null or empty text has no words
    and fails the base rules; its score is 0. Repeated rows give repeated rows; a null doc_id is never trusted. With no
    trusted document every score is 0, and the base rules decide alone.
    """
    weights = bucket_weights(docs, labels)
    split = docs.select("doc_id", text_of().alias("body")).select(
        "doc_id", "body", words_of("body").alias("words"), F.array_remove(F.split("body", "\n"), "").alias("lines")
    )
    paired = split.select("doc_id", "words", *base_columns(), pairs_of(F.col("words")).alias("pairs"))
    # A window that the text holds before has four pairs that it holds before; other texts need no windows.
    repeats = F.size("pairs") - F.size(F.array_distinct("pairs")) >= 4
    weight = lambda w, crc: F.get(w, bucket(crc)).cast("double")
    of_words = lambda w: F.aggregate("words", F.lit(0.0), lambda a, x: a + weight(w, checksum(x)))
    total = let(F.col("weights"), lambda w: F.aggregate("pairs", of_words(w), lambda a, x: a + weight(w, x)))
    scored = paired.withColumn("weights", weights.scalar()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(repeats, window_hashes(F.col("words"))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.when(F.col("n_words") > 0, total / (2 * F.col("n_words"))).otherwise(0.0).alias("score"),
    ).withColumn("n_repeat_words", covered(F.col("windows")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"), F.round("score", 6).alias("score"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, see ``quality_rules``."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
