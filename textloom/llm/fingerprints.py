"""Document fingerprints by order MinHash.

A text's k-mers are its runs of K_WORDS words, each numbered by its occurrence, so that repeats count. Their hashes fall
into BINS bins; for each bin in use the PICKS smallest from its start on (of the bins that follow, where it has fewer) are
selected, put back in text order and hashed as a tuple. The tuples by bin are the signature: the share of equal ones
falls with the edit distance, also where only the order differs, in short texts too.

Everything is DataFrame work on one row at a time: hashes are sorted with the position in their low bits, and runs of
equal hashes give the occurrence numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import let, partitions, table, text_of, words_of

#: Words of a k-mer, bins (a power of two), k-mers selected from a bin.
K_WORDS, BINS, PICKS = 3, 64, 2
BIN_BITS = BINS.bit_length() - 1
#: Bits of a packed number that hold the position: no array is longer.
PLACE_BITS = 31
#: Bytes of text in a range of neighbouring documents, about.
RANGE_BYTES = 16 << 20


def kmer_hashes(words: Column) -> Column:
    """The hashes of the k-mers in text order; all words are one k-mer if they are fewer, none without words."""
    n = F.size(words)
    rest = lambda i: [F.get(words, i + k) for k in range(1, K_WORDS)]
    whole = F.transform(F.slice(words, 1, F.greatest(n - (K_WORDS - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *rest(i)))
    return F.when(n >= K_WORDS, whole).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def packed(h: Column, place: Column) -> Column:
    """The high bits of a hash with a position in the low ones."""
    return F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def numbered(hashes: Column) -> Column:
    """Packed hashes of (k-mer, occurrence number), unsorted. Texts without repeats skip the numbering."""
    plain = F.transform(hashes, lambda h, i: packed(F.xxhash64(h, F.lit(0)), i))
    run = lambda x: F.shiftright(x, PLACE_BITS)

    def repeats(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (run(F.get(s, i)) != run(F.get(s, F.greatest(i - 1, F.lit(0))))))
        numbers = let(begins, lambda b: F.flatten(F.transform(b, lambda x, k: F.sequence(F.lit(0), F.coalesce(F.get(b, k + 1), F.size(s)) - x - 1))))
        return let(numbers, lambda o: F.transform(s, lambda x, k: packed(F.xxhash64(F.get(hashes, place_of(x).cast("int")), F.get(o, k)), place_of(x))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: packed(h, i)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(let(ordered, repeats))


def bin_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def signature(kmers: Column) -> Column:
    """The entries (bin in the high half, tuple hash in the low one) of the used bins, from numbered k-mers.

    kmers must be sorted: k-mers of a bin are neighbours, smallest first; the first ones follow the last ones.
    """
    begins = F.filter(F.sequence(F.lit(0), F.size(kmers) - 1), lambda i: (i == 0) | (bin_of(F.get(kmers, i)) != bin_of(F.get(kmers, F.greatest(i - 1, F.lit(0))))))
    ring = F.concat(kmers, F.slice(kmers, 1, PICKS - 1))
    picked = lambda r, i: F.slice(r, i + 1, F.least(F.lit(PICKS), F.size(kmers)))
    in_order = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(place_of(x).alias("p"), F.shiftright(x, PLACE_BITS).alias("h"))))
    entry = lambda r, i: F.shiftleft(bin_of(F.get(r, i)), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.transform(in_order(picked(r, i)), lambda y: y["h"])), 32))
    return F.when(F.size(kmers) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(let(ring, lambda r: F.transform(begins, lambda i: entry(r, i)))))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the signature of a text column; the steps are columns of their own, so each is computed once."""
    keep = df.columns
    hashed = df.select(*keep, words_of(text).alias("_words")).select(*keep, kmer_hashes(F.col("_words")).alias("_hashes"))
    kmers = hashed.select(*keep, F.sort_array(numbered(F.col("_hashes"))).alias("_kmers"))
    return kmers.select(*keep, signature(F.col("_kmers")).alias(out))


def fingerprint(entries: Column) -> Column:
    """A signature as text: 'bin:hash' in hexadecimal, by bin; the empty string without words."""
    return F.array_join(F.transform(entries, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit(":"), F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries among the bins that either signature uses; 1 for two empty signatures."""
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 32))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (doc_id, _tie, ...) with next_<column> from the row with the next smaller doc_id; the last gets the first's.

    Null ids are the smallest; equal ids go by _tie. The ids are cut into ranges by quantiles, as many as the texts'
    bytes ask for (a number for each goes to the driver); each range is one window, and its first row also stands
    behind the range before.
    """
    spark = df.sparkSession
    n = max(partitions(spark), 1 + (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    cuts = df.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    part = lambda c: F.coalesce(sum([(F.col(c) > x).cast("int") for x in cuts], F.lit(0)) if len(cuts) <= 64 else F.size(F.filter(F.lit(cuts), lambda x: x < F.col(c))), F.lit(0))
    firsts = {r["part"]: r["id"] for r in df.select(part("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("id")).collect()}
    order = sorted(firsts, reverse=True)
    # Rows of literals: a list given to createDataFrame would start Python workers in the executors.
    row = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("id").cast("int"))
    also = spark.range(0, len(order), 1, 1).select(row(order, "int").alias("part"), row([firsts[k] for k in order], "long").alias("first_id"), row(order[-1:] + order[:-1], "int").alias("into"))
    rows = df.withColumn("_part", part("doc_id")).join(F.broadcast(also), F.col("_part") == F.col("part"), "left")
    heads = F.col("doc_id").eqNullSafe(F.col("first_id"))
    parts = F.when(heads, F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")), F.struct(F.col("into").alias("p"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g"))))
    spread = rows.select(*df.columns, F.explode(parts).alias("_at"))
    window = Window.partitionBy("_at.p").orderBy(F.col("_at.g"), F.col("doc_id").desc_nulls_last(), "_tie")
    following = spread.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where("_at.g = 0")
    return following.drop("_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half (rounded down) replaced by as many first code points of the next document in
    descending doc_id. Null texts count as empty; a single document is its own next. Rows with equal ids go by the
    text's hash, null ids last. Extra columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("_tie"))
    own = with_next(with_signature(slim, "text", "own"), ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = own.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("following"))
    rows = rows.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "own", "following")
    rows = with_signature(rows, "edited", "other")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, see ``fingerprints``."""
    return fingerprints(table(spark, sf_dir, "documents"))
