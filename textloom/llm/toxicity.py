"""Toxicity: every passage of a text whose words are significantly those of toxic documents.

Tokens are lower-cased words and their beginnings of a few lengths, hashed to buckets. The buckets' documents are counted,
toxic, clean and all; a token's score is its log-odds of toxic against clean documents under Dirichlet priors that have
the shape of the whole corpus, less a multiple of its standard error, so that rare tokens say nothing. A word scores as
its strongest token; words that say nothing cost a little. A linear-time scan then finds all maximal-scoring segments of
a text (Ruzzo and Tompa). Scores of segments in clean text follow an extreme-value law, whose scale and size come from
clean documents (Karlin and Altschul); a document's segments are added up by its sum statistics, and what comes out is
calibrated on labelled documents by a complementary log-log line, the extreme-value link. For that, documents are scored
by counts of the other half of the labelled ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import stored, table

#: Buckets of the tokens (a power of two); their weights are as many floats (4 MB) and go to every task.
N_BUCKETS = 1 << 20
#: A word's tokens: itself and its first letters, so many of them.
BEGINNINGS = (3, 4, 5, 6, 7)
#: What tells a whole word's checksum from that of a beginning.
WHOLE = 0x5BD1E995
#: The priors' weight beside the labelled documents, and the standard errors that a log-odds is lessened by.
PRIOR, ERRORS = 0.05, 2.0
#: Labelled documents that the calibration is fitted on, at most (the smallest by MD5 of their id).
CALIBRATION_ROWS = 20_000
#: Labelled ids that are broadcast, at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A passage is significant if clean texts of its document's length have fewer such ones.
EXPECTED = 0.05
#: Documents that score so much or more are toxic.
THRESHOLD = 0.7
#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
PASSAGES = T.ArrayType(T.StructType([T.StructField(k, t, False) for k, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("score", T.DoubleType()), ("expected", T.DoubleType()))]), False)


def words_in(text: str | None) -> list[str]:
    """The words of a whole text: runs of letters in lower case."""
    return LETTERS.findall(text.lower()) if text else []


class Buckets(dict):
    """For each word its place in ``rows``, the buckets of its tokens, and in ``gain``, what the strongest of them weighs.

    A worker's table is begun anew when it is full.
    """

    def __init__(self, weight: np.ndarray | None = None):
        super().__init__()
        self.weight, self.fresh = weight, []
        self.rows, self.gain = np.empty((REMEMBERED, 1 + len(BEGINNINGS)), np.int32), np.zeros(REMEMBERED, np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        checksum, n, row = 0, 0, []
        for k in BEGINNINGS:  # each goes on from the shorter one
            if len(word) < k:
                break
            checksum, n = zlib.crc32(word[n:k].encode(), checksum), k
            row.append((checksum ^ k) % N_BUCKETS)
        whole = (zlib.crc32(word[n:].encode(), checksum) ^ WHOLE) % N_BUCKETS
        self.fresh.append([whole, *row, *[whole] * (len(BEGINNINGS) - len(row))])
        return at

    def places(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > len(self.rows):
            self.clear()
            if len(words) > len(self.rows):
                self.rows, self.gain = np.empty((len(words), self.rows.shape[1]), np.int32), np.zeros(len(words), np.float32)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            new = slice(len(self) - len(self.fresh), len(self))
            self.rows[new] = self.fresh
            if self.weight is not None:
                self.gain[new] = self.weight[self.rows[new]].max(axis=1)
            self.fresh = []
        return found


class Once:
    """Distinct numbers below a bound, in time in proportion to how many are asked of."""

    def __init__(self, bound: int):
        self.last = np.empty(bound, np.int32)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        if len(numbers) and numbers.max() >= len(self.last):
            self.last = np.empty(numbers.max() + 1, np.int32)
        own = np.arange(len(numbers), dtype=np.int32)
        self.last[numbers] = own
        return numbers[self.last[numbers] == own]


def in_fold(doc_id: str = "doc_id") -> tuple[Column, Column]:
    """Whether an id is held out (its checksum leaves 1 by 3), and its half (0 or 1) of the others."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(h, F.lit(3)) == 1, F.lit(False)), F.pmod(F.floor(h / 3), F.lit(2)).cast("int")


def known_labels(labels: DataFrame) -> DataFrame:
    """labelled_id, label, half of the ids outside the held-out fold. Ids with two labels, or null ones, teach nothing."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b"))
    held, half = in_fold()
    return clean.where((F.col("a") == F.col("b")) & ~held).select(F.col("doc_id").alias("labelled_id"), F.col("a").cast("int").alias("label"), half.alias("half"))


def with_labels(docs: DataFrame, known: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """text, label and half of every row of docs, the latter null where nothing is known. Rows without id are dealt by their text."""
    texts, same = docs.select("doc_id", "text"), F.col("doc_id") == F.col("labelled_id")
    if known.count() <= most:
        joined = texts.join(F.broadcast(known), same, "left")
    else:
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
        joined = texts.join(known.withColumn("of", F.lit(0).cast("long")).hint("shuffle_hash"), same & (spread == F.col("of")), "left")
    return joined.select("text", "label", "half")


#: What is counted of a bucket: documents, and clean and toxic ones of both halves.
COUNTS = ("n", "clean0", "toxic0", "clean1", "toxic1")


def bucket_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """bucket and ``COUNTS``: how many documents hold a token of the bucket. Every document is counted, once for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = Buckets(), np.zeros((len(COUNTS), N_BUCKETS), np.int32)
        words_once, buckets_once = Once(REMEMBERED), Once(N_BUCKETS)
        for batch in batches:
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = buckets_once(table.rows[words_once(table.places(words_in(text)))].ravel())
                sums[0][own] += 1
                if label is not None:
                    sums[1 + 2 * half + label][own] += 1
        some = np.flatnonzero(sums[0])
        for a in range(0, len(some), 100_000):
            part = some[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(s[part].astype(np.int64)) for s in sums)], names=["bucket", *COUNTS])

    each = with_labels(docs, known).mapInArrow(run, "bucket int, " + ", ".join(f"{c} long" for c in COUNTS))
    return each.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS])


def weights(n: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The log-odds of each bucket's tokens, toxic against clean, less its standard errors; 0 where less is left.

    Each class's prior is ``PRIOR`` of its size, dealt like the whole corpus; so a token that no labelled text has is even.
    """
    sides = []
    for y in (toxic.astype(float), clean.astype(float)):
        prior = PRIOR * y.sum() * n / max(1, n.sum()) + 1e-9
        sides.append((y + prior, (y.sum() + prior.sum()) - y - prior + 1e-9))
    (t, rest_t), (c, rest_c) = sides
    odds = np.log(t) - np.log(rest_t) - np.log(c) + np.log(rest_c)
    return np.maximum(0, odds - ERRORS * np.sqrt(1 / t + 1 / c)).astype(np.float32)


def segments(at: list[int], gain: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first and last word, score) of a text whose words at ``at`` gain and all others cost ``drift``.

    One pass: a word is a segment of its own until an earlier one with a lower start and a lower end is found, which takes
    it in. ``back`` leads from a segment to the last one before it that starts lower.
    """
    low, high, first, last, back = [], [], [], [], []
    total, before = 0.0, -1
    for p, g in zip(at, gain, strict=True):
        total -= drift * (p - before - 1)
        a, start, j = total, p, len(low) - 1
        total, before = total + g, p
        while True:
            while j >= 0 and low[j] >= a:
                j = back[j]
            if j < 0 or high[j] >= total:
                break
            a, start, k = low[j], first[j], back[j]
            for column in (low, high, first, last, back):
                del column[j:]
            j = k
        for column, value in zip((low, high, first, last, back), (a, total, start, p, j), strict=True):
            column.append(value)
    return [(s, e, h - b) for s, e, h, b in zip(first, last, high, low, strict=True)]


@dataclass
class Law:
    """What segments score in clean text: ``size`` * words * exp(-``rate`` * score) of them score so much; ``drift``: what a word costs."""

    drift: float = 0.01
    rate: float = 1.0
    size: float = 1.0

    def expected(self, score: float, n: int) -> float:
        return self.size * n * math.exp(-min(700.0, self.rate * score))

    def surprise(self, scores: list[float], n: int) -> float:
        """How little chance alone gives such scores in clean text of n words: -log of the least chance of the best r of them."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.rate * s - math.log(max(self.size * n, 1e-9))
            if total <= r * (r - 1) or total <= 0:
                break
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return best


def fit_law(samples: list[tuple[int, int, list[int], list[float]]]) -> Law:
    """The law of clean documents among samples (label, words, places and gains of the words that gain)."""
    words, gains = [1, 1], [[], []]
    for label, n, _, g in samples:
        words[label] += n
        gains[label] += g
    share = [min(0.9, len(g) / w) for g, w in zip(gains, words, strict=True)]
    drift = max(1e-3, math.log((1 - share[0]) / (1 - share[1])), 1.5 * sum(gains[0]) / words[0] / (1 - share[0]))
    law = Law(drift)
    if gains[0]:
        values, counts = np.unique(np.round(gains[0], 2), return_counts=True)
        a, b = 1e-3, 50.0
        for _ in range(60):  # the rate at which the mean of exp(rate * score) over clean words is 1
            law.rate = (a + b) / 2
            mean = (counts * np.exp(np.minimum(700, law.rate * values))).sum() / words[0] + (1 - share[0]) * math.exp(-law.rate * drift)
            a, b = (a, law.rate) if mean > 1 else (law.rate, b)
        scores = np.array([law.rate * s for label, _, at, g in samples if not label for *_, s in segments(at, g, drift)])
        middle = float(np.median(scores))
        law.size = float((scores >= middle).sum() * math.exp(middle) / words[0])
    else:
        law.size = 1 / words[0]
    return law


def fit_link(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the chance 1 - exp(-exp(a + b * x)), by damped Newton steps, b never negative."""
    rate = (y.sum() + 1) / (len(y) + 2)
    a, b = math.log(-math.log(1 - rate)), 0.0
    if len(np.unique(y)) < 2:
        return a, b

    def loss(a: float, b: float) -> float:
        e = np.exp(np.clip(a + b * x, -30, 4))
        return float(-(np.where(y == 1, np.log(-np.expm1(-e)), -e)).sum() + 0.5 * b * b)

    now = loss(a, b)
    for _ in range(60):
        e = np.exp(np.clip(a + b * x, -30, 4))
        p = -np.expm1(-e)
        pull = np.where(y == 1, e * np.exp(-e) / np.maximum(p, 1e-12), -e)
        weight = e * e * np.exp(-e) / np.maximum(p, 1e-12) + 1e-9
        design = np.stack([np.ones_like(x), x])
        step = np.linalg.solve((design * weight) @ design.T + np.diag([1e-6, 1.0]), design @ pull - np.array([0, b]))
        size = 1.0
        while size > 1e-4 and (b + size * step[1] < 0 or loss(a + size * step[0], b + size * step[1]) > now):
            size /= 2
        if size <= 1e-4:
            break
        a, b = a + size * step[0], b + size * step[1]
        now = loss(a, b)
    return float(a), float(b)


def gaining(table: Buckets, words: list[str]) -> tuple[list[int], list[float]]:
    """The places and gains of the words that some token of theirs speaks for. A word gains its score where it comes first
    in a text, half of it where it comes again, a third the next time: documents are what was counted."""
    places = table.places(words)
    gain = table.gain[places]
    at = np.flatnonzero(gain)
    if not len(at):
        return [], []
    order = np.argsort(places[at], kind="stable")
    own = places[at][order]
    fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    times = np.empty(len(at), np.int64)
    times[order] = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at)))) + 1
    return at.tolist(), (gain[at] / times).astype(float).tolist()


@dataclass
class Model:
    weight: np.ndarray
    law: Law
    link: tuple[float, float]

    def chance(self, surprise: float) -> float:
        return -math.expm1(-math.exp(min(4.0, self.link[0] + self.link[1] * math.log1p(surprise))))


def train(docs: DataFrame, labels: DataFrame, rows: int = CALIBRATION_ROWS) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic). Without both labels every text scores the same.

    The counts cover all documents; the law and the calibration are fitted on at most ``rows`` labelled ones.
    """
    known = stored(known_labels(labels), "toxic-labels")
    n, clean0, toxic0, clean1, toxic1 = (np.zeros(N_BUCKETS, np.int64) for _ in COUNTS)
    counted = bucket_counts(docs, known).toArrow()  # a row for each bucket, at most
    at = counted.column("bucket").to_numpy()
    for into, name in zip((n, clean0, toxic0, clean1, toxic1), COUNTS, strict=True):
        into[at] = counted.column(name).to_numpy()
    halves = [weights(n, clean1, toxic1), weights(n, clean0, toxic0)]  # each half by the other's counts
    chosen = known.orderBy(F.md5(F.col("labelled_id").cast("string")), "labelled_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", "label", "half")
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Buckets(w) for w in shared.value]
        for batch in batches:
            out = []
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_in(text)
                out.append((label, len(words), *gaining(tables[half], words)))
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)] if out else []
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "n", "at", "gain"])

    found = [tuple(r) for r in sample.mapInArrow(run, "label int, n int, at array<int>, gain array<double>").collect()]
    found.sort()
    law = fit_law(found)
    x = np.array([math.log1p(law.surprise([s for *_, s in segments(at, g, law.drift)], n)) for _, n, at, g in found])
    link = fit_link(x, np.array([r[0] for r in found], dtype=float))
    return Model(weights(n, clean0 + clean1, toxic0 + toxic1), law, link)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df, without its text, with ``score`` (0 to 1) and ``passages``: start and end (numbers of words, the end's too),
    score, and how many as high ones clean text of that length is expected to have. Null and empty texts have none and
    score as clean texts without a sign. Other columns are kept; those named score or passages are replaced."""
    kept = df.drop("score", "passages")
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != text], T.StructField("score", T.DoubleType(), False), T.StructField("passages", PASSAGES, False)])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = Buckets(m.weight)
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(text):
                words = words_in(value.as_py())
                found = segments(*gaining(table, words), m.law.drift)
                scores.append(m.chance(m.law.surprise([s for *_, s in found], len(words))))
                told = [{"start": a, "end": b, "score": s, "expected": m.law.expected(s, len(words))} for a, b, s in found]
                passages.append([p for p in told if p["expected"] <= EXPECTED])
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*rest.schema.names, "score", "passages"])

    return kept.mapInArrow(run, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document, repeated ids included; a null id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", in_fold()[0].alias("held_out"), "score", predicted, F.size("passages").cast("long").alias("n_passages"))
