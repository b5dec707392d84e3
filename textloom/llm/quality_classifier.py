"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically.

Every text becomes a dozen numbers by SQL functions. On a bounded sample of labelled rows, shallow trees are boosted
over each feature's bins in turn and summed into one lookup table for each feature, then over the strongest pairs of
features on coarser bins. A score is the logistic of the intercept and the looked-up table entries, added for whole
batches. Labels are used for learning only; language, source and id are never features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WHITE, table, text_of

#: Labelled ids that the model learns from, at most (the smallest by MD5); only their features go to the driver.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.15, 2.0
#: Documents that score less are rejected.
THRESHOLD = 0.3


def features() -> dict[str, Column]:
    """The features by name, from the columns body (text) and words; all are finite, also for empty texts."""
    chars = F.greatest(F.length("body"), F.lit(1))
    words = F.greatest(F.size("words"), F.lit(1))
    left = lambda pattern: F.length("body") - F.length(F.regexp_replace("body", pattern, ""))
    count = lambda c: F.length("body") - F.length(F.replace(F.col("body"), F.lit(c), F.lit("")))
    lines = F.array_remove(F.split("body", "\n"), "")
    return {
        "words": F.log1p(F.size("words")),
        "word_length": F.length(F.array_join("words", "")) / words,
        "distinct_words": F.size(F.array_distinct("words")) / words,
        "symbols": left(r"[#*$%&<>@^~_=+\\/]+") / chars,
        "bars": count("|") / chars,
        "shouts": count("!") / chars,
        "stops": count(".") / words,
        "commas": count(",") / words,
        "upper": left(r"\p{Lu}+") / chars,
        "digits": left(r"[0-9]+") / chars,
        "other": left(r"[^\p{L}\s.,]+") / chars,
        "line_words": F.log1p(words / F.greatest(F.size(lines), F.lit(1))),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and a struct column x of the features."""
    split = docs.select(*keep, text_of().alias("body")).select(*keep, "body", F.array_remove(F.split("body", WHITE), "").alias("words"))
    return split.select(*keep, F.struct(*[c.cast("double").alias(k) for k, c in features().items()]).alias("x"))


@dataclass
class Model:
    """edges: inner bin edges of each feature; tables: a value for each bin; pairs: (i, j, coarse edges of both, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], "right")]
        for i, j, a, b, values in self.pairs:
            total += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def inner_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values of a tree of a few leaves over the ordered bins, split greedily by gain; g, h: sums of each bin."""
    gain = lambda a, b: a * a / (b + RIDGE)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                all_g, all_h = g[a:b].sum(), h[a:b].sum()
                gains = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
                k = int(gains.argmax())
                best = max(best, (float(gains[k]), (a, b), a + k + 1), key=lambda t: t[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid of bins into four quadrants."""
    best, out = 0.0, np.zeros_like(g)
    cum_g, cum_h = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            sums = [tuple(c[-1 if r.stop is None else r.stop, -1 if q.stop is None else q.stop] - c[r.start, -1 if q.stop is None else q.stop] - c[-1 if r.stop is None else r.stop, q.start] + c[r.start, q.start] for c in (cum_g, cum_h)) for r, q in cells]
            found = sum(a * a / (b + RIDGE) for a, b in sums) - whole
            if found > best:
                best, out = found, np.zeros_like(g)
                for (r, q), (a, b) in zip(cells, sums, strict=True):
                    out[r, q] = a / (b + RIDGE)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of x (rows by features) and y (0 or 1). Without rows, or with one label only, it is an intercept."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(rate / (1 - rate))), [], [], [])
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        model.edges, model.tables = [np.empty(0)] * width, [np.zeros(1)] * width
        return model
    model.edges = [inner_edges(x[:, k], BINS) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    logit = np.full(len(y), model.intercept)
    chance = lambda: 1 / (1 + np.exp(-logit))
    for _ in range(ROUNDS):
        for k in range(width):
            p, n = chance(), len(model.tables[k])
            step = RATE * tree(np.bincount(bins[k], y - p, n), np.bincount(bins[k], p * (1 - p), n))
            model.tables[k] += step
            logit += step[bins[k]]
    coarse = [inner_edges(x[:, k], PAIR_BINS) for k in range(width)]
    cell = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        p, shape = chance(), (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cell[i] * shape[1] + cell[j]
        return quadrants(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))))

    ranked = sorted(((grid(i, j)[0], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in tables.items():
            step = RATE * grid(i, j)[1]
            values += step
            logit += step[cell[i], cell[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], v) for (i, j), v in tables.items()]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of at most ``rows`` labelled ids outside the held-out fold. Ids with two labels, or null ones, teach nothing."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b"))
    chosen = clean.where((F.col("a") == F.col("b")) & ~held_out()).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    chosen = chosen.select(F.col("doc_id").alias("labelled_id"), F.col("a").alias("label"))
    rows_of = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    sample = featured(rows_of, "labelled_id", "label").groupBy("labelled_id").agg(F.min(F.struct("x", "label")).alias("r"))
    found = sample.select("labelled_id", "r.x.*", "r.label").orderBy("labelled_id").toPandas()
    return fit(found[list(features())].to_numpy(float), found["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row and its score (0 to 1). Null and empty texts score as texts without words."""
    names = list(features())

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(x[names].to_numpy(float)))

    return featured(docs, *keep).select(*keep, scored("x").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; other columns of docs are ignored. A null id isn't held out."""
    scored = score(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, see ``classify``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
