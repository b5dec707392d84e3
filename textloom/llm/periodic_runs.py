"""Periodic runs of words: stretches that repeat themselves, found by Baier's grouping, and texts without the repeats.

Every run holds a Lyndon root: a copy of its period that is the longest Lyndon word from where it starts, under the order
of the words or under the reverse one. The first phase of Baier's suffix sorter groups suffixes by their longest Lyndon
prefix: groups are taken from the last to the first, and each of their suffixes lengthens the context of the nearest
suffix before it whose group is lower. So one phase under each order gives all Lyndon words and tells which are equal.
Neighbouring equal ones are a root's copies; comparing words a period apart beyond both ends (the longest common
extensions) makes them a run. Words are numbers of one Arrow dictionary a batch; only the grouping is a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.bpe import appended
from textloom.llm.common import let, slices, table, words_of

#: A run has so many words and so many periods at least (three whole Lyndon roots lie in four periods).
LEAST, PERIODS = 6, 4
#: Rounds in which rare words cut a text, at most; later ones would only save time.
ROUNDS = 12
RUNS = T.ArrayType(T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")]), False)


def lyndon_groups(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest Lyndon word from there, and a number that equal ones share.

    ranks: the letters as numbers from 0 without gaps; the text's end is lower than every letter. Groups are stretches of
    ``order``, told by where they begin; ``left`` leads to the nearest place before that isn't done yet.
    """
    n = len(ranks)
    by_letter = np.argsort(ranks, kind="stable")
    counts = np.bincount(ranks)
    firsts = np.cumsum(counts) - counts
    place = np.empty(n, np.int64)
    place[by_letter] = np.arange(n)
    order, place, group = by_letter.tolist(), place.tolist(), firsts[ranks].tolist()
    size, length, left = [0] * n, [1] * n, list(range(n + 1))
    for g, k in zip(firsts.tolist(), counts.tolist(), strict=True):
        size[g] = k

    def nearest(i: int) -> int:
        """The nearest place before i that isn't done, plus 1; 0 for none. Ways are halved as they are walked."""
        while left[i] != i:
            left[i] = i = left[left[i]]
        return i

    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            left[i + 1] = i
            lower = [(1, [p - 1])] if (p := nearest(i)) else []
        else:
            members, found = order[start:end], {}
            for i in members:
                left[i + 1] = i
            for i in members:
                if p := nearest(i):
                    found[p - 1] = found.get(p - 1, 0) + 1
            times: dict[int, list[int]] = {}
            for p, k in found.items():
                times.setdefault(k, []).append(p)
            lower = sorted(times.items(), reverse=True)
        step = length[order[start]]
        for k, places in lower:  # most copies first: each part goes behind what is left of its old group
            parts: dict[int, list[int]] = {}
            for p in places:
                length[p] += k * step
                if size[group[p]] > 1:
                    parts.setdefault(group[p], []).append(p)
            for g, part in parts.items():
                rest = size[g] - len(part)
                if rest:
                    size[g], size[g + rest] = rest, len(part)
                    for at, p in enumerate(part, g + rest):
                        # the moved part fills the end of the stretch; who stood there takes the mover's place
                        other, old = order[at], place[p]
                        order[old], place[other] = other, old
                        order[at], place[p] = p, at
                        group[p] = g + rest
        end = start
    return np.array(length), np.array(group)


def agreeing(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many letters agree from i and from j (j > i) on, forwards (step 1) or backwards (-1)."""
    done, block = 0, 32
    while True:
        room = min(block, len(x) - j - done if step > 0 else i - done + 1)
        if room <= 0:
            return done
        a, b = ((x[k + done : k + done + room]) if step > 0 else (x[k - done - room + 1 : k - done + 1][::-1]) for k in (i, j))
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done, block = done + room, 2 * block


def roots_to_runs(x: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text of letters 0 to k - 1."""
    n, found = len(x), set()
    for ranks in (x, x.max() - x):
        period, same = lyndon_groups(ranks)
        at = np.arange(n)
        at = at[at + 2 * period < n]
        p = period[at]
        at = at[(same[at] == same[at + p]) & (same[at] == same[at + 2 * p])]
        p = period[at]
        first = (at < p) | (same[at - np.minimum(p, at)] != same[at])
        for i, q in zip(at[first].tolist(), p[first].tolist(), strict=True):
            before = agreeing(x, i - 1, i - 1 + q, -1)
            after = agreeing(x, i, i + q, 1)
            if before + q + after >= max(LEAST, PERIODS * q):
                found.add((i - before, before + q + after, q))
    return found


def stretches(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches that hold all runs, as where they begin and their letters numbered from 0.

    Each word of a run comes ``PERIODS`` times or more in it, so words that are rarer in a stretch cut it, again and again.
    """
    todo = [(0, x, 0)]
    while todo:
        at, part, rounds = todo.pop()
        _, own, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[own] < PERIODS)
        if len(rare) and rounds < ROUNDS:
            begins, ends = np.concatenate([[0], rare + 1]), np.concatenate([rare, [len(part)]])
            todo += [(at + a, part[a:b], rounds + 1) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a >= LEAST] if (ends - begins).max() >= LEAST else []
        elif len(part) >= LEAST:
            yield at, own


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a text of letters, by start and period. A run ends where a word of its stretch ends or another one begins."""
    return sorted((at + s, n, p) for at, part in stretches(x) for s, n, p in roots_to_runs(part))


def find_runs(df: DataFrame, words: str = "words") -> DataFrame:
    """df, without its array of words, with ``runs`` (start, length, period) and ``collapsed``.

    A run is a stretch of words with smallest period q, of max(6, 4q) words or more, that no neighbouring word extends.
    collapsed is the text of the words that no run has after its first period, joined by spaces. Null or empty arrays
    have no runs and the empty text. Other columns are kept; those named runs or collapsed are replaced. A document is
    one task's work, in memory of some hundred bytes for each word of its longest stretch.
    """
    kept = df.drop("runs", "collapsed")
    rest = [f for f in kept.schema.fields if f.name != words]
    schema = T.StructType([*rest, T.StructField("runs", RUNS, False), T.StructField("collapsed", T.StringType(), False)])
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(words)
            sizes = pc.fill_null(pc.list_value_length(whole.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(8 * sizes):
                batch, ends = whole.slice(a, b - a), np.concatenate([[0], np.cumsum(sizes[a:b])])
                values = batch.column(at).flatten()
                codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                left = np.ones(len(values), bool)
                found = [runs_of(codes[s:e]) if e - s >= LEAST else [] for s, e in zip(ends[:-1], ends[1:], strict=True)]
                for s, runs in zip(ends, found, strict=False):
                    for start, length, period in runs:
                        left[s + start + period : s + start + length] = False
                starts = np.concatenate([[0], np.cumsum(left)])[ends].astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), values.filter(pa.array(left))), " ")
                rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], kind)
                yield appended(appended(batch.drop_columns([words]), "runs", rows), "collapsed", texts)

    return kept.mapInArrow(run, schema)


def repeating(words: Column, doc_id: Column) -> Column:
    """The words, for every tenth id (by checksum) with those from a place on replaced by repeats of the first of them.

    The place and the period come from the checksum too. Rows without id or words stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3))
        at = F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")))
        drawn = lambda s: F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, s["a"] + (i - s["a"]) % s["p"])))
        return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.get(F.transform(at, drawn), F.lit(0))).otherwise(w)

    return let(words, repeated)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its runs' number and digest, the run of the greatest exponent, and the digest of the
    text without repeats. A null or empty text has no words and no run; repeated rows give repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs.select("doc_id", repeating(words_of(), F.col("doc_id")).alias("words")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    told = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
