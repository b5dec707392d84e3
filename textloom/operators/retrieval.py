"""Semantic search: similarity top-k, rerank, fusion of several queries' rankings, weak results, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as tx

#: Hits of a query, hits of an answer, the weights of the rerank, the offset of fused ranks, weak results.
TOP_K, FINAL_K = 8, 4
OVERLAP_WEIGHT, CONTAINS_WEIGHT, FIRST_LINE_WEIGHT = 0.25, 0.15, 0.01
RANK_OFFSET = 60
WEAK_SIMILARITY, WEAK_OVERLAP = 0.18, 0.1
VERIFIED_READS, READ_LINES, READ_AROUND = 4, 40, 20
#: Queries of one block of texts: a block is sent to every task, whatever the number of queries.
QUERY_BLOCK = 4096
#: Queries that one scan of all vectors serves (16 MB of 64 numbers each), and those compared at a time.
ASKED, TOGETHER = 65_536, 128


def blocks(queries: DataFrame, key: str, most: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in blocks that are small enough to send to every task."""
    n = queries.count()
    parts = max(1, -(-n // most))
    if parts == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The dot product of each row of q with each row of c: products in single precision, summed left to right in double."""
    out = np.zeros((len(q), len(c)))
    for k in range(q.shape[1]):
        out += np.multiply.outer(q[:, k], c[:, k])
    return out


def by_width(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors by their length: their numbers, their values, their norms. Null, empty and zero vectors, and those that hold
    a null, are like nothing and left out."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values, starts = vectors.flatten(), np.concatenate([[0], np.cumsum(sizes)])
    holes = np.concatenate([[0], np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False))])[starts]
    flat = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float32)
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero((sizes == width) & (np.diff(holes) == 0))
        own = flat[starts[rows][:, None] + np.arange(width)]
        norms = np.zeros(len(rows))
        for k in range(width):
            norms += own[:, k] * own[:, k]
        norms = np.sqrt(norms)
        some = ~(norms <= 0)
        out[width] = (rows[some], own[some], norms[some])
    return out


def first_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row; of equal ones the first columns."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones_like(scores, bool))
    ranked = np.where(np.isnan(scores), np.inf, scores)
    least = np.partition(ranked, -k, axis=1)[:, -k][:, None]
    above, equal = ranked > least, ranked == least
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))


def compared(batch: pa.RecordBatch, known: dict, numbers: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest chunks of a batch, in order of path and chunk, for each of the queries ``numbers``, whose vectors are known."""
    mine, n = by_width(batch.column("vector")), len(numbers)
    for a in range(0, n, TOGETHER):
        scores = np.zeros((min(TOGETHER, n - a), batch.num_rows))
        for width, (rows, q, norms) in known.items():
            if width in mine:
                s, e = np.searchsorted(rows, [a, a + TOGETHER])
                at, c, lengths = mine[width]
                scores[np.ix_(rows[s:e] - a, at)] = products(q[s:e], c) / np.multiply.outer(norms[s:e], lengths)
        i, j = first_of(scores, k)
        part = pa.array(j)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[i + a]), batch.column("path").take(part), batch.column("chunk_id").take(part), pa.array(scores[i, j])], names=["_query", "path", "chunk_id", "similarity"])


def nearest(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, key: str = "query_id") -> DataFrame:
    """The k chunks (path, chunk_id, vector) most like each query (key, query_vector): key, path, chunk_id, similarity, rank
    from 0; of equal cosines the first path and chunk. A query that also has a path searches that path's chunks alone.

    Exact, over all chunks: each batch of chunks is compared with ``ASKED`` queries at a time as a matrix and gives off k
    of them a query, of which Spark ranks the best; no pair leaves its task otherwise. A scan serves ``ASKED`` queries.
    """
    spark, out = queries.sparkSession, None
    path = F.col("path") if "path" in queries.columns else F.lit(None)
    fields = {f.name: f.dataType for f in chunks.select("path", "chunk_id").schema.fields}
    schema = T.StructType([T.StructField("_query", T.IntegerType()), *[T.StructField(n, t) for n, t in fields.items()], T.StructField("similarity", T.DoubleType())])
    for block in blocks(queries.select(key, "query_vector", path.cast("string").alias("path")), key, ASKED):
        asked = block.toArrow().combine_chunks()
        numbers = np.arange(asked.num_rows, dtype=np.int32)
        vectors = asked.column("query_vector").chunk(0) if asked.num_rows else pa.array([], pa.list_(pa.float32()))
        of: dict[str | None, list[int]] = {}
        for i, name in enumerate(asked.column("path").to_pylist()):
            of.setdefault(name, []).append(i)
        shared = spark.sparkContext.broadcast({name: (numbers[own], by_width(vectors.take(pa.array(own)))) for name, own in of.items()})
        names = spark.createDataFrame(asked.select([key]).append_column("_query", pa.array(numbers)), T.StructType([queries.schema[key], T.StructField("_query", T.IntegerType())]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups = shared.value
            for whole in batches:
                batch = whole.take(pc.sort_indices(whole.select(["path", "chunk_id"]), [("path", "ascending"), ("chunk_id", "ascending")], null_placement="at_start"))
                if None in groups:
                    yield from compared(batch, groups[None][1], groups[None][0], k)
                if len(groups) > (None in groups):
                    paths = batch.column("path").cast(pa.string()).to_pylist()
                    starts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]] + [len(paths)]
                    for a, b in zip(starts[:-1], starts[1:], strict=True):
                        if paths[a] is not None and paths[a] in groups:
                            yield from compared(batch.slice(a, b - a), groups[paths[a]][1], groups[paths[a]][0], k)

        found = top_k(chunks.select("path", "chunk_id", "vector").mapInArrow(run, schema), k, "_query").join(F.broadcast(names), "_query").drop("_query")
        out = found if out is None else out.unionByName(found)
    return out.select(key, "path", "chunk_id", "similarity", "rank")


def ranked(hits: DataFrame, by: list[str | Column], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 0; Spark cuts before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("_row", F.row_number().over(window)).where(F.col("_row") <= k).withColumn(out, F.col("_row") - 1).drop("_row")


def top_k(hits: DataFrame, k: int = TOP_K, key: str = "query_id") -> DataFrame:
    """The k most similar chunks of each query: similarity, then path and chunk."""
    return ranked(hits, [key], [F.col("similarity").desc(), F.col("path"), F.col("chunk_id")], k)


def reranked(hits: DataFrame, key: str = "query_id", mode: str = "heuristic", k: int = TOP_K) -> DataFrame:
    """Top-k hits (with question, text, start_line) by similarity, token overlap, the question's words in a row, and the first line.

    mode "off" keeps the order; every other mode is the heuristic one.
    """
    hits = hits.withColumn("overlap", tx.overlap_ratio(tx.tokens(F.col("question")), F.col("text")))
    if mode == "off":
        return hits.withColumn("score", F.col("similarity"))
    asked = tx.lowered(tx.trimmed(F.col("question")))
    bonus = F.when((asked != "") & F.contains(tx.lowered(F.col("text")), asked), CONTAINS_WEIGHT).otherwise(0.0)
    score = F.col("similarity") + OVERLAP_WEIGHT * F.col("overlap")
    score = score + bonus + F.when(F.col("start_line") == 1, FIRST_LINE_WEIGHT).otherwise(0.0)
    return ranked(hits.drop("rank").withColumn("score", score), [key], [F.col("score").desc(), F.col("path"), F.col("chunk_id")], k)


def fused(hits: DataFrame, key: str = "prompt_id", k: int = TOP_K) -> DataFrame:
    """Ranked hits of several queries (query_ord, rank) of a prompt as one ranking by the sum of 1 / (60 + rank + 1).

    The terms are added in the queries' order. Blank paths are dropped; of equal chunks the best values, the widest
    lines and the first text stay.
    """
    path = tx.trimmed(F.col("path"))
    rows = hits.withColumn("path", path).where("path <> ''")
    terms = F.array_sort(F.collect_list(F.struct("query_ord", (1.0 / (RANK_OFFSET + F.col("rank") + 1)).alias("t"))))
    merged = rows.groupBy(key, "path", "chunk_id").agg(
        F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["t"]).alias("score"),
        F.max("similarity").alias("similarity"), F.max("overlap").alias("overlap"),
        F.coalesce(F.min(F.when(F.col("start_line") > 0, F.col("start_line"))), F.lit(0)).alias("start_line"),
        F.max("end_line").alias("end_line"), F.coalesce(F.min_by("text", F.when(F.col("text") != "", F.col("query_ord"))), F.lit("")).alias("text"),
    )
    order = [F.col(c).desc() for c in ("score", "similarity", "overlap")] + [F.col("path"), F.col("chunk_id")]
    return ranked(merged, [key], order, k if k > 0 else 1 << 30)


def weak(hits: DataFrame, prompts: DataFrame | None = None, key: str = "prompt_id") -> DataFrame:
    """key and weak: whether the best hit has little similarity and little overlap.

    Prompts (key) without hits are weak; if no prompts are given, they have no row.
    """
    test = (F.col("similarity") < WEAK_SIMILARITY) & (F.col("overlap") < WEAK_OVERLAP)
    found = hits.where("rank = 0").select(key, test.alias("weak"))
    return found if prompts is None else prompts.select(key).distinct().join(found, key, "left").select(key, F.coalesce("weak", F.lit(True)).alias("weak"))


def with_history(turns: DataFrame, by: str, order: str, question: str = "question") -> DataFrame:
    """turns with history: the questions before it in its conversation, in order, without blank ones.

    What a turn returns grows with its conversation, as the follow-up search asks for all earlier questions.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.array_remove(F.collect_list(question).over(before), ""))


def query_context(history: Column, question: Column) -> Column:
    """What a follow-up question is searched by: the earlier questions and itself; alone it is searched as it is."""
    current = tx.trimmed(question)
    return F.when(F.size(history) == 0, current).otherwise(F.concat(F.lit("Earlier questions:\n- "), F.array_join(history, "\n- "), F.lit("\n\nQuestion: "), current))


def spread(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Ranked hits of a prompt, ``most`` of them: neighbours of chosen chunks wait while enough others are left."""
    rows = list(group.sort_values("rank").itertuples())
    chosen: list = []
    near = lambda r: any(c.path == r.path and abs(c.chunk_id - r.chunk_id) <= 1 for c in chosen)
    for i, r in enumerate(rows):
        if len(chosen) < most and not (near(r) and len(rows) - i > most - len(chosen)):
            chosen.append(r)
    taken = {r.Index for r in chosen}
    order = [r.Index for r in chosen] + [r.Index for r in rows if r.Index not in taken]
    return group.loc[order[:most]].assign(pick=range(min(most, len(order))))


def apart(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Ranked hits of a prompt to read again: one of each path first, then others; none overlaps another's lines."""
    rows, chosen = list(group.sort_values("rank").itertuples()), []
    free = lambda r: not any(c.path == r.path and r.start_line <= c.end_line and c.start_line <= r.end_line for c in chosen)
    for once in (True, False):
        for r in rows:
            if len(chosen) < most and free(r) and not (once and any(c.path == r.path for c in chosen)):
                chosen.append(r)
    return group.loc[[r.Index for r in chosen]].assign(pick=range(len(chosen)))


def selected(hits: DataFrame, how=spread, most: int = FINAL_K, key: str = "prompt_id") -> DataFrame:
    """The hits that ``how`` picks of each prompt's ranking (top-k rows at most), with pick from 0."""
    schema = hits.withColumn("pick", F.lit(0).cast("long")).schema
    return hits.groupBy(key).applyInPandas(lambda g: how(g, most).astype({"pick": "int64"}), schema)


def planned_reads(hits: DataFrame) -> DataFrame:
    """Selected hits with the lines to read: the hit's own if they are few, else those around its middle."""
    size = F.col("end_line") - F.col("start_line") + 1
    middle = F.col("start_line") + F.floor(size / 2)
    few = size <= READ_LINES
    return hits.select(
        "*", F.when(few, "read_lines").otherwise("read_around").alias("tool"),
        F.when(few, F.col("start_line")).otherwise(F.greatest(F.lit(1), middle - READ_AROUND)).alias("read_start"),
        F.when(few, F.col("end_line")).otherwise(middle + READ_AROUND).alias("read_end"),
    )
