"""Semantic search as pages of matches: in one path or in all, cut to the best, reranked, then paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import retrieval
from textloom.operators.search import MOST, PAGE

#: A request's columns beside its key and query_vector.
REQUEST = ("question", "path", "limit", "offset")
MATCH = ("chunk_id", "path", "start_line", "end_line", "similarity", "overlap", "score", "text")


def path_bucket(path: Column, buckets: int) -> Column:
    """The part of an index that holds a path's chunks."""
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def in_path(chunks: DataFrame, path: str | None, buckets: int = 0) -> DataFrame:
    """The chunks of one path, or all if none or a blank one is named; a path without chunks is an error.

    With ``buckets``, the number of parts of an index laid out by path_bucket, only the path's own part is read.
    """
    if path is None or not path.strip():
        return chunks
    name = F.lit(path.strip())
    own = chunks.where(F.col("path") == name)
    own = own.where(F.col("path_bucket") == path_bucket(name, buckets)) if buckets else own
    if own.select("path").isEmpty():
        raise ValueError(f"invalid_arguments: path {path.strip()!r} has no chunks")
    return own


def normalized(requests: DataFrame, key: str) -> DataFrame:
    """Requests with trimmed questions and paths (null if blank), limits from 1 to 20 (5 unless asked) and offsets of 0 or more."""
    limit = F.coalesce(F.col("limit"), F.lit(0))
    path = tx.trimmed(F.col("path").cast("string"))
    return requests.select(
        key, "query_vector", tx.trimmed(F.col("question")).alias("question"), F.when(path != "", path).alias("path"),
        F.when(limit <= 0, PAGE).otherwise(F.least(limit, F.lit(MOST))).cast("long").alias("limit"), F.greatest(F.coalesce(F.col("offset"), F.lit(0)), F.lit(0)).cast("long").alias("offset"),
    )


def checked(requests: DataFrame, chunks: DataFrame) -> None:
    """Raises if a normalized request has no question, or a path that no chunk has. Of the chunks, only the named paths are kept."""
    if not requests.where(F.coalesce(F.col("question"), F.lit("")) == "").isEmpty():
        raise ValueError("invalid_arguments: a question is empty")
    named = requests.where("path IS NOT NULL").select(*[c for c in ("path", "path_bucket") if c in requests.columns]).distinct()
    known = chunks.select(*named.columns).join(F.broadcast(named), named.columns, "left_semi").distinct()
    lost = named.join(known, "path", "left_anti").select("path").orderBy("path").first()
    if lost is not None:
        raise ValueError(f"invalid_arguments: path {lost['path']!r} has no chunks")


def pages(requests: DataFrame, chunks: DataFrame, key: str = "query_id", top_k: int = retrieval.TOP_K, mode: str = "heuristic", buckets: int = 0) -> DataFrame:
    """One row for each request (key, query_vector, question, path, limit, offset): key, question, path, limit, offset,
    match_count, total_matches, has_more, next_offset (null if there is no more) and matches, an array of ``MATCH``.

    A request with a path searches its chunks alone; null and blank paths search all. The ``top_k`` most similar chunks
    are reranked and then paged, so totals are ``top_k`` at most, and an offset beyond the total is the total. Texts join
    the few matches that are left. Chunks need ``MATCH``'s columns but scores, and vector; path and chunk_id name one.
    buckets: the parts of an index that is laid out by path_bucket; those that no request names are not read.
    """
    asked = normalized(requests, key).checkpoint()  # a few rows, asked for again and again
    if buckets:
        asked = asked.withColumn("path_bucket", path_bucket(F.col("path"), buckets))
    checked(asked, chunks)
    if buckets and asked.where("path IS NULL").isEmpty():  # the parts that are named; there are few parts in all
        chunks = chunks.where(F.col("path_bucket").isin([r["path_bucket"] for r in asked.select("path_bucket").distinct().collect()]))
    best = retrieval.nearest(asked.select(key, "query_vector", "path"), chunks, top_k, key)
    texts = chunks.select("path", "chunk_id", "start_line", "end_line", "text")
    hits = retrieval.reranked(best.join(asked.select(key, "question"), key).join(texts, ["path", "chunk_id"]), key, mode, top_k)
    # the order within a page is the rank's; a request without hits keeps its row
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), *MATCH))).alias("_hits"))
    none = F.array().cast(listed.schema["_hits"].dataType)
    whole = asked.join(listed, key, "left").withColumn("_hits", F.coalesce("_hits", none)).withColumn("total_matches", F.size("_hits").cast("long"))
    whole = whole.withColumn("offset", F.least("offset", "total_matches"))
    page = F.slice("_hits", (F.col("offset") + 1).cast("int"), F.col("limit").cast("int"))
    matches = F.transform(page, lambda h: F.struct(*[h[c].alias(c) for c in MATCH]))
    end = F.least(F.col("offset") + F.col("limit"), F.col("total_matches"))
    more = end < F.col("total_matches")
    return whole.select(key, "question", "path", "limit", "offset", F.size(page).cast("long").alias("match_count"), "total_matches", more.alias("has_more"), F.when(more, end).alias("next_offset"), matches.alias("matches"))


def matched(found: DataFrame, key: str = "query_id") -> DataFrame:
    """The matches of pages as rows, with place from 0; evidence of retrieved lines can be made of them."""
    return found.select(key, F.posexplode("matches").alias("place", "_m")).select(key, F.col("place").cast("long").alias("place"), "_m.*")


def progress(found: DataFrame, key: str = "query_id") -> DataFrame:
    """key, namespace, path and lines (start, end) that a page shows: what novelty is counted over."""
    rows = matched(found, key).where((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    return rows.select(key, F.lit("rag").alias("namespace"), tx.trimmed(F.col("path")).alias("path"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
