"""Searches over lines: literal, regular expression, token overlap, and literal with overlap as fallback."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.lines import content, line_array, page

#: Matches of a page unless asked, and at most.
PAGE, MOST = 5, 20


def normalized(mode: str, limit: int, offset: int, context: int) -> tuple[str, int, int, int]:
    mode = mode if mode in ("literal", "regex") else "auto"
    return mode, min(limit, MOST) if limit > 0 else PAGE, max(0, offset), max(0, context)


def query_tokens(query: str) -> list[str]:
    """The distinct tokens of a query, as the column function has them."""
    low = query.replace("İ", "i").replace("Σ", "σ").lower()
    found = "".join(c if c.isalpha() or c.isnumeric() else " " for c in low).split()
    return [t for t in dict.fromkeys(found) if len(t) >= 2]


def literal(query: str) -> Column:
    return F.contains(tx.lowered(F.col("content")), F.lit(query.replace("İ", "i").replace("Σ", "σ").lower()))


def regex(pattern: str) -> Column:
    """Case-insensitive search. Java's patterns, and named groups as (?P<n>...), are taken; back-references, look-around
    and broken patterns are refused before any task runs."""
    if re.search(r"\\[1-9]|\\k<|\(\?(?:[=!>]|<[=!])", pattern):
        raise ValueError("invalid_arguments: back-references and look-around aren't supported")
    pattern = "(?iud)" + pattern.replace("(?P<", "(?<")
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"invalid_arguments: {e}") from e
    return F.col("content").rlike(pattern)


def numbered(docs: DataFrame, path: str, text: str) -> DataFrame:
    rows = docs.select(path, F.posexplode(line_array(F.col(text))).alias("_at", "_line"))
    return rows.select(path, (F.col("_at") + 1).cast("long").alias("line_no"), content(F.col("_line")).alias("content"))


def literal_matches(docs: DataFrame, query: str, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, content, score, reason of the lines that hold the query, whatever its case."""
    return numbered(docs, path, text).where(literal(query)).select("*", F.lit(1.0).alias("score"), F.lit("literal_match").alias("reason"))


def regex_matches(docs: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    return numbered(docs, path, text).where(regex(pattern)).select("*", F.lit(1.0).alias("score"), F.lit("regex_match").alias("reason"))


def overlap_matches(docs: DataFrame, query: str, path: str = "path", text: str = "text") -> DataFrame:
    """Lines that hold some token of the query, scored by the share that they hold; none for queries of under two tokens."""
    found = query_tokens(query)
    rows = numbered(docs, path, text)
    if len(found) < 2:
        return rows.select("*", F.lit(0.0).alias("score"), F.lit("").alias("reason")).where(F.lit(False))
    wanted = F.array(*map(F.lit, found))
    hits = rows.withColumn("_n", tx.contained(wanted, F.col("content"))).where("_n > 0")
    reason = F.concat(F.lit("token_overlap:"), F.col("_n").cast("string"), F.lit(f"/{len(found)}"))
    return hits.select(path, "line_no", "content", (F.round(F.col("_n") / len(found) * 1000) / 1000).alias("score"), reason.alias("reason"))


def auto_matches(docs: DataFrame, query: str, path: str = "path", text: str = "text") -> DataFrame:
    """Literal matches; if no document has any, token overlap. One plan: the overlap branch is empty beside literal hits."""
    exact = literal_matches(docs, query, path, text)
    some = exact.limit(1).agg(F.count("*").alias("_some"))
    return exact.unionByName(overlap_matches(docs, query, path, text).join(F.broadcast(some)).where("_some = 0").drop("_some"))


def matches(docs: DataFrame, query: str, mode: str = "auto", path: str = "path", text: str = "text") -> DataFrame:
    return {"literal": literal_matches, "regex": regex_matches}.get(mode, auto_matches)(docs, query.strip(), path, text)


def alias(only: str, path: Column, source: Column) -> Column:
    """Whether a name stands for a single file: its path, the name it was opened by, or the last part of that."""
    name = only.strip()
    return F.lit(not name) | (path == name) | (source == name) | (F.element_at(F.split(source, "/"), -1) == name)


def restricted(docs: DataFrame, only: str | None, path: str = "path", source: str | None = None) -> DataFrame:
    """The document of one path, or all of docs if none or a blank one is named; a path that docs doesn't have is an error.

    source: the column of the name that a document was opened by. Where docs is a single document, that name and its last
    part stand for it too.
    """
    if only is None or not only.strip():
        return docs
    found = docs.where(F.col(path) == only.strip())
    if source and found.select(path).isEmpty() and docs.select(path).limit(2).count() == 1:
        found = docs.where(alias(only, F.col(path), F.col(source)))
    if found.select(path).isEmpty():
        raise ValueError(f"invalid_arguments: unknown path {only.strip()!r}")
    return found


def search(docs: DataFrame, query: str, mode: str = "auto", limit: int = 0, offset: int = 0, only: str | None = None, path: str = "path", text: str = "text", context: int = 0) -> DataFrame:
    """A page of matches: best score first, then path and line. A query for one path must not be empty.

    With context, context_before and context_after hold up to as many lines; they are cut out of the documents of the
    page's few matches.
    """
    mode, limit, offset, context = normalized(mode, limit, offset, context)
    if only is not None and not query.strip():
        raise ValueError("invalid_arguments: query must not be empty")
    docs = restricted(docs, only, path)
    found = page(matches(docs, query, mode, path, text), [F.col("score").desc(), F.col(path), F.col("line_no")], limit, offset)
    if not context:
        return found
    at, k = (F.col("line_no") - 1).cast("int"), F.lit(context)
    whole = docs.select(path, F.transform(line_array(F.col(text)), content).alias("_lines")).join(F.broadcast(found), path)
    before = F.slice("_lines", F.greatest(at - k, F.lit(0)) + 1, F.least(at, k))
    return whole.select(*found.columns, before.alias("context_before"), F.slice("_lines", at + 2, k).alias("context_after"))


def with_context(docs: DataFrame, keep, k: int, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, content, context_before and context_after (arrays of up to k lines) of the lines that ``keep`` takes.

    keep: a function of a line's column. The neighbours come from the document's own row: no join, no shuffle.
    """
    rows = docs.select(path, F.transform(line_array(F.col(text)), content).alias("_lines"))
    hits = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: keep(s["x"]))
    at = F.col("_hit.i")
    return rows.select(path, "_lines", F.explode(hits).alias("_hit")).select(
        path, (at + 1).cast("long").alias("line_no"), F.col("_hit.x").alias("content"),
        F.slice("_lines", F.greatest(at - k, F.lit(0)) + 1, F.least(at, F.lit(k))).alias("context_before"),
        F.slice("_lines", at + 2, F.lit(k)).alias("context_after"),
    )
