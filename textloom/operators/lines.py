"""Lines of documents, range reads and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let


def line_array(text: Column) -> Column:
    """The lines of a text: no line after a last newline, none in an empty text."""
    parts = F.split(text, "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.coalesce(whole, F.array().cast("array<string>"))


def content(line: Column) -> Column:
    """A line without the carriage returns at its end."""
    return F.regexp_replace(line, r"\r+$", "")


def lines(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no (long, from 1), text of each line."""
    return docs.select(path, F.posexplode(line_array(F.col(text))).alias("_at", "_line")).select(
        path, (F.col("_at") + 1).cast("long").alias("line_no"), F.col("_line").alias("text")
    )


def sums_before(sizes: Column) -> Column:
    """For each size of an array the sum of those before it, inside the row: sums over 1, 2, 4 ... sizes, doubled while
    the array is longer."""
    steps = lambda x: F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(x))
    add = lambda acc, p: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - p), F.lit(0)))
    return let(sizes, lambda x: F.transform(F.aggregate(steps(x), x, add), lambda v, i: v - F.get(x, i)))


def lines_with_offsets(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, text, byte_start and byte_len of each line, in bytes of UTF-8; newlines count to the offsets only.

    Offsets are summed in the document's own row, without a shuffle.
    """
    rows = docs.select(path, line_array(F.col(text)).alias("_lines"))
    starts = sums_before(F.transform("_lines", lambda x: (F.octet_length(x) + 1).cast("long")))
    each = rows.select(path, F.posexplode(F.arrays_zip(F.col("_lines").alias("x"), starts.alias("b"))).alias("_at", "_z"))
    return each.select(path, (F.col("_at") + 1).cast("long").alias("line_no"), F.col("_z.x").alias("text"), F.col("_z.b").alias("byte_start"), F.octet_length("_z.x").cast("long").alias("byte_len"))


def read_lines(docs: DataFrame, start: Column | int, end: Column | int, path: str = "path", text: str = "text") -> DataFrame:
    """The lines from start (1 at least) to end of every document of docs; none if end is before start.

    The range is cut out of the document's row before lines become rows.
    """
    first = F.greatest(F.lit(1), F.lit(start) if isinstance(start, int) else start)
    last = F.lit(end) if isinstance(end, int) else end
    part = F.slice(line_array(F.col(text)), first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    cut = docs.select(path, first.alias("_first"), F.posexplode(part).alias("_at", "_line"))
    return cut.select(path, (F.col("_first") + F.col("_at")).cast("long").alias("line_no"), content(F.col("_line")).alias("content"))


def read_around(docs: DataFrame, line: Column | int, before: int = 0, after: int = 0, path: str = "path", text: str = "text") -> DataFrame:
    """The lines around one; negative distances mean 3. A line below 1 is an error."""
    if isinstance(line, int) and line < 1:
        raise ValueError("invalid_arguments: line must be at least 1")
    at = F.lit(line) if isinstance(line, int) else line
    return read_lines(docs, at - (3 if before < 0 else before), at + (3 if after < 0 else after), path, text)


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with total_matches, has_more and next_offset (0 if none).

    The total is a sum over all tasks that joins as one row; the page itself is a top-k.
    """
    limit, offset = max(0, limit), max(0, offset)
    total = rows.agg(F.count("*").alias("total_matches"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    more = F.col("total_matches") > offset + limit
    return part.join(F.broadcast(total)).select(*rows.columns, "total_matches", more.alias("has_more"), F.when(more, offset + limit).otherwise(0).cast("long").alias("next_offset"))


def page_totals(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row with total_matches, has_more and next_offset of a page, also where the page itself is empty."""
    end = max(0, limit) + max(0, offset)
    more = F.col("total_matches") > end
    return rows.agg(F.count("*").alias("total_matches")).select("total_matches", more.alias("has_more"), F.when(more, end).otherwise(0).cast("long").alias("next_offset"))


def list_files(docs: DataFrame, limit: int = 50, offset: int = 0, path: str = "path") -> DataFrame:
    """A page of paths: 50 unless asked, 200 at most."""
    return page(docs.select(path), [path], 50 if limit <= 0 else min(limit, 200), offset)
