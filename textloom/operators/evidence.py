"""Evidence: closed ranges of lines of a path, their union and difference, and their text form.

by: further columns, such as a prompt's id, that keep the evidence of one apart from another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx


def clamped(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranges (kind, path, start_line, end_line) with start 1 at least and end not before it; blank paths are dropped."""
    start = F.greatest(F.lit(1), F.col("start_line"))
    return ranges.where(F.trim("path") != "").select(*by, "kind", F.trim("path").alias("path"), start.cast("long").alias("start_line"), F.greatest(start, F.col("end_line")).cast("long").alias("end_line"))


def distinct_evidence(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return ranges.dropDuplicates([*by, "kind", "path", "start_line", "end_line"])


def merged(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unions of overlapping ranges of a kind and path; ranges that only touch (10, 11) stay apart.

    Equal ranges are one before they are shuffled.
    """
    order = Window.partitionBy(*by, "kind", "path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_line") > reach), 1).otherwise(0)
    islands = distinct_evidence(ranges, by).withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*by, "kind", "path", "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_island")


def subtracted(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """path, start_line, end_line of what merged right leaves of merged left.

    One sweep over the ranges' ends in order: between two neighbouring ends, lines are left where a left range is open
    and no right one. Each range is two rows, whatever it meets.
    """
    ends = lambda l, r: F.inline(F.array(  # noqa: E731, E741
        F.struct(F.col("start_line").alias("at"), F.lit(l).alias("l"), F.lit(r).alias("r")),
        F.struct((F.col("end_line") + 1).alias("at"), F.lit(-l).alias("l"), F.lit(-r).alias("r"))))
    events = left.select(*by, "path", ends(1, 0)).unionByName(right.select(*by, "path", ends(0, 1)))
    order = Window.partitionBy(*by, "path").orderBy("at")
    swept = events.select(*by, "path", "at", F.sum("l").over(order).alias("l"), F.sum("r").over(order).alias("r"), F.lead("at").over(order).alias("next"))
    return swept.where("l > 0 AND r = 0 AND at < next").select(*by, "path", F.col("at").alias("start_line"), (F.col("next") - 1).alias("end_line"))


def formatted(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """path and lines ('1-5, 7') of merged ranges."""
    one = F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    spans = F.array_sort(F.collect_list(F.struct("start_line", "end_line", one.alias("s"))))
    return ranges.groupBy(*by, "path").agg(F.array_join(F.transform(spans, lambda x: x["s"]), ", ").alias("lines"))


def cited(evidence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """kind, path, lines: verified ranges, and retrieved ranges without what is verified."""
    all_ = merged(clamped(evidence, by), by)
    seen = all_.where("kind = 'verified'")
    rest = subtracted(all_.where("kind = 'retrieved'"), seen, by)
    return formatted(seen, by).select(*by, F.lit("verified").alias("kind"), "path", "lines").unionByName(formatted(rest, by).select(*by, F.lit("retrieved").alias("kind"), "path", "lines"))


def source_list(citations: DataFrame, by: str, headed: bool = True) -> DataFrame:
    """by and sources: cited paths in order with their lines, as a text; headed: verified and retrieved ones apart."""
    entry = F.concat(F.lit("- "), "path", F.lit(":\n  "), "lines")
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("path", entry.alias("e"))))), lambda x: x["e"]), "\n")
    if not headed:
        return citations.groupBy(by).agg(listed(F.lit(True)).alias("sources"))
    parts = [(name, listed(F.col("kind") == name.lower())) for name in ("Verified", "Retrieved")]
    blocks = [F.when(text != "", F.concat(F.lit(f"{name}:\n\n"), text)) for name, text in parts]
    return citations.groupBy(by).agg(F.concat_ws("\n\n", *blocks).alias("sources"))


def with_sources(answer: Column, sources: Column) -> Column:
    """An answer and the list of its sources; '- none' without any."""
    return F.concat(tx.trimmed(answer), F.lit("\n\nSources:\n\n"), F.coalesce(F.nullif(sources, F.lit("")), F.lit("- none")))


def whole_files(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Every document as retrieved evidence from its first to its last line; empty ones give none."""
    n = F.size(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")).cast("long")
    return docs.where(F.col(text) != "").select(F.lit("retrieved").alias("kind"), F.col(path).cast("string").alias("path"), F.lit(1).cast("long").alias("start_line"), n.alias("end_line"))


def from_matches(matches: DataFrame, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """Every match's line is verified evidence."""
    return matches.select(*by, F.lit("verified").alias("kind"), F.col(path).cast("string").alias("path"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))


def from_hits(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every hit's lines are retrieved evidence."""
    return hits.select(*by, F.lit("retrieved").alias("kind"), F.col("path").cast("string").alias("path"), "start_line", "end_line")


def from_reads(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The lines asked for are verified evidence, also those beyond the file's end."""
    return reads.select(*by, F.lit("verified").alias("kind"), F.col("path").cast("string").alias("path"), F.col("read_start").alias("start_line"), F.col("read_end").alias("end_line"))


def novel(keys: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """The keys that weren't seen before."""
    return keys.join(seen.select(*by).distinct(), by, "left_anti")


def novel_counts(shown: DataFrame) -> DataFrame:
    """session, turn, novel_lines and already_seen: the lines that each call shows and no earlier call of its session did.

    shown: ranges (session, turn, namespace, path, start, end, synthetic) of calls; namespaces don't know of each other,
    and synthetic calls mark nothing as seen. Each line's first call is a combined minimum; only the lines of synthetic
    calls meet them again, so that a long session is many tasks' work.
    """
    line = ["session", "namespace", "path", "line"]
    each = shown.where("start <= end").select("session", "turn", "namespace", "path", "synthetic", F.explode(F.sequence("start", "end")).alias("line"))
    firsts = each.where("NOT synthetic").groupBy(*line).agg(F.min("turn").alias("first"))
    own = each.where("synthetic").select("turn", *line).distinct().join(firsts, line, "left").where("first IS NULL OR first >= turn")
    fresh = firsts.select("session", F.col("first").alias("turn")).unionByName(own.select("session", "turn")).groupBy("session", "turn").agg(F.count("*").alias("novel_lines"))
    calls = shown.select("session", "turn").distinct().join(fresh, ["session", "turn"], "left")
    novel = F.coalesce("novel_lines", F.lit(0)).cast("long")
    return calls.select("session", "turn", novel.alias("novel_lines"), (novel == 0).alias("already_seen"))
