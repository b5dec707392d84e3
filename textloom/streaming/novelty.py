"""Matches in a folder to which text files are added, each piece of evidence once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.lines import content, line_array


def added_files(spark: SparkSession, folder: str, at_once: int = 1000) -> DataFrame:
    """path, text and modified of whole text files, as they are added to a folder; ``at_once`` files a batch at most."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("modified"))


def matching_lines(docs: DataFrame, keep: Column) -> DataFrame:
    """path, line_no, content and modified of the lines for which ``keep``, a condition on content, holds."""
    rows = docs.select("path", "modified", F.posexplode(line_array(F.col("text"))).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line_no"), content(F.col("line")).alias("content"), "modified").where(keep)


def novel_lines(matches: DataFrame, delay: str = "1 day") -> DataFrame:
    """The matches whose path and line weren't seen within the delay; the state forgets older ones."""
    return matches.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["path", "line_no"])
