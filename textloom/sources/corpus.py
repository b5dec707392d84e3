"""Text files and folders as document tables."""

from __future__ import annotations

import hashlib
import sys
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.media import is_text
from textloom.sources import index, spool, walk

#: Digests that are hashed together in a corpus's hash.
FAN = 4096

def spread(docs: DataFrame) -> DataFrame:
    """A table as it is read, dealt anew where it has fewer splits than there are cores: a small file of one split, say.

    A large table keeps its splits and isn't shuffled.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), text of the text files below a folder, at any depth, also of those whose names start with a dot;
    links and folders that start with a dot are left out."""
    return walk.texts(walk.walked(spark, folder))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path (base name, with #2, #3 ... where it repeats) and text of single files."""
    files = spark.read.format("binaryFile").load(paths)
    named = files.where(is_text(F.col("content"))).select(F.col("path").alias("full"), F.element_at(F.split("path", "/"), -1).alias("path"), F.col("content").cast("string").alias("text"))
    return disambiguated(named, "full").drop("full")


def open_input(spark: SparkSession, path: str | None = None, handle: BinaryIO | None = None) -> tuple[str, DataFrame]:
    """What a question is asked of, as its kind (directory, file or stdin) and documents (path, text, source).

    A folder is its text files, and an error without any; a file is one document, text or not, under its base name; no
    path, or a blank one, is the handle, by default standard input, which is spooled to the shared folder.
    """
    if not path or not path.strip():
        found = spool.spooled(spark, handle or sys.stdin.buffer)
        return "stdin", spool.document(spark, found).withColumn("source", F.lit("stdin"))
    fs, place = index.files_of(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    if fs.isDirectory(place):
        docs = read_folder(spark, path)
        if docs.isEmpty():
            raise ValueError(f"{path} holds no text files")
        return "directory", docs.withColumn("source", F.lit(path))
    one = spark.createDataFrame([(path.rstrip("/").rpartition("/")[2], walk.as_uri(path))], "path string, full string")
    return "file", walk.contents(one).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(path).alias("source"))


def placed(rows: DataFrame, at: str) -> DataFrame:
    """rows with place: their number from 0 in the order of the column ``at``. No task sees more than its range of them.

    Rows are dealt by ranges and sorted there; the ranges' sizes, a row for each partition, say where each begins.
    """
    ranged = rows.repartitionByRange(at).sortWithinPartitions(at).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    own = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), part == F.col("_part")).select(*rows.columns, own.alias("place"))


def disambiguated(docs: DataFrame, order: str) -> DataFrame:
    """docs with repeated paths told apart in order of a unique column: the second is path#2, the third path#3; taken names are skipped.

    Texts don't go with the names. However often a path repeats, its rows are numbered in ranges; only families in which
    names with a number are there already are gone through one by one, each in one task.
    """

    def named(group: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        names = []
        for path in group.sort_values("_order")["path"]:
            name, k = path, used.get(path, 0)
            while name in used:
                k += 1
                name = f"{path}#{k}"
            if name != path:
                used[path] = k
            used[name] = 1
            names.append(name)
        return pd.DataFrame({"_order": group["_order"].sort_values(), "_name": names})

    keys = docs.select(F.col(order).alias("_order"), "path", F.regexp_replace("path", r"(#[0-9]+)+$", "").alias("_root"))
    numbered = keys.where("path <> _root").select("_root").distinct()
    schema = keys.select("_order", F.col("path").alias("_name")).schema
    odd = keys.join(numbered, "_root", "left_semi").groupBy("_root").applyInPandas(named, schema)
    plain = placed(keys.join(numbered, "_root", "left_anti").select(F.struct("path", "_order").alias("_at")), "_at").select("_at.*", "place")
    first = plain.groupBy(F.col("path").alias("_path")).agg(F.min("place").alias("_first"))
    k = F.col("place") - F.col("_first") + 1
    even = plain.join(first, F.col("path").eqNullSafe(F.col("_path"))).select("_order", F.when(k == 1, F.col("path")).otherwise(F.concat("path", F.lit("#"), k.cast("string"))).alias("_name"))
    return docs.join(even.unionByName(odd), F.col(order) == F.col("_order")).withColumn("path", F.col("_name")).drop("_order", "_name")


def entry(path: Column, text: Column) -> Column:
    """A document as a part of a corpus text: a header line, the text, and a newline where it has none at its end."""
    end = F.when((text == "") | text.endswith("\n"), "").otherwise("\n")
    return F.concat(F.lit("=== file: "), path, F.lit(" ===\n"), text, end)


def corpus_parts(docs: DataFrame) -> DataFrame:
    """path and part: the corpus text is the parts in order of path, joined by a newline. It is never built in one row."""
    return docs.select("path", entry(F.col("path"), F.col("text")).alias("part"))


def sized(value: Column) -> Column:
    """A value with the number of its bytes before it, so that joined values can't be taken for others."""
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def content_hash(docs: DataFrame, *options: object, order: tuple[str, ...] = ("path",)) -> str:
    """A hash of options and of all documents (path, text) in order; null texts count as empty.

    A tree: each document's digest, in the order of the columns ``order`` (unique, else equal rows in the order of their
    digests), then those of ``FAN`` neighbours at a time, up to one. Any partitioning gives the same; documents that swap
    texts or places give another. Only digests are sorted, and no task sees more than ``FAN`` of them at once.
    """
    leaf = F.sha2(F.concat(sized(F.col("path").cast("string")), sized(F.coalesce("text", F.lit("")))), 256).alias("digest")
    level = placed(docs.select(F.struct(*order, leaf).alias("at")), "at").select("place", F.col("at.digest").alias("digest"))
    n = level.count()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    while n > 1:
        level = level.groupBy(F.floor(F.col("place") / FAN).alias("node")).agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest")).withColumnRenamed("node", "place")
        n = -(-n // FAN)
    root = level.first()
    parts = [f"{len(str(o).encode())}:{o}" for o in options] + [root["digest"] if root else "none"]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()
