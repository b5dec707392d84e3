"""Folders as tables of files, listed level by level in the tasks, and their texts.

Spark's own listing leaves out files whose names start with a dot or an underscore and follows links; this one keeps such
files, and leaves out links, other special files, and folders that start with a dot.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.media import SNIFFED, is_text

FOUND = "path string, full string, folder boolean, length long"


def as_uri(path: str) -> str:
    """A path as a URI; one without a scheme is the machine's own, which all tasks must see."""
    return path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def children(uri: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and bytes of what lies in a folder: regular files and folders, no links."""
    if uri.startswith("file://"):
        with os.scandir(uri.removeprefix("file://")) as found:
            for e in found:
                if not e.is_symlink() and (e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)):
                    yield e.name, e.is_dir(follow_symlinks=False), 0 if e.is_dir(follow_symlinks=False) else e.stat(follow_symlinks=False).st_size
        return
    store, root = store_of(uri)
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def walked(spark: SparkSession, root: str) -> DataFrame:
    """path (from the root, with slashes), full and length of the files below a folder, at any depth, in order of path.

    Each level's folders are dealt to the tasks, which list them; what they find is written before the next level is
    listed, so that no folder is listed twice and the driver holds none of it.
    """
    top = as_uri(root).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, full in zip(batch.column("path").to_pylist(), batch.column("full").to_pylist(), strict=True):
                rows = [(f"{path}{name}", f"{full}/{name}", folder, size) for name, folder, size in children(full) if not (folder and name.startswith("."))]
                for a in range(0, len(rows), 10_000):
                    columns = zip(*rows[a : a + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["path", "full", "folder", "length"])

    files, level = [], spark.createDataFrame([("", top)], "path string, full string")
    width = spark.sparkContext.defaultParallelism
    while True:
        found = level.mapInArrow(run, FOUND).checkpoint()
        files.append(found.where("NOT folder"))
        below = found.where("folder")
        if below.isEmpty():
            break
        level = below.select(F.concat("path", F.lit("/")).alias("path"), "full").repartition(width, "path")
    out = files[0]
    for more in files[1:]:
        out = out.unionByName(more)
    return out.select("path", "full", "length").orderBy("path")


def contents(files: DataFrame, most: int | None = None) -> DataFrame:
    """files (full and others) with content: a file's bytes, or its first ``most``. A task reads one file at a time."""
    schema = files.select("*", F.lit(b"").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column("full").to_pylist()):
                store, path = store_of(uri)
                with store.open_input_stream(path) as f:
                    data = f.read(most) if most is not None else f.read()
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(run, schema)


def text_files(files: DataFrame) -> DataFrame:
    """Those of files that begin like a text; of the others only the first bytes are read."""
    return contents(files, SNIFFED).where(is_text(F.col("content"))).drop("content")


def texts(files: DataFrame) -> DataFrame:
    """path and text of the text files among files; bytes that are no UTF-8 become U+FFFD."""
    width = files.sparkSession.sparkContext.defaultParallelism
    whole = contents(text_files(files).repartition(width, "path"))
    return whole.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
