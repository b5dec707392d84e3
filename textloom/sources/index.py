"""Chunk indexes: tables of chunks with vectors and a manifest, found by the hash of their source, in generations."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from uuid import uuid4

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.text import folded
from textloom.operators import chunking
from textloom.operators.semantic import path_bucket

#: The layout's version; other versions count as missing.
VERSION = 3
#: Parts of an index by path.
BUCKETS = 64
TTL = timedelta(hours=24)
MANIFEST = "version int, created_at timestamp, input_hash string, model string, chunk_size int, chunk_overlap int, item_count long, columns string"


class IndexExists(ValueError):
    """The index is there already."""


class IndexBroken(RuntimeError):
    """The index can't be read although it was just written, by this or another writer."""


def files_of(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and the folder's path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def generations(spark: SparkSession, base: str, input_hash: str) -> list[tuple[int, str]]:
    """(generation, name) of the indexes written for a hash, the one that counts first: the latest generation, of those
    written at once the one whose name is first."""
    fs, folder = files_of(spark, f"{base.rstrip('/')}/{input_hash}")
    names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [m.groups() for n in names if (m := re.fullmatch(r"g(\d+)-([0-9a-f]+)", n))]
    return sorted(((int(g), name) for g, name in found), key=lambda x: (-x[0], x[1]))


def write_index(chunks: DataFrame, base: str, input_hash: str, model: str, size: int, overlap: int, ttl: timedelta = TTL) -> None:
    """Writes chunks and manifest into a folder of their own and names it the hash's latest generation by an empty file.

    Raises if a fresh index is there by then. Nothing that is written is ever replaced or deleted here, so writers at the
    same time don't harm each other: each one's index is whole before it is named, and all readers take the same one.
    Chunks lie in a folder for each path_bucket, by path, so that a search in one path reads its own part alone. A
    large part, such as that of a very common path, is many files.
    """
    spark, name = chunks.sparkSession, uuid4().hex
    folder = f"{base.rstrip('/')}/{input_hash}"
    if load_index(spark, base, input_hash, ttl) is not None:
        raise IndexExists(input_hash)
    fs, own = files_of(spark, f"{folder}/data-{name}")
    try:
        placed = chunks.withColumn("path_bucket", path_bucket(F.col("path"), BUCKETS))
        placed.hint("rebalance", "path_bucket").sortWithinPartitions("path_bucket", "path").write.partitionBy("path_bucket").parquet(f"{folder}/data-{name}/chunks")
        n = spark.read.schema(placed.schema).parquet(f"{folder}/data-{name}/chunks").count()
        row = (VERSION, datetime.now(timezone.utc), input_hash, model, size, overlap, n, placed.schema.json())
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{folder}/data-{name}/manifest")
        if load_index(spark, base, input_hash, ttl) is not None:  # another writer was faster
            raise IndexExists(input_hash)
    except BaseException:
        fs.delete(own, True)
        raise
    latest = max([g for g, _ in generations(spark, base, input_hash)], default=0)
    fs.createNewFile(files_of(spark, f"{folder}/g{latest + 1:010d}-{name}")[1])


def clear_indexes(spark: SparkSession, base: str, ttl: timedelta = TTL) -> list[str]:
    """Deletes what was written into the indexes below base longer ago than ttl, whole ones and drafts; returns the
    hashes of which something went.

    Folders that aren't indexes are left alone, and so is all that is younger, whatever lies beside it.
    """
    fs, top = files_of(spark, base)
    if not fs.exists(top):
        return []
    oldest, gone = (datetime.now(timezone.utc) - ttl).timestamp() * 1000, []
    for status in (s for s in fs.listStatus(top) if s.isDirectory()):
        parts = [p for p in fs.listStatus(status.getPath()) if re.fullmatch(r"data-[0-9a-f]+|g\d+-[0-9a-f]+", p.getPath().getName())]
        old = [p for p in parts if p.getModificationTime() < oldest and fs.delete(p.getPath(), True)]
        if old:
            gone.append(status.getPath().getName())
            if not list(fs.listStatus(status.getPath())):
                with contextlib.suppress(Exception):  # a writer may have come in between: a folder that isn't empty stays
                    fs.delete(status.getPath(), False)
    return sorted(gone)


def read_manifest(spark: SparkSession, base: str, input_hash: str, name: str | None = None):
    """The manifest of one written index, or of the one that counts; None if there is none."""
    named = [name] if name else [n for _, n in generations(spark, base, input_hash)[:1]]
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base.rstrip('/')}/{input_hash}/data-{named[0]}/manifest").first() if named else None
    except AnalysisException:
        return None


def load_index(spark: SparkSession, base: str, input_hash: str, ttl: timedelta = TTL) -> DataFrame | None:
    """The chunks, with path_bucket, of a complete index of this layout that isn't too old, else None. Of the latest
    generation, one that can't be read is passed over."""
    found = generations(spark, base, input_hash)
    for _, name in [x for x in found if x[0] == found[0][0]]:
        m = read_manifest(spark, base, input_hash, name)
        if m is None or m["version"] != VERSION:
            continue
        created = m["created_at"].replace(tzinfo=m["created_at"].tzinfo or datetime.now().astimezone().tzinfo)
        if datetime.now(timezone.utc) - created > ttl:
            continue
        with contextlib.suppress(PySparkException, Py4JJavaError):  # files that are gone or broken
            chunks = spark.read.schema(StructType.fromJson(json.loads(m["columns"]))).parquet(f"{base.rstrip('/')}/{input_hash}/data-{name}/chunks")
            if chunks.count() == m["item_count"]:
                return chunks
    return None


def build_or_load(spark: SparkSession, base: str, input_hash: str, build: Callable[[], DataFrame], model: str, size: int, overlap: int, ttl: timedelta = TTL) -> DataFrame:
    """The index's chunks, built and written as a new generation if there is none, or if it is stale or broken."""
    found = load_index(spark, base, input_hash, ttl)
    if found is None:
        with contextlib.suppress(IndexExists):  # another writer was faster: its index is as good
            write_index(build(), base, input_hash, model, size, overlap, ttl)
        found = load_index(spark, base, input_hash, ttl)
        if found is None:
            raise IndexBroken(input_hash)
    return found


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """chunks with vector (array of float) from an embedder that takes lists of texts; texts are folded, batches small."""
    return embedded_counted(chunks, embed, batch)[0]


def embedded_counted(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> tuple[DataFrame, Observation]:
    """The same with an observation of embedding_calls and embedding_tokens (estimated), taken by the job that embeds."""
    rows = chunks.withColumn("_input", folded(F.col("text")))
    seen, used = Observation(), ("embedding_calls", "embedding_tokens")

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                texts = part.column(part.schema.get_field_index("_input")).to_pylist()
                vectors = embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                kept = part.drop_columns(["_input"])
                counts = [pa.array([1] + [0] * (len(texts) - 1), pa.int64()), pa.array([chunking.approx(len(t or "")) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(vectors, pa.list_(pa.float32())), *counts], names=[*kept.schema.names, "vector", *used])

    zero = [F.lit(0).cast("long").alias(c) for c in used]
    out = rows.mapInArrow(run, chunks.select("*", F.array().cast("array<float>").alias("vector"), *zero).schema)
    return out.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in used]).drop(*used), seen
