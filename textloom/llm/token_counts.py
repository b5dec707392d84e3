"""Token counts of the documents in flat token files, by a scan for separators.

The files hold fixed-width token ids and nothing else: a document ends at an end-of-document id. Each file is cut in
blocks; a task reads its blocks by offset and finds the separators of a block at once. What a block can't know, how many
documents and how many tokens of an open document lie before it, comes from a prefix scan over the blocks' few numbers:
first inside chunks of blocks, then over the chunks, so that a file of any length is many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe
from textloom.llm.common import own, partitions, shared_dir, stored, table

#: The end-of-document id and the width of a token in the files.
END, DTYPE = 50_256, "<u2"
#: Tokens in a block, and blocks in a chunk.
BLOCK_TOKENS, CHUNK_BLOCKS = 1 << 18, 256


def write_flat(docs: DataFrame, folder: str, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Writes the ids of docs (doc_id, ids) to flat files in a folder, one for each partition; returns where each went.

    The result, (file, ordinal, doc_id), is stored, so each file is written once; a task that runs again writes the
    same file anew under another name and moves it into place. Documents without tokens are a separator alone. Ids that a
    token of the files has no room for are an error.
    """
    most = np.iinfo(dtype).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.bin"
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        own, n = f"{root}/_{name}-{task.taskAttemptId()}", 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                ids = batch.column(1)
                ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
                flat = ids.flatten().to_numpy()
                if len(flat) and not 0 <= flat.min() <= flat.max() <= most:
                    raise ValueError(f"an id is outside 0 to {most}")
                out.write(np.insert(flat.astype(dtype), ends, end).tobytes())
                places = pa.array(range(n, n + len(ids)), pa.int64())
                n += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), places, batch.column(0)], names=["file", "ordinal", "doc_id"])
        store.move(own, f"{root}/{name}")

    kind = dict(docs.dtypes)["doc_id"]
    return stored(docs.select("doc_id", "ids").mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), "places")


def block_stats(files: DataFrame, end: int, dtype: str, block_tokens: int) -> DataFrame:
    """For each block of files (path, length): tokens n, separators seps, tokens before the first and after the last, and between."""
    width = np.dtype(dtype).itemsize
    last = F.floor((F.col("length") - 1) / (block_tokens * width)).cast("long")
    blocks = files.where(F.col("length") >= width).select("path", "length", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition(partitions(files.sparkSession), "path", "block")
    schema = "path string, block long, is_last boolean, n long, seps long, head long, tail long, inner array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, final, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, root = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                begin = block * block_tokens * width
                size = min(block_tokens * width, (length - begin) // width * width)
                with store.open_input_file(root) as f:
                    found = np.flatnonzero(np.frombuffer(f.read_at(size, begin), dtype) == end)
                n = size // width
                head, tail = (int(found[0]), n - 1 - int(found[-1])) if len(found) else (n, n)
                row = [[path], [block], [block == final], [n], [len(found)], [head], [tail], [(np.diff(found) - 1).tolist()]]
                yield pa.RecordBatch.from_pydict(dict(zip(["path", "block", "is_last", "n", "seps", "head", "tail", "inner"], row, strict=True)), schema=ARROW)

    return blocks.mapInArrow(run, schema)


ARROW = pa.schema([("path", pa.string()), ("block", pa.int64()), ("is_last", pa.bool_()), *((k, pa.int64()) for k in ("n", "seps", "head", "tail")), ("inner", pa.list_(pa.int64()))])


def scanned(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df (seps, open) with docs_in, open_in (before the row) and any_in (whether a separator was), open_out (after it).

    open holds the tokens after the row's last separator, or all of its tokens.
    """
    group = Window.partitionBy(*by).orderBy(order)
    so_far = group.rowsBetween(Window.unboundedPreceding, 0)
    counted = df.withColumn("_runs", F.sum((F.col("seps") > 0).cast("long")).over(so_far)).withColumn("_docs", F.sum("seps").over(so_far))
    run = Window.partitionBy(*by, "_runs").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("open_out", F.sum("open").over(run))
    before = lambda c: F.lag(c, 1, 0).over(group)
    return summed.select("*", (F.col("_docs") - F.col("seps")).alias("docs_in"), before("open_out").alias("open_in"), (before("_runs") > 0).alias("any_in")).drop("_docs", "_runs")


def count_tokens(files: DataFrame, end: int = END, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, ordinal, n_tokens) of each document of the flat files (path, length in bytes).

    Separators aren't counted. Tokens after a file's last separator are its last document; nothing after it is none. An
    empty file has no documents; bytes at the end that fill no token are left out.
    """
    stats = stored(block_stats(files, end, dtype, block_tokens), "blocks")
    stats = stats.withColumn("open", F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("n"))).withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
    inside = scanned(stats, ["path", "chunk"], "block")
    chunks = inside.groupBy("path", "chunk").agg(F.sum("seps").alias("seps"), F.max_by("open_out", "block").alias("open"))
    outside = scanned(chunks, ["path"], "chunk").select("path", "chunk", F.col("docs_in").alias("docs_0"), F.col("open_in").alias("open_0"))
    whole = inside.join(outside, ["path", "chunk"])
    open_in = F.col("open_in") + F.when(F.col("any_in"), 0).otherwise(F.col("open_0"))
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(open_in + F.col("n"))
    none: Column = F.array().cast("array<bigint>")
    lengths = F.concat(
        F.when(F.col("seps") > 0, F.concat(F.array(open_in + F.col("head")), F.col("inner"))).otherwise(none),
        F.when(F.col("is_last") & (rest > 0), F.array(rest)).otherwise(none),
    )
    first = F.col("docs_0") + F.col("docs_in")
    return whole.select("path", first.alias("first"), F.posexplode(lengths).alias("at", "n_tokens")).select("path", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens")


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the token files in a folder; the contents stay unread."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(folder).select("path", "length")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts, encoded and written as flat files, are counted: doc_id, n_tokens, file, ordinal."""
    folder = f"{shared_dir(spark)}/textloom-tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = write_flat(bpe.encode(docs, special=False).select("doc_id", "ids"), folder)
    own(spark, folder)
    counts = count_tokens(flat_files(spark, folder)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return counts.join(places, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
