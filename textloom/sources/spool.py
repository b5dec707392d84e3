"""A handle that can be read once, such as standard input, as a table of lines: spooled to the shared folder, hashed as it
is read, and read back by many tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from textloom.sources.index import files_of, shared_folder
from textloom.sources.walk import as_uri, store_of

#: Bytes read at once, and bytes after which the next line begins another task's block.
READ, BLOCK = 1 << 20, 16 << 20
LINES = "path string, line_no long, text string, byte_start long, byte_len long"


@dataclass(frozen=True)
class Spooled:
    """Where a handle's bytes lie, their SHA-256, their number, and (byte, line number) at which each block begins."""

    name: str
    full: str
    sha256: str
    n_bytes: int
    n_lines: int
    blocks: tuple[tuple[int, int], ...]

    def manifest(self) -> str:
        return json.dumps(self.__dict__)


def spooled(spark: SparkSession, handle: BinaryIO, name: str = "stdin", block: int = BLOCK) -> Spooled:
    """Copies all of a handle into a file of its own in the shared folder. Memory holds ``READ`` bytes, whatever the
    handle's length; a copy that fails is deleted at once, others when the process ends."""
    folder = f"{shared_folder(spark)}/spooled-{uuid4().hex}"
    fs, path = files_of(spark, f"{folder}/text")
    digest, at, lines, blocks, open_line = hashlib.sha256(), 0, 0, [(0, 1)], False
    out = fs.create(path, False)
    try:
        while data := handle.read(READ):
            digest.update(data)
            out.write(bytearray(data))
            due = blocks[-1][0] + block - at  # the next line that begins here or later begins a block
            if due <= len(data) and (cut := data.find(b"\n", max(0, due - 1))) >= 0:
                blocks.append((at + cut + 1, lines + data.count(b"\n", 0, cut + 1) + 1))
            lines += data.count(b"\n")
            at, open_line = at + len(data), not data.endswith(b"\n")
        out.close()
    except BaseException:
        out.close()
        fs.delete(path.getParent(), True)
        raise
    fs.deleteOnExit(path.getParent())
    blocks = [b for b in blocks if b[0] < at]
    return Spooled(name, as_uri(f"{folder}/text"), digest.hexdigest(), at, lines + open_line, tuple(blocks))


def discard(spark: SparkSession, found: Spooled) -> None:
    """Deletes a spooled file, when nothing reads it any more."""
    fs, path = files_of(spark, found.full)
    fs.delete(path.getParent(), True)


class SpooledLines(DataSource):
    """The lines of a spooled file: format spooled_lines, option manifest. A task reads a block by its place."""

    @classmethod
    def name(cls) -> str:
        return "spooled_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(json.loads(self.options["manifest"]))


class LineReader(DataSourceReader):
    def __init__(self, manifest: dict):
        self.manifest = manifest

    def partitions(self) -> list[InputPartition]:
        starts = [tuple(b) for b in self.manifest["blocks"]]
        ends = [b[0] for b in starts[1:]] + [self.manifest["n_bytes"]] if starts else []
        return [InputPartition((start, line, end)) for (start, line), end in zip(starts, ends, strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:  # an empty handle has no block
            return
        start, line, end = partition.value
        store, path = store_of(self.manifest["full"])
        with store.open_input_file(path) as f:
            f.seek(start)
            held = b""
            while start + len(held) < end or held:
                data = f.read(min(READ, end - start - len(held)))
                parts = (held + data).split(b"\n")
                held = parts.pop()
                for part in parts:
                    yield self.manifest["name"], line, part.decode("utf-8", "replace"), start, len(part)
                    start, line = start + len(part) + 1, line + 1
                if not data and held:
                    yield self.manifest["name"], line, held.decode("utf-8", "replace"), start, len(held)
                    return


def lines(spark: SparkSession, found: Spooled) -> DataFrame:
    """path, line_no, text, byte_start and byte_len of a spooled handle's lines, as of a file."""
    spark.dataSource.register(SpooledLines)
    return spark.read.format("spooled_lines").option("manifest", found.manifest()).load()


def document(spark: SparkSession, found: Spooled) -> DataFrame:
    """The handle as a document: one row of path and text."""
    from pyspark.sql import functions as F

    whole = spark.read.text(found.full, wholetext=True)
    return whole.select(F.lit(found.name).alias("path"), F.col("value").alias("text"))
