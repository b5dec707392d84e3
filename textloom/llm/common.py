"""What the operators of this subpackage share: word splitting, table access and durable intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import corpus

#: A word is a run of characters other than the ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; those of texts are dealt over all cores where they are few splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return corpus.spread(df) if name in ("documents", "pages") else df


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, use) -> Column:
    """use(x) for a value that it needs several times: the value is computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_white(text: Column) -> Column:
    """The text with a space for each other ASCII white space but the newline: byte searches, no pattern."""
    for c in "\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(column: str | Column = "text") -> Column:
    """The words of a text in order; none for a null or empty text."""
    return F.array_remove(F.split(F.replace(plain_white(text_of(column)), F.lit("\n"), F.lit(" ")), " "), "")


def word_count(column: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text_of(column), F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may do without; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders written so far by this process; what is left of them goes when it ends.
WRITTEN: list[tuple[SparkSession, str]] = []


def own(spark: SparkSession, folder: str) -> None:
    """Takes a written folder into the tables that go when the process ends, whether the session is stopped by then or not."""
    WRITTEN.append((spark, folder))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of stored tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        path.getFileSystem(conf).cancelDeleteOnExit(path)
    WRITTEN[:] = [w for w in WRITTEN if w[1] not in folders]


@contextlib.contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but those of the names ``kept``, which the result still reads."""
    before = {folder for _, folder in WRITTEN}
    yield
    for spark, folder in list(WRITTEN):
        if folder not in before and folder.rpartition("/textloom-")[2].rpartition("-")[0] not in kept:
            discard(spark, [folder])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: it cuts the lineage, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/textloom-{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    finally:
        own(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: np.ndarray, rows: int = 512, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded number and total size (one row at least)."""
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + rows]), most, "right")))
        yield at, min(end, at + rows)
        at = min(end, at + rows)


#: Bytes of a batch of rows that goes to Python, about (one row at least).
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside; the session's own comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Tables stored inside go to Python in batches of BATCH_BYTES; Spark's own are 10,000 rows, whatever these hold."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def brief_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of tables stored inside go when the table is written, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers outlive their task, and others run in them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
