"""What the operators share: the cluster's shared folder, written tables, Arrow text access, sub-batches."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; working memory is a small multiple of it.
STEP_BYTES = 1_000_000
#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session says otherwise; a longer row is a batch of its own.
BATCH_BYTES = "4m"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        found = _OWN[context.applicationId]
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def in_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session sets no bound: 10,000 rows of long texts would be held several times over on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    in_batches(df.sparkSession)
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FORGET: dict[str, Callable[[], None]] = {}


def kept_by(owner: str, forget: Callable[[], None]) -> None:
    """Register how a worker gives up what ``owner`` keeps between tasks."""
    _FORGET[owner] = forget


def give_back(*owners: str) -> None:
    """In a worker: drop what others than ``owners`` keep, and return freed memory, so that one stage's tables don't add to the next one's."""
    for name, forget in _FORGET.items():
        if name not in owners:
            forget()
    pa.default_memory_pool().release_unused()
    trim = _libc_trim()
    if trim is not None:
        trim(0)


def tidy(run, *owners: str):
    """A function of batches that gives memory back before its first and after its last batch."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(*owners)
        yield from run(batches)
        give_back(*owners)

    return tidied


def tidy_group(run):
    """A function of one table that gives memory back before and after."""

    def tidied(table: pa.Table) -> pa.Table:
        give_back()
        out = run(table)
        give_back()
        return out

    return tidied


def tidy_pair(run):
    """A function of two tables that gives memory back before and after."""

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        out = run(left, right)
        give_back()
        return out

    return tidied


@functools.lru_cache(maxsize=1)
def _libc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, ...)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return pc.fill_null(column, b"").to_pylist()


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of rows with about ``most`` bytes together; a longer row stands alone."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def with_text(df: DataFrame) -> DataFrame:
    """The two columns that the text operators read, typed."""
    in_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices ``values[starts[i] : starts[i] + lens[i]]``, one after another."""
    lens = lens.astype(np.int64)
    before = np.cumsum(lens) - lens
    at = np.repeat(starts - before, lens)
    at += np.arange(len(at))
    return values[at]
