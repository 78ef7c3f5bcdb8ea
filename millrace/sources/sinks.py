"""Sinks: Parquet as the canonical form, gzip CSV beside it, replace-by-model, staged promotion."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dumps import TABLES

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``; local sessions may leave it unset)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="millrace-")
        _OWN[spark.sparkContext.applicationId] = folder
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def write_table(df: DataFrame, path: str, if_exists: str = "replace", partition_by: list[str] | None = None, sort: list[str] | None = None, csv: bool = False) -> None:
    """Parquet below ``path``; with ``csv`` a gzip CSV beside it, arrays and structs as JSON."""
    own = df.sortWithinPartitions(*sort) if sort else df
    writer = own.write.mode(MODES[if_exists])
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if csv:
        flat = own.select(*[F.to_json(f"`{n}`").alias(n) if k.startswith(("array", "struct", "map")) else F.col(f"`{n}`") for n, k in own.dtypes])
        flat.write.mode(MODES[if_exists]).option("header", "true").option("compression", "gzip").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").csv(path.rstrip("/") + "_csv")


def replace_where(spark: SparkSession, df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of ``column`` that ``df`` holds and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def promote(spark: SparkSession, df: DataFrame, path: str, check) -> None:
    """Write beside the target, check what was written, then take the target's place: nobody reads an unchecked table."""
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    check(spark.read.parquet(staged))
    jvm = spark.sparkContext._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"can't rename {staged}")


def report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def schema_dictionary(spark: SparkSession) -> DataFrame:
    rows = [(t, n, k) for t, spec in TABLES.items() for n, k in (c.split() for c in spec.split(", "))]
    return spark.createDataFrame(rows, "table string, column string, kind string")


def schema_json(df: DataFrame) -> str:
    return json.dumps({f.name: f.dataType.simpleString() for f in df.schema}, indent=2)
