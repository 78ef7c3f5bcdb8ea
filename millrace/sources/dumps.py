"""Plain-text database dumps: a Spark data source that reads COPY blocks, and their profiles.

``spark.read.format("pgcopy").load(folder or file)`` gives a row for each line of each block: source_file, line_no (from 1),
schema_name, table_name, columns, values (nulls kept apart from empty texts), digest (of table, columns and typed
values).  One partition a file, read as a stream; a block begins at its header and ends at ``\\.``; lines outside are ignored;
a line with another number of fields than its header fails with file and line.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_HEADER = re.compile(r'^COPY\s+([^.\s]+)\."?([^"\s(]+)"?\s*\((.*)\)\s+FROM\s+stdin;\s*$')
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_ESCAPED = re.compile(r"\\(.)", re.S)

#: Tables, their columns and kinds.
TABLES = {
    "tblMachineReport": "ResourceID string, timeStamp int64, Busy boolean, RFIDTagPresent boolean, Done boolean",
    "tblOperationLog": "ResourceID string, timeStamp int64, Busy boolean, RFIDTagPresent boolean, Done boolean, StationEntryxBG5 boolean, ReadyAtStationxBG1 boolean, DoneWorkingxBG9 boolean, StationExitxBG6 boolean, OperationNo integer, WorkPlanNo integer, OrderNo integer, StepNo integer, CarrierID integer, iResourceID string, OrderPosition integer, PartNumber integer",
    "tblPowerLog": "ResourceID string, timeStamp int64, ActivePowerL1 numeric, Flow numeric, Pressure numeric",
    "tblSensorsLog": "ResourceID string, timeStamp int64, StationEntryxBG5 boolean, ReadyAtStationxBG1 boolean, DoneWorkingxBG9 boolean, StationExitxBG6 boolean",
}
KINDS = {name: kind for spec in TABLES.values() for name, kind in (c.split() for c in spec.split(", "))}
_SPARK = {"string": "string", "int64": "bigint", "integer": "bigint", "boolean": "boolean", "numeric": "double"}


def unescape(text: str) -> str:
    """COPY escapes in one pass from the left; an unknown escape is the character itself."""
    return _ESCAPED.sub(lambda m: _ESCAPES.get(m[1], m[1]), text)


def typed(column: str, raw: str | None):
    """The value of a raw field by its column's kind; null is null, a bad value fails."""
    if raw is None:
        return None
    kind = KINDS.get(column, "string")
    if kind == "boolean":
        if raw not in ("t", "f"):
            raise ValueError(f"{column}: {raw!r} is no boolean")
        return raw == "t"
    if kind in ("int64", "integer"):
        return int(raw)
    return float(raw) if kind == "numeric" else raw


class CopyFile(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__((path, name))
        self.path, self.name = path, name


class CopyDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgcopy"

    def schema(self) -> str:
        return "source_file string, line_no long, schema_name string, table_name string, columns array<string>, values array<string>, digest string"

    def reader(self, schema) -> DataSourceReader:
        return CopyReader(self.options["path"], self.options.get("suffix", ".sql"))


class CopyReader(DataSourceReader):
    def __init__(self, path: str, suffix: str = ".sql"):
        self.path, self.suffix = path, suffix

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        if self.path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + self.path[5:].lstrip("/")
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[CopyFile]:
        fs, root = self._fs()
        info = fs.get_file_info(root)
        if info.is_file:
            return [CopyFile(root, info.base_name)]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [CopyFile(f.path, f.path[len(root.rstrip("/")) + 1 :]) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))]

    def read(self, partition: CopyFile) -> Iterator[pa.RecordBatch]:
        fs, _ = self._fs()
        block, rows = None, []
        with fs.open_input_stream(partition.path) as stream:
            for number, line in enumerate(_lines(stream), 1):
                if block is None:
                    m = _HEADER.match(line)
                    if m:
                        block = (m[1], m[2], [c.strip().strip('"') for c in m[3].split(",")])
                elif line == "\\.":
                    block = None
                else:
                    schema, table, columns = block
                    fields = line.split("\t")
                    if len(fields) != len(columns):
                        raise ValueError(f"{partition.name}:{number}: {len(fields)} fields for {len(columns)} columns")
                    values = [None if f == "\\N" else unescape(f) for f in fields]
                    payload = {"table": table, "columns": columns, "values": [typed(c, v) for c, v in zip(columns, values)]}
                    digest = hashlib.sha256(json.dumps(payload, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
                    rows.append((partition.name, number, schema, table, columns, values, digest))
                    if len(rows) == 4096:
                        yield _arrow(rows)
                        rows = []
        if rows:
            yield _arrow(rows)


_ARROW = pa.schema([("source_file", pa.string()), ("line_no", pa.int64()), ("schema_name", pa.string()), ("table_name", pa.string()), ("columns", pa.list_(pa.string())), ("values", pa.list_(pa.string())), ("digest", pa.string())])


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _lines(stream, size: int = 1 << 20) -> Iterator[str]:
    left = b""
    while data := stream.read(size):
        *whole, left = (left + data).split(b"\n")
        for line in whole:
            yield line.rstrip(b"\r").decode("utf-8", "surrogateescape")
    if left:
        yield left.rstrip(b"\r").decode("utf-8", "surrogateescape")


def read_dumps(spark: SparkSession, path: str, suffix: str = ".sql") -> DataFrame:
    spark.dataSource.register(CopyDump)
    return spark.read.format("pgcopy").option("suffix", suffix).load(path)


def _escaped(c: Column) -> Column:
    c = c.cast("string")
    for raw, text in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(text))
    return F.coalesce(c, F.lit("\\N"))


def write_dump(df: DataFrame, path: str, table: str, schema: str = "public") -> None:
    """COPY blocks below ``path``, a file for each partition, each with its header and end."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    head = f'COPY {schema}."{table}" ({names}) FROM stdin;'
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = df.select(F.concat_ws("\t", *[_escaped(F.col(f"`{c}`")) for c in df.columns]).alias("value"), F.lit(1).alias("k"))
    body = body.withColumn("p", F.pmod(F.xxhash64("value"), F.lit(n)))
    ends = spark.range(n).select(F.col("id").alias("p"), F.explode(F.array(F.struct(F.lit(head).alias("value"), F.lit(0).alias("k")), F.struct(F.lit("\\.").alias("value"), F.lit(2).alias("k")))).alias("r")).select("r.value", "r.k", "p")
    body.unionByName(ends).repartition(n, "p").sortWithinPartitions("p", "k").select("value").write.text(path)


def table_rows(rows: DataFrame, table: str) -> DataFrame:
    """The rows of one table, with its columns typed; a bad boolean or number fails.  Keeps source_file, line_no and digest."""
    spec = [c.split() for c in TABLES[table].split(", ")]

    def value(name: str, kind: str) -> Column:
        raw = F.element_at(F.col("values"), F.array_position("columns", F.lit(name)).cast("int"))
        if kind == "boolean":
            return F.when(raw == "t", True).when(raw == "f", False).when(raw.isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: "), raw, F.lit(" is no boolean"))).cast("boolean"))
        return raw.cast(_SPARK[kind])

    own = rows.where(F.col("table_name") == table)
    return own.select("source_file", "line_no", "digest", *[F.when(F.array_contains("columns", n), value(n, k)).alias(n) for n, k in spec])
