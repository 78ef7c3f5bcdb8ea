"""Files as rows: manifests, digests, classification, selection of snapshots, exports, logs, workbooks, images."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_ms, extract
from ..operators import diagnostics as dg


def files(spark: SparkSession, path: str) -> DataFrame:
    """path (relative), name, extension, bytes and sha256 of every file below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").split("://")[-1].removeprefix("file:")) + "/", "")
    name = F.element_at(F.split(relative, "/"), -1)
    extension = F.coalesce(F.lower(extract(name, r"(\.[^.]+)$")), F.lit(""))
    return read.select(relative.alias("path"), name.alias("name"), extension.alias("extension"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_difference(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and problem (missing, untracked, changed) of each file that differs from the manifest (path, sha256)."""
    m = manifest.select("path", F.col("sha256").alias("expected"))
    j = found.select("path", "sha256").join(m, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "untracked").when(F.col("sha256") != F.col("expected"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def manifest(found: DataFrame) -> DataFrame:
    """The manifest of files found, to be kept beside them: path, bytes, sha256.  Paths that leave their folder fail."""
    away = F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").startswith("/")
    path = F.when(away, F.raise_error(F.concat(F.lit("a path leaves its folder: "), F.col("path"))).cast("string")).otherwise(F.col("path"))
    return found.select(path.alias("path"), "bytes", "sha256")


def require_manifest(found: DataFrame, manifest: DataFrame) -> None:
    bad = manifest_difference(found, manifest).limit(20).collect()
    if bad:
        raise ValueError("files differ from the manifest: " + ", ".join(f"{r.path} ({r.problem})" for r in bad))


def same_content(found: DataFrame) -> DataFrame:
    """Groups of files with equal bytes."""
    return found.groupBy("bytes", "sha256").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")


def classify_source(name: Column, extension: Column) -> dict[str, Column]:
    """Source type and pipeline role, by ordered rules on name and extension (fixed values, first match wins)."""
    low = F.lower(name)
    rules = [
        (extension == ".sql", "primary_sql_snapshot", "canonical_candidate"),
        (low.startswith("query_"), "sparse_query_export", "validation_only"),
        (low.startswith("probe") | (low.startswith("dump_") & (extension == ".txt")), "probe_opcua_log", "auxiliary_only"),
        (low.startswith("1_") | low.startswith("2_fuse"), "probe_annotated_capture", "auxiliary_only"),
        (extension == ".xlsx", "workbook", "documentation_or_validation_only"),
        (extension == ".png", "screenshot", "documentation_only"),
    ]
    kind, role = F.lit("other"), F.lit("inventory_only")
    for test, k, r in reversed(rules):
        kind, role = F.when(test, k).otherwise(kind), F.when(test, r).otherwise(role)
    return {"source_type": kind, "pipeline_role": role}


#: Role, confidence and note of a file, first match wins.
ROLES = (
    (lambda n: n.endswith(".sql"), "database snapshot containing power and PLC/MES tables", "confirmed", "PostgreSQL COPY dump"),
    (lambda n: n.startswith("query_"), "sparse union-style export of power and operation/PLC events", "probable", "not a time-fused table; requires original query confirmation"),
    (lambda n: n.startswith("probe") | (n.startswith("dump_") & n.endswith(".txt")), "OPC UA / Node-RED sensor event log", "probable", "sensor/topic semantics require confirmation"),
    (lambda n: n.startswith("1_") | n.startswith("2_fuse"), "annotated Node-RED sensor capture", "probable", "manual headings require interpretation"),
    (lambda n: n.startswith("datalogger"), "OPC UA data logger workbook", "probable", "workbook semantics require confirmation"),
    (lambda n: n.contains("elaborazioni"), "manually derived/analysis workbook", "probable", "not a primary raw source until lineage is confirmed"),
    (lambda n: n.contains("summary"), "experiment summary workbook", "probable", "contextual/derived source"),
    (lambda n: n.contains("performancemonitor"), "system-performance screenshot", "confirmed", "contextual evidence, not a tabular measurement source"),
    (lambda n: (n == "ui4155.png") | n.startswith("produzione"), "Node-RED energy-dashboard screenshot", "confirmed", "contextual validation of drill-station power profile"),
)


def role_of(name: Column) -> Column:
    low = F.lower(name)
    row = lambda r, c, n: F.struct(F.lit(r).alias("role"), F.lit(c).alias("confidence"), F.lit(n).alias("note"))
    out = row("unclassified", "to_confirm", "")
    for test, *rest in reversed(ROLES):
        out = F.when(test(low), row(*rest)).otherwise(out)
    return out


def select_snapshots(paths: DataFrame, path: str = "path") -> DataFrame:
    """Of X.sql and X_new.sql the latter, alone files as they are: experiment_id, canonical_source_file, ordinary_counterpart, selection_reason."""
    stem = F.regexp_replace(F.col(path), r"(_new)?\.sql$", "")
    named = paths.where(F.col(path).endswith(".sql")).select(F.col(path).alias("p"), stem.alias("stem"), F.col(path).endswith("_new.sql").alias("is_new"))
    both = named.groupBy("stem").agg(F.max(F.when(F.col("is_new"), F.col("p"))).alias("new"), F.max(F.when(~F.col("is_new"), F.col("p"))).alias("old"))
    reason = F.when(F.col("new").isNotNull() & F.col("old").isNotNull(), "_new preferred").when(F.col("new").isNotNull(), "only _new available").otherwise("only ordinary dump available")
    chosen = F.coalesce("new", "old")
    return both.select(F.split_part(chosen, F.lit("/"), F.lit(1)).alias("experiment_id"), chosen.alias("canonical_source_file"), F.when(F.col("new").isNotNull(), F.col("old")).alias("ordinary_counterpart"), reason.alias("selection_reason"))


def query_export(lines: DataFrame, delimiter: str = "|", line: str = "value", order: str = "line_no", file: str = "source_file") -> DataFrame:
    """Records of a delimited export: the first line with "dateandtime" is its header; later lines that begin with a time and have as many fields are records.

    A time is a date and a time of day joined by ``_`` (a space or T also reads).  file, line_no, ts_ms, series (the second field), fields (trimmed, a
    map by header), digest.
    """
    parts = F.transform(F.split(F.col(line), re.escape(delimiter)), lambda x: F.trim(x))
    head = lines.where(F.lower(F.col(line)).contains("dateandtime")).groupBy(file).agg(F.min_by(parts, order).alias("header"), F.min(order).alias("__from"))
    begins = r"^\s*(\d{4}-\d{2}-\d{2})[_ T](\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
    ts = F.when(F.col(line).rlike(begins), F.concat(F.regexp_extract(line, begins, 1), F.lit(" "), F.regexp_extract(line, begins, 2)))
    joined = lines.withColumns({"__p": parts, "__t": epoch_ms(F.try_to_timestamp(ts).cast("timestamp_ntz"))}).join(F.broadcast(head), file)  # a row a file
    kept = joined.where(F.col("__t").isNotNull() & (F.size("__p") == F.size("header")) & (F.col(order) > F.col("__from")))
    series = F.coalesce(F.try_element_at("__p", F.lit(2)), F.lit(""))
    return kept.select(file, order, F.col("__t").alias("ts_ms"), series.alias("series"), F.map_from_arrays("header", "__p").alias("fields"), F.sha2(F.col(line), 256).alias("digest"))


def export_profile(lines: DataFrame, delimiter: str = "|", line: str = "value", order: str = "line_no", file: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Per export: lines, records, repeats, ends and gaps of each series; and per export and column the missing (empty) fields."""
    records = query_export(lines, delimiter, line, order, file)
    profile = lines.groupBy(file).agg(F.count("*").alias("line_count")).join(dg.time_profile(records, [file], "series", "ts_ms", order, "digest"), file, "left")
    return profile, dg.column_profile(records, [file], "fields", F.col("v") == "", numeric=False)


def event_log(lines: DataFrame, line: str = "value", order: str = "line_no", file: str = "source_file") -> DataFrame:
    """Events of a log, of JSON lines or annotated text: lines that carry ``timestampms``; topic (or "unknown") and the names they give values.

    Lines that read as JSON objects give their own members; in others a name stands before a colon, perhaps in quotes.
    """
    object_keys = F.json_object_keys(F.trim(line))
    is_json = object_keys.isNotNull()
    quote = "[\"']?"
    at = extract(F.col(line), rf"\btimestampms{quote}\s*:\s*{quote}(\d{{13}})(?!\d)")
    topic = F.coalesce(F.when(is_json, F.get_json_object(line, "$.topic")), extract(F.col(line), rf"\btopic{quote}\s*:\s*[\"']([^\"']*)"), F.lit("unknown"))
    names = F.regexp_extract_all(F.col(line), F.lit(rf"\b([A-Za-z]\w*){quote}\s*:"), F.lit(1))
    return lines.select(file, order, at.cast("long").alias("ts_ms"), topic.alias("topic"), F.array_distinct(F.when(is_json, F.array_union(object_keys, names)).otherwise(names)).alias("keys"), F.sha2(F.concat_ws("\0", at, topic), 256).alias("digest")).where("ts_ms is not null")


def log_profile(lines: DataFrame, line: str = "value", order: str = "line_no", file: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Per log: lines, events, repeats (of time and topic), ends, gaps within topics, all names, and whether every line is an event; and events per topic."""
    events = event_log(lines, line, order, file)
    names = events.select(file, F.explode("keys").alias("k")).groupBy(file).agg(F.array_sort(F.collect_set("k")).alias("keys"))
    counted = lines.groupBy(file).agg(F.count("*").alias("line_count")).join(dg.time_profile(events, [file], "topic", "ts_ms", order, "digest"), file, "left").join(names, file, "left")
    kind = F.when(F.col("line_count") == F.col("record_count"), "JSON Lines").otherwise("Node-RED multiline log")
    return counted.withColumn("delimiter", kind), events.groupBy(file, "topic").agg(F.count("*").alias("events"))


def png_size(content: Column) -> dict[str, Column]:
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return {"width": number(17), "height": number(21)}


@F.pandas_udf(T.StringType())
def text_encoding(content: pd.Series) -> pd.Series:
    """ascii, utf-8-sig or cp1252, whichever reads the first MiB first; else unknown."""

    def one(data: bytes) -> str:
        for name in ("ascii", "utf-8-sig", "cp1252"):
            try:
                data[: 1 << 20].decode(name)
                return name
            except UnicodeDecodeError:
                continue
        return "unknown"

    return content.map(one)


_SHEET = T.StructType([T.StructField(n, t) for n, t in (("sheet", T.StringType()), ("dimension", T.StringType()), ("rows", T.LongType()), ("formulas", T.LongType()), ("errors", T.LongType()))])


@F.pandas_udf(T.ArrayType(_SHEET))
def workbook_sheets(content: pd.Series) -> pd.Series:
    """Sheets of an OOXML workbook: name, dimension, rows, formulas and cached errors; none for what is no workbook."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def one(data: bytes) -> list[dict]:
        try:
            book = zipfile.ZipFile(io.BytesIO(data))
            names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet")]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return []
        out = []
        for k, name in enumerate(names, 1):
            sheet = {"sheet": name, "dimension": None, "rows": 0, "formulas": 0, "errors": 0}
            try:
                with book.open(f"xl/worksheets/sheet{k}.xml") as stream:
                    for _, e in ElementTree.iterparse(stream):
                        if e.tag == f"{main}dimension":
                            sheet["dimension"] = e.get("ref")
                        elif e.tag == f"{main}row":
                            sheet["rows"] += 1
                            e.clear()
                        elif e.tag == f"{main}f":
                            sheet["formulas"] += 1
                        elif e.tag == f"{main}c" and e.get("t") == "e":
                            sheet["errors"] += 1
            except KeyError:
                pass
            out.append(sheet)
        return out

    return content.map(one)


_DTYPES = {"boolean": "boolean", "Int64": "bigint", "int64": "bigint", "Float64": "double", "float64": "double", "string": "string", "object": "string"}


def dataset_name(path: str) -> str:
    """The data set that a CSV file, plain or gzip, is named after."""
    return re.sub(r"\.csv(\.gz)?$", "", path.rstrip("/").rsplit("/", 1)[-1])


def load_recorded(spark: SparkSession, path: str, schemas: str, derived_zone: str | None = None) -> DataFrame:
    """A CSV file with the types that a JSON file of recorded schemas (data set -> column -> type) gives its data set."""
    recorded = json.loads(spark.read.text(schemas, wholetext=True).first()[0])
    name = dataset_name(path)
    if name not in recorded:
        raise ValueError(f"no schema is recorded for {name}")
    return load_csv(spark, path, recorded[name], derived_zone)


def load_csv(spark: SparkSession, path: str, columns: dict[str, str], derived_zone: str | None = None) -> DataFrame:
    """A CSV file (gzip too) with its recorded types.  Missing or extra columns fail; so does a null in an ``int64`` column.

    Times are ISO texts of either precision, read one by one; ``datetime64[..., ZONE]`` other than UTC become wall clock.
    """
    raw = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    if set(raw.columns) != set(columns):
        raise ValueError(f"columns differ: missing {sorted(set(columns) - set(raw.columns))}, extra {sorted(set(raw.columns) - set(columns))}")
    out = []
    for name, dtype in columns.items():
        c = F.nullif(F.col(f"`{name}`"), F.lit(""))
        if dtype.startswith("datetime64"):
            at = F.to_timestamp(c)
            zone = dtype.rstrip("]").split(", ")[-1] if ", " in dtype else "UTC"
            out.append((at if zone == "UTC" else F.from_utc_timestamp(at, zone).cast("timestamp_ntz")).alias(name))
        else:
            v = c.cast(_DTYPES[dtype])
            if dtype == "int64":
                v = F.when(v.isNull(), F.raise_error(F.lit(f"{name} has a null")).cast("bigint")).otherwise(v)
            out.append(v.alias(name))
    return raw.select(*out)
