"""Dumps, files, CSV, sinks, and the stages from dump to experiment on a made-up line."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans import pipelines
from millrace.sources import dumps, files, sinks

COLUMNS = {t: [c.split()[0] for c in spec.split(", ")] for t, spec in dumps.TABLES.items()}


def block(table, rows):
    head = ", ".join(f'"{c}"' for c in COLUMNS[table])
    return f'COPY demo."{table}" ({head}) FROM stdin;\n' + "".join("\t".join(r) + "\n" for r in rows) + "\\.\n"


def write(folder, name, *blocks, end="\n"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("CREATE SCHEMA demo;\n" + "".join(blocks)).replace("\n", end).encode())


ROW = ["mes60:camera", "1551234567890", "t", "f", "t", "f", "\\N", "t", "f", "7", "12", "\\N", "3", "\\N", "other", "2", "0"]


def test_copy_keeps_null_false_and_zero_apart(spark, tmp_path):
    write(tmp_path, "E/a.sql", block("tblOperationLog", [ROW]), "noise\n", block("tblMachineReport", []), end="\r\n")
    rows = dumps.read_dumps(spark, str(tmp_path))
    r = dumps.table_rows(rows, "tblOperationLog").first()
    assert rows.count() == 1 and r.Busy is True and r.StationEntryxBG5 is False and r.ReadyAtStationxBG1 is None and r.PartNumber == 0 and r.OrderNo is None and r.source_file == "E/a.sql" and r.line_no == 3


def test_copy_escapes_and_errors(spark, tmp_path):
    assert dumps.unescape(r"a\tb\\n\qc\n") == "a\tb\\nqc\n"
    write(tmp_path / "bad", "b.sql", block("tblPowerLog", [["ene1_x", "1", "2"]]))
    with pytest.raises(Exception, match="b.sql:3"):
        dumps.read_dumps(spark, str(tmp_path / "bad")).collect()
    write(tmp_path / "bool", "c.sql", block("tblMachineReport", [["ene1_x", "1", "x", "t", "t"]]))
    with pytest.raises(Exception, match="no boolean"):
        dumps.read_dumps(spark, str(tmp_path / "bool")).collect()


def test_files_selection_and_manifest(spark, tmp_path):
    for n in ("E/x.sql", "E/x_new.sql", "E/y.sql", "F/z_new.sql", "F/query_1.txt"):
        write(tmp_path, n)
    found = files.files(spark, str(tmp_path))
    chosen = {(r.canonical_source_file, r.ordinary_counterpart, r.selection_reason) for r in files.select_snapshots(found).collect()}
    assert chosen == {("E/x_new.sql", "E/x.sql", "_new preferred"), ("E/y.sql", None, "only ordinary dump available"), ("F/z_new.sql", None, "only _new available")}
    assert {r.name: r.source_type for r in found.withColumns(files.classify_source(F.col("name"), F.col("extension"))).collect()}["query_1.txt"] == "sparse_query_export"
    manifest = found.select("path", F.when(F.col("path") == "E/y.sql", "0").otherwise(F.col("sha256")).alias("sha256")).where("path <> 'E/x.sql'").union(spark.createDataFrame([("gone.sql", "1")], "path string, sha256 string"))
    assert {(r.path, r.problem) for r in files.manifest_difference(found, manifest).collect()} == {("E/x.sql", "untracked"), ("E/y.sql", "changed"), ("gone.sql", "missing")}
    assert files.same_content(found).first().n == 5


def test_exports_and_logs(spark):
    text = ["2019-03-05_10:00:00.5 | a | 1 | early", "id | DateAndTime | v | w", "2019-03-05_10:00:00.500 | a | 1 | ", "  2019-03-05_10:00:02.000|a|2|x", "2019-03-05_10:00:01.000|b||x", "2019-03-05_10:00:01.000|b|", "x 2019-03-05_10:00:01.000|a|b|c", "2019-03-05_10:00:02.000|a|2|x"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "source_file string, line_no long, value string")
    got = files.query_export(lines).orderBy("line_no").collect()
    assert [(r.line_no, r.ts_ms - 1551780000000, r.series) for r in got] == [(2, 500, "a"), (3, 2000, "a"), (4, 1000, "b"), (7, 2000, "a")]
    assert got[0].fields == {"id": "2019-03-05_10:00:00.500", "DateAndTime": "a", "v": "1", "w": ""}
    profile, columns = files.export_profile(lines)
    r = profile.first()
    assert (r.line_count, r.record_count, r.duplicate_rows, r.repeated_times, r.gap_count, r.gap_median) == (8, 4, 0, 1, 2, 750.0)
    assert {c.column: c.missing_count for c in columns.collect()} == {"id": 0, "DateAndTime": 0, "v": 1, "w": 1}
    log = spark.createDataFrame([("f", 1, '{"timestampms": 1551234567890, "topic": "a/b", "x": {"y": 1}}'), ("f", 2, "nothing"), ("f", 3, "timestampms: 1551234567895"), ("f", 4, "{topic: 'a/b', timestampms: 1551234567890}")], "source_file string, line_no long, value string")
    assert [(r.ts_ms, r.topic) for r in files.event_log(log).orderBy("line_no").collect()] == [(1551234567890, "a/b"), (1551234567895, "unknown"), (1551234567890, "a/b")]
    profile, topics = files.log_profile(log)
    r = profile.first()
    assert (r.line_count, r.record_count, r.duplicate_rows, r.keys, r.delimiter) == (4, 3, 1, ["timestampms", "topic", "x", "y"], "Node-RED multiline log")
    assert {t.topic: t.events for t in topics.collect()} == {"a/b": 2, "unknown": 1}


def test_contents(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"plain"),), (bytearray("é".encode("cp1252")),), (bytearray("\ufeffé".encode()),)], "content binary")
    assert tuple(df.limit(1).select(*[v.alias(k) for k, v in files.png_size(F.col("content")).items()]).first()) == (640, 480)
    assert [r[0] for r in df.select(files.text_encoding("content")).collect()][1:] == ["ascii", "cp1252", "utf-8-sig"]
    assert df.select(files.workbook_sheets("content")).first()[0] == []


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "demo.csv.gz"
    path.write_bytes(gzip.compress(b"flag,count,label,at\ntrue,1,a,2019-04-16T07:00:00.123Z\nfalse,2,b,2019-04-16T07:00:01Z\n,,c,\n"))
    kinds = {"flag": "boolean", "count": "Int64", "label": "string", "at": "datetime64[ms, UTC]"}
    got = files.load_csv(spark, str(path), kinds).collect()
    assert [r["count"] for r in got] == [1, 2, None] and sum(r["at"] is not None for r in got) == 2 and got[2].flag is None
    with pytest.raises(ValueError, match="columns differ"):
        files.load_csv(spark, str(path), {**kinds, "more": "string"})
    with pytest.raises(Exception, match="has a null"):
        files.load_csv(spark, str(path), {**kinds, "count": "int64"}).collect()


def test_promotion_needs_a_passed_check(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.promote(spark, spark.range(3), path, lambda w: None)

    def refuse(written):
        raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.promote(spark, spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 3
    sinks.replace_where(spark, spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int"), f"{path}2", "model")
    sinks.replace_where(spark, spark.createDataFrame([("a", 9)], "model string, v int"), f"{path}2", "model")
    assert {(r.model, r.v) for r in spark.read.parquet(f"{path}2").collect()} == {("a", 9), ("b", 2)}


def line(rng, day):
    power, plc = [], []
    for station in (1, 2):
        t = day
        for k in range(120):
            t += rng.choice((400, 500, 600)) if k != 60 else 400_000
            bits = [rng.choice("tf") for _ in range(7)]
            plc.append([f"mes{station}0_x", str(t), *bits[:3], *bits[3:], *[str(k)] * 5, f"mes{station}0", "1", "2"])
            for d in (50, 150, 250, 350):
                power.append([f"ene{station}_x", str(t + d), f"{rng.uniform(10, 90):.4f}", "1.5", "\\N" if rng.random() < 0.1 else "6.0"])
    return power, plc


def test_stages_from_dumps_to_experiment(spark, tmp_path):
    rng = random.Random(7)
    for n, day in enumerate(("Exp20190124", "Exp20190320", "Exp20190416")):
        power, plc = line(rng, 1548000000000 + n * 10**9)
        write(tmp_path, f"raw/{day}/one.sql", block("tblPowerLog", power[:300]), block("tblOperationLog", plc[:100]))
        write(tmp_path, f"raw/{day}/two.sql", block("tblPowerLog", power[200:]), block("tblOperationLog", plc[50:]))
    settings = pipelines.Settings(window_seconds=(1, 5))
    made = pipelines.common(spark, str(tmp_path / "raw"), str(tmp_path / "out"), settings)
    fused = made["fused"]
    assert fused.count() == 3 * 2 * 480 == made["power"].count()
    assert made["intervals"].count() == 12 and fused.where("join_matched").count() > 2000
    assert fused.where("join_matched and (state_age_seconds < 0 or state_age_seconds > 1)").count() == 0
    assert made["snapshot_overlap"].where("table_name = 'tblPowerLog'").first().shared_rows == 100
    truth = pipelines.ground_truth(spark, fused, str(tmp_path / "out"), settings)
    assert truth["segments"].agg(F.sum("n_rows")).first()[0] == fused.where("join_matched").count()
    splits = {"Exp20190124": "train", "Exp20190320": "validation", "Exp20190416": "test"}
    quick = pipelines.Settings(window_seconds=(1, 5), min_dwell=0.0, lookback_seconds=(1, 10), thresholds_seconds=(0.1, 0.3))
    idle = pipelines.idle_durations(spark, truth["classified"], truth["segments"], splits, str(tmp_path / "out"), quick, trees=3)
    assert {r.model for r in idle["metrics"].collect()} == {"naive_previous", "naive_median", "random_forest", "boosted_trees"}
    assert idle["decisions"].where("tp + fp + fn + tn <> n").count() == 0
    experiment = pipelines.state_experiment(spark, truth["features_1s"], truth["windows"].where("window_seconds = 1"), splits, str(tmp_path / "out"), settings, trees=3)
    assert {r.model for r in experiment.collect()} == {"kmeans_2", "kmeans_4", "logistic", "random_forest"}
