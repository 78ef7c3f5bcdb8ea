"""The chained stages over dumps: common pipeline, ground truth, idle durations, state experiment.

Each stage writes Parquet below ``out``, checked before it takes its place, and returns the DataFrames it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical as cn
from ..operators import datasets as ds
from ..operators import diagnostics as dg
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import ml
from ..operators import sampling as sm
from ..operators import sessions as se
from ..operators import states as st
from ..operators import temporal as tp
from ..operators import validate as va
from ..sources import dumps, files, sinks

KEYS = ["experiment_id", "station_id"]
SESSION = [*KEYS, "session_id"]


@dataclass(frozen=True)
class Settings:
    quantile: float = 0.95
    min_ratio: float = 2.0
    top_gaps: int = 3
    station_fraction: float = 0.6
    station_count: int = 2
    relative_duration: float = 0.2
    age_review_seconds: float = 1800.0
    window_seconds: tuple[int, ...] = (1, 2, 5)
    purity: float = 0.8
    min_known: float = 0.5
    min_dwell: float = 1.0
    lookback_seconds: tuple[int, ...] = (1, 10)
    thresholds_seconds: tuple[float, ...] = (28, 60, 120)
    per_class: tuple[tuple[str, int], ...] = (("train", 40), ("validation", 20), ("test", 20))


def _kept(spark: SparkSession, df: DataFrame, out: str, name: str, check=lambda written: None) -> DataFrame:
    path = f"{out.rstrip('/')}/{name}"
    sinks.promote(spark, df, path, check)
    return spark.read.parquet(path)


def common(spark: SparkSession, raw: str, out: str, settings: Settings = Settings(), manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dumps in folders by experiment -> canonical rows, sessions, and one fused row a power reading."""
    inventory = files.files(spark, raw).withColumns(files.classify_source(F.col("name"), F.col("extension")))
    if manifest is not None:
        files.require_manifest(inventory, manifest)
    selection = files.select_snapshots(inventory)
    parsed = _kept(spark, dumps.read_dumps(spark, raw).withColumn("experiment_id", F.split_part("source_file", F.lit("/"), F.lit(1))), out, "parsed_rows")
    chosen = parsed.join(F.broadcast(selection.select(F.col("canonical_source_file").alias("source_file"), "ordinary_counterpart")), "source_file")  # a row a dump
    typed = {}
    for table in ("tblPowerLog", "tblOperationLog"):
        rows = dumps.table_rows(chosen, table).withColumns({"experiment_id": F.split_part("source_file", F.lit("/"), F.lit(1)), "table": F.lit(table)})
        rows = rows.withColumn("canonical_row_id", F.sha2(F.concat_ws("\0", "experiment_id", "table", "digest"), 256))
        names = [c for c in rows.columns if c not in ("source_file", "line_no", "canonical_row_id")]
        one = cn.canonical_rows(rows, names).withColumns(cn.normalised_resource(F.col("ResourceID")))
        ts = F.timestamp_millis(F.col("timeStamp"))
        one = one.withColumns({"ts_ms": F.col("timeStamp"), "timestamp_utc": ts, "timestamp_europe_rome": F.from_utc_timestamp(ts, "Europe/Rome").cast("timestamp_ntz")})
        typed[table] = _kept(spark, one, out, f"canonical_{table}")
    power, operation = typed["tblPowerLog"], typed["tblOperationLog"]
    gap_rows = se.gaps(operation)
    threshold = se.thresholds(gap_rows, q=settings.quantile, min_ratio=settings.min_ratio)
    silences, shared = se.silences(operation, settings.top_gaps, settings.station_fraction, settings.station_count, settings.relative_duration)
    boundaries, counts = se.boundary_union(se.local_boundaries(gap_rows, threshold), shared)
    plc = _kept(spark, se.assign_sessions(operation, boundaries), out, "operation_sessions")
    intervals = _kept(spark, se.intervals(plc), out, "session_intervals")
    sessions = se.sessions_of(power, intervals)
    payload = [c for c in dumps.KINDS if c in plc.columns and c not in ("ResourceID", "timeStamp")]
    columns = {"canonical_row_id": "operation_row_id", "ResourceID": "plc_resource_id_original", "canonical_source_file": "plc_source_file", "lineage_source_files": "plc_lineage_source_files", "mes_resource_id": "mes_resource_id_plc", **{c: c for c in payload}}
    own = [c for c in sessions.columns if c not in columns.values()]
    fused = ds.fuse(sessions.select(*own), plc, SESSION, "ts_ms", columns)
    expected = power.count()

    def check(written: DataFrame) -> None:
        va.require(va.violations(written, va.fused_rules()))
        if written.count() != expected or written.select("canonical_row_id").distinct().count() != expected:
            raise ValueError("fused rows aren't one a power row")

    fused = _kept(spark, fused, out, "power_operation_fused", check)
    reports = {
        "thresholds": threshold, "silences": silences, "boundary_counts": counts, "join_coverage": dg.join_coverage(fused, SESSION), "usage": dg.usage_summary(dg.operation_usage(plc, fused, "canonical_row_id", "operation_row_id"), KEYS),
        "sampling": dg.sampling_report(sessions, SESSION), "presence": dg.presence(power, operation, KEYS), "power_outside": sessions.where("session_id is null").groupBy(*KEYS).agg(F.count("*").alias("n")), "highest_age": dg.highest_age(fused, 100, "canonical_row_id"), "old_matches": fused.where(F.col("state_age_seconds") > settings.age_review_seconds).groupBy(*SESSION).agg(F.count("*").alias("n")),
        "snapshot_overlap": cn.snapshot_overlap(parsed.withColumns({"canonical_row_id": F.col("digest"), "ts_ms": F.element_at("values", F.array_position("columns", F.lit("timeStamp")).cast("int")).cast("long")}), ["experiment_id", "table_name"]),
        "dump_profile": dg.raw_profile(parsed.withColumns({"resource": F.element_at("values", 1), "ts": F.element_at("values", 2).cast("long")}), ["source_file", "table_name"], "resource", "ts", "line_no", "digest"), "selection": selection,
    }
    for name, df in reports.items():
        sinks.write_table(df, f"{out.rstrip('/')}/reports/{name}")
    return {"fused": fused, "plc": plc, "intervals": intervals, "power": power, **reports}


def ground_truth(spark: SparkSession, fused: DataFrame, out: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """States, windows of each width with labels and features, run-length segments and their durations."""
    rows = fused.where("join_matched").withColumn("plc_state", st.classify(F.col("station_id"), [F.col(b) for b in st.BITS]))
    rows = _kept(spark, rows, out, "classified")
    labels, found = None, {}
    for s in settings.window_seconds:
        windows = tp.anchored_window(rows, SESSION, "ts_ms", s)
        label = st.majority(windows, [*SESSION, "window_no"], purity=settings.purity, least_known=settings.min_known).withColumn("window_seconds", F.lit(s))
        labels = label if labels is None else labels.unionByName(label)
        found[f"features_{s}s"] = _kept(spark, ft.segment_features(windows, [*SESSION, "window_no"], "ts_ms", "canonical_row_id", "ActivePowerL1", ("Flow", "Pressure")), out, f"gt_features_{s}s")
    found["windows"] = _kept(spark, labels, out, "gt_windows")
    found["segments"] = _kept(spark, tp.islands(rows, SESSION, "plc_state", "ts_ms", "canonical_row_id"), out, "gt_state_segments")
    found["durations"] = _kept(spark, ft.duration_statistics(found["segments"], ["station_id", "plc_state"], dwell=settings.min_dwell), out, "gt_duration_stats")
    return {"classified": rows, **found}


def idle_durations(spark: SparkSession, fused: DataFrame, segments: DataFrame, splits: dict[str, str], out: str, settings: Settings = Settings(), trees: int = 300) -> dict[str, DataFrame]:
    """Idle dataset, naive and learned predictions, errors and decisions."""
    values = ["ActivePowerL1", "Flow", "Pressure"]
    at = {c: c for c in ("state_age_seconds", "OperationNo", "OrderNo", "PartNumber")}
    data = ds.idle_dataset(segments, fused, SESSION, values, at, "ts_ms", "canonical_row_id", list(settings.lookback_seconds), settings.min_dwell)
    data = _kept(spark, sm.split_by(data, "experiment_id", splits, "drop"), out, "idle_dataset")
    features = [f"{v}_{s}s_{k}" for v in values for s in settings.lookback_seconds for k in ("mean", "std")] + [f"n_samples_{settings.lookback_seconds[0]}s", "prev_duration", "time_since_processing_s", "cycles_before", "station_id", "hour_of_day", *at]
    full = data.na.drop(subset=[*features, "target_log1p"]).withColumn("label", F.col("target_log1p"))
    states = [r[0] for r in full.select("prev_state").where("prev_state is not null").distinct().orderBy("prev_state").collect()]  # names of states
    full = ds.naive_predictions(ds.one_hot(full, "prev_state", states), "station_id", "start_ms", "duration_seconds", "split")
    x = ml.assembled(full, [*features, *(f"prev_state_{s}" for s in states)]).persist()
    keep = ["split", "station_id", "start_ms", "duration_seconds"]
    log = ds.prediction_log(x, "naive_previous", "full", F.col("naive_previous"), keep, False).unionByName(ds.prediction_log(x, "naive_median", "full", F.col("naive_median"), keep, False))
    for name, learner in ml.regressors(20260915, trees).items():
        log = log.unionByName(ds.prediction_log(learner.fit(x.where("split = 'train'")).transform(x), name, "full", F.col("prediction"), keep))
    log = _kept(spark, log, out, "idle_predictions")
    errors = mt.regression_metrics(log, ["model", "condition", "split"], F.col("duration_seconds"), F.col("prediction"), in_log=False)
    decisions = mt.decision_metrics(log.where("split = 'test'"), ["model", "condition"], "duration_seconds", "prediction", list(settings.thresholds_seconds), {"all": F.lit(True), "without_station_50": F.col("station_id") != 50})
    return {"dataset": data, "predictions": log, "metrics": _kept(spark, errors, out, "idle_metrics"), "decisions": _kept(spark, decisions, out, "idle_decision_metrics")}


def state_experiment(spark: SparkSession, features: DataFrame, windows: DataFrame, splits: dict[str, str], out: str, settings: Settings = Settings(), trees: int = 300) -> DataFrame:
    """Clustering and classification of windows: merged classes, a class sample, k-means, learners, a kernel of a bounded sample."""
    key = [*SESSION, "window_no"]
    rows = features.join(windows.select(*key, "inferred_state"), key).withColumn("class", st.merged_class(F.col("inferred_state"))).where("class is not null")
    rows = sm.split_by(rows.withColumn("label", st.class_number(F.col("class")).cast("double")), "experiment_id", splits, "label")
    names = ["power_mean", "power_std", "power_range", "power_slope", "Flow_mean", "Pressure_mean"]
    sample = sm.class_sample(rows.na.drop(subset=names), "split", "class", "station_id", ["start_ms", *key], dict(settings.per_class)).persist()
    out_rows = []
    for k in (2, 4):
        c = ml.clusters(sample, names, k, 20260915)
        r = mt.adjusted_rand(c, "class", "cluster").first()
        out_rows.append((f"kmeans_{k}", "unsupervised", float(r.ari), float(r.nmi), float(mt.matched_accuracy(c, "class", "cluster"))))
    x = ml.balanced_weights(ml.assembled(sample, names), "label").persist()
    for name, learner in ml.classifiers(20260915, trees).items():
        test = learner.fit(x.where("split = 'train'")).transform(x.where("split = 'test'"))
        r = mt.class_metrics(test, "label", "prediction").first()
        out_rows.append((name, "supervised", None, float(r.macro_f1 or 0.0), float(r.accuracy or 0.0)))
    metrics = spark.createDataFrame(out_rows, "model string, paradigm string, ari double, score double, accuracy double")
    return _kept(spark, metrics, out, "parallel_metrics")
