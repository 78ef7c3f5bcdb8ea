"""Telemetry operators on hand-made rows."""

import random
import statistics
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.operators import canonical, datasets, diagnostics, features, metrics, sampling, sessions, states, temporal, validate

KEYS = ["experiment_id", "station_id"]


def keyed(spark, times, station=30, experiment="ExpX"):
    return spark.createDataFrame([(experiment, station, t) for t in times], "experiment_id string, station_id long, ts_ms long")


def test_session_rule(spark):
    plc = keyed(spark, [*range(500, 24500, 800), *range(310000, 330000, 800)])
    g = sessions.gaps(plc)
    b = sessions.local_boundaries(g, sessions.thresholds(g))
    assert [r.boundary for r in b.collect()] == [23700]
    power = keyed(spark, [499, 500, 23700, 60000, 310000, 329200, 330000])
    got = {r.ts_ms: r.session_id for r in sessions.sessions_of(power, sessions.intervals(sessions.assign_sessions(plc, b))).collect()}
    one, two = "ExpX-S30-001", "ExpX-S30-002"
    assert got == {499: None, 500: one, 23700: one, 60000: None, 310000: two, 329200: two, 330000: None}


def test_synchronized_silence(spark):
    own = {10: (1200, 1840), 20: (2400, 3040), 30: (3300, 3940)}
    rows = [("E", s, t) for s in own for t in range(0, 4801, 12) if not 600 < t < 672 and not own[s][0] < t < own[s][1]]
    plc = spark.createDataFrame(rows, "experiment_id string, station_id long, ts_ms long")
    found, shared = sessions.silences(plc)
    assert [(r.start, r.end, r.support) for r in found.collect()] == [(600, 672, 3)]
    g = sessions.gaps(plc)
    _, counts = sessions.boundary_union(sessions.local_boundaries(g, sessions.thresholds(g)), shared)
    assert {(r.station_id, r.local_boundaries, r.shared_boundaries, r.boundaries) for r in counts.collect()} == {(s, 1, 1, 2) for s in own}


@pytest.mark.parametrize("bucket", [None, 700])
def test_asof(spark, bucket):
    power = spark.createDataFrame([("p1", "s1", 1000), ("p2", "s1", 2000), ("p3", "s2", 5000), ("p4", "s1", 1500), ("p5", None, 1600), ("p6", "s1", 9000), ("p7", "s1", None)], "id string, session string, ts long")
    plc = spark.createDataFrame([("o1", "s1", 1500, True), ("o2", "s1", 8000, False), ("o3", "s1", 8000, True), ("o4", None, 1, True)], "id string, session string, ts long, busy boolean")
    got = {r.id: (r.op, r.busy, r.join_matched, r.join_ambiguous, r.state_age_seconds) for r in temporal.asof_backward(power, plc, ["session"], "ts", "ts", {"id": "op", "busy": "busy"}, bucket).collect()}
    none = (None, None, False, False, None)
    assert got == {"p1": none, "p2": ("o1", True, True, False, 0.5), "p3": none, "p4": ("o1", True, True, False, 0.0), "p5": none, "p6": (None, None, False, True, None), "p7": none}


def test_lookback_ends_and_nulls(spark):
    trig = spark.createDataFrame([(1, "a", 10000), (2, "b", 5)], "id long, k string, t long")
    rows = spark.createDataFrame([("a", 9000, 1.0), ("a", 10000, 3.0), ("a", 8999, 9.0), ("a", 9500, None), ("a", 10001, 7.0)], "k string, t long, v double")
    got = {r.id: (r.v_1s_mean, round(r.v_1s_std or 0, 6), r.n_samples_1s) for r in temporal.lookback(trig, rows, ["k"], "t", "t", ["v"], [1]).collect()}
    assert got == {1: (2.0, 1.414214, 3), 2: (None, 0, None)}


def test_latest_row_takes_nulls(spark):
    trig = spark.createDataFrame([(1, "a", 5), (2, "a", 0)], "id long, k string, t long")
    rows = spark.createDataFrame([("a", 1, 1, 7.0), ("a", 5, 1, 8.0), ("a", 5, 2, None)], "k string, t long, tie long, v double")
    assert {(r.id, r.v) for r in temporal.latest_row(trig, rows, ["k"], "t", "t", {"v": "v"}, "tie").collect()} == {(1, None), (2, None)}


def test_marks_and_windows(spark):
    rows = spark.createDataFrame([("a", t) for t in (1, 5, 6)], "k string, t long")
    marks = spark.createDataFrame([("a", 5), ("a", 5), ("a", 2)], "k string, m long")
    count = lambda inc: sorted((r.t, r.n) for r in temporal.count_marks(rows, marks, ["k"], "t", "m", inc, "n").collect())
    assert count(False) == [(1, 0), (5, 1), (6, 2)] and count(True) == [(1, 0), (5, 2), (6, 2)]
    w = temporal.anchored_window(spark.createDataFrame([("a", t) for t in (100, 1099, 1100, 5100)], "k string, t long"), ["k"], "t", 1)
    assert sorted((r.t, r.window_no) for r in w.collect()) == [(100, 0), (1099, 0), (1100, 1), (5100, 5)]


def test_islands_and_transitions_take_null_as_a_value(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, True), ("a", 4, None), (None, 5, True)], "k string, t long, v boolean")
    got = sorted((r.start_ms, r.end_ms, r.v) for r in temporal.islands(rows, ["k"], "v", "t", "t").collect())
    assert got == [(1, 2, None), (3, 3, True), (4, 4, None)]
    assert sorted(r.t for r in temporal.transitions(rows, ["k"], ["v"], "t", "t").collect()) == [3, 4]


def brute_state(station, v):
    b, r, d, e, y, x = v
    if station == 70 and v == (0, 0, 1, 0, 0, 1):
        return "idle_ready"
    if b:
        return "processing"
    if station == 50:
        return "waiting_carrier" if r and d else "idle_ready" if d else "unknown"
    if r:
        return "waiting_carrier_ready" if y else "waiting_carrier"
    if e or x:
        return "transfer" if e and x else "entering" if e else "exiting"
    return "idle_ready" if d else "unknown"


def test_state_table(spark):
    rows = [(s, *map(bool, v)) for s in (10, 50, 70) for v in product((0, 1), repeat=6)] + [(10, *[None] * 6), (None, True, *[None] * 5)]
    df = spark.createDataFrame(rows, "station_id long, " + ", ".join(f"{b} boolean" for b in states.BITS))
    got = df.withColumn("s", states.classify(F.col("station_id"), [F.col(b) for b in states.BITS])).collect()
    assert all(r.s == brute_state(r[0], tuple(int(bool(x)) for x in r[1:7])) for r in got)


def test_segment_features(spark):
    rows = spark.createDataFrame([("w", 0, "a", 1.0), ("w", 1000, "b", None), ("w", 2000, "c", 5.0), ("w", 3000, "d", 7.0), ("x", 0, "a", 2.0), ("y", 0, "a", None)], "w string, ts_ms long, row_id string, power double")
    got = {r.w: r for r in features.segment_features(rows, ["w"], others=()).collect()}
    assert got["w"].power_delta == 6 and got["w"].energy_ws == 6 and abs(got["w"].power_slope - 2) < 1e-9 and got["w"].density_hz == pytest.approx(4 / 3)
    assert got["x"].power_std == 0 and got["x"].power_slope == 0 and got["x"].density_hz is None and got["y"].power_slope is None


def test_temporal_quantiles_are_numpys(spark):
    np = pytest.importorskip("numpy")
    rows = [(n, k) for n in (1, 2, 5, 17, 40) for k in range(n)]
    df = spark.createDataFrame(rows, "n long, k long")
    for count in (1, 2, 3, 6, 16, 30):
        got = {}
        for r in sampling.temporal_quantiles(df, ["n"], ["k"], count).collect():
            got.setdefault(r.n, set()).add(r.k)
        assert got == {n: set(range(n)) if count >= n else {0} if count == 1 else set(np.unique(np.linspace(0, n - 1, count).round().astype(int)).tolist()) for n in (1, 2, 5, 17, 40)}


def test_splits(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "e string")
    assert [r.split for r in sampling.split_by(df, "e", {"a": "train", "b": "test"}, "label").orderBy("e").collect()] == ["train", "test", "unknown"]
    assert sampling.split_by(df, "e", {"a": "train"}, "drop").count() == 1
    with pytest.raises(Exception, match="no split"):
        sampling.split_by(df, "e", {"a": "train"}).collect()


def test_canonical_rows_and_conflicts(spark):
    rows = spark.createDataFrame([("b", 1, "r", 1, 1.0), ("a", 9, "r", 1, 1.0), ("a", 2, "r", 1, 1.0), ("a", 3, "r", 1, 2.0), ("a", 4, "r", 1, None), ("a", 5, "r", 1, 0.0), ("b", 6, "r", 1, -0.0)], "source_file string, line_no long, res string, t long, v double")
    ids = canonical.identified(rows, ["res", "t", "v"], F.lit("e"), F.lit("t"))
    one = canonical.canonical_rows(ids, ["res", "t", "v"])
    assert sorted((r.source_occurrence_count, r.canonical_source_file, r.canonical_source_line_number, r.lineage_source_files) for r in one.collect()) == [(1, "a", 3, ["a"]), (1, "a", 4, ["a"]), (1, "a", 5, ["a"]), (1, "b", 6, ["b"]), (3, "a", 2, ["a", "b"])]
    assert canonical.conflicts(one, ["res", "t"]).first().row_variants == 5
    assert canonical.occurrences(ids).where("status = 'kept'").count() == 5


def test_resource_names(spark):
    df = spark.createDataFrame([(" ene3_x\t",), ("mes80:plc",), ("ene9_x",), ("mes30",), (None,)], "r string")
    got = [(r.resource_id_normalized, r.station_id) for r in df.withColumns(canonical.normalised_resource(F.col("r"))).collect()]
    assert got == [("ene3_x", 30), ("mes80:plc", 80), ("ene9_x", None), ("mes30", 30), (None, None)]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 2)], "t int, p int")
    r = metrics.class_metrics(df, "t", "p").first()
    assert r.accuracy == pytest.approx(0.8) and r.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)
    assert metrics.matched_accuracy(spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 2)], "t string, c int"), "t", "c") == 0.75


def test_missing_zero_counts_false_as_zero(spark):
    df = spark.createDataFrame([(False, "5", 0.0), (True, "x", None), (None, None, 2.0)], "b boolean, s string, d double")
    got = {r.column: (r.null_count, r.zero_count, r.minimum, r.maximum) for r in diagnostics.missing_zero(df, "t").collect()}
    assert got == {"b": (1, 1, 0.0, 1.0), "s": (1, 0, 5.0, 5.0), "d": (1, 1, 0.0, 2.0)}


def test_validation_raises(spark):
    bad = validate.violations(spark.range(3), {"small": F.col("id") < 2, "null": F.lit(None).cast("boolean")})
    assert {r.invariant: r.violations for r in bad.collect()} == {"small": 1, "null": 3}
    with pytest.raises(ValueError):
        validate.require(bad)


def test_unique_join_and_one_hot(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, s string")
    assert datasets.unique_join(a, a.select("k"), "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        datasets.unique_join(a, a.select("k").union(a.select("k")), "k").collect()
    assert [tuple(r) for r in datasets.one_hot(a, "s", ["x", "y"]).select("s_x", "s_y").collect()] == [(1.0, 0.0), (0.0, 0.0)]


def test_look_back_is_that_of_each_frame(spark):
    rng = random.Random(4)
    samples = [("a" if k % 3 else None, rng.choice((None, *range(0, 40000, 250))), rng.choice((None, 5.0, 1e6 + rng.random()))) for k in range(300)]
    triggers = [(i, rng.choice(("a", "a", "b", None)), rng.choice((None, *range(0, 40000, 500)))) for i in range(60)] + [(99, "a", 7000), (99, "a", 7000)]
    out = temporal.lookback(spark.createDataFrame(triggers, "i long, k string, t long"), spark.createDataFrame(samples, "k string, ts long, v double"), ["k"], "t", "ts", ["v"], [1, 10]).collect()
    assert sorted((r.i, r.k or "", -1 if r.t is None else r.t) for r in out) == sorted((i, k or "", -1 if t is None else t) for i, k, t in triggers)
    for r in out:
        if r.k != "a":
            assert r.n_samples_1s is None and r.v_10s_mean is None
            continue
        for s in (1, 10):
            own = [v for k, t, v in samples if k == "a" and (t is None if r.t is None else t is not None and r.t - 1000 * s <= t <= r.t)]
            known = [v for v in own if v is not None]
            assert r[f"n_samples_{s}s"] == len(own)
            assert r[f"v_{s}s_mean"] == (pytest.approx(statistics.fmean(known)) if known else None)
            assert r[f"v_{s}s_std"] == (pytest.approx(statistics.stdev(known), rel=1e-9, abs=1e-9) if len(known) > 1 else 0.0)


@pytest.mark.parametrize("few", [True, False])
def test_within_intervals_broadcast_or_not(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(temporal, "MOST_INTERVALS", 0)
    intervals = spark.createDataFrame([("a", 0, 10, "x"), ("a", 20, 30, "y"), ("b", 5, 5, "z"), (None, 0, 99, "n")], "k string, f long, l long, s string")
    points = spark.createDataFrame([("a", t) for t in (-1, 0, 10, 15, 20, 30, 31, None)] + [("b", 5), ("c", 5), (None, 5)], "k string, t long")
    got = sorted(((r.k or "", -9 if r.t is None else r.t, r.s) for r in temporal.within_intervals(points, intervals, ["k"], "t", "f", "l", {"s": "s"}).collect()), key=str)
    assert got == sorted([("a", -9, None), ("a", -1, None), ("a", 0, "x"), ("a", 10, "x"), ("a", 15, None), ("a", 20, "y"), ("a", 30, "y"), ("a", 31, None), ("b", 5, "z"), ("c", 5, None), ("", 5, None)], key=str)


def test_exact_quantiles_by_rank(spark):
    np = pytest.importorskip("numpy")
    rng = random.Random(8)
    values = {"skewed": [rng.expovariate(1) ** 6 for _ in range(700)], "few": [1.0, 1.0, 2.0], "one": [5.0], "none": [None, float("nan")], "ties": [rng.choice((0.0, 3.0)) for _ in range(99)]}
    df = spark.createDataFrame([(n, v) for n, vs in values.items() for v in vs], "n string, v double")
    got = {r.n: r for r in diagnostics.exact_quantiles(df, "n", "v", 50).collect()}
    assert set(got) == set(values) - {"none"}
    for n, r in got.items():
        assert [r[c] for c in ("min", "p01", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "max")] == pytest.approx(np.quantile(values[n], [0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]).tolist())


def test_audit_finds_each_fault(spark):
    power = spark.createDataFrame([(i, "E", 10, 100 * i) for i in range(6)], "canonical_row_id long, experiment_id string, station_id long, ts_ms long")
    op = spark.createDataFrame([(50, "E", 10, "s1", 100), (51, "E", 10, "s1", 300)], "canonical_row_id long, experiment_id string, station_id long, session_id string, ts_ms long")
    intervals = spark.createDataFrame([("E", 10, "s1", 100, 300)], "experiment_id string, station_id long, session_id string, first_ms long, last_ms long")
    schema = "canonical_row_id long, experiment_id string, station_id long, ts_ms long, session_id string, operation_row_id long, plc_timestamp_epoch_ms long, state_age_seconds double, join_matched boolean, join_ambiguous boolean"
    good = [(0, "E", 10, 0, None, None, None, None, False, False)] + [(i, "E", 10, 100 * i, "s1", 50 if i < 3 else 51, 100 if i < 3 else 300, (100 * i - (100 if i < 3 else 300)) / 1000, True, False) for i in (1, 2, 3)] + [(i, "E", 10, 100 * i, None, None, None, None, False, False) for i in (4, 5)]
    empty_gaps, empty_silences = spark.createDataFrame([], "experiment_id string, station_id long, start long, end long"), spark.createDataFrame([], "experiment_id string, start long, end long")

    def bad(rows, operation=op, gaps=empty_gaps, silences=empty_silences):
        found = validate.audit(spark.createDataFrame(rows, schema), power, operation, intervals, gaps, silences).collect()
        return {r.check for r in found if r.violations}

    def changed(at, **values):
        names = [c.split()[0] for c in schema.split(", ")]
        return [tuple(values.get(n, x) for n, x in zip(names, row)) if k == at else row for k, row in enumerate(good)]

    assert bad(good) == set()
    assert {"readings_are_unique"} <= bad([*good, good[1]]) and "every_reading_is_fused" in bad(good[1:]) and "every_fused_row_is_a_reading" in bad(changed(5, canonical_row_id=77))
    assert "operation_of_same_session" in bad(changed(1, session_id="s2")) and "operation_of_same_station" in bad(changed(1, station_id=20)) and "operation_of_same_experiment" in bad(changed(1, experiment_id="F"))
    assert {"no_future_match", "operation_time_is_its_own"} <= bad(changed(1, plc_timestamp_epoch_ms=150)) and "operation_exists" in bad(changed(1, operation_row_id=9))
    assert {"outside_sessions_has_no_state", "matched_has_time"} <= bad(changed(0, plc_timestamp_epoch_ms=0)) and "unmatched_age_is_null" in bad(changed(4, state_age_seconds=1.0))
    assert "matched_readings_lie_in_their_interval" in bad(changed(4, session_id="s1", operation_row_id=51, plc_timestamp_epoch_ms=300, state_age_seconds=0.1, join_matched=True))
    assert "every_operation_has_a_session" in bad(good, op.withColumn("session_id", F.when(F.col("canonical_row_id") == 50, F.col("session_id"))))
    gaps, silences = spark.createDataFrame([("E", 10, 100, 300)], empty_gaps.schema), spark.createDataFrame([("E", 100, 300), ("E", 400, 500)], empty_silences.schema)
    assert {"readings_in_silent_gaps_have_no_session", "readings_in_silent_gaps_have_no_state", "silences_have_support"} <= bad(good, op, gaps, silences)
    assert {"silent_gaps_end_at_operations", "silent_gaps_hold_no_operation"} <= bad(good, op, spark.createDataFrame([("E", 10, 50, 300)], empty_gaps.schema))
