"""The query catalogue on the star-schema test tables, and the SQL that each query must agree with.

The event stream stands in for telemetry: a station is 10 * (1 + user_id % 8), an experiment the week of the event,
machine records are purchase and error events, power samples the others with ``value`` as watts, and the six state bits
are those of event_id % 64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms
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
Q, RATIO = 0.95, 1.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    bits = {b: F.expr(f"(event_id >> {5 - k}) & 1") == 1 for k, b in enumerate(st.BITS)}
    return e.select(
        "event_id", "user_id", "event_type", "value", epoch_ms(F.col("ts")).alias("ts_ms"), F.date_sub(day, F.weekday(day)).cast("string").alias("experiment_id"),
        (10 * (1 + F.col("user_id") % 8)).cast("long").alias("station_id"), *[v.alias(k) for k, v in bits.items()],
    )


EVENTS = """e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS experiment_id,
  CAST(10 * (1 + user_id % 8) AS BIGINT) AS station_id, ((event_id >> 5) & 1) = 1 AS b, ((event_id >> 4) & 1) = 1 AS r, ((event_id >> 3) & 1) = 1 AS d,
  ((event_id >> 2) & 1) = 1 AS n, ((event_id >> 1) & 1) = 1 AS y, (event_id & 1) = 1 AS x FROM events),
plc AS (SELECT * FROM e WHERE event_type IN ('purchase', 'error')), pw AS (SELECT * FROM e WHERE event_type NOT IN ('purchase', 'error'))"""


def plc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type in ('purchase', 'error')")


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type not in ('purchase', 'error')")


STATE = """CASE WHEN station_id = 70 AND NOT b AND NOT r AND d AND NOT n AND NOT y AND x THEN 'idle_ready'
  WHEN station_id = 50 THEN CASE WHEN b THEN 'processing' WHEN r AND d THEN 'waiting_carrier' WHEN NOT r AND d THEN 'idle_ready' ELSE 'unknown' END
  WHEN b THEN 'processing' WHEN r AND y THEN 'waiting_carrier_ready' WHEN r THEN 'waiting_carrier' WHEN n AND x THEN 'transfer' WHEN n THEN 'entering'
  WHEN x THEN 'exiting' WHEN d THEN 'idle_ready' ELSE 'unknown' END"""


def with_state(rows: DataFrame) -> DataFrame:
    return rows.withColumn("plc_state", st.classify(F.col("station_id"), [F.col(b) for b in st.BITS]))


# ---- sessions

SESSIONS = (
    EVENTS
    + """, t AS (SELECT DISTINCT experiment_id, station_id, ts_ms FROM plc),
g AS (SELECT * FROM (SELECT experiment_id, station_id, ts_ms AS s, lead(ts_ms) OVER (PARTITION BY experiment_id, station_id ORDER BY ts_ms) AS f FROM t) WHERE f IS NOT NULL),
fl AS (SELECT experiment_id, station_id, count(*) AS gap_count, quantile_cont(f - s, 0.95) AS tail_floor FROM g GROUP BY ALL),
tail AS (SELECT DISTINCT g.experiment_id, g.station_id, f - s AS gap FROM g JOIN fl USING (experiment_id, station_id) WHERE gap_count >= 2 AND f - s >= tail_floor),
jm AS (SELECT * FROM (SELECT *, lag(gap) OVER (PARTITION BY experiment_id, station_id ORDER BY gap) AS below FROM tail) WHERE below IS NOT NULL),
jr AS (SELECT *, gap / below AS ratio, row_number() OVER (PARTITION BY experiment_id, station_id ORDER BY CAST(gap AS DOUBLE) / below DESC, gap) AS rn FROM jm),
th AS (SELECT fl.experiment_id, fl.station_id, gap_count, tail_floor, below AS gap_below, gap AS gap_above, ratio AS jump_ratio,
  CASE WHEN ratio >= 1.2 THEN sqrt(CAST(below AS DOUBLE) * CAST(gap AS DOUBLE)) END AS threshold_ms FROM fl LEFT JOIN jr ON fl.experiment_id = jr.experiment_id AND fl.station_id = jr.station_id AND rn = 1),
bd AS (SELECT g.experiment_id, g.station_id, s AS boundary FROM g JOIN th USING (experiment_id, station_id) WHERE f - s > threshold_ms),
ps AS (SELECT plc.*, 1 + (SELECT count(*) FROM bd WHERE bd.experiment_id = plc.experiment_id AND bd.station_id = plc.station_id AND bd.boundary < plc.ts_ms) AS session_no FROM plc),
sp AS (SELECT *, experiment_id || '-S' || lpad(CAST(station_id AS VARCHAR), 2, '0') || '-' || lpad(CAST(session_no AS VARCHAR), CAST(greatest(3, length(CAST(session_no AS VARCHAR))) AS INTEGER), '0') AS session_id FROM ps),
iv AS (SELECT experiment_id, station_id, session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS row_count FROM sp GROUP BY ALL),
pp AS (SELECT pw.*, iv.session_id FROM pw LEFT JOIN iv ON pw.experiment_id = iv.experiment_id AND pw.station_id = iv.station_id AND pw.ts_ms BETWEEN first_ms AND last_ms),
m AS (SELECT experiment_id, station_id, session_id, ts_ms, count(*) AS c, min(event_id) AS op_id, bool_or(b) AS b, bool_or(r) AS r, bool_or(d) AS d, bool_or(n) AS n, bool_or(y) AS y, bool_or(x) AS x, min(value) AS op_value FROM sp GROUP BY ALL),
fu AS (SELECT p.event_id, p.user_id, p.value, p.ts_ms, p.experiment_id, p.station_id, p.session_id, coalesce(m.c > 1, false) AS join_ambiguous, coalesce(m.c = 1, false) AS join_matched,
  CASE WHEN m.c = 1 THEN m.ts_ms END AS plc_ts, CASE WHEN m.c = 1 THEN op_id END AS operation_row_id, CASE WHEN m.c = 1 THEN (p.ts_ms - m.ts_ms) / 1000.0 END AS age,
  CASE WHEN m.c = 1 THEN m.b END AS b, CASE WHEN m.c = 1 THEN m.r END AS r, CASE WHEN m.c = 1 THEN m.d END AS d, CASE WHEN m.c = 1 THEN m.n END AS n, CASE WHEN m.c = 1 THEN m.y END AS y, CASE WHEN m.c = 1 THEN m.x END AS x
  FROM pp p ASOF LEFT JOIN m ON p.experiment_id = m.experiment_id AND p.station_id = m.station_id AND p.session_id = m.session_id AND p.ts_ms >= m.ts_ms),
fs AS (SELECT *, """
    + STATE
    + """ AS plc_state FROM fu WHERE join_matched)"""
)


def plc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.gaps(plc(spark, sf_dir))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = plc_gaps(spark, sf_dir)
    return se.local_boundaries(g, se.thresholds(g, q=Q, min_ratio=RATIO))


def plc_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.assign_by_threshold(plc(spark, sf_dir), se.thresholds(plc_gaps(spark, sf_dir), q=Q, min_ratio=RATIO))


def power_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.sessions_of(power(spark, sf_dir), se.intervals(plc_sessions(spark, sf_dir)))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = plc_sessions(spark, sf_dir).withColumn("op_id", F.col("event_id"))
    own = power_sessions(spark, sf_dir).select("event_id", "user_id", "value", "ts_ms", *SESSION)
    return ds.fuse(own, right, SESSION, "ts_ms", {"op_id": "operation_row_id", **{b: b for b in st.BITS}})


def fused_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_state(fused(spark, sf_dir).where("join_matched"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.islands(fused_states(spark, sf_dir), SESSION, "plc_state", "ts_ms", "event_id")


SEGMENTS = (
    SESSIONS
    + """, i1 AS (SELECT *, CASE WHEN plc_state IS DISTINCT FROM lag(plc_state) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM fs WINDOW w AS (PARTITION BY experiment_id, station_id, session_id ORDER BY ts_ms, event_id)),
i2 AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id, station_id, session_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS no FROM i1),
sg AS (SELECT experiment_id, station_id, session_id, plc_state, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_rows, (max(ts_ms) - min(ts_ms)) / 1000.0 AS duration_seconds FROM i2 GROUP BY experiment_id, station_id, session_id, no, plc_state)"""
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else "WITH " + sql
        return f

    return add


@query(SESSIONS + "SELECT event_id, session_id, operation_row_id, plc_ts AS plc_timestamp_epoch_ms, join_ambiguous, join_matched, round(age, 6) AS state_age_seconds FROM fu")
def asof_backward_state(spark, sf_dir):
    return fused(spark, sf_dir).select("event_id", "session_id", "operation_row_id", "plc_timestamp_epoch_ms", "join_ambiguous", "join_matched", F.round("state_age_seconds", 6).alias("state_age_seconds"))


HOURLY = EVENTS + """, l AS (SELECT event_id, user_id, ts_ms // 3600000 * 3600000 AS h FROM pw), o AS (SELECT user_id, ts_ms // 3600000 * 3600000 AS h, count(*) AS c, min(event_id) AS op_id FROM plc GROUP BY ALL)
SELECT event_id, coalesce(c > 1, false) AS join_ambiguous, coalesce(c = 1, false) AS join_matched, CASE WHEN c = 1 THEN op_id END AS operation_row_id,
  CASE WHEN c = 1 THEN round((l.h - o.h) / 1000.0, 6) END AS state_age_seconds FROM l ASOF LEFT JOIN o ON l.user_id = o.user_id AND l.h >= o.h"""


def _hourly(spark, sf_dir, bucket_ms=None):
    hour = F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000
    l, o = power(spark, sf_dir).select("event_id", "user_id", hour.alias("h")), plc(spark, sf_dir).select("user_id", hour.alias("h"), F.col("event_id").alias("op_id"))
    out = tp.asof_backward(l, o, ["user_id"], "h", "h", {"op_id": "operation_row_id"}, bucket_ms)
    return out.select("event_id", "join_ambiguous", "join_matched", "operation_row_id", F.round("state_age_seconds", 6).alias("state_age_seconds"))


@query(HOURLY)
def asof_ambiguous_nulls(spark, sf_dir):
    return _hourly(spark, sf_dir)


@query(HOURLY)
def asof_bucketed_timeline(spark, sf_dir):
    return _hourly(spark, sf_dir, 7 * 86_400_000)


QUANTILE_SQL = ", ".join(f"round(quantile_cont(%s, {q}), 6) AS %s{n}" for q, n in zip((0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0), ("min", "p01", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "max")))


def q_sql(column: str, prefix: str) -> str:
    return QUANTILE_SQL.replace("%s,", f"{column},").replace("%s", prefix)


@query(SESSIONS + f"SELECT experiment_id, station_id, session_id, count(*) AS power_rows, count(*) FILTER (join_matched) AS matched, count(*) FILTER (join_ambiguous) AS ambiguous, round(100.0 * count(*) FILTER (join_matched) / count(*), 6) AS coverage_percent, {q_sql('age', 'age_')} FROM fu GROUP BY ALL")
def asof_state_age_quantiles(spark, sf_dir):
    out = dg.join_coverage(fused(spark, sf_dir), SESSION)
    return out.select(*SESSION, "power_rows", "matched", "ambiguous", F.round("coverage_percent", 6).alias("coverage_percent"), *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("age_")])


USES = SESSIONS + ", us AS (SELECT sp.event_id, sp.experiment_id, sp.station_id, sp.session_id, count(fu.event_id) AS uses FROM sp LEFT JOIN fu ON fu.operation_row_id = sp.event_id GROUP BY ALL)"


@query(USES + "SELECT experiment_id, station_id, count(*) AS operation_rows, count(*) FILTER (uses = 0) AS unused, count(*) FILTER (uses = 1) AS used_once, count(*) FILTER (uses > 1) AS used_often, round(avg(uses), 6) AS mean_uses, max(uses) AS max_uses FROM us GROUP BY ALL")
def operation_usage_summary(spark, sf_dir):
    usage = dg.operation_usage(plc_sessions(spark, sf_dir), fused(spark, sf_dir), "event_id", "operation_row_id")
    return dg.usage_summary(usage, KEYS).withColumn("mean_uses", F.round("mean_uses", 6))


@query(SESSIONS + "SELECT experiment_id, station_id, gap_count, round(tail_floor, 3) AS tail_floor, gap_below, gap_above, round(jump_ratio, 9) AS jump_ratio, round(threshold_ms, 3) AS threshold_ms FROM th")
def session_thresholds(spark, sf_dir):
    t = se.thresholds(plc_gaps(spark, sf_dir), q=Q, min_ratio=RATIO)
    return t.withColumns({"tail_floor": F.round("tail_floor", 3), "jump_ratio": F.round("jump_ratio", 9), "threshold_ms": F.round("threshold_ms", 3)})


@query(SESSIONS + "SELECT event_id, session_no, session_id FROM sp")
def session_assign(spark, sf_dir):
    return plc_sessions(spark, sf_dir).select("event_id", "session_no", "session_id")


@query(SESSIONS + "SELECT *, round((last_ms - first_ms) / 1000.0, 6) AS duration_seconds FROM iv")
def session_intervals(spark, sf_dir):
    return se.intervals(plc_sessions(spark, sf_dir)).withColumn("duration_seconds", F.round("duration_seconds", 6))


@query(SESSIONS + "SELECT event_id, session_id FROM pp")
def power_in_session_interval(spark, sf_dir):
    return power_sessions(spark, sf_dir).select("event_id", "session_id")


TOP = ", tg AS (SELECT experiment_id, station_id, s AS gs, f AS ge, f - s AS gap, row_number() OVER (PARTITION BY experiment_id, station_id ORDER BY f - s DESC, s DESC) AS rn FROM g QUALIFY rn <= 5)"
SILENCE = (
    SESSIONS
    + TOP
    + """, nd AS (SELECT experiment_id, greatest(2, CAST(ceil(count(DISTINCT station_id) * 0.4) AS BIGINT)) AS need FROM plc GROUP BY ALL),
pt AS (SELECT experiment_id, gs AS p FROM tg UNION SELECT experiment_id, ge FROM tg),
atm AS (SELECT * FROM (SELECT experiment_id, p AS s, lead(p) OVER (PARTITION BY experiment_id ORDER BY p) AS f FROM pt) WHERE f IS NOT NULL),
ok AS (SELECT atm.experiment_id, atm.s, atm.f, need FROM atm JOIN tg ON atm.experiment_id = tg.experiment_id AND gs <= s AND ge >= f JOIN nd ON nd.experiment_id = atm.experiment_id GROUP BY atm.experiment_id, s, f, need HAVING count(DISTINCT station_id) >= need),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY experiment_id ORDER BY s) = s THEN 0 ELSE 1 END AS nw FROM ok)),
co AS (SELECT experiment_id, need, min(s) AS cs, max(f) AS cf, max(f) - min(s) AS du FROM rn GROUP BY experiment_id, need, no),
lo AS (SELECT * FROM (SELECT *, max(du) OVER (PARTITION BY experiment_id) AS longest FROM co) WHERE du > longest * 0.2),
ov AS (SELECT lo.*, station_id, gs FROM lo JOIN tg ON lo.experiment_id = tg.experiment_id AND gs < cf AND ge > cs),
si AS (SELECT experiment_id, row_number() OVER (PARTITION BY experiment_id ORDER BY cs) AS silence_no, cs, cf, du, support FROM (SELECT experiment_id, cs, cf, du, need, count(DISTINCT station_id) AS support FROM ov GROUP BY ALL) WHERE support >= need),
sb AS (SELECT DISTINCT ov.experiment_id, station_id, gs AS boundary FROM ov JOIN si ON ov.experiment_id = si.experiment_id AND ov.cs = si.cs AND ov.cf = si.cf)"""
)


def _silences(spark, sf_dir):
    return se.silences(plc(spark, sf_dir), k=5, fraction=0.4, min_count=2, relative=0.2)


@query(SESSIONS + TOP + "SELECT experiment_id, station_id, gs AS start, ge AS \"end\", gap, rn FROM tg")
def topk_gaps_per_station(spark, sf_dir):
    return se.longest_gaps(plc_gaps(spark, sf_dir), 5).withColumn("rn", F.col("rn").cast("long"))


@query(SILENCE + 'SELECT experiment_id, silence_no, cs AS start, cf AS "end", du AS duration_ms, support FROM si')
def sync_silence_segments(spark, sf_dir):
    return _silences(spark, sf_dir)[0]


@query(SILENCE + ", al AS (SELECT experiment_id, station_id, boundary, max(l) AS l FROM (SELECT *, 1 AS l FROM bd UNION ALL SELECT *, 0 FROM sb) GROUP BY ALL) SELECT experiment_id, station_id, CAST(sum(l) AS BIGINT) AS local_boundaries, CAST(sum(1 - l) AS BIGINT) AS shared_boundaries, count(*) AS boundaries FROM al GROUP BY ALL")
def boundary_union_counts(spark, sf_dir):
    return se.boundary_union(boundaries(spark, sf_dir), _silences(spark, sf_dir)[1])[1]


@query(SESSIONS + "SELECT event_id, session_no, session_id FROM sp")
def session_assign_by_boundaries(spark, sf_dir):
    return se.assign_sessions(plc(spark, sf_dir), boundaries(spark, sf_dir)).select("event_id", "session_no", "session_id")


# ---- states, segments, windows


@query(EVENTS + f" SELECT event_id, {STATE} AS plc_state FROM e")
def state_classification(spark, sf_dir):
    return with_state(events(spark, sf_dir)).select("event_id", "plc_state")


@query(SESSIONS + "SELECT station_id, plc_state, count(*) AS n, round_even(avg(value), 2) AS avg_watts FROM fs GROUP BY ALL")
def state_coverage(spark, sf_dir):
    return st.coverage(fused_states(spark, sf_dir), watts="value")


VEC = "concat(CAST(b AS INT), CAST(r AS INT), CAST(d AS INT), CAST(n AS INT), CAST(y AS INT), CAST(x AS INT))"


@query(
    EVENTS
    + f""", v AS (SELECT *, {VEC} AS vec, {STATE} AS s FROM plc), c AS (SELECT station_id, lag(vec) OVER w AS prev_vec, vec, lag(s) OVER w AS prev_state, s AS curr_state FROM v WINDOW w AS (PARTITION BY experiment_id, station_id ORDER BY ts_ms, event_id))
SELECT station_id, prev_vec, vec, count(*) AS transitions, prev_state, curr_state, (prev_state = curr_state OR (prev_state = 'processing' AND curr_state = 'waiting_carrier_ready') OR (prev_state = 'waiting_carrier_ready' AND curr_state IN ('processing', 'idle_ready'))
  OR (prev_state = 'idle_ready' AND curr_state IN ('entering', 'exiting', 'transfer', 'processing', 'waiting_carrier', 'waiting_carrier_ready'))) AS in_expected_cycle FROM c WHERE prev_vec IS NOT NULL GROUP BY ALL"""
)
def cycle_transition_check(spark, sf_dir):
    vec = F.concat(*[F.col(b).cast("int").cast("string") for b in st.BITS])
    w = Window.partitionBy(*KEYS).orderBy("ts_ms", "event_id")
    rows = plc(spark, sf_dir).withColumn("vec", vec).withColumn("prev_vec", F.lag("vec").over(w)).where("prev_vec is not null")
    return st.cycle_check(rows.groupBy("station_id", "prev_vec", "vec").agg(F.count("*").alias("transitions")))


@query(SEGMENTS + "SELECT *, FROM sg".replace("*,", "* REPLACE (round(duration_seconds, 6) AS duration_seconds)"))
def state_islands(spark, sf_dir):
    return segments(spark, sf_dir).withColumn("duration_seconds", F.round("duration_seconds", 6))


STATS = "count(*) AS n, round(median(duration_seconds), 6) AS median, round(quantile_cont(duration_seconds, 0.25), 6) AS p25, round(quantile_cont(duration_seconds, 0.75), 6) AS p75, round(quantile_cont(duration_seconds, 0.9), 6) AS p90, round(avg(duration_seconds), 9) AS mean, round(min(duration_seconds), 6) AS minimum, round(max(duration_seconds), 6) AS maximum"


@query(SEGMENTS + f"SELECT station_id, plc_state, {STATS}, 'raw' AS statistics FROM sg GROUP BY ALL UNION ALL SELECT station_id, plc_state, {STATS}, 'dwell>=1s' FROM sg WHERE duration_seconds >= 1 GROUP BY ALL")
def duration_stats(spark, sf_dir):
    out = ft.duration_statistics(segments(spark, sf_dir), ["station_id", "plc_state"])
    return out.withColumns({c: F.round(c, 9 if c == "mean" else 6) for c in ("median", "p25", "p75", "p90", "mean", "minimum", "maximum")})


TRANSITIONS = EVENTS + ", tr AS (SELECT * FROM (SELECT *, (b IS DISTINCT FROM lag(b) OVER w OR r IS DISTINCT FROM lag(r) OVER w OR d IS DISTINCT FROM lag(d) OVER w) AND row_number() OVER w > 1 AS c FROM plc WINDOW w AS (PARTITION BY experiment_id, station_id ORDER BY ts_ms, event_id)) WHERE c)"


def _transitions(spark, sf_dir):
    return tp.transitions(plc(spark, sf_dir), KEYS, ["Busy", "RFIDTagPresent", "Done"], "ts_ms", "event_id")


@query(TRANSITIONS + "SELECT event_id, experiment_id, station_id, ts_ms FROM tr")
def transition_times(spark, sf_dir):
    return _transitions(spark, sf_dir).select("event_id", *KEYS, "ts_ms")


@query(TRANSITIONS + ", tt AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, station_id ORDER BY ts_ms) AS k FROM (SELECT DISTINCT experiment_id, station_id, ts_ms FROM tr)) SELECT event_id, 1 + coalesce(k, 0) AS segment_no FROM pw ASOF LEFT JOIN tt ON pw.experiment_id = tt.experiment_id AND pw.station_id = tt.station_id AND pw.ts_ms >= tt.ts_ms")
def event_segments(spark, sf_dir):
    marks = _transitions(spark, sf_dir).select(*KEYS, "ts_ms")
    return tp.count_marks(power(spark, sf_dir), marks, KEYS, "ts_ms", "ts_ms", True, "k").select("event_id", (F.col("k") + 1).alias("segment_no"))


WIDTH = 21600
WINDOWS = SESSIONS + f", wn AS (SELECT *, (ts_ms - min(ts_ms) OVER (PARTITION BY experiment_id, station_id, session_id)) // {WIDTH * 1000} AS window_no FROM fs)"


def windows(spark, sf_dir):
    return tp.anchored_window(fused_states(spark, sf_dir), SESSION, "ts_ms", WIDTH)


@query(
    WINDOWS
    + """, lg AS (SELECT *, lag(value) OVER w AS pv, lag(ts_ms) OVER w AS pt, (ts_ms - min(ts_ms) OVER (PARTITION BY experiment_id, station_id, session_id, window_no)) / 1000.0 AS sx FROM wn WINDOW w AS (PARTITION BY experiment_id, station_id, session_id, window_no ORDER BY ts_ms, event_id))
SELECT experiment_id, station_id, session_id, window_no, count(*) AS sample_count, round(avg(value), 9) AS power_mean, min(value) AS power_min, max(value) AS power_max, round(coalesce(stddev_samp(value), 0), 6) AS power_std, round(median(value), 4) AS power_median,
  round(max(value) - min(value), 4) AS power_range, round(arg_max(value, (ts_ms, event_id)) - arg_min(value, (ts_ms, event_id)), 4) AS power_delta, CASE WHEN max(ts_ms) > min(ts_ms) THEN round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000.0), 9) END AS density_hz,
  round(coalesce(sum((value + pv) / 2 * (ts_ms - pt) / 1000.0), 0), 6) AS energy_ws, round(CASE WHEN max(ts_ms) > min(ts_ms) THEN regr_slope(value, sx) ELSE 0 END, 6) AS power_slope, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, round((max(ts_ms) - min(ts_ms)) / 1000.0, 6) AS duration_seconds
FROM lg GROUP BY ALL"""
)
def anchored_tumbling_features(spark, sf_dir):
    out = ft.segment_features(windows(spark, sf_dir), [*SESSION, "window_no"], "ts_ms", "event_id", "value", ())
    digits = {"power_mean": 9, "power_std": 6, "power_median": 4, "power_range": 4, "power_delta": 4, "density_hz": 9, "energy_ws": 6, "power_slope": 6, "duration_seconds": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    WINDOWS
    + """, ct AS (SELECT experiment_id, station_id, session_id, window_no, plc_state, count(*) AS n FROM wn GROUP BY ALL),
sh AS (SELECT *, sum(n) OVER w AS total, coalesce(sum(n) FILTER (plc_state <> 'unknown') OVER w, 0) AS known, row_number() OVER (PARTITION BY experiment_id, station_id, session_id, window_no ORDER BY n DESC, plc_state) AS rk FROM ct WINDOW w AS (PARTITION BY experiment_id, station_id, session_id, window_no))
SELECT experiment_id, station_id, session_id, window_no, plc_state, n, CAST(total AS BIGINT) AS total, round(n / total, 9) AS purity, round(known / total, 9) AS known_fraction,
  CASE WHEN known / total < 0.5 THEN 'unknown' WHEN plc_state = 'unknown' THEN 'unknown' WHEN n / total >= 0.8 THEN plc_state ELSE 'mixed' END AS inferred_state FROM sh WHERE rk = 1"""
)
def window_majority_label(spark, sf_dir):
    return st.majority(windows(spark, sf_dir), [*SESSION, "window_no"]).withColumns({c: F.round(c, 9) for c in ("purity", "known_fraction")})


LOOK = ", ".join(
    f"round(avg(v) OVER w{s}, 9) AS value_{s}s_mean, round(coalesce(stddev_samp(v) OVER w{s}, 0), 6) AS value_{s}s_std, CAST(sum(1 - side) OVER w{s} AS BIGINT) AS n_samples_{s}s" for s in (3600, 86400)
)


@query(
    EVENTS
    + f""", un AS (SELECT NULL AS event_id, station_id, experiment_id, ts_ms, value AS v, 0 AS side FROM pw UNION ALL SELECT event_id, station_id, experiment_id, ts_ms, NULL, 1 FROM plc),
al AS (SELECT event_id, side, max(1 - side) OVER (PARTITION BY experiment_id, station_id) AS has, {LOOK} FROM un WINDOW w3600 AS (PARTITION BY experiment_id, station_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW), w86400 AS (PARTITION BY experiment_id, station_id ORDER BY ts_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW))
SELECT event_id, """
    + ", ".join(f"CASE WHEN has = 1 THEN {c} END AS {c}" for s in (3600, 86400) for c in (f"value_{s}s_mean", f"value_{s}s_std", f"n_samples_{s}s"))
    + " FROM al WHERE side = 1"
)
def lookback_stats_multi_scale(spark, sf_dir):
    out = tp.lookback(plc(spark, sf_dir).select("event_id", *KEYS, "ts_ms"), power(spark, sf_dir), KEYS, "ts_ms", "ts_ms", ["value"], [3600, 86400])
    return out.drop(*KEYS, "ts_ms").withColumns({c: F.round(c, 9 if c.endswith("_mean") else 6) for c in out.columns if c.endswith(("_mean", "_std"))})


@query(EVENTS + ", ls AS (SELECT experiment_id, station_id, ts_ms, arg_max(event_id, event_id) AS row_id, arg_max(value, event_id) AS row_value FROM pw GROUP BY ALL) SELECT plc.event_id, ls.row_id, ls.row_value FROM plc ASOF LEFT JOIN ls ON plc.experiment_id = ls.experiment_id AND plc.station_id = ls.station_id AND plc.ts_ms >= ls.ts_ms")
def latest_row_at_trigger(spark, sf_dir):
    return tp.latest_row(plc(spark, sf_dir).select("event_id", *KEYS, "ts_ms"), power(spark, sf_dir), KEYS, "ts_ms", "ts_ms", {"event_id": "row_id", "value": "row_value"}, "event_id").select("event_id", "row_id", "row_value")


CONTEXT = SEGMENTS + """, cx AS (SELECT *, lag(plc_state) OVER w AS prev_state, lag(duration_seconds) OVER w AS prev_duration, CAST(coalesce(sum(CASE WHEN plc_state = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY experiment_id, station_id, session_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cycles_before,
  (start_ms - last_value(CASE WHEN plc_state = 'processing' THEN end_ms END IGNORE NULLS) OVER (PARTITION BY experiment_id, station_id, session_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1000.0 AS time_since_processing_s FROM sg WINDOW w AS (PARTITION BY experiment_id, station_id, session_id ORDER BY start_ms, end_ms))"""


@query(CONTEXT + "SELECT experiment_id, station_id, session_id, plc_state, start_ms, end_ms, prev_state, round(prev_duration, 6) AS prev_duration, cycles_before, round(time_since_processing_s, 6) AS time_since_processing_s FROM cx")
def idle_context(spark, sf_dir):
    out = tp.context(segments(spark, sf_dir), SESSION, "plc_state", "processing")
    return out.select(*SESSION, "plc_state", "start_ms", "end_ms", "prev_state", F.round("prev_duration", 6).alias("prev_duration"), "cycles_before", F.round("time_since_processing_s", 6).alias("time_since_processing_s"))


def idle_rows(spark, sf_dir):
    f = fused_states(spark, sf_dir)
    return ds.idle_dataset(segments(spark, sf_dir), f, SESSION, ["value"], {"state_age_seconds": "age_at_start", "operation_row_id": "operation_at_start"}, "ts_ms", "event_id", [3600, 86400], min_dwell=0.0, idle=("idle_ready", "waiting_carrier", "waiting_carrier_ready"))


IDLE = CONTEXT + """, id AS (SELECT * FROM cx WHERE plc_state IN ('idle_ready', 'waiting_carrier', 'waiting_carrier_ready')),
idl AS (SELECT id.*, (SELECT round(avg(value), 9) FROM fs WHERE fs.experiment_id = id.experiment_id AND fs.station_id = id.station_id AND fs.session_id = id.session_id AND fs.ts_ms BETWEEN id.start_ms - 86400000 AND id.start_ms) AS mean_day,
  (SELECT count(*) FROM fs WHERE fs.experiment_id = id.experiment_id AND fs.station_id = id.station_id AND fs.session_id = id.session_id AND fs.ts_ms BETWEEN id.start_ms - 3600000 AND id.start_ms) AS n_hour,
  (SELECT arg_max(operation_row_id, (ts_ms, event_id)) FROM fs WHERE fs.experiment_id = id.experiment_id AND fs.station_id = id.station_id AND fs.session_id = id.session_id AND fs.ts_ms <= id.start_ms) AS op FROM id)"""


@query(IDLE + "SELECT experiment_id, station_id, session_id, start_ms, mean_day AS value_86400s_mean, n_hour AS n_samples_3600s, op AS operation_at_start, CAST(start_ms % 86400000 // 3600000 AS INTEGER) AS hour_of_day, round(ln(1 + duration_seconds), 9) AS target_log1p, cycles_before FROM idl")
def idle_dataset(spark, sf_dir):
    return idle_rows(spark, sf_dir).select(*SESSION, "start_ms", F.round("value_86400s_mean", 9).alias("value_86400s_mean"), "n_samples_3600s", "operation_at_start", "hour_of_day", F.round("target_log1p", 9).alias("target_log1p"), "cycles_before")


@query(SEGMENTS + """SELECT experiment_id, station_id, session_id, start_ms, end_ms, round(coalesce(lag(duration_seconds) OVER (PARTITION BY station_id ORDER BY start_ms, duration_seconds), (SELECT median(duration_seconds) FROM sg)), 6) AS naive_previous, round(median(duration_seconds) OVER (PARTITION BY station_id), 6) AS naive_median FROM sg""")
def naive_previous_and_median(spark, sf_dir):
    out = ds.naive_predictions(segments(spark, sf_dir), "station_id", "start_ms", "duration_seconds")
    return out.select(*SESSION, "start_ms", "end_ms", F.round("naive_previous", 6).alias("naive_previous"), F.round("naive_median", 6).alias("naive_median"))


@query(
    EVENTS
    + f""", df AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY experiment_id, station_id ORDER BY ts_ms) AS dl FROM pw) SELECT experiment_id, station_id, count(*) AS row_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, round((max(ts_ms) - min(ts_ms)) / 1000.0, 6) AS duration_seconds,
  CASE WHEN max(ts_ms) > min(ts_ms) THEN round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000.0), 9) END AS rate_hz, round(avg(dl) FILTER (dl > 0), 3) AS delta_mean, round(stddev_samp(dl) FILTER (dl > 0), 3) AS delta_std, {q_sql("CASE WHEN dl > 0 THEN dl END", "delta_")},
  count(*) FILTER (dl = 0) AS zero_deltas, count(*) FILTER (dl < 0) AS negative_deltas, count(*) FILTER (dl > 0 AND dl <= 100) AS burst_deltas FROM df GROUP BY ALL"""
)
def sampling_report(spark, sf_dir):
    out = dg.sampling_report(power(spark, sf_dir), KEYS)
    return out.withColumns({"duration_seconds": F.round("duration_seconds", 6), "rate_hz": F.round("rate_hz", 9), **{c: F.round(c, 3 if c in ("delta_mean", "delta_std") else 6) for c in out.columns if c.startswith("delta_")}})


@query(EVENTS + """, gp AS (SELECT experiment_id, station_id, lead(ts_ms) OVER (PARTITION BY experiment_id, station_id ORDER BY ts_ms) - ts_ms AS gap FROM (SELECT DISTINCT experiment_id, station_id, ts_ms FROM plc)), rk AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, station_id ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY experiment_id, station_id) AS n FROM gp WHERE gap IS NOT NULL)
SELECT experiment_id, station_id, count(*) AS n, median(gap) AS median, max(CASE WHEN k = floor((n - 1) * 0.1) THEN gap END) AS p10, max(CASE WHEN k = floor((n - 1) * 0.9) THEN gap END) AS p90 FROM rk GROUP BY experiment_id, station_id""")
def interval_summary(spark, sf_dir):
    return dg.interval_summary(plc_gaps(spark, sf_dir), KEYS)


@query(SESSIONS + """, p AS (SELECT experiment_id, station_id, min(ts_ms) AS p0, max(ts_ms) AS p1 FROM pw GROUP BY ALL), o AS (SELECT experiment_id, station_id, min(ts_ms) AS o0, max(ts_ms) AS o1 FROM plc GROUP BY ALL)
SELECT experiment_id, station_id, greatest(0, least(p1, o1) - greatest(p0, o0)) / 1000.0 AS overlap_seconds, greatest(0, o0 - p0) / 1000.0 AS power_before_seconds, greatest(0, p1 - o1) / 1000.0 AS power_after_seconds FROM p JOIN o USING (experiment_id, station_id)""")
def session_overlap(spark, sf_dir):
    return dg.session_overlap(power(spark, sf_dir), plc(spark, sf_dir), KEYS)


@query(SESSIONS + "SELECT event_id, round(age, 6) AS state_age_seconds FROM fu WHERE age IS NOT NULL ORDER BY age DESC, event_id LIMIT 100")
def topk_highest_age(spark, sf_dir):
    return dg.highest_age(fused(spark, sf_dir), 100, "event_id").select("event_id", F.round("state_age_seconds", 6).alias("state_age_seconds"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST(0 AS BIGINT))" for n in va.FUSED_INVARIANTS) + ") AS t(invariant, violations)")
def invariant_violations(spark, sf_dir):
    return va.violations(fused(spark, sf_dir), va.fused_rules())


AUDITS = (
    *va.FUSED_INVARIANTS, "matched_names_an_operation", "unmatched_age_is_null", "matched_age_is_not_negative", "matched_operation_is_not_later", "outside_sessions_is_unmatched", "outside_sessions_has_no_state", "matched_flag_is_known",
    "operation_of_same_experiment", "operation_of_same_station", "operation_of_same_session", "operation_exists", "operation_time_is_its_own", "readings_are_unique", "every_reading_is_fused", "every_fused_row_is_a_reading", "operations_are_unique",
    "every_operation_has_a_session", "intervals_are_ordered", "matched_readings_lie_in_their_interval", "silences_have_support", "silent_gaps_end_at_operations", "silent_gaps_hold_no_operation", "readings_in_silent_gaps_have_no_session",
    "readings_in_silent_gaps_have_no_state", "type_of_join_matched", "type_of_join_ambiguous", "type_of_Busy", "type_of_plc_timestamp_epoch_ms", "type_of_operation_row_id", "no_column_like_^inferred_state$", "no_column_like_^(feature|window)_", "no_column_like_possible_reset",
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST(0 AS BIGINT))" for n in AUDITS) + ") AS t(\"check\", violations)")
def audit_violations(spark, sf_dir):
    """Every audit over readings, machine rows and sessions that local and shared boundaries give; tables that many audits read are written once."""

    def written(df: DataFrame, name: str) -> DataFrame:
        path = sinks.scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    machine, readings = plc(spark, sf_dir), power(spark, sf_dir)
    g = plc_gaps(spark, sf_dir)
    found, shared = (written(x, "silences") for x in se.silences(machine))
    both, _ = se.boundary_union(boundaries(spark, sf_dir), shared)
    owned = written(se.assign_sessions(machine, both), "operation")
    intervals = written(se.intervals(owned), "session-intervals")
    columns = {"event_id": "operation_row_id", **{b: b for b in st.BITS}}
    joined = written(ds.fuse(se.sessions_of(readings.drop(*st.BITS), intervals), owned, SESSION, "ts_ms", columns), "fused")
    support = g.join(shared.withColumnRenamed("boundary", "start"), [*KEYS, "start"])
    support = written(support, "support")
    kinds = {"join_matched": "boolean", "join_ambiguous": "boolean", "Busy": "boolean", "plc_timestamp_epoch_ms": "bigint", "operation_row_id": "bigint"}
    return va.audit(joined, readings, owned, intervals, support, found, "event_id", "ts_ms", st.BITS, kinds, ("^inferred_state$", "^(feature|window)_", "possible_reset"))


# ---- snapshots of lineitem: one with line numbers up to 3, one with all

SNAP_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SNAPS = "sn AS (SELECT *, 'a.sql' AS source_file, hash(l) AS h FROM lineitem l WHERE l_linenumber <= 3 UNION ALL SELECT *, 'b.sql', hash(l) FROM lineitem l)"


def snapshots(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    both = l.where("l_linenumber <= 3").withColumn("source_file", F.lit("a.sql")).unionByName(l.withColumn("source_file", F.lit("b.sql"))).withColumn("line_no", place)
    return cn.identified(both, SNAP_COLUMNS, F.lit("exp"), F.lit("lineitem"))


@query("WITH " + SNAPS + f" SELECT {', '.join(SNAP_COLUMNS[:5])}, min(source_file) AS canonical_source_file, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS lineage, count(*) AS source_occurrence_count FROM sn GROUP BY {', '.join(SNAP_COLUMNS)}")
def dedup_canonical_rows(spark, sf_dir):
    out = cn.canonical_rows(snapshots(spark, sf_dir), SNAP_COLUMNS)
    return out.select(*SNAP_COLUMNS[:5], "canonical_source_file", F.array_join("lineage_source_files", ",").alias("lineage"), "source_occurrence_count")


@query("WITH " + SNAPS + f", k AS (SELECT l_returnflag, count(*) AS canonical_rows FROM (SELECT DISTINCT {', '.join(SNAP_COLUMNS)} FROM sn) GROUP BY ALL), o AS (SELECT l_returnflag, count(*) AS original_rows FROM sn GROUP BY ALL) SELECT l_returnflag, original_rows, canonical_rows, original_rows - canonical_rows AS duplicates_removed FROM o JOIN k USING (l_returnflag)")
def dedup_counts(spark, sf_dir):
    return cn.counts(snapshots(spark, sf_dir), ["l_returnflag"])


@query("WITH " + SNAPS + f", w AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(SNAP_COLUMNS)} ORDER BY source_file) AS rn FROM sn) SELECT source_file, CASE WHEN rn = 1 THEN 'kept' ELSE 'duplicate_occurrence' END AS status, count(*) AS n FROM w GROUP BY ALL")
def row_lineage_status(spark, sf_dir):
    return cn.occurrences(snapshots(spark, sf_dir)).groupBy("source_file", "status").agg(F.count("*").alias("n"))


@query(f"WITH k AS (SELECT DISTINCT {', '.join(SNAP_COLUMNS)} FROM lineitem) SELECT l_orderkey, l_shipdate, count(*) AS row_variants FROM k GROUP BY ALL HAVING count(*) > 1")
def timestamp_conflicts(spark, sf_dir):
    rows = cn.canonical_rows(cn.identified(table(spark, sf_dir, "lineitem").withColumns({"source_file": F.lit("b.sql"), "line_no": F.lit(1)}), SNAP_COLUMNS, F.lit("exp"), F.lit("lineitem")), SNAP_COLUMNS)
    return cn.conflicts(rows, ["l_orderkey", "l_shipdate"]).select("l_orderkey", "l_shipdate", "row_variants")


@query("""WITH a AS (SELECT * FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT * FROM lineitem WHERE l_linenumber >= 2), s AS (SELECT l_returnflag, count(*) AS shared FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY ALL)
SELECT l_returnflag, 'a.sql' AS left_source_file, 'b.sql' AS right_source_file, ra AS left_rows, rb AS right_rows, coalesce(shared, 0) AS shared_rows, greatest(0, least(la, lb) - greatest(fa, fb)) AS overlap_ms, fb <= fa AND lb >= la AS right_is_temporal_superset
FROM (SELECT l_returnflag, count(*) AS ra, min(epoch_us(l_shipdate) // 1000) AS fa, max(epoch_us(l_shipdate) // 1000) AS la FROM (SELECT DISTINCT * FROM a) GROUP BY ALL) JOIN (SELECT l_returnflag, count(*) AS rb, min(epoch_us(l_shipdate) // 1000) AS fb, max(epoch_us(l_shipdate) // 1000) AS lb FROM (SELECT DISTINCT * FROM b) GROUP BY ALL) USING (l_returnflag) LEFT JOIN s USING (l_returnflag)""")
def snapshot_overlap_pairs(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("ts_ms", epoch_ms(F.col("l_shipdate")))
    both = l.where("l_linenumber <= 3").withColumn("source_file", F.lit("a.sql")).unionByName(l.where("l_linenumber >= 2").withColumn("source_file", F.lit("b.sql")))
    return cn.snapshot_overlap(cn.identified(both, SNAP_COLUMNS, F.lit("exp"), F.lit("lineitem")), ["l_returnflag"])


@query("""WITH a AS (SELECT o_orderstatus, o_custkey, count(*) AS l FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus, o_custkey, count(*) AS r FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL), j AS (SELECT o_orderstatus, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM a FULL JOIN b USING (o_orderstatus, o_custkey))
SELECT o_orderstatus, CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS only_in_left, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS only_in_right, CASE WHEN sum(greatest(l - r, 0)) = 0 AND sum(greatest(r - l, 0)) = 0 THEN 'schema_name_only' ELSE 'content_or_schema_difference' END AS difference_class FROM j GROUP BY ALL""")
def multiset_diff_counts(spark, sf_dir):
    o = cn.identified(table(spark, sf_dir, "orders"), ["o_custkey"], F.lit("exp"), F.col("o_orderstatus"))
    return cn.multiset_difference(o, o.where("o_orderkey % 5 <> 0"), ["o_orderstatus"])


@query(EVENTS + """, w AS (SELECT *, lag(ts_ms) OVER (PARTITION BY experiment_id, station_id ORDER BY reverse(CAST(event_id AS VARCHAR)), event_id) > ts_ms AS f FROM e)
SELECT experiment_id, station_id, count(*) FILTER (ts_ms IS NULL) AS invalid, count(*) FILTER (length(CAST(ts_ms AS VARCHAR)) <> 13) AS not_13_digits, count(*) FILTER (f) AS regressions, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM w GROUP BY ALL""")
def raw_order_regressions(spark, sf_dir):
    raw = events(spark, sf_dir).withColumn("line", F.reverse(F.col("event_id").cast("string")))
    return dg.timestamp_diagnostics(raw, KEYS, "ts_ms", ["line", "event_id"]).drop("other_day")


def _mz_sql(table_name: str, columns: list[tuple[str, str]]) -> str:
    out = []
    for c, kind in columns:
        v = f"TRY_CAST({c} AS DOUBLE)"
        zero = "CAST(0 AS BIGINT)" if kind == "s" else f"count(*) FILTER ({v} = 0)"
        out.append(f"SELECT '{table_name}' AS \"table\", '{c}' AS \"column\", count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, {zero} AS zero_count, min({v}) AS minimum, max({v}) AS maximum, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_percent FROM {table_name}")
    return " UNION ALL ".join(out)


@query("SELECT * FROM (" + _mz_sql("customer", [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "s")]) + " UNION ALL " + _mz_sql("labels", [("doc_id", "n"), ("quality", "n"), ("toxic", "n")]) + ")")
def missing_zero_report(spark, sf_dir):
    return dg.missing_zero(table(spark, sf_dir, "customer"), "customer").unionByName(dg.missing_zero(table(spark, sf_dir, "labels"), "labels"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS p FROM customer GROUP BY ALL), s AS (SELECT s_nationkey AS k, count(*) AS o FROM supplier GROUP BY ALL) SELECT k AS nation, coalesce(p, 0) AS power_rows, coalesce(o, 0) AS operation_rows, o IS NULL AS power_only, p IS NULL AS operation_only FROM c FULL JOIN s USING (k)""")
def resource_presence(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return dg.presence(c, s, ["nation"])


@query("""WITH r AS (SELECT s_suppkey, '  ' || CASE WHEN s_suppkey % 3 = 0 THEN 'ene' || (1 + s_suppkey % 8) || '_x' WHEN s_suppkey % 3 = 1 THEN 'mes' || (10 * (1 + s_suppkey % 9)) || ':plc' ELSE s_name END || chr(9) AS res FROM supplier),
x AS (SELECT s_suppkey, trim(res, ' ' || chr(9)) AS resource_id_normalized FROM r), y AS (SELECT *, nullif(regexp_extract(resource_id_normalized, '^(ene[1-8])(?:_|:|$)', 1), '') AS energy_resource_id, nullif(regexp_extract(resource_id_normalized, '^(mes(?:10|20|30|40|50|60|70|80))(?:_|:|$)', 1), '') AS mes_resource_id FROM x)
SELECT *, CAST(coalesce(TRY_CAST(substr(energy_resource_id, 4) AS INT) * 10, TRY_CAST(substr(mes_resource_id, 4) AS INT)) AS INTEGER) AS station_id FROM y""")
def resource_normalise(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("ene"), (1 + k % 8).cast("string"), F.lit("_x"))).when(k % 3 == 1, F.concat(F.lit("mes"), (10 * (1 + k % 9)).cast("string"), F.lit(":plc"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("  "), raw, F.lit("\t")).alias("res")).withColumns(cn.normalised_resource(F.col("res"))).drop("res")


# ---- samples and splits of orders

POSITIONS = "CASE WHEN c >= n THEN true WHEN c = 1 THEN k = 0 ELSE list_contains(list_transform(range(CAST(c AS BIGINT)), lambda i: CAST(round_even(i * ((n - 1) / (c - 1)), 0) AS BIGINT)), k) END"


@query(f"WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n, 37 AS c FROM orders) SELECT o_orderpriority, o_orderkey FROM o WHERE {POSITIONS}")
def temporal_quantile_sample(spark, sf_dir):
    return sm.temporal_quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 37).select("o_orderpriority", "o_orderkey")


@query(f"WITH s AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS r, count(*) OVER () AS m FROM (SELECT DISTINCT o_orderpriority FROM orders)), o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n, 103 // m + CASE WHEN r < 103 % m THEN 1 ELSE 0 END AS c FROM orders JOIN s USING (o_orderpriority)) SELECT o_orderpriority, o_orderkey FROM o WHERE {POSITIONS}")
def station_quota_sample(spark, sf_dir):
    return sm.quota_sample(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], 103).select("o_orderpriority", "o_orderkey")


@query("WITH b AS (SELECT o_orderpriority, o_totalprice, ntile(45) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS bin FROM orders) SELECT o_orderpriority, CAST(bin AS INTEGER) AS bin, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM b GROUP BY ALL")
def ntile_bin_bounds(spark, sf_dir):
    b = table(spark, sf_dir, "orders").withColumn("bin", F.ntile(45).over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")))
    return b.groupBy("o_orderpriority", "bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("WITH b AS (SELECT o_orderpriority, o_orderkey, ntile(45) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS bin FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY md5('20260915:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM b) SELECT o_orderpriority, CAST(bin AS INTEGER) AS bin, o_orderkey FROM r WHERE k = 1")
def ntile_bin_sample(spark, sf_dir):
    return sm.bin_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", 45, 20260915).select("o_orderpriority", "bin", "o_orderkey")


SPLIT_SQL = "CASE WHEN y <= 1995 THEN 'train' WHEN y = 1996 THEN 'validation' ELSE 'test' END"


@query(f"WITH o AS (SELECT *, year(o_orderdate) AS y FROM orders) SELECT {SPLIT_SQL} AS split, count(*) AS rows, count(DISTINCT y) AS experiments, count(DISTINCT o_orderpriority) AS stations, min(o_orderdate) AS first, max(o_orderdate) AS last FROM o GROUP BY ALL")
def experiment_split_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    splits = {str(y): "train" if y <= 1995 else "validation" if y == 1996 else "test" for y in range(1900, 2101)}
    return sm.split_summary(sm.split_by(o, "y", splits), "split", "y", "o_orderpriority", "o_orderdate")


# ---- metrics


@query("WITH p AS (SELECT l_returnflag, ln(1 + l_extendedprice) AS t, ln(1 + l_quantity * 1500) AS p FROM lineitem), e AS (SELECT *, abs((exp(t) - 1) - (exp(p) - 1)) AS e FROM p) SELECT l_returnflag, round(avg(e), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(median(e), 3) AS median_ae, round(avg(abs(t - p)), 9) AS log_mae, count(*) AS n FROM e GROUP BY ALL")
def regression_metrics(spark, sf_dir):
    out = mt.regression_metrics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.log1p("l_extendedprice"), F.log1p(F.col("l_quantity") * 1500))
    return out.withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3), "median_ae": F.round("median_ae", 3), "log_mae": F.round("log_mae", 9)})


@query("""WITH t AS (SELECT l_returnflag, scope, tt_seconds, l_extendedprice >= tt_seconds AS t, l_quantity * 1500 >= tt_seconds AS p FROM lineitem, (VALUES (28000.0::DOUBLE), (60000.0::DOUBLE)) AS x(tt_seconds), (VALUES ('all'), ('not_first_line')) AS s(scope) WHERE scope = 'all' OR l_linenumber <> 1),
c AS (SELECT l_returnflag, scope, tt_seconds, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) AS n FROM t GROUP BY ALL)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall, round((tp + tn) / n, 9) AS accuracy FROM c""")
def decision_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    out = mt.decision_metrics(rows, ["l_returnflag"], "l_extendedprice", "guess", [28000, 60000], {"all": F.lit(True), "not_first_line": F.col("l_linenumber") != 1})
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "accuracy")})


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 9) AS pearson FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + ")")
def feature_correlation(spark, sf_dir):
    return dg.correlations(table(spark, sf_dir, "lineitem"), FEATURES).withColumn("pearson", F.round("pearson", 9))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER ({f} IS NULL) / count(*) AS missing_fraction, round(var_samp({f}), 4) AS variance, {q_sql(f, '')} FROM lineitem" for f in FEATURES) + ")")
def feature_diagnostics(spark, sf_dir):
    out = dg.feature_diagnostics(table(spark, sf_dir, "lineitem"), FEATURES)
    return out.select("feature", "missing_fraction", F.round("variance", 4).alias("variance"), *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round((SELECT max(m) - min(m) FROM (SELECT median({f}) AS m FROM lineitem GROUP BY l_returnflag)), 6) AS median_range, round((SELECT max(m) - min(m) FROM (SELECT median({f}) AS m FROM lineitem GROUP BY l_returnflag)) / greatest(abs(avg({f})), 1e-12), 6) AS relative_range FROM lineitem" for f in FEATURES) + ")")
def feature_group_shift(spark, sf_dir):
    return dg.group_shift(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag").withColumns({"median_range": F.round("median_range", 6), "relative_range": F.round("relative_range", 6)})


CM = "WITH r AS (SELECT quality AS t, CASE WHEN doc_id % 3 = 0 THEN toxic ELSE quality END AS p FROM labels), k AS (SELECT t AS k FROM r UNION SELECT p FROM r), e AS (SELECT k, (SELECT count(*) FROM r WHERE t = k) AS a, (SELECT count(*) FROM r WHERE p = k) AS g, (SELECT count(*) FROM r WHERE t = k AND p = k) AS tp FROM k), m AS (SELECT *, coalesce(tp / nullif(g, 0), 0) AS pr, coalesce(tp / nullif(a, 0), 0) AS re FROM e)"


@query(CM + " SELECT round(sum(tp) / sum(a), 9) AS accuracy, round(avg(re) FILTER (a > 0), 9) AS balanced_accuracy, round(avg(pr), 9) AS macro_precision, round(avg(re), 9) AS macro_recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 9) AS macro_f1 FROM m")
def confusion_and_macro_f1(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("p"))
    return mt.class_metrics(r, "t", "p").select(*[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query("""WITH r AS (SELECT label AS t, vec_id % 4 AS c FROM embeddings), n AS (SELECT t, c, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT t, sum(n) AS na FROM n GROUP BY ALL), b AS (SELECT c, sum(n) AS nb FROM n GROUP BY ALL), z AS (SELECT sum(n) AS z, sum(n * (n - 1) / 2) AS nij FROM n),
q AS (SELECT z, nij, (SELECT sum(na * (na - 1) / 2) FROM a) AS pa, (SELECT sum(nb * (nb - 1) / 2) FROM b) AS pb, (SELECT -sum(na / z * ln(na / z)) FROM a, z) AS ha, (SELECT -sum(nb / z * ln(nb / z)) FROM b, z) AS hb, (SELECT sum(n / z * ln(n * z / (na * nb))) FROM n JOIN a USING (t) JOIN b USING (c), z) AS mi FROM z)
SELECT round((nij - pa * pb / (z * (z - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (z * (z - 1) / 2)), 9) AS ari, round(2 * mi / (ha + hb), 9) AS nmi FROM q""")
def contingency_ari(spark, sf_dir):
    r = table(spark, sf_dir, "embeddings").select(F.col("label").alias("t"), (F.col("vec_id") % 4).alias("c"))
    return mt.adjusted_rand(r, "t", "c").select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


@query(SESSIONS + "SELECT CAST(count(*) AS BIGINT) AS fused_rows, count(*) FILTER (join_matched) AS matched, round(avg(age), 6) AS age_mean, round(median(age), 6) AS age_median, count(DISTINCT session_id) AS sessions FROM fu")
def run_summary(spark, sf_dir):
    return fused(spark, sf_dir).agg(F.count("*").alias("fused_rows"), F.count_if("join_matched").alias("matched"), F.round(F.avg("state_age_seconds"), 6).alias("age_mean"), F.round(F.median("state_age_seconds"), 6).alias("age_median"), F.count_distinct("session_id").alias("sessions"))


# ---- learners: no SQL form; tests hold them against numpy


def _vectors(spark, sf_dir, dims: int):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.element_at("embedding", k + 1).cast("double").alias(f"x{k}") for k in range(dims)])


@query()
def kmeans_clusters(spark, sf_dir):
    return ml.clusters(_vectors(spark, sf_dir, 64), [f"x{k}" for k in range(64)], 4, 20260915).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def quantum_gram(spark, sf_dir):
    """Kernel of a sample of 60 rows, spread evenly over the labels."""
    v, names = _vectors(spark, sf_dir, 6), [f"x{k}" for k in range(6)]
    return ml.fidelity_gram(ml.scaled(v, sm.quota_sample(v, "label", ["vec_id"], 60), names), "vec_id")


@query()
def idle_regression(spark, sf_dir):
    """Errors of a random forest on idle durations, by split: the weeks in order, the last two for validation and test."""
    rows = idle_rows(spark, sf_dir).withColumn("label", F.col("target_log1p"))
    weeks = [r[0] for r in events(spark, sf_dir).select("experiment_id").where("experiment_id is not null").distinct().orderBy("experiment_id").collect()]  # a row a week
    splits = {w: "test" if k == len(weeks) - 1 else "validation" if k == len(weeks) - 2 else "train" for k, w in enumerate(weeks)}
    names = ["value_3600s_mean", "value_86400s_mean", "n_samples_3600s", "cycles_before", "hour_of_day"]
    rows = sm.split_by(rows, "experiment_id", splits).na.drop(subset=[*names, "label"])
    x = ml.assembled(rows.select(*SESSION, "split", "label", *names), names).persist()  # a learner reads it many times
    model = ml.regressors(20260915)["random_forest"].fit(x.where("split = 'train'"))
    return mt.regression_metrics(model.transform(x), ["split"], F.col("label"), F.col("prediction"))


# ---- dumps


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def pgcopy_scan(spark, sf_dir):
    """Customers written as COPY blocks and read back through the dump source."""
    c = table(spark, sf_dir, "customer")
    path = sinks.scratch(spark, "dump")
    dumps.write_dump(c, path, "customer")
    rows = dumps.read_dumps(spark, path, ".txt")
    return rows.select(*[F.element_at("values", k + 1).cast(t).alias(n) for k, (n, t) in enumerate(c.dtypes)])


@query(SESSIONS + "SELECT experiment_id, station_id, count(*) AS power_rows, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM pp WHERE session_id IS NULL GROUP BY ALL")
def power_outside_sessions(spark, sf_dir):
    return power_sessions(spark, sf_dir).where("session_id is null").groupBy(*KEYS).agg(F.count("*").alias("power_rows"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(SESSIONS + "SELECT session_id, count(*) AS n FROM fu WHERE join_matched GROUP BY ALL ORDER BY n DESC, session_id LIMIT 5")
def top_sessions(spark, sf_dir):
    return fused(spark, sf_dir).where("join_matched").groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(5)


# ---- profiles of files written from the tables


def _lines(spark, rows, path: str):
    """The text rows (line_no, value) written to one file and read back."""
    rows.orderBy("line_no").coalesce(1).select("value").write.text(path)
    read = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    return read.select(F.lit("export.txt").alias("source_file"), "line_no", "value")


DAY_ORDERS = "o AS (SELECT o_orderkey, o_orderpriority, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus ELSE '' END AS status FROM orders)"
PROFILE = """g AS (SELECT d FROM (SELECT ts - lag(ts) OVER (PARTITION BY series ORDER BY line_no) AS d FROM r) WHERE d IS NOT NULL), k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM g)"""


@query(f"""WITH {DAY_ORDERS}, r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ts, o_orderpriority AS series FROM o), {PROFILE}
SELECT (SELECT count(*) FROM o) + 1 AS line_count, (SELECT count(*) FROM r) AS record_count, CAST(0 AS BIGINT) AS duplicate_rows, (SELECT count(*) FROM g WHERE d = 0) AS repeated_times, (SELECT count(*) FROM g WHERE d < 0) AS regressions, (SELECT min(ts) FROM r) AS first_ms, (SELECT max(ts) FROM r) AS last_ms,
  (SELECT count(*) FROM g) AS gap_count, (SELECT median(d) FROM g) AS gap_median, (SELECT max(d) FROM k WHERE i = floor((n - 1) * 0.1)) AS gap_p10, (SELECT max(d) FROM k WHERE i = floor((n - 1) * 0.9)) AS gap_p90, (SELECT count(*) FROM o WHERE status = '') AS missing_status""")
def export_profile(spark, sf_dir):
    """Orders written as a delimited export, read back and profiled."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).otherwise("")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_00:00:00.000 | "), F.col("o_orderpriority"), F.lit(" | "), F.col("o_orderkey").cast("string"), F.lit(" | "), status)
    rows = o.select(F.col("o_orderkey").alias("line_no"), text.alias("value")).unionByName(spark.createDataFrame([(-1, "DateAndTime | series | id | status")], "line_no long, value string"))
    profile, columns = files.export_profile(_lines(spark, rows, sinks.scratch(spark, "export")))
    missing = columns.where("column = 'status'").select("source_file", F.col("missing_count").alias("missing_status"))
    return profile.join(missing, "source_file").drop("source_file")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS line_no, event_id, epoch_us(ts) // 1000 AS ts, event_type AS series FROM events), """ + PROFILE + """
SELECT (SELECT count(*) FROM r) AS line_count, (SELECT count(*) FROM r) AS record_count, (SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT ts, series FROM r)) AS duplicate_rows, (SELECT count(*) FROM g WHERE d = 0) AS repeated_times, (SELECT count(*) FROM g WHERE d < 0) AS regressions, (SELECT min(ts) FROM r) AS first_ms,
  (SELECT max(ts) FROM r) AS last_ms, (SELECT count(*) FROM g) AS gap_count, (SELECT median(d) FROM g) AS gap_median, (SELECT max(d) FROM k WHERE i = floor((n - 1) * 0.1)) AS gap_p10, (SELECT max(d) FROM k WHERE i = floor((n - 1) * 0.9)) AS gap_p90, 'timestampms,topic,user,value' AS keys, 'JSON Lines' AS delimiter""")
def log_profile(spark, sf_dir):
    """Events written as JSON lines, read back and profiled."""
    e = table(spark, sf_dir, "events")
    body = F.struct(epoch_ms(F.col("ts")).alias("timestampms"), F.col("event_type").alias("topic"), F.col("user_id").alias("user"), "value")
    profile, _ = files.log_profile(_lines(spark, e.select(F.col("event_id").alias("line_no"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")), sinks.scratch(spark, "log")))
    return profile.withColumn("keys", F.array_join("keys", ",")).drop("source_file")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE n <= 9 OR k IN (SELECT CAST(floor(i * ((n - 1) / 8)) AS BIGINT) FROM range(9) AS t(i))")
def evenly_spaced_rows(spark, sf_dir):
    return dg.evenly_spaced(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"], 9).select("c_mktsegment", "c_custkey")


@query("SELECT name AS path, CASE WHEN lower(name) LIKE 'query\\_%' ESCAPE '\\' THEN 'sparse_query_export' WHEN lower(name) LIKE '%.sql' THEN 'primary_sql_snapshot' ELSE 'other' END AS source_type FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Query_' || p_partkey || '.txt' WHEN p_partkey % 3 = 1 THEN 'dump_' || p_partkey || '.sql' ELSE 'note_' || p_partkey || '.txt' END AS name FROM part)")
def source_classification(spark, sf_dir):
    p = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Query_"), p, F.lit(".txt"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("dump_"), p, F.lit(".sql"))).otherwise(F.concat(F.lit("note_"), p, F.lit(".txt")))
    named = table(spark, sf_dir, "part").select(name.alias("path"))
    kinds = files.classify_source(F.col("path"), F.regexp_extract("path", r"(\.[a-z]+)$", 1))
    return named.select("path", kinds["source_type"].alias("source_type"))


@query("SELECT CAST(s_nationkey AS VARCHAR) || '/' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN '_new.sql' ELSE '.sql' END AS canonical_source_file, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN CAST(s_nationkey AS VARCHAR) || '/' || CAST(s_suppkey AS VARCHAR) || '.sql' END AS ordinary_counterpart FROM supplier")
def snapshot_selection(spark, sf_dir):
    stem = F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"))
    s = table(spark, sf_dir, "supplier")
    plain, new = s.where("s_suppkey % 2 = 1 or s_suppkey % 3 = 0").select(F.concat(stem, F.lit(".sql")).alias("path")), s.where("s_suppkey % 2 = 0").select(F.concat(stem, F.lit("_new.sql")).alias("path"))
    return files.select_snapshots(plain.unionByName(new)).select("canonical_source_file", "ordinary_counterpart")
