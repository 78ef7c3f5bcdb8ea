"""Sessions from the data's own gaps: thresholds, silences shared by stations, boundaries, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import session_label
from .temporal import count_marks, within_intervals

KEYS = ["experiment_id", "station_id"]


def gaps(rows: DataFrame, keys: list[str] = KEYS, ts: str = "ts_ms") -> DataFrame:
    """Positive gaps between distinct times: keys, start, end, gap."""
    order = Window.partitionBy(*keys).orderBy("start")
    times = rows.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, F.col(ts).cast("long").alias("start")).where("start is not null").distinct()
    return times.withColumn("end", F.lead("start").over(order)).where("end is not null").withColumn("gap", F.col("end") - F.col("start"))


def thresholds(gap_rows: DataFrame, keys: list[str] = KEYS, q: float = 0.95, min_ratio: float = 2.0) -> DataFrame:
    """For each key: gap_count, tail_floor (q-quantile), and the widest jump between consecutive distinct tail gaps.

    The threshold is the geometric mean of the gaps below and above the jump, if their ratio reaches ``min_ratio``; the
    first of equal jumps counts; keys with fewer than two gaps or tail gaps have none.
    """
    group = Window.partitionBy(*keys)  # the partitioning that the gaps already have: no further shuffle
    below, gap = F.lag("gap").over(group.orderBy("gap")), F.col("gap")
    seen = gap_rows.withColumns({"gap_count": F.count("*").over(group), "tail_floor": F.percentile("gap", F.lit(q)).over(group), "below": below})
    jump = F.when((F.col("gap_count") >= 2) & (F.col("below") >= F.col("tail_floor")) & (F.col("below") < gap), F.struct(F.col("below"), gap.alias("gap"), (gap / F.col("below")).alias("ratio")))
    seen = seen.withColumn("j", jump)
    best = F.max_by("j", F.when(F.col("j").isNotNull(), F.struct(F.col("j.ratio"), -gap)))
    found = seen.groupBy(*keys).agg(F.first("gap_count").alias("gap_count"), F.first("tail_floor").alias("tail_floor"), best.alias("j"))
    ratio = F.col("j.ratio")
    return found.select(
        *keys, "gap_count", "tail_floor", F.col("j.below").alias("gap_below"), F.col("j.gap").alias("gap_above"), ratio.alias("jump_ratio"),
        F.when(ratio >= min_ratio, F.sqrt(F.col("j.below").cast("double") * F.col("j.gap").cast("double"))).alias("threshold_ms"),
    )


def local_boundaries(gap_rows: DataFrame, threshold: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, boundary: the time after which a gap above the threshold begins."""
    own = threshold.where("threshold_ms is not null").select(*keys, "threshold_ms")
    return gap_rows.join(own, keys).where("gap > threshold_ms").select(*keys, F.col("start").alias("boundary"))


def longest_gaps(gap_rows: DataFrame, k: int, keys: list[str] = KEYS) -> DataFrame:
    """The k longest gaps of each key; of equal gaps the later."""
    order = Window.partitionBy(*keys).orderBy(F.desc("gap"), F.desc("start"))
    return gap_rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def silences(rows: DataFrame, k: int = 3, fraction: float = 0.6, min_count: int = 2, relative: float = 0.2, experiment: str = "experiment_id", station: str = "station_id", ts: str = "ts_ms") -> tuple[DataFrame, DataFrame]:
    """Silences that enough stations of an experiment share, and the boundaries they give.

    Of each station's k longest gaps, end points cut time into atoms; atoms that ``max(min_count, ceil(stations *
    fraction))`` stations cover are joined where they touch; cores longer than ``relative`` of the longest stay, if as many stations
    overlap them.  Returns (experiment, silence_no, start, end, duration_ms, support) and (experiment, station, boundary):
    the start of every gap that overlaps a core.  Work is bounded by k gaps a station.
    """
    keys = [experiment, station]
    known = rows.where(F.col(experiment).isNotNull() & F.col(station).isNotNull())
    need = known.groupBy(experiment).agg(F.count_distinct(station).alias("active")).withColumn("need", F.greatest(F.lit(min_count), F.ceil(F.col("active") * F.lit(fraction))).cast("long"))
    top = longest_gaps(gaps(known, keys, ts), k, keys).select(*keys, F.col("start").alias("gs"), F.col("end").alias("ge"))
    points = top.select(experiment, F.explode(F.array("gs", "ge")).alias("s")).distinct()
    by_time = Window.partitionBy(experiment).orderBy("s")
    atoms = points.withColumn("e", F.lead("s").over(by_time)).where("e is not null")
    held = atoms.join(top, experiment).where("gs <= s and ge >= e").groupBy(experiment, "s", "e").agg(F.count_distinct(station).alias("support"))
    held = held.join(need, experiment).where("support >= need").select(experiment, "s", "e", "need")
    fresh = F.when(F.lag("e").over(by_time) == F.col("s"), 0).otherwise(1)
    runs = held.withColumn("new", fresh).withColumn("no", F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    cores = runs.groupBy(experiment, "no", "need").agg(F.min("s").alias("start"), F.max("e").alias("end")).withColumn("duration_ms", F.col("end") - F.col("start"))
    cores = cores.withColumn("longest", F.max("duration_ms").over(Window.partitionBy(experiment))).where(F.col("duration_ms") > F.col("longest") * relative)
    over = cores.join(top, experiment).where("gs < end and ge > start")
    support = over.groupBy(experiment, "start", "end", "duration_ms", "need").agg(F.count_distinct(station).alias("support")).where("support >= need")
    number = Window.partitionBy(experiment).orderBy("start")
    found = support.select(experiment, F.row_number().over(number).cast("long").alias("silence_no"), "start", "end", "duration_ms", "support")
    kept = over.join(found.select(experiment, F.col("start"), F.col("end")), [experiment, "start", "end"])
    return found, kept.select(experiment, station, F.col("gs").alias("boundary")).distinct()


def boundary_union(local: DataFrame, shared: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """All boundaries, and for each key how many are local, shared only, and in all."""
    both = local.select(*keys, "boundary", F.lit(1).alias("is_local")).unionByName(shared.select(*keys, "boundary", F.lit(0).alias("is_local")))
    merged = both.groupBy(*keys, "boundary").agg(F.max("is_local").alias("is_local"))
    counts = merged.groupBy(*keys).agg(F.sum("is_local").alias("local_boundaries"), F.sum(1 - F.col("is_local")).alias("shared_boundaries"), F.count("*").alias("boundaries"))
    return merged.select(*keys, "boundary"), counts


def assign_sessions(rows: DataFrame, boundaries: DataFrame, keys: list[str] = KEYS, ts: str = "ts_ms") -> DataFrame:
    """session_no, 1 + boundaries strictly before a row, and session_id."""
    numbered = count_marks(rows.where(" and ".join(f"{k} is not null" for k in keys)), boundaries, keys, ts, "boundary", False, "__n")
    number = F.col("__n") + 1
    return numbered.withColumns({"session_no": number, "session_id": session_label(F.col(keys[0]), F.col(keys[1]), number)}).drop("__n")


def assign_by_threshold(rows: DataFrame, threshold: DataFrame, keys: list[str] = KEYS, ts: str = "ts_ms") -> DataFrame:
    """As :func:`assign_sessions` where the only boundaries are gaps above each key's threshold: one window over the rows."""
    order = Window.partitionBy(*keys).orderBy(ts)
    known = rows.where(" and ".join(f"{k} is not null" for k in keys)).join(threshold.select(*keys, "threshold_ms"), keys, "left")
    opened = known.withColumn("__o", F.coalesce((F.col(ts) - F.lag(ts).over(order) > F.col("threshold_ms")).cast("long"), F.lit(0)))
    number = F.sum("__o").over(order.rangeBetween(Window.unboundedPreceding, 0)) + 1  # rows of one time are in one session
    numbered = opened.withColumn("session_no", number.cast("long")).drop("__o", "threshold_ms")
    return numbered.withColumn("session_id", session_label(F.col(keys[0]), F.col(keys[1]), F.col("session_no")))


def intervals(rows: DataFrame, keys: list[str] = KEYS, ts: str = "ts_ms") -> DataFrame:
    return (
        rows.groupBy(*keys, "session_id")
        .agg(F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"), F.count("*").alias("row_count"))
        .withColumn("duration_seconds", (F.col("last_ms") - F.col("first_ms")) / 1000.0)
    )


def sessions_of(points: DataFrame, session_intervals: DataFrame, keys: list[str] = KEYS, ts: str = "ts_ms") -> DataFrame:
    """Each point with the session whose interval holds it, else null."""
    return within_intervals(points, session_intervals, keys, ts, "first_ms", "last_ms", {"session_id": "session_id"})
