"""Features of segments of power samples: one aggregate, with the samples' lag taken in the same partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope(y: str, seconds: Column) -> Column:
    """Least-squares slope: null without values, 0 where times don't differ."""
    return F.when(F.count(y) > 0, F.coalesce(F.regr_slope(F.col(y), seconds), F.lit(0.0)))


def segment_features(rows: DataFrame, segment: list[str], ts: str = "ts_ms", tiebreak: str = "row_id", power: str = "power", others: tuple[str, ...] = ("flow", "pressure")) -> DataFrame:
    """Count, moments, median, range, first-to-last change, density, energy, slopes and ends of each segment.

    First and last skip nulls; deviations of one value are 0; density is null over no duration; energy is the trapezoid
    sum over neighbouring samples that both have a value.
    """
    order = Window.partitionBy(*segment).orderBy(ts, tiebreak)
    start = F.min(ts).over(Window.partitionBy(*segment))
    p, before = F.col(power), F.lag(power).over(order)
    step = (F.col(ts) - F.lag(ts).over(order)) / 1000.0
    prepared = rows.withColumns({"__x": (F.col(ts) - start) / 1000.0, "__e": (p + before) / 2.0 * step})
    at = F.when(p.isNotNull(), F.struct(ts, tiebreak))
    duration = (F.max(ts) - F.min(ts)) / 1000.0
    out = [
        F.count("*").alias("sample_count"), F.avg(p).alias("power_mean"), F.min(p).alias("power_min"), F.max(p).alias("power_max"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("power_std"), F.median(p).alias("power_median"),
        (F.max(p) - F.min(p)).alias("power_range"), (F.max_by(p, at) - F.min_by(p, at)).alias("power_delta"),
        F.try_divide(F.count("*").cast("double"), duration).alias("density_hz"), F.coalesce(F.sum("__e"), F.lit(0.0)).alias("energy_ws"),
        slope(power, F.col("__x")).alias("power_slope"), F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), duration.alias("duration_seconds"),
    ]
    for o in others:
        out += [F.avg(o).alias(f"{o}_mean"), F.min(o).alias(f"{o}_min"), F.max(o).alias(f"{o}_max"), F.coalesce(F.stddev_samp(o), F.lit(0.0)).alias(f"{o}_std"), slope(o, F.col("__x")).alias(f"{o}_slope")]
    return prepared.groupBy(*segment).agg(*out)


def duration_statistics(segments: DataFrame, keys: list[str], duration: str = "duration_seconds", dwell: float = 1.0) -> DataFrame:
    """Of raw segments and of those that last ``dwell`` seconds: n, median, quartiles, p90, mean, least, most."""
    d = F.col(duration)
    stats = [F.count("*").alias("n"), F.median(d).alias("median"), F.percentile(d, F.lit(0.25)).alias("p25"), F.percentile(d, F.lit(0.75)).alias("p75"), F.percentile(d, F.lit(0.9)).alias("p90"), F.avg(d).alias("mean"), F.min(d).alias("minimum"), F.max(d).alias("maximum")]
    known = segments.where(" and ".join(f"{k} is not null" for k in keys))
    raw = known.groupBy(*keys).agg(*stats).withColumn("statistics", F.lit("raw"))
    return raw.unionByName(known.where(d >= dwell).groupBy(*keys).agg(*stats).withColumn("statistics", F.lit(f"dwell>={dwell:g}s")))
