"""Composite datasets: fused readings, idle durations with context and look-back features, naive baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_backward, context, latest_row, lookback

#: States whose beginning triggers an idle-duration row.
IDLE = ("idle_ready",)


def fuse(power: DataFrame, operation: DataFrame, keys: list[str], ts: str, columns: dict[str, str], bucket_ms: int | None = None) -> DataFrame:
    """Exactly one row a power row, with the operation state at its time in the same session."""
    return asof_backward(power, operation, keys, ts, ts, columns, bucket_ms, "plc_timestamp_epoch_ms")


def idle_dataset(segments: DataFrame, fused: DataFrame, keys: list[str], values: list[str], at_trigger: dict[str, str], ts: str, tiebreak: str, scales: list[int], min_dwell: float = 1.0, idle: tuple[str, ...] = IDLE, state: str = "plc_state", busy: str = "processing", where: Column | None = None) -> DataFrame:
    """Idle segments of ``min_dwell`` seconds or more: context over all segments first, then look-back features, the last
    row's values at the start, the hour (UTC), and the logarithm of the duration as target."""
    chosen = context(segments, keys, state, busy).where(F.col(state).isin(*idle) & (F.col("duration_seconds") >= min_dwell))
    if where is not None:
        chosen = chosen.where(where)
    looked = lookback(chosen, fused, keys, "start_ms", ts, values, scales)
    found = latest_row(looked, fused, keys, "start_ms", ts, at_trigger, tiebreak)
    return found.withColumns({"hour_of_day": F.floor(F.pmod(F.col("start_ms"), F.lit(86_400_000)) / 3_600_000).cast("int"), "target_log1p": F.log1p("duration_seconds")})


def one_hot(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A double column for each category; null is 0 everywhere."""
    return rows.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)) for c in categories})


def naive_predictions(rows: DataFrame, station: str, start: str, duration: str, split: str | None = None, train: str = "train") -> DataFrame:
    """naive_previous: the station's last duration before; naive_median: its median over training rows; both fall back on the median of all training rows."""
    learn = rows if split is None else rows.where(F.col(split) == train)
    overall = learn.agg(F.median(duration).alias("__all"))
    own = learn.groupBy(station).agg(F.median(duration).alias("__own"))
    order = Window.partitionBy(station).orderBy(start, duration)
    joined = rows.withColumn("__prev", F.lag(duration).over(order)).join(F.broadcast(own), station, "left").crossJoin(F.broadcast(overall))  # a row a station; one row
    return joined.withColumns({"naive_previous": F.coalesce("__prev", "__all"), "naive_median": F.coalesce("__own", "__all")}).drop("__prev", "__own", "__all")


def prediction_log(rows: DataFrame, model: str, condition: str, prediction: Column, keep: list[str], from_log: bool = True) -> DataFrame:
    return rows.select(F.lit(model).alias("model"), F.lit(condition).alias("condition"), *keep, (F.expm1(prediction) if from_log else prediction).alias("prediction"))


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a key repeats on either side."""
    def checked(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key)))

    return checked(left).join(checked(right), key)
