"""Deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_quantiles(rows: DataFrame, keys: list[str], order: list[str], count: Column | int, truncate: bool = False) -> DataFrame:
    """At most ``count`` rows of each group, evenly spaced in order: positions round_half_even(i * step), the step taken first.

    All rows of groups that aren't larger; one row is the first.  ``truncate``: positions are cut, not rounded.
    """
    count = F.lit(count) if isinstance(count, int) else count
    group = Window.partitionBy(*keys)
    numbered = rows.withColumns({"__k": F.row_number().over(group.orderBy(*order)) - 1, "__n": F.count("*").over(group), "__c": count})
    step = (F.col("__n") - 1) / (F.col("__c") - 1)
    # a row is taken if the position nearest to it comes from a whole step
    near = F.floor(F.col("__k") / step)
    cut = (lambda x: F.floor(x)) if truncate else (lambda x: F.rint(x))
    taken = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        taken = taken | ((i >= 0) & (i < F.col("__c")) & (cut(i.cast("double") * step) == F.col("__k")))
    keep = F.when(F.col("__c") <= 0, F.lit(False)).when(F.col("__c") >= F.col("__n"), F.lit(True)).when(F.col("__c") == 1, F.col("__k") == 0).otherwise(taken)
    return numbered.where(keep).drop("__k", "__n", "__c")


def quota_sample(rows: DataFrame, station: str, order: list[str], count: int) -> DataFrame:
    """``count`` rows over all stations: equal quotas, the remainder to the first stations in order."""
    stations = rows.where(F.col(station).isNotNull()).select(station).distinct()
    ranked = stations.withColumns({"__r": F.row_number().over(Window.orderBy(station)) - 1, "__s": F.count("*").over(Window.partitionBy())})  # a row a station
    quota = F.floor(F.lit(count) / F.col("__s")) + F.when(F.col("__r") < F.lit(count) % F.col("__s"), 1).otherwise(0)
    joined = rows.join(F.broadcast(ranked.select(station, quota.alias("__q"))), station)
    return temporal_quantiles(joined, [station], order, F.col("__q")).drop("__q")


def class_sample(rows: DataFrame, split: str, label: str, station: str, order: list[str], counts: dict[str, int]) -> DataFrame:
    """For each split, label and station up to the split's count."""
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col(split))
    return temporal_quantiles(rows.where(F.col(split).isin(*counts)), [split, label, station], order, quota)


def bin_sample(rows: DataFrame, station: str, target: str, identity: str, bins: int, seed: int = 0) -> DataFrame:
    """One row of each of ``bins`` equal-frequency bins of the target, for each station: that of the least seeded hash."""
    binned = rows.withColumn("bin", F.ntile(bins).over(Window.partitionBy(station).orderBy(target, identity)))
    draw = Window.partitionBy(station, "bin").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string"))), identity)
    return binned.withColumn("__r", F.row_number().over(draw)).where("__r = 1").drop("__r")


def split_by(rows: DataFrame, key: str, splits: dict[str, str], unknown: str = "raise", name: str = "split") -> DataFrame:
    """The split of each row's key.  Keys without one: ``raise``, ``drop`` or ``label`` (they are "unknown")."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in splits.items() for x in pair]), F.col(key))
    if unknown == "raise":
        return rows.withColumn(name, F.coalesce(found, F.raise_error(F.concat(F.lit("no split for "), F.coalesce(F.col(key), F.lit("null")))).cast("string")))
    out = rows.withColumn(name, found)
    return out.where(F.col(name).isNotNull()) if unknown == "drop" else out.withColumn(name, F.coalesce(name, F.lit("unknown")))


def split_summary(rows: DataFrame, split: str, experiment: str, station: str, ts: str, label: str | None = None) -> DataFrame:
    out = [F.count("*").alias("rows"), F.count_distinct(experiment).alias("experiments"), F.count_distinct(station).alias("stations"), F.min(ts).alias("first"), F.max(ts).alias("last")]
    return rows.groupBy(split, *([label] if label else [])).agg(*out)
