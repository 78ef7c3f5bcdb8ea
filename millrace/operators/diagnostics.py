"""Reports: sampling, coverage, missing values, presence, use of matched rows, correlations, interval summaries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import QUANTILE_NAMES, TEN_QUANTILES, quantiles


def sampling_report(rows: DataFrame, keys: list[str], ts: str = "ts_ms", burst_ms: int = 100) -> DataFrame:
    """Per group, null keys too: count, span, rate, and the differences between consecutive times; quantiles are of positive ones."""
    step = F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    positive = F.when(F.col("d") > 0, F.col("d"))
    span = (F.max(ts) - F.min(ts)) / 1000.0
    return rows.withColumn("d", step).groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"), span.alias("duration_seconds"),
        F.try_divide(F.count("*").cast("double"), span).alias("rate_hz"), F.avg(positive).alias("delta_mean"), F.stddev_samp(positive).alias("delta_std"),
        *quantiles(positive, "delta_"),
        F.count_if(F.col("d") == 0).alias("zero_deltas"), F.count_if(F.col("d") < 0).alias("negative_deltas"), F.count_if((F.col("d") > 0) & (F.col("d") <= burst_ms)).alias("burst_deltas"),
    )


def missing_zero(frame: DataFrame, table: str) -> DataFrame:
    """Per column: rows, nulls, zeros (false is zero; strings have none), least and greatest as numbers (texts where they read as such).

    One pass over the table: a partial aggregate of all columns, unpivoted.
    """
    packed = []
    for name, kind in frame.dtypes:
        c = F.col(f"`{name}`")
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        number = c.cast("int").cast("double") if kind == "boolean" else c.try_cast("double") if numeric or kind == "string" else F.lit(None).cast("double")
        zero = F.count_if(number == 0) if numeric or kind == "boolean" else F.lit(0).cast("long")
        packed.append(F.struct(F.lit(name).alias("column"), F.count("*").alias("row_count"), F.count_if(c.isNull()).alias("null_count"), zero.alias("zero_count"), F.min(number).alias("minimum"), F.max(number).alias("maximum")))
    one = frame.agg(F.array(*packed).alias("a")).select(F.explode("a").alias("r")).select(F.lit(table).alias("table"), "r.*")
    return one.withColumn("null_percent", F.coalesce(F.try_divide(100.0 * F.col("null_count"), F.col("row_count")), F.lit(0.0)))


def resource_diagnostics(rows: DataFrame, table: str, resource: str = "ResourceID", station: str = "station_id") -> DataFrame:
    """Per resource: its stations, whether it has exactly one (recognised) or several (ambiguous), and rows."""
    out = rows.groupBy(resource).agg(F.array_sort(F.collect_set(station)).alias("stations"), F.count("*").alias("row_count"))
    return out.select(F.lit(table).alias("table"), resource, "stations", (F.size("stations") == 1).alias("recognized"), (F.size("stations") > 1).alias("ambiguous"), "row_count")


def presence(power: DataFrame, operation: DataFrame, keys: list[str]) -> DataFrame:
    """Per key in either: rows of both, and whether only one has any.  Null keys meet."""
    both = power.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("o")).unionByName(operation.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("o")))
    out = both.groupBy(*keys).agg(F.sum("p").alias("power_rows"), F.sum("o").alias("operation_rows"))
    return out.withColumns({"power_only": F.col("operation_rows") == 0, "operation_only": F.col("power_rows") == 0})


def timestamp_diagnostics(rows: DataFrame, keys: list[str], ts: str, raw_order: list[str], day: Column | None = None) -> DataFrame:
    """Per group: invalid times, times not of 13 digits, times on another day than the group's, falls in raw order, ends."""
    order = Window.partitionBy(*keys).orderBy(*raw_order)
    falls = F.lag(ts).over(order) > F.col(ts)
    other = F.to_date(F.timestamp_millis(F.col(ts))) != day if day is not None else F.lit(None).cast("boolean")
    return rows.withColumn("__f", falls).groupBy(*keys).agg(
        F.count_if(F.col(ts).isNull()).alias("invalid"), F.count_if(~F.col(ts).cast("string").rlike(r"^\d{13}$")).alias("not_13_digits"), F.count_if(other).alias("other_day"), F.count_if("__f").alias("regressions"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms")
    )


def join_coverage(fused: DataFrame, keys: list[str]) -> DataFrame:
    """Per group, null keys too: rows, matched, percent, ambiguous, and quantiles of the matched state's age."""
    age = F.when(F.col("join_matched"), F.col("state_age_seconds"))
    return fused.withColumn("__age", age).groupBy(*keys).agg(
        F.count("*").alias("power_rows"), F.count_if("join_matched").alias("matched"), F.count_if("join_ambiguous").alias("ambiguous"), (100.0 * F.count_if("join_matched") / F.count("*")).alias("coverage_percent"), *quantiles("__age", "age_")
    )


def operation_usage(operation: DataFrame, fused: DataFrame, identity: str, used: str) -> DataFrame:
    """Each operation row with how often it was matched, 0 included."""
    uses = fused.where(F.col(used).isNotNull()).groupBy(F.col(used).alias(identity)).agg(F.count("*").alias("uses"))
    return operation.join(uses, identity, "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))


def usage_summary(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(F.count("*").alias("operation_rows"), F.count_if(F.col("uses") == 0).alias("unused"), F.count_if(F.col("uses") == 1).alias("used_once"), F.count_if(F.col("uses") > 1).alias("used_often"), F.avg("uses").alias("mean_uses"), F.max("uses").alias("max_uses"))


def session_overlap(power: DataFrame, operation: DataFrame, keys: list[str], ts: str = "ts_ms") -> DataFrame:
    """Per key: overlap of the two spans and what the power span has before and after, in seconds."""
    p = power.groupBy(*keys).agg(F.min(ts).alias("p0"), F.max(ts).alias("p1"))
    o = operation.groupBy(*keys).agg(F.min(ts).alias("o0"), F.max(ts).alias("o1"))
    j = p.join(o, keys)
    over = F.greatest(F.lit(0), F.least("p1", "o1") - F.greatest("p0", "o0")) / 1000.0
    return j.select(*keys, over.alias("overlap_seconds"), (F.greatest(F.lit(0), F.col("o0") - F.col("p0")) / 1000.0).alias("power_before_seconds"), (F.greatest(F.lit(0), F.col("p1") - F.col("o1")) / 1000.0).alias("power_after_seconds"))


def highest_age(fused: DataFrame, k: int, identity: str) -> DataFrame:
    return fused.where("state_age_seconds is not null").orderBy(F.desc("state_age_seconds"), identity).limit(k)


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    from .sampling import temporal_quantiles

    return temporal_quantiles(rows, keys, order, most, truncate=True)


def exact_quantiles(long: DataFrame, name: str, value: str, cells: int = 1024) -> DataFrame:
    """``name`` and ten exact, interpolated quantiles of its values, by rank selection: no task sorts a whole column.

    A histogram of equal cells between each name's ends (one row a cell reaches the driver) tells which cells hold the ranks that
    the quantiles need; only the distinct values of those cells are sorted.  Nulls and NaN are left out.
    """
    known = long.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(name, value).agg(F.count("*").alias("__n"))
    ends = known.groupBy(name).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("__n").alias("__all"))
    width = F.col("__high") - F.col("__low")
    cell = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__low")) / width * cells), F.lit(cells - 1))).otherwise(0).cast("int")
    placed = known.join(F.broadcast(ends), name).withColumn("__cell", cell)  # a row a name
    counts = placed.groupBy(name, "__cell").agg(F.sum("__n").alias("__rows"), F.max("__all").alias("__total")).collect()
    before: dict = {}
    wanted = []  # name, cell, rank within the cell, quantile, weight
    for r in sorted(counts, key=lambda r: (r[name], r["__cell"])):
        at = before.get(r[name], 0)
        for q, label in zip(TEN_QUANTILES, QUANTILE_NAMES):
            place = q * (r["__total"] - 1)
            low = int(place)
            for rank, weight in ((low, 1 - (place - low)), (low + 1, place - low)):
                if weight and at <= rank < at + r["__rows"]:
                    wanted.append((r[name], r["__cell"], rank - at, label, weight))
        before[r[name]] = at + r["__rows"]
    ranks = F.broadcast(long.sparkSession.createDataFrame(wanted, f"{name} {dict(long.dtypes)[name]}, __cell int, __rank long, __label string, __weight double"))  # twenty rows a name
    order = Window.partitionBy(name, "__cell").orderBy(value)
    needed = placed.join(ranks.select(name, "__cell").distinct(), [name, "__cell"], "left_semi").withColumn("__to", F.sum("__n").over(order))
    found = needed.join(ranks, [name, "__cell"]).where((F.col("__rank") < F.col("__to")) & (F.col("__rank") >= F.col("__to") - F.col("__n")))
    parts = found.groupBy(name, "__label").agg(F.sum(F.col(value) * F.col("__weight")).alias("__v"))
    return parts.groupBy(name).agg(*[F.max(F.when(F.col("__label") == n, F.col("__v"))).alias(n) for n in QUANTILE_NAMES])


def _long(rows: DataFrame, features: list[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    return rows.select(*keep, F.explode(pairs).alias("r")).select(*keep, "r.*")


def feature_diagnostics(rows: DataFrame, features: list[str], chosen: list[str] | None = None) -> DataFrame:
    """Per feature: missing share, variance, ten quantiles, and (with ``chosen``) the greatest size of its correlation with another chosen one."""
    plain = [F.struct(F.lit(f).alias("feature"), (F.count_if(F.col(f).isNull()) / F.count("*")).alias("missing_fraction"), F.var_samp(F.col(f).cast("double")).alias("variance")) for f in features]
    one = rows.agg(F.array(*plain).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    out = one.join(F.broadcast(exact_quantiles(_long(rows, features), "feature", "v")), "feature", "left")  # a row a feature
    if chosen:
        pairs = correlations(rows, sorted({*features, *chosen}))
        both = pairs.select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("other"), "pearson").unionByName(pairs.select(F.col("feature_b").alias("feature"), F.col("feature_a").alias("other"), "pearson"))
        top = both.where(F.col("other").isin(*chosen)).groupBy("feature").agg(F.max(F.abs("pearson")).alias("max_abs_correlation"))
        out = out.join(F.broadcast(top), "feature", "left")
    return out


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each pair of features, over rows that have both; one pass."""
    pairs = list(combinations(features, 2))
    out = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.corr(a, b).alias("pearson")) for a, b in pairs]
    return rows.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def group_shift(rows: DataFrame, features: list[str], group: str) -> DataFrame:
    """Per feature: range of the groups' medians, absolute and relative to the mean's size (1e-12 at least)."""
    long = _long(rows, features, group)
    medians = long.groupBy("feature", group).agg(F.median("v").alias("m")).groupBy("feature").agg((F.max("m") - F.min("m")).alias("median_range"))
    means = long.groupBy("feature").agg(F.avg("v").alias("mean"))
    return medians.join(means, "feature").select("feature", "median_range", (F.col("median_range") / F.greatest(F.abs("mean"), F.lit(1e-12))).alias("relative_range"))


def interval_summary(gap_rows: DataFrame, keys: list[str], gap: str = "gap") -> DataFrame:
    """Median, and p10 and p90 by lower index (position floor((n - 1) p), not interpolated)."""
    order = Window.partitionBy(*keys).orderBy(gap)
    ranked = gap_rows.withColumns({"__k": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    at = lambda p: F.max(F.when(F.col("__k") == F.floor((F.col("__n") - 1) * F.lit(p)), F.col(gap)))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.median(gap).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"))


def time_profile(rows: DataFrame, keys: list[str], series: str, ts: str, line: str, digest: str) -> DataFrame:
    """Per group of rows in line order: rows, repeats, ends, and the differences of consecutive times of a series: their number, median,
    lower p10 and p90 (by position), how many are zero, and how many fall.  A row without a time has no difference."""
    order = Window.partitionBy(*keys, series).orderBy(line)
    timed = rows.withColumn("__d", F.when(F.col(ts).isNotNull(), F.col(ts) - F.last(ts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    whole = timed.groupBy(*keys).agg(
        F.count("*").alias("record_count"), (F.count("*") - F.count_distinct(digest)).alias("duplicate_rows"), F.count_if(F.col("__d") == 0).alias("repeated_times"), F.count_if(F.col("__d") < 0).alias("regressions"),
        F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"),
    )
    gaps = interval_summary(timed.where("__d is not null"), keys, "__d").select(*keys, F.col("n").alias("gap_count"), F.col("median").alias("gap_median"), F.col("p10").alias("gap_p10"), F.col("p90").alias("gap_p90"))
    return whole.join(gaps, keys, "left")


def column_profile(rows: DataFrame, keys: list[str], fields: str, missing: Column, numeric: bool = True) -> DataFrame:
    """Per group and field of the map column ``fields``: rows, missing ones, and the ends of what reads as a number."""
    each = rows.select(*keys, F.explode(fields).alias("column", "v"))
    number = F.when(~missing, F.col("v").try_cast("double"))
    out = [F.count("*").alias("row_count"), F.count_if(missing).alias("missing_count")]
    return each.groupBy(*keys, "column").agg(*out, *([F.min(number).alias("minimum"), F.max(number).alias("maximum")] if numeric else []))


def raw_profile(rows: DataFrame, table: list[str], resource: str, ts: str, line: str, digest: str) -> DataFrame:
    """Per file and table: rows, exact duplicates, rows that differ from the first at their resource and time, falls in line order, ends."""
    at_ts = Window.partitionBy(*table, resource, ts).orderBy(line)
    in_file = Window.partitionBy(*table, resource).orderBy(line)
    marked = rows.withColumns({"__c": F.col(digest) != F.first(digest).over(at_ts), "__f": F.lag(ts).over(in_file) > F.col(ts)})
    return marked.groupBy(*table).agg(F.count("*").alias("row_count"), (F.count("*") - F.count_distinct(digest)).alias("duplicate_rows"), F.count_if("__c").alias("conflicts"), F.count_if("__f").alias("regressions"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))
