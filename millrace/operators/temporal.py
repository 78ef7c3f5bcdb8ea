"""Generic temporal operators over keys, an order column in epoch milliseconds, and explicit tie-breaks.

All are equi-partitioned windows or aggregates: no range join is planned as a nested loop, nothing is collected.
A key's rows stream through its window in order.  Where one key holds much of the data, ``bucket_ms`` cuts its
time line into buckets that are separate tasks, with what earlier buckets leave carried over (one row a bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks


def _known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _salt(rows: DataFrame, ok: Column, ts: str) -> Column:
    """0 for rows that can match; the others, which meet nothing, are spread by hash instead of standing in one task."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(0)).otherwise(F.pmod(F.xxhash64(ts, rows.columns[0]), F.lit(4096)).cast("int") + 1)


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: dict[str, str], bucket_ms: int | None = None, right_ts_as: str = "matched_ts_ms"
) -> DataFrame:
    """Each left row with the newest right row of its keys at or before its time.

    ``columns``: right column -> output name.  If several right rows share that time the match is ambiguous: the row
    counts as unmatched and gets nulls, not an older row.  Left rows with a null key or time are kept unmatched.
    Adds the right columns, ``right_ts_as``, join_ambiguous, join_matched and state_age_seconds.
    """
    taken = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    right = right.where(_known(keys) & F.col(right_ts).isNotNull())
    ones = right.groupBy(*keys, F.col(right_ts).cast("long").alias("__t")).agg(F.count("*").alias("__n"), F.first(taken).alias("__r"))
    ones = ones.withColumn("__m", F.struct(F.col("__t").alias("t"), F.col("__n").alias("n"), F.col("__r").alias("r")))
    payload = F.struct(*[F.col(c) for c in left.columns])
    ok = _known(keys) & F.col(left_ts).isNotNull()
    asked = left.select(*keys, _salt(left, ok, left_ts).alias("__s"), F.col(left_ts).cast("long").alias("__t"), F.lit(1).alias("__side"), payload.alias("__l"))
    ones = ones.withColumn("__s", F.lit(0))
    by = [*keys, "__s"]
    if bucket_ms:
        by.append("__b")
        bucket = F.floor(F.col("__t") / bucket_ms).cast("long")
        ones, asked = ones.withColumn("__b", bucket), asked.withColumn("__b", bucket)
    told = ones.select(*by, "__t", F.lit(0).alias("__side"), "__m")
    both = told.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__m", ignorenulls=True).over(order)).where("__side = 1")
    if bucket_ms:
        newest = ones.groupBy(*by).agg(F.max_by("__m", "__t").alias("__new"))
        buckets = newest.unionByName(asked.where("__s = 0").select(*by).distinct(), allowMissingColumns=True).groupBy(*by).agg(F.first("__new", ignorenulls=True).alias("__new"))
        earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = buckets.withColumn("__old", F.last("__new", ignorenulls=True).over(earlier)).select(*by, "__old")
        found = found.join(carried, by, "left").withColumn("__m", F.coalesce("__m", "__old"))
    matched = F.coalesce(F.col("__m.n") == 1, F.lit(False))
    return found.select(
        "__l.*",
        *[F.when(matched, F.col(f"__m.r.{n}")).alias(n) for n in columns.values()],
        F.when(matched, F.col("__m.t")).alias(right_ts_as),
        F.coalesce(F.col("__m.n") > 1, F.lit(False)).alias("join_ambiguous"),
        matched.alias("join_matched"),
        F.when(matched, (F.col(f"__l.{left_ts}").cast("long") - F.col("__m.t")) / 1000.0).alias("state_age_seconds"),
    )


def latest_row(triggers: DataFrame, rows: DataFrame, keys: list[str], trigger_ts: str, row_ts: str, columns: dict[str, str], tiebreak: str) -> DataFrame:
    """Each trigger with the values, nulls included, of the last row at or before it; equal times go by ``tiebreak``."""
    payload = F.struct(*[F.col(c) for c in triggers.columns])
    told = rows.where(_known(keys)).select(*keys, F.lit(0).alias("__s"), F.col(row_ts).cast("long").alias("__t"), F.lit(0).alias("__side"), F.col(tiebreak).alias("__tie"), F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias("__r"))
    asked = triggers.select(*keys, _salt(triggers, _known(keys), trigger_ts).alias("__s"), F.col(trigger_ts).cast("long").alias("__t"), F.lit(1).alias("__side"), payload.alias("__l"))
    order = Window.partitionBy(*keys, "__s").orderBy("__t", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = told.unionByName(asked, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__l.*", *[F.col(f"__r.{n}").alias(n) for n in columns.values()])


def lookback(triggers: DataFrame, samples: DataFrame, keys: list[str], trigger_ts: str, sample_ts: str, values: list[str], seconds: list[int]) -> DataFrame:
    """For each trigger and scale, mean and standard deviation of each value over [trigger - scale, trigger], and the sample count.

    Both ends count; the count has rows with null values too; a mean over none is null, a deviation over fewer than
    two is 0; a trigger without any sample of its keys gets nulls throughout.  Equal triggers stay as many rows.

    For each scale the time line is cut into cells as long as the frame, so a frame is the end of one cell and the beginning of the next.  Counts, means and
    squared deviations run forwards and backwards within cells and are merged for each trigger: the work doesn't grow with the frames' length, and
    no difference of large sums is taken.  One shuffle of the samples for all scales.
    """
    payload = F.struct(*[F.col(c) for c in triggers.columns])
    told = samples.where(_known(keys)).select(*keys, F.lit(0).alias("__s"), F.col(sample_ts).cast("long").alias("__t"), F.lit(1).alias("__side"), *[F.col(v).cast("double").alias(f"__{v}") for v in values])
    at = F.col(trigger_ts).cast("long")
    probes = F.array(F.struct(at.alias("t"), F.lit(2).alias("side"), F.lit(-1).alias("scale")), *[F.struct((at - 1000 * s).alias("t"), F.lit(0).alias("side"), F.lit(s).alias("scale")) for s in seconds])
    asked = triggers.select(*keys, _salt(triggers, _known(keys), trigger_ts).alias("__s"), payload.alias("__l"), F.explode(probes).alias("__p"))
    asked = asked.select(*keys, "__s", F.col("__p.t").alias("__t"), F.col("__p.side").alias("__side"), F.col("__p.scale").alias("__scale"), "__l")
    seen = told.unionByName(asked, allowMissingColumns=True).withColumn("__any", F.max(F.when(F.col("__side") == 1, 1)).over(Window.partitionBy(*keys, "__s")))
    ends, begins = {}, {}
    for s in seconds:
        cell = Window.partitionBy(*keys, "__s", F.floor(F.col("__t") / (1000 * s)))
        for found, order in ((ends, cell.orderBy("__t", "__side")), (begins, cell.orderBy(F.desc("__t"), F.desc("__side")))):
            frame = order.rowsBetween(Window.unboundedPreceding, 0)
            parts = [F.count_if(F.col("__side") == 1).over(frame).alias("rows")]
            for v in values:
                n = F.count(f"__{v}").over(frame)
                parts += [n.alias(f"n_{v}"), F.avg(f"__{v}").over(frame).alias(f"mean_{v}"), (F.var_pop(f"__{v}").over(frame) * n).alias(f"m2_{v}")]
            found[s] = F.struct(*parts)
    seen = seen.withColumns({**{f"__e{s}": c for s, c in ends.items()}, **{f"__b{s}": c for s, c in begins.items()}}).where("__scale is not null")
    # equal triggers have equal frames: one group, as many rows as there are
    is_end = F.col("__scale") == -1
    taken = [F.max(F.when(is_end, F.col("__any"))).alias("__any"), F.count_if(is_end).alias("__copies")]
    for s in seconds:
        taken += [F.max(F.when(is_end, F.col(f"__e{s}"))).alias(f"__e{s}"), F.max(F.when((F.col("__scale") == s) & F.col("__t").isNotNull(), F.col(f"__b{s}"))).alias(f"__b{s}")]
    one = seen.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], "__s", "__l").agg(*taken)
    out: dict[str, Column] = {}
    for s in seconds:
        part = lambda side, c, s=s: F.coalesce(F.col(f"__{side}{s}.{c}"), F.lit(0))
        for v in values:
            n1, n2, m1, m2 = part("b", f"n_{v}"), part("e", f"n_{v}"), part("b", f"mean_{v}"), part("e", f"mean_{v}")
            n = n1 + n2
            mean = F.when(n1 == 0, m2).when(n2 == 0, m1).otherwise(m1 + (m2 - m1) * n2 / n)
            spread = part("b", f"m2_{v}") + part("e", f"m2_{v}") + F.when((n1 > 0) & (n2 > 0), (m2 - m1) * (m2 - m1) * n1 * n2 / n).otherwise(0.0)
            out[f"{v}_{s}s_mean"] = F.when(n > 0, mean)
            out[f"{v}_{s}s_std"] = F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0)
        out[f"n_samples_{s}s"] = (part("b", "rows") + part("e", "rows")).cast("long")
    many = one.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return many.select("__l.*", *[F.when(F.col("__any") == 1, c).alias(n) for n, c in out.items()])


#: Intervals up to this many, and this many of one key, are sent to all tasks.
MOST_INTERVALS, MOST_OF_KEY = 100_000, 1_000


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, first: str, last: str, columns: dict[str, str]) -> DataFrame:
    """Each point with the columns of the interval of its keys that holds it, both ends included; else nulls.

    Intervals of a key must be disjoint, so each point meets one.  Intervals are written once; if they are few (and don't even touch) they
    are broadcast and the points aren't shuffled; else the candidate is the interval that began last, found by one window.
    """
    spark = points.sparkSession
    path = sinks.scratch(spark, "intervals")
    own = intervals.where(_known(keys)).select(*keys, F.col(first).cast("long").alias("__first"), F.col(last).cast("long").alias("__last"), *[F.col(c).alias(f"__v_{n}") for c, n in columns.items()])
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    order = Window.partitionBy(*keys).orderBy("__first", "__last")
    checked = own.withColumns({"__touch": F.lag("__last").over(order) >= F.col("__first"), "__of": F.count("*").over(Window.partitionBy(*keys))})
    n, most, touch = checked.agg(F.count("*"), F.max("__of"), F.max("__touch")).first()
    if n <= MOST_INTERVALS and (most or 0) <= MOST_OF_KEY and not touch:
        small = own.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first", "__last", *[f"__v_{v}" for v in columns.values()])
        inside = F.col(ts).between(F.col("__first"), F.col("__last"))
        for k in keys:
            inside = inside & (F.col(k) == F.col(f"__k_{k}"))
        found = points.join(F.broadcast(small), inside, "left")
        return found.select(*[points[c] for c in points.columns], *[F.col(f"__v_{v}").alias(v) for v in columns.values()])
    found = asof_backward(points, own, keys, ts, "__first", {**{f"__v_{v}": v for v in columns.values()}, "__last": "__last"}, right_ts_as="__first")
    inside = F.coalesce(F.col(ts) <= F.col("__last"), F.lit(False))
    return found.select(*[F.col(c) for c in points.columns], *[F.when(inside, F.col(v)).alias(v) for v in columns.values()])


def count_marks(rows: DataFrame, marks: DataFrame, keys: list[str], ts: str, mark_ts: str, inclusive: bool, name: str) -> DataFrame:
    """Each row with the number of distinct marks of its keys before its time (or at it, if inclusive)."""
    payload = F.struct(*[F.col(c) for c in rows.columns])
    side = 0 if inclusive else 2
    told = marks.where(_known(keys)).select(*keys, F.col(mark_ts).cast("long").alias("__t")).distinct().withColumn("__side", F.lit(side))
    asked = rows.select(*keys, F.col(ts).cast("long").alias("__t"), F.lit(1).alias("__side"), payload.alias("__l"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("__side") == side, 1).otherwise(0)).over(order).cast("long")
    return told.unionByName(asked, allowMissingColumns=True).withColumn("__c", total).where("__side = 1").select("__l.*", F.col("__c").alias(name))


def islands(rows: DataFrame, keys: list[str], value: str, ts: str, tiebreak: str) -> DataFrame:
    """Run-length segments of equal value: keys, value, start_ms, end_ms, n_rows, duration_seconds.  The end is the last row inside."""
    order = Window.partitionBy(*keys).orderBy(ts, tiebreak)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.row_number().over(order) == 1)
    numbered = rows.where(_known(keys)).withColumn("__new", changed.cast("int")).withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*keys, "__no").agg(F.first(value).alias(value), F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.count("*").alias("n_rows"))
    return grouped.select(*keys, value, "start_ms", "end_ms", "n_rows", ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_seconds"))


def transitions(rows: DataFrame, keys: list[str], fields: list[str], ts: str, tiebreak: str) -> DataFrame:
    """Rows at which any field differs from the row before; null is a value, a first row is none."""
    order = Window.partitionBy(*keys).orderBy(ts, tiebreak)
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f).eqNullSafe(F.lag(f).over(order))
    return rows.where(_known(keys)).withColumn("__c", changed & (F.row_number().over(order) > 1)).where("__c").drop("__c")


def anchored_window(rows: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "window_no", base: int = 0) -> DataFrame:
    """Tumbling windows counted from each key's first row, from ``base``."""
    first = F.min(ts).over(Window.partitionBy(*keys))
    return rows.where(_known(keys)).withColumn(name, F.floor((F.col(ts) - first) / (1000 * seconds)).cast("long") + base)


def context(segments: DataFrame, keys: list[str], state: str, busy: str, start: str = "start_ms", end: str = "end_ms", duration: str = "duration_seconds") -> DataFrame:
    """Previous state and duration, count of earlier busy segments, time since the last busy end (its own, for a busy row)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_busy = F.col(state) == busy
    return segments.withColumns(
        {
            "prev_state": F.lag(state).over(order),
            "prev_duration": F.lag(duration).over(order),
            "cycles_before": F.coalesce(F.sum(is_busy.cast("long")).over(before), F.lit(0)).cast("long"),
            "time_since_processing_s": (F.col(start) - F.last(F.when(is_busy, F.col(end)), ignorenulls=True).over(so_far)) / 1000.0,
        }
    )
