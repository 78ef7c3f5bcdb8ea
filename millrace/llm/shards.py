"""Operator 4: shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts stand together.  A size-weighted sample of keys,
of bounded size, gives quantile boundaries of many small ranges; ranges are counted exactly, and overfull ones (hot
keys, unlucky samples) are subdivided by a sample of their own.  Prefix sums of the ranges' bytes and rows give each
record its exact place in the whole order, hence its shard and its slot.  Only narrow rows are shuffled, never texts.

Equal texts are a group and share a shard.  Groups of more than ``large`` of a shard's bytes, of which there are at most
``shards / large``, are dealt first, the largest to the emptiest shard; the others fill the shards up to a common level, in order, each
where the middle of its group falls.  Only a group that alone exceeds a shard's share is cut between records;
``group_cut`` says so in its rows.  Null text has size 8 and counts as empty; rows with equal doc_id and text are ordered among
themselves anyhow; a null doc_id comes first among equal texts; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

_LOWEST = -(1 << 63)


def _range_of(splitters: list[tuple[int, int]]):
    keys = np.array([k for k, _ in splitters], np.int64)
    docs = np.array([d for _, d in splitters], np.int64)

    @F.pandas_udf("int")
    def of(key: pd.Series, doc: pd.Series) -> pd.Series:
        k, d = key.to_numpy(np.int64), doc.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = lo.astype(np.int32)
        cut = lo < hi
        for at in np.unique(lo[cut]):  # keys that a splitter stands in
            rows = cut & (lo == at)
            out[rows] += np.searchsorted(docs[at : hi[rows][0]], d[rows], "right").astype(np.int32)
        return pd.Series(out)

    return of


def _quantiles(sample: list, n: int, cut: set[int] | None) -> list[tuple[int, int]]:
    """n - 1 boundaries of equal weight among (key, doc, weight) rows; within a key only if it is in ``cut`` (None: in any)."""
    if not sample or n < 2:
        return []
    sample = sorted(sample)
    before = np.cumsum([r[2] for r in sample])
    at = np.minimum(np.searchsorted(before, before[-1] * np.arange(1, n) / n), len(sample) - 1)
    return sorted({(sample[i][0], sample[i][1] if cut is None or sample[i][0] in cut else _LOWEST) for i in at})


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    return rows.withColumn("range", _range_of(splitters)("key", "doc")) if splitters else rows.withColumn("range", F.lit(0))


def _ordered(rows: DataFrame, least_ranges: int, rows_in_range: int, oversample: int, cut: set[int] | None = None) -> tuple[DataFrame, int, int]:
    """The rows with the bytes (``before``) and rows (``place``) before them in the order, and ``group_before``, the bytes before
    the first of their key in their range; and all rows and bytes.  Groups outside ``cut`` are never split between ranges."""
    all_rows, all_bytes = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = max(least_ranges, -(-all_rows // rows_in_range))
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit(17)), F.lit(1 << 52)) / float(1 << 52)
    unit = max(all_bytes or 0, 1) / (ranges * oversample)  # a record of this size or more is always drawn
    sample = rows.where(chance < F.col("size") / unit).select("key", "doc", F.greatest("size", F.lit(unit)).alias("weight")).collect()
    splitters = _quantiles(sample, ranges, cut)
    for again in range(3):
        counts = {r[0]: (r[1], r[2]) for r in _ranged(rows, splitters).groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        most_bytes, most_rows = 2 * (all_bytes or 0) / ranges, max(2 * all_rows / ranges, 2)
        over = {r: int(max(b / most_bytes, n / most_rows)) + 1 for r, (b, n) in counts.items() if n > 1 and (b > most_bytes or n > most_rows)}
        if not over or again == 2:
            break
        rate = F.element_at(F.create_map(*[F.lit(x) for r, parts in over.items() for x in (r, oversample * parts / counts[r][1])]), F.col("range"))
        more = _ranged(rows, splitters).where(F.col("range").isin(*over)).where(chance < rate).select("range", "key", "doc").collect()
        found = {s for r, parts in over.items() for s in _quantiles([(x.key, x.doc, 1) for x in more if x.range == r], parts, cut)}
        if found <= set(splitters):
            break
        splitters = sorted({*splitters, *found})
    bases, size_before, rows_before = [], 0, 0
    for r in sorted(counts):
        bases.append((r, size_before, rows_before))
        size_before, rows_before = size_before + counts[r][0], rows_before + counts[r][1]
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "range int, size_before long, rows_before long"))  # a row a range
    order = Window.partitionBy("range").orderBy("key", "doc")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = _ranged(rows, splitters).select("*", before.alias("b"), (F.row_number().over(order) - 1).cast("long").alias("p")).join(base, "range")
    group = Window.partitionBy("range", "key")
    placed = placed.select("*", (F.col("b") + F.col("size_before")).alias("before"), (F.col("p") + F.col("rows_before")).alias("place"))
    return placed.withColumns({"group_before": F.min("before").over(group), "group_size": F.sum("size").over(group)}).drop("range", "b", "p", "size_before", "rows_before"), all_rows, all_bytes


def _levels(loads: list[float], rest: float) -> list[float]:
    """What each shard takes of the rest, so that those that take any end on one level."""
    level, n = 0.0, 0
    ranked = sorted(loads)
    for n in range(1, len(ranked) + 1):
        level = (sum(ranked[:n]) + rest) / n
        if n == len(ranked) or level <= ranked[n]:
            break
    return [max(level - x, 0.0) for x in loads]


def _shard_of(bounds: list[float]):
    edges = np.array(bounds)

    @F.pandas_udf("int")
    def of(middle: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(edges, middle.to_numpy(), "right"), len(edges) - 1).astype(np.int32))

    return of


def shard_by_bytes(docs: DataFrame, shards: int = 24, rows_in_range: int = 1_000_000, oversample: int = 16, large: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves records when shards are added), group_cut."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = materialize(sized.withColumn("doc", F.coalesce("doc_id", F.lit(_LOWEST))), "sizes")
    all_bytes = rows.agg(F.sum("size")).first()[0]
    if not all_bytes:
        return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' law", "cast(0 as int) shard", "0L slot", "cast(null as int) grown_shard", "false group_cut")
    share = all_bytes / shards
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > large * share) & (F.col("n") > 1)).collect()  # at most shards / large
    huge = {g["key"] for g in groups if g["bytes"] > share}
    loads, counts, dealt = [0.0] * shards, [0] * shards, []
    for g in sorted(groups, key=lambda g: (-g["bytes"], g["key"])):
        if g["key"] not in huge:
            k = min(range(shards), key=lambda i: (loads[i], i))
            dealt.append((g["key"], k, counts[k]))
            loads[k], counts[k] = loads[k] + g["bytes"], counts[k] + g["n"]
    of_group = F.broadcast(spark.createDataFrame(dealt, "key long, shard int, from long"))
    rest, n, rest_bytes = _ordered(rows.join(of_group.select("key"), "key", "left_anti"), 8 * shards, rows_in_range, oversample, huge)
    bounds = np.cumsum(_levels(loads, rest_bytes or 0)).tolist()
    is_huge = F.col("key").isin(*huge) if huge else F.lit(False)
    middle = F.when(is_huge, F.col("before") + F.col("size") / 2).otherwise(F.col("group_before") + F.col("group_size") / 2)
    rest = rest.select("doc_id", "size", "text_crc32", _shard_of(bounds)(middle.cast("double")).alias("shard"), "place", is_huge.alias("group_cut"))
    rest = materialize(rest, "placed")
    first = {r[0]: r[1] for r in rest.groupBy("shard").agg(F.min("place")).collect()}
    starts = F.broadcast(spark.createDataFrame([(k, first.get(k, 0), counts[k]) for k in range(shards)], "shard int, first long, dealt long"))  # a row a shard
    out = rest.join(starts, "shard").withColumn("slot", F.col("place") - F.col("first") + F.col("dealt"))
    names = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_cut"]
    if not dealt:
        return out.select(*names)
    together, _, _ = _ordered(rows.join(of_group.select("key"), "key", "left_semi"), 8 * shards, rows_in_range, oversample)
    together = materialize(together.select("doc_id", "size", "text_crc32", "key", "place"), "together")
    of_first = F.broadcast(together.groupBy("key").agg(F.min("place").alias("first")))  # a row a dealt group
    own = together.join(of_group, "key").join(of_first, "key").withColumns({"slot": F.col("place") - F.col("first") + F.col("from"), "group_cut": F.lit(False)})
    return out.select(*names).unionByName(own.select(*names))
