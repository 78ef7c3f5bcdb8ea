"""Structured Streaming forms: states and anchored windows need no state of ours; as-of matching keeps the last state a key.

Session thresholds need a whole group's quantile, so a stream takes boundaries that a batch has derived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.states import BITS, classify


def classified(stream: DataFrame, station: str = "station_id") -> DataFrame:
    return stream.withColumn("plc_state", classify(F.col(station), [F.col(b) for b in BITS]))


def windowed_power(stream: DataFrame, event_time: str, station: str, watts: str, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Count and mean of each station's power in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), station).agg(F.count("*").alias("n"), F.avg(watts).alias("mean_watts"))


def asof_stream(stream: DataFrame, key: str, ts: str, is_state: str, state: str, identity: str) -> DataFrame:
    """Each reading with the newest state of its key at or before it, over a stream of both (``is_state`` tells states).

    Within a micro-batch rows go by time, states first at equal times; two different state rows of one time are
    ambiguous and match nothing, as in batch.  A reading that comes after a later state has been seen still meets
    the states kept: the last ``16`` of its key.
    """
    out = f"{identity} long, {ts} long, matched_state string, matched_ts long, join_ambiguous boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*held.get)) if held.exists else {}
        pdf = pd.concat(list(frames))
        for t, s in pdf[pdf[is_state]][[ts, state]].itertuples(index=False):
            known[int(t)] = "\0" if int(t) in known else s
        times = sorted(known)
        rows = []
        for i, t in pdf[~pdf[is_state]].sort_values(ts)[[identity, ts]].itertuples(index=False):
            at = next((x for x in reversed(times) if x <= t), None)
            double = at is not None and known[at] == "\0"
            rows.append((i, t, None if at is None or double else known[at], None if at is None or double else at, double))
        times = times[-16:]
        held.update((times, [known[t] for t in times]))
        yield pd.DataFrame(rows, columns=[identity, ts, "matched_state", "matched_ts", "join_ambiguous"]).astype({"matched_ts": "Int64"})

    return stream.groupBy(key).applyInPandasWithState(step, out, "times array<long>, states array<string>", "append", GroupStateTimeout.NoTimeout)
