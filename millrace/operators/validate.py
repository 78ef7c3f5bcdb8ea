"""Invariants as counts of violations: one aggregate, no row leaves the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """invariant, violations: rows for which a rule is not true (null counts as a violation)."""
    out = [F.struct(F.lit(n).alias("invariant"), F.count_if(~F.coalesce(r, F.lit(False))).alias("violations")) for n, r in rules.items()]
    return rows.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


FUSED_INVARIANTS = ("matched_is_not_ambiguous", "matched_has_time", "matched_has_age", "no_future_match", "age_is_difference", "age_is_not_negative", "unmatched_without_session")


def fused_rules(exact_ts: str = "ts_ms") -> dict[str, Column]:
    """What must hold for every fused row."""
    matched = F.col("join_matched")
    return {
        "matched_is_not_ambiguous": ~(matched & F.col("join_ambiguous")),
        "matched_has_time": matched == F.col("plc_timestamp_epoch_ms").isNotNull(),
        "matched_has_age": matched == F.col("state_age_seconds").isNotNull(),
        "no_future_match": F.coalesce(F.col("plc_timestamp_epoch_ms") <= F.col(exact_ts), F.lit(True)),
        "age_is_difference": F.coalesce(F.col("state_age_seconds") == (F.col(exact_ts) - F.col("plc_timestamp_epoch_ms")) / 1000.0, F.lit(True)),
        "age_is_not_negative": F.coalesce(F.col("state_age_seconds") >= 0, F.lit(True)),
        "unmatched_without_session": F.col("session_id").isNotNull() | ~matched,
    }


def require(checked: DataFrame) -> None:
    """Raise if any invariant is violated."""
    bad = checked.where("violations > 0").collect()  # a row an invariant
    if bad:
        raise ValueError("violated: " + ", ".join(f"{r.invariant} ({r.violations})" for r in bad))


#: State columns that an unmatched reading must not have.
STATE_COLUMNS = ("operation_row_id", "plc_timestamp_epoch_ms", "state_age_seconds")


def audit(fused: DataFrame, power: DataFrame, operation: DataFrame, intervals: DataFrame, gaps: DataFrame, silences: DataFrame, identity: str = "canonical_row_id", ts: str = "ts_ms",
          payload: tuple[str, ...] = (), kinds: dict[str, str] | None = None, forbidden: tuple[str, ...] = (), more: dict[str, Column | DataFrame] | None = None) -> DataFrame:
    """check, violations: all that must hold between readings, machine rows, sessions, silences and the fused table.

    ``gaps``: experiment_id, station_id, start, end of the gaps that support ``silences`` (experiment_id, start, end).  ``payload``: state columns that only
    matched rows may have; ``kinds``: column -> type of the fused table; ``forbidden``: regular expressions of names that no table may have; ``more``: further
    checks, each a DataFrame whose rows are violations.  One pass over the fused rows, one join with machine rows, and joins with few rows.
    """
    spark = fused.sparkSession
    keys = ["experiment_id", "station_id"]
    state = [c for c in (*STATE_COLUMNS, *payload) if c in fused.columns]
    none = F.lit(True)
    for c in state:
        none = none & F.col(c).isNull()
    matched = F.coalesce(F.col("join_matched"), F.lit(False))
    later = F.coalesce(F.col("plc_timestamp_epoch_ms") > F.col(ts), F.lit(False))
    rules = {
        **{n: r for n, r in fused_rules(ts).items()},
        "matched_names_an_operation": matched == F.col("operation_row_id").isNotNull(),
        "unmatched_age_is_null": matched | F.col("state_age_seconds").isNull(),
        "matched_age_is_not_negative": ~matched | F.coalesce(F.col("state_age_seconds") >= 0, F.lit(False)),
        "matched_operation_is_not_later": ~(matched & later),
        "outside_sessions_is_unmatched": F.col("session_id").isNotNull() | ~matched,
        "outside_sessions_has_no_state": F.col("session_id").isNotNull() | none,
        "matched_flag_is_known": F.col("join_matched").isNotNull() & F.col("join_ambiguous").isNotNull(),
    }
    # one machine row at most for a reading, of its own experiment, station and session
    op = operation.select(F.col(identity).alias("operation_row_id"), *[F.col(c).alias(f"__{c}") for c in (*keys, "session_id")], F.col(ts).alias("__ts"))
    met = fused.where(matched).join(op, "operation_row_id", "left")
    own = {f"operation_of_same_{n}": F.col(c).eqNullSafe(F.col(f"__{c}")) for n, c in (("experiment", "experiment_id"), ("station", "station_id"), ("session", "session_id"))}
    own |= {"operation_exists": F.col("__ts").isNotNull(), "operation_time_is_its_own": F.col("__ts") == F.col("plc_timestamp_epoch_ms")}
    # readings against session intervals and silences, which are few rows
    held = fused.where(matched).join(intervals.select(*keys, "session_id", F.col("first_ms").alias("__a"), F.col("last_ms").alias("__b")), [*keys, "session_id"], "left")
    quiet = fused.join(F.broadcast(gaps.select(*keys, F.col("start").alias("__a"), F.col("end").alias("__b"))), keys).where((F.col(ts) > F.col("__a")) & (F.col(ts) < F.col("__b")))
    inner = operation.join(F.broadcast(gaps.select(*keys, F.col("start").alias("__a"), F.col("end").alias("__b"))), keys).where((F.col(ts) > F.col("__a")) & (F.col(ts) < F.col("__b")))
    ends = gaps.select(*keys, F.explode(F.array("start", "end")).alias(ts)).join(operation.select(*keys, ts).distinct(), [*keys, ts], "left_anti")
    idle = silences.join(gaps.select("experiment_id", F.col("start").alias("__a"), F.col("end").alias("__b")), "experiment_id").where((F.col("__a") <= F.col("start")) & (F.col("__b") >= F.col("end")))
    left = {
        "readings_are_unique": fused.groupBy(identity).agg(F.count("*").alias("n")).where("n > 1"),
        "every_reading_is_fused": power.select(identity).join(fused.select(identity), identity, "left_anti"),
        "every_fused_row_is_a_reading": fused.select(identity).join(power.select(identity), identity, "left_anti"),
        "operations_are_unique": operation.groupBy(identity).agg(F.count("*").alias("n")).where("n > 1"),
        "every_operation_has_a_session": operation.where(F.col("session_id").isNull()),
        "intervals_are_ordered": intervals.where(F.col("first_ms") > F.col("last_ms")),
        "matched_readings_lie_in_their_interval": held.where(F.col("__a").isNull() | (F.col(ts) < F.col("__a")) | (F.col(ts) > F.col("__b"))),
        "silences_have_support": silences.join(idle.select("experiment_id", "start", "end").distinct(), ["experiment_id", "start", "end"], "left_anti"),
        "silent_gaps_end_at_operations": ends,
        "silent_gaps_hold_no_operation": inner,
        "readings_in_silent_gaps_have_no_session": quiet.where(F.col("session_id").isNotNull()),
        "readings_in_silent_gaps_have_no_state": quiet.where(matched | ~none),
        **(more or {}),
    }
    types = dict(fused.dtypes)
    fixed = {f"type_of_{c}": int(types.get(c) != k) for c, k in (kinds or {}).items()}
    for pattern in forbidden:
        fixed[f"no_column_like_{pattern}"] = sum(bool(re.search(pattern, c)) for t in (fused, power, operation) for c in t.columns)
    out = violations(fused, rules).unionByName(violations(met, own))
    for name, bad in left.items():
        out = out.unionByName(bad.agg(F.lit(name).alias("invariant"), F.count("*").alias("violations")).select("invariant", "violations"))
    if fixed:
        out = out.unionByName(spark.createDataFrame(list(fixed.items()), "invariant string, violations long"))
    return out.select(F.col("invariant").alias("check"), "violations")


def snapshot_checks(selection: DataFrame, canonical: DataFrame, comparison: DataFrame | None = None) -> dict[str, DataFrame]:
    """Violations, as rows, of the choice of snapshots: pairs without the newer one, rows that don't name the older one, pairs that differ."""
    paired = selection.where(F.col("ordinary_counterpart").isNotNull())
    out = {
        "newer_snapshot_is_chosen": paired.where(~F.col("canonical_source_file").endswith("_new.sql")),
        "older_snapshot_is_named": canonical.join(F.broadcast(paired.select("canonical_source_file")), "canonical_source_file", "left_semi").where(F.col("ordinary_counterpart").isNull()),  # a row a dump
    }
    if comparison is not None:
        out["snapshot_pairs_agree"] = comparison.where((F.col("only_in_left") > 0) | (F.col("only_in_right") > 0))
    return out


def orphan_sessions(points: DataFrame, session_intervals: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Points that claim a session and lie outside its interval."""
    return points.join(session_intervals, [*keys, "session_id"], "left").where(F.col("session_id").isNotNull() & (F.col("first_ms").isNull() | (F.col(ts) < F.col("first_ms")) | (F.col(ts) > F.col("last_ms"))))
