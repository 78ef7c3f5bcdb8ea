"""Scalar expressions with the null, rounding and casting rules that the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits) if digits else F.rint(c)


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a zoneless timestamp, read as UTC whatever the session's zone."""
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")
    return day * 86_400_000 + F.hour(c).cast("long") * 3_600_000 + F.minute(c).cast("long") * 60_000 + second


def iso_of_ms(ms: Column) -> Column:
    """ISO text of epoch milliseconds, in UTC when the session is."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def session_label(experiment: Column, station: Column, number: Column) -> Column:
    return F.format_string("%s-S%02d-%03d", experiment, station.cast("int"), number.cast("int"))


def segment_label(config: str, experiment: Column, station: Column, session: Column, number: Column) -> Column:
    return F.format_string(f"{config}:%s:S%02d:%s:%06d", experiment, station.cast("int"), session, number.cast("int"))


def row_digest(parts: list[Column]) -> Column:
    """SHA-256 of values, told apart from each other and from null; numbers by their text, so 0.0 and -0.0 differ."""
    marked = [F.when(p.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat(*marked), 256)


def canonical_id(experiment: Column, table: Column, digest: Column) -> Column:
    return F.sha2(F.concat(experiment, F.lit("\0"), table, F.lit("\0"), digest), 256)


TEN_QUANTILES = (0.0, 0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)
QUANTILE_NAMES = ("min", "p01", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "max")


def quantiles(c: str | Column, prefix: str = "", digits: int | None = None) -> list[Column]:
    """Ten exact, interpolated quantiles as columns, of one buffer of values; null over no values."""
    all_ten = F.percentile(c, F.array(*[F.lit(q) for q in TEN_QUANTILES]))
    found = [F.element_at(all_ten, k + 1) for k in range(len(TEN_QUANTILES))]
    return [(f if digits is None else F.round(f, digits)).alias(prefix + n) for f, n in zip(found, QUANTILE_NAMES)]
