"""Machine states by ordered rules, compiled to one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of the bits in a state vector.
BITS = ("Busy", "RFIDTagPresent", "Done", "StationEntryxBG5", "ReadyAtStationxBG1", "StationExitxBG6")
#: Fixed values, first match wins: (bits that are set, bits that are clear, state).
GENERIC = (
    (("Busy",), (), "processing"),
    (("RFIDTagPresent", "ReadyAtStationxBG1"), (), "waiting_carrier_ready"),
    (("RFIDTagPresent",), ("ReadyAtStationxBG1",), "waiting_carrier"),
    (("StationEntryxBG5", "StationExitxBG6"), ("RFIDTagPresent",), "transfer"),
    (("StationEntryxBG5",), ("RFIDTagPresent",), "entering"),
    (("StationExitxBG6",), ("RFIDTagPresent",), "exiting"),
    (("Done",), ("RFIDTagPresent",), "idle_ready"),
)
#: Rules of single stations, in place of the generic ones.
STATION_RULES = {
    50: (
        (("Busy",), (), "processing"),
        (("RFIDTagPresent", "Done"), ("Busy",), "waiting_carrier"),
        (("Done",), ("Busy", "RFIDTagPresent"), "idle_ready"),
    )
}
#: Whole vectors of a station that come before any rule.
OVERRIDES = {70: (("001001", "idle_ready"),)}
UNKNOWN = "unknown"
#: Merged classes; other states (mixed, unknown) have none.
MERGED = {
    "idle_ready": "idle_ready", "processing": "processing", "waiting_carrier": "waiting_carrier", "waiting_carrier_ready": "waiting_carrier",
    "entering": "transfer_transient", "exiting": "transfer_transient", "transfer": "transfer_transient",
}
#: Class numbers.
CLASS_NUMBER = {"idle_ready": 0, "waiting_carrier": 1, "transfer_transient": 2, "processing": 3}


def _rules(bits: dict[str, Column], rules: tuple, otherwise: str = UNKNOWN) -> Column:
    out = None
    for set_bits, clear_bits, state in rules:
        test = F.lit(True)
        for c in set_bits:
            test = test & bits[c]
        for c in clear_bits:
            test = test & ~bits[c]
        out = F.when(test, state) if out is None else out.when(test, state)
    return out.otherwise(otherwise)


def classify(station: Column, bits: list[Column]) -> Column:
    """State of a row; a null bit is clear.  A station's overrides come first, then its own rules or the generic ones."""
    clear = [F.coalesce(b.cast("boolean"), F.lit(False)) for b in bits]
    named = dict(zip(BITS, clear))
    vector = F.concat(*[F.when(b, "1").otherwise("0") for b in clear])
    out = _rules(named, GENERIC)
    for s, rules in STATION_RULES.items():
        out = F.when(station == s, _rules(named, rules)).otherwise(out)
    for s, whole in OVERRIDES.items():
        for text, state in whole:
            out = F.when((station == s) & (vector == text), state).otherwise(out)
    return out


def classify_vector(station: Column, vector: Column) -> Column:
    return classify(station, [F.substring(vector, k + 1, 1) == "1" for k in range(len(BITS))])


def merged_class(state: Column) -> Column:
    """The merged class, null for states that have none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in MERGED.items() for x in pair]), state)


def class_number(merged: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CLASS_NUMBER.items() for x in pair]), merged)


#: What may follow a state in the expected work cycle, besides itself.
FOLLOWS = {
    "processing": ("waiting_carrier_ready",),
    "waiting_carrier_ready": ("processing", "idle_ready"),
    "idle_ready": ("entering", "exiting", "transfer", "processing", "waiting_carrier", "waiting_carrier_ready"),
}


def cycle_check(changes: DataFrame, station: str = "station_id", before: str = "prev_vec", after: str = "vec") -> DataFrame:
    """Adds prev_state, curr_state and whether the change is part of the expected cycle; vectors are texts of six bits."""
    prev, curr = F.col("prev_state"), F.col("curr_state")
    expected = prev == curr
    for state, after_it in FOLLOWS.items():
        expected = expected | ((prev == state) & curr.isin(*after_it))
    named = changes.withColumns({"prev_state": classify_vector(F.col(station), F.col(before)), "curr_state": classify_vector(F.col(station), F.col(after))})
    return named.withColumn("in_expected_cycle", expected)


def majority(rows: DataFrame, window: list[str], state: str = "plc_state", purity: float = 0.8, least_known: float = 0.5) -> DataFrame:
    """Each window's commonest state (ties: first by name), its share, the share of known states, and the label these give."""
    counts = rows.groupBy(*window, state).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*window)
    share = counts.withColumns({"total": F.sum("n").over(group), "known": F.coalesce(F.sum(F.when(F.col(state) != UNKNOWN, F.col("n"))).over(group), F.lit(0)), "rn": F.row_number().over(group.orderBy(F.desc("n"), state))})
    top = share.where("rn = 1").withColumns({"purity": F.col("n") / F.col("total"), "known_fraction": F.col("known") / F.col("total")})
    label = F.when(F.col("known_fraction") < least_known, UNKNOWN).when(F.col(state) == UNKNOWN, UNKNOWN).when(F.col("purity") >= purity, F.col(state)).otherwise("mixed")
    return top.select(*window, state, "n", "total", "purity", "known_fraction", label.alias("inferred_state"))


def coverage(rows: DataFrame, station: str = "station_id", state: str = "plc_state", watts: str = "ActivePowerL1") -> DataFrame:
    return rows.where(F.col(station).isNotNull() & F.col(state).isNotNull()).groupBy(station, state).agg(F.count("*").alias("n"), F.bround(F.avg(watts), 2).alias("avg_watts"))
