"""Snapshots into canonical rows: full-row identity, lineage, conflicts, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_id, extract, row_digest, strip


def identified(rows: DataFrame, values: list[str], experiment: Column, table: Column) -> DataFrame:
    return rows.withColumn("canonical_row_id", canonical_id(experiment, table, row_digest([F.col(v) for v in values])))


def occurrences(rows: DataFrame, file: str = "source_file", line: str = "line_no") -> DataFrame:
    """Every row with status kept (the first of its id by file, then line) or duplicate_occurrence."""
    order = Window.partitionBy("canonical_row_id").orderBy(file, line)
    return rows.withColumn("status", F.when(F.row_number().over(order) == 1, "kept").otherwise("duplicate_occurrence"))


def canonical_rows(rows: DataFrame, keep: list[str], file: str = "source_file", line: str = "line_no") -> DataFrame:
    """One row an id, with the first occurrence's place, all source files, and how often it occurs.

    A partial aggregate: repeats are folded before the shuffle, so a row that fills a third of the input is no hot task.
    """
    first = F.min_by(F.struct(*keep, F.col(file).alias("canonical_source_file"), F.col(line).alias("canonical_source_line_number")), F.struct(file, line))
    folded = rows.groupBy("canonical_row_id").agg(first.alias("f"), F.array_sort(F.collect_set(file)).alias("lineage_source_files"), F.count("*").alias("source_occurrence_count"))
    return folded.select("canonical_row_id", "f.*", "lineage_source_files", "source_occurrence_count")


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows read, distinct rows, and their difference."""
    out = rows.groupBy(*by).agg(F.count("*").alias("original_rows"), F.count_distinct("canonical_row_id").alias("canonical_rows"))
    return out.withColumn("duplicates_removed", F.col("original_rows") - F.col("canonical_rows"))


def conflicts(canonical: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which more than one distinct row stands; null keys are a group too.  Rows are reported, never dropped."""
    found = canonical.groupBy(*keys).agg(F.count("*").alias("row_variants"), F.array_sort(F.collect_list("canonical_row_id")).alias("row_ids"))
    return found.where("row_variants > 1")


def multiset_difference(left: DataFrame, right: DataFrame, by: list[str], identity: str = "canonical_row_id") -> DataFrame:
    """Per group: rows only in either side, as multisets; equal contents can differ in schema name only."""
    both = left.select(*by, identity, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*by, identity, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = both.groupBy(*by, identity).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    out = each.groupBy(*by).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("only_in_left"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("only_in_right"))
    return out.withColumn("difference_class", F.when((F.col("only_in_left") == 0) & (F.col("only_in_right") == 0), "schema_name_only").otherwise("content_or_schema_difference"))


def snapshot_overlap(rows: DataFrame, by: list[str], file: str = "source_file", identity: str = "canonical_row_id", ts: str = "ts_ms") -> DataFrame:
    """For each pair of files of a group: rows of each, shared rows, overlap in time, and whether the right one spans the left.

    Pairs are of files, which are few; shared rows are counted from each id's set of files.
    """
    spans = rows.groupBy(*by, file).agg(F.count_distinct(identity).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    a = spans.select(*by, *[F.col(c).alias(f"left_{c}") for c in (file, "rows", "first", "last")])
    b = spans.select(*by, *[F.col(c).alias(f"right_{c}") for c in (file, "rows", "first", "last")])
    pairs = a.join(b, by).where(F.col(f"left_{file}") < F.col(f"right_{file}"))
    files = rows.groupBy(*by, identity).agg(F.array_sort(F.collect_set(file)).alias("fs")).where("size(fs) > 1")
    shared = files.select(*by, F.explode("fs").alias(f"left_{file}"), "fs").select("*", F.explode("fs").alias(f"right_{file}")).where(F.col(f"left_{file}") < F.col(f"right_{file}"))
    shared = shared.groupBy(*by, f"left_{file}", f"right_{file}").agg(F.count("*").alias("shared_rows"))
    out = pairs.join(shared, [*by, f"left_{file}", f"right_{file}"], "left")
    return out.select(
        *by, f"left_{file}", f"right_{file}", "left_rows", "right_rows", F.coalesce("shared_rows", F.lit(0)).cast("long").alias("shared_rows"),
        F.greatest(F.lit(0), F.least("left_last", "right_last") - F.greatest("left_first", "right_first")).cast("long").alias("overlap_ms"),
        ((F.col("right_first") <= F.col("left_first")) & (F.col("right_last") >= F.col("left_last"))).alias("right_is_temporal_superset"),
    )


#: Stations, their energy and machine prefixes, and names.
STATIONS = (
    (10, "ene1", "mes10", "Manual"), (20, "ene2", "mes20", "MagazineFront"), (30, "ene3", "mes30", "DrillingCPS"), (40, "ene4", "mes40", "Bridge"),
    (50, "ene5", "mes50", "RobotAssembly"), (60, "ene6", "mes60", "CameraInspection"), (70, "ene7", "mes70", "MagazineBack"), (80, "ene8", "mes80", "Press"),
)


def normalised_resource(resource: Column) -> dict[str, Column]:
    """Trimmed name, energy and machine prefixes, and the station either gives (energy first)."""
    name = strip(resource)
    energy, machine = extract(name, r"^(ene[1-8])(?:_|:|$)"), extract(name, r"^(mes(?:10|20|30|40|50|60|70|80))(?:_|:|$)")
    lookup = F.create_map(*[F.lit(x) for s, e, m, _ in STATIONS for x in (e, s, m, s)])
    return {"resource_id_normalized": name, "energy_resource_id": energy, "mes_resource_id": machine, "station_id": F.coalesce(F.element_at(lookup, energy), F.element_at(lookup, machine))}
