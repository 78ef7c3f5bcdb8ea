"""The corpus pipeline: five stages over ``documents``, each a training-data operator whose decisions take effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents`` and leave other
columns.  Null and empty texts have scores like others (their features are 0), equal each other as near copies, lose no repeats and
are packed as the end id alone; rows with equal doc_id stay separate rows, and rows without one are never near copies of others;
an empty table gives no rows; long texts are worked on whole, in parts where memory asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.packing import pack
from millrace.llm.quality import with_quality
from millrace.llm.queries import WORDS
from millrace.llm.repeats import cut_repeats
from millrace.llm.shared import documents, materialize
from millrace.llm.similar import near_texts
from millrace.llm.toxicity import fit, training_split, with_score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7."""
    docs = docs.select(*COLUMNS)
    return with_score(docs, fit(docs, _labels(spark, sf_dir), training_split()), "__score").where("__score < 0.7").drop("__score")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, given their site, is at least even."""
    docs = docs.select(*COLUMNS)
    scored = with_quality(docs, _labels(spark, sf_dir), F.col("source"), F.col("lang"))
    return scored.where("quality_score >= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of a five-word similarity of 0.8 or more join: that with the smallest doc_id, then text hash, then other columns.

    Rows are decided one by one: of a doc_id with several texts, those that are no copies stay; of equal rows of one doc_id and text one stays.
    Documents without an id stay.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.where("doc_id is not null").withColumn("node", F.xxhash64("text"))
    gone = materialize(near_texts(docs).where("doc_id <> first.doc_id or node <> first.node").select("doc_id", "node"), "gone")
    kept = keyed.join(_small(gone), ["doc_id", "node"], "left_anti")
    again = materialize(keyed.groupBy("doc_id", "node").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "node"), "again")  # equal rows
    once = kept.join(_small(again), ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", "r.*")
    single = kept.join(_small(again), ["doc_id", "node"], "left_anti")
    return single.select(*COLUMNS).unionByName(once.select(*COLUMNS)).unionByName(docs.where("doc_id is null"))


def _small(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """To all executors if there are at most ``most`` (16 bytes each); else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most else keys


def cut_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id has are cut from texts; every document stays."""
    return cut_repeats(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 4096 tokens."""
    return pack(docs, WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("long_repeats", cut_long_repeats),
    ("packing", pack_sequences),
]

#: Trees, tokenizers and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
