"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .media import media_features, read_archives, write_archives
from .packing import pack
from .piece_codec import encode_digests
from .quality import quality_scores
from .repeats import repeat_digests
from .shards import shard_by_bytes
from .shared import documents, scratch
from .simhash import near_copies
from .token_files import read_tokens, write_tokens
from .toxicity import toxicity_scores
from .va_search import top_k

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    return read_tokens(spark, path, write_tokens(documents(spark, sf_dir), WORDS, path, end_id=2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 24)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


def op6_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    write_archives(documents(spark, sf_dir), path)
    return media_features(read_archives(spark, path))


def op7_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", 5)


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), WORDS)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), PIECES)


QUERIES = {f.__name__: f for f in (op1_run_length_dedup, op2_token_files, op3_toxicity, op4_shards, op5_simhash, op6_media_archive, op7_va_search, op8_site_quality, op9_island_packing, op10_piece_codec)}
ORACLE_SQL: dict[str, str] = {
    "op7_va_search": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
              FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) AS q JOIN v ON q.vec_id <> v.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
