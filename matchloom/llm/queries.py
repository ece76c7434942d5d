"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, license_oracle, licenses, lm_scoring, mixing, near_dedup, packing, token_counts, topk, training_order


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_power_of_two(_read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def _fold(divisor: int, remainder: int):
    """Ids whose CRC-32, as text, leaves that remainder."""
    return lambda i: F.crc32(i.cast("string").cast("binary")) % divisor == remainder


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_read(spark, sf_dir, "documents"), held_out=_fold(7, 2))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_read(spark, sf_dir, "documents"), held_out=_fold(3, 1))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.write_training_order(_read(spark, sf_dir, "documents")).drop("ids")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_minhash, op3_exact_topk, op4_mixing, op5_lm_scoring, op6_language_id, op7_training_order, op8_exact_dedup, op9_token_counts, op10_license_scan)}
ORACLE_SQL = {"op2_minhash": near_dedup.ORACLE_SQL, "op3_exact_topk": topk.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL, "op10_license_scan": license_oracle.ORACLE_SQL}
