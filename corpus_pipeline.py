"""From raw documents to packed sequences: five stages, each an operator of matchloom.llm.

Each stage works on all that the one before kept; its result is written as Parquet and read again. Every stage
takes an empty table, columns of any names, repeated rows and nulls in any column; what becomes of such rows is said
at each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from matchloom.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labels teach go, and null, empty and letterless texts with them.
    Rows with a null id are decided by their text like any other, repeated rows alike."""
    return language_id.keep_identified(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, of these the one with the smallest id (a null id last);
    null counts as empty, and of fully equal rows one stays."""
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id. Texts without words and
    rows with a null id are in no group and stay; rows with one id stay or go together."""
    return near_dedup.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, languages and topics are sampled to tempered shares. Nulls among them form a value of their own;
    texts without words go; rows with one id, or with none, are decided alike within their cell."""
    return mixing.mixed_sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in pieces of power-of-two lengths; a null or empty text is one piece, the end id.

    The workers' caches are smaller than op1's, as they stay in memory beside what the other stages need."""
    return packing.pack_power_of_two(docs, cache=100_000)


STAGES = [("language", language), ("copies", copies), ("near_copies", near_copies), ("mixture", mixture), ("packed", packed)]

#: Token ids and MinHash have no form in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
