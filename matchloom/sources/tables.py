"""Reading sources: tab-separated records as strings, Parquet, ids and samples."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens

RECORD = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, keep_nulls: bool = False, multi_line: bool = False) -> DataFrame:
    """Every column a string, quotes doubled; missing values empty unless keep_nulls.

    A file is split among tasks, which stand in for chunks, and a later select prunes the columns that are read.
    multi_line: values may hold line breaks; a file is then read by one task."""
    reader = spark.read.schema(strings(columns or RECORD)).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    df = reader.csv(path)
    return df if keep_nulls else df.na.fill("")


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Source records with their source, which the id's prefix names."""
    return read_tsv(spark, path, multi_line=multi_line).withColumn("source", F.substring("entity_id", 1, 2))


def head(df: DataFrame, n: int, by: str = "entity_id") -> DataFrame:
    """A4: the first n rows in the order of a column."""
    return df.orderBy(by).limit(n)


def count_lines(spark: SparkSession, path: str) -> int:
    """A5: physical lines without the headers. Where path is a folder, each file that isn't empty has one, as Spark's
    writer leaves it."""
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count("*") - 1).alias("n"))
    return files.agg(F.sum("n")).first()[0] or 0


def read_ids(df: DataFrame, column: str = "entity_id") -> DataFrame:
    """A6."""
    return df.select(column)


def read_parquet(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """With a view for SQL where a name is given."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def find_file(folder: str, *names: str, variable: str | None = None, fallback: str | None = None) -> str:
    """The first that exists in the folder (or the one that an environment variable names) or the fallback folder, else the first name."""
    places = [os.environ[variable]] if variable and os.environ.get(variable) else [folder]
    places += [fallback] if fallback else []
    options = [os.path.join(p, n) for p in places for n in names]
    return next((o for o in options if os.path.exists(o)), options[0])


def truth_lists(df: DataFrame) -> DataFrame:
    """Truth rows with an array of trimmed, non-blank ids."""
    return df.select("source1_entity_id", tokens.id_list(F.col("matched_entity_ids")).alias("ids"))


def truth_pairs(df: DataFrame) -> DataFrame:
    """A row for each true pair, with the target source."""
    long = truth_lists(df).select("source1_entity_id", F.explode("ids").alias("matched_entity_id"))
    return long.withColumn("target_source", tokens.source_tag(F.col("matched_entity_id")))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made and written first if it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def schema_differences(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Missing and extra columns."""
    return {"missing": sorted(set(expected) - set(df.columns)), "extra": sorted(set(df.columns) - set(expected))}
