"""Writing tables, lists, reports and models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaced as a whole, compressed with zstd."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Header, tabs, nothing for an empty value. A value that holds a tab, a quote or a line break stands in
    quotes, with its own quotes doubled; lists of ids have none. one_file only for lists that one task can write."""
    out = df.coalesce(1) if one_file else df
    writer = out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "")
    # Blanks at either end are part of a value.
    writer.option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A small document, wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps(document, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def save_model(model: PipelineModel, path: str) -> None:
    """B9."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
