"""Keys of record files as they arrive: the batch operators on a stream that works off what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys
from ..sources import tables


def stream_records(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Tab-separated record files of a folder as a stream; the number of files a trigger bounds a batch."""
    reader = spark.readStream.schema(tables.strings(tables.RECORD)).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
    return reader.option("maxFilesPerTrigger", files_a_trigger).csv(folder).na.fill("").withColumn("source", F.substring("entity_id", 1, 2))


def write_keys(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_trigger: int = 100) -> None:
    """Adds the keys of all files not yet seen to the table at out; a run that fails goes on where it stopped."""
    made = keys.keys_builder(keys.key_features(stream_records(spark, folder, files_a_trigger)))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
