"""What the operators share: the folder for intermediate tables, and column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Deletes what this driver has written to the shared folder; results that still read it are lost."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where neither that setting nor a checkpoint folder is set, and Spark runs inside one
    machine, a temporary folder is made and set (as in tests); it goes with the driver."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        return found.get().rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="matchloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def bounded_batches(df: DataFrame, rows: int = 1000) -> None:
    """Has Spark hand Python at most so many rows at once: with whole texts, its 10,000 would take much memory
    on either side. The session's setting is lowered, never raised."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a query are deleted when the query ends, not when the driver's collector
    next finds them unused. The session's setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str, compression: str = "snappy", options: dict | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{label}"
    _written.append(path.rsplit("/", 1)[0])
    with shuffles_dropped(spark):
        df.write.options(compression=compression, **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text"):
    """The text as it is, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def own_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list:
    """df's columns, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of a written table whose count `n` reaches a bound, at most `most` of them.

    The bound comes from a histogram of the counts, a few hundred rows whatever the table's size; a sorted
    limit would send `most` rows from every task to the driver."""
    level = F.floor(8 * F.log2(n)).cast("int")
    sizes, held, least = counts.groupBy(level.alias("k")).count().collect(), 0, None
    for r in sorted(sizes, key=lambda r: -r["k"]):
        held += r["count"]
        if held > most:
            break
        least = r["k"]
    return counts.where(level >= least) if least is not None else counts.limit(0)
