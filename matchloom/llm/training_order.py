"""Training-order materialisation: a keyed Feistel permutation deals sequences to fixed-stride shards."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokenizing
from .shared import bounded_batches, shared_dir, shuffles_dropped, whole_text, written

#: A record: the number of real ids as 4 bytes, the ids as 2 or 4 bytes each, and one line feed.
HEAD, TAIL = 4, 1
#: Documents are packed in buckets: of some so many documents, and at most so many buckets, whose starts are broadcast.
A_BUCKET, BUCKETS = 512, 1 << 16
#: Sequences in a shard, a power of two: with small inputs, and at the most (256 MB of 2,048 ids of 2 bytes).
SMALL_SHARD, LARGE_SHARD, SHARDS = 2048, 65536, 2048


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def stride(length: int, width: int = 2) -> int:
    return HEAD + width * length + TAIL


def shard_size(n: int) -> int:
    """Sequences in a shard for n in all: as few as make some SHARDS shards, within the two bounds."""
    return min(LARGE_SHARD, max(SMALL_SHARD, 1 << (-(-n // SHARDS) - 1).bit_length()))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1: balanced rounds over the next power of four, walked until back below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(1 << 63, size=rounds, dtype=np.uint64)

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(40)) & mask) if half <= 24 else left ^ ((f >> (np.uint64(64) - half)) & mask)
        return (left << half) | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, mark, id, text): the bucket of each row and its mark, after which and the id a bucket is ordered.

    Both come from hashes of the id and the text, so they are the same however the rows are split; rows that
    have them alike hold the same text under the same id, and their order makes no difference."""
    mark = F.xxhash64(F.col(id_col).cast("string"), whole_text(text_col))
    many = min(BUCKETS, max(1, docs.count() // A_BUCKET))
    return docs.select(F.pmod(mark, F.lit(many)).cast("int").alias("bucket"), mark.alias("mark"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))


def sequences(
    docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache: int = tokenizing.CACHE
) -> DataFrame:
    """(bucket, place, n_ids, packed): each bucket's documents, an end id after each, cut every `length` ids.

    Only a bucket's last sequence is filled up, with end ids. packed is the zstd frame of the ids as unsigned 16-bit
    numbers, or 32-bit ones where the tokenizer has more than 65,536; so they are shuffled, too. Texts are not."""
    bounded_batches(docs)
    model = tokenizing.load(tokenizer)
    width = tokenizing.id_bytes(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = {2: np.uint16, 4: np.uint32}[width]
    end, size = kind(end_id).tobytes(), width * length

    def encoded(batches):
        codec, own = _codec(), tokenizing.worker_encoder(shared.value, cache)
        for batch in batches:
            counts, parts = [], []
            for t in batch.column(3).cast(pa.binary()).to_pylist():
                ids = (np.frombuffer(own.ids(t), np.uint32) if t else np.empty(0, np.uint32)).astype(kind).tobytes() + end
                counts.append(len(ids) // width)
                parts.append(codec.compress(ids, asbytes=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(parts, pa.binary())], ["bucket", "mark", "id", "n", "packed"])

    def made(batches):
        codec, now, place, held, waiting = _codec(), None, 0, [], 0

        def rows(last: bool):
            """The whole sequences of what is held, and the rest filled up if it is the bucket's last."""
            nonlocal place, held, waiting
            whole = b"".join(held)
            cut = len(whole) - len(whole) % size
            parts, counts = [whole[i : i + size] for i in range(0, cut, size)], [length] * (cut // size)
            held, waiting = [whole[cut:]], len(whole) - cut
            if last and waiting:
                parts.append(held[0] + end * ((size - waiting) // width))
                counts.append(waiting // width)
            n = len(parts)
            place += n
            return pa.RecordBatch.from_arrays(
                [pa.array([now] * n, pa.int32()), pa.array(range(place - n, place), pa.int64()), pa.array(counts, pa.int32()), pa.array([codec.compress(x, asbytes=True) for x in parts], pa.binary())],
                ["bucket", "place", "n_ids", "packed"],
            )

        for batch in batches:
            for bucket, n, x in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4))):
                if bucket != now:
                    if now is not None:
                        yield rows(True)
                    now, place, held, waiting = bucket, 0, [], 0
                held.append(codec.decompress(x, n * width, asbytes=True))
                waiting += n * width
                if waiting >= 1 << 23:
                    yield rows(False)
        if now is not None:
            yield rows(True)

    found = placed(docs, id_col, text_col).mapInArrow(encoded, "bucket int, mark long, id string, n long, packed binary")
    found = found.repartition("bucket").sortWithinPartitions("bucket", "id", "mark")
    return found.mapInArrow(made, "bucket int, place long, n_ids int, packed binary")


def materialise(made: DataFrame, path: str, key: int = 17, length: int = 2048, a_shard: int | None = None, width: int = 2) -> int:
    """Writes (bucket, place, n_ids, packed) as shards under path and returns the number of sequences.

    A sequence's index counts buckets and places in order; its slot is the index permuted. Shard s holds the
    slots from s * a_shard on (by default shard_size of their number) as records of one stride, so slot i begins at
    byte (i % a_shard) * stride of file part-<i // a_shard>. Spark's own writer commits the files, so a lost task
    leaves no half shard. An empty input writes no shard."""
    # One row for each bucket, of which there are BUCKETS at most.
    per_bucket = made.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    before = F.sum("n").over(Window.partitionBy("one").orderBy("bucket")) - F.col("n")
    starts = written(per_bucket.select("bucket", "n", before.alias("before")), "starts")
    n = starts.agg(F.sum("n")).first()[0]
    if not n:
        return 0
    a_shard = a_shard or shard_size(n)

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    slots = made.join(F.broadcast(starts.drop("n")), "bucket").select(slot_of(F.col("before") + F.col("place")).alias("slot"), "n_ids", "packed")
    slots = slots.withColumn("shard", F.expr(f"cast(slot div {a_shard} as int)"))
    dealt = slots.repartitionById(-(-n // a_shard), "shard").sortWithinPartitions("slot")

    def records(batches):
        codec = _codec()
        for batch in batches:
            heads = (int(x).to_bytes(HEAD, "little") for x in batch.column(0).to_pylist())
            rows = [h + codec.decompress(x, width * length, asbytes=True) for h, x in zip(heads, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    whole = dealt.select("n_ids", "packed").mapInArrow(records, "record binary")
    with shuffles_dropped(made.sparkSession):
        whole.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    return n


def read_records(spark: SparkSession, path: str, length: int = 2048, a_shard: int = SMALL_SHARD, first_slot: int = 0, width: int = 2) -> DataFrame:
    """(slot, shard, byte_offset, n_ids, ids, ids_crc32) from first_slot on; shards before it are not opened."""
    size = stride(length, width)

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = int(re.search(r"part-(\d+)", name)[1])
                skip = max(0, first_slot - shard * a_shard)
                offsets = list(range(skip * size, len(content), size))
                parts = [content[o + HEAD : o + HEAD + width * int.from_bytes(content[o : o + HEAD], "little")] for o in offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard * a_shard + o // size for o in offsets], pa.int64()), pa.array([shard] * len(parts), pa.int32()), pa.array(offsets, pa.int64()),
                     pa.array([len(p) // width for p in parts], pa.int32()), pa.array(parts, pa.binary()), pa.array([zlib.crc32(p) for p in parts], pa.int64())],
                    ["slot", "shard", "byte_offset", "n_ids", "ids", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    if first_slot:
        files = files.where(F.regexp_extract("path", r"part-(\d+)", 1).cast("int") >= first_slot // a_shard)
    return files.mapInArrow(parse, "slot long, shard int, byte_offset long, n_ids int, ids binary, ids_crc32 long")


def _is_done(spark: SparkSession, path: str) -> bool:
    """Whether Spark's writer has finished that folder."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def write_training_order(
    docs: DataFrame, path: str | None = None, key: int = 17, length: int = 2048, a_shard: int | None = None, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The records of all documents in training order, read back from the shards that were written.

    Null and empty texts are an end id alone; repeated rows are written each, and so are rows with a null id; an
    empty table writes nothing and gives no rows; other columns are not read. The same rows and key give the same
    shards, however the rows are split and whatever the cluster is.

    path: a folder that driver and executors share, by default one in the shared folder. The sequences are
    written beside it, to <path>-sequences, and then permuted into shards: a run that was stopped goes on with what
    is finished when it is called again with the same path and arguments."""
    spark = docs.sparkSession
    path = (path or f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/shards").rstrip("/")
    width = tokenizing.id_bytes(tokenizing.load(tokenizer))
    if not _is_done(spark, f"{path}-sequences"):
        made = sequences(docs, tokenizer, length, end_id, id_col, text_col)
        with shuffles_dropped(spark):
            made.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}-sequences")
    made = spark.read.schema("bucket int, place long, n_ids int, packed binary").parquet(f"{path}-sequences")
    n = made.count()
    if n and not _is_done(spark, path):
        materialise(made, path, key, length, a_shard, width)
    if not n:
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, n_ids int, ids binary, ids_crc32 long")
    return read_records(spark, path, length, a_shard or shard_size(n), 0, width)
