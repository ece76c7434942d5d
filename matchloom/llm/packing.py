"""Packing by power-of-two decomposition: binary-length pieces, equal lengths in one bucket."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokenizing
from .shared import bounded_batches, sql_type

#: A sequence's id: the logarithm of its length above, then the map task, then the task's own count.
LENGTH_SHIFT, TASK_SHIFT = 58, 34


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as full sequences and then the powers of two of what is left, largest first."""
    out, rest = [longest] * (n // longest), n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def write_buckets(pieces: DataFrame, path: str) -> None:
    """pack_power_of_two's pieces as Parquet, a folder bucket=<n> for each length 2^n: a batch of one length is read
    from one folder. Each task writes a file for each length that it has; there is no shuffle."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def pack_power_of_two(
    docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache: int = tokenizing.CACHE
) -> DataFrame:
    """One row for each piece of each document's ids (with end_id last): the piece is its own sequence.

    Columns: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (base-2
    logarithm of the length), sequence_id, offset (always 0). As every length is a power of two at most
    `longest`, no sequence needs padding and none holds two documents; sequences of one length have
    adjacent ids, and write_buckets puts them together. There is no shuffle. A null or empty text is the end id
    alone; repeated rows, and rows with a null id, are packed like any other; an empty table gives no rows; other
    columns are not read."""
    bounded_batches(docs)
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizing.load(tokenizer))
    end = end_id.to_bytes(4, "little")
    names = [id_col, "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]

    def packed(batches):
        own = tokenizing.worker_encoder(shared.value, cache)
        task, made = TaskContext.get().partitionId() << TASK_SHIFT, 0

        def rows(ids, at, start, length, parts, total):
            nonlocal made
            bucket = [n.bit_length() - 1 for n in length]
            seq = [(b << LENGTH_SHIFT) | task | (made + i) for i, b in enumerate(bucket)]
            made += len(seq)
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(long(at)), long(start), long(length), pa.array(parts, pa.binary()), long(total), pa.array(bucket, pa.int32()), long(seq), long([0] * len(seq))], names
            )

        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = (own.ids(t) if t else b"") + end
                n, start = len(ids) >> 2, 0
                for length in piece_lengths(n, longest):
                    for column, x in zip(held, (i, start, length, ids[4 * start : 4 * (start + length)], n)):
                        column.append(x)
                    start += length
                size += len(ids)
                if size > 1 << 24:
                    yield rows(batch.column(0), *held)
                    held, size = ([], [], [], [], []), 0
            if held[0]:
                yield rows(batch.column(0), *held)

    schema = f"`{id_col}` {sql_type(docs, id_col)}, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(packed, schema)
