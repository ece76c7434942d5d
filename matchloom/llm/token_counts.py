"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then worker caches."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing
from .shared import bounded_batches, sql_type, whole_text

#: Bytes of sampled texts that the fast tier is chosen from, at most.
_SAMPLE_BYTES = 1 << 26


def frequent_pretokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", entries: int = 1 << 16, sample: int = 4000) -> dict[bytes, int]:
    """The frequent pre-tokens of about `sample` whole texts, which a hash of id and text picks, and their numbers of tokens.

    The picked texts go to one task, which stops when it has seen _SAMPLE_BYTES of them, and at most `entries`
    pre-tokens of at most 64 bytes come back in one row. This decides only which pre-tokens the first tier
    holds, so how fast it is; no result depends on it, and no pre-token is shuffled."""
    if not tokenizing.is_known(model):
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = F.xxhash64(F.lit("frequent"), F.col(id_col).cast("string"), whole_text(text_col))
    chance = min(1.0, sample / max(docs.count(), 1))
    picked = docs.select(key.alias("key"), F.col(text_col).alias("text")).where(F.pmod("key", F.lit(1 << 20)) < chance * (1 << 20)).where(F.octet_length("text") > 0)

    def chosen(batches):
        seen, size = Counter(), 0
        for batch in batches:
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                if size < _SAMPLE_BYTES:
                    size += len(t)
                    seen.update(tokenizing.pretokens(t))
        encoder = tokenizing.ChunkEncoder(shared.value)
        top = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(c) <= tokenizing.LONGEST_KEPT][:entries]
        yield pa.RecordBatch.from_arrays(
            [pa.array([top], pa.list_(pa.binary())), pa.array([[encoder.count(c) for c in top]], pa.list_(pa.int32()))], ["chunks", "lengths"]
        )

    rows = picked.repartition(1).mapInArrow(chosen, "chunks array<binary>, lengths array<int>").collect()
    return {bytes(c): n for r in rows for c, n in zip(r["chunks"], r["lengths"])}


def count_tokens(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", entries: int = 1 << 16, cache: int = tokenizing.CACHE
) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs; tokenizer: path of a tokenizers .json file.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows each give a row;
    an empty table gives none; other columns are not read. The one pass over all texts looks up each pre-token
    in the broadcast hash table, which holds at most `entries` frequent ones of at most 64 bytes each with
    their lengths, then in its worker's cache of at most `cache` more; anything else is encoded when it is met."""
    bounded_batches(docs)
    spark = docs.sparkSession
    model = tokenizing.load(tokenizer)
    # A file whose pre-tokens aren't known here is left to the library as a whole; it then has no tiers.
    table = spark.sparkContext.broadcast((uuid.uuid4().hex, frequent_pretokens(docs, model, id_col, text_col, entries)))
    shared = spark.sparkContext.broadcast(model)

    def counted(batches):
        own = tokenizing.worker_encoder(shared.value, cache, *table.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([own.count(t) for t in texts], pa.int64())],
                [id_col, "n_bytes", "n_tokens"],
            )

    return docs.select(id_col, text_col).mapInArrow(counted, f"`{id_col}` {sql_type(docs, id_col)}, n_bytes long, n_tokens long")
