"""LM scoring by context-tree weighting, beside a word unigram base with add-one smoothing."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, most_frequent, sql_type, written
from .tree_model import DEPTH, Known, grams, log10_of_grams

#: Bytes of text, and distinct words or grams, that a task gathers before it counts or hands on.
_CHUNK, _HELD_WORDS, _HELD_GRAMS = 1 << 21, 200_000, 1_500_000


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _padded(texts: list[bytes], depth: int):
    """One buffer with `depth` zero bytes before each text, and where each text begins and ends in it."""
    gap = b"\0" * depth
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + depth)
    return gap + gap.join(texts), ends - lengths, ends


def _text_positions(begins, ends, size: int) -> np.ndarray:
    change = np.zeros(size + 1, np.int8)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1], dtype=np.int8).astype(bool)


def corpus_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, gram, n) of (text, learned): counts of the words, and of the byte grams of depth + 1, over every learned
    text; the grams of the others come with a count of 0.

    A task sums its own share before it hands it on, and hands on early when it holds many."""

    def counted(batches):
        words: Counter[bytes] = Counter()
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting, size = ([], []), 0

        def out_words():
            batch = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])
            words.clear()
            return batch

        def out_grams():
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["word", "gram", "n"])

        def add():
            nonlocal keys, counts, waiting, size
            for held, one in zip(waiting, (0, 1)):
                if held:
                    buffer, begins, ends = _padded(held, depth)
                    found = np.sort(grams(buffer, depth)[_text_positions(begins, ends, len(buffer))])
                    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                    keys, counts = _merged(np.concatenate([keys, found[first]]), np.concatenate([counts, one * np.diff(np.append(first, len(found)))]))
            waiting, size = ([], []), 0

        for batch in batches:
            for t, learned in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                if learned:
                    words.update(t.lower().split())
                waiting[learned].append(t)
                size += len(t)
                if size >= _CHUNK:
                    add()
                    if len(words) > _HELD_WORDS:
                        yield out_words()
                    if len(keys) > _HELD_GRAMS:
                        yield out_grams()
                        keys, counts = keys[:0], counts[:0]
        add()
        yield out_words()
        yield out_grams()

    return texts.mapInArrow(counted, "word binary, gram long, n long")


def score_texts(
    docs: DataFrame, held_out=None, depth: int = DEPTH, entries: int = 1 << 20, frequent: int = 100_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), a row for every row.

    Everything is learned from the rows outside held_out (a column over the id; where it is null the row is
    learned from). Base: A-Z in lower case, words between white space, then one end token; the sum of
    log10((c + 1) / (N + V + 1)). score: log10 probability of the text's bytes under the context tree of all
    learned texts, with every context of up to `depth` bytes; bits_per_byte is its code length. A null or empty
    text has one token, score 0 and 0 bits a byte. Rows with a null id and repeated rows each give a row, an
    empty table none; other columns are not read; with nothing to learn from, the base score is 0 and each byte
    costs 8 bits.

    Broadcast, and only to spare shuffles, are the values of the most frequent grams (at most `entries`, 16 bytes
    each) and the `frequent` words of at most 64 bytes with their counts; grams and words beyond them go
    through joins with the tables of all."""
    bounded_batches(docs)
    spark = docs.sparkSession
    held_out = held_out or (lambda i: F.lit(False))
    kind = sql_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = written(corpus_counts(rows.select("text", ~F.col("held_out")), depth).groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word IS NOT NULL").select("word", F.col("n").alias("c"))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_texts = rows.where(~F.col("held_out")).count()
    total, distinct = sums["n"] + n_texts, sums["v"] + (n_texts > 0)
    values = log10_of_grams(counts.where("gram IS NOT NULL").select("gram", "n"), depth)
    near = most_frequent(values.where("n > 0"), entries).select("gram", "value").toArrow().sort_by("gram")
    near = near.column("gram").to_numpy().astype(np.uint64), near.column("value").to_numpy()
    top = most_frequent(words.where(F.octet_length("word") <= 64), frequent, "c").collect()
    shared = spark.sparkContext.broadcast((*near, {bytes(r[0]): math.log10(r[1] + 1) for r in top}))
    end = math.log10(n_texts + 1)

    def scored(batches):
        from pyspark import TaskContext

        keys, worth, logs = shared.value
        scorer, known = Known(keys, worth), logs.get
        task, made = TaskContext.get().partitionId() << 36, 0
        fields = ["row", "id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "rare", "rare_grams"]
        rare_type, gram_type = pa.map_(pa.binary(), pa.int64()), pa.map_(pa.int64(), pa.int64())

        def part(ids, held, texts):
            nonlocal made
            buffer, begins, ends = _padded(texts, depth)
            gram = grams(buffer, depth)[_text_positions(begins, ends, len(buffer))]
            value = scorer(gram)
            sizes = ends - begins
            edge = np.concatenate([[0], np.cumsum(sizes)])
            away = np.isnan(value)
            scores, rare_grams = [], []
            for a, b in zip(edge[:-1], edge[1:]):
                scores.append(float(np.nansum(value[a:b])))
                left, times = np.unique(gram[a:b][away[a:b]], return_counts=True)
                rare_grams.append(list(zip(left.astype(np.int64).tolist(), times.tolist())))
            n_tokens, n_known, sums, rare = [], [], [], []
            for t in texts:
                tokens = t.lower().split()
                found = list(map(known, tokens))
                left = Counter([w for w, v in zip(tokens, found) if v is None])
                here = [v for v in found if v is not None]
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(here) + (n_texts > 0))
                sums.append(math.fsum(here) + end)
                rare.append(list(left.items()))
            row = list(range(task + made, task + made + len(texts)))
            made += len(texts)
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([long(row), ids, held, long(n_tokens), long(n_known), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), long(sizes), pa.array(rare, rare_type), pa.array(rare_grams, gram_type)], fields)

        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            begin, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= _CHUNK or i + 1 == len(texts):
                    yield part(batch.column(0).slice(begin, i + 1 - begin), batch.column(1).slice(begin, i + 1 - begin), texts[begin : i + 1])
                    begin, size = i + 1, 0

    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, rare map<binary,long>, rare_grams map<long,long>"
    found = written(rows.mapInArrow(scored, schema), "scored")
    zero, times = F.lit(0.0), F.col("times")
    rare = found.select("row", F.explode("rare").alias("word", "times")).join(words, "word").select("row", times.alias("more"), (times * F.log10(F.col("c") + 1)).alias("more_logs"), zero.alias("more_score"))
    away = found.select("row", F.explode("rare_grams").alias("gram", "times")).join(values, "gram").select("row", F.lit(0).cast("long"), zero, times * F.col("value"))
    rare = rare.union(away).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "more_logs", "more_score")))
    out = found.drop("rare", "rare_grams").join(rare, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * math.log10(total + distinct + 1)
    score = F.col("score") + F.coalesce("more_score", zero)
    bits = F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).otherwise(0.0)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), "n_bytes", bits.alias("bits_per_byte"),
    )
