"""Exact top-k inner products, pruned by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of each row's segments, each times the root of the segment's length.

    For vectors a and b, the sum over segments of (mean difference)^2 + (deviation difference)^2, so
    weighted, is at most their squared distance."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    sizes = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / sizes
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / sizes
    return mean * np.sqrt(sizes), np.sqrt(np.maximum(square - mean * mean, 0) * sizes)


def _levels(dim: int, resolutions) -> list[int]:
    return sorted({min(r, dim) for r in resolutions if r > 0}) if dim else []


def block_topk(q_ids, q, x_ids, x, k: int, resolutions=(1, 4, 16), floors=None):
    """(query id, row id, score) of each query's k best rows of this block, ties to the smaller id; of these
    only scores that reach the query's floor, where floors are given.

    q and x hold integers as doubles. At first a query is held against the block as a whole: the ranges of its
    rows' segment statistics bound the distance to all of them. Then a row goes on to the next resolution only while
    its lower-bound distance still allows a score that reaches the floor and the k-th best exact score known; ties pass."""
    levels = _levels(x.shape[1], resolutions)
    top = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * max(x.shape[1], 1)
    small = top < 2.0**52
    floors = np.full(len(q_ids), -np.inf) if floors is None else floors
    out, asked = [], range(len(q_ids))
    if small and len(x) and len(q):
        stats_q, stats_x = [segment_statistics(q, s) for s in levels], [segment_statistics(x, s) for s in levels]
        norm_q, norm_x = (q * q).sum(1), (x * x).sum(1)
        if levels:
            low = sum((np.maximum(0, np.maximum(sx.min(0) - sq, sq - sx.max(0))) ** 2).sum(1) for sq, sx in zip(stats_q[-1], stats_x[-1]))
            bound = (norm_q + norm_x.max() - low) / 2 + (norm_q + norm_x.max()) * 1e-9 + 1
            asked = np.flatnonzero(bound >= floors).tolist()
    for i in asked:
        own = q_ids[i]
        alive = np.flatnonzero(x_ids != own)
        if small:
            for (mq, dq), (mx, dx) in zip(stats_q, stats_x) if len(x) else ():
                if not len(alive):
                    break
                low = ((mx[alive] - mq[i]) ** 2).sum(1) + ((dx[alive] - dq[i]) ** 2).sum(1)
                bound = (norm_q[i] + norm_x[alive] - low) / 2 + (norm_q[i] + norm_x[alive]) * 1e-9 + 1
                least = floors[i]
                if len(alive) > k:
                    likely = alive[np.argpartition(-bound, k - 1)[: 4 * k]]
                    least = max(least, np.sort(x[likely] @ q[i])[::-1][k - 1])
                alive = alive[bound >= least]
            scores = x[alive] @ q[i]
            alive, scores = alive[scores >= floors[i]], scores[scores >= floors[i]]
            if len(alive) > k:
                keep = scores >= np.partition(scores, len(alive) - k)[len(alive) - k]
                alive, scores = alive[keep], scores[keep]
            order = np.lexsort((x_ids[alive], -scores))[:k]
            out += [(own, x_ids[alive[j]], int(scores[j])) for j in order]
        else:
            left = [int(v) for v in q[i]]
            exact = sorted((-sum(a * int(b) for a, b in zip(left, x[j])), x_ids[j]) for j in alive)[:k]
            out += [(own, j, min(max(-s, LONG.min), LONG.max)) for s, j in exact]
    return out


def floors_of(q_ids, q, x_ids, x, k: int) -> np.ndarray:
    """Each query's k-th best score among some rows: no smaller one can be among its k best of all."""
    found: dict[int, list[int]] = {}
    for own, _, score in block_topk(q_ids, q, x_ids, x, k):
        found.setdefault(own, []).append(score)
    return np.array([float(s[k - 1]) if len(s := found.get(own, ())) >= k else -np.inf for own in q_ids])


def exact_topk(
    vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_block: int = 4096, queries_a_block: int = 1024, pilot: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the highest integer inner product.

    Components count as floor(scale * x), at most the largest and at least the smallest long. is_query: a column over
    the ids that names the stated queries; each is set against all rows but those with its own id, block by block.
    Ties go to the smaller id. `pilot` rows that a hash of the id picks are searched first: a query's k-th best score
    among them is the floor below which no block, row or result is followed up.
    Null vectors, null ids and vectors with a null or non-finite component take no part; a vector meets
    only those of its own length; a repeated row counts each time as a candidate, while a query id that
    occurs more than once is asked once, with its smallest vector. Scores beyond a long are ranked
    exactly and returned as the nearest long. An empty table gives no rows; other columns are not read."""
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    )
    whole = clean.select("id", F.transform("v", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double")).alias("v"))
    asked = whole.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession

    def blocks(limit, held_against=None):
        def made(batches):
            task, n = TaskContext.get().partitionId() << 32, 0
            held: dict[int, tuple[list, list]] = {}

            def row(dim):
                nonlocal n
                n += 1
                ids, parts = held.pop(dim)
                ids, data, floors = np.array(ids, np.int64), b"".join(parts), b""
                if held_against is not None:
                    shape = lambda b, n: np.frombuffer(b, np.float64).reshape(n, dim)
                    first_ids, first = held_against.value.get(dim, ([], b""))
                    first_ids = np.array(first_ids, np.int64)
                    floors = floors_of(ids, shape(data, len(ids)), first_ids, shape(first, len(first_ids)), k).tobytes()
                return pa.RecordBatch.from_arrays(
                    [pa.array([task | n]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([data]), pa.array([floors])], ["block", "dim", "ids", "data", "floors"]
                )

            for batch in batches:
                lists = batch.column(1)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                at = 0
                for i, dim in zip(batch.column(0).to_pylist(), ends.tolist()):
                    ids, parts = held.setdefault(dim, ([], []))
                    ids.append(i)
                    parts.append(flat[at : at + dim].tobytes())
                    at += dim
                    if len(ids) == limit:
                        yield row(dim)
            for dim in list(held):
                yield row(dim)

        return made

    packed = "block long, dim int, ids binary, data binary, floors binary"
    few: dict[int, tuple[list, list]] = {}
    for r in whole.orderBy(F.xxhash64("id"), "id", "v").limit(pilot).collect():
        ids, parts = few.setdefault(len(r["v"]), ([], []))
        ids.append(r["id"])
        parts.append(np.array(r["v"], np.float64).tobytes())
    first = spark.sparkContext.broadcast({dim: (ids, b"".join(parts)) for dim, (ids, parts) in few.items()})
    many = max(1, -(-asked.count() // queries_a_block))
    sides = spark.sparkContext.defaultParallelism * 2
    right = asked.repartition(many, "id").mapInArrow(blocks(queries_a_block, first), packed)
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("floors").alias("q_floors"))
    left = whole.mapInArrow(blocks(rows_a_block), packed).withColumn("side", F.pmod(F.xxhash64("block"), F.lit(sides)).cast("int"))
    met = left.join(right, ["side", "dim"]).select("dim", "ids", "data", "q_ids", "q_data", "q_floors")

    def best(batches):
        for batch in batches:
            for dim, ids, data, q_ids, q_data, q_floors in zip(*(c.to_pylist() for c in batch.columns)):
                shape = lambda b, n, dim=dim: np.frombuffer(b, np.float64).reshape(n, dim)
                xi, qi = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                rows = block_topk(qi, shape(q_data, len(qi)), xi, shape(data, len(xi)), k, floors=np.frombuffer(q_floors, np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
