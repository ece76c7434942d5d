"""Spherical k-means over every row of a table of sparse vectors.

The rows are (group int, slots binary, weights binary): the slots of a vector, distinct unsigned 16-bit numbers, and
its weights, 32-bit floats, at least one of each. Tables that many passes read are better given as `blocks` of such
rows, which Spark hands to Python without looking into them. Every step is one pass over them, whose sums are exact, so that the
result depends neither on how the rows are split nor on their order. Only sums and seeds reach the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, written

ROWS = "group int, slots binary, weights binary"
#: Components of unit vectors are summed as multiples of 1 / ONE: whole numbers, exact up to 2^29 rows.
ONE = 1 << 24
#: Rows that are worked on at once.
_AT_ONCE = 128
_BLOCK = pa.schema([("block", pa.binary()), ("vectors", pa.int32())])
#: For the files of blocks: row groups of some 1 MB, as Spark's reader holds all blocks of one at once.
_SMALL_GROUPS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}


def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a binary column without nulls holds, in one array, and how many each value has."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    numbers = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return numbers, np.diff(ends) // np.dtype(kind).itemsize


def binary(numbers: np.ndarray, lens: np.ndarray) -> pa.Array:
    """The binary column that `flat` reads."""
    ends = np.concatenate([[0], np.cumsum(lens) * numbers.itemsize])
    assert ends[-1] < 1 << 31
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers.tobytes())])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Vectors:
    """Some rows as unit vectors: of the i-th, group[i], and from starts[i] on lens[i] slots and components."""

    def __init__(self, group: np.ndarray, slots: pa.Array, weights: pa.Array, idf: np.ndarray):
        self.group, (at, self.lens) = group, flat(slots, np.uint16)
        self.at, self.starts = at.astype(np.int64), np.cumsum(self.lens) - self.lens
        x = flat(weights, np.float32)[0] * np.take(idf, self.at, mode="clip")
        norm = np.sqrt(np.add.reduceat(x * x, self.starts))
        self.x = x / np.repeat(np.maximum(norm, 1e-12), self.lens)

    def cosines(self, centroids: np.ndarray, have: np.ndarray) -> np.ndarray:
        """The cosine with each centroid of the row's own group; -inf where the group has fewer. centroids: one row of
        `dims` after the other for every group, for each cluster; have: the groups' numbers of clusters."""
        place, out, own = self.at, np.empty((centroids.shape[0], len(self.lens))), have[self.group]
        if centroids.shape[1] == 1:  # few numbers: widened here rather than at each place
            centroids = centroids.astype(float)
        else:
            place = np.repeat(self.group, self.lens) * centroids.shape[-1] + place
        for j, c in enumerate(centroids):
            np.add.reduceat(self.x * np.take(c.ravel(), place, mode="clip"), self.starts, out=out[j])
            out[j, own <= j] = -np.inf
        return out.T


def blocks(rows: DataFrame) -> DataFrame:
    """The same rows in blocks, written: (block, vectors), Arrow's compressed stream of some rows and their number."""
    bounded_batches(rows)
    kind = pa.schema([("group", pa.int32()), ("slots", pa.binary()), ("weights", pa.binary())])

    def packed(batches):
        # Every pass opens them: lz4's are larger than zstd's, and opened in a third of the time.
        options = pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)
        for whole in batches:
            for begin in range(0, whole.num_rows, _AT_ONCE):
                batch, out = whole.slice(begin, _AT_ONCE), pa.BufferOutputStream()
                with pa.ipc.new_stream(out, kind, options=options) as stream:
                    stream.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kind)], schema=kind))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([batch.num_rows], pa.int32())], schema=_BLOCK)

    # Nothing is left for the writer to compress.
    return written(rows.mapInArrow(packed, "block binary, vectors int"), "blocks", "uncompressed", _SMALL_GROUPS)


def opened(batches):
    """Arrow batches of rows, from such or from batches of blocks."""
    options = pa.ipc.IpcReadOptions(use_threads=False)
    for batch in batches:
        if batch.schema.names != _BLOCK.names:
            yield batch
            continue
        for block in batch.column(0):
            yield from pa.ipc.open_stream(block.as_buffer(), options=options)


def vectors(batches, idf: np.ndarray):
    """The rows of Arrow batches, some at a time."""
    for whole in opened(batches):
        for begin in range(0, whole.num_rows, _AT_ONCE):
            batch = whole.slice(begin, _AT_ONCE)
            yield batch, Vectors(batch.column(0).to_numpy().astype(np.int64), batch.column(1), batch.column(2), idf)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """(cell, sums): the tasks' whole numbers, added up by cell."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[cell] = total.get(cell, 0) + np.frombuffer(sums, np.int64)
        yield _cells(total)

    return {r["cell"]: np.frombuffer(r["sums"], np.int64) for r in parts.repartition("cell").mapInArrow(add, "cell int, sums binary").collect()}


def _cells(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["cell", "sums"])


def frequencies(rows: DataFrame, dims: int) -> np.ndarray:
    """In how many rows each slot occurs."""

    def counted(batches):
        seen = np.zeros(dims, np.int64)
        for batch in opened(batches):
            seen += np.bincount(flat(batch.column(1), np.uint16)[0], minlength=dims)
        yield _cells({0: seen})

    return _added(rows.mapInArrow(counted, "cell int, sums binary")).get(0, np.zeros(dims, np.int64))


def inverse_frequencies(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    return np.log((1 + n) / (1 + frequencies(rows, dims))) + 1


class Passes:
    """Passes over the rows, or blocks of them, with one idf."""

    def __init__(self, rows: DataFrame, idf: np.ndarray, groups: int):
        self.rows, self.dims, self.groups, self.spark = rows, len(idf), groups, rows.sparkSession
        self.idf = self.spark.sparkContext.broadcast(idf.astype(float))

    def sums(self, centroids: np.ndarray, have: np.ndarray) -> dict[int, np.ndarray]:
        """The sum of the unit vectors nearest each centroid, by group * clusters + cluster; nothing for none."""
        idf, shared, dims, k = self.idf, self.spark.sparkContext.broadcast((centroids, have)), self.dims, len(centroids)

        def summed(batches):
            total: dict[int, np.ndarray] = {}
            for _, v in vectors(batches, idf.value):
                nearest = v.cosines(*shared.value).argmax(1) if k > 1 else 0
                cells, own = np.unique(v.group * k + nearest, return_inverse=True)
                some = np.bincount(np.repeat(own * dims, v.lens) + v.at, np.rint(v.x * ONE), len(cells) * dims).astype(np.int64).reshape(-1, dims)
                for cell, s in zip(cells.tolist(), some):
                    total[cell] = total.get(cell, 0) + s
            yield _cells(total)

        found = _added(self.rows.mapInArrow(summed, "cell int, sums binary"))
        shared.destroy()
        return found

    def least(self, centroids: np.ndarray, have: np.ndarray, sign: float) -> dict[int, np.ndarray]:
        """Each group's unit vector whose largest cosine with a centroid, times sign, is least; of such the first by
        its bytes."""
        idf, shared = self.idf, self.spark.sparkContext.broadcast((centroids, have))

        def chosen(batches):
            best: dict[int, tuple] = {}
            for batch, v in vectors(batches, idf.value):
                value = sign * v.cosines(*shared.value).max(1)
                for g in np.unique(v.group).tolist():
                    own = np.flatnonzero(v.group == g)
                    for i in own[value[own] == value[own].min()].tolist():
                        row = (float(value[i]), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                        best[g] = min(best.get(g, row), row)
            columns = [list(best), *([b[i] for b in best.values()] for i in range(3))]
            types = (pa.int32(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["group", "value", "slots", "weights"])

        rows = self.rows.mapInArrow(chosen, "group int, value double, slots binary, weights binary")
        found = rows.groupBy("group").agg(F.min(F.struct("value", "slots", "weights")).alias("row")).collect()
        shared.destroy()
        out = {}
        for r in found:
            x = np.zeros(self.dims)
            x[np.frombuffer(r["row"]["slots"], np.uint16)] = np.frombuffer(r["row"]["weights"], np.float32)
            out[r["group"]] = unit(x * self.idf.value)
        return out

    def kmeans(self, sizes: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Centroids (cluster, group, dims) and how many each group has: `clusters`, or its number of rows (sizes).

        Seeds are the row nearest the group's mean and then those farthest from all seeds; of all rows, as all steps."""
        have, c = np.minimum(sizes, clusters), np.zeros((clusters, self.groups, self.dims), np.float32)
        for cell, s in self.sums(c[:1], np.ones(self.groups, int)).items():
            c[0, cell] = unit(s.astype(float))
        for j in range(int(have.max(initial=0))):
            for g, x in self.least(c[: max(j, 1)], np.minimum(have, max(j, 1)), 1.0 if j else -1.0).items():
                if j < have[g]:
                    c[j, g] = x
        for _ in range(rounds):
            before = c.copy()
            for cell, s in self.sums(c, have).items():
                c[cell % clusters, cell // clusters] = unit(s.astype(float))
            if (before == c).all():
                break
        return c, have

    def cosines(self, centroids: np.ndarray, have: np.ndarray) -> DataFrame:
        """(group, cosine): each row's largest cosine with a centroid, in steps of 2^-16."""
        idf, shared = self.idf, self.spark.sparkContext.broadcast((centroids, have))

        def found(batches):
            for batch, v in vectors(batches, idf.value):
                cosine = np.rint(v.cosines(*shared.value).max(1) * (1 << 16)) / (1 << 16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cosine)], ["group", "cosine"])

        return self.rows.mapInArrow(found, "group int, cosine double")
