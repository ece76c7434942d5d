"""Exact dedup by content sort: range partitions of normalised text, external sort, neighbour comparison."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, sql_type, whole_text, written

#: Deleted before texts are compared: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
ORDERED = 24


def _in_order(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """(norm, n, id, c0, c1, ...) in content order, by sampled splitters and an external sort; c0, ... are the carried columns.

    The order is that of a text's first ORDERED characters, then of the SHA-256 of all of it, then of all of it: a
    splitter, which the driver holds, is then short however long the texts are, and equal texts stay adjacent. The
    id comes last, so that a large group of copies fills as many range partitions as its size asks for."""
    names = [f"c{i}" for i in range(len(carried))]
    whole = whole_text(text_col)
    rows = docs.select(F.translate(whole, BLANKS, ""), F.char_length(whole).cast("long"), F.col(id_col), *[F.col(f"`{c}`") for c in carried]).toDF("norm", "n", "id", *names)
    rows = rows.withColumns({"begin": F.substring("norm", 1, ORDERED), "digest": F.unhex(F.sha2(F.col("norm").cast("binary"), 256))})
    rows = rows.repartitionByRange("begin", "digest", "id").sortWithinPartitions("begin", "digest", "norm", F.desc("n"), F.asc_nulls_last("id"))
    return rows.select("norm", "n", "id", *names)


def _best(runs: DataFrame) -> DataFrame:
    """(text_sha256, best, whole) of the texts that have runs in several partitions: the run whose row stays, and
    the rows of all.

    runs: (text_sha256, head_n, head_id, part, size) of first and last runs, two rows a partition."""
    order = F.struct((-F.col("head_n")).alias("n"), F.col("head_id").isNull().alias("none"), F.col("head_id").alias("id"), "part")
    return runs.groupBy("text_sha256").agg(F.min(order).alias("best"), F.sum("size").alias("whole"), F.count("*").alias("runs")).where("runs > 1").drop("runs")


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for every row of docs.

    Texts are equal when identical after deleting BLANKS. Of equal texts the row with most code points
    in its original text stays, of these the smallest id (a null id last); of fully equal rows, ids
    included, one is marked kept. A null text counts as empty, so null and blank texts form one group. An empty
    table gives no rows; other columns are not read.

    Rows are range-partitioned and sorted in the order of their content (see _in_order), spilling when they
    must. One pass compares each text with its neighbour in full and closes a run when they differ. Only a partition's
    first and last run can go on elsewhere: these, two rows a partition, are summed by their SHA-256 and joined
    back. The runs are written once to the shared folder, without texts."""
    bounded_batches(docs)
    kind = sql_type(docs, id_col)
    schema = f"id {kind}, text_sha256 string, n long, first boolean, head_id {kind}, head_n long, size long, edge boolean, part int"
    names = [x.split()[0] for x in schema.split(", ")]

    def runs(batches):
        """A run's first row is the one that stays, as the sort puts it first."""
        part = TaskContext.get().partitionId()
        last, ids, lengths, pieces = None, [], [], []
        head = None
        is_first = True
        longest_piece = 1 << 16

        def closed(edge):
            sha, (h_id, h_n), size = hashlib.sha256(last).hexdigest(), head, sum(map(len, ids))
            at = 0
            for piece, counts in zip(ids, lengths):
                k = len(piece)
                flags = [False] * k
                if not at:
                    flags[0] = True
                at += k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece, id_type), pa.array([sha] * k, pa.string()), pa.array(counts, pa.int64()), pa.array(flags, pa.bool_()), pa.array([h_id] * k, id_type),
                     pa.array([h_n] * k, pa.int64()), pa.array([size] * k, pa.int64()), pa.array([edge] * k, pa.bool_()), pa.array([part] * k, pa.int32())], names
                )

        def joined(tables, least):
            pieces.extend(tables)
            if sum(p.num_rows for p in pieces) >= least:
                out = pa.Table.from_batches(pieces).combine_chunks().to_batches()
                pieces.clear()
                yield from out

        id_type = None
        for batch in batches:
            id_type = batch.column(2).type
            for text, n, i in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text != last:
                    if last is not None:
                        yield from joined(closed(is_first), 8192)
                        is_first = False
                    last, head, ids, lengths = text, (i, n), [[]], [[]]
                elif len(ids[-1]) >= longest_piece:
                    ids.append([])
                    lengths.append([])
                ids[-1].append(i)
                lengths[-1].append(n)
        if last is not None:
            yield from joined(closed(True), 0)

    found = written(_in_order(docs, id_col, text_col, []).mapInArrow(runs, schema), "runs")
    own = (F.col("id").alias(id_col), F.col("head_id").alias("keep_id"), F.col("size").alias("group_size"), F.col("first").alias("kept"), "text_sha256")
    # Of the rows of edge runs all take the group's head and size; fully equal heads are told apart by their partition.
    # They are joined by run, not by text: a large group's rows stay spread over its partitions.
    runs_ = found.where("edge AND first")
    whole = runs_.select("text_sha256", "part").join(_best(runs_), "text_sha256")
    edges = found.where("edge").join(whole, ["text_sha256", "part"], "left")
    elsewhere = F.col("best").isNotNull()
    keep_id = F.when(elsewhere, F.col("best.id")).otherwise(F.col("head_id"))
    stays = F.col("first") & F.when(elsewhere, F.col("best.part") == F.col("part")).otherwise(F.lit(True))
    edges = edges.select(F.col("id"), keep_id, F.coalesce("whole", "size"), stays, "text_sha256")
    return found.where("NOT edge").select(*own).union(edges)


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that content_groups keeps; of fully equal rows one.

    The rows go once through the content sort, where all but a run's first are left behind; of the first and last
    runs of the partitions those go that continue a better one elsewhere. Columns may have any names."""
    bounded_batches(docs)
    schema = T.StructType([
        T.StructField("text_sha256", T.StringType()), T.StructField("head_n", T.LongType()), T.StructField("head_id", docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("edge", T.BooleanType()), *(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)),
    ])
    names = schema.names

    def heads(batches):
        part, last, held, is_first = TaskContext.get().partitionId(), None, None, True

        def out(rows: pa.RecordBatch, sha, edge):
            k = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.array([sha] * k, pa.string()), rows.column(1), rows.column(2), pa.array([part] * k, pa.int32()), pa.array([edge] * k, pa.bool_()), *rows.columns[3:]], names)

        for batch in batches:
            begins = []
            for i, text in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
                if text != last:
                    begins.append(i)
                    last = text
            if not begins:
                continue
            # The partition's first run and the last one so far stay apart.
            if held is not None:
                yield out(held, hashlib.sha256(held.column(0).cast(pa.binary())[0].as_py()).hexdigest() if is_first else None, is_first)
                is_first = False
            rows = batch.take(pa.array(begins, pa.int32()))
            if is_first and len(begins) > 1:
                yield out(rows.slice(0, 1), hashlib.sha256(rows.column(0).cast(pa.binary())[0].as_py()).hexdigest(), True)
                rows, is_first = rows.slice(1), False
            if rows.num_rows > 1:
                yield out(rows.slice(0, rows.num_rows - 1), None, False)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield out(held, hashlib.sha256(last).hexdigest(), True)

    found = written(_in_order(docs, id_col, text_col, docs.columns).mapInArrow(heads, schema), "heads")
    best = _best(found.where("edge").withColumn("size", F.lit(1).cast("long")))
    edges = found.where("edge").join(best, "text_sha256", "left").where("best IS NULL OR best.part = part")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    return found.where("NOT edge").select(*columns).union(edges.select(*columns)).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
