"""MinHash near-dedup: banded candidates, sequential Bayesian verification, exact check, components."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, bounded_batches, sql_type, written

WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
#: 40 bands of 5 rows: a pair at similarity 0.75 shares no band with a chance of 2e-5, at 0.8 of 1e-7.
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS
#: Signatures are compared so many at a time, one byte each.
BATCH = 20
_MULTIPLY = np.random.default_rng(20240607).integers(1 << 31, size=(2, PERMUTATIONS), dtype=np.uint32)
_TIMES, _PLUS = (_MULTIPLY[0] << 1) | 1, _MULTIPLY[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct word shingles of a whole text as sorted 64-bit hashes; A-Z count as a-z.

    A text of fewer words is one shingle, hashed apart from the full ones; one without words has none."""
    own = text.lower().split() if text else []
    n = len(own)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, n)
    k = min(n, words)
    total = np.full(n - k + 1, 0 if k == words else k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    total = np.sort(_mixed(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the linear maps of the shingles' upper 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(x), 512):
        np.minimum(out, (x[begin : begin + 512, None] * _TIMES + _PLUS).min(0), out=out)
    return out


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For n = BATCH, 2 * BATCH, ... compared bytes the fewest matches with which a pair stays.

    With m of n equal and a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1); a pair is
    pruned when the chance that it reaches the threshold is below `miss`. Bytes of unequal hashes agree
    by chance once in 256, which the threshold takes in."""
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        terms = [math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 1)]
        out.append(next(m for m in range(n + 1) if sum(terms[: m + 1]) >= miss))
    return tuple(out)


def likely(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indices of the rows of byte signatures a and b that the sequential test doesn't prune."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, least in enumerate(least_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (a[alive, part] == b[alive, part]).sum(1)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
        if not len(alive):
            break
    return alive


def _binary(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def sketches(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, same, signature, bands): same is a 128-bit digest of the whole set, null without shingles."""

    def made(batches):
        for batch in batches:
            counts, same, bytes_, bands = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text)
                counts.append(len(s))
                if not len(s):
                    same.append(None), bytes_.append(None), bands.append(None)
                    continue
                m = signature(s)
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                bytes_.append((m >> np.uint32(24) ^ m).astype(np.uint8).tobytes())
                cut = m.tobytes()
                bands.append([xxhash.xxh3_64_intdigest(cut[4 * ROWS * i : 4 * ROWS * (i + 1)], i) - (1 << 63) for i in range(BANDS)])
            yield _batch({"id": batch.column(0), "n_shingles": pa.array(counts, pa.int64()), "same": pa.array(same, pa.binary()), "signature": pa.array(bytes_, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.mapInArrow(made, "id long, n_shingles long, same binary, signature binary, bands array<long>")


def _sizes_allow(a, b):
    """Sets whose sizes differ more than this cannot reach the similarity."""
    return (F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR)


def _tested(pairs: DataFrame, marks: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that the sequential test leaves, from the signatures of both."""
    left, right = (marks.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").where(_sizes_allow(F.col("n_a"), F.col("n_b"))).select("a", "b", "s_a", "s_b")

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                at = likely(_binary(batch.column(2), np.uint8, PERMUTATIONS), _binary(batch.column(3), np.uint8, PERMUTATIONS), threshold, miss)
                yield batch.select(["a", "b"]).take(pa.array(at))

    return both.mapInArrow(test, "a long, b long")


#: Up to so many ids (some 32 MB) are broadcast as they are, which keeps a second Python worker out of the stage.
FEW_IDS = 1 << 20


def _asked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in the written table ids, and beyond FEW_IDS a few others, which a join then leaves
    out: texts that no pair asks for are not shuffled.

    Many ids are told by a bit for each hash of one, some eight for each id and at most 2^27 (16 MB): that is what
    reaches the driver and the tasks, however many there are."""
    n = ids.count()
    if n <= FEW_IDS:
        return rows.join(F.broadcast(ids), "id", "left_semi")
    bits = min(27, max(20, (8 * n).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().astype(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def asked(slots: pd.Series) -> pd.Series:
        x = slots.to_numpy().astype(np.uint64)
        return pd.Series((shared.value[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    return rows.where(asked(slot))


def _sets(ids: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, shingles) of the written table ids, from one look at the texts (id, text).

    Where rows with one id differ, it is the set that marks has for the id."""

    def made(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield _batch({"id": batch.column(0), "same": pa.array(digests, pa.binary()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    asked = ids.join(marks.select("id", "same"), "id")
    found = _asked(texts, ids).mapInArrow(made, "id long, same binary, shingles binary")
    return written(found.join(asked, ["id", "same"], "left_semi").dropDuplicates(["id"]).select("id", "shingles"), "sets")


#: Members that are checked against a hub in one group.
A_HUB = 256


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """The written pairs (a, b) whose whole shingle sets reach the similarity; texts: (id, text).

    A hub's set goes once to each group of some A_HUB members, which are streamed past it."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    sets = _sets(ids, marks, texts)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / A_HUB).alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    dealt = written(dealt, "dealt")
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "shingles")
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "shingles")
    met = hubs.union(members).repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def check(batches):
        own = np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for i, (side, x) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                other = np.frombuffer(x, np.uint64)
                if not side:
                    own = other
                    continue
                common = len(np.intersect1d(own, other, assume_unique=True))
                if DENOMINATOR * common >= NUMERATOR * (len(own) + len(other) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return met.mapInArrow(check, "a long, b long")


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v), v the smaller, that join what links (a, b) join: within each task every id is tied to the
    smallest that it can reach there, some 200,000 links at a time."""

    def ties(batches):
        at: dict[int, int] = {}

        def root(x):
            while (up := at.setdefault(x, x)) != x:
                at[x] = at[up]
                x = at[x]
            return x

        def out():
            rows = [(x, r) for x in at if (r := root(x)) != x]
            at.clear()
            return _batch({"u": pa.array([x for x, _ in rows], pa.int64()), "v": pa.array([r for _, r in rows], pa.int64())})

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                if a != b:
                    at[max(a, b)] = min(a, b)
            if len(at) > 2 * 100_000:
                yield out()
        yield out()

    return links.select("a", "b").mapInArrow(ties, "u long, v long")


#: Up to so many links are tied in one task; a task of _contracted holds twice as many ids.
ONE_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b) but the components' own: the smallest id that can be reached.

    Links are contracted within each task first; a few that are left are then contracted in one task. Of more,
    large-star and small-star steps are made in turn, each an aggregate and a join whose result is written, until
    few are left or every id has one link and no link's smaller end has one."""
    edges = written(_contracted(links).distinct(), "links")
    while edges.count() > ONE_TASK:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
        if ends.where("up > 1 OR up > 0 AND top > 0").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        # Large star: every larger neighbour is tied to the smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # Small star: every smaller neighbour, and the node, is tied to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        edges = written(large.join(low, "u").select(tied.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "links")
    edges = written(_contracted(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1)), "tied")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that found doesn't have in one component, with the components c_a and c_b."""
    for c in "ab":
        own = found.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
    return pairs.where("c_a <> c_b")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found after the written links (a, b) between components, which are few: only components are tied anew."""
    if links.isEmpty():
        return found
    ties = components(_apart(links, found).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    moved = found.join(ties.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return written(moved.select("id", F.coalesce("to", "component").alias("component")).union(ties), "found")


def _by_group(make):
    """A mapInArrow function over rows sorted by (bucket, low, high): make gets the table of each group of two rows or more."""

    def groups(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "low", "high")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            begin = 0
            for cut in cuts:
                if cut - begin > 1:
                    yield make(table.slice(begin, cut - begin))
                begin = int(cut)
            held = table.slice(begin)
        if held is not None and held.num_rows > 1:
            yield make(held)

    return groups


#: Rows of a bucket that meet in one block: at first, and where a bucket has over 64 such blocks; and shingles in one.
BLOCK, WIDE_BLOCK, BLOCK_SHINGLES = 512, 8192, 1 << 21
#: Sizes of sets fall in classes by this ratio, so that sets that can be similar are at most one class apart.
SIZE_RATIO = 1.34


def _size_class(n: str):
    return F.floor(F.log(F.col(n).cast("double")) / math.log(SIZE_RATIO)).cast("int")


def _blocks(n, size):
    """The number of blocks for n sets of a size class: what a block holds is bounded in rows and in bytes, and
    a set's copies grow with the root of a large bucket's size class, not with it."""
    fit = F.lit(BLOCK_SHINGLES) / F.pow(F.lit(SIZE_RATIO), size + 1)
    of = lambda rows: F.ceil(n / F.greatest(F.lit(1.0), F.least(F.lit(float(rows)), fit)))
    return F.greatest(of(WIDE_BLOCK), F.least(of(BLOCK), F.lit(64))).cast("int")


def _doubtful(members: DataFrame, marks: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(bucket, low, high, own, id, component, n_shingles): members that the test leaves with another of their bucket.

    members: (bucket, size, id, component), without the hubs. Buckets of one component are left out. The
    rows of a bucket's size class are dealt to blocks, and each pair of blocks of one class or of neighbouring ones is a
    group, so no task holds a whole large bucket and sets too unlike in size never meet. A member is given once
    for a group, however many others of other components it may be like."""
    units = members.groupBy("bucket", "size").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    units = units.select("bucket", "x", "y", F.struct("size", _blocks(F.col("n"), F.col("size")).alias("blocks")).alias("unit"))
    mixed = units.groupBy("bucket").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.map_from_entries(F.collect_list("unit")).alias("blocks")).where("x <> y")
    # Signatures come before a row is copied to its blocks.
    rows = members.join(mixed.select("bucket", "blocks"), "bucket").join(marks.select("id", "n_shingles", "signature"), "id")
    rows = rows.withColumn("own", F.expr("shiftleft(cast(size as long), 32) + pmod(xxhash64(id), blocks[size])"))
    unit = "transform(sequence(0, {n} - 1), i -> shiftleft(cast({k} as long), 32) + i)"
    every = [f"CASE WHEN blocks[{k}] IS NOT NULL THEN {unit.format(n=f'blocks[{k}]', k=k)} ELSE array() END" for k in ("size", "size + 1", "size - 1")]
    dealt = rows.withColumn("other", F.explode(F.expr(f"concat({', '.join(every)})"))).drop("blocks")
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "n_shingles")
    names = ["bucket", "low", "high", "own", "id", "component", "n_shingles"]

    def marked(rows: pa.Table):
        n, comp, own = (rows.column(c).to_numpy() for c in ("n_shingles", "component", "own"))
        marks = _binary(rows.column("signature").combine_chunks(), np.uint8, PERMUTATIONS)
        within = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        last = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, "right")
        seen = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            j = np.arange(i + 1, last[i])
            j = j[comp[j] != comp[i]] if within else j[(comp[j] != comp[i]) & (own[j] != own[i])]
            if len(j):
                j = j[likely(np.broadcast_to(marks[i], (len(j), PERMUTATIONS)), marks[j], threshold, miss)]
                seen[j] = True
                seen[i] |= len(j) > 0
        return rows.select(names).filter(pa.array(seen)).combine_chunks().to_batches()

    def flat(batches):
        for group in _by_group(marked)(batches):
            yield from group

    schema = "bucket long, low long, high long, own long, id long, component long, n_shingles long"
    return dealt.select(*names, "signature").mapInArrow(flat, schema)


def _joining_links(doubtful: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the components in each group, checked on the sets of whole texts.

    A group's pairs are checked where they stand, sizes first, and a pair that the links found so far already
    join is passed over; so a group gives fewer links than it has members, whatever the number of its pairs."""
    sets = _sets(written(doubtful.select("id").distinct(), "asked"), marks, texts)
    rows = doubtful.join(sets, "id").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "n_shingles")

    def joined(table: pa.Table):
        ids, comp, n = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        slots = np.unique(np.concatenate(sets), return_inverse=True)[1]
        width = int(slots.max(initial=-1)) + 1
        edges = np.cumsum([0, *map(len, sets)])
        label = np.unique(comp, return_inverse=True)[1]
        last = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, "right")
        held = np.zeros(width, bool)
        a_out, b_out = [], []
        for i in range(len(ids) - 1):
            end = last[i]
            if (label[i + 1 : end] == label[i]).all():
                continue
            held[slots[edges[i] : edges[i + 1]]] = True
            common = np.add.reduceat(held[slots[edges[i + 1] : edges[end]]], edges[i + 1 : end] - edges[i + 1], dtype=np.int64)
            held[slots[edges[i] : edges[i + 1]]] = False
            for j in i + 1 + np.flatnonzero(DENOMINATOR * common >= NUMERATOR * (n[i] + n[i + 1 : end] - common)):
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    a_out.append(min(ids[i], ids[j]))
                    b_out.append(max(ids[i], ids[j]))
        return _batch({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return rows.select("bucket", "low", "high", "id", "component", "n_shingles", "shingles").mapInArrow(_by_group(joined), "a long, b long")


#: Bands whose stars are met first; most members of a large group are joined by them.
FIRST = 6


def near_duplicates(docs: DataFrame, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked when their sets of distinct five-word shingles have a Jaccard similarity of 0.75
    or more; component_id is the smallest id that links reach, kept marks the document that has it. Null and
    empty texts, and blank ones, have no shingles and no links. A row with a null id stays alone, with a null
    component, and is kept. Rows with one id count as one document; where their texts differ, one of them, chosen by
    its digest, stands for it in links. An empty table gives no rows; other columns are not read.

    1. Equal sets become one class, known by its smallest id, so exact copies never meet as pairs.
    2. Every class puts its MinHash bands into buckets. In each bucket of the first FIRST bands the smallest id
       is the hub and meets every member: work in proportion to the bucket, however large a group of near
       copies is. In the other bands the same is done for members that are not yet in their hub's component.
    3. Pairs whose signatures, compared 20 at a time, make a similarity of 0.75 less likely than `miss` are
       pruned; the others are checked on the sets of their whole texts.
    4. In buckets that still hold several components all other pairs across components are tested in
       the same way, block by block, and checked in their group with the sets of those that pass; only links
       that join components become rows. Links within one component add nothing to the result.
    What can be missed: a pair that shares no band (2e-5 at 0.75 and less above) or that the test prunes."""
    bounded_batches(docs)
    threshold = NUMERATOR / DENOMINATOR
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = written(sketches(texts), "sketches")
    filled = made.where("same IS NOT NULL AND id IS NOT NULL")
    classes = written(filled.groupBy("same").agg(F.min("id").alias("class")), "classes")
    member = written(made.select("id", "n_shingles", "same").join(classes, "same", "left").select("id", "n_shingles", "class"), "members")
    # The smallest digest decides where rows with one id differ.
    first = F.row_number().over(Window.partitionBy("id").orderBy("same"))
    heads = classes.select(F.col("class").alias("id"), "same").withColumn("n", first).where("n = 1").drop("n")
    marks = filled.join(heads, ["id", "same"], "left_semi").dropDuplicates(["id"])
    marks = written(marks.select("id", "n_shingles", "same", "signature", "bands"), "marks")
    placed = marks.select("id", _size_class("n_shingles").alias("size"), F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("many"), F.min("id").alias("hub")).where("many > 1").drop("many")
    inside = written(placed.join(shared, "bucket").select("bucket", "band", "size", "hub", "id"), "buckets")
    texts = texts.where("id IS NOT NULL")

    def linked(pairs):
        return written(_verified(written(_tested(pairs.select("a", "b").distinct(), marks, threshold, miss), "candidates"), marks, texts), "stars")

    stars = inside.where("id <> hub").select("band", F.col("hub").alias("a"), F.col("id").alias("b"))
    found = components(linked(stars.where(F.col("band") < FIRST)))
    found = _joined(found, linked(_apart(stars.where(F.col("band") >= FIRST), found)))
    labelled = inside.where("id <> hub").join(found, "id", "left").select("bucket", "size", "id", F.coalesce("component", "id").alias("component"))
    doubtful = written(_doubtful(labelled, marks, threshold, miss), "doubtful")
    if not doubtful.isEmpty():
        found = _joined(found, written(_joining_links(doubtful, marks, texts), "across"))
    out = member.join(found.withColumnRenamed("id", "class"), "class", "left")
    component = F.coalesce("component", "class", "id")
    return out.select(F.col("id").cast(sql_type(docs, id_col)).alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns, whatever their names, that near_duplicates keeps; see there for nulls,
    texts without words, rows with one id and empty tables."""
    dropped = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("NOT kept").select(id_col)
    return docs.join(dropped, id_col, "left_anti").select(*all_columns(docs))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE 'short ' || array_to_string(w, ' ') END AS sh
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, dest) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.dest),
m AS (SELECT doc_id, min(dest) AS component_id FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
