"""Context-tree weighting over bytes: binary-decomposed Krichevsky-Trofimov estimates, mixed over all depths.

The tree holds every context of the corpus down to its depth and is never in one place. A node is a context and
the leading bits of the byte after it; its key is context * 256 + those bits after a 1. Its weighted probability
is half its own KT estimate and half the product over the contexts one byte longer; at the full depth it is the
KT estimate alone. Two passes make of the counts of all grams (a context and its byte) the probability of
each gram's byte: one from the longest contexts up, which gives each node's weighted probability, and one down,
which carries (a, b) such that the probability of a 1 is a + b * (what the next depth says). The last two
depths are worked out in numpy, for each shorter context apart; those above by aggregates and joins on the nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import written

DEPTH = 5
#: With its byte and the node's bits, a context must fit a signed long.
DEEPEST = 6
_AT_ONCE = 1 << 18


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series from 8 on."""
    x = np.array(x, float)
    shift = np.zeros(x.shape)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    inverse = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - inverse * (1 / 360 - inverse / 1260)) / x


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of any sequence with so many zeros and ones."""
    out = np.zeros(len(zeros))
    some = np.flatnonzero(zeros + ones)
    z, o = zeros[some], ones[some]
    out[some] = _lgamma(z + 0.5) + _lgamma(o + 0.5) - np.log(np.pi) - _lgamma(z + o + 1)
    return out


def grams(text: bytes | np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte its context and itself as one number: the byte lowest, then the context, newest byte
    first; before a text stand zero bytes."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = b.copy()
    for d in range(1, min(depth, len(b) - 1) + 1):
        out[d:] |= b[:-d] << np.uint64(8 * d)
    return out


def _above(key: np.ndarray, depth: int) -> np.ndarray:
    """The key of the node with the same bits after the context's newest `depth` bytes."""
    return ((key >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8) | (key & np.uint64(255))


def _shares(zeros, ones, own, total):
    """The KT estimate of a 1, and the weight of a node's own estimate against its longer contexts'."""
    return (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(total - own, -700, 700)))


class Subtree:
    """The nodes of depth `top` to `depth` over some grams and their counts; grams with count 0 change nothing."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, top: int, depth: int):
        gram, n = gram.astype(np.uint64), n.astype(float)
        byte, keys, ones = gram & np.uint64(255), [], []
        for i in range(8):
            keys.append((gram >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << i) | (byte >> np.uint64(8 - i)))
            ones.append((byte >> np.uint64(7 - i)) & np.uint64(1))
        self.bits = np.concatenate(ones)
        # Of each level: keys, zeros, ones, KT logarithm, sum over longer contexts, weighted logarithm, place of each lower node's parent.
        self.levels: list[tuple] = []
        key, self.at = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.tile(n, 8)
        one = np.bincount(self.at, weight * self.bits, len(key))
        zero = np.bincount(self.at, weight, len(key)) - one
        own = kt_log(zero, one)
        self.levels.append((key, zero, one, own, np.full(len(key), -np.inf), own, None))
        for d in range(depth - 1, top - 1, -1):
            below = self.levels[0]
            key, at = np.unique(_above(below[0], d), return_inverse=True)
            zero, one, total = (np.bincount(at, below[i], len(key)) for i in (1, 2, 5))
            own = kt_log(zero, one)
            self.levels[0] = (*below[:6], at)
            self.levels.insert(0, (key, zero, one, own, total, np.logaddexp(own, total) - np.log(2), None))

    def log10(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10 of each gram's byte, from (a, b) of the uppermost level's nodes in the order of their keys."""
        for _, zero, one, own, total, _, parent in self.levels[1:]:
            p, stop = _shares(zero, one, own, total)
            a, b = a[parent] + b[parent] * stop * p, b[parent] * (1 - stop)
        p = np.clip(a[self.at], 1e-300, 1.0)
        return np.log10(np.where(self.bits == 1, p, np.maximum(1 - p, 1e-300))).reshape(8, -1).sum(0)


def _whole_groups(batches, least: int = _AT_ONCE):
    """Tables of some `least` rows that end where the first column, by which rows are sorted, changes."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = table.column(0).to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        else:
            held = table.to_batches()
        least = max(least, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _context(gram: str, depth: int) -> Column:
    return F.shiftright(gram, 8).bitwiseAND(F.lit((1 << (8 * depth)) - 1).cast("long"))


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


@F.pandas_udf(DoubleType())
def _kt(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    return pd.Series(kt_log(zeros.to_numpy(), ones.to_numpy()))


def log10_of_grams(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, value) for the written table counts (gram, n): log10 of each gram's byte under the tree of all.

    n is 0 for a gram that is only asked for. Each depth's nodes are one written table; grams are shuffled twice."""
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth must be from 0 to {DEEPEST}")
    top = max(0, depth - 2)
    by_context = counts.select(_context("gram", top).alias("context"), "gram", "n")

    def upper(batches):
        for table in _whole_groups(batches):
            key, zero, one, _, _, weighted, _ = Subtree(*_numbers(table, "gram", "n"), top, depth).levels[0]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(zero), pa.array(one), pa.array(weighted)], ["key", "zeros", "ones", "weighted"])

    nodes = by_context.repartition("context").sortWithinPartitions("context").mapInArrow(upper, "key long, zeros double, ones double, weighted double")
    levels = [written(nodes, "nodes")]
    above = lambda key, d: F.shiftleft(_context(key, d), 8).bitwiseOR(F.col(key).bitwiseAND(F.lit(255).cast("long")))
    for d in range(top - 1, -1, -1):
        sums = levels[0].groupBy(above("key", d).alias("key")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones")), F.sum("weighted").alias("total"))
        sums = sums.withColumn("own", _kt("zeros", "ones"))
        # The logarithm of half of e^own and half of e^total.
        high, low = F.greatest("own", "total"), F.least("own", "total")
        levels.insert(0, written(sums.withColumn("weighted", high + F.log1p(F.exp(low - high)) - float(np.log(2))), "nodes"))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    stop = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("total") - F.col("own")))))
    down = None
    for d in range(top):
        level = levels[d].select("key", one.alias("p"), stop.alias("stop"))
        if down is None:
            down = level.select("key", (F.col("stop") * F.col("p")).alias("a"), (1 - F.col("stop")).alias("b"))
        else:
            both = level.withColumn("up", above("key", d - 1)).join(down.withColumnRenamed("key", "up"), "up")
            down = both.select("key", (F.col("a") + F.col("b") * F.col("stop") * F.col("p")).alias("a"), (F.col("b") * (1 - F.col("stop"))).alias("b"))
    # The uppermost nodes of the subtrees get (a, b) of the node above them: their own share is mixed in below.
    nodes = levels[-1].select("key")
    if down is None:
        nodes = nodes.select("key", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    else:
        nodes = nodes.withColumn("up", above("key", top - 1)).join(down.withColumnRenamed("key", "up"), "up").select("key", "a", "b")
    nodes = nodes.select(F.shiftright("key", 8).alias("context"), F.col("key").alias("gram"), F.lit(None).cast("long").alias("n"), "a", "b")
    none = F.lit(None).cast("double")
    met = nodes.union(by_context.select("context", "gram", "n", none.alias("a"), none.alias("b")))

    def lower(batches):
        for table in _whole_groups(batches):
            known = table.filter(pa.compute.is_valid(table.column("n")))
            tree = Subtree(*_numbers(known, "gram", "n"), top, depth)
            key, a, b = _numbers(table.filter(pa.compute.is_null(table.column("n"))), "gram", "a", "b")
            order = np.argsort(key)
            key, zero, one, own, total, _, _ = tree.levels[0]
            p, stop = _shares(zero, one, own, total)
            a, b = a[order], b[order]
            value = tree.log10(a + b * stop * p, b * (1 - stop))
            yield pa.RecordBatch.from_arrays([known.column("gram").combine_chunks(), known.column("n").combine_chunks(), pa.array(value)], ["gram", "n", "value"])

    dealt = met.repartition("context").sortWithinPartitions("context")
    return written(dealt.mapInArrow(lower, "gram long, n long, value double"), "values")


class Known:
    """Looks up grams in a sorted table of some; the values met last stay in a fixed number of slots. NaN: not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.table, self.worth, self.shift = keys, values, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64((1 << 64) - 1))
        self.values = np.zeros(1 << bits)

    def _slots(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        slot = self._slots(gram)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != gram)
        if len(miss):
            new, back = np.unique(gram[miss], return_inverse=True)
            values = np.full(len(new), np.nan)
            if len(self.table):
                at = np.minimum(np.searchsorted(self.table, new), len(self.table) - 1)
                there = self.table[at] == new
                values[there] = self.worth[at[there]]
            out[miss] = values[back]
            slot = self._slots(new)
            self.keys[slot], self.values[slot] = new, values
        return out
