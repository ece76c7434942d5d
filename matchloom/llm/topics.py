"""Topics of texts: the nearest of a few clustered TF-IDF centroids over hashed words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import clusters
from .shared import whole_text, written

#: Hashed words share this many dimensions.
DIMS = 1 << 12
#: The topic of a text without words.
NONE = "none"
#: Texts are looked at up to so many at once, and beyond the first up to so many bytes of them.
_TEXTS, _BYTES = 128, 1 << 20
#: Weights are multiples of 1 / ONE, so that their sums are exact in any order.
ONE = 1 << 36


class Slots(dict):
    """A word's dimension, a word at a time; slots_of has the same for many."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) & (DIMS - 1)


def slots_of(words: pa.Array) -> np.ndarray:
    """The dimensions of words."""
    # Not to_pylist, which takes several times as long as the hashes.
    digests = b"".join(map(xxhash.xxh3_64_digest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)))
    return (np.frombuffer(digests, ">u8") & np.uint64(DIMS - 1)).astype(np.int64)


def weighed_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of its words and that of their distinct dimensions; of all texts after one another
    these dimensions, ascending in a text, and their weights."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty one
    words, text = words.filter(some).dictionary_encode(), text[some.to_numpy(zero_copy_only=False)]
    word = words.indices.to_numpy().astype(np.int64)
    keys = np.sort((text * DIMS + slots_of(words.dictionary)[word]) << 32 | word)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    weights, cells = np.rint(np.log1p(np.diff(first, append=len(keys))) * ONE) / ONE, keys[first] >> 32
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    cells, weights = cells[first], np.add.reduceat(weights, first) if len(first) else weights
    return np.bincount(text, minlength=len(texts)), np.bincount(cells // DIMS, minlength=len(texts)), (cells % DIMS).astype(np.uint16), weights.astype(np.float32)


def _bunches(texts: pa.StringArray):
    """The texts, up to _TEXTS and _BYTES at once."""
    begin, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    while begin < len(texts):
        most = (ends[begin - 1] if begin else 0) + _BYTES
        end = max(begin + 1, min(begin + _TEXTS, int(np.searchsorted(ends, most, "right"))))
        yield texts.slice(begin, end - begin)
        begin = end


_FOUND = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("slots", T.BinaryType()), T.StructField("weights", T.BinaryType())])


def words_of(text_col: str = "text") -> Column:
    """A struct of the number of a text's words between white space, the dimensions of its distinct words (unsigned
    16-bit numbers) and their weights (32-bit floats), log(1 + n) summed over the words that share one."""

    @F.arrow_udf(_FOUND)
    def looked_at(texts: pa.Array) -> pa.Array:
        found = list(zip(*map(weighed_words, _bunches(texts.cast(pa.string())))))
        n, lens, dims, weights = map(np.concatenate, found) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint16), np.zeros(0, np.float32))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), clusters.binary(dims, lens), clusters.binary(weights, lens)], [f.name for f in _FOUND])

    return looked_at(whole_text(text_col))


@dataclass
class Topics:
    """centroids: one unit row for each topic, over dimensions weighted by idf."""

    idf: np.ndarray
    centroids: np.ndarray

    def __post_init__(self):
        self.weighed = np.ascontiguousarray(self.centroids * self.idf)

    def nearest(self, slots: pa.Array, weights: pa.Array) -> list[str]:
        """The topic of each text from its words' dimensions and weights: the centroid with the largest cosine."""
        (at, lens), (x, _) = clusters.flat(slots, np.uint16), clusters.flat(weights, np.float32)
        out, some = [NONE] * len(slots), np.flatnonzero(lens)
        if not len(self.centroids) or not len(some):
            return out
        starts = (np.cumsum(lens) - lens)[some]
        best = np.stack([np.add.reduceat(x * c[at], starts) for c in self.weighed]).argmax(0)
        for i, topic in zip(some.tolist(), best.tolist()):
            out[i] = f"topic{topic}"
        return out

    def of(self, spark: SparkSession, slots: Column, weights: Column) -> Column:
        """The column of the topics of words_of's dimensions and weights."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf(T.StringType())
        def nearest(at: pa.Array, x: pa.Array) -> pa.Array:
            return pa.array(shared.value.nearest(at, x), pa.string())

        # Never null, and Spark has to know: else a join by the topic first filters by it, which makes all topics
        # twice and takes two Python workers more in each executor.
        return F.coalesce(nearest(slots, weights), F.lit(NONE))


def fit_found(found: DataFrame, topics: int = 8) -> Topics:
    """Spherical k-means of all rows of a written table with words_of's slots and weights; rows without words teach nothing."""
    rows = clusters.blocks(found.select(F.lit(0).alias("group"), "slots", "weights").where(F.octet_length("slots") > 0))
    n = rows.agg(F.sum("vectors")).first()[0] or 0
    idf = clusters.inverse_frequencies(rows, n, DIMS)
    c, have = clusters.Passes(rows, idf, 1).kmeans(np.array([n]), topics)
    return Topics(idf, c[: have[0], 0].astype(float))


def fit(docs: DataFrame, topics: int = 8, text_col: str = "text") -> Topics:
    """The topics of all texts. Their words are written once; every step is a pass over these."""
    found = docs.select(words_of(text_col).alias("found")).select("found.slots", "found.weights")
    return fit_found(written(found, "words", "zstd"), topics)
