"""Language ID: TF-IDF vectors of hashed byte n-grams against several clustered centroids a language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import ROWS, Passes, inverse_frequencies
from .clusters import unit as _unit
from .shared import bounded_batches, sql_type, written

#: Hashed n-grams of one, two and three bytes share this many dimensions.
DIMS = 1 << 13
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 97 and c <= 122 or c > 127 else 32 for c in range(256))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text: letters in lower case, any other ASCII run as one blank."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    slots = np.concatenate([b * np.uint32(2654435761), (two + np.uint32(1 << 25)) * np.uint32(2246822519), (three + np.uint32(1 << 26)) * np.uint32(3266489917)])
    return np.bincount(slots >> np.uint32(32 - 13), minlength=DIMS)


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (Unicode's L categories; numbers such as ½ are none)."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Centroids:
    """languages[i] owns rows owner == i of centroids; a document is rejected below floors[i]."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts, dtype=np.float32) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of counts the index of the nearest language and the cosine."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        return self.owner[best], np.clip(cosines[np.arange(len(best)), best], 0, 1)


@dataclass
class Labelled:
    """What teaches: rows, a written table of n-grams as `clusters` takes them, whose group is an index into languages,
    and how many rows each language has."""

    languages: list[str]
    rows: DataFrame | None
    sizes: np.ndarray


def fit(labelled: Labelled, clusters: int = 3, slack: float = 0.35) -> Centroids:
    """From all rows of the labelled documents; every step is a pass over them.

    A language's floor is `slack` times the cosine that the least typical hundredth of its rows has."""
    languages, sizes = labelled.languages, labelled.sizes
    if not sizes.sum():
        return Centroids([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    idf = inverse_frequencies(labelled.rows, int(sizes.sum()), DIMS).astype(np.float32)
    passes = Passes(labelled.rows, idf, len(languages))
    c, have = passes.kmeans(sizes, clusters)
    floors = np.zeros(len(languages))
    for r in passes.cosines(c, have).groupBy("group").agg(F.percentile("cosine", 0.01).alias("least")).collect():
        floors[r["group"]] = slack * r["least"]
    return Centroids(languages, idf, np.concatenate([c[:n, g] for g, n in enumerate(have)]), np.repeat(np.arange(len(languages)), have), floors)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out, a_language: int | None = None, most_languages: int = 500) -> Labelled:
    """The training rows: all labelled rows outside held_out or, with a_language, about so many of each language,
    chosen by a hash of the id and the text.

    Learned are the `most_languages` labels with the most rows, which a real set of languages stays below. Texts with
    no letter teach nothing. The n-grams are counted once and written; nothing but labels reaches the driver."""
    bounded_batches(docs)
    fold = ~F.coalesce(held_out(F.col(id_col)), F.lit(False))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & fold)
    counts = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return Labelled([], None, np.zeros(0, int))
    counts.sort(key=lambda r: r["lang"])
    shares = [min(1.0, a_language / r["count"]) if a_language else 1.0 for r in counts]
    # As an Arrow table: rows of a list go through an RDD, which starts a second daemon with Python workers of its own.
    groups = docs.sparkSession.createDataFrame(pa.table({"lang": [r["lang"] for r in counts], "group": pa.array(range(len(counts)), pa.int32()), "share": pa.array(shares, pa.float64())}))
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), chance.alias("chance"))
    chosen = chosen.join(F.broadcast(groups), "lang")

    def features(batches):
        for batch in batches:
            groups, slots, weights = [], [], []
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    c = ngram_counts(text.encode("utf-8", "replace"))
                    at = np.flatnonzero(c)
                    groups.append(group)
                    slots.append(at.astype(np.uint16).tobytes())
                    weights.append(np.log1p(c[at], dtype=np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(slots, pa.binary()), pa.array(weights, pa.binary())], ["group", "slots", "weights"])

    rows = written(chosen.where("chance < share").select("group", "text").mapInArrow(features, ROWS), "ngrams", "zstd")
    sizes = np.zeros(len(counts), int)
    for r in rows.groupBy("group").count().collect():
        sizes[r["group"]] = r["count"]
    return Labelled([r["lang"] for r in counts], rows, sizes)


def _predict(model: Centroids, texts: list) -> tuple[list, list, list]:
    """Languages, cosines and rejections of texts."""
    lettered = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    lang, score, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    for begin in range(0, len(lettered), 64):
        part = lettered[begin : begin + 64]
        near, cosine = model.nearest(np.stack([ngram_counts(texts[i].encode("utf-8", "replace")) for i in part]).astype(np.float32))
        for i, n, c in zip(part, near.tolist(), cosine.tolist()):
            lang[i], score[i], out[i] = model.languages[n], c, c < model.floors[n]
    return lang, score, out


def identify_languages(
    docs: DataFrame, held_out=None, a_language: int | None = None, clusters: int = 3, slack: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) for every row of docs.

    The centroids are fitted on all labelled rows outside held_out (a column over the id; null: nothing is held
    out; with a_language on about so many a language), and broadcast: clusters * DIMS floats a language.
    lang_pred is the language of the nearest centroid by cosine, score that cosine; a text that is null or
    has no letter gets und and score 0. rejected: und, or farther from every centroid than the nearest
    language's floor allows. Where no labelled row exists everything is und. Predictions use the text alone;
    repeated rows and rows with a null id each give a row; an empty table gives none; other columns are not
    read. Texts are read whole and never shuffled."""
    held_out = held_out or (lambda i: F.lit(False))
    model = fit(labelled_sample(docs, id_col, text_col, lang_col, held_out, a_language), clusters, slack)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        for batch in batches:
            found = _predict(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found, (pa.string(), pa.float64(), pa.bool_()))], [id_col, "held_out", "lang_pred", "score", "rejected"])

    schema = f"`{id_col}` {sql_type(docs, id_col)}, held_out boolean, lang_pred string, score double, rejected boolean"
    return docs.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)), text_col).mapInArrow(predicted, schema)


def keep_identified(docs: DataFrame, a_language: int | None = None, clusters: int = 3, slack: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with their columns, that identify_languages doesn't reject; nothing is held out.

    Null and empty texts and those without a letter go. Repeated rows and rows with a null id are decided each;
    an empty table gives no rows; columns may have any names."""
    model = fit(labelled_sample(docs, id_col, text_col, lang_col, lambda i: F.lit(False), a_language), clusters, slack)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches):
        for batch in batches:
            _, _, out = _predict(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([not x for x in out], pa.bool_()))

    # Numbered names, as mapInArrow doesn't take every character that a column's name may hold.
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return rows.mapInArrow(kept, rows.schema).toDF(*docs.columns)
