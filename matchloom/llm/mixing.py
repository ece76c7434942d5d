"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import topics as topic_model
from .shared import all_columns, bounded_batches, own_name, whole_text, written

DIMENSIONS = ("source", "lang", "topic")
#: Up to so many cells are raked in one task and broadcast; more are raked by aggregates and joined.
FEW_CELLS = 50_000


def target_shares(tokens: dict[str, float], target: dict[str, float] | None, temper: float) -> dict[str, float]:
    """A share for each value that has tokens; they sum to 1.

    With a dict, values it doesn't name share what it leaves of 1, by their tokens. Without one, shares are
    the observed ones to the power `temper`."""
    seen = {v: t for v, t in tokens.items() if t > 0}
    if target is None:
        raw = {v: float(t) ** temper for v, t in seen.items()}
    else:
        left = max(0.0, 1.0 - sum(target.values()))
        free = sum(t for v, t in seen.items() if v not in target) or 1
        raw = {v: float(target[v]) if v in target else t * left / free for v, t in seen.items()}
    total = sum(raw.values()) or 1.0
    return {v: r / total for v, r in raw.items()}


def rake_cells(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], sweeps: int, tolerance: float) -> np.ndarray:
    """The tokens of cells, scaled one dimension after the other until each dimension's shares are met.

    codes[d][i]: cell i's value of dimension d; shares[d][value]. It ends when no share is off by more than
    `tolerance`, or after `sweeps` (targets that contradict each other have no solution; the last dimension
    is then met exactly)."""
    weight, total = tokens.astype(float), tokens.sum()
    for _ in range(sweeps if total else 0):
        for code, share in zip(codes, shares):
            have = np.bincount(code, weight, len(share))
            weight = weight * np.divide(share * total, have, out=np.zeros(len(share)), where=have > 0)[code]
        off = [np.abs(np.bincount(code, weight, len(share)) / total - share).max(initial=0) for code, share in zip(codes[:-1], shares[:-1])]
        if max(off, default=0.0) <= tolerance:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, keep: float) -> np.ndarray:
    """min(1, s * weight / tokens) for each cell, s such that `keep` of all tokens are expected."""
    ratio = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    scale, full, total = 0.0, -1, tokens.sum()
    while True:
        at_one = ratio * scale >= 1
        free = weight[~at_one].sum()
        if at_one.sum() == full or free <= 0:
            return np.minimum(1.0, ratio * scale)
        full, scale = at_one.sum(), max(0.0, keep * total - tokens[at_one].sum()) / free


def _in_one_task(cells: DataFrame, targets: dict, keep: float, temper: float, sweeps: int, tolerance: float) -> DataFrame:
    names = [f"share_{d}" for d in DIMENSIONS] + ["weight", "probability"]

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([(d, "ascending") for d in DIMENSIONS])
        tokens = table.column("tokens").to_numpy().astype(float)
        codes, shares = [], []
        for d in DIMENSIONS:
            column = table.column(d).combine_chunks().dictionary_encode()
            values, code = column.dictionary.to_pylist(), column.indices.to_numpy()
            goal = target_shares(dict(zip(values, np.bincount(code, tokens, len(values)).tolist())), targets.get(d), temper)
            codes.append(code)
            shares.append(np.array([goal.get(v, 0.0) for v in values]))
        weight = rake_cells(tokens, codes, shares, sweeps, tolerance)
        for name, x in zip(names, [*(s[c] for s, c in zip(shares, codes)), weight, calibrate(tokens, weight, keep)]):
            table = table.append_column(name, pa.array(x, pa.float64()))
        yield from table.combine_chunks().to_batches()

    schema = T.StructType([*cells.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return cells.coalesce(1).mapInArrow(fitted, schema)


def _by_aggregates(cells: DataFrame, targets: dict, keep: float, temper: float, sweeps: int, tolerance: float) -> DataFrame:
    """The same for any number of cells: each dimension's step is an aggregate, a join and a written table."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        seen = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t"))
        seen, target = written(seen.where("t > 0"), "values"), targets.get(d)
        if target is None:
            raw = seen.select("value", F.pow(F.col("t").cast("double"), temper).alias("raw"))
        else:
            named = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], "value string, named double")
            both = seen.join(named, "value", "left")
            free = both.agg(F.sum(F.when(F.col("named").isNull(), F.col("t")))).first()[0] or 1
            raw = both.select("value", F.coalesce("named", F.col("t") * (max(0.0, 1.0 - sum(target.values())) / free)).alias("raw"))
        raw = written(raw, "targets")
        whole = raw.agg(F.sum("raw")).first()[0] or 1.0
        share = raw.select(F.col("value").alias(d), (F.col("raw") / whole).alias(f"share_{d}"))
        now = written(now.join(share, d, "left").fillna(0.0, [f"share_{d}"]), "weights")
    for _ in range(sweeps if total else 0):
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(F.sum("weight").alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"share_{d}") * total / F.col("have")).otherwise(0.0)
            now = written(now.join(have, d).withColumn("weight", F.col("weight") * factor).drop("have"), "weights")
        off = [now.groupBy(d).agg(F.abs(F.sum("weight") / total - F.first(f"share_{d}")).alias("off")).agg(F.max("off")).first()[0] or 0.0 for d in DIMENSIONS[:-1]]
        if max(off) <= tolerance:
            break
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    now, scale, full = written(now.withColumn("ratio", ratio), "ratios"), 0.0, -1
    while True:
        at_one = F.col("ratio") * scale >= 1
        sums = [F.sum(F.when(at_one, F.col("tokens"))).alias("full"), F.sum(F.when(~at_one, F.col("weight"))).alias("free"), F.count_if(at_one).alias("n")]
        r = now.agg(*sums).first()
        if r["n"] == full or not r["free"]:
            break
        full, scale = r["n"], max(0.0, keep * total - (r["full"] or 0)) / r["free"]
    return now.select(*cells.columns, *(f"share_{d}" for d in DIMENSIONS), "weight", F.least(F.lit(1.0), F.col("ratio") * scale).alias("probability"))


def fit_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.8, temper: float = 0.7, sweeps: int = 50, tolerance: float = 1e-9, few: int = FEW_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens, ...) with share_source, share_lang, share_topic (the targets), weight
    (raked tokens) and probability, written. Up to `few` cells are raked in one task, in the same steps."""
    cells = written(cells, "cells")
    make = _in_one_task if cells.count() <= few else _by_aggregates
    return written(make(cells, targets or {}, keep, temper, sweeps, tolerance), "chances")


def marginals(fitted: DataFrame) -> DataFrame:
    """(dimension, value, tokens, target, raked, realised) of fit_cells' result.

    target, raked and realised are shares: what was asked for, what the weights have, and what sampling
    with the probabilities is expected to give (less than raked where a probability reaches 1)."""
    sums = fitted.agg(F.sum("weight").alias("w"), F.sum(F.col("tokens") * F.col("probability")).alias("p")).first()
    parts = [
        fitted.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(
            F.sum("tokens").alias("tokens"), F.first(f"share_{d}").alias("target"), (F.sum("weight") / (sums["w"] or 1.0)).alias("raked"),
            (F.sum(F.col("tokens") * F.col("probability")) / (sums["p"] or 1.0)).alias("realised"),
        )
        for d in DIMENSIONS
    ]
    return parts[0].union(parts[1]).union(parts[2])


def uniform(id_col: str, seed: str) -> Column:
    """A number from 0 to under 1 that the id and the seed fix."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


#: What mix adds to a document.
ADDED = ("mix_topic", "mix_tokens", "mix_probability", "mix_kept")


def _mixed(
    docs: DataFrame, columns: list[str] | None, names: list[str], targets, keep: float, temper: float, tokens: Column | None, topic: Column | None, id_col: str, text_col: str, seed: str, tolerance: float
) -> DataFrame:
    """The columns of docs (None: all) and the four added columns under those names, none of which docs has."""
    bounded_batches(docs)
    columns = docs.columns if columns is None else columns
    own, both, chance = [own_name(docs, f"mix_{d}_value") for d in DIMENSIONS], own_name(docs, "mix_both"), own_name(docs, "mix_uniform")
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.withColumns({own[0]: value("source"), own[1]: value("lang"), chance: uniform(id_col, seed)})
    extra = {both: topic_model.words_of(text_col)} if tokens is None or topic is None else {}
    rows = rows.withColumns(extra | ({own[2]: topic} if topic is not None else {}) | ({names[1]: tokens} if tokens is not None else {}))
    # Written, as texts are looked at once: the topics are learned, the cells counted and the rows decided from this.
    passed = [f"c{i}" for i in range(len(columns))]
    given = [*own[:2], chance, *extra, *([own[2]] if topic is not None else []), *([names[1]] if tokens is not None else [])]
    rows = written(rows.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(columns, passed)], *[F.col(g) for g in given]), "looked_at", "zstd")
    if topic is None:
        topic = topic_model.fit_found(rows.select(f"{both}.slots", f"{both}.weights")).of(docs.sparkSession, F.col(f"{both}.slots"), F.col(f"{both}.weights"))
        rows = rows.withColumn(own[2], topic)
    rows = rows.withColumns({names[1]: F.col(names[1] if tokens is not None else f"{both}.tokens")})
    cells = rows.select(*[F.col(o).alias(d) for o, d in zip(own, DIMENSIONS)], F.col(names[1]).alias("tokens"))
    cells = cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    chances = fit_cells(cells, targets, keep, temper, tolerance=tolerance)
    chances = chances.select(*[F.col(d).alias(o) for o, d in zip(own, DIMENSIONS)], F.col("probability").alias(names[2]))
    few = chances.count() <= FEW_CELLS
    out = rows.join(F.broadcast(chances) if few else chances, own)
    kept = (F.col(names[1]) > 0) & (F.col(chance) < F.col(names[2]))
    return out.select(*[F.col(p).alias(c) for p, c in zip(passed, columns)], F.col(own[2]).alias(names[0]), F.col(names[1]), F.col(names[2]), kept.alias(names[3]))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.8, temper: float = 0.7, tokens: Column | None = None, topic: Column | None = None,
    columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", tolerance: float = 1e-9,
) -> DataFrame:
    """docs, or the given columns of it, with mix_topic, mix_tokens, mix_probability and mix_kept.

    targets: for source, lang and topic the share of tokens of each value (see target_shares for what isn't
    named). The cells of the three are raked to them, and every document is kept with its cell's probability, by a
    keyed hash of its id: the same document is always decided alike, and one with a null id by the hash of
    an empty one. topic: a column, by default the nearest of eight centroids clustered on all whole texts
    (topics.fit); tokens: by default the words between white space. Null values, and those of a
    column that docs lacks, form a value of their own, ''. A document without tokens (a null, empty or blank
    text) has no weight and is not kept; its topic is 'none'. Repeated rows count each; an empty table gives no
    rows. All other columns pass through; ones that have the names of the four are replaced. Texts are not shuffled
    and looked at once; the rows are written with what was found. The cells are broadcast while they number at
    most FEW_CELLS, else joined. marginals(fit_cells(...)) tells
    what the targets, the raked weights and the sample have."""
    docs = docs.drop(*ADDED)
    return _mixed(docs, columns, list(ADDED), targets, keep, temper, tokens, topic, id_col, text_col, seed, tolerance)


def mixed_sample(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.8, temper: float = 0.7, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix"
) -> DataFrame:
    """The rows of docs, with their columns and whatever their names, that mix keeps; see there for nulls, texts
    without words, repeated rows and empty tables."""
    names = [own_name(docs, n) for n in ADDED]
    return _mixed(docs, None, names, targets, keep, temper, None, None, id_col, text_col, seed, 1e-9).where(F.col(names[3])).select(*all_columns(docs))
