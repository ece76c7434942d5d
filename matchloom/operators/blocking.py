"""Candidate pairs from keys: equi-joins on (rule, key), with caps applied before the join that they bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = "entity_id"


def sources(keys: DataFrame, left: str = "S1") -> tuple[DataFrame, DataFrame]:
    """The keys of one source and of all others, with the ids named for a pair."""
    s = keys.where(F.col("source") == left).select(F.col(ID).alias("s1_id"), "rule", "key")
    t = keys.where(F.col("source") != left).select(F.col(ID).alias("cand_id"), F.col("source").alias("target"), "rule", "key")
    return s, t


def cap_blocks(targets: DataFrame, most: int, by=("rule", "key")) -> DataFrame:
    """Blocks of the target side with more than `most` rows are left out as a whole.

    The sizes are an aggregate, combined before its shuffle, and the join keeps small blocks alone: the
    rows of a hot block never meet in one task."""
    small = targets.groupBy(*by).count().where(F.col("count") <= most).drop("count")
    return targets.join(small, list(by), "left_semi")


def stride_sample(rows: DataFrame, by, order: Column, most: int) -> DataFrame:
    """Of a bucket with n > most rows, every (n div most)-th in that order, `most` in all."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumns({"_pos": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.expr(f"cast(_n div {most} as int)"))
    return numbered.where((F.col("_n") <= most) | ((F.col("_pos") % step == 0) & (F.expr(f"_pos div greatest(1, cast(_n div {most} as int))") < most))).drop("_pos", "_n")


def candidates(keys: DataFrame, most: int = 100, left: str = "S1") -> DataFrame:
    """H1, H2, K2: distinct (s1_id, cand_id) of all rules, hot target blocks left out."""
    s, t = sources(keys, left)
    return s.join(cap_blocks(t, most), ["rule", "key"]).select("s1_id", "cand_id").distinct()


def pairs_with_rules(keys: DataFrame, left: str = "S1", most: int | None = None) -> DataFrame:
    """(s1_id, cand_id, target, rule) for every key in common; with `most`, without target blocks of more rows."""
    s, t = sources(keys, left)
    if most is not None:
        t = cap_blocks(t, most)
    return s.join(t, ["rule", "key"]).select("s1_id", "cand_id", "target", "rule")


def top_per_entity(pairs: DataFrame, score: Column, most: int, by=("s1_id",)) -> DataFrame:
    """Each entity's `most` best pairs, ties to the smaller candidate id; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(score.desc(), "cand_id")
    return pairs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def stop_tokens(tokens: DataFrame, most: int, key: str = "key") -> DataFrame:
    """The tokens that more than `most` rows have."""
    return tokens.groupBy(key).count().where(F.col("count") > most).select(key)


def token_candidates(keys: DataFrame, most: int = 60, stop: int = 5000, overflow: str = "drop", left: str = "S1") -> DataFrame:
    """H4: pairs that share a token, without tokens that over `stop` targets have.

    An entity with more than `most` pairs loses them all (overflow="drop") or keeps those with most
    tokens in common (overflow="topk")."""
    s, t = sources(keys, left)
    common = stop_tokens(t, stop)
    s, t = s.join(common, "key", "left_anti"), t.join(common, "key", "left_anti")
    pairs = s.join(t, "key").groupBy("s1_id", "cand_id").agg(F.count("*").alias("shared"))
    if overflow == "topk":
        return top_per_entity(pairs, F.col("shared"), most).select("s1_id", "cand_id")
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("s1_id"))).where(F.col("n") <= most).select("s1_id", "cand_id")


def flagged(pairs: DataFrame, rules: list[str]) -> DataFrame:
    """One row a pair with a 0/1 flag for each rule."""
    flags = [F.max((F.col("rule") == r).cast("int")).alias(r) for r in rules]
    return pairs.groupBy("s1_id", "cand_id", "target").agg(*flags).withColumnRenamed("target", "source")


def topk_candidates(keys: DataFrame, records: DataFrame, score, per_rule: int = 30, most: int = 100, left: str = "S1") -> DataFrame:
    """Stride-sampled target blocks, joined, distinct, scored, and the best `most` of each entity and source.

    score: a function of two structs of record columns; give records that hold only what it reads. The sample bounds every block to per_rule rows
    before the join, so a join row count is at most per_rule for each key of an entity."""
    s, t = sources(keys, left)
    t = stride_sample(t, ("rule", "target", "key"), F.col("cand_id"), per_rule)
    pairs = s.join(t, ["rule", "key"]).select("s1_id", "cand_id", "target").distinct()
    whole = F.struct(*[F.col(c) for c in records.columns])
    a, b = records.select(F.col(ID).alias("s1_id"), whole.alias("a")), records.select(F.col(ID).alias("cand_id"), whole.alias("b"))
    scored = pairs.join(a, "s1_id").join(b, "cand_id").select("s1_id", "cand_id", F.col("target").alias("source"), score(F.col("a"), F.col("b")).alias("score"))
    return top_per_entity(scored, F.col("score"), most, ("s1_id", "source"))


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """H9: pairs with both records as structs a and b."""
    whole = F.struct(*[F.col(c) for c in records.columns])
    return pairs.join(records.select(F.col(ID).alias("s1_id"), whole.alias("a")), "s1_id").join(records.select(F.col(ID).alias("cand_id"), whole.alias("b")), "cand_id")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where the truth has them."""
    known = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_id").alias("cand_id")).distinct().withColumn("label", F.lit(1))
    return pairs.join(known, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
