"""Match and candidate lists, one row for each entity, and the rules that they must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens


def match_lists(scored: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """Ids from the threshold on, sorted, joined by commas; empty for an entity without any."""
    lists = scored.where(F.col("score") >= threshold).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))
    return _every(lists, entities, "matched_entity_ids")


def ranked_lists(scored: DataFrame, entities: DataFrame, threshold: float = 0.0, name: str = "matched_entity_ids") -> DataFrame:
    """Ids by falling score, ties by id."""
    best = scored.where(F.col("score") >= threshold).groupBy("s1_id", "cand_id").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("cand_id").alias("i"))))
    return _every(best.groupBy("s1_id").agg(F.array_join(F.transform(order, lambda x: x["i"]), ",").alias("ids")), entities, name)


def _every(lists: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    own = entities.select(F.col("entity_id").alias("source1_entity_id"))
    return own.join(lists.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias(name))


def violations(lists: DataFrame, candidates: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """A count for each rule; all are 0 in a valid submission (the last one is a warning)."""
    own = lists.select("source1_entity_id", tokens.id_list(F.col("matched_entity_ids")).alias("ids"))
    long = own.select("source1_entity_id", F.explode("ids").alias("id"))
    offered = candidates.select("source1_entity_id", F.explode(tokens.id_list(F.col("candidate_entity_ids"))).alias("id"))
    n = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    left = entities.select(F.col("entity_id").alias("source1_entity_id"))
    return (
        n(left.join(own, "source1_entity_id", "left_anti"), "missing_entity")
        .unionByName(n(own.join(left, "source1_entity_id", "left_anti"), "unknown_entity"))
        .unionByName(n(own.groupBy("source1_entity_id").count().where("count > 1"), "repeated_entity"))
        .unionByName(n(own.where(tokens.has_repeats(F.col("ids"))), "repeated_id"))
        .unionByName(n(own.where(~tokens.prefixes_valid(F.col("ids"))), "bad_prefix"))
        .unionByName(n(long.join(targets.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_id"))
        .unionByName(n(long.join(offered, ["source1_entity_id", "id"], "left_anti"), "not_a_candidate"))
    )
