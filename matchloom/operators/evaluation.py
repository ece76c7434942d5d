"""F0.5 over entities and pairs, and the threshold that maximises it, in one pass over the scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds as numerators of fiftieths.
GRID = range(10, 48)
GRID_PIPELINE = range(25, 50)


def fbeta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """O1."""
    b2 = beta * beta
    below = b2 * precision + recall
    return F.when(below > 0, (1 + b2) * precision * recall / below).otherwise(0.0)


def _f05(tp: Column, predicted: Column, true: Column, compat: bool) -> Column:
    """O3, or with compat O2: an entity without truth that has candidates and predicts nothing scores 0."""
    score = fbeta(F.when(predicted > 0, tp / predicted).otherwise(0.0), F.when(true > 0, tp / true).otherwise(1.0))
    return F.when((true == 0) & (predicted == 0), 0.0 if compat else 1.0).otherwise(F.when(tp > 0, score).otherwise(0.0))


def entity_counts(scored: DataFrame, truth: DataFrame, entities: DataFrame, grid=GRID) -> DataFrame:
    """(t, s1_id, tp, predicted, true, candidates) for every threshold t of fiftieths and entity with pairs; an entity
    without any scores alike at each, so it has one row, with a null t.

    One pass: a pair is exploded to the thresholds that it reaches and summed with its entity's others before
    the shuffle."""
    low, high = min(grid), max(grid)
    true = truth.groupBy(F.col("source1_entity_id").alias("s1_id")).agg(F.count_distinct("matched_entity_id").alias("true"))
    known = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_id").alias("cand_id")).distinct().withColumn("hit", F.lit(1))
    pairs = scored.select("s1_id", "cand_id", "score").join(known, ["s1_id", "cand_id"], "left")
    reach = F.sequence(F.lit(low), F.lit(high))
    per = pairs.select("s1_id", "hit", F.filter(reach, lambda t: F.col("score") >= t / 50.0).alias("ts"))
    sums = per.select("s1_id", "hit", F.explode("ts").alias("t")).groupBy("s1_id", "t").agg(F.count("*").alias("predicted"), F.count("hit").alias("tp"))
    with_pairs = pairs.groupBy("s1_id").agg(F.count("*").alias("candidates"))
    every = entities.select(F.col("entity_id").alias("s1_id")).join(true, "s1_id", "left").join(with_pairs, "s1_id", "left")
    every = every.withColumn("t", F.explode_outer(F.when(F.col("candidates").isNotNull(), reach)))
    out = every.join(sums, ["s1_id", "t"], "left").na.fill(0, ["tp", "predicted", "true", "candidates"])
    return out.select("t", "s1_id", "tp", "predicted", "true", "candidates")


def macro_f05(counts: DataFrame, compat: bool = False, grid=GRID) -> DataFrame:
    """O2, O3 for each threshold: the mean over entities.

    An entity without pairs scores 1 where it has no match, else 0, in either way of counting."""
    score = _f05(F.col("tp"), F.col("predicted"), F.col("true"), compat)
    rest = counts.where("t IS NULL").agg(F.count("*").alias("others"), F.count_if(F.col("true") == 0).alias("right"))
    sums = counts.where("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("n"), F.sum(score).alias("total"))
    every = counts.sparkSession.range(min(grid), max(grid) + 1).select(F.col("id").cast("int").alias("t")).join(sums, "t", "left").na.fill(0).join(F.broadcast(rest))
    entities = F.col("n") + F.col("others")
    mean = F.when(entities > 0, F.round((F.col("total") + F.col("right")) / entities, 6))
    return every.select((F.col("t") / 50.0).alias("threshold"), entities.alias("entities"), mean.alias("macro_f05"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The best one, the lowest of equals."""
    return scores.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def pair_metrics(labelled: DataFrame, threshold: float) -> DataFrame:
    """Counts, precision, recall and F0.5 over the candidates."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    n = labelled.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(0.0)
    n = n.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})
    return n.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(fbeta(F.col("precision"), F.col("recall")), 6).alias("f05"))


def metrics_document(best: DataFrame, pairs: DataFrame, entities: int, candidates: int) -> dict:
    """One nested document of the validation's figures."""
    b, p = best.first().asDict(), pairs.first().asDict()
    return {"threshold": b["threshold"], "macro_f05": b["macro_f05"], "pairs": p, "validation_entities": entities, "candidate_pairs": candidates}
