"""Splits, training pairs and the classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import labelled


def keyed(seed: str, *columns: Column) -> Column:
    """A pseudo-random order that the seed fixes."""
    return F.md5(F.concat_ws("|", *columns, F.lit(seed)))


def lowest(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows with the smallest keyed order, for any n.

    A histogram over the order's first four digits, 65,536 counts whatever the table's size, tells which
    rows are in; only those of the one prefix that holds the cut are sorted. A plain sorted limit would bring
    all n rows to one task."""
    keyed_ = rows.withColumn("_k", order)
    begin = F.substring("_k", 1, 4)
    left = n
    for prefix, count in sorted((r[0], r[1]) for r in keyed_.groupBy(begin).count().collect()):
        if count > left:
            inside = keyed_.where(begin == prefix).orderBy("_k", *rows.columns).limit(left)
            return keyed_.where(begin < prefix).unionByName(inside).drop("_k")
        left -= count
    return rows


def sample(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """N rows in a fixed pseudo-random order."""
    return lowest(rows, order, n)


def split(ids: DataFrame, share: float = 0.9, seed: str = "42", column: str = "entity_id") -> DataFrame:
    """Ids with is_train, exactly int(share * n) of them, in a keyed order."""
    own = ids.select(column)
    chosen = lowest(own, keyed(seed, F.col(column)), int(share * own.count())).withColumn("is_train", F.lit(True))
    return own.join(chosen, column, "left").select(column, F.coalesce("is_train", F.lit(False)).alias("is_train"))


def hash_split(ids: DataFrame, share: float = 0.9, seed: str = "42", column: str = "entity_id") -> DataFrame:
    """J8 on entities: the scalable split, by a hash bucket; shares hold on average."""
    bucket = F.conv(F.substring(keyed(seed, F.col(column)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return ids.select(column, (bucket < share).alias("is_train"))


def positives(truth: DataFrame, train_ids: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs of the training entities whose target exists."""
    pairs = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_id").alias("cand_id")).distinct()
    pairs = pairs.join(train_ids.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    return pairs.join(targets.select(F.col("entity_id").alias("cand_id"), F.col("source")), "cand_id").select("s1_id", "cand_id", "source")


def hard_negatives(pos: DataFrame, candidates: DataFrame, a_positive: int = 4) -> DataFrame:
    """For each positive pair the first a_positive candidates of its entity and source that aren't true.

    candidates: (s1_id, cand_id, source, score), made once for an entity however many positives it has."""
    wrong = candidates.join(pos.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    w = Window.partitionBy("s1_id", "source").orderBy(F.desc("score"), "cand_id")
    first = wrong.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= a_positive)
    return pos.select("s1_id", F.col("cand_id").alias("pos_id"), "source").join(first, ["s1_id", "source"]).select("s1_id", "pos_id", "source", "cand_id", "rank")


def training_pairs(pos: DataFrame, candidates: DataFrame, a_positive: int = 4) -> DataFrame:
    """Positives and hard negatives, each pair once."""
    neg = hard_negatives(pos, candidates, a_positive).select("s1_id", "cand_id", "source", F.lit(0).alias("label"))
    return pos.withColumn("label", F.lit(1)).unionByName(neg).groupBy("s1_id", "cand_id", "source").agg(F.max("label").alias("label"))


def sampled_negatives(pairs: DataFrame, a_positive: int = 8, seed: str = "42") -> DataFrame:
    """All positives and a_positive times as many negatives, in a keyed order."""
    n = pairs.where("label = 1").count() * a_positive
    return pairs.where("label = 1").unionByName(sample(pairs.where("label = 0"), keyed(seed, F.col("s1_id"), F.col("cand_id")), n))


def training_frame(pairs: DataFrame, truth: DataFrame, a_positive: int = 8, seed: str = "42") -> DataFrame:
    """N3."""
    return sampled_negatives(labelled(pairs, truth), a_positive, seed)


def anchored_sample(left: DataFrame, targets: DataFrame, truth: DataFrame, n: int, distractors: int, seed: str = "42") -> DataFrame:
    """N entities, their true matches and so many other targets, so that recall can still be measured."""
    own = sample(left, keyed(seed, F.col("entity_id")), n)
    true = truth.join(own.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi").select(F.col("matched_entity_id").alias("entity_id")).distinct()
    matched = targets.join(true, "entity_id", "left_semi")
    others = sample(targets.join(true, "entity_id", "left_anti"), keyed(seed, F.col("entity_id")), distractors)
    return own.unionByName(matched).unionByName(others).dropDuplicates(["entity_id"])


def train(frame: DataFrame, features: list[str], max_iter: int = 20, max_depth: int = 5, step: float = 0.1, seed: int = 42, validation: str | None = None, **options) -> PipelineModel:
    """Boosted trees on the named feature columns; validation names a boolean column for early stopping."""
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, **options)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(frame)


def scored(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Pairs with the probability of a match."""
    out = model.transform(pairs)
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str], top: int = 10) -> list[tuple[str, float]]:
    """I29."""
    found = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, found)), key=lambda x: (-x[1], x[0]))[:top]
