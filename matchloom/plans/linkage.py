"""The whole linkage: records and truth in, a model, a threshold, match and candidate lists out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, evaluation, features, keys, submission, training
from ..sources import sinks, tables


@dataclass
class Settings:
    """Caps and sizes. country_in_key and fixed F0.5 are the defaults; train_share splits entities, not pairs."""

    per_rule: int = 30
    candidates: int = 100
    negatives_a_positive: int = 4
    train_share: float = 0.9
    max_iter: int = 20
    max_depth: int = 5
    country_in_key: bool = True
    kernels: bool = True
    seed: str = "42"
    grid: range = field(default_factory=lambda: evaluation.GRID)


@dataclass
class Linkage:
    model: PipelineModel
    threshold: float
    scores: DataFrame
    metrics: dict
    columns: list[str]


def candidate_pairs(records: DataFrame, settings: Settings, folder: str | None = None) -> DataFrame:
    """(s1_id, cand_id, source, score, a, b): each entity's best candidates with both records.

    They are ranked by their token sets; character kernels meet only what is left. With a folder the normal
    records are written there once; else each of the joins makes them again."""
    made = keys.matcher_features(records)
    if folder:
        made = tables.cached(records.sparkSession, f"{folder}/records", lambda: keys.matcher_features(records))
    long = keys.keys_matcher(made, settings.country_in_key)
    narrow = made.select("entity_id", *features.JACCARD_COLUMNS)
    return blocking.with_records(blocking.topk_candidates(long, narrow, features.jaccard_score, settings.per_rule, settings.candidates), made)


def pair_frame(pairs: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    made = (features.matcher_features if settings.kernels else features.native_features)(F.col("a"), F.col("b"))
    return pairs.select("s1_id", "cand_id", "source", F.col("score").alias("cheap"), *[c.cast("double").alias(n) for n, c in made.items()]), list(made)


def scored_frame(records: DataFrame, settings: Settings, folder: str | None) -> tuple[DataFrame, list[str]]:
    """The candidates with their features, written to folder once, as every step after passes over them."""
    frame, columns = pair_frame(candidate_pairs(records, settings, folder), settings)
    return (tables.cached(records.sparkSession, f"{folder}/pairs", lambda: frame) if folder else frame), columns


def fit(records: DataFrame, truth: DataFrame, folder: str, settings: Settings | None = None) -> Linkage:
    """Candidates once for every entity, trained on the one part of the entities, tuned on the other."""
    s = settings or Settings()
    spark = records.sparkSession
    frame, columns = scored_frame(records, s, folder)
    own = training.hash_split(records.where("source = 'S1'").select("entity_id"), s.train_share, s.seed)
    train_ids, held_ids = own.where("is_train"), own.where("NOT is_train")
    if tables.exists(spark, f"{folder}/model/metadata/_SUCCESS"):
        model = sinks.load_model(f"{folder}/model")
    else:
        ranked = frame.select("s1_id", "cand_id", "source", F.col("cheap").alias("score"))
        chosen = training.training_pairs(training.positives(truth, train_ids, records), ranked, s.negatives_a_positive)
        rows = frame.join(chosen.select("s1_id", "cand_id", "label"), ["s1_id", "cand_id"])
        model = training.train(tables.cached(spark, f"{folder}/training", lambda: rows), columns, s.max_iter, s.max_depth)
        sinks.save_model(model, f"{folder}/model")
    held = frame.join(held_ids.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    held = tables.cached(spark, f"{folder}/validation", lambda: blocking.labelled(training.scored(model, held), truth))
    held_truth = truth.join(held_ids.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    scores = tables.cached(spark, f"{folder}/grid", lambda: evaluation.macro_f05(evaluation.entity_counts(held, held_truth, held_ids, s.grid), grid=s.grid))
    best = evaluation.best_threshold(scores)
    threshold = best.first()["threshold"]
    metrics = evaluation.metrics_document(best, evaluation.pair_metrics(held, threshold), held_ids.count(), held.count())
    return Linkage(model, threshold, scores, metrics, columns)


def predict(records: DataFrame, linkage: Linkage, settings: Settings | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Match lists and candidate lists, a row for every S1 record."""
    s = settings or Settings()
    frame, _ = scored_frame(records, s, folder)
    scored = training.scored(linkage.model, frame).select("s1_id", "cand_id", "score")
    entities = records.where("source = 'S1'").select("entity_id")
    return submission.match_lists(scored, entities, linkage.threshold), submission.ranked_lists(scored, entities, name="candidate_entity_ids")


STAGES = ("candidates", "train", "infer")


def _records(spark: SparkSession, sources: list[str], multi_line: bool) -> DataFrame:
    records = tables.read_records(spark, sources[0], multi_line)
    for path in sources[1:]:
        records = records.unionByName(tables.read_records(spark, path, multi_line))
    return records


def run(
    spark: SparkSession, sources: list[str], truth: str, out: str, settings: Settings | None = None, stage: str = "all", test_sources: list[str] | None = None, multi_line: bool = False
) -> dict:
    """From tab-separated files to a saved model, two lists that are checked, and the validation's figures.

    stage: candidates (pairs with features), train (model, threshold, metrics.json), infer (the lists for
    test_sources, by default the same sources) or all. What a stage has written under out is not made again, so a
    run that was stopped goes on; another out starts afresh. Lists that break a rule are not written."""
    if stage not in ("all", *STAGES):
        raise ValueError(f"stage must be all or one of {', '.join(STAGES)}")
    s = settings or Settings()
    records = _records(spark, sources, multi_line)
    if stage == "candidates":
        return {"candidate_pairs": scored_frame(records, s, out)[0].count()}
    pairs = tables.truth_pairs(tables.read_tsv(spark, truth, tables.TRUTH))
    linkage = fit(records, pairs, out, s)
    sinks.write_json(spark, linkage.metrics, f"{out}/metrics.json")
    sinks.write_report(linkage.scores.orderBy("threshold"), f"{out}/thresholds")
    if stage == "train":
        return linkage.metrics
    asked = _records(spark, test_sources, multi_line) if test_sources else records
    # The same records have their pairs already.
    matches, candidates = predict(asked, linkage, s, f"{out}/inference" if test_sources else out)
    matches = tables.cached(spark, f"{out}/checked/matches", lambda: matches)
    candidates = tables.cached(spark, f"{out}/checked/candidates", lambda: candidates)
    found = submission.violations(matches, candidates, asked.where("source = 'S1'"), asked.where("source <> 'S1'")).where("violations > 0").collect()
    if found:
        raise ValueError("the lists break rules: " + ", ".join(f"{r['rule']} {r['violations']}" for r in found))
    sinks.write_tsv(matches, f"{out}/matching_results")
    sinks.write_tsv(candidates, f"{out}/candidate_pairs")
    return linkage.metrics


def main(argv: list[str] | None = None) -> None:
    import argparse

    parser = argparse.ArgumentParser(prog="matchloom.plans.linkage", description="Links the records of three sources.")
    parser.add_argument("--sources", nargs="+", required=True)
    parser.add_argument("--truth", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--test-sources", nargs="+")
    parser.add_argument("--stage", choices=["all", *STAGES], default="all")
    parser.add_argument("--multi-line", action="store_true", help="values may hold line breaks")
    a = parser.parse_args(argv)
    print(run(SparkSession.builder.getOrCreate(), a.sources, a.truth, a.out, None, a.stage, a.test_sources, a.multi_line))


if __name__ == "__main__":
    main()
