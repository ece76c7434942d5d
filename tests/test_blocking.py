"""Caps, samples and estimates against plain Python, and the relations between them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking, keys, profile, training
from matchloom.plans.projection import ent, gt


@pytest.fixture(scope="module")
def long(spark, sf_dir):
    return keys.keys_v1(keys.engineered(ent(spark, sf_dir))).cache()


@pytest.mark.parametrize("n", [1, 7, 29, 30, 31, 59, 60, 61, 95, 1000])
def test_stride_sample(spark, n):
    rows = spark.range(n).select(F.lit("k").alias("key"), "id")
    got = sorted(r.id for r in blocking.stride_sample(rows, ("key",), F.col("id"), 30).collect())
    assert got == (list(range(n)) if n <= 30 else list(range(0, n, max(1, n // 30)))[:30])


def test_a_hot_block_is_left_out_as_a_whole(spark):
    rows = [("S1-0", "S1", "r", "hot"), ("S1-0", "S1", "r", "cold")] + [(f"S2-{i}", "S2", "r", "hot") for i in range(11)] + [("S3-1", "S3", "r", "cold")]
    df = spark.createDataFrame(rows, "entity_id string, source string, rule string, key string")
    assert [r.cand_id for r in blocking.candidates(df, 10).collect()] == ["S3-1"]
    assert blocking.candidates(df, 11).count() == 12


def test_estimate_is_the_size_of_the_join(long):
    estimate = profile.estimated_pairs(long).agg(F.sum("candidate_pairs")).first()[0]
    assert estimate == blocking.pairs_with_rules(long).count()


def test_rules_without_hits_are_reported(spark):
    rows = [("S1-1", "S1", "a", "x"), ("S2-1", "S2", "a", "x"), ("S1-1", "S1", "b", "p"), ("S2-1", "S2", "b", "q"), ("S3-1", "S3", "a", "z")]
    keys_ = spark.createDataFrame(rows, "entity_id string, source string, rule string, key string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], "source1_entity_id string, matched_entity_id string")
    by = lambda df, *c: {tuple(r[x] for x in c[:-1]): r[c[-1]] for r in df.collect()}
    assert by(profile.recall_by_rule(truth, keys_), "target", "rule", "recovered_pairs") == {("S2", "a"): 1, ("S2", "b"): 0, ("S3", "a"): 0, ("S3", "b"): 0}
    assert by(profile.recall_by_entity(truth, keys_), "rule", "fully_recovered_entities") == {("a",): 0, ("b",): 0}
    assert by(profile.estimated_pairs(keys_), "target", "rule", "candidate_pairs") == {("S2", "a"): 1, ("S2", "b"): 0, ("S3", "a"): 0, ("S3", "b"): 0}
    assert by(profile.block_statistics(keys_, ("source", "rule")), "source", "rule", "blocks")[("S3", "b")] == 0


def test_candidates_grow_with_the_cap(long):
    few, many = (blocking.candidates(long, n) for n in (2, 50))
    assert few.count() <= many.count() and few.subtract(many).count() == 0


def test_recall_of_all_rules_is_at_least_that_of_each(spark, sf_dir, long):
    truth = gt(spark, sf_dir)
    whole = profile.candidate_recall(blocking.candidates(long, 10_000), truth).first().recall
    each = profile.recall_by_rule(truth, long).groupBy("rule").agg(F.sum("recovered_pairs").alias("n")).agg(F.max("n")).first()[0]
    assert whole >= 100 * each / truth.count() - 1e-6


@pytest.mark.parametrize("n", [0, 1, 250, 999, 1000, 2000])
def test_lowest(spark, n):
    rng = random.Random(n)
    names = [f"S1-{rng.randrange(10**6)}-{i}" for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in names], "entity_id string").repartition(3)
    got = {r.entity_id for r in training.lowest(df, training.keyed("7", F.col("entity_id")), n).collect()}
    assert got == set(sorted(names, key=lambda x: hashlib.md5(f"{x}|7".encode()).hexdigest())[:n])


def test_token_overflow(spark):
    rows = [("S1-0", "S1", "t", w) for w in "abc"] + [(f"S2-{i}", "S2", "t", w) for i in range(6) for w in "abc"[: 1 + i % 3]]
    df = spark.createDataFrame(rows, "entity_id string, source string, rule string, key string")
    assert blocking.token_candidates(df, 5).count() == 0
    assert {r.cand_id for r in blocking.token_candidates(df, 2, overflow="topk").collect()} == {"S2-2", "S2-5"}
    assert blocking.token_candidates(df, 6, stop=4).count() == 4
    assert blocking.token_candidates(df, 6, stop=3).count() == 2
