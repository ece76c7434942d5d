"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import exact_dedup, language_id, licenses, lm_scoring, mixing, near_dedup, packing, token_counts, topk, training_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, bucket string, same string, rank string, mix_kept string, own_digest string, `a.b` string"
LONG = "der lange text hat viele woerter und noch mehr davon " * 6000


@pytest.fixture(scope="module")
def odd(spark):
    base = [
        (1, None, "en", "s"), (2, "", "en", None), (3, " \t\n", None, "s"), (4, LONG, "de", "s"), (5, LONG, "de", "s"), (6, "the same short text of six words", "en", "s"),
        (6, "the same short text of six words", "en", "s"), (7, "the  same short text of six\nwords", "en", "t"), (None, "a row without an id has words", "en", "t"), (8, "12345 !!! 678", "en", "t"),
        (9, "x" * 50_000, "en", "t"), (10, "one two", "en", "t"), (11, "ONE two", "en", "t"), (12, "été déjà <|endoftext|> 中文 नमस्ते", "fr", "t"), (13, "½ ² ①", "en", "t"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "i", "k", "b", "s", "r", "m", "o", "dot") for r in base], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


OPERATORS = {
    "1": packing.pack_power_of_two, "2": near_dedup.near_duplicates, "4": mixing.mix, "5": lm_scoring.score_texts, "6": language_id.identify_languages,
    "7": training_order.write_training_order, "8": exact_dedup.content_groups, "9": token_counts.count_tokens, "10": licenses.scan_licenses,
}


@pytest.mark.parametrize("n", OPERATORS)
def test_empty_table(n, none):
    assert OPERATORS[n](none).count() == 0


@pytest.mark.parametrize("n", [n for n in OPERATORS if n not in ("1", "7")])
def test_a_row_for_each_row(n, odd):
    assert OPERATORS[n](odd).count() == odd.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, odd, none, sf_dir):
    assert stage(spark, none, sf_dir).count() == 0
    out = stage(spark, odd, sf_dir)
    out.collect()
    if name != "packed":
        assert out.schema == odd.schema


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_packing(odd):
    rows = packing.pack_power_of_two(odd).collect()
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 1)}
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_near(odd):
    got = by_id(near_dedup.near_duplicates(odd))
    assert [got[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(got[i].kept for i in (1, 2, 3))
    assert got[5].component_id == 4 and not got[5].kept and got[11].component_id == 10 and got[7].component_id == 6
    assert got[None].component_id is None and got[None].kept


def test_exact(odd):
    got = exact_dedup.content_groups(odd)
    rows = by_id(got)
    assert rows[1].group_size == 3 and rows[3].keep_id == 3 and rows[3].kept and not rows[1].kept
    six = got.where("doc_id IN (6, 7)").collect()
    assert all(r.group_size == 3 and r.keep_id == 7 for r in six) and sum(r.kept for r in six) == 1
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.count() == got.where("kept").count() == kept.select("doc_id", "text").distinct().count()


def test_copies_over_many_partitions(spark):
    """A group of copies over several range partitions, with fully equal rows among them."""
    many = [(i // 2, "a" * 50 + " " * (i % 7), "x") for i in range(3000)] + [(10_000 + i, f"text {i % 40}", "y") for i in range(400)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in many], "doc_id long, text string, source string, edge int, part int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = exact_dedup.content_groups(docs).collect()
        kept = exact_dedup.keep_first_copies(docs)
        assert kept.schema == docs.schema
        kept = sorted((r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    best = min((-len(t), i) for i, t, _ in many[:3000])[1]
    assert all(r.keep_id == best and r.group_size == 3000 for r in got if r.doc_id < 10_000) and len(got) == 3400
    assert sum(r.kept for r in got) == 41 and [r.doc_id for r in got if r.kept and r.doc_id < 10_000] == [best]
    assert kept == sorted([(best, "a" * 50 + " " * 6), *((10_000 + i, f"text {i}") for i in range(40))])


def test_scores(odd):
    got = by_id(lm_scoring.score_texts(odd, held_out=lambda i: i == 12))
    assert got[1].n_tokens == 1 and got[1].score == 0 and got[1].bits_per_byte == 0
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got.values())
    assert got[12].held_out and got[12].n_known < got[12].n_tokens


def test_nothing_to_learn_from(odd):
    rows = lm_scoring.score_texts(odd, held_out=lambda i: F.lit(True)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert all(abs(r.bits_per_byte - (8 if r.n_bytes else 0)) < 1e-6 for r in rows)


def test_languages(odd):
    got = by_id(language_id.identify_languages(odd))
    assert [got[i].lang_pred for i in (1, 2, 3, 8, 13)] == ["und"] * 5 and got[4].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixing(odd):
    got = mixing.mix(odd)
    assert got.columns == [c for c in odd.columns if c != "mix_kept"] + list(mixing.ADDED)
    assert all(not r.mix_kept and r.mix_tokens == 0 for r in got.where("doc_id IN (1, 2, 3)").collect())


def test_counts(odd):
    got = by_id(token_counts.count_tokens(odd))
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0 and got[3].n_bytes == 3


def test_order(odd):
    rows = training_order.write_training_order(odd, length=64).orderBy("slot").collect()
    ids = [np.frombuffer(r.ids, np.uint16) for r in rows]
    tokens = token_counts.count_tokens(odd).agg(F.sum("n_tokens")).first()[0]
    assert [r.slot for r in rows] == list(range(len(rows))) and sum(r.n_ids for r in rows) == tokens + odd.count()
    assert sum((x == 1).sum() for x in ids) >= odd.count()


def test_licenses(odd):
    got = by_id(licenses.scan_licenses(odd))
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == ""


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (50, [1e300, 1e300]),
            (51, [-1e300, 1.0]), (3, [0.5, 0.5]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, score int")
    got = {}
    for r in topk.exact_topk(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0] == [(50, topk.LONG.max), (1, 65536), (2, 65536), (3, 32768), (3, 32768)]
    assert [v for v, _ in got[50]] == [0, 1, 2, 3, 3] and got[50][0][1] == topk.LONG.max
    assert got[100][:3] == [(0, 0), (1, 0), (2, 0)]
    assert topk.exact_topk(df.limit(0), lambda i: i % 50 == 0).count() == 0
