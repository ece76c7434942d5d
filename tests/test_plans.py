"""Files in, files out: the whole linkage, sinks, and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import submission
from matchloom.plans import linkage, reports
from matchloom.sources import sinks, tables
from matchloom.streaming import keys as stream


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three sources with noisy copies; texts with tabs, quotes and nothing at all."""
    folder, rng = tmp_path_factory.mktemp("records"), random.Random(8)
    words = ["".join(rng.choices("bcdfgklmnprst", k=2)) + rng.choice("aeiou") + "".join(rng.choices("lmnrst", k=2)) for _ in range(300)]
    rows, truth = {"S1": [], "S2": [], "S3": []}, []
    for i in range(120):
        name, place, country = rng.sample(words, 3), f"{rng.randint(1, 99)} {rng.choice(words)} Road, {560001 + i}", rng.choice(["India", "US"])
        rows["S1"].append((f"S1-{i}", " ".join(name) + " Pvt Ltd", place, country))
        own = []
        for s in ("S2", "S3"):
            if rng.random() < 0.8:
                own.append(f"{s}-{i}")
                rows[s].append((own[-1], " ".join(name) + rng.choice([" Private Limited", "", ' "Group"']), place.replace("Road", "Rd"), country))
            rows[s].append((f"{s}-x{i}", " ".join([name[0], *rng.sample(words, 2)]), f"{rng.randint(1, 99)} {rng.choice(words)} Street", country))
        truth.append((f"S1-{i}", ", ".join(own)))
    rows["S2"].append(("S2-empty", "", "", ""))
    for s, records in rows.items():
        quoted = ["\t".join('"' + c.replace('"', '""') + '"' if '"' in c else c for c in r) for r in records]
        (folder / f"{s}.tsv").write_text("\n".join(["\t".join(tables.RECORD), *quoted]) + "\n", encoding="utf-8")
    (folder / "truth.tsv").write_text("\n".join(["\t".join(tables.TRUTH), *map("\t".join, truth)]) + "\n")
    return folder


def test_linkage(spark, files, tmp_path):
    settings = linkage.Settings(train_share=0.7, max_iter=5, max_depth=3)
    sources, truth, out = [str(files / f"{s}.tsv") for s in ("S1", "S2", "S3")], str(files / "truth.tsv"), str(tmp_path / "out")
    assert linkage.run(spark, sources, truth, out, settings, "candidates")["candidate_pairs"] > 100
    written = {p: (tmp_path / "out" / p / "_SUCCESS").stat().st_mtime_ns for p in ("records", "pairs")}
    metrics = linkage.run(spark, sources, truth, out, settings, "train")
    assert metrics["macro_f05"] > 0.8 and metrics["pairs"]["precision"] > 0.8
    assert not (tmp_path / "out/matching_results").exists()
    # The rest goes on with what is there.
    assert linkage.run(spark, sources, truth, out, settings) == metrics == sinks.read_json(spark, f"{out}/metrics.json")
    assert written == {p: (tmp_path / "out" / p / "_SUCCESS").stat().st_mtime_ns for p in written}
    matches = tables.read_tsv(spark, f"{out}/matching_results", tables.TRUTH)
    candidates = tables.read_tsv(spark, f"{out}/candidate_pairs", ["source1_entity_id", "candidate_entity_ids"])
    records = [tables.read_records(spark, x) for x in sources]
    found = submission.violations(matches, candidates, records[0], records[1].union(records[2]))
    assert matches.count() == 120 and all(r.violations == 0 for r in found.collect())
    with pytest.raises(ValueError):
        linkage.run(spark, sources, truth, out, settings, "other")


def test_lists_that_break_a_rule_are_not_written(spark, files, tmp_path, monkeypatch):
    settings = linkage.Settings(train_share=0.7, max_iter=2, max_depth=2, kernels=False)
    monkeypatch.setattr(submission, "match_lists", lambda scored, entities, t: entities.selectExpr("entity_id AS source1_entity_id", "'X-1' AS matched_entity_ids"))
    with pytest.raises(ValueError, match="bad_prefix"):
        linkage.run(spark, [str(files / f"{s}.tsv") for s in ("S1", "S2", "S3")], str(files / "truth.tsv"), str(tmp_path / "out"), settings)
    assert not (tmp_path / "out/matching_results").exists()


def test_violations_are_found(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    matches = frame([("S1-1", "S2-1,S2-1"), ("S1-1", "X-1"), ("S1-9", "S3-7")], "source1_entity_id string, matched_entity_ids string")
    candidates = frame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_ids string")
    entities, targets = frame([("S1-1",), ("S1-2",)], "entity_id string"), frame([("S2-1",)], "entity_id string")
    got = {r.rule: r.violations for r in submission.violations(matches, candidates, entities, targets).collect()}
    assert got == {"missing_entity": 1, "unknown_entity": 1, "repeated_entity": 1, "repeated_id": 1, "bad_prefix": 1, "unknown_id": 2, "not_a_candidate": 2}


def test_tsv_details(spark, files, tmp_path):
    s2 = tables.read_records(spark, str(files / "S2.tsv"))
    assert s2.where("business_name LIKE '%\"Group\"'").count() > 0
    assert s2.where("entity_id = 'S2-empty'").first().business_name == ""
    assert tables.count_lines(spark, str(files / "S2.tsv")) == s2.count()
    sinks.write_tsv(spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1,S3-1")], "source1_entity_id string, matched_entity_ids string").coalesce(1), str(tmp_path / "t"), one_file=True)
    text = next((tmp_path / "t").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1,S3-1\n"
    assert tables.schema_differences(s2.drop("country"), tables.RECORD) == {"missing": ["country"], "extra": ["source"]}


def test_counted_lines_of_a_folder(spark, tmp_path):
    rows = spark.range(10).selectExpr("cast(id AS string) AS entity_id", "'x' AS business_name")
    for n, df in ((10, rows.repartition(3)), (10, rows.coalesce(1)), (0, rows.limit(0))):
        sinks.write_tsv(df, str(tmp_path / "t"))
        assert tables.count_lines(spark, str(tmp_path / "t")) == n
    (tmp_path / "empty").write_text("")
    assert tables.count_lines(spark, str(tmp_path / "empty")) == 0


def test_awkward_values(spark, tmp_path):
    values = ["a\tb", '"start', 'in "the" middle', '"', '""', "two\nlines", '\t"\n"', "  blanks ", "", "\\", '\\"', "r\rn", "a\r\nb", "'", "#", "é", "\u2028"]
    rows = [(f"S1-{i}", v, v + "x", "US") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, tables.strings(tables.RECORD)).coalesce(1)
    sinks.write_tsv(df, str(tmp_path / "t"))
    got = {r.entity_id: (r.business_name, r.business_address) for r in tables.read_tsv(spark, str(tmp_path / "t"), multi_line=True).collect()}
    assert got == {i: (v, x) for i, v, x, _ in rows}
    plain = df.where(~F.col("business_name").rlike("[\\r\\n]"))
    sinks.write_tsv(plain, str(tmp_path / "p"))
    got = {r.entity_id: r.business_name for r in tables.read_tsv(spark, str(tmp_path / "p")).collect()}
    assert got == {r.entity_id: r.business_name for r in plain.collect()}


def test_cached_and_found(spark, tmp_path, monkeypatch):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    path = str(tmp_path / "cached")
    assert tables.cached(spark, path, make).count() == tables.cached(spark, path, make).count() == 3 and made == [1]
    (tmp_path / "b.tsv").write_text("x")
    assert tables.find_file(str(tmp_path), "a.tsv", "b.tsv").endswith("b.tsv")
    assert tables.find_file("/nowhere", "a.tsv", "b.tsv", fallback=str(tmp_path)).endswith("b.tsv")
    monkeypatch.setenv("PLACE", str(tmp_path))
    assert tables.find_file("/nowhere", "b.tsv", variable="PLACE").startswith(str(tmp_path))


def test_stream(spark, files, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, mark = str(tmp_path / "keys"), str(tmp_path / "mark")
    for s in ("S1", "S2"):
        (folder / f"{s}.tsv").write_bytes((files / f"{s}.tsv").read_bytes())
        stream.write_keys(spark, str(folder), out, mark)
    got = spark.read.parquet(out)
    assert {r.source for r in got.select("source").distinct().collect()} == {"S1", "S2"}
    assert got.count() == got.distinct().count() > 240


def test_reports(spark, files, tmp_path):
    records = tables.read_records(spark, str(files / "S1.tsv")).union(tables.read_records(spark, str(files / "S2.tsv")))
    lists = tables.truth_lists(tables.read_tsv(spark, str(files / "truth.tsv"), tables.TRUTH))
    found = reports.run(spark, records, lists, str(tmp_path / "out"))
    assert found == sinks.read_json(spark, str(tmp_path / "out/summary.json")) and found["s1_records"] == found["ground_truth_records"] == 120
    assert found["s1_singletons"] + found["s1_with_matches"] == 120 and found["total_source_records"] == records.count()
    assert found["s2_only_entities"] + found["s3_only_entities"] + found["both_sources_entities"] == found["s1_with_matches"]
    for name in ("script_distribution", "top_tokens", "abbreviations", "columns", "top_values"):
        assert spark.read.option("header", True).csv(str(tmp_path / f"out/s2_{name}")).count() > 0


def test_early_stopping_bites(spark, sf_dir):
    from matchloom.operators import features, training
    from matchloom.plans import model_queries

    model, frame = model_queries.early_stopped(spark, sf_dir)
    assert 0 < model.stages[-1].getNumTrees < 30
    names = [c for c in frame.columns if c not in ("s1_id", "cand_id", "source", "label")]
    assert names == features.PIPELINE_FEATURES
    first = training.scored(model, frame).toPandas()
    # Scores tell matches from the rest.
    assert first[first.label == 1].score.mean() > 0.7 > 0.3 > first[first.label == 0].score.mean()
