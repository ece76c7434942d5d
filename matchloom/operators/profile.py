"""Profiles and reports: block sizes, recall, distributions. Aggregates combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, tokens
from .blocking import ID, sources

PERCENTILES = {"p90": 0.90, "p95": 0.95, "p99": 0.99}


def block_sizes(keys: DataFrame, by=("rule",)) -> DataFrame:
    """I4: rows of each block."""
    return keys.groupBy(*by, "key").agg(F.count("*").alias("size"))


def _with_zeros(found: DataFrame, keys: DataFrame, by: list[str], fills: dict) -> DataFrame:
    """found, and a row of `fills` for each combination of the keys' sources (but the first) and rules that it lacks.

    Sources and rules are a handful; what a rule gives nothing for belongs in a report as much as the rest."""
    seen = keys.agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_set("source")).alias("sources"))
    every = seen.select(F.explode("rules").alias("rule"), "sources")
    if by != ["rule"]:
        every = every.select("rule", F.explode("sources").alias(by[0]))
        if by[0] == "target":
            every = every.where("target <> 'S1'")
    return every.select(*by).join(found, by, "left").na.fill(fills)


def block_statistics(keys: DataFrame, by=("rule",)) -> DataFrame:
    """Number and sizes of blocks; percentiles interpolate. A rule without blocks in a source has zeros."""
    sizes = block_sizes(keys, by)
    found = sizes.groupBy(*by).agg(
        F.count("*").alias("blocks"), F.sum("size").alias("rows_in_blocks"), F.round(F.avg("size"), 6).alias("mean"), F.percentile("size", F.lit(0.5)).alias("median"),
        *[F.round(F.percentile("size", F.lit(p)), 6).alias(n) for n, p in PERCENTILES.items()], F.max("size").alias("max"),
        F.count_if(F.col("size") > 100).alias("blocks_gt_100"), F.count_if(F.col("size") > 1000).alias("blocks_gt_1000"),
    )
    return _with_zeros(found, keys, list(by), {c: 0 for c in found.columns if c not in by}).select(*found.columns)


def estimated_pairs(keys: DataFrame, left: str = "S1") -> DataFrame:
    """Pairs that each rule would give, from block sizes alone, and their mean over the source's entities."""
    s, t = sources(keys, left)
    a, b = s.groupBy("rule", "key").agg(F.count("*").alias("m")), t.groupBy("target", "rule", "key").agg(F.count("*").alias("n"))
    total = s.select("s1_id").distinct().agg(F.count("*").alias("entities"))
    pairs = b.join(a, ["rule", "key"]).groupBy("target", "rule").agg(F.sum(F.col("m") * F.col("n")).alias("candidate_pairs"))
    pairs = _with_zeros(pairs, keys, ["target", "rule"], {"candidate_pairs": 0})
    mean = F.when(F.col("entities") > 0, F.round(F.col("candidate_pairs") / F.col("entities"), 6)).otherwise(0.0)
    return pairs.join(F.broadcast(total)).select("target", "rule", "candidate_pairs", mean.alias("avg_candidates_per_s1"))


def recall_by_rule(truth: DataFrame, keys: DataFrame) -> DataFrame:
    """Of the true pairs, how many share each rule's key; candidates are never made. A rule that
    recovers none of a target's pairs has a row with 0."""
    pairs = truth.select("source1_entity_id", "matched_entity_id", tokens.source_tag(F.col("matched_entity_id")).alias("target"))
    a = keys.select(F.col(ID).alias("source1_entity_id"), "rule", "key")
    b = keys.select(F.col(ID).alias("matched_entity_id"), F.col("rule"), F.col("key"))
    hits = pairs.join(a, "source1_entity_id").join(b, ["matched_entity_id", "rule", "key"]).groupBy("target", "rule").agg(F.count("*").alias("recovered_pairs"))
    hits = _with_zeros(hits, keys, ["target", "rule"], {"recovered_pairs": 0})
    total = pairs.groupBy("target").agg(F.count("*").alias("total_true_pairs"))
    return hits.join(F.broadcast(total), "target").select("target", "rule", "total_true_pairs", "recovered_pairs", F.round(100 * F.col("recovered_pairs") / F.col("total_true_pairs"), 6).alias("pair_recall"))


def recall_by_entity(truth: DataFrame, keys: DataFrame) -> DataFrame:
    """For each rule the entities all of whose true pairs share its key, 0 where there are none."""
    a = keys.select(F.col(ID).alias("source1_entity_id"), "rule", "key")
    b = keys.select(F.col(ID).alias("matched_entity_id"), F.col("rule"), F.col("key"))
    hits = truth.join(a, "source1_entity_id").join(b, ["matched_entity_id", "rule", "key"]).groupBy("rule", "source1_entity_id").agg(F.count("*").alias("hits"))
    need = truth.groupBy("source1_entity_id").agg(F.count("*").alias("need"))
    whole = hits.join(need, "source1_entity_id").groupBy("rule").agg(F.count_if(F.col("hits") == F.col("need")).alias("fully_recovered_entities"))
    whole = _with_zeros(whole, keys, ["rule"], {"fully_recovered_entities": 0})
    total = need.agg(F.count("*").alias("non_singleton_entities"))
    return whole.join(F.broadcast(total)).select("rule", "non_singleton_entities", "fully_recovered_entities", F.round(100 * F.col("fully_recovered_entities") / F.col("non_singleton_entities"), 6).alias("full_entity_recall"))


def candidate_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """I8, K3: pairs, true pairs, recovered ones and their share."""
    true = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_id").alias("cand_id")).distinct()
    pairs = candidates.select("s1_id", "cand_id").distinct()
    n, m, hit = (x.agg(F.count("*").alias(c)) for x, c in ((pairs, "candidate_pairs"), (true, "true_pairs"), (pairs.intersect(true), "recovered_pairs")))
    recall = F.when(F.col("true_pairs") == 0, 0.0).otherwise(100 * F.col("recovered_pairs") / F.col("true_pairs"))
    return n.join(F.broadcast(m)).join(F.broadcast(hit)).select("candidate_pairs", "true_pairs", "recovered_pairs", F.round(recall, 6).alias("recall"))


def entity_detail(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """For each entity of the truth its true, recovered and candidate pairs."""
    true = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_id").alias("cand_id")).distinct().withColumn("t", F.lit(1))
    pairs = candidates.select("s1_id", "cand_id").distinct().withColumn("c", F.lit(1))
    both = true.join(pairs, ["s1_id", "cand_id"], "full").groupBy("s1_id").agg(F.count("t").alias("true_matches"), F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull()).alias("recovered_matches"), F.count("c").alias("block_candidates"))
    return both.where("true_matches > 0")


def country_consistency(truth: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs whose countries differ, by target."""
    c = records.select(ID, text.normal_country(F.col("country")).alias("country"))
    both = truth.join(c.select(F.col(ID).alias("source1_entity_id"), F.col("country").alias("x")), "source1_entity_id").join(c.select(F.col(ID).alias("matched_entity_id"), F.col("country").alias("y")), "matched_entity_id")
    out = both.groupBy(tokens.source_tag(F.col("matched_entity_id")).alias("target")).agg(F.count("*").alias("total_pairs"), F.count_if(F.col("x") != F.col("y")).alias("mismatches"))
    return out.withColumn("mismatch_percent", F.round(100 * F.col("mismatches") / F.col("total_pairs"), 6))


def uniques_by(records: DataFrame, by=("country",)) -> DataFrame:
    """Rows and exact distinct names and addresses."""
    return records.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("business_name").alias("unique_names"), F.count_distinct("business_address").alias("unique_addresses"))


def matched_scripts(truth: DataFrame, features: DataFrame) -> DataFrame:
    """True pairs by the scripts of both names and addresses."""
    own = lambda i, p: features.select(F.col(ID).alias(i), F.col("name_script").alias(f"{p}_name_script"), F.col("address_script").alias(f"{p}_address_script"))
    both = truth.join(own("source1_entity_id", "s1"), "source1_entity_id").join(own("matched_entity_id", "target"), "matched_entity_id")
    return both.groupBy("s1_name_script", "s1_address_script", "target_name_script", "target_address_script").agg(F.count("*").alias("n"))


def column_profile(records: DataFrame, columns=("business_name", "business_address")) -> DataFrame:
    """A row for each column: rows, distinct values, nulls and their share, repeats, lengths."""
    values = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.column", "x.v")
    n = F.length("v")
    return values.groupBy("column").agg(
        F.count("*").alias("n_rows"), F.count_distinct("v").alias("distinct_values"), F.count_if(F.col("v").isNull()).alias("nulls"),
        F.round(100 * F.avg(F.col("v").isNull().cast("double")), 6).alias("null_percent"), (F.count("v") - F.count_distinct("v")).alias("repeats"), F.min(n).alias("min_length"),
        F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("mean_length"), F.percentile(n, F.lit(0.5)).alias("median_length"), F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95_length"),
        F.round(F.percentile(n, F.lit(0.99)), 6).alias("p99_length"),
    )


def shares(values: DataFrame, *by: str) -> DataFrame:
    """Counts and percents of the total."""
    counts = values.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(*by, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def script_distribution(records: DataFrame, script) -> DataFrame:
    """Scripts over names and addresses alike."""
    values = records.select(F.explode(F.array("business_name", "business_address")).alias("v"))
    return shares(values.select(script(F.col("v")).alias("script")), "script")


def script_pairs(records: DataFrame, script) -> DataFrame:
    """I15."""
    return shares(records.select(script(F.col("business_name")).alias("name_script"), script(F.col("business_address")).alias("address_script")), "name_script", "address_script")


def token_counts(records: DataFrame, top: int | None = 100, only: list[str] | None = None) -> DataFrame:
    """The most frequent tokens of both columns, or those of a list."""
    words = records.select(F.explode(F.array("business_name", "business_address")).alias("v")).select(F.explode(text.tokens(text.clean_words(F.col("v")))).alias("token"))
    if only is not None:
        words = words.where(F.col("token").isin(only))
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(top) if top else counts


def repeated(records: DataFrame, column: str, top: int = 50) -> DataFrame:
    """The values that occur most, of those that occur more than once."""
    return records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(top)


def cardinality(truth_lists: DataFrame) -> DataFrame:
    """Entities by number of matches; truth_lists has an array `ids`."""
    return truth_lists.groupBy(F.size("ids").alias("match_count")).agg(F.count("*").alias("n"))


def patterns(truth_lists: DataFrame) -> DataFrame:
    """Entities by the sources that their matches are in."""
    n = lambda p: F.size(F.filter("ids", lambda x: x.startswith(p)))
    return shares(truth_lists.select(tokens.match_pattern(n("S2-"), n("S3-")).alias("pattern")), "pattern")


def described(df: DataFrame, value: Column) -> DataFrame:
    """Count, mean, deviation, quartiles."""
    q = [F.percentile(value, F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return df.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), *q, F.max(value).alias("max"))


def truth_integrity(truth_lists: DataFrame, records: DataFrame) -> DataFrame:
    """Unique, repeated and null ids, entities that no record has, lists with repeats or bad prefixes."""
    own = truth_lists.agg(
        F.count("*").alias("n_rows"), F.count_distinct("source1_entity_id").alias("unique_ids"), F.count_if(F.col("source1_entity_id").isNull()).alias("null_ids"),
        F.count_if(tokens.has_repeats(F.col("ids"))).alias("lists_with_repeats"), F.count_if(~tokens.prefixes_valid(F.col("ids"))).alias("bad_prefixes"),
    )
    orphans = truth_lists.join(records.select(F.col(ID).alias("source1_entity_id")), "source1_entity_id", "left_anti").agg(F.count("*").alias("orphans"))
    return own.join(F.broadcast(orphans))


def pivot_countries(records: DataFrame, sources_: list[str]) -> DataFrame:
    """Rows by country and source, 0 where there are none."""
    return records.groupBy("country").pivot("source", sources_).count().na.fill(0)


def coverage(features: DataFrame, by: str = "source") -> DataFrame:
    """Shares of records with a postal code, and how many entities there are."""
    return features.groupBy(by).agg(F.round(F.avg((F.col("postal") != "").cast("double")), 6).alias("postal_share"), F.count_distinct(ID).alias("entities"))


def top_values(records: DataFrame, columns=("business_name", "business_address", "country"), most: int = 20) -> DataFrame:
    """(column, value, n, rank): the most frequent values of each column, ties in their order; nulls don't count.

    Of each column's counts the best are kept before they meet."""
    values = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    return top_by_group(values.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n")), "column", most)


def top_by_group(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The most frequent rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc("n"), *[c for c in counts.columns if c not in (by, "n")])
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
