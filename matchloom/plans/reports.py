"""The set of reports on sources and truth as one run: profiles of every source, a few small files and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries, scripts
from ..operators import profile
from ..sources import sinks


def summary(records: DataFrame, truth_lists: DataFrame) -> dict:
    """Rows of each source and how many matches its entities have."""
    rows = {r["source"].lower(): r["count"] for r in records.groupBy("source").count().collect()}
    n = F.size("ids")
    own = truth_lists.agg(
        F.count("*").alias("ground_truth_records"), F.count_if(n == 0).alias("s1_singletons"), F.count_if(n > 0).alias("s1_with_matches"), F.avg((n == 0).cast("double")).alias("share"),
        F.avg(n).alias("mean_matches_per_s1"), F.percentile(n, F.lit(0.5)).alias("median_matches_per_s1"), F.max(n).alias("max_matches_per_s1"),
    ).first().asDict()
    share = own.pop("share")
    patterns = {r["pattern"]: r["n"] for r in profile.patterns(truth_lists).collect()}
    return (
        {f"{s}_records": c for s, c in sorted(rows.items())}
        | {"total_source_records": sum(rows.values()), "singleton_percentage": 100 * (share or 0.0)}
        | own
        | {"s2_only_entities": patterns.get("S2_ONLY", 0), "s3_only_entities": patterns.get("S3_ONLY", 0), "both_sources_entities": patterns.get("S2_AND_S3", 0)}
    )


def run(spark: SparkSession, records: DataFrame, truth_lists: DataFrame, out: str) -> dict:
    """Writes scripts, top tokens, abbreviations, column profiles and most frequent values of each source, the truth's
    patterns and cardinalities and summary.json under out, and returns the summary. Each is a small file."""
    for source in [r["source"] for r in records.select("source").distinct().orderBy("source").collect()]:
        own, name = records.where(F.col("source") == source), source.lower()
        sinks.write_report(profile.script_distribution(own, scripts.script_profile), f"{out}/{name}_script_distribution")
        sinks.write_report(profile.token_counts(own), f"{out}/{name}_top_tokens")
        sinks.write_report(profile.token_counts(own, None, list(dictionaries.EXPAND_PROFILE)), f"{out}/{name}_abbreviations")
        sinks.write_report(profile.column_profile(own), f"{out}/{name}_columns")
        sinks.write_report(profile.top_values(own), f"{out}/{name}_top_values")
    sinks.write_report(profile.patterns(truth_lists), f"{out}/ground_truth_match_patterns")
    sinks.write_report(profile.cardinality(truth_lists), f"{out}/ground_truth_cardinality")
    found = summary(records, truth_lists)
    sinks.write_json(spark, found, f"{out}/summary.json")
    return found
