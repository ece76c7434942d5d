"""Business records and a ground truth made from the given tables, in Spark and, word for word, in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three sources from documents: the first line is the name, the next 120 characters the address."""
    first = F.substring_index("text", "\n", 1)
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string")).alias("source"), F.upper("lang").alias("country"), F.left(first, F.lit(80)).alias("business_name"),
        F.substring(F.col("text"), F.length(first) + 2, F.lit(120)).alias("business_address"),
    )


ENT = """
ent AS (
  SELECT concat('S', doc_id % 3 + 1, '-', doc_id) AS entity_id, concat('S', doc_id % 3 + 1) AS source, upper(lang) AS country,
    left(split_part(text, chr(10), 1), 80) AS business_name, substring(text, length(split_part(text, chr(10), 1)) + 2, 120) AS business_address
  FROM documents)"""


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs: S1 documents and the S2 and S3 documents with the same text."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    name = lambda c: F.concat(F.lit("S"), (F.col(c) % 3 + 1).cast("string"), F.lit("-"), F.col(c).cast("string"))
    a, b = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("x"), "h"), d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("y"), "h")
    return a.join(b, "h").select(name("x").alias("source1_entity_id"), name("y").alias("matched_entity_id"))


GT = """
gt AS (
  SELECT concat('S', a.doc_id % 3 + 1, '-', a.doc_id) AS source1_entity_id, concat('S', b.doc_id % 3 + 1, '-', b.doc_id) AS matched_entity_id
  FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0)"""

#: Business-like records from customer; the same text is Spark SQL and oracle SQL.
_BIZ = """
SELECT concat('S', c_custkey % 3 + 1, '-', c_custkey) AS entity_id, concat('S', c_custkey % 3 + 1) AS source,
  CASE c_custkey % 6 WHEN 0 THEN concat(c_mktsegment, ' Traders Pvt Ltd') WHEN 1 THEN concat(c_name, ' Private Limited') WHEN 2 THEN concat(c_mktsegment, ' & Co. LLC')
    WHEN 3 THEN concat('The ', c_mktsegment, ' Corp. of ', c_name) WHEN 4 THEN concat('इंडो फूड ', c_custkey % 40) ELSE concat(c_mktsegment, ' Café ಕರ್ನಾಟಕ None Inc') END AS business_name,
  concat(c_custkey % 500, ' Main St, No. ', c_custkey % 97, '/', c_custkey % 13, ', MG Rd Apt ', c_custkey % 7, ' Town ',
    CASE c_custkey % 3 WHEN 0 THEN concat(560001 + c_custkey % 50) WHEN 1 THEN concat(10000 + c_custkey % 90, '-', 1000 + c_custkey % 9000) ELSE concat(75001 + c_custkey % 20) END) AS business_address,
  CASE c_custkey % 5 WHEN 0 THEN 'India' WHEN 1 THEN 'US' WHEN 2 THEN ' usa ' WHEN 3 THEN 'France' ELSE 'in' END AS country
FROM customer"""
BIZ = f"\nbiz AS ({_BIZ})"


def biz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BIZ.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer"))
