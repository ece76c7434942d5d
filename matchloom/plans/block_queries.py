"""Queries for sources, keys, joins, windows, sets and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import scripts, tokens
from ..operators import blocking, features, keys, profile, training
from ..sources import sinks, tables
from . import sqltext as S
from .projection import BIZ, ENT, GT, biz, ent, gt, read

ENG, KEYS, MAT, MKEYS, PIPE, PKEYS = S.ENG, S.KEYS, S.MAT, S.MKEYS, S.PIPE, S.PKEYS
Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark) -> str:
    """A new path for what a query writes: beside the checkpoints, or in a temporary folder where Spark is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.gettempdir()
    return f"{base.rstrip('/')}/matchloom-{uuid.uuid4().hex}"


def _eng(spark, d):
    return keys.engineered(ent(spark, d))


def _keys(spark, d):
    return keys.keys_v1(_eng(spark, d))


def _mat(spark, d):
    return keys.matcher_features(ent(spark, d))


def _mkeys(spark, d):
    return keys.keys_matcher(_mat(spark, d))


def mat_once(spark, d):
    """The matcher's records, written: queries that join them several times normalise the texts once."""
    path = folder(spark)
    sinks.write_parquet(_mat(spark, d), path)
    return spark.read.parquet(path)


def _pipe(spark, d):
    return keys.pipeline_features(ent(spark, d))


def _pkeys(spark, d):
    return keys.keys_pipeline(_pipe(spark, d))


def _lists(truth):
    return truth.groupBy("source1_entity_id").agg(F.sort_array(F.collect_set("matched_entity_id")).alias("ids"))


def _all_lists(spark, d):
    """A list for every S1 entity, empty where it has no match."""
    own = ent(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))
    return own.join(_lists(gt(spark, d)), "source1_entity_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


LISTS = """
lists AS (SELECT e.entity_id AS source1_entity_id, list_sort(list_distinct(list_filter(list(g.matched_entity_id), lambda z: z IS NOT NULL))) AS ids
  FROM ent e LEFT JOIN gt g ON e.entity_id = g.source1_entity_id WHERE e.source = 'S1' GROUP BY 1)"""


#: Target blocks of more rows give no pairs.
CAP = 100


def capped(table: str) -> str:
    """The target side of a table of keys without its large blocks."""
    return f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rule, key) AS bn FROM {table} WHERE source <> 'S1') WHERE bn <= {CAP})"


def _faulty_lists(spark, d):
    """The lists, some of them with a repeated id, an id without a source, or an unknown or missing entity."""
    n = F.substring("source1_entity_id", 4, 20).cast("long")
    rows = _all_lists(spark, d).withColumn("ids", F.when(n % 7 == 0, F.concat("ids", F.array(F.lit("S2-1"), F.lit("S2-1")))).when(n % 11 == 0, F.concat("ids", F.array(F.lit("X-9")))).otherwise(F.col("ids")))
    return rows.withColumn("source1_entity_id", F.when(n % 13 == 0, F.concat(F.lit("S1-none"), "source1_entity_id")).when(n % 17 == 0, F.lit(None)).otherwise(F.col("source1_entity_id")))


FAULTY = """
faulty AS (SELECT CASE WHEN n % 13 = 0 THEN 'S1-none' || source1_entity_id WHEN n % 17 = 0 THEN NULL ELSE source1_entity_id END AS source1_entity_id,
  CASE WHEN n % 7 = 0 THEN list_concat(ids, ['S2-1', 'S2-1']) WHEN n % 11 = 0 THEN list_append(ids, 'X-9') ELSE ids END AS ids FROM (SELECT *, substring(source1_entity_id, 4)::BIGINT AS n FROM lists))"""


# Sources and sinks


def _tsv(spark, d):
    path = folder(spark)
    sinks.write_tsv(biz(spark, d).select(*tables.RECORD), path)
    return path


#: Values that a separated file can lose: tabs, quotes, line breaks, blanks at the ends, a quote at the start.
_AWKWARD = [
    ("a\tb", "'a' || chr(9) || 'b'"), ('"quoted" start', "'\"quoted\" start'"), ('in "the" middle', "'in \"the\" middle'"), ('"', "'\"'"), ("two\nlines", "'two' || chr(10) || 'lines'"),
    ('"\t"\n', "'\"' || chr(9) || '\"' || chr(10)"), ("  blanks  ", "'  blanks  '"), ("", "''"), ("back\\slash", "'back\\slash'"),
]
_AWKWARD_SQL = "awkward AS (SELECT * FROM (VALUES {}) v(n, x))".format(", ".join(f"({i}, {x})" for i, (_, x) in enumerate(_AWKWARD)))
_RECORDS_SQL = S.with_(BIZ, _AWKWARD_SQL) + (
    f"SELECT entity_id, CASE WHEN n IS NULL THEN business_name ELSE x END AS business_name, CASE WHEN n IS NULL THEN business_address ELSE x || '|' || business_address END AS business_address, "
    f"trim(country) AS country, source FROM biz LEFT JOIN awkward ON substring(entity_id, 4)::BIGINT % {3 * len(_AWKWARD)} = n"
)


def _awkward(spark, d):
    """The business records, a third of them with an awkward value."""
    own = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_AWKWARD)], "n int, x string")
    rows = biz(spark, d).withColumn("n", (F.substring("entity_id", 4, 20).cast("long") % (3 * len(_AWKWARD))).cast("int")).join(F.broadcast(own), "n", "left")
    put = F.col("x").isNotNull()
    return rows.withColumns({"business_name": F.when(put, F.col("x")).otherwise(F.col("business_name")), "business_address": F.when(put, F.concat("x", F.lit("|"), "business_address")).otherwise(F.col("business_address"))})


@query(_RECORDS_SQL)
def A1_tsv_scan(spark, d):
    """Records with tabs, quotes and line breaks written as tab-separated text and read again, empties kept."""
    path = folder(spark)
    sinks.write_tsv(_awkward(spark, d).select(*tables.RECORD), path)
    return tables.read_records(spark, path, multi_line=True).withColumn("country", F.trim("country"))


@query("SELECT concat('S1-', p_partkey) AS entity_id, concat(p_partkey) AS business_name, '' AS business_address, concat(p_size) AS country FROM part")
def A2_numeric_names(spark, d):
    """Names of digits alone stay texts, as no type is inferred."""
    path = folder(spark)
    text_of = lambda c: F.col(c).cast("string")
    rows = read(spark, d, "part").select(F.concat(F.lit("S1-"), text_of("p_partkey")).alias("entity_id"), text_of("p_partkey").alias("business_name"), F.lit("").alias("business_address"), text_of("p_size").alias("country"))
    sinks.write_tsv(rows, path)
    return tables.read_tsv(spark, path)


@query(S.with_(BIZ) + "SELECT entity_id, business_name FROM biz")
def A3_pruned_scan(spark, d):
    return tables.read_tsv(spark, _tsv(spark, d)).select("entity_id", "business_name")


@query(S.with_(ENT) + "SELECT entity_id, country FROM ent ORDER BY entity_id LIMIT 20")
def A4_head_sample(spark, d):
    return tables.head(ent(spark, d).select("entity_id", "country"), 20)


@query("SELECT count(*) AS n FROM customer")
def A5_count_rows(spark, d):
    return spark.range(1).select(F.lit(tables.count_lines(spark, _tsv(spark, d))).cast("long").alias("n"))


@query(S.with_(ENT) + "SELECT entity_id FROM ent")
def A6_read_ids(spark, d):
    return tables.read_ids(ent(spark, d))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def A7_parquet_sql(spark, d):
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM {c} GROUP BY 1", c=read(spark, d, "customer"))


@query(S.with_(BIZ) + "SELECT trim(country) AS country, count(*) AS n, count(DISTINCT business_name) AS names FROM biz GROUP BY 1")
def A8_csv_sql(spark, d):
    return spark.sql("SELECT trim(country) AS country, count(*) AS n, count(DISTINCT business_name) AS names FROM {r} GROUP BY 1", r=tables.read_tsv(spark, _tsv(spark, d)))


@query(S.with_(ENT, GT, LISTS) + "SELECT source1_entity_id, array_to_string(ids, ',') AS ids, len(ids) AS n FROM lists")
def A10_truth_lists(spark, d):
    raw = _all_lists(spark, d).select("source1_entity_id", F.concat(F.lit(" "), F.array_join("ids", " , ")).alias("matched_entity_ids"))
    return tables.truth_lists(raw).select("source1_entity_id", F.array_join("ids", ",").alias("ids"), F.size("ids").alias("n"))


@query(S.with_(ENT, ENG, KEYS) + "SELECT entity_id, source, rule, key FROM keys")
def B1_key_parquet(spark, d):
    path = folder(spark)
    sinks.write_parquet(_keys(spark, d), path)
    return tables.read_parquet(spark, path)


@query(S.with_(GT) + "SELECT source1_entity_id, matched_entity_id, left(matched_entity_id, 2) AS target_source FROM gt")
def B2_select_to_parquet(spark, d):
    path = folder(spark)
    sinks.write_parquet(spark.sql("SELECT *, left(matched_entity_id, 2) AS target_source FROM {g}", g=gt(spark, d)), path, ["target_source"])
    return spark.read.schema("source1_entity_id string, matched_entity_id string, target_source string").parquet(path)


@query(S.with_(ENT, ENG, KEYS) + f"SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, b.source AS target, rule FROM keys a JOIN {capped('keys')} b USING (rule, key) WHERE a.source = 'S1' AND b.source <> 'S1' AND rule = 'name_exact'")
def B3_pair_checkpoint(spark, d):
    """Pairs written once for the steps that pass over them more than once; made only where they aren't there."""
    path = folder(spark)
    make = lambda: blocking.pairs_with_rules(_keys(spark, d).where("rule = 'name_exact'"), most=CAP)
    tables.cached(spark, path, make)
    return tables.cached(spark, path, make)


@query(S.with_(ENT, GT, LISTS) + "SELECT source1_entity_id, array_to_string(ids, ',') AS matched_entity_ids FROM lists")
def B4_matching_tsv(spark, d):
    path = folder(spark)
    sinks.write_tsv(_all_lists(spark, d).select("source1_entity_id", F.array_join("ids", ",").alias("matched_entity_ids")), path, one_file=True)
    return tables.read_tsv(spark, path, tables.TRUTH)


# Engineered records and keys


@query(S.with_(ENT, ENG) + "SELECT entity_id, name_norm, address_norm, name_core, numbers, postal, name_first, name_last, name_chars, name_prefix4, name_prefix6, array_to_string(name_tokens, ' ') AS name_tokens FROM eng")
def G1_engineered(spark, d):
    return _eng(spark, d).select("entity_id", "name_norm", "address_norm", "name_core", "numbers", "postal", "name_first", "name_last", "name_chars", "name_prefix4", "name_prefix6", F.array_join("name_tokens", " ").alias("name_tokens"))


#: The records' two names in Indic scripts, as romanised.
_ROMAN = {"इंडो फूड": "imddo phuudd", "ಕರ್ನಾಟಕ": "krnaattk"}


def _roman(x: str) -> str:
    for a, b in _ROMAN.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


_TRANS = S.without_null_like(S.clean(_roman("business_name")))
_LONGEST = f"list_transform(list_slice(list_sort(list_transform(list_filter({S.tokens('core')}, lambda z: length(z) >= 3 AND NOT regexp_full_match(z, '\\d+')), lambda z: {{'n': -length(z), 't': z}})), 1, 2), lambda z: z.t)"
_RAW_POSTAL = """CASE WHEN c IN ('INDIA', 'IN') THEN coalesce(list_extract(list_filter(regexp_extract_all(business_address, '\\d+'), lambda z: length(z) = 6), -1), '')
  WHEN c IN ('US', 'USA') THEN coalesce(list_extract(list_filter(regexp_extract_all(business_address, '\\d+(?:-\\d+)?'), lambda z: regexp_full_match(z, '\\d{5}(-\\d{4})?')), -1), '') ELSE '' END"""
_BUILT = {
    "block_postal_name4": "c || '|' || postal_code || '|' || substring(compact, 1, 4)", "block_name_prefix6": "c || '|' || substring(compact, 1, 6)", "block_name_exact": "c || '|' || core",
    "block_token_pair": "c || '|' || pair", "block_postal": "c || '|' || postal_code",
}
_BUILD = f"""
bld0 AS (SELECT *, {S.country('country')} AS c, {_TRANS} AS name_translit, {S.without_null_like(S.clean(_roman('business_address')))} AS address_translit FROM <t>),
bld1 AS (SELECT *, {S.expanded('name_translit', D.EXPAND_KEYS)} AS name_expanded, {S.expanded('address_translit', D.EXPAND_KEYS)} AS address_expanded FROM bld0),
bld2 AS (SELECT *, {S.suffixless('name_expanded')} AS core FROM bld1),
bld AS (SELECT *, regexp_replace(core, '[^a-z0-9]', '', 'g') AS compact, array_to_string(list_sort({_LONGEST}), '|') AS pair, {_RAW_POSTAL} AS postal_code FROM bld2)"""
_BKEYS = "\nbkeys AS ({})".format(S.long_keys("bld", {r: S.cleared(k) for r, k in _BUILT.items()}))
_KEY_COLUMNS = "entity_id source country name_script address_script name_translit address_translit postal_code name_expanded address_expanded name_core name_compact name_exact name_token_pair name_prefix4 name_prefix6".split()


@query(
    S.with_(BIZ, _BUILD.replace("<t>", "biz"))
    + "SELECT entity_id, source, c AS country, {} AS name_script, {} AS address_script, name_translit, address_translit, postal_code, name_expanded, address_expanded, core AS name_core, ".format(
        *(S.script(x, D.SCRIPTS, "OTHER", True) for x in ("business_name", "business_address"))
    )
    + "compact AS name_compact, core AS name_exact, pair AS name_token_pair, substring(compact, 1, 4) AS name_prefix4, substring(compact, 1, 6) AS name_prefix6, "
    + ", ".join(f"{S.cleared(k)} AS {r}" for r, k in _BUILT.items())
    + " FROM bld"
)
def G2_key_features(spark, d):
    """Every column of the key file."""
    return keys.key_features(biz(spark, d)).select(*_KEY_COLUMNS, *_BUILT)


@query(S.with_(ENT, PIPE) + "SELECT entity_id, name_norm, addr_norm, postal, name_prefix, name_prefix_p, array_to_string(list_sort(name_tokens), ' ') AS name_tokens FROM pipe")
def G3_pipeline_records(spark, d):
    return _pipe(spark, d).select("entity_id", "name_norm", "addr_norm", "postal", "name_prefix", "name_prefix_p", F.array_join(F.array_sort("name_tokens"), " ").alias("name_tokens"))


_KINDS = {
    "norm": S.words_folded, "expanded": lambda x: S.expanded(S.words_folded(x), D.EXPAND_PROFILE), "translit": lambda x: S.fold(_roman(x)),
}


@query(
    S.with_(BIZ, "made AS (SELECT entity_id, {} FROM biz)".format(", ".join(f"{make(f'business_{f}')} AS {f}_{kind}" for kind, make in _KINDS.items() for f in ("name", "address"))))
    + "SELECT *, {} FROM made".format(", ".join(f"trim(name_{kind} || ' ' || address_{kind}) AS merged_{kind}" for kind in _KINDS))
)
def C17_text_features(spark, d):
    """All nine texts."""
    return keys.text_features(biz(spark, d)).select("entity_id", *[f"{f}_{kind}" for kind in _KINDS for f in ("name", "address", "merged")])


@query(S.with_(ENT, ENG, KEYS) + "SELECT entity_id, rule, key FROM keys")
def F1_keys_v1(spark, d):
    return _keys(spark, d).select("entity_id", "rule", "key")


@query(S.with_(BIZ, _BUILD.replace("<t>", "biz"), _BKEYS) + "SELECT entity_id, source, rule, key FROM bkeys")
def F2_keys_builder(spark, d):
    """All five rules, on records that have postal codes of two countries."""
    return keys.keys_builder(keys.key_features(biz(spark, d)))


@query(S.with_(ENT, MAT, MKEYS) + "SELECT entity_id, rule, key FROM mkeys")
def F3_keys_matcher(spark, d):
    return _mkeys(spark, d).select("entity_id", "rule", "key")


@query(S.with_(ENT, PIPE, PKEYS) + "SELECT entity_id, rule, key FROM pkeys")
def F4_keys_pipeline(spark, d):
    return _pkeys(spark, d).select("entity_id", "rule", "key")


_BLOCKED = S.collapse(f"regexp_replace({S.words_folded('business_name')}, '[^a-z0-9 ]+', ' ', 'g')")


@query(S.with_(BIZ) + f"SELECT entity_id, country || '_' || substring(regexp_replace({_BLOCKED}, '[^a-z0-9]', '', 'g'), 1, 4) AS country_name_prefix, country || '_' || CASE WHEN regexp_extract(business_address, '\\b\\d{{6}}\\b') <> '' THEN regexp_extract(business_address, '\\b\\d{{6}}\\b') ELSE regexp_extract(business_address, '\\b\\d{{5}}(?:-\\d{{4}})?\\b') END AS country_postal FROM biz")
def F5_keys_profile(spark, d):
    return keys.profile_features(biz(spark, d)).select("entity_id", "country_name_prefix", "country_postal")


@query("WITH k(key) AS (VALUES ('US|acme'), ('US|'), ('|'), ('||'), (''), ('US||acme'), ('|x')) SELECT key, CASE WHEN suffix(key, '|') OR key IN ('', '|', '||') THEN '' ELSE key END AS kept, CASE WHEN suffix(key, '|') OR key IN ('', '|', '||') OR contains(key, '||') OR prefix(key, '|') THEN '' ELSE key END AS kept_strict FROM k")
def F6_clear_keys(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("US|acme", "US|", "|", "||", "", "US||acme", "|x")], "key string")
    return rows.select("key", keys.cleared(F.col("key")).alias("kept"), keys.cleared(F.col("key"), True).alias("kept_strict"))


@query(S.with_(ENT, ENG, KEYS) + "SELECT rule, count(*) AS n FROM keys WHERE NOT (contains(key, '||') OR prefix(key, '|')) GROUP BY rule")
def F7_strict_keys(spark, d):
    return keys.keys_v1(_eng(spark, d), strict=True).groupBy("rule").agg(F.count("*").alias("n"))


# Filters


@query(S.with_(ENT, ENG, KEYS) + "SELECT rule, count(*) AS n, count(DISTINCT entity_id) AS entities FROM keys WHERE key <> '' GROUP BY rule")
def G4_non_empty_keys(spark, d):
    return _keys(spark, d).where("key <> ''").groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


@query(S.with_(ENT, GT) + "SELECT entity_id, business_name FROM ent WHERE entity_id IN (SELECT matched_entity_id FROM gt)")
def G5_id_membership(spark, d):
    ids = gt(spark, d).select(F.col("matched_entity_id").alias("entity_id"))
    return ent(spark, d).join(ids, "entity_id", "left_semi").select("entity_id", "business_name")


@query(S.with_(ENT, GT) + "SELECT entity_id, source FROM ent WHERE entity_id NOT IN (SELECT matched_entity_id FROM gt)")
def G6_id_exclusion(spark, d):
    ids = gt(spark, d).select(F.col("matched_entity_id").alias("entity_id"))
    return ent(spark, d).join(ids, "entity_id", "left_anti").select("entity_id", "source")


@query(S.with_(ENT, PIPE, PKEYS) + "SELECT key, count(*) AS n FROM pkeys WHERE source <> 'S1' AND rule = 'rule_token_pair' GROUP BY key HAVING count(*) > 20")
def G7_stop_tokens(spark, d):
    t = _pkeys(spark, d).where("source <> 'S1' AND rule = 'rule_token_pair'")
    return t.join(blocking.stop_tokens(t, 20), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


@query(S.with_(ENT, ENG, KEYS) + "SELECT entity_id, rule, key FROM (SELECT *, count(*) OVER (PARTITION BY rule, key) AS n FROM keys WHERE source <> 'S1') WHERE n <= 5")
def G8_block_cap(spark, d):
    return blocking.cap_blocks(_keys(spark, d).where("source <> 'S1'"), 5).select("entity_id", "rule", "key")


@query(S.with_(ENT, MAT, MKEYS) + """, p AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM mkeys a JOIN """ + capped("mkeys") + """ b USING (rule, key) WHERE a.source = 'S1')
SELECT s1_id, cand_id, round(%s, 6) AS score FROM p JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id WHERE round(%s, 6) >= 0.5""" % ((S.jaccard("a.name_tokens", "b.name_tokens"),) * 2))
def G9_threshold(spark, d):
    m = mat_once(spark, d)
    pairs = blocking.pairs_with_rules(keys.keys_matcher(m), most=CAP).select("s1_id", "cand_id").distinct()
    from ..functions.similarity import jaccard

    return blocking.with_records(pairs, m).select("s1_id", "cand_id", F.round(jaccard(F.col("a.name_tokens"), F.col("b.name_tokens")), 6).alias("score")).where("score >= 0.5")


_SC = S.script("business_name", D.SCRIPTS, "OTHER", True)


@query(S.with_(BIZ) + f"SELECT entity_id, {_SC} AS script FROM biz WHERE {_SC} NOT IN ('LATIN', 'EMPTY', 'OTHER') ORDER BY entity_id LIMIT 25")
def G10_non_latin(spark, d):
    rows = biz(spark, d).select("entity_id", scripts.script_fast(F.col("business_name")).alias("script"))
    return rows.where(~F.col("script").isin("LATIN", "EMPTY", "OTHER")).orderBy("entity_id").limit(25)


@query(S.with_(BIZ) + f"SELECT entity_id, {_SC} AS name_script, {S.script('business_address', D.SCRIPTS, 'OTHER', True)} AS address_script FROM biz WHERE {_SC} <> {S.script('business_address', D.SCRIPTS, 'OTHER', True)} ORDER BY entity_id LIMIT 20")
def G11_cross_script(spark, d):
    rows = biz(spark, d).select("entity_id", scripts.script_fast(F.col("business_name")).alias("name_script"), scripts.script_fast(F.col("business_address")).alias("address_script"))
    return rows.where("name_script <> address_script").orderBy("entity_id").limit(20)


@query(S.with_(ENT) + "SELECT entity_id AS s1_id, 'S1' AS origin, 1 AS rule_flag FROM ent WHERE source = 'S1'")
def G12_constants(spark, d):
    return ent(spark, d).where("source = 'S1'").select("entity_id").withColumnRenamed("entity_id", "s1_id").withColumns({"origin": F.lit("S1"), "rule_flag": F.lit(1)})


# Joins and candidates


@query(S.with_(ENT, ENG, KEYS) + "SELECT rule, count(*) AS pairs FROM keys a JOIN keys b USING (rule, key) WHERE a.source = 'S1' AND b.source <> 'S1' GROUP BY rule")
def H1_index_probe(spark, d):
    """Pairs of each rule from the sizes of its lists, as no pair is needed to count them."""
    n = lambda source, c: _keys(spark, d).where(source).groupBy("rule", "key").agg(F.count("*").alias(c))
    return n("source = 'S1'", "m").join(n("source <> 'S1'", "n"), ["rule", "key"]).groupBy("rule").agg(F.sum(F.col("m") * F.col("n")).alias("pairs"))


_CAND = """,
capped AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rule, key) AS n FROM keys WHERE source <> 'S1') WHERE n <= 100),
cand AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM keys a JOIN capped b USING (rule, key) WHERE a.source = 'S1')
"""


@query(S.with_(ENT, ENG, KEYS) + _CAND + "SELECT s1_id, cand_id FROM cand")
def H2_candidates_capped(spark, d):
    return blocking.candidates(_keys(spark, d), 100)


@query(S.with_(ENT, MAT, MKEYS) + """, p AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM mkeys a JOIN """ + capped("mkeys") + """ b USING (rule, key) WHERE a.source = 'S1' AND rule = 'name_prefix6'),
s AS (SELECT s1_id, cand_id, round(%s, 6) AS score FROM p JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id)
SELECT s1_id, cand_id, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS r FROM s) WHERE r <= 3""" % S.jaccard("a.name_tokens", "b.name_tokens"))
def H3_block_by_key(spark, d):
    from ..functions.similarity import jaccard

    m = mat_once(spark, d)
    pairs = blocking.pairs_with_rules(keys.keys_matcher(m).where("rule = 'name_prefix6'"), most=CAP).select("s1_id", "cand_id").distinct()
    both = blocking.with_records(pairs, m).select("s1_id", "cand_id", F.round(jaccard(F.col("a.name_tokens"), F.col("b.name_tokens")), 6).alias("score"))
    return blocking.top_per_entity(both, F.col("score"), 3)


_TOK = """,
t AS (SELECT * FROM pkeys WHERE rule = 'rule_token_pair'), stop AS (SELECT key FROM t WHERE source <> 'S1' GROUP BY key HAVING count(*) > 20),
pr AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, count(*) AS shared FROM t a JOIN t b USING (key) WHERE a.source = 'S1' AND b.source <> 'S1' AND key NOT IN (SELECT key FROM stop) GROUP BY ALL)
"""


@query(S.with_(ENT, PIPE, PKEYS) + _TOK + "SELECT s1_id, cand_id FROM (SELECT *, count(*) OVER (PARTITION BY s1_id) AS n FROM pr) WHERE n <= 10")
def H4_token_candidates(spark, d):
    return blocking.token_candidates(_pkeys(spark, d).where("rule = 'rule_token_pair'"), 10, 20)


@query(S.with_(ENT, PIPE, PKEYS) + _TOK + "SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY shared DESC, cand_id) AS n FROM pr) WHERE n <= 10")
def H4_token_candidates_topk(spark, d):
    return blocking.token_candidates(_pkeys(spark, d).where("rule = 'rule_token_pair'"), 10, 20, "topk")


@query(S.with_(ENT, ENG, KEYS) + "SELECT rule, key, count(*) AS n, min(entity_id) AS first_id FROM keys WHERE source = 'S2' GROUP BY rule, key")
def H5_posting_lists(spark, d):
    """The index itself, as list sizes and first ids; lookups are the joins above."""
    return _keys(spark, d).where("source = 'S2'").groupBy("rule", "key").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


@query(S.with_(ENT, ENG, KEYS, GT) + "SELECT source1_entity_id, matched_entity_id, rule FROM gt JOIN keys a ON a.entity_id = source1_entity_id JOIN keys b ON b.entity_id = matched_entity_id AND a.rule = b.rule AND a.key = b.key WHERE matched_entity_id LIKE 'S2-%'".replace("rule FROM", "a.rule AS rule FROM"))
def H6_truth_keys(spark, d):
    k, g = _keys(spark, d), gt(spark, d).where(tokens.source_tag(F.col("matched_entity_id")) == "S2")
    return g.join(k.select(F.col("entity_id").alias("source1_entity_id"), "rule", "key"), "source1_entity_id").join(k.select(F.col("entity_id").alias("matched_entity_id"), "rule", "key"), ["matched_entity_id", "rule", "key"]).select("source1_entity_id", "matched_entity_id", "rule")


@query(S.with_(ENT, ENG, KEYS) + ", a AS (SELECT key, count(*) AS m FROM keys WHERE source = 'S1' AND rule = 'name_exact' GROUP BY key), b AS (SELECT key, count(*) AS n FROM keys WHERE source = 'S2' AND rule = 'name_exact' GROUP BY key) SELECT key, m, n, m * n AS pairs FROM a JOIN b USING (key)")
def H7_block_counts(spark, d):
    k = _keys(spark, d).where("rule = 'name_exact'")
    n = lambda s, c: k.where(F.col("source") == s).groupBy("key").agg(F.count("*").alias(c))
    return n("S1", "m").join(n("S2", "n"), "key").select("key", "m", "n", (F.col("m") * F.col("n")).alias("pairs"))


_RULE_SOURCES = "rs AS (SELECT * FROM (SELECT DISTINCT rule FROM keys), (SELECT DISTINCT source FROM keys))"
_STAT = """, rs AS (SELECT * FROM (SELECT DISTINCT rule FROM keys), (SELECT DISTINCT source FROM keys)), bs AS (SELECT source, rule, key, count(*) AS n FROM keys GROUP BY ALL)
SELECT source, rule, count(n) AS blocks, coalesce(sum(n), 0)::BIGINT AS rows_in_blocks, coalesce(round(avg(n), 6), 0) AS mean, coalesce(quantile_cont(n, 0.5), 0)::DOUBLE AS median,
  coalesce(round(quantile_cont(n, 0.9), 6), 0) AS p90, coalesce(round(quantile_cont(n, 0.95), 6), 0) AS p95, coalesce(round(quantile_cont(n, 0.99), 6), 0) AS p99, coalesce(max(n), 0) AS max,
  count(*) FILTER (WHERE n > 100) AS blocks_gt_100, count(*) FILTER (WHERE n > 1000) AS blocks_gt_1000 FROM rs LEFT JOIN bs USING (source, rule) GROUP BY source, rule"""
_EST = """ap AS (SELECT rule, key, count(*) AS m FROM keys WHERE source = 'S1' GROUP BY ALL), bp AS (SELECT source AS target, rule, key, count(*) AS n FROM keys WHERE source <> 'S1' GROUP BY ALL),
ep AS (SELECT target, rule, sum(m * n)::BIGINT AS c FROM ap JOIN bp USING (rule, key) GROUP BY ALL),
est AS (SELECT source AS target, rule, coalesce(c, 0) AS candidate_pairs, round(coalesce(c, 0) / (SELECT count(DISTINCT entity_id) FROM keys WHERE source = 'S1'), 6) AS avg_candidates_per_s1
  FROM rs LEFT JOIN ep ON ep.target = rs.source AND ep.rule = rs.rule WHERE source <> 'S1')""".replace("source AS target, rule, coalesce", "source AS target, rs.rule AS rule, coalesce")
_REC = """hits AS (SELECT left(matched_entity_id, 2) AS target, a.rule AS rule, count(*) AS n FROM gt JOIN keys a ON a.entity_id = source1_entity_id JOIN keys b ON b.entity_id = matched_entity_id AND a.rule = b.rule AND a.key = b.key GROUP BY ALL),
tot AS (SELECT left(matched_entity_id, 2) AS target, count(*) AS total_true_pairs FROM gt GROUP BY ALL),
rec AS (SELECT tot.target AS target, rs.rule AS rule, total_true_pairs, coalesce(n, 0) AS recovered_pairs, round(100 * coalesce(n, 0) / total_true_pairs, 6) AS pair_recall
  FROM rs JOIN tot ON tot.target = rs.source LEFT JOIN hits ON hits.target = rs.source AND hits.rule = rs.rule)"""


@query(S.with_(ENT, ENG, KEYS, GT, _RULE_SOURCES, _EST, _REC) + "SELECT target, rule, pair_recall, candidate_pairs, avg_candidates_per_s1 FROM rec LEFT JOIN est USING (target, rule)")
def H8_report_join(spark, d):
    k = _keys(spark, d)
    return profile.recall_by_rule(gt(spark, d), k).join(profile.estimated_pairs(k), ["target", "rule"], "left").select("target", "rule", "pair_recall", "candidate_pairs", "avg_candidates_per_s1")


@query(S.with_(ENT, GT) + "SELECT source1_entity_id AS s1_id, matched_entity_id AS cand_id, a.business_name AS name_a, b.business_name AS name_b FROM gt JOIN ent a ON a.entity_id = source1_entity_id JOIN ent b ON b.entity_id = matched_entity_id")
def H9_pair_records(spark, d):
    pairs = gt(spark, d).select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_id").alias("cand_id"))
    return blocking.with_records(pairs, ent(spark, d)).select("s1_id", "cand_id", F.col("a.business_name").alias("name_a"), F.col("b.business_name").alias("name_b"))


@query(S.with_(GT) + "SELECT source1_entity_id, matched_entity_id, left(matched_entity_id, 2) AS target_source FROM gt")
def H10_truth_explode(spark, d):
    raw = _lists(gt(spark, d)).select("source1_entity_id", F.array_join("ids", ", ").alias("matched_entity_ids"))
    return tables.truth_pairs(raw)


@query(S.with_(ENT, ENG, KEYS, GT) + _CAND + "SELECT s1_id, cand_id, CASE WHEN source1_entity_id IS NULL THEN 0 ELSE 1 END AS label FROM cand LEFT JOIN gt ON s1_id = source1_entity_id AND cand_id = matched_entity_id")
def H11_labels(spark, d):
    return blocking.labelled(blocking.candidates(_keys(spark, d), 100), gt(spark, d)).select("s1_id", "cand_id", "label")


@query(S.with_(ENT, GT) + "SELECT entity_id FROM ent WHERE source = 'S1' AND entity_id NOT IN (SELECT source1_entity_id FROM gt)")
def H13_anti_join(spark, d):
    return ent(spark, d).where("source = 'S1'").select("entity_id").join(gt(spark, d).select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")


@query(S.with_(ENT, GT, LISTS) + "SELECT source1_entity_id, coalesce(nullif(array_to_string(ids, ','), ''), '') AS matched_entity_ids FROM lists")
def H14_map_lookup(spark, d):
    return _all_lists(spark, d).select("source1_entity_id", F.array_join("ids", ",").alias("matched_entity_ids"))


# Aggregates and reports


@query(S.with_(ENT, ENG, KEYS) + _STAT)
def I1_block_statistics(spark, d):
    return profile.block_statistics(_keys(spark, d), ("source", "rule"))


@query(S.with_(ENT, MAT, MKEYS) + _STAT.replace("FROM keys", "FROM mkeys"))
def I2_block_size_stats(spark, d):
    return profile.block_statistics(_mkeys(spark, d), ("source", "rule"))


@query(S.with_(ENT, ENG, KEYS, _RULE_SOURCES, _EST) + "SELECT target, rule, candidate_pairs, avg_candidates_per_s1 FROM est")
def I3_estimated_pairs(spark, d):
    return profile.estimated_pairs(_keys(spark, d))


@query("SELECT 'brand_type' AS rule, p_brand || '|' || p_type AS key, count(*) AS size FROM part GROUP BY ALL")
def I4_block_size_analysis(spark, d):
    return profile.block_sizes(read(spark, d, "part").select(F.lit("brand_type").alias("rule"), F.concat_ws("|", "p_brand", "p_type").alias("key")))


@query(S.with_(ENT, GT) + "SELECT left(matched_entity_id, 2) AS target, count(*) AS total_pairs, count(*) FILTER (WHERE a.country <> b.country) AS mismatches, round(100 * count(*) FILTER (WHERE a.country <> b.country) / count(*), 6) AS mismatch_percent FROM gt JOIN ent a ON a.entity_id = source1_entity_id JOIN ent b ON b.entity_id = matched_entity_id GROUP BY ALL")
def I5_country_consistency(spark, d):
    return profile.country_consistency(gt(spark, d), ent(spark, d))


@query(S.with_(ENT, ENG, KEYS, GT, _RULE_SOURCES, _REC) + "SELECT * FROM rec")
def I6_rule_recall(spark, d):
    return profile.recall_by_rule(gt(spark, d), _keys(spark, d))


@query(S.with_(ENT, ENG, KEYS, GT, _RULE_SOURCES, _REC) + "SELECT target, rule, recovered_pairs, pair_recall FROM rec")
def B7_report_csv(spark, d):
    path = folder(spark)
    sinks.write_report(profile.recall_by_rule(gt(spark, d), _keys(spark, d)).select("target", "rule", "recovered_pairs", "pair_recall"), path)
    return spark.read.schema("target string, rule string, recovered_pairs long, pair_recall double").option("header", True).csv(path)


@query(S.with_(ENT, ENG, KEYS, GT) + """, need AS (SELECT source1_entity_id, count(*) AS need FROM gt GROUP BY 1), h AS (SELECT a.rule AS rule, source1_entity_id, count(*) AS hits FROM gt JOIN keys a ON a.entity_id = source1_entity_id JOIN keys b ON b.entity_id = matched_entity_id AND a.rule = b.rule AND a.key = b.key GROUP BY ALL)
SELECT rule, (SELECT count(*) FROM need) AS non_singleton_entities, count(*) FILTER (WHERE hits = need) AS fully_recovered_entities, round(100 * count(*) FILTER (WHERE hits = need) / (SELECT count(*) FROM need), 6) AS full_entity_recall
FROM (SELECT DISTINCT rule FROM keys) r LEFT JOIN (SELECT * FROM h JOIN need USING (source1_entity_id)) x USING (rule) GROUP BY rule""")
def I7_entity_recall(spark, d):
    return profile.recall_by_entity(gt(spark, d), _keys(spark, d))


@query(S.with_(ENT, ENG, KEYS, GT) + _CAND + ", t AS (SELECT DISTINCT source1_entity_id AS s1_id, matched_entity_id AS cand_id FROM gt) SELECT (SELECT count(*) FROM cand) AS candidate_pairs, (SELECT count(*) FROM t) AS true_pairs, (SELECT count(*) FROM cand JOIN t USING (s1_id, cand_id)) AS recovered_pairs, round(100 * (SELECT count(*) FROM cand JOIN t USING (s1_id, cand_id)) / (SELECT count(*) FROM t), 6) AS recall")
def I8_candidate_recall(spark, d):
    return profile.candidate_recall(blocking.candidates(_keys(spark, d), 100), gt(spark, d))


@query(S.with_(ENT, ENG, KEYS, GT) + _CAND + ", t AS (SELECT DISTINCT source1_entity_id AS s1_id, matched_entity_id AS cand_id FROM gt) SELECT s1_id, count(t.cand_id) AS true_matches, count(*) FILTER (WHERE t.cand_id IS NOT NULL AND c.cand_id IS NOT NULL) AS recovered_matches, count(c.cand_id) AS block_candidates FROM t FULL JOIN cand c USING (s1_id, cand_id) GROUP BY s1_id HAVING count(t.cand_id) > 0".replace("t.cand_id", "t.x").replace("c.cand_id", "c.y").replace("matched_entity_id AS cand_id FROM gt", "matched_entity_id AS cand_id, 1 AS x FROM gt").replace("FULL JOIN cand c", "FULL JOIN (SELECT *, 1 AS y FROM cand) c"))
def I9_entity_detail(spark, d):
    return profile.entity_detail(blocking.candidates(_keys(spark, d), 100), gt(spark, d))


@query(S.with_(ENT) + "SELECT country, count(*) AS n_rows, count(DISTINCT business_name) AS unique_names, count(DISTINCT business_address) AS unique_addresses FROM ent GROUP BY country")
def I10_uniques_by_country(spark, d):
    return profile.uniques_by(ent(spark, d))


@query(S.with_(ENT) + "SELECT count(*) AS n_rows, count(DISTINCT business_name) AS unique_names, count(DISTINCT business_address) AS unique_addresses FROM ent")
def I11_global_uniques(spark, d):
    return profile.uniques_by(ent(spark, d), ())


_SB = S.script("business_address", D.SCRIPTS, "OTHER", True)


@query(S.with_(ENT, GT) + f", f AS (SELECT entity_id, {_SC} AS n, {_SB} AS a FROM ent) SELECT x.n AS s1_name_script, x.a AS s1_address_script, y.n AS target_name_script, y.a AS target_address_script, count(*) AS n FROM gt JOIN f x ON x.entity_id = source1_entity_id JOIN f y ON y.entity_id = matched_entity_id GROUP BY ALL")
def I12_matched_scripts(spark, d):
    f = ent(spark, d).select("entity_id", scripts.script_fast(F.col("business_name")).alias("name_script"), scripts.script_fast(F.col("business_address")).alias("address_script"))
    return profile.matched_scripts(gt(spark, d), f)


_VALUES = "vals AS (SELECT 'business_name' AS col, nullif(business_name, '') AS v FROM ent UNION ALL SELECT 'business_address', nullif(business_address, '') FROM ent)"


@query(S.with_(ENT, _VALUES) + 'SELECT col AS "column", count(*) AS n_rows, count(DISTINCT v) AS distinct_values, count(*) FILTER (WHERE v IS NULL) AS nulls, round(100 * count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS null_percent, count(v) - count(DISTINCT v) AS repeats, min(length(v)) AS min_length, max(length(v)) AS max_length, round(avg(length(v)), 6) AS mean_length, quantile_cont(length(v), 0.5)::DOUBLE AS median_length, round(quantile_cont(length(v), 0.95), 6) AS p95_length, round(quantile_cont(length(v), 0.99), 6) AS p99_length FROM vals GROUP BY col')
def I13_column_profile(spark, d):
    return profile.column_profile(ent(spark, d).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("business_name", "business_address")}))


@query(
    S.with_(ENT)
    + """, v AS (SELECT unnest([{'c': 'business_name', 'v': business_name}, {'c': 'business_address', 'v': business_address}, {'c': 'country', 'v': country}], recursive := true) FROM ent)
SELECT c AS "column", v AS value, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS rank FROM v WHERE v IS NOT NULL GROUP BY c, v QUALIFY rank <= 20"""
)
def I13_top_values(spark, d):
    return profile.top_values(ent(spark, d))


@query(S.with_(ENT) + "SELECT source, count(DISTINCT entity_id) AS entities, count(DISTINCT country) AS countries FROM ent GROUP BY source")
def I13_distinct_ids(spark, d):
    return ent(spark, d).groupBy("source").agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("country").alias("countries"))


@query(S.with_(BIZ) + f", v AS (SELECT {S.script('x', D.SCRIPTS, 'EMPTY', False)} AS script FROM (SELECT business_name AS x FROM biz UNION ALL SELECT business_address FROM biz)) SELECT script, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM v GROUP BY script")
def I14_script_distribution(spark, d):
    return profile.script_distribution(biz(spark, d), scripts.script_profile)


@query(S.with_(BIZ) + f", v AS (SELECT {_SC} AS name_script, {_SB} AS address_script FROM biz) SELECT name_script, address_script, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM v GROUP BY ALL")
def I15_script_pairs(spark, d):
    return profile.script_pairs(biz(spark, d), scripts.script_fast)


_WORDS = f", w AS (SELECT unnest({S.tokens(S.words_folded('x'))}) AS token FROM (SELECT business_name AS x FROM <t> UNION ALL SELECT business_address FROM <t>))"


@query(S.with_(ENT) + _WORDS.replace("<t>", "ent") + " SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 100")
def I16_token_statistics(spark, d):
    return profile.token_counts(ent(spark, d))


@query(S.with_(BIZ) + _WORDS.replace("<t>", "biz") + f" SELECT token, count(*) AS n FROM w WHERE token IN ({S.literal(D.EXPAND_PROFILE)}) GROUP BY token")
def I17_abbreviations(spark, d):
    return profile.token_counts(biz(spark, d), None, list(D.EXPAND_PROFILE))


@query(S.with_(ENT, _VALUES) + 'SELECT col AS "column", round(100 * count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS null_percent FROM vals GROUP BY col')
def I18_null_percentage(spark, d):
    return I13_column_profile(spark, d).select("column", "null_percent")


@query(S.with_(ENT) + "SELECT business_name AS value, count(*) AS n FROM ent GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 50")
def I19_duplicate_names(spark, d):
    return profile.repeated(ent(spark, d), "business_name")


@query(S.with_(ENT, GT, LISTS) + "SELECT len(ids) AS match_count, count(*) AS n FROM lists GROUP BY 1")
def I20_cardinality(spark, d):
    return profile.cardinality(_all_lists(spark, d))


_PAT = "CASE WHEN len(list_filter(ids, lambda z: prefix(z, 'S2-'))) = 0 AND len(list_filter(ids, lambda z: prefix(z, 'S3-'))) = 0 THEN 'NONE' WHEN len(list_filter(ids, lambda z: prefix(z, 'S3-'))) = 0 THEN 'S2_ONLY' WHEN len(list_filter(ids, lambda z: prefix(z, 'S2-'))) = 0 THEN 'S3_ONLY' ELSE 'S2_AND_S3' END"


@query(S.with_(ENT, GT, LISTS) + f"SELECT {_PAT} AS pattern, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lists GROUP BY 1")
def I21_match_patterns(spark, d):
    return profile.patterns(_all_lists(spark, d))


_VALID = "len(list_filter(ids, lambda z: NOT (prefix(z, 'S2-') OR prefix(z, 'S3-')))) = 0"


@query(S.with_(ENT, GT, LISTS, FAULTY) + f"SELECT source1_entity_id, {_PAT} AS pattern, len(ids) <> len(list_distinct(ids)) AS repeats, {_VALID} AS valid FROM faulty")
def D24_list_checks(spark, d):
    """A list's pattern, repeats and prefixes, with faulty lists among them."""
    n = lambda p: F.size(F.filter("ids", lambda x: x.startswith(p)))
    checks = tokens.match_pattern(n("S2-"), n("S3-")).alias("pattern"), tokens.has_repeats(F.col("ids")).alias("repeats"), tokens.prefixes_valid(F.col("ids")).alias("valid")
    return _faulty_lists(spark, d).select("source1_entity_id", *checks)


@query(r"WITH r(s) AS (VALUES ('S2-1, S3-2,,S2-1'), (''), ('X-1'), (' S2-9 ')), l AS (SELECT s, list_filter(list_transform(string_split(s, ','), lambda z: trim(z)), lambda z: z <> '') AS ids FROM r) SELECT s, array_to_string(ids, ';') AS ids, len(ids) <> len(list_distinct(ids)) AS repeats, len(list_filter(ids, lambda z: NOT (prefix(z, 'S2-') OR prefix(z, 'S3-')))) = 0 AS valid FROM l")
def D21_parse_ids(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("S2-1, S3-2,,S2-1", "", "X-1", " S2-9 ")], "s string").withColumn("ids", tokens.id_list(F.col("s")))
    return rows.select("s", F.array_join("ids", ";").alias("ids"), tokens.has_repeats(F.col("ids")).alias("repeats"), tokens.prefixes_valid(F.col("ids")).alias("valid"))


@query(S.with_(ENT, GT, LISTS) + "SELECT count(*) AS n, round(avg(len(ids)), 6) AS mean, round(stddev_samp(len(ids)), 6) AS std, min(len(ids)) AS min, quantile_cont(len(ids), 0.25)::DOUBLE AS p25, quantile_cont(len(ids), 0.5)::DOUBLE AS p50, quantile_cont(len(ids), 0.75)::DOUBLE AS p75, max(len(ids)) AS max FROM lists")
def I22_describe(spark, d):
    return profile.described(_all_lists(spark, d), F.size("ids"))


@query(
    S.with_(ENT, GT, LISTS, FAULTY)
    + f"""SELECT count(*) AS n_rows, count(DISTINCT source1_entity_id) AS unique_ids, count(*) FILTER (WHERE source1_entity_id IS NULL) AS null_ids,
  count(*) FILTER (WHERE len(ids) <> len(list_distinct(ids))) AS lists_with_repeats, count(*) FILTER (WHERE NOT ({_VALID})) AS bad_prefixes,
  count(*) FILTER (WHERE source1_entity_id IS NULL OR source1_entity_id NOT IN (SELECT entity_id FROM ent)) AS orphans FROM faulty"""
)
def I23_truth_integrity(spark, d):
    return profile.truth_integrity(_faulty_lists(spark, d), ent(spark, d))


@query(S.with_(ENT, GT, LISTS) + "SELECT (SELECT count(*) FROM ent WHERE source = 'S1') AS s1_rows, (SELECT count(*) FROM ent WHERE source = 'S2') AS s2_rows, (SELECT count(*) FROM ent WHERE source = 'S3') AS s3_rows, (SELECT count(*) FROM lists WHERE len(ids) = 0) AS singletons, (SELECT round(avg(len(ids)), 6) FROM lists) AS mean_matches, (SELECT max(len(ids)) FROM lists) AS max_matches")
def I24_summary(spark, d):
    n = ent(spark, d).agg(*[F.count_if(F.col("source") == s).alias(f"{s.lower()}_rows") for s in ("S1", "S2", "S3")])
    own = _all_lists(spark, d).agg(F.count_if(F.size("ids") == 0).alias("singletons"), F.round(F.avg(F.size("ids")), 6).alias("mean_matches"), F.max(F.size("ids")).alias("max_matches"))
    return n.join(F.broadcast(own))


_RULES = ["rule_postal_name4", "rule_prefix6", "rule_exact_name", "rule_postal", "rule_token_pair"]


@query(S.with_(ENT, PIPE, PKEYS) + ", p AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, b.source, rule FROM pkeys a JOIN " + capped("pkeys") + " b USING (rule, key) WHERE a.source = 'S1' AND rule <> 'rule_token_pair') SELECT s1_id, cand_id, source, " + ", ".join(f"max(CASE WHEN rule = '{r}' THEN 1 ELSE 0 END) AS {r}" for r in _RULES) + " FROM p GROUP BY s1_id, cand_id, source")
def I25_rule_flags(spark, d):
    return blocking.flagged(blocking.pairs_with_rules(_pkeys(spark, d).where("rule <> 'rule_token_pair'"), most=CAP), _RULES)


@query(S.with_(GT) + "SELECT source1_entity_id, array_to_string(list_sort(list_distinct(list(matched_entity_id))), ',') AS ids, count(*) AS n FROM gt GROUP BY 1")
def I26_collect_lists(spark, d):
    return gt(spark, d).groupBy("source1_entity_id").agg(F.array_join(F.sort_array(F.collect_set("matched_entity_id")), ",").alias("ids"), F.count("*").alias("n"))


@query(S.with_(ENT) + "SELECT country, count(*) FILTER (WHERE source = 'S1') AS \"S1\", count(*) FILTER (WHERE source = 'S2') AS \"S2\", count(*) FILTER (WHERE source = 'S3') AS \"S3\" FROM ent GROUP BY country")
def I27_pivot_countries(spark, d):
    return profile.pivot_countries(ent(spark, d), ["S1", "S2", "S3"])


@query(S.with_(BIZ.replace("biz AS", "ent AS"), ENG) + "SELECT source, round(avg(CASE WHEN postal <> '' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS postal_share, count(DISTINCT entity_id) AS entities FROM eng GROUP BY source")
def I28_coverage(spark, d):
    return profile.coverage(keys.engineered(biz(spark, d)))


# Windows, order, samples


@query(S.with_(ENT) + "SELECT entity_id, count(*) OVER (PARTITION BY business_name) AS n FROM ent")
def J1_group_count(spark, d):
    return ent(spark, d).select("entity_id", F.count("*").over(Window.partitionBy("business_name")).alias("n"))


@query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def J2_top_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n <= 7 OR (pos % greatest(1, n // 7) = 0 AND pos // greatest(1, n // 7) < 7)")
def J3_stride_sample(spark, d):
    return blocking.stride_sample(read(spark, d, "part").select("p_name", "p_partkey"), ("p_name",), F.col("p_partkey"), 7)


_TOPK = """,
ts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, source, key ORDER BY entity_id) - 1 AS pos, count(*) OVER (PARTITION BY rule, source, key) AS n FROM mkeys WHERE source <> 'S1') WHERE n <= 30 OR (pos %% greatest(1, n // 30) = 0 AND pos // greatest(1, n // 30) < 30)),
pp AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id, b.source FROM mkeys a JOIN ts b USING (rule, key) WHERE a.source = 'S1'),
sc AS (SELECT s1_id, cand_id, pp.source, round(0.6 * (%s) + 0.4 * (%s), 6) AS score FROM pp JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id),
top AS (SELECT s1_id, cand_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, cand_id) AS r FROM sc) WHERE r <= 10)
""" % (S.jaccard("a.name_tokens", "b.name_tokens"), S.jaccard("a.address_tokens", "b.address_tokens"))


def _top(spark, d, mat=None):
    mat = mat_once(spark, d) if mat is None else mat
    return blocking.topk_candidates(keys.keys_matcher(mat), mat.select("entity_id", *features.JACCARD_COLUMNS), features.jaccard_score, 30, 10)


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + "SELECT * FROM top")
def J4_topk_candidates(spark, d):
    return _top(spark, d)


_POS = "pos AS (SELECT DISTINCT source1_entity_id AS s1_id, matched_entity_id AS pos_id, left(matched_entity_id, 2) AS source FROM gt)"


@query(S.with_(ENT, MAT, MKEYS, GT) + _TOPK + f", {_POS}, wrong AS (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, cand_id) AS rank FROM top WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.s1_id = top.s1_id AND p.pos_id = top.cand_id)) SELECT s1_id, pos_id, source, cand_id, rank FROM pos JOIN wrong USING (s1_id, source) WHERE rank <= 4")
def J5_hard_negatives(spark, d):
    pos = training.positives(gt(spark, d), ent(spark, d).where("source = 'S1'"), ent(spark, d))
    return training.hard_negatives(pos, _top(spark, d))


@query(S.with_(ENT, ENG, KEYS, GT) + _CAND + ", l AS (SELECT s1_id, cand_id, CASE WHEN source1_entity_id IS NULL THEN 0 ELSE 1 END AS label FROM cand LEFT JOIN gt ON s1_id = source1_entity_id AND cand_id = matched_entity_id) SELECT s1_id, cand_id, label FROM l WHERE label = 1 UNION ALL SELECT s1_id, cand_id, label FROM (SELECT *, row_number() OVER (ORDER BY md5(s1_id || '|' || cand_id || '|42')) AS r FROM l WHERE label = 0) WHERE r <= 8 * (SELECT count(*) FROM l WHERE label = 1)")
def J6_sampled_negatives(spark, d):
    return training.training_frame(blocking.candidates(_keys(spark, d), 100), gt(spark, d)).select("s1_id", "cand_id", "label")


@query(S.with_(ENT) + "SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id || '|42'), entity_id) <= floor(0.9 * (SELECT count(*) FROM ent WHERE source = 'S1')) AS is_train FROM ent WHERE source = 'S1'")
def J7_split(spark, d):
    return training.split(ent(spark, d).where("source = 'S1'").select("entity_id"))


@query(S.with_(ENT) + "SELECT entity_id, ('0x' || left(md5(entity_id || '|42'), 8))::BIGINT / 4294967296.0 < 0.9 AS is_train FROM ent WHERE source = 'S1'")
def J8_hash_split(spark, d):
    return training.hash_split(ent(spark, d).where("source = 'S1'").select("entity_id"))


@query(S.with_(ENT) + "SELECT entity_id FROM ent ORDER BY md5(entity_id || '|7') LIMIT 50")
def J9_sample(spark, d):
    return training.sample(ent(spark, d).select("entity_id"), training.keyed("7", F.col("entity_id")), 50)


@query(S.with_(ENT, GT) + """, own AS (SELECT entity_id, source FROM ent WHERE source = 'S1' ORDER BY md5(entity_id || '|42') LIMIT 40), tr AS (SELECT DISTINCT matched_entity_id AS entity_id FROM gt WHERE source1_entity_id IN (SELECT entity_id FROM own)),
oth AS (SELECT entity_id, source FROM ent WHERE source <> 'S1' AND entity_id NOT IN (SELECT entity_id FROM tr) ORDER BY md5(entity_id || '|42') LIMIT 80)
SELECT * FROM own UNION SELECT entity_id, source FROM ent WHERE entity_id IN (SELECT entity_id FROM tr) UNION SELECT * FROM oth""")
def J10_anchored_sample(spark, d):
    e = ent(spark, d).select("entity_id", "source")
    return training.anchored_sample(e.where("source = 'S1'"), e.where("source <> 'S1'"), gt(spark, d), 40, 80)


@query(S.with_(ENT) + "SELECT source, entity_id, length(business_name) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(entity_id || '|len')) AS r FROM ent) WHERE r <= 20")
def J11_length_sample(spark, d):
    w = Window.partitionBy("source").orderBy(training.keyed("len", F.col("entity_id")))
    return ent(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20").select("source", "entity_id", F.length("business_name").alias("n"))


@query(S.with_(ENT) + "SELECT business_name, country, min(entity_id) AS entity_id FROM ent GROUP BY 1, 2")
def J12_dedup_first(spark, d):
    """The first row of each (name, country), by id."""
    return ent(spark, d).groupBy("business_name", "country").agg(F.min("entity_id").alias("entity_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def J13_order_limit(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(S.with_(ENT) + "SELECT DISTINCT business_name FROM ent ORDER BY business_name LIMIT 30")
def J16_distinct_limit(spark, d):
    return ent(spark, d).select("business_name").distinct().orderBy("business_name").limit(30)


# Sets


@query("SELECT c_custkey AS k, 'customer' AS origin, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', NULL FROM supplier")
def K1_union_all(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("origin")), allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def K2_union_distinct(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def K3_intersect(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(read(spark, d, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 1000")
def K4_except(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, d, "orders").where("o_totalprice > 1000").select("o_custkey"))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)


