"""Queries for similarities, features, training, evaluation and submissions; and the whole linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import blocking, evaluation, features, keys, submission, training
from ..sources import sinks, tables
from . import sqltext as S
from .block_queries import _CAND, _pipe, _pkeys, _top, _TOPK, CAP, capped, folder, mat_once
from .projection import BIZ, ENT, GT, biz, ent, gt

ENG, KEYS, MAT, MKEYS, PIPE, PKEYS = S.ENG, S.KEYS, S.MAT, S.MKEYS, S.PIPE, S.PKEYS
Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LCS = """/*RECURSIVE*/
pr AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part),
dp(a, b, i, prev) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) FROM (SELECT {a} AS a, {b} AS b FROM pr)
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, jj: list_append(acc, CASE WHEN substr(b, jj[1], 1) = substr(a, i + 1, 1)
    THEN prev[jj[1]] + 1 ELSE greatest(prev[jj[1] + 1], acc[jj[1]]) END), [0::BIGINT])
  FROM dp WHERE i < length(a)),
res AS (SELECT DISTINCT a, b, round(200.0::DOUBLE * prev[length(b) + 1] / greatest(1, length(a) + length(b)), 6) AS score, prev[length(b) + 1] AS lcs FROM dp WHERE i = length(a))"""
_PARTS_SQL = "pr AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part)"


def _lcs_of(pairs: str) -> str:
    """The recursion over other pairs (a, b), each of them once."""
    return _LCS.format(a="a", b="b").replace(_PARTS_SQL, pairs)


_SORTED = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda z: z <> '')), ' ')"


def _parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()


@query(S.with_(_LCS.format(a="a", b="b")) + "SELECT a, b, score FROM res")
def L1_ratio(spark, d):
    return _parts(spark, d).select("a", "b", F.round(sim.score("ratio", F.col("a"), F.col("b")), 6).alias("score"))


@query(S.with_(_LCS.format(a=_SORTED.format("a"), b=_SORTED.format("b"))) + "SELECT a, b, score FROM res")
def L2_token_sort_ratio(spark, d):
    p = _parts(spark, d).select(*[F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda z: z != "")), " ").alias(c) for c in "ab"]).distinct()
    return p.select("a", "b", F.round(sim.score("token_sort_ratio", F.col("a"), F.col("b")), 6).alias("score"))


def _token_sets(table: str, x: str, y: str) -> str:
    """u: the common tokens of two texts and what each has besides, each in order as one text; pr: pairs of the latter."""
    only = lambda a, b: f"array_to_string(list_sort(list_filter({a}, lambda z: NOT list_contains({b}, z))), ' ')"
    return f"""tks AS (SELECT *, list_distinct({S.tokens(x)}) AS x, list_distinct({S.tokens(y)}) AS y FROM {table}),
u AS (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS common, {only('x', 'y')} AS p, {only('y', 'x')} AS q FROM tks),
pr AS (SELECT DISTINCT p AS a, q AS b FROM u)"""


_SET_SCORE = """CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE WHEN common <> '' AND (p = '' OR q = '') THEN 100.0::DOUBLE ELSE round(greatest(
  200.0::DOUBLE * (length(common) + g + lcs) / (2 * (length(common) + g) + length(p) + length(q)), CASE WHEN common <> '' THEN 200.0::DOUBLE * length(common) / (2 * length(common) + 1 + length(p)) ELSE 0 END,
  CASE WHEN common <> '' THEN 200.0::DOUBLE * length(common) / (2 * length(common) + 1 + length(q)) ELSE 0 END), 6) END"""


@query(
    S.with_(BIZ, _lcs_of(_token_sets("biz", "lower(business_name)", "lower(business_address)")))
    + f"SELECT entity_id, {_SET_SCORE} AS score FROM (SELECT *, CASE WHEN common = '' THEN 0 ELSE 1 END AS g FROM u) JOIN res ON a = p AND b = q"
)
def L3_token_set_ratio(spark, d):
    return biz(spark, d).select("entity_id", F.round(sim.score("token_set_ratio", F.lower("business_name"), F.lower("business_address")), 6).alias("score"))


_WINDOWS = """w0 AS (SELECT DISTINCT p_name AS n, p_type AS t, CASE WHEN length(p_name) <= length(p_type) THEN p_name ELSE p_type END AS s, CASE WHEN length(p_name) <= length(p_type) THEN p_type ELSE p_name END AS l FROM part),
w1 AS (SELECT n, t, s, l FROM w0 UNION SELECT n, t, l, s FROM w0 WHERE length(s) = length(l)),
w AS (SELECT n, t, s, unnest(list_distinct(list_transform(range(1 - length(s), length(l)), lambda i: substr(l, greatest(i, 0) + 1, length(s) + least(i, 0))))) AS part FROM w1),
pr AS (SELECT DISTINCT s AS a, part AS b FROM w)"""
_PARTIAL = "SELECT n AS a, t AS b, round(max(200.0::DOUBLE * lcs / (length(res.a) + length(res.b))), 6) AS score FROM w JOIN res ON res.a = s AND res.b = part GROUP BY n, t"


@query(S.with_(_lcs_of(_WINDOWS)) + _PARTIAL)
def L4_partial_ratio(spark, d):
    return _parts(spark, d).select("a", "b", F.round(sim.score("partial_ratio", F.col("a"), F.col("b")), 6).alias("score"))


def _partial_of(pairs: str) -> str:
    """wi: for each pair (s, l) its windows, on the longer text, or on either where they are equally long."""
    return f"""o0 AS (SELECT DISTINCT s, l FROM ({pairs})),
o1 AS (SELECT s, l, CASE WHEN length(s) <= length(l) THEN s ELSE l END AS lo, CASE WHEN length(s) <= length(l) THEN l ELSE s END AS hi FROM o0),
o2 AS (SELECT s, l, lo, hi FROM o1 UNION SELECT s, l, hi, lo FROM o1 WHERE length(lo) = length(hi)),
wi AS (SELECT s, l, lo, unnest(list_distinct(list_transform(range(1 - length(lo), length(hi)), lambda i: substr(hi, greatest(i, 0) + 1, length(lo) + least(i, 0))))) AS part FROM o2 WHERE lo <> '')"""


_WEIGHTED = f"""own AS (SELECT DISTINCT p_name AS n, p_type AS t, array_to_string(list_sort({S.tokens('p_name')}), ' ') AS sn, array_to_string(list_sort({S.tokens('p_type')}), ' ') AS st,
  array_to_string(list_sort(list_distinct({S.tokens('p_name')})), ' ') AS dn, array_to_string(list_sort(list_distinct({S.tokens('p_type')})), ' ') AS dt FROM part),
{_token_sets('own', 'n', 't').split(',' + chr(10) + 'pr AS')[0]},
{_partial_of('SELECT n AS s, t AS l FROM own UNION SELECT sn, st FROM own UNION SELECT dn, dt FROM own')},
pr AS (SELECT DISTINCT n AS a, t AS b FROM own UNION SELECT sn, st FROM own UNION SELECT p, q FROM u UNION SELECT lo, part FROM wi)"""
_RATIO = "200.0::DOUBLE * {0}.lcs / greatest(1, length({0}.a) + length({0}.b))"


@query(
    S.with_(_lcs_of(_WEIGHTED))
    + f""", pa AS (SELECT wi.s, wi.l, max({_RATIO.format('res')}) AS v FROM wi JOIN res ON res.a = lo AND res.b = part GROUP BY ALL),
m AS (SELECT u.n, u.t, {_RATIO.format('r')} AS ratio, {_RATIO.format('k')} AS sorted, {_SET_SCORE.replace('lcs', 'e.lcs').replace('round(greatest', '(greatest').replace('END), 6) END', 'END)) END')} AS sets,
  p1.v AS part, CASE WHEN common <> '' THEN 100.0::DOUBLE ELSE greatest(p2.v, p3.v) END AS part_tokens, greatest(length(u.n), length(u.t))::DOUBLE / least(length(u.n), length(u.t)) AS longer
  FROM (SELECT *, CASE WHEN common = '' THEN 0 ELSE 1 END AS g FROM u) u JOIN res r ON r.a = u.n AND r.b = u.t JOIN res k ON k.a = sn AND k.b = st JOIN res e ON e.a = p AND e.b = q
  JOIN pa p1 ON p1.s = u.n AND p1.l = u.t JOIN pa p2 ON p2.s = sn AND p2.l = st JOIN pa p3 ON p3.s = dn AND p3.l = dt)
SELECT n AS a, t AS b, round(CASE WHEN longer < 1.5 THEN greatest(ratio, 0.95::DOUBLE * greatest(sorted, sets))
  ELSE greatest(ratio, part * CASE WHEN longer <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END, part_tokens * 0.95::DOUBLE * CASE WHEN longer <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) END, 6) AS score FROM m"""
)
def L5_weighted_ratio(spark, d):
    return _parts(spark, d).select("a", "b", F.round(sim.score("weighted_ratio", F.col("a"), F.col("b")), 6).alias("score"))


@query("SELECT DISTINCT p_name AS a, p_type AS b, round(jaro_winkler_similarity(p_name, p_type), 6) AS score FROM part")
def L6_jaro_winkler(spark, d):
    return _parts(spark, d).select("a", "b", F.round(sim.score("jaro_winkler", F.col("a"), F.col("b")), 6).alias("score"))


@query(
    f"SELECT r.a, r.b, r.score AS ratio, o.score AS partial_ratio, k.score AS token_sort_ratio, e.score AS token_set_ratio FROM ({S.with_(_LCS.format(a='a', b='b'))} SELECT a, b, score FROM res) r "
    f"JOIN ({S.with_(_lcs_of(_WINDOWS))} {_PARTIAL}) o ON o.a = r.a AND o.b = r.b "
    f"JOIN ({S.with_('own AS (SELECT DISTINCT p_name AS n, p_type AS t FROM part)', _lcs_of('pr AS (SELECT DISTINCT ' + _SORTED.format('n') + ' AS a, ' + _SORTED.format('t') + ' AS b FROM own)'))} "
    f"SELECT n, t, score FROM own JOIN res ON a = {_SORTED.format('n')} AND b = {_SORTED.format('t')}) k ON k.n = r.a AND k.t = r.b "
    f"JOIN ({S.with_('own AS (SELECT DISTINCT p_name AS n, p_type AS t FROM part)', _lcs_of(_token_sets('own', 'n', 't')))} "
    f"SELECT n, t, {_SET_SCORE} AS score FROM (SELECT *, CASE WHEN common = '' THEN 0 ELSE 1 END AS g FROM u) JOIN res ON a = p AND b = q) e ON e.n = r.a AND e.t = r.b"
)
def L7_all_scores(spark, d):
    found = _parts(spark, d).select("a", "b", sim.all_scores(F.col("a"), F.col("b")).alias("s"))
    return found.select("a", "b", *[F.round(f"s.{c}", 6).alias(c) for c in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")])


_SAFE_PAIRS = "pr AS (SELECT DISTINCT left(business_name, 30) AS a, left(business_address, 30) AS b FROM ent)"


@query(
    S.with_(ENT, _lcs_of(_SAFE_PAIRS))
    + "SELECT pr.a, pr.b, CASE WHEN pr.a = '' OR pr.b = '' THEN 0.0::DOUBLE ELSE round(score / 100.0, 6) END AS score FROM pr LEFT JOIN res ON pr.a = res.a AND pr.b = res.b"
)
def L8_safe_ratio(spark, d):
    """Name against address: 0 where one is empty."""
    rows = ent(spark, d).select(F.left("business_name", F.lit(30)).alias("a"), F.left("business_address", F.lit(30)).alias("b")).distinct()
    return rows.select("a", "b", F.round(sim.safe("ratio", F.col("a"), F.col("b")), 6).alias("score"))


def _pairs(spark, d):
    """Candidates with both matcher records."""
    mat = mat_once(spark, d)
    return blocking.with_records(_top(spark, d, mat), mat)


def _scores_of(pairs: str) -> str:
    """alike: ratio and token_set of each distinct pair of texts (n, t), from one recursion; both 0 to 100."""
    made = _token_sets(f"(SELECT DISTINCT n, t FROM ({pairs}))", "n", "t").replace("pr AS (SELECT DISTINCT p AS a, q AS b FROM u)", "pr AS (SELECT DISTINCT n AS a, t AS b FROM u UNION SELECT p, q FROM u)")
    return _lcs_of(made) + f""",
alike AS (SELECT n, t, CASE WHEN n = '' AND t = '' THEN 100.0::DOUBLE ELSE {_RATIO.format('r')} END AS ratio, {_SET_SCORE.replace('lcs', 'e.lcs').replace('round(greatest', '(greatest').replace('END), 6) END', 'END)) END')} AS sets
  FROM (SELECT *, CASE WHEN common = '' THEN 0 ELSE 1 END AS g FROM u) JOIN res r ON r.a = n AND r.b = t JOIN res e ON e.a = p AND e.b = q)"""


_TOP_PAIRS = "SELECT a.name_norm AS n, b.name_norm AS t FROM top JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id UNION SELECT a.address_norm, b.address_norm FROM top JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id"


@query(
    S.with_(ENT, MAT, MKEYS, _TOPK.strip().lstrip(","), _scores_of(_TOP_PAIRS))
    + """SELECT s1_id, cand_id, top.source, round(0.40::DOUBLE * x.ratio / 100 + 0.20::DOUBLE * x.sets / 100 + 0.25::DOUBLE * y.ratio / 100 + 0.10::DOUBLE * y.sets / 100
  + 0.05::DOUBLE * CASE WHEN a.postal <> '' AND a.postal = b.postal THEN 1 ELSE 0 END, 6) AS cheap
FROM top JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id JOIN alike x ON x.n = a.name_norm AND x.t = b.name_norm JOIN alike y ON y.n = a.address_norm AND y.t = b.address_norm"""
)
def M1_cheap_score(spark, d):
    return _pairs(spark, d).select("s1_id", "cand_id", "source", F.round(features.cheap_score(F.col("a"), F.col("b")), 6).alias("cheap"))


def _m2(f: str) -> str:
    x, y = f"a.{f}_norm", f"b.{f}_norm"
    return f"""CASE WHEN {x} = {y} AND {x} <> '' THEN 1 ELSE 0 END AS {f}_exact, round({S.jaccard(f'a.{f}_tokens', f'b.{f}_tokens')}, 6) AS {f}_token_jaccard, abs(length({x}) - length({y})) AS {f}_length_diff,
round(least(length({x}), length({y}))::DOUBLE / greatest(1, length({x}), length({y})), 6) AS {f}_length_ratio, CASE WHEN a.{f}_script = b.{f}_script THEN 1 ELSE 0 END AS {f}_script_same,
CASE WHEN {x} <> '' AND (contains({y}, {x}) OR contains({x}, {y})) THEN 1 ELSE 0 END AS {f}_contains"""


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + f"""SELECT s1_id, cand_id, CASE WHEN a.country = b.country THEN 1 ELSE 0 END AS country_exact, {_m2('name')}, {_m2('address')}, CASE WHEN a.postal <> '' AND a.postal = b.postal THEN 1 ELSE 0 END AS postal_exact,
round(CASE WHEN len(a.number_tokens) = 0 OR len(b.number_tokens) = 0 THEN 0.0 ELSE len(list_intersect(a.number_tokens, b.number_tokens))::DOUBLE / least(len(a.number_tokens), len(b.number_tokens)) END, 6) AS number_overlap
FROM top JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id""")
def M2_native_features(spark, d):
    made = features.native_features(F.col("a"), F.col("b"))
    return _pairs(spark, d).select("s1_id", "cand_id", *[(F.round(c, 6) if n.endswith(("ratio", "jaccard", "overlap")) else c).alias(n) for n, c in made.items()])


@query()
def M2_matcher_features(spark, d):
    return _pairs(spark, d).select("s1_id", "cand_id", "source", *[F.round(c.cast("double"), 6).alias(n) for n, c in features.matcher_features(F.col("a"), F.col("b")).items()])


def _pipe_pairs(spark, d):
    pairs = blocking.pairs_with_rules(_pkeys(spark, d).where("rule IN ('rule_exact_name', 'rule_prefix6')"), most=CAP)
    return blocking.with_records(blocking.flagged(pairs, ["rule_exact_name", "rule_prefix6"]), _pipe(spark, d))


_PP = ", pp AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM pkeys a JOIN " + capped("pkeys") + " b USING (rule, key) WHERE a.source = 'S1' AND rule IN ('rule_exact_name', 'rule_prefix6'))"


def _contain(c: str) -> str:
    return f"CASE WHEN len(a.{c}) = 0 THEN 0.0 ELSE len(list_intersect(a.{c}, b.{c}))::DOUBLE / len(a.{c}) END"


@query(S.with_(ENT, PIPE, PKEYS) + _PP + f"""SELECT s1_id, cand_id, CASE WHEN a.name_norm = b.name_norm THEN 1 ELSE 0 END AS name_exact, round({S.jaccard('a.name_tokens', 'b.name_tokens', '1.0')}, 6) AS name_tok_jaccard, round({_contain('name_tokens')}, 6) AS name_tok_contain,
CASE WHEN a.name_prefix = b.name_prefix THEN 1 ELSE 0 END AS name_prefix6_match, round({S.jaccard('a.addr_tokens', 'b.addr_tokens', '1.0')}, 6) AS addr_tok_jaccard, round({_contain('addr_tokens')}, 6) AS addr_tok_contain,
round({S.jaccard('a.addr_numbers', 'b.addr_numbers', '1.0')}, 6) AS addr_num_overlap, CASE WHEN a.postal = b.postal AND a.postal <> '' THEN 1 ELSE 0 END AS postal_match, CASE WHEN a.postal = '' OR b.postal = '' THEN 1 ELSE 0 END AS postal_missing,
CASE WHEN a.country = b.country THEN 1 ELSE 0 END AS country_match FROM pp JOIN pipe a ON a.entity_id = s1_id JOIN pipe b ON b.entity_id = cand_id""")
def M3_native_features(spark, d):
    made = features.pipeline_native(F.col("a"), F.col("b"))
    return _pipe_pairs(spark, d).select("s1_id", "cand_id", *[(F.round(c, 6) if n.endswith(("jaccard", "contain", "overlap")) else c).alias(n) for n, c in made.items()])


@query()
def M3_pipeline_features(spark, d):
    return _pipe_pairs(spark, d).select("s1_id", "cand_id", "source", "rule_exact_name", "rule_prefix6", *[F.round(c.cast("double"), 6).alias(n) for n, c in features.pipeline_features(F.col("a"), F.col("b")).items()])


# Training


@query(S.with_(ENT, GT) + "SELECT DISTINCT source1_entity_id AS s1_id, matched_entity_id AS cand_id, left(matched_entity_id, 2) AS source FROM gt")
def N1_positives(spark, d):
    return training.positives(gt(spark, d), ent(spark, d).where("source = 'S1'"), ent(spark, d))


_POS = ", pos AS (SELECT DISTINCT source1_entity_id AS s1_id, matched_entity_id AS pos_id, left(matched_entity_id, 2) AS source FROM gt)"


@query(S.with_(ENT, MAT, MKEYS, GT) + _TOPK + _POS + """, wrong AS (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, cand_id) AS rank FROM top WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.s1_id = top.s1_id AND p.pos_id = top.cand_id))
SELECT s1_id, pos_id AS cand_id, source, 1 AS label FROM pos UNION SELECT s1_id, cand_id, source, 0 FROM pos JOIN wrong USING (s1_id, source) WHERE rank <= 4""")
def N2_training_pairs(spark, d):
    return training.training_pairs(N1_positives(spark, d), _top(spark, d))


_FRAME = ", l AS (SELECT s1_id, cand_id, CASE WHEN source1_entity_id IS NULL THEN 0 ELSE 1 END AS label FROM pp LEFT JOIN gt ON s1_id = source1_entity_id AND cand_id = matched_entity_id)"


@query(
    S.with_(ENT, PIPE, PKEYS, GT)
    + ", pp AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM pkeys a JOIN " + capped("pkeys") + " b USING (rule, key) WHERE a.source = 'S1' AND rule IN ('rule_exact_name', 'rule_prefix6'))"
    + _FRAME
    + """ SELECT s1_id, cand_id, label FROM l WHERE label = 1 UNION ALL SELECT s1_id, cand_id, label FROM (
  SELECT *, row_number() OVER (ORDER BY md5(s1_id || '|' || cand_id || '|42')) AS r FROM l WHERE label = 0) WHERE r <= 8 * (SELECT count(*) FROM l WHERE label = 1)"""
)
def N3_training_frame(spark, d):
    """Every labelled row of the training frame."""
    pairs = blocking.pairs_with_rules(_pkeys(spark, d).where("rule IN ('rule_exact_name', 'rule_prefix6')"), most=CAP).select("s1_id", "cand_id").distinct()
    return training.training_frame(pairs, gt(spark, d)).select("s1_id", "cand_id", "label")


FEATURES = features.PIPELINE_FEATURES


def _frame(spark, d):
    """Candidates with the staged pipeline's features and their label, written once: fitting passes over it again and again."""
    path = folder(spark)
    rows = _pipe_pairs(spark, d).select("s1_id", "cand_id", "source", *[c.cast("double").alias(n) for n, c in features.pipeline_features(F.col("a"), F.col("b")).items()])
    sinks.write_parquet(blocking.labelled(rows, gt(spark, d)), path)
    return spark.read.parquet(path)


def _scored(spark, d):
    frame = _frame(spark, d)
    ids = training.hash_split(ent(spark, d).where("source = 'S1'").select("entity_id")).where("is_train").select(F.col("entity_id").alias("s1_id"))
    model = training.train(frame.join(ids, "s1_id", "left_semi"), FEATURES, max_iter=15, max_depth=5)
    return model, training.scored(model, frame)


@query()
def N4_gbt_scores(spark, d):
    return _scored(spark, d)[1].select("s1_id", "cand_id", "label", F.round("score", 6).alias("score"))


def early_stopped(spark, d, most: int = 30):
    """Row and feature subsampling, least rows a leaf, and a held-out part that stops the boosting: its model and frame."""
    frame = _frame(spark, d)
    own = training.hash_split(ent(spark, d).where("source = 'S1'").select("entity_id")).select(F.col("entity_id").alias("s1_id"), (~F.col("is_train")).alias("held"))
    options = {"validationTol": 0.1, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 5}
    return training.train(frame.join(own, "s1_id"), FEATURES, max_iter=most, max_depth=5, step=0.5, validation="held", **options), frame


@query()
def N5_early_stop_scores(spark, d):
    model, frame = early_stopped(spark, d)
    return training.scored(model, frame).select("s1_id", "cand_id", "label", F.round("score", 6).alias("score"))


@query()
def I29_importances(spark, d):
    return spark.createDataFrame(training.importances(_scored(spark, d)[0], FEATURES), "feature string, importance double")


@query()
def B9_model_round_trip(spark, d):
    """Scores of a model that was saved and loaded again."""
    path = folder(spark)
    frame = _frame(spark, d)
    sinks.save_model(training.train(frame, FEATURES, max_iter=3, max_depth=3), path)
    return training.scored(sinks.load_model(path), frame).select("s1_id", "cand_id", F.round("score", 6).alias("score"))


_M2_COLUMNS = f"""CASE WHEN a.country = b.country THEN 1 ELSE 0 END AS country_exact, {_m2('name')}, {_m2('address')}, CASE WHEN a.postal <> '' AND a.postal = b.postal THEN 1 ELSE 0 END AS postal_exact,
round(CASE WHEN len(a.number_tokens) = 0 OR len(b.number_tokens) = 0 THEN 0.0 ELSE len(list_intersect(a.number_tokens, b.number_tokens))::DOUBLE / least(len(a.number_tokens), len(b.number_tokens)) END, 6) AS number_overlap"""


@query(
    S.with_(ENT, MAT, MKEYS, GT) + _TOPK + f"""SELECT s1_id, cand_id, top.source, CASE WHEN g.source1_entity_id IS NULL THEN 0 ELSE 1 END AS label, {_M2_COLUMNS}
FROM top JOIN mat a ON a.entity_id = s1_id JOIN mat b ON b.entity_id = cand_id LEFT JOIN (SELECT DISTINCT * FROM gt) g ON g.source1_entity_id = s1_id AND g.matched_entity_id = cand_id
WHERE ('0x' || left(md5(s1_id || '|42'), 8))::BIGINT / 4294967296.0 >= 0.5"""
)
def N7_validation_candidates(spark, d):
    ids = training.hash_split(ent(spark, d).where("source = 'S1'").select("entity_id"), 0.5).where("NOT is_train").select(F.col("entity_id").alias("s1_id"))
    rows = blocking.labelled(_pairs(spark, d).join(ids, "s1_id", "left_semi"), gt(spark, d))
    made = features.native_features(F.col("a"), F.col("b"))
    return rows.select("s1_id", "cand_id", "source", "label", *[F.round(c.cast("double"), 6).alias(n) for n, c in made.items()])


@query()
def N8_predictions(spark, d):
    """Every entity's matches by the model, as the submission has them."""
    return submission.match_lists(_scored(spark, d)[1], ent(spark, d).where("source = 'S1'"), 0.5)


# Evaluation: the token score of J4 stands for a probability


_SETS = S.with_(ENT, MAT, MKEYS, GT) + _TOPK + """,
tr AS (SELECT source1_entity_id AS s1_id, count(DISTINCT matched_entity_id) AS true FROM gt GROUP BY 1), tp AS (SELECT DISTINCT source1_entity_id AS s1_id, matched_entity_id AS cand_id, 1 AS hit FROM gt),
grid AS (SELECT unnest(range(10, 48)) AS t), ev AS (SELECT entity_id AS s1_id FROM ent WHERE source = 'S1'),
su AS (SELECT s1_id, t, count(*) AS predicted, count(hit) AS tp FROM top LEFT JOIN tp USING (s1_id, cand_id) JOIN grid ON score >= t / 50.0::DOUBLE GROUP BY ALL),
wp AS (SELECT s1_id, count(*) AS candidates FROM top GROUP BY 1),
ct AS (SELECT t, s1_id, coalesce(su.tp, 0) AS tp, coalesce(predicted, 0) AS predicted, coalesce(true, 0) AS true, coalesce(candidates, 0) AS candidates FROM ev CROSS JOIN grid LEFT JOIN tr USING (s1_id) LEFT JOIN wp USING (s1_id) LEFT JOIN su USING (s1_id, t)),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS p, CASE WHEN true > 0 THEN tp::DOUBLE / true ELSE 1 END AS r FROM ct),
fs AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END AS f FROM pr),
o3 AS (SELECT t / 50.0::DOUBLE AS threshold, count(*) AS entities, round(avg(CASE WHEN true = 0 AND predicted = 0 THEN 1 ELSE f END), 6) AS macro_f05 FROM fs GROUP BY t),
o2 AS (SELECT t / 50.0::DOUBLE AS threshold, count(*) AS entities, round(avg(CASE WHEN candidates = 0 AND true = 0 THEN 1 ELSE f END), 6) AS macro_f05 FROM fs GROUP BY t)
""".replace("AS true", 'AS "true"').replace("(true", '("true"').replace(" true ", ' "true" ')


def _counts(spark, d):
    return evaluation.entity_counts(_top(spark, d), gt(spark, d), ent(spark, d).where("source = 'S1'"))


@query("SELECT p / 10.0::DOUBLE AS p, r / 10.0::DOUBLE AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 1.25 * (p / 10.0::DOUBLE) * (r / 10.0::DOUBLE) / (0.25 * p / 10.0::DOUBLE + r / 10.0::DOUBLE) END, 6) AS f FROM range(0, 11) a(p), range(0, 11) b(r)")
def O1_fbeta(spark, d):
    grid = spark.range(121).select((F.col("id") % 11 / 10.0).alias("p"), (F.floor(F.col("id") / 11) / 10.0).alias("r"))
    return grid.select("p", "r", F.round(evaluation.fbeta(F.col("p"), F.col("r")), 6).alias("f"))


@query(_SETS + "SELECT * FROM o2")
def O2_macro_f05_compat(spark, d):
    return evaluation.macro_f05(_counts(spark, d), compat=True)


@query(_SETS + "SELECT * FROM o3")
def O3_macro_f05(spark, d):
    return evaluation.macro_f05(_counts(spark, d))


@query(_SETS + "SELECT * FROM o3 ORDER BY macro_f05 DESC, threshold LIMIT 1")
def O4_best_threshold(spark, d):
    return evaluation.best_threshold(O3_macro_f05(spark, d))


@query(S.with_(ENT, MAT, MKEYS, GT) + _TOPK + """, l AS (SELECT score, source1_entity_id IS NOT NULL AS y FROM top LEFT JOIN (SELECT DISTINCT * FROM gt) g ON s1_id = source1_entity_id AND cand_id = matched_entity_id),
c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND y) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT y) AS fp, count(*) FILTER (WHERE score < 0.5 AND y) AS fn FROM l), q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END, 6) AS f05 FROM q""")
def O5_pair_metrics(spark, d):
    return evaluation.pair_metrics(blocking.labelled(_top(spark, d), gt(spark, d)), 0.5)


# Submission


_ML = """, ml AS (SELECT e.entity_id AS source1_entity_id, coalesce(array_to_string(list_sort(list_distinct(list(cand_id) FILTER (WHERE cand_id IS NOT NULL))), ','), '') AS matched_entity_ids FROM ent e LEFT JOIN (SELECT * FROM top WHERE score >= 0.5) t ON t.s1_id = e.entity_id WHERE e.source = 'S1' GROUP BY 1)"""
_RL = """, rl AS (SELECT e.entity_id AS source1_entity_id, coalesce(array_to_string(list(cand_id ORDER BY score DESC, cand_id) FILTER (WHERE cand_id IS NOT NULL), ','), '') AS candidate_entity_ids FROM ent e LEFT JOIN top t ON t.s1_id = e.entity_id WHERE e.source = 'S1' GROUP BY 1)"""


def _s1(spark, d):
    return ent(spark, d).where("source = 'S1'")


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + _ML + " SELECT * FROM ml")
def P1_submission(spark, d):
    return submission.match_lists(_top(spark, d), _s1(spark, d), 0.5)


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + _RL + " SELECT * FROM rl")
def P2_ranked_candidates(spark, d):
    return submission.ranked_lists(_top(spark, d), _s1(spark, d), name="candidate_entity_ids")


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + _RL + " SELECT * FROM rl")
def B5_candidate_tsv(spark, d):
    """The candidate lists as the file has them."""
    path = folder(spark)
    sinks.write_tsv(P2_ranked_candidates(spark, d), path)
    return tables.read_tsv(spark, path, ["source1_entity_id", "candidate_entity_ids"])


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + "SELECT s1_id, array_to_string(list(cand_id ORDER BY score DESC, cand_id), ',') AS ids FROM top GROUP BY s1_id")
def J14_ids_by_score(spark, d):
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("cand_id").alias("i"))))
    return _top(spark, d).groupBy("s1_id").agg(F.array_join(F.transform(order, lambda x: x["i"]), ",").alias("ids"))


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + "SELECT s1_id, cand_id AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS n FROM top) WHERE n = 1")
def J15_argmax(spark, d):
    """Each entity's best candidate, the smaller id of equals, as one aggregate without a sort."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("cand_id").alias("i"))).alias("m")
    return _top(spark, d).groupBy("s1_id").agg(best).select("s1_id", F.col("m.i").alias("best"), (-F.col("m.s")).alias("score"))


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + "SELECT s1_id, cand_id, source FROM top")
def B6_candidate_dump(spark, d):
    return _top(spark, d).select("s1_id", "cand_id", "source")


_N = "substring(source1_entity_id, 4)::BIGINT"
_CHECKED = f""", fl AS (SELECT CASE WHEN n % 13 = 0 THEN 'S1-none' || source1_entity_id WHEN n % 17 = 0 THEN 'S1-0' ELSE source1_entity_id END AS source1_entity_id,
  CASE WHEN n % 7 = 0 THEN matched_entity_ids || ',S2-1,S2-1' WHEN n % 11 = 0 THEN matched_entity_ids || ',X-9' ELSE matched_entity_ids END AS s FROM (SELECT *, {_N} AS n FROM ml)),
own AS (SELECT source1_entity_id, list_filter(list_transform(string_split(s, ','), lambda z: trim(z)), lambda z: z <> '') AS ids FROM fl),
lng AS (SELECT source1_entity_id, unnest(ids) AS id FROM own), s1 AS (SELECT entity_id FROM ent WHERE source = 'S1'),
off AS (SELECT DISTINCT s1_id, cand_id FROM top)
SELECT 'missing_entity' AS rule, count(*) AS violations FROM s1 WHERE entity_id NOT IN (SELECT source1_entity_id FROM own)
UNION ALL SELECT 'unknown_entity', count(*) FROM own WHERE source1_entity_id NOT IN (SELECT entity_id FROM s1)
UNION ALL SELECT 'repeated_entity', count(*) FROM (SELECT 1 FROM own GROUP BY source1_entity_id HAVING count(*) > 1)
UNION ALL SELECT 'repeated_id', count(*) FROM own WHERE len(ids) <> len(list_distinct(ids))
UNION ALL SELECT 'bad_prefix', count(*) FROM own WHERE len(list_filter(ids, lambda z: NOT (prefix(z, 'S2-') OR prefix(z, 'S3-')))) > 0
UNION ALL SELECT 'unknown_id', count(*) FROM lng WHERE id NOT IN (SELECT entity_id FROM ent WHERE source <> 'S1')
UNION ALL SELECT 'not_a_candidate', count(*) FROM lng WHERE NOT EXISTS (SELECT 1 FROM off WHERE s1_id = source1_entity_id AND cand_id = id)"""


@query(S.with_(ENT, MAT, MKEYS) + _TOPK + _ML + _CHECKED)
def P4_validator(spark, d):
    """Lists with every kind of fault among them."""
    n, ids = F.substring("source1_entity_id", 4, 20).cast("long"), F.col("matched_entity_ids")
    lists = P1_submission(spark, d).withColumn("matched_entity_ids", F.when(n % 7 == 0, F.concat(ids, F.lit(",S2-1,S2-1"))).when(n % 11 == 0, F.concat(ids, F.lit(",X-9"))).otherwise(ids))
    entity = F.when(n % 13 == 0, F.concat(F.lit("S1-none"), "source1_entity_id")).when(n % 17 == 0, F.lit("S1-0")).otherwise(F.col("source1_entity_id"))
    return submission.violations(lists.withColumn("source1_entity_id", entity), P2_ranked_candidates(spark, d), _s1(spark, d), ent(spark, d).where("source <> 'S1'"))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
