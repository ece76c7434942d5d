"""One query for each text, token, number, postal, script and set-similarity operator, over records made from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import scripts, similarity, text, tokens
from . import projection as P
from . import sqltext as S

def N() -> Column:  # noqa: N802
    return F.col("business_name")


def A() -> Column:  # noqa: N802
    return F.col("business_address")


def _both(make, sql) -> list[tuple[str, Callable[[], Column], str]]:
    return [("name", lambda: make(N()), sql("business_name")), ("address", lambda: make(A()), sql("business_address"))]


def _list(c: Column) -> Column:
    return F.array_join(c, "~")


def _sql_list(x: str) -> str:
    return f"array_to_string({x}, '~')"


def _clean_tokens(x: Column) -> Column:
    return text.tokens(text.clean_words(x))


_T = S.tokens(S.words_folded("business_name"))
_TA = S.tokens(S.words_folded("business_address"))
_NUMS = S.clean("business_address")
_PIN, _ZIP = r"\b\d{6}\b", r"\b\d{5}(?:-\d{4})?\b"
_RUNS = r"regexp_extract_all(business_address, '\d+(?:-\d+)?')"

#: name: (table, [(column, what makes the Spark expression when a query runs, oracle expression)])
SCALARS: dict[str, tuple[str, list[tuple[str, Callable[[], Column], str]]]] = {
    "C1_normalize_folded": ("ent", _both(text.clean_folded, S.clean)),
    "C2_normalize_preserving": ("biz", _both(text.clean_preserving, S.words)),
    "C3_normalize_casefold": ("ent", _both(text.clean_casefold, S.casefolded)),
    "C4_normalize_text": ("ent", _both(text.clean_words, S.words_folded)),
    "C5_clean_unicode": ("biz", _both(text.clean_unicode, lambda x: S.without_null_like(S.words_folded(x)))),
    "C6_clean_transliterated": ("ent", _both(text.clean_transliterated, lambda x: S.without_null_like(S.clean(x)))),
    "C7_transliterate": ("ent", _both(text.transliterate, S.fold)),
    "C8_normalize_contracted": ("biz", _both(lambda x: text.clean_contracted(x, D.CONTRACT), lambda x: S.expanded(S.words(x), D.CONTRACT))),
    "C9_normalize_for_blocking": ("biz", _both(text.clean_for_blocking, lambda x: S.collapse(f"regexp_replace({S.words_folded(x)}, '[^a-z0-9 ]+', ' ', 'g')"))),
    "C10_expand_abbreviations": (
        "biz",
        [(f"address_{n}", lambda d=d: text.expand(text.clean_words(A()), d), S.expanded(S.words_folded("business_address"), d)) for n, d in (("engineered", D.EXPAND), ("keys", D.EXPAND_KEYS), ("profile", D.EXPAND_PROFILE), ("short", D.CONTRACT))],
    ),
    "C11_normalize_name_address": ("ent", _both(text.normal_name, lambda x: S.expanded(S.clean(x), D.EXPAND))),
    "C12_name_core": ("biz", [("core", lambda: text.core(text.expand(text.clean_words(N()))), f"CASE WHEN {S.core(S.expanded(S.words_folded('business_name'), D.EXPAND))} = '' THEN {S.expanded(S.words_folded('business_name'), D.EXPAND)} ELSE {S.core(S.expanded(S.words_folded('business_name'), D.EXPAND))} END"),
                              ("core_v1", lambda: text.core(text.expand(text.clean_words(N())), False), S.core(S.expanded(S.words_folded("business_name"), D.EXPAND)))]),
    "C13_strip_legal_suffix": ("biz", [("stripped", lambda: text.strip_suffix(text.clean_words(N())), S.suffixless(S.words_folded("business_name")))]),
    "C14_name_core_builder": ("ent", [("core", lambda: text.strip_suffix(text.expand(text.clean_transliterated(N()), D.EXPAND_KEYS)), S.suffixless(S.expanded(S.without_null_like(S.clean("business_name")), D.EXPAND_KEYS)))]),
    "C15_compact_alnum": ("biz", _both(lambda x: text.compact(F.lower(x)), lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')")),
    "C16_merged_text": ("biz", [("merged", lambda: text.merged(N(), A()), "trim(business_name || ' ' || business_address)")]),
    "C18_country": ("biz", [("country_norm", lambda: text.normal_country(F.col("country")), S.country("country"))]),
    "D1_tokenize_list": ("biz", _both(lambda x: _list(_clean_tokens(x)), lambda x: _sql_list(S.tokens(S.words_folded(x))))),
    "D2_tokenize_set": ("ent", _both(lambda x: _list(F.array_sort(tokens.token_set(text.clean_words(x)))), lambda x: _sql_list(f"list_sort(list_distinct({S.tokens(S.words_folded(x))}))"))),
    "D3_tokenize_latin": ("biz", _both(lambda x: _list(F.array_sort(tokens.latin_tokens(x))), lambda x: _sql_list(f"list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')))"))),
    "D4_token_preview": ("ent", [(f"token_{i + 1}", lambda i=i: tokens.preview(_clean_tokens(A()))[i], f"coalesce(list_extract({_TA}, {i + 1}), '')") for i in range(15)]),
    "D5_first_last_token": ("biz", [("first_token", lambda: tokens.first(_clean_tokens(N())), S.first(_T)), ("last_token", lambda: tokens.last(_clean_tokens(N())), S.last(_T))]),
    "D6_compact_prefix": ("ent", [(f"prefix{n}", lambda n=n: tokens.prefix(text.clean_words(N()), n), f"substring(replace({S.words_folded('business_name')}, ' ', ''), 1, {n})") for n in (4, 6)]),
    "D7_first_chars": ("ent", [(f"chars{n}", lambda n=n: F.substring(text.clean_words(N()), 1, n), f"substring({S.words_folded('business_name')}, 1, {n})") for n in (4, 6)]),
    "D8_longest_token_pair": ("biz", [("pair", lambda: tokens.longest_pair(text.clean_words(N())),
        f"array_to_string(list_sort(list_transform(list_slice(list_sort(list_transform(list_filter({_T}, lambda z: length(z) >= 3 AND NOT regexp_full_match(z, '\\d+')), lambda z: {{'n': -length(z), 't': z}})), 1, 2), lambda z: z.t)), '|')")]),
    "D9_sorted_token_pair": ("biz", [("pair", lambda: tokens.sorted_pair(text.clean_words(N())), f"array_to_string(list_slice(list_sort(list_distinct({_T})), 1, 2), '|')")]),
    "D10_numbers_joined": ("biz", [("numbers", lambda: F.array_join(tokens.numbers(A()), " "), f"array_to_string({S.numbers('business_address')}, ' ')")]),
    "D11_numbers_set": ("biz", [("numbers", lambda: _list(F.array_sort(F.array_distinct(tokens.numbers(A())))), _sql_list(f"list_sort(list_distinct({S.numbers('business_address')}))"))]),
    "D12_numbers_compound": ("biz", [("numbers", lambda: _list(tokens.compound_numbers(A())), _sql_list(r"regexp_extract_all(business_address, '\d+(?:[-/]\d+)*')"))]),
    "D13_number_features": ("biz", [("numbers", lambda: _list(tokens.number_features(A())["numbers"]), _sql_list(r"regexp_extract_all(business_address, '\d+(?:[-/]\d+)*')")),
                                    ("number_count", lambda: tokens.number_features(A())["number_count"], r"len(regexp_extract_all(business_address, '\d+(?:[-/]\d+)*'))")]),
    "D14_postal_v1": ("biz", [("postal", lambda: tokens.postal_exact(text.clean_folded(A()), F.col("country")),
        f"CASE country WHEN 'India' THEN {S.last(f"regexp_extract_all({_NUMS}, '{D.POSTAL['INDIA']}')")} WHEN 'US' THEN substring({S.last(f"regexp_extract_all({_NUMS}, '{D.POSTAL['US']}')")}, 1, 5) ELSE '' END")]),
    "D15_postal_v2": ("biz", [("postal", lambda: tokens.postal(text.clean_folded(A()), F.col("country")), S.postal(_NUMS, S.aliased("country"), D.POSTAL))]),
    "D16_postal_raw": ("biz", [("postal", lambda: tokens.postal_raw(A(), F.col("country")),
        f"CASE WHEN {S.country('country')} IN ('INDIA', 'IN') THEN {S.last("list_filter(regexp_extract_all(business_address, '\\d+'), lambda z: length(z) = 6)")} WHEN {S.country('country')} IN ('US', 'USA') THEN {S.last(f"list_filter({_RUNS}, lambda z: regexp_full_match(z, '\\d{{5}}(-\\d{{4}})?'))")} ELSE '' END")]),
    "D17_postal_matcher": ("biz", [("postal", lambda: tokens.postal_by_length(tokens.numbers(A()), F.col("country")),
        f"coalesce(list_extract(list_filter({S.numbers('business_address')}, lambda z: length(z) = CASE {S.aliased('country')} WHEN 'US' THEN 5 WHEN 'INDIA' THEN 6 END), 1), '')")]),
    "D18_postal_pipeline": ("biz", [("postal", lambda: tokens.postal_any(tokens.numbers(A())), S.last(f"list_filter({S.numbers('business_address')}, lambda z: length(z) IN (5, 6))"))]),
    "D19_postal_profile": ("biz", [("postal", lambda: tokens.postal_profile(A()), f"CASE WHEN regexp_extract(business_address, '{_PIN}') <> '' THEN regexp_extract(business_address, '{_PIN}') ELSE regexp_extract(business_address, '{_ZIP}') END")]),
    "D22_source_tag": ("ent", [("tag", lambda: tokens.source_tag(F.col("entity_id")), "CASE WHEN entity_id LIKE 'S2-%' THEN 'S2' WHEN entity_id LIKE 'S3-%' THEN 'S3' ELSE 'UNKNOWN' END")]),
    "D23_substring_count": ("ent", [("commas", lambda: tokens.count_of(A(), ","), "length(business_address) - length(replace(business_address, ',', ''))"), ("the", lambda: tokens.count_of(A(), "the"), "len(regexp_extract_all(business_address, 'the'))")]),
    "E1_script_fast": ("biz", _both(scripts.script_fast, lambda x: S.script(x, D.SCRIPTS, "OTHER", True))),
    "E2_script_counted": ("biz", _both(scripts.script_counted, lambda x: S.script(x, D.INDIC, "OTHER", True)) + [("digits", lambda: scripts.script_counted(F.regexp_replace(A(), r"[^0-9]", "")), "'OTHER'")]),
    "E3_script_profile": ("biz", _both(scripts.script_profile, lambda x: S.script(x, D.SCRIPTS, "EMPTY", False)) + [("digits", lambda: scripts.script_profile(F.regexp_replace(A(), r"[^0-9]", "")), "'EMPTY'")]),
    "G13_null_fill": ("ent", [("name", lambda: F.coalesce(F.nullif(N(), F.lit("That it.")), F.lit("")), "coalesce(nullif(business_name, 'That it.'), '')")]),
    "G14_conditional_zero": ("ent", [("n", lambda: F.when(A() == "", 0).otherwise(tokens.count_of(A(), ",") + 1), "CASE WHEN business_address = '' THEN 0 ELSE length(business_address) - length(replace(business_address, ',', '')) + 1 END")]),
    "L9_jaccard": ("ent", [("jaccard", lambda: F.round(similarity.jaccard(_clean_tokens(N()), _clean_tokens(A())), 6), f"round({S.jaccard(_T, _TA)}, 6)")]),
    "L10_jaccard_empty_one": ("ent", [("jaccard", lambda: F.round(similarity.jaccard(tokens.numbers(N()), tokens.numbers(A()), 1.0), 6), f"round({S.jaccard(S.numbers('business_name'), S.numbers('business_address'), '1.0')}, 6)")]),
    "L11_overlap_ratio": ("biz", [("overlap", lambda: F.round(similarity.overlap(F.array_distinct(tokens.numbers(A())), F.array_distinct(tokens.numbers(N()))), 6),
        f"round(CASE WHEN len({S.numbers('business_name')}) = 0 OR len({S.numbers('business_address')}) = 0 THEN 0.0 ELSE len(list_intersect({S.numbers('business_name')}, {S.numbers('business_address')}))::DOUBLE / least(len(list_distinct({S.numbers('business_name')})), len(list_distinct({S.numbers('business_address')}))) END, 6)")]),
    "L12_containment": ("ent", [("containment", lambda: F.round(similarity.containment(F.array_distinct(_clean_tokens(N())), _clean_tokens(A())), 6),
        f"round(CASE WHEN len({_T}) = 0 THEN 0.0 ELSE len(list_intersect({_T}, {_TA}))::DOUBLE / len(list_distinct({_T})) END, 6)")]),
    "K5_array_set_algebra": ("ent", [("both", lambda: F.size(F.array_intersect(_clean_tokens(N()), _clean_tokens(A()))), f"len(list_intersect({_T}, {_TA}))"),
        ("either", lambda: F.size(F.array_union(_clean_tokens(N()), _clean_tokens(A()))), f"len(list_distinct(list_concat({_T}, {_TA})))"), ("only_name", lambda: F.size(F.array_except(_clean_tokens(N()), _clean_tokens(A()))), f"len(list_distinct({_T})) - len(list_intersect({_T}, {_TA}))")]),
}


def _query(table: str, columns):
    def run(spark, sf_dir):
        return getattr(P, table)(spark, sf_dir).select("entity_id", *[make().alias(n) for n, make, _ in columns])

    return run


def queries():
    return {name: _query(*q) for name, q in SCALARS.items()}


def oracle_sql():
    base = {"ent": P.ENT, "biz": P.BIZ}
    return {name: S.with_(base[t]) + f"SELECT entity_id, {', '.join(f'{sql} AS {c}' for c, _, sql in columns)} FROM {t}" for name, (t, columns) in SCALARS.items()}
