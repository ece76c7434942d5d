"""Oracle SQL: text fragments that say, independently of the operators, what a column must hold."""

from __future__ import annotations

from ..functions import dictionaries as D

_S = r"[ \t\n\r\f\v]"


def literal(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def mapped(words: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in words.items())}}}"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'))"


def words(x: str) -> str:
    """Lower case, marks to blanks."""
    return collapse(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_ \t\n\r\f\v]', ' ', 'g')")


def casefolded(x: str) -> str:
    return collapse(f"replace(lower({x}), 'ß', 'ss')")


def words_folded(x: str) -> str:
    return words(f"replace(lower({x}), 'ß', 'ss')")


def fold(x: str) -> str:
    """ASCII, for Latin text."""
    return f"replace(strip_accents({x}), 'ß', 'ss')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x)}), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda tk: tk <> '')"


def without_null_like(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda tk: tk NOT IN ({literal(D.NULL_LIKE)})), ' ')"


def expanded(x: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_transform({tokens(x)}, lambda tk: coalesce({mapped(table)}[tk], tk)), ' ')"


def core(x: str) -> str:
    return f"array_to_string(list_filter({tokens(x)}, lambda tk: tk NOT IN ({literal(D.CORPORATE)})), ' ')"


def suffixless(x: str) -> str:
    return f"regexp_replace({x}, '(?: (?:{'|'.join(D.LEGAL_SUFFIXES)}))+$', '')"


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '\d+')"


def last(x: str) -> str:
    return f"coalesce(list_extract({x}, -1), '')"


def first(x: str) -> str:
    return f"coalesce(list_extract({x}, 1), '')"


def country(x: str) -> str:
    return f"upper(trim({x}))"


def aliased(x: str) -> str:
    return f"coalesce({mapped(D.COUNTRY_ALIASES)}[{country(x)}], {country(x)})"


def script(x: str, names, none: str, empty: bool) -> str:
    seen = ", ".join(f"CASE WHEN regexp_matches({x}, '[\\x{{{D.SCRIPTS[s][0]:04X}}}-\\x{{{D.SCRIPTS[s][1]:04X}}}]') THEN '{s}' END" for s in names)
    found = f"list_filter([{seen}, CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN 'LATIN' END], lambda z: z IS NOT NULL)"
    out = f"CASE len({found}) WHEN 0 THEN '{none}' WHEN 1 THEN {found}[1] ELSE 'MIXED' END"
    return f"CASE WHEN trim({x}) = '' THEN 'EMPTY' ELSE {out} END" if empty else out


def postal(address: str, name: str, patterns: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{c}' THEN substring({last(f"regexp_extract_all({address}, '{p}')")}, 1, {5 if c == 'US' else 6})" for c, p in patterns.items())
    return f"CASE {name} {cases} ELSE '' END"


def jaccard(a: str, b: str, both_empty: str = "0.0") -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {both_empty}::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def cleared(key: str) -> str:
    return f"CASE WHEN suffix({key}, '|') OR {key} IN ('', '|', '||') THEN '' ELSE {key} END"


def long_keys(table: str, keys: dict[str, str], keep: str = "entity_id, source") -> str:
    pairs = ", ".join(f"{{'rule': '{r}', 'key': {k}}}" for r, k in keys.items())
    return f"SELECT {keep}, k.rule AS rule, k.key AS key FROM (SELECT {keep}, unnest([{pairs}]) AS k FROM {table}) WHERE k.key <> ''"


#: Engineered records of ent, as operators.keys.engineered makes them.
ENG = f"""
eng1 AS (SELECT *, {expanded(clean('business_name'), D.EXPAND)} AS name_norm, {expanded(clean('business_address'), D.EXPAND)} AS address_norm FROM ent),
eng2 AS (SELECT *, CASE WHEN {core('name_norm')} = '' THEN name_norm ELSE {core('name_norm')} END AS name_core, array_to_string({numbers('address_norm')}, ' ') AS numbers,
  {postal('address_norm', aliased('country'), D.POSTAL)} AS postal FROM eng1),
eng AS (SELECT *, {tokens('name_core')} AS name_tokens, {first(tokens('name_core'))} AS name_first, {last(tokens('name_core'))} AS name_last, replace(name_core, ' ', '') AS name_chars,
  substring(replace(name_core, ' ', ''), 1, 4) AS name_prefix4, substring(replace(name_core, ' ', ''), 1, 6) AS name_prefix6 FROM eng2)"""
_C = country("country")
KEYS_V1 = {
    "name_exact": f"{_C} || '|' || name_norm", "name_core": f"{_C} || '|' || name_core", "postal_name4": f"{_C} || '|' || postal || '|' || name_prefix4",
    "postal_name6": f"{_C} || '|' || postal || '|' || name_prefix6", "postal_first": f"{_C} || '|' || postal || '|' || name_first",
    "first_last": f"{_C} || '|' || name_first || '|' || name_last", "number_first": f"{_C} || '|' || numbers || '|' || name_first",
    "number_name4": f"{_C} || '|' || numbers || '|' || name_prefix4",
}
KEYS = f"\nkeys AS ({long_keys('eng', {r: cleared(k) for r, k in KEYS_V1.items()})})"
#: Matcher records of ent.
MAT = f"""
mat1 AS (SELECT *, {words('business_name')} AS name_norm, {words('business_address')} AS address_norm FROM ent),
mat AS (SELECT *, {script('name_norm', D.INDIC, 'OTHER', True)} AS name_script, {script('address_norm', D.INDIC, 'OTHER', True)} AS address_script,
  list_distinct({numbers('address_norm')}) AS number_tokens,
  coalesce(list_extract(list_filter({numbers('address_norm')}, lambda z: length(z) = CASE {aliased('country')} WHEN 'US' THEN 5 WHEN 'INDIA' THEN 6 END), 1), '') AS postal,
  list_distinct({tokens('name_norm')}) AS name_tokens, list_distinct({tokens('address_norm')}) AS address_tokens FROM mat1)"""
_PAIR = "array_to_string(list_slice(list_sort(list_distinct({})), 1, 2), '|')".format(tokens("name_norm"))
KEYS_MATCHER = {
    "postal_name4": "CASE WHEN postal = '' THEN '' ELSE postal || '|' || substring(name_norm, 1, 4) END", "name_prefix6": "substring(name_norm, 1, 6)", "name_exact": "name_norm",
    "token_pair": _PAIR, "postal": "postal",
}
MKEYS = "\nmkeys AS ({})".format(long_keys("mat", {r: f"CASE WHEN {k} = '' THEN '' ELSE {_C} || '|' || {k} END" for r, k in KEYS_MATCHER.items()}))
#: The staged pipeline's records of ent.
_LATIN = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
PIPE = f"""
pipe1 AS (SELECT *, {expanded(words('business_name'), D.CONTRACT)} AS name_norm, {expanded(words('business_address'), D.CONTRACT)} AS addr_norm FROM ent),
pipe AS (SELECT *, {_LATIN.format('name_norm')} AS name_tokens, {_LATIN.format('addr_norm')} AS addr_tokens, list_distinct({numbers('addr_norm')}) AS addr_numbers,
  {last(f"list_filter({numbers('addr_norm')}, lambda z: length(z) IN (5, 6))")} AS postal, substring(replace(name_norm, ' ', ''), 1, 6) AS name_prefix,
  substring(replace(name_norm, ' ', ''), 1, 4) AS name_prefix_p FROM pipe1)"""
PKEYS = "\npkeys AS ({} UNION ALL SELECT entity_id, source, 'rule_token_pair', unnest(name_tokens) FROM pipe)".format(
    long_keys("pipe", {"rule_postal_name4": "CASE WHEN postal = '' OR name_prefix_p = '' THEN '' ELSE postal || '|' || name_prefix_p END", "rule_prefix6": "name_prefix", "rule_exact_name": "name_norm", "rule_postal": "postal"})
)


def with_(*ctes: str) -> str:
    recursive = " RECURSIVE" if any("RECURSIVE" in c for c in ctes) else ""
    return f"WITH{recursive} " + ",".join(c.replace("/*RECURSIVE*/", "") for c in ctes) + "\n"
