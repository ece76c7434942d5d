"""Token, number, postal and id-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .dictionaries import COUNTRY_ALIASES, POSTAL


def token_set(column: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(text.tokens(column))


def latin_tokens(column: Column) -> Column:
    """D3: distinct runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0)))


def preview(words: Column, n: int = 15) -> list[Column]:
    """The first n tokens as columns, empty where there is none."""
    return [F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("")).alias(f"token_{i}") for i in range(1, n + 1)]


def first(words: Column) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))


def last(words: Column) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def prefix(column: Column, n: int) -> Column:
    """Without blanks."""
    return F.substring(F.replace(column, F.lit(" "), F.lit("")), 1, n)


def longest_pair(column: Column) -> Column:
    """The two longest tokens of three characters or more that aren't numbers, in order, joined."""
    fit = F.filter(text.tokens(column), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\p{Nd}+$"))
    ranked = F.array_sort(F.transform(fit, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda s: s["t"])), "|")


def sorted_pair(column: Column) -> Column:
    """The first two distinct tokens in order, joined."""
    return F.array_join(F.slice(F.array_sort(token_set(column)), 1, 2), "|")


def numbers(column: Column, pattern: str = r"\p{Nd}+") -> Column:
    """Runs of digits."""
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def compound_numbers(column: Column) -> Column:
    """Numbers with parts joined by - or /."""
    return numbers(column, r"\p{Nd}+(?:[-/]\p{Nd}+)*")


def number_features(column: Column) -> Column:
    """D13."""
    return F.struct(compound_numbers(column).alias("numbers"), F.size(compound_numbers(column)).alias("number_count"))


def _last_match(column: Column, pattern: str) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.lit(-1)), F.lit(""))


def postal_exact(address: Column, country: Column) -> Column:
    """By the country's exact name, last match, ZIP cut to five."""
    return F.when(country == "India", _last_match(address, POSTAL["INDIA"])).when(country == "US", F.substring(_last_match(address, POSTAL["US"]), 1, 5)).otherwise("")


def known_country(country: Column) -> Column:
    """Upper case, aliases resolved."""
    table = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    upper = text.normal_country(country)
    return F.coalesce(F.try_element_at(table, upper), upper)


def postal(address: Column, country: Column, patterns: dict[str, str] | None = None) -> Column:
    """By the country or an alias; the registry of patterns is open."""
    out, name = F.lit(""), known_country(country)
    for c, p in (POSTAL if patterns is None else patterns).items():
        out = F.when(name == c, F.substring(_last_match(address, p), 1, 5 if c == "US" else 6)).otherwise(out)
    return out


def postal_raw(address: Column, country: Column) -> Column:
    """On the raw address; six digits in India, ZIP or ZIP+4 whole in the US."""
    name = text.normal_country(country)
    return F.when(name.isin("INDIA", "IN"), _last_match(address, r"(?<!\d)\d{6}(?!\d)")).when(name.isin("US", "USA"), _last_match(address, r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)")).otherwise("")


def postal_by_length(numbers_: Column, country: Column) -> Column:
    """The first number with as many digits as the country's codes have."""
    name = known_country(country)
    digits = F.when(name == "US", 5).when(name == "INDIA", 6)
    return F.coalesce(F.try_element_at(F.filter(numbers_, lambda n: F.length(n) == digits), F.lit(1)), F.lit(""))


def postal_any(numbers_: Column) -> Column:
    """The last number of five or six digits."""
    return F.coalesce(F.try_element_at(F.filter(numbers_, lambda n: F.length(n).isin(5, 6)), F.lit(-1)), F.lit(""))


def postal_profile(column: Column) -> Column:
    """The first six-digit number, else the first ZIP or ZIP+4."""
    six, zip_ = F.regexp_extract(column, r"\b\d{6}\b", 0), F.regexp_extract(column, r"\b\d{5}(?:-\d{4})?\b", 0)
    return F.when(six != "", six).otherwise(zip_)


def id_list(column: Column) -> Column:
    """Ids between commas, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def source_tag(column: Column) -> Column:
    """D22."""
    return F.when(column.startswith("S2-"), "S2").when(column.startswith("S3-"), "S3").otherwise("UNKNOWN")


def count_of(column: Column, part: str) -> Column:
    """How often a literal string stands in a text."""
    return ((F.length(column) - F.length(F.replace(column, F.lit(part), F.lit("")))) / len(part)).cast("int")


def match_pattern(s2: Column, s3: Column) -> Column:
    """D24."""
    return F.when((s2 == 0) & (s3 == 0), "NONE").when(s3 == 0, "S2_ONLY").when(s2 == 0, "S3_ONLY").otherwise("S2_AND_S3")


def has_repeats(ids: Column) -> Column:
    """D25."""
    return F.size(ids) != F.size(F.array_distinct(ids))


def prefixes_valid(ids: Column) -> Column:
    """Nothing, or S2 and S3 ids only."""
    return F.forall(ids, lambda x: x.startswith("S2-") | x.startswith("S3-"))
