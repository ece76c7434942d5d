"""Engineered records and blocking keys. Keys are kept long, (id, rule, key): one shuffle serves every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scripts, text, tokens
from ..functions.dictionaries import CONTRACT, EXPAND_KEYS, EXPAND_PROFILE

ID = "entity_id"


def engineered(records: DataFrame, fallback: bool = True, aliases: bool = True) -> DataFrame:
    """G1: records with normal name and address, core, numbers, postal code, tokens and prefixes."""
    out = records.withColumns({"name_norm": text.normal_name(F.col("business_name")), "address_norm": text.normal_name(F.col("business_address"))})
    out = out.withColumn("name_core", text.core(F.col("name_norm"), fallback))
    postal = tokens.postal if aliases else tokens.postal_exact
    out = out.withColumns({"numbers": F.array_join(tokens.numbers(F.col("address_norm")), " "), "postal": postal(F.col("address_norm"), F.col("country")), "name_tokens": text.tokens(F.col("name_core"))})
    return out.withColumns({
        "name_first": tokens.first(F.col("name_tokens")), "name_last": tokens.last(F.col("name_tokens")), "name_chars": F.replace("name_core", F.lit(" "), F.lit("")),
        "name_prefix4": tokens.prefix(F.col("name_core"), 4), "name_prefix6": tokens.prefix(F.col("name_core"), 6),
    })


def key_features(records: DataFrame) -> DataFrame:
    """The columns of the key file, its five block columns included."""
    name, address = F.col("business_name"), F.col("business_address")
    out = records.withColumns({
        "country": text.normal_country(F.col("country")), "name_script": scripts.script_fast(name), "address_script": scripts.script_fast(address),
        "name_translit": text.clean_transliterated(name), "address_translit": text.clean_transliterated(address), "postal_code": tokens.postal_raw(address, F.col("country")),
    })
    out = out.withColumns({"name_expanded": text.expand(F.col("name_translit"), EXPAND_KEYS), "address_expanded": text.expand(F.col("address_translit"), EXPAND_KEYS)})
    out = out.withColumn("name_core", text.strip_suffix(F.col("name_expanded")))
    out = out.withColumns({"name_compact": text.compact(F.col("name_core")), "name_exact": F.col("name_core"), "name_token_pair": tokens.longest_pair(F.col("name_core"))})
    out = out.withColumns({"name_prefix4": F.substring("name_compact", 1, 4), "name_prefix6": F.substring("name_compact", 1, 6)})
    return out.withColumns({rule: key for rule, key in _builder(out).items()}).drop("business_name", "business_address")


def matcher_features(records: DataFrame) -> DataFrame:
    """The matcher's record: script-preserving texts, scripts, number and token sets, postal code."""
    out = records.withColumns({"name_norm": text.clean_preserving(F.col("business_name")), "address_norm": text.clean_preserving(F.col("business_address"))})
    return out.withColumns({
        "name_script": scripts.script_counted(F.col("name_norm")), "address_script": scripts.script_counted(F.col("address_norm")),
        "number_tokens": F.array_distinct(tokens.numbers(F.col("address_norm"))), "postal": tokens.postal_by_length(tokens.numbers(F.col("address_norm")), F.col("country")),
        "name_tokens": tokens.token_set(F.col("name_norm")), "address_tokens": tokens.token_set(F.col("address_norm")),
    })


def pipeline_features(records: DataFrame) -> DataFrame:
    """The staged pipeline's record: contracted texts, Latin tokens, numbers, prefixes."""
    out = records.withColumns({"name_norm": text.clean_contracted(F.col("business_name"), CONTRACT), "addr_norm": text.clean_contracted(F.col("business_address"), CONTRACT)})
    numbers = tokens.numbers(F.col("addr_norm"))
    return out.withColumns({
        "name_tokens": tokens.latin_tokens(F.col("name_norm")), "addr_tokens": tokens.latin_tokens(F.col("addr_norm")), "addr_numbers": F.array_distinct(numbers),
        "postal": tokens.postal_any(numbers), "name_prefix": tokens.prefix(F.col("name_norm"), 6), "name_prefix_p": tokens.prefix(F.col("name_norm"), 4),
    })


def profile_features(records: DataFrame) -> DataFrame:
    """F5 and C17's neighbours: profile names, prefixes, postal code and two keys with the country as it is."""
    out = records.withColumns({"name_norm": text.clean_for_blocking(F.col("business_name")), "address_norm": text.clean_for_blocking(F.col("business_address")), "postal_code": tokens.postal_profile(F.coalesce("business_address", F.lit("")))})
    out = out.withColumns({"name_prefix4": F.substring(text.compact(F.col("name_norm")), 1, 4), "name_prefix6": F.substring(text.compact(F.col("name_norm")), 1, 6), "name_first_token": tokens.first(text.tokens(F.col("name_norm")))})
    country = F.coalesce("country", F.lit(""))
    return out.withColumns({"country_name_prefix": F.concat(country, F.lit("_"), F.col("name_prefix4")), "country_postal": F.concat(country, F.lit("_"), F.col("postal_code"))})


def text_features(records: DataFrame) -> DataFrame:
    """C17: name, address and both merged, each normal, expanded and transliterated."""
    out = records
    for kind, make in (("norm", text.clean_words), ("expanded", lambda c: text.expand(text.clean_words(c), EXPAND_PROFILE)), ("translit", text.transliterate)):
        out = out.withColumns({f"name_{kind}": make(F.col("business_name")), f"address_{kind}": make(F.col("business_address"))})
        out = out.withColumn(f"merged_{kind}", text.merged(F.col(f"name_{kind}"), F.col(f"address_{kind}")))
    return out


def cleared(key: Column, strict: bool = False) -> Column:
    """a key whose last part is empty stands for nothing; strict (F7): nor does one with any empty part."""
    void = key.endswith("|") | key.isin("", "|", "||")
    if strict:
        void = void | key.contains("||") | key.startswith("|")
    return F.when(void, "").otherwise(key)


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def _v1(df: DataFrame) -> dict[str, Column]:
    c, col = text.normal_country(df["country"]), df.__getitem__
    return {
        "name_exact": _joined(c, col("name_norm")), "name_core": _joined(c, col("name_core")), "postal_name4": _joined(c, col("postal"), col("name_prefix4")),
        "postal_name6": _joined(c, col("postal"), col("name_prefix6")), "postal_first": _joined(c, col("postal"), col("name_first")),
        "first_last": _joined(c, col("name_first"), col("name_last")), "number_first": _joined(c, col("numbers"), col("name_first")),
        "number_name4": _joined(c, col("numbers"), col("name_prefix4")),
    }


def _builder(df: DataFrame, strict: bool = False) -> dict[str, Column]:
    c, col = df["country"], df.__getitem__
    keys = {
        "block_postal_name4": _joined(c, col("postal_code"), col("name_prefix4")), "block_name_prefix6": _joined(c, col("name_prefix6")), "block_name_exact": _joined(c, col("name_exact")),
        "block_token_pair": _joined(c, col("name_token_pair")), "block_postal": _joined(c, col("postal_code")),
    }
    return {r: cleared(k, strict) for r, k in keys.items()}


def _matcher(df: DataFrame, country: bool) -> dict[str, Column]:
    name, postal = df["name_norm"], df["postal"]
    keys = {
        "postal_name4": F.when(postal == "", "").otherwise(_joined(postal, F.substring(name, 1, 4))), "name_prefix6": F.substring(name, 1, 6), "name_exact": name,
        "token_pair": tokens.sorted_pair(name), "postal": postal,
    }
    return {r: F.when(k == "", "").otherwise(_joined(text.normal_country(df["country"]), k)) for r, k in keys.items()} if country else keys


def long_keys(df: DataFrame, keys: dict[str, Column], keep=(ID, "source")) -> DataFrame:
    """(id, ..., rule, key) without keys that stand for nothing."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), k.alias("key")) for r, k in keys.items()])
    return df.select(*keep, F.explode(pairs).alias("k")).select(*keep, "k.rule", "k.key").where("key <> ''")


def keys_v1(engineered_: DataFrame, strict: bool = False, keep=(ID, "source")) -> DataFrame:
    """eight rules."""
    return long_keys(engineered_, {r: cleared(k, strict) for r, k in _v1(engineered_).items()}, keep)


def keys_builder(features: DataFrame, keep=(ID, "source")) -> DataFrame:
    """five rules, from the key file's columns."""
    return long_keys(features, {r: features[r] for r in ("block_postal_name4", "block_name_prefix6", "block_name_exact", "block_token_pair", "block_postal")}, keep)


def keys_matcher(features: DataFrame, country: bool = True, keep=(ID, "source")) -> DataFrame:
    """five rules; country tells whether it is part of the key."""
    return long_keys(features, _matcher(features, country), keep)


def keys_pipeline(features: DataFrame, composite: bool = True, keep=(ID, "source")) -> DataFrame:
    """four rules and a key for each token; composite joins the postal code to the four-letter prefix."""
    prefix = features["name_prefix_p"]
    if composite:
        prefix = F.when((features["postal"] == "") | (prefix == ""), "").otherwise(_joined(features["postal"], prefix))
    keys = {"rule_postal_name4": prefix, "rule_prefix6": features["name_prefix"], "rule_exact_name": features["name_norm"], "rule_postal": features["postal"]}
    tokens_ = features.select(*keep, F.lit("rule_token_pair").alias("rule"), F.explode("name_tokens").alias("key"))
    return long_keys(features, keys, keep).unionByName(tokens_)
