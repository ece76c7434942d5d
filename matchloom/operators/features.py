"""Features of a candidate pair; a and b are structs of record columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import similarity as sim


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def cheap_score(a: Column, b: Column) -> Column:
    """M1: ranks candidates before the costly features; two empty addresses score a full ratio and no tokens."""
    r = lambda n, c: sim.score(n, a[c], b[c]) / 100.0
    postal = _flag((a["postal"] != "") & (a["postal"] == b["postal"]))
    return 0.40 * r("ratio", "name_norm") + 0.20 * r("token_set_ratio", "name_norm") + 0.25 * r("ratio", "address_norm") + 0.10 * r("token_set_ratio", "address_norm") + 0.05 * postal


#: The record columns that jaccard_score reads; a join before the cut to the best pairs carries no others.
JACCARD_COLUMNS = ["name_tokens", "address_tokens"]


def jaccard_score(a: Column, b: Column) -> Column:
    """A score without character kernels: token sets of names and addresses."""
    return F.round(0.6 * sim.jaccard(a["name_tokens"], b["name_tokens"]) + 0.4 * sim.jaccard(a["address_tokens"], b["address_tokens"]), 6)


def _within(a: Column, b: Column) -> Column:
    return _flag((a != "") & (F.contains(b, a) | F.contains(a, b)))


def native_features(a: Column, b: Column) -> dict[str, Column]:
    """M2's columns that need no character kernel."""
    out = {"country_exact": _flag(a["country"] == b["country"])}
    for f in ("name", "address"):
        x, y = a[f"{f}_norm"], b[f"{f}_norm"]
        longer = F.greatest(F.lit(1), F.length(x), F.length(y))
        out |= {
            f"{f}_exact": _flag((x == y) & (x != "")), f"{f}_token_jaccard": sim.jaccard(a[f"{f}_tokens"], b[f"{f}_tokens"]), f"{f}_length_diff": F.abs(F.length(x) - F.length(y)),
            f"{f}_length_ratio": F.least(F.length(x), F.length(y)) / longer, f"{f}_script_same": _flag(a[f"{f}_script"] == b[f"{f}_script"]), f"{f}_contains": _within(x, y),
        }
    return out | {"postal_exact": _flag((a["postal"] != "") & (a["postal"] == b["postal"])), "number_overlap": sim.overlap(a["number_tokens"], b["number_tokens"])}


KERNEL_FEATURES = {"ratio": "ratio", "wratio": "weighted_ratio", "token_sort": "token_sort_ratio", "token_set": "token_set_ratio"}


def matcher_features(a: Column, b: Column) -> dict[str, Column]:
    """M2: the matcher's 24 features."""
    out = native_features(a, b)
    for f in ("name", "address"):
        out |= {f"{f}_{n}": sim.safe(k, a[f"{f}_norm"], b[f"{f}_norm"]) for n, k in KERNEL_FEATURES.items()}
    return out | {"combined_score": 0.55 * out["name_ratio"] + 0.45 * out["address_ratio"]}


def pipeline_native(a: Column, b: Column) -> dict[str, Column]:
    """M3's columns that need no character kernel."""
    return {
        "name_exact": _flag(a["name_norm"] == b["name_norm"]), "name_tok_jaccard": sim.jaccard(a["name_tokens"], b["name_tokens"], 1.0),
        "name_tok_contain": sim.containment(a["name_tokens"], b["name_tokens"]), "name_prefix6_match": _flag(a["name_prefix"] == b["name_prefix"]),
        "addr_tok_jaccard": sim.jaccard(a["addr_tokens"], b["addr_tokens"], 1.0), "addr_tok_contain": sim.containment(a["addr_tokens"], b["addr_tokens"]),
        "addr_num_overlap": sim.jaccard(a["addr_numbers"], b["addr_numbers"], 1.0), "postal_match": _flag((a["postal"] == b["postal"]) & (a["postal"] != "")),
        "postal_missing": _flag((a["postal"] == "") | (b["postal"] == "")), "country_match": _flag(a["country"] == b["country"]),
    }


#: The names of pipeline_features, in their order.
PIPELINE_FEATURES = (
    "name_exact name_tok_jaccard name_tok_contain name_prefix6_match addr_tok_jaccard addr_tok_contain addr_num_overlap postal_match postal_missing country_match "
    "name_jw name_token_sort name_token_set name_partial addr_jw addr_token_sort combo_score"
).split()


def pipeline_features(a: Column, b: Column) -> dict[str, Column]:
    """M3: the staged pipeline's features, beside the rules' flags."""
    r = lambda n, c: sim.score(n, a[c], b[c]) / 100.0
    out = pipeline_native(a, b) | {
        "name_jw": sim.score("jaro_winkler", a["name_norm"], b["name_norm"]), "name_token_sort": r("token_sort_ratio", "name_norm"), "name_token_set": r("token_set_ratio", "name_norm"),
        "name_partial": r("partial_ratio", "name_norm"), "addr_jw": sim.score("jaro_winkler", a["addr_norm"], b["addr_norm"]), "addr_token_sort": r("token_sort_ratio", "addr_norm"),
    }
    return out | {"combo_score": 0.6 * out["name_token_set"] + 0.4 * out["addr_token_sort"]}
