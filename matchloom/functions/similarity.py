"""String similarities. Character kernels run on distinct pairs of an Arrow batch; set measures stay in the JVM."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _where(a: str) -> dict[str, int]:
    """For each character a bit at each of its places."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    return where


def _lcs(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    if not a or not b:
        return 0
    where = where or _where(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """L1: twice the common subsequence over both lengths, 0 to 100; 100 for two empty texts."""
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """L2."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """L3: the best of the common tokens against either side, and of both sides' remainders with them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 100.0
    gap = 1 if both else 0
    n, n_p, n_q = len(both), len(both) + gap + len(p), len(both) + gap + len(q)
    shared = n + gap + _lcs(p, q)
    best = 200.0 * shared / (n_p + n_q)
    if both:
        best = max(best, 200.0 * n / (n + n_p), 200.0 * n / (n + n_q))
    return best


def _best_window(a: str, b: str) -> float:
    """The best ratio of a with a window of its length on b, ends cut short too.

    The characters in common bound a window's ratio; they are kept up to date from one window to the next, and
    only windows whose bound is above the best ratio so far are compared, those with the highest first."""
    n, need, have, common, bounds = len(a), Counter(a), Counter(), 0, []
    for i in range(1 - n, len(b)):
        if i + n <= len(b):
            c = b[i + n - 1]
            have[c] += 1
            common += have[c] <= need[c]
        if i > 0:
            c = b[i - 1]
            common -= have[c] <= need[c]
            have[c] -= 1
        bounds.append((200.0 * common / (n + min(i + n, len(b)) - max(0, i)), i))
    best, where = 0.0, _where(a)
    for bound, i in sorted(bounds, reverse=True):
        if bound <= best:
            break
        window = b[max(0, i) : i + n]
        best = max(best, 200.0 * _lcs(a, window, where) / (n + len(window)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """L4: the best ratio of the shorter text with a window of its length on the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(_best_window(a, b), _best_window(b, a) if len(a) == len(b) else 0.0)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    order = lambda t: " ".join(sorted(t.split()))
    return max(partial_ratio(order(a), order(b)), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """Whole texts, tokens and parts, weighed by how much the lengths differ."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if longer < 1.5:
        return max(base, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(base, partial_ratio(a, b) * scale, partial_token_ratio(a, b) * 0.95 * scale)


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; a shared prefix of up to four characters counts above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    crossed = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - crossed) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


KERNELS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "weighted_ratio": weighted_ratio,
    "jaro_winkler": jaro_winkler,
}


def _column(kernel: Callable[[str, str], float]):
    @F.arrow_udf(T.DoubleType())
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = list(zip(a.to_pylist(), b.to_pylist()))
        known = {p: None if None in p else kernel(*p) for p in set(pairs)}
        return pa.array([known[p] for p in pairs], pa.float64())

    return score


def score(name: str, a: Column, b: Column) -> Column:
    """One of KERNELS as a column; null where a side is null."""
    return _column(KERNELS[name])(a, b)


def safe(name: str, a: Column, b: Column) -> Column:
    """0 where a side is empty, else the score out of 1."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(score(name, a, b) / 100.0)


def all_scores(a: Column, b: Column) -> Column:
    """The four measures of a pair."""
    return F.struct(*[score(n, a, b).alias(n) for n in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")])


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """L9 (0 for two empty sets), L10 (1 for them)."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).otherwise(_common(a, b) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common ones over the smaller set."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_common(a, b) / F.least(F.size(a), F.size(b)))


def containment(a: Column, b: Column) -> Column:
    """Common ones over the first set."""
    return F.when(F.size(a) == 0, 0.0).otherwise(_common(a, b) / F.size(a))
