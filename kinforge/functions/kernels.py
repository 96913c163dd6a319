"""String similarity kernels behind Arrow functions: the ratio family on longest common subsequences, and Jaro-Winkler.

Definitions: ratio is 2 LCS / (|a| + |b|), 1 for two empty strings.  partial_ratio is the best ratio of the shorter
string against the longer one's windows of the same length, and against shorter windows at both ends; 0 if just one
is empty.  token_set_ratio is 0 if either has no words.  Jaro-Winkler uses prefix weight 0.1 up to four characters, and
is 1 for two empty strings and 0 if one is empty.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # zero bits mark the ends of matches
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short or not long:
        return float(short == long)
    if short in long:
        return 1.0
    n, letters, best = len(short), set(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(start, 0) : start + n]
        # only windows that begin (at the left end: end) with a letter of the short string can be best
        if (window[-1] if start < 0 else window[0]) in letters and 2 * len(window) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    core = " ".join(both)
    one, two = " ".join(both + left), " ".join(both + right)
    return max([ratio(one, two)] + ([ratio(core, one), ratio(core, two)] if both else []))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def pair_function(*kernels: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """One Arrow function that returns an array with the value of every kernel, so that a pair crosses over once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna("")))
        known = {p: [k(*p) for k in kernels] for p in set(pairs)}  # equal pairs of a batch are computed once
        return pd.Series([known[p] for p in pairs])

    return lambda a, b: both(a, b)


name_kernels = pair_function(ratio, partial_ratio, token_sort_ratio, token_set_ratio, jaro_winkler)
address_kernels = pair_function(ratio, partial_ratio, token_sort_ratio, token_set_ratio)
set_kernel = pair_function(token_set_ratio)
