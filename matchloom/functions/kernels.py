"""Fuzzy scorers, 0 to 100: plain Python, as pandas UDFs, and `ratio` as an expression too."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_subsequence(a, b) / n


def join_sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer one, cut short at its ends."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    pairs = [(a, b), (b, a)] if len(a) == len(b) else [(a, b) if len(a) < len(b) else (b, a)]
    best = 0.0
    for short, long in pairs:
        m = len(short)
        for i in range(1 - m, len(long)):
            window = long[max(i, 0) : i + m]
            # No window can score more than all of the shorter of both in common.
            if window and 200.0 * min(m, len(window)) / (m + len(window)) > best:
                best = max(best, ratio(short, window))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(join_sorted(a), join_sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    with_x, with_y = shared + gap + len(only_x), shared + gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    scores = [100.0 - 100.0 * apart / (with_x + with_y)]
    if shared:
        scores += [100.0 - 100.0 * (gap + len(only)) / (shared + whole) for only, whole in ((only_x, with_x), (only_y, with_y))]
    return max(scores)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return max(partial_ratio(join_sorted(a), join_sorted(b)), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio,
    "partial_ratio": partial_ratio,
    "token_sort_ratio": token_sort_ratio,
    "token_set_ratio": token_set_ratio,
    "WRatio": weighted_ratio,
}


def scorer(name: str) -> Callable[[str, str], float]:
    """An unknown name means ratio."""
    return SCORERS.get(name, ratio)


def similarity(a: str, b: str, name: str = "ratio") -> float:
    """Of preprocessed strings: two empty ones are equal, one is unlike all others."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    return scorer(name)(a, b)


def upper_bound(a: str, b: str) -> float:
    """At least the ratio of the strings: from what letters they have in common, in any order."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * (Counter(a) & Counter(b)).total() / n


def score_udf(name: str, guard_empty: bool = False) -> Callable[[Column, Column], Column]:
    """A pandas UDF of two string columns; null where either is."""
    score = (lambda a, b: similarity(a, b, name)) if guard_empty else scorer(name)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def ratio_expression(a: Column, b: Column) -> Column:
    """`ratio` of strings of 62 characters at most, without Python: a bit for each character of `a`."""
    letters = F.split(a, "")
    masks = F.map_from_arrays(
        F.array_distinct(letters),
        F.transform(F.array_distinct(letters), lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0).cast("long"), lambda m, i: F.when(F.element_at(letters, i) == c, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))).otherwise(m))),
    )
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - 1

    def step(state: Column, c: Column) -> Column:
        hit = state.bitwiseAND(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long")))
        return (state + hit).bitwiseOR(state - hit).bitwiseAND(full)

    left = F.aggregate(F.split(b, ""), full, step)
    common = F.length(a) - F.bit_count(left)
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(200.0 * common / n)


def register(spark: SparkSession) -> None:
    """The scorers by name, for SQL."""
    for name in SCORERS:
        spark.udf.register(name.lower(), score_udf(name))
