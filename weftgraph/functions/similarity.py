"""Jaro-Winkler and sequence similarity as Arrow UDFs, with native bounds that prune pairs before any UDF runs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler_value(a: str | None, b: str | None) -> float:
    """0 if either is blank, 1 if equal; case and outer spaces are ignored. Prefix weight 0.1, at most 4, boost above 0.7."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def sequence_value(a: str | None, b: str | None) -> float:
    """Share of matching characters in order (asymmetric: call with the earlier name first)."""
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


def _udf(value):
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([value(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(each, "double")


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    return _udf(jaro_winkler_value)(a, b)


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    return _udf(sequence_value)(a, b)


def letter_counts(c: Column) -> Column:
    """Characters of a string, numbered by repetition, so that set overlap is multiset overlap."""
    ordered = F.array_sort(F.split(F.lower(F.trim(c)), ""))
    return F.transform(ordered, lambda ch, i: F.concat(ch, (i - F.array_position(ordered, ch)).cast("string")))


def may_reach_jaro_winkler(a: Column, b: Column, letters_a: Column, letters_b: Column, threshold: float) -> Column:
    """Sound bound: never false for a pair whose Jaro-Winkler reaches the threshold."""
    la, lb = F.length(F.trim(a)), F.length(F.trim(b))
    common = F.size(F.array_intersect(letters_a, letters_b))
    jaro = (common / la + common / lb + 1) / 3
    prefix = F.when(F.substring(F.lower(F.trim(a)), 1, 1) == F.substring(F.lower(F.trim(b)), 1, 1), 4).otherwise(0)
    return jaro + F.lit(0.1) * prefix * (1 - jaro) >= threshold - 1e-9


def may_reach_sequence(a: Column, b: Column, letters_a: Column, letters_b: Column, threshold: float) -> Column:
    """Sound bound for sequence_ratio from lengths and the letters in common."""
    spare = F.least(F.length(a) - F.length(F.trim(a)), F.length(b) - F.length(F.trim(b)))  # outer spaces count here, but not among the letters
    common = F.size(F.array_intersect(letters_a, letters_b)) + spare
    return 2 * common / (F.length(a) + F.length(b)) >= threshold - 1e-9


def hashed_embedding(name: Column, dims: int = 64, gram: int = 3) -> Column:
    """A unit vector of a name's letter n-grams, hashed to ``dims`` places: an embedding that needs no model. Null for names without letters or digits."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    padded = F.concat(F.lit("^"), plain, F.lit("$"))
    places = F.transform(F.sequence(F.lit(1), F.length(padded) - (gram - 1)), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, gram)), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(plain != "", F.transform(counts, lambda x: (x / length).cast("float")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_score(a: Column, b: Column) -> Column:
    """1 - squared distance / 2: the cosine of unit vectors."""
    squared = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 - squared / 2
