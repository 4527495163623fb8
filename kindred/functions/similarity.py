"""Similarity functions on two columns.

Set measures, edit similarity and number similarity are plain column
expressions.  Jaro, Jaro-Winkler and Monge-Elkan have no built-in equivalent;
they are Arrow-batched functions, and callers evaluate them on distinct value
pairs only (see ``operators.features``).
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Set measures as formulas on the sizes of the intersection and of both token sets.
SET_FORMULAS = {
    "jaccard": lambda i, na, nb: i / (na + nb - i),
    "cosine": lambda i, na, nb: i / F.sqrt(na * nb),
    "dice": lambda i, na, nb: 2 * i / (na + nb),
    "overlap_coeff": lambda i, na, nb: i / F.least(na, nb),
}


def set_sizes(a: Column, b: Column, distinct: bool = False) -> tuple[Column, Column, Column]:
    """Sizes of the intersection and of both sets, for several measures to share.

    ``distinct`` says that the arrays hold no duplicates already.  The three
    sizes stay separate columns: the optimizer would inline a struct of them
    and compute each one once per use.
    """
    da, db = (a, b) if distinct else (F.array_distinct(a), F.array_distinct(b))
    return (F.size(F.array_intersect(da, db)).cast("double"), F.size(da).cast("double"), F.size(db).cast("double"))


def set_measure(name: str, i: Column, na: Column, nb: Column) -> Column:
    """Both sets empty scores 1, one empty scores 0, a missing side (size -1 or null) gives null."""
    return (F.when(na.isNull() | nb.isNull() | (na < 0) | (nb < 0), F.lit(None).cast("double"))
            .when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(SET_FORMULAS[name](i, na, nb)))


def jaccard(a: Column, b: Column) -> Column:
    return set_measure("jaccard", *set_sizes(a, b))


def cosine(a: Column, b: Column) -> Column:
    return set_measure("cosine", *set_sizes(a, b))


def dice(a: Column, b: Column) -> Column:
    return set_measure("dice", *set_sizes(a, b))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return set_measure("overlap_coeff", *set_sizes(a, b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def exact_match(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def absolute_norm(a: Column, b: Column) -> Column:
    """``1 - |a-b| / max(|a|,|b|)`` on numbers, never below 0; two zeros score 1."""
    x, y = a.try_cast("double"), b.try_cast("double")
    top = F.greatest(F.abs(x), F.abs(y))
    score = F.when(top == 0, F.lit(1.0)).otherwise(1 - F.least(F.lit(1.0), F.try_divide(F.abs(x - y), top)))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).otherwise(score)


#: Token and value pairs that a worker remembers; memory only.
REMEMBERED = 1 << 20


def _jaro_score(s: str, t: str) -> float:
    if s == t:
        return 1.0
    n, m = len(s), len(t)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = bytearray(m)
    matched = []
    for i, ch in enumerate(s):
        lo, hi = max(0, i - reach), min(m, i + reach + 1)
        j = t.find(ch, lo, hi)
        while j != -1 and taken[j]:
            j = t.find(ch, j + 1, hi)
        if j != -1:
            taken[j] = 1
            matched.append(ch)
    k = len(matched)
    if not k:
        return 0.0
    other = [t[j] for j in range(m) if taken[j]]
    moved = sum(x != y for x, y in zip(matched, other)) // 2
    return (k / n + k / m + (k - moved) / k) / 3


@lru_cache(maxsize=REMEMBERED)
def _winkler_score(s: str, t: str, weight: float = 0.1) -> float:
    base = _jaro_score(s, t)
    shared = 0
    for x, y in zip(s[:4], t[:4]):
        if x != y:
            break
        shared += 1
    return base + shared * weight * (1 - base)


def _elkan_score(a, b) -> float:
    """Mean over the left tokens of their best Jaro-Winkler score on the right."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return sum(max(_winkler_score(x, y) for y in b) for x in a) / len(a)


def _pairwise(score):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)],
                         dtype="float64")
    return apply


def jaro(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(_jaro_score), "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Prefix bonus of 0.1 per shared leading character (at most 4), whatever the base score."""
    return F.pandas_udf(_pairwise(_winkler_score), "double")(a, b)


def monge_elkan(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(_elkan_score), "double")(a, b)


# Measure -> short name used in feature names.
SHORT_NAMES = {
    "jaccard": "jac",
    "cosine": "cos",
    "dice": "dice",
    "overlap_coeff": "overlap_coeff",
    "lev_sim": "lev_sim",
    "jaro": "jar",
    "jaro_winkler": "jwn",
    "monge_elkan": "mel",
    "exact_match": "exm",
    "abs_norm": "anm",
}

MEASURES = {
    "jaccard": jaccard,
    "cosine": cosine,
    "dice": dice,
    "overlap_coeff": overlap_coefficient,
    "lev_sim": levenshtein_similarity,
    "jaro": jaro,
    "jaro_winkler": jaro_winkler,
    "monge_elkan": monge_elkan,
    "exact_match": exact_match,
    "abs_norm": absolute_norm,
}

# Measures that run outside the JVM.
PYTHON_MEASURES = {"jaro", "jaro_winkler", "monge_elkan"}


def similarity(name: str):
    """A measure by name: ``f(left_column, right_column) -> Column``."""
    return MEASURES[name]
