"""Column expressions over entity text: serialisation and tokenisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aggregate_value(cols: list[str]) -> Column:
    """All attribute values of a record in one string; a missing value is the empty string."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def col_val(cols: list[str], prefix: str = "") -> Column:
    """``COL <name> VAL <value>`` form, lower-cased; ``prefix`` is stripped from names."""
    parts = [
        F.concat(F.lit(f"COL {c[len(prefix):].lower()} VAL "),
                 F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        for c in cols
    ]
    return F.concat_ws(" ", *parts)


def words(c: Column) -> Column:
    """Whitespace words, in order, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def qgrams(c: Column, q: int, padding: bool = True) -> Column:
    """Character q-grams, in order.  Padding puts q-1 ``#`` before and q-1 ``$`` after the text."""
    s = F.concat(F.lit("#" * (q - 1)), c, F.lit("$" * (q - 1))) if padding else c
    n = F.length(s) - (q - 1)
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(q)))
    return F.when(n > 0, grams).when(c.isNotNull(), F.array().cast("array<string>"))


# Tokeniser names as they appear in feature names.
TOKENISERS = {
    "dlm_dc0": words,
    "qgm_2": lambda c: qgrams(c, 2),
    "qgm_3": lambda c: qgrams(c, 3),
}


def tokens(c: Column, kind: str) -> Column:
    """Tokens of a text column by tokeniser name."""
    return TOKENISERS[kind](c)
