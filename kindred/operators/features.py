"""Pair-similarity features of a candidate set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import (
    PYTHON_MEASURES, SET_FORMULAS, SHORT_NAMES, set_measure, set_sizes, similarity,
)
from kindred.functions.text import tokens
from kindred.operators.blocking import equal_records, overlap_block
from kindred.runtime import cut_lineage, spread

# Measures per attribute type.  Token measures run once per tokeniser of the type.
TOKEN_MEASURES = ["cosine", "dice", "monge_elkan", "overlap_coeff", "jaccard"]
TYPE_TOKENISERS = {
    "str_eq_1w": ["qgm_2", "qgm_3"],
    "str_bt_1w_5w": ["dlm_dc0", "qgm_3"],
    "str_bt_5w_10w": ["dlm_dc0", "qgm_3"],
    "str_gt_10w": ["dlm_dc0", "qgm_3"],
    "numeric": [],
    "boolean": [],
    "un_determined": [],
}
TYPE_VALUE_MEASURES = {
    "str_eq_1w": ["lev_sim", "jaro", "jaro_winkler", "exact_match"],
    "str_bt_1w_5w": ["lev_sim", "jaro", "jaro_winkler", "exact_match"],
    "str_bt_5w_10w": [],
    "str_gt_10w": [],
    "numeric": ["exact_match", "abs_norm", "lev_sim"],
    "boolean": ["exact_match"],
    "un_determined": [],
}
# Similarity kinds that are not scaled to [0, 1] and never kept.
UNSCALED_KINDS = ["lev_dist", "rdf", "aff", "sw", "swn", "nmw"]


def feature_name(attr: str, measure: str, tokeniser: str | None = None) -> str:
    stem = "_".join(attr.split())
    parts = [stem, stem, SHORT_NAMES[measure]] + ([tokeniser, tokeniser] if tokeniser else [])
    return "_".join(parts)


def feature_plan(types: dict[str, str], measures: set[str] | None = None) -> list[tuple]:
    """``(name, attribute, measure, tokeniser)`` for typed attributes; ids are never compared."""
    plan = []
    for attr, kind in types.items():
        if attr == "id":
            continue
        for m in TOKEN_MEASURES:
            for t in TYPE_TOKENISERS[kind]:
                plan.append((feature_name(attr, m, t), attr, m, t))
        for m in TYPE_VALUE_MEASURES[kind]:
            plan.append((feature_name(attr, m), attr, m, None))
    return [p for p in plan if measures is None or p[2] in measures]


def scaled_only(columns: list[str]) -> list[str]:
    """Names whose similarity kind (the part after ``attr_attr_``) is scaled to [0, 1].

    Attribute names are compared as whole halves, so ``affiliation_*`` or
    ``answer_*`` are kept.
    """
    def kind(name: str) -> str:
        parts = name.split("_")
        for half in range(1, len(parts) // 2 + 1):
            if parts[:half] == parts[half:2 * half]:
                return "_".join(parts[2 * half:])
        return ""
    return [c for c in columns
            if not any(kind(c) == u or kind(c).startswith(u + "_") for u in UNSCALED_KINDS)]


def label(cand: DataFrame, gt: DataFrame) -> DataFrame:
    """Add ``gold``: 1 for a known match, else 0."""
    known = gt.select("l_id", "r_id").distinct().withColumn("gold", F.lit(1))
    return cand.join(known, ["l_id", "r_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))


def _measure_columns(df: DataFrame, plan: list[tuple], keep: list[str], digits: int | None = None) -> DataFrame:
    """Evaluate a plan on value columns ``_l_<attr>`` / ``_r_<attr>``, rounded to ``digits``.

    Token sets come from columns ``_l_<attr>|<tokeniser>`` if the frame has
    them.  Set sizes are computed once per (attribute, tokeniser); the set
    measures are then arithmetic.
    """
    have = set(df.columns)
    arrays, sizes = {}, {}
    for _, attr, measure, tok in plan:
        if not tok:
            continue
        names = [f"_{s}_{attr}|{tok}" for s in "lr"]
        ready = names[0] in have
        if measure in SET_FORMULAS:
            made = set_sizes(*[F.col(f"`{n}`") for n in names], distinct=ready)
            sizes.update({f"_{k}_{attr}|{tok}": c for k, c in zip(("i", "na", "nb"), made)})
        if not ready:
            arrays.update({f"_{s}_{attr}|{tok}": tokens(F.col(f"`_{s}_{attr}`"), tok) for s in "lr"})
    if arrays:
        df = df.withColumns(arrays)
    if sizes:
        df = df.withColumns(sizes)
    cols = []
    for name, attr, measure, tok in plan:
        if measure in SET_FORMULAS:
            made = set_measure(measure, *[F.col(f"`_{k}_{attr}|{tok}`") for k in ("i", "na", "nb")])
        else:
            tail = f"|{tok}" if tok else ""
            made = similarity(measure)(F.col(f"`_l_{attr}{tail}`"), F.col(f"`_r_{attr}{tail}`"))
        cols.append((made if digits is None else F.round(made, digits)).alias(name))
    return df.select(*keep, *cols)


def pair_features(cand: DataFrame, l: DataFrame, r: DataFrame, plan: list[tuple], fill: bool = True,
                  distinct_values: list[str] | None = None, rows_per_task: int = 50_000, digits: int | None = None) -> DataFrame:
    """One double column per planned feature, rounded to ``digits`` if given; other candidate columns are kept.

    Attributes in ``distinct_values`` are compared once per distinct value pair
    and joined back, so repeated values cost one evaluation.  By default these
    are the attributes that have a measure outside the JVM, and those of which
    all values of both sides together make far fewer pairs than there are
    candidates.  All others are expressions on the joined values.
    """
    attrs = list(dict.fromkeys(p[1] for p in plan))
    keep = list(cand.columns)
    cand = cut_lineage(cand, "pairs")
    crossed = _few_values(l, r, attrs, cand.count() // 10)
    if distinct_values is None:
        distinct_values = [a for a in attrs if a in crossed or any(p[1] == a and p[2] in PYTHON_MEASURES for p in plan)]
    # Token sets of directly compared attributes are built once per record, not once per pair.
    sets = {(p[1], p[3]) for p in plan if p[3] and p[1] not in distinct_values}
    sets -= {(p[1], p[3]) for p in plan if p[3] and p[2] not in SET_FORMULAS}

    def values_of(e, side):
        made = [F.array_distinct(tokens(F.col(f"`{a}`").cast("string"), t)).alias(f"_{side}_{a}|{t}") for a, t in sorted(sets)]
        return e.select(F.col("id").alias(f"{side}_id"),
                        *[F.col(f"`{a}`").cast("string").alias(f"_{side}_{a}") for a in attrs], *made)

    lv, rv = values_of(l, "l"), values_of(r, "r")
    joined = spread(cand, ["l_id", "r_id"], rows_per_task).join(lv, "l_id").join(rv, "r_id")
    direct = [p for p in plan if p[1] not in distinct_values]
    carry = keep + [f"`_{s}_{a}`" for a in distinct_values for s in "lr"]
    out = _measure_columns(joined, direct, carry, digits)
    for a in distinct_values:
        pair = [f"_l_{a}", f"_r_{a}"]
        mine = [p for p in plan if p[1] == a]
        if a in crossed:
            values = lv.select(f"`{pair[0]}`").distinct().crossJoin(rv.select(f"`{pair[1]}`").distinct())
        else:
            values = joined.select(*[f"`{c}`" for c in pair])
        values = values.where(F.col(f"`{pair[0]}`").isNotNull() & F.col(f"`{pair[1]}`").isNotNull()).distinct()
        scored = _measure_columns(spread(cut_lineage(values, "values"), [f"`{c}`" for c in pair], rows_per_task // 10),
                                  mine, [f"`{c}`" for c in pair], digits)
        out = out.join(scored, pair, "left").drop(*pair)
    out = out.select(*keep, *[p[0] for p in plan])
    return out.fillna(0.0, [p[0] for p in plan]) if fill else out


def _few_values(l: DataFrame, r: DataFrame, attrs: list[str], most: int) -> set[str]:
    """Attributes of which all values of both sides together make at most ``most`` pairs."""
    if not attrs:
        return set()
    n = [e.agg(*[F.approx_count_distinct(f"`{a}`").alias(f"n{i}") for i, a in enumerate(attrs)]).first() for e in (l, r)]
    return {a for i, a in enumerate(attrs) if n[0][i] * n[1][i] <= most}


def block_and_compare(l: DataFrame, r: DataFrame, attr: str, n: int, plan: list[tuple], digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlap blocking and pair features of groups of records that agree in all that is compared.

    ``(table, left members, right members)``; ``expand_pairs`` gives the record
    pairs, ``group_sizes`` how many each row stands for.
    """
    cols = list(dict.fromkeys([attr, *[p[1] for p in plan]]))
    (le, lm), (re, rm) = equal_records(l, cols), equal_records(r, cols)
    cand = overlap_block(le, re, attr, n).drop("overlap")
    return pair_features(cand, le, re, plan, digits=digits), lm, rm


def constant_features(df: DataFrame, cols: list[str]) -> list[str]:
    """Features with a single value, from one aggregate."""
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"lo{i}"] == row[f"hi{i}"]]


def drop_constant(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*constant_features(df, cols))


def common_features(frames: list[DataFrame], cols: list[str]) -> list[str]:
    """Features that vary in every one of several tables."""
    lost = set().union(*[set(constant_features(f, cols)) for f in frames])
    return sorted(c for c in cols if c not in lost)


def mean_by_attr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of the features of each attribute (name part before the first underscore)."""
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(c.split("_")[0], []).append(c)
    keep = [c for c in df.columns if c not in cols]
    means = [(reduce(lambda a, b: a + b, [F.col(c) for c in g]) / len(g)).alias(a) for a, g in groups.items()]
    return df.select(*keep, *means)
