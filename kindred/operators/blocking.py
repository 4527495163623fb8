"""Token-overlap, equality and all-pairs blocking; blocking quality.

Records whose token sets are equal are compared once and expanded at the end
(`overlap_groups` gives the compact form), so a large group of copies costs one
row in the join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import words
from kindred.runtime import cut_lineage, estimated_bytes, with_totals

# ASCII punctuation, removed before words are compared.
PUNCTUATION = r"[!-/:-@\[-`{-~]"

_RANKED = 10_000   # tokens above 1/10,000 of all token rows: by count there are at most 10,000 of them
_CODE_DIGITS = 12


def blocking_words(c: Column) -> Column:
    """Distinct lower-case words without punctuation, sorted."""
    return F.array_sort(F.array_distinct(words(F.regexp_replace(F.lower(c), PUNCTUATION, ""))))


def _token_sets(e: DataFrame, attr: str, equal_on: list[str]):
    """Distinct (equality keys, token set) under the smallest id, and the (id, rep) membership."""
    rec = e.select(F.col("id"), *equal_on, blocking_words(F.col(attr)).alias("toks"))
    for c in equal_on:
        rec = rec.where(F.col(c).isNotNull())
    sets = rec.groupBy(*equal_on, "toks").agg(F.min("id").alias("rep"))
    members = rec.join(sets, [*equal_on, "toks"]).select("id", "rep")
    return sets, members


def _coded(sets: DataFrame, ranked: DataFrame, equal_on: list[str]) -> DataFrame:
    """Token sets as codes that sort rare tokens first (unranked ones are rarest)."""
    code = F.concat(F.lpad(F.coalesce("df", F.lit(0)).cast("string"), _CODE_DIGITS, "0"), "tok")
    return (sets.select("rep", *equal_on, F.explode("toks").alias("tok"))
            .join(F.broadcast(ranked), "tok", "left")
            .groupBy("rep", *equal_on).agg(F.array_sort(F.collect_list(code)).alias("codes")))


def _df_of(code: Column) -> Column:
    return F.substring(code, 1, _CODE_DIGITS).cast("long")


def _keys(n: int, heavy: int | None) -> Column:
    """Join keys of one record.

    Two sets that share n tokens share one within the first ``size-n+1`` rare
    tokens.  Where that token is frequent and n > 1, the next shared one lies
    within the first ``size-n+2``; both together form the key, so no single
    frequent token ever becomes a join key.
    """
    codes = F.col("codes")
    p = F.size(codes) - (n - 1)

    def one(c, i):
        pairs = F.transform(F.slice(codes, i + 2, p - i), lambda d: F.concat(c, F.lit("|"), d))
        if n < 2 or heavy is None:
            return F.array(c)
        return F.when(_df_of(c) > heavy, pairs).otherwise(F.array(c))

    return F.flatten(F.transform(F.slice(codes, 1, p), one))


def overlap_groups(l: DataFrame, r: DataFrame, attr: str, n: int, equal_on: list[str] | None = None,
                   heavy: int | None = 500, r_attr: str | None = None):
    """Compact overlap blocking: ``(pairs of set representatives, left members, right members)``.

    ``equal_on`` adds attribute equality to the same join (equivalence blocking
    followed by overlap blocking, without the pairs of the first step).
    ``heavy`` is the record count above which a token is only used together with
    a second one; None uses single tokens only, which suits long texts, where
    token combinations outnumber the records they would keep apart.
    """
    eq = equal_on or []
    ls, lm = _token_sets(l, attr, eq)
    rs, rm = _token_sets(r, r_attr or attr, eq)
    ls, rs = ls.where(F.size("toks") >= n), rs.where(F.size("toks") >= n)
    counts = (ls.select(F.explode("toks").alias("tok")).unionByName(rs.select(F.explode("toks").alias("tok")))
              .groupBy("tok").agg(F.count(F.lit(1)).alias("df")))
    total = counts.agg(F.sum("df").alias("_all"))
    ranked = with_totals(counts, total).where(F.col("df") * _RANKED > F.col("_all")).select("tok", "df")

    def side(sets, name):
        coded = _coded(sets, ranked, eq)
        return coded.select(F.col("rep").alias(f"{name}_rep"), *eq, F.col("codes").alias(f"{name}_codes"),
                            F.explode(_keys(n, heavy)).alias("_key"))

    # Few bytes can make very many pairs here: a merge join keeps both sides partitioned by key.
    joined = side(ls, "l").join(side(rs, "r").hint("merge"), [*eq, "_key"])
    shared = joined.withColumn("both", F.array_intersect("l_codes", "r_codes")).where(F.size("both") >= n)
    first = F.col("both")[0]
    if n >= 2 and heavy is not None:
        first = F.when(_df_of(first) > heavy, F.concat(first, F.lit("|"), F.col("both")[1])).otherwise(first)
    # A pair is kept only at its rarest shared key: no duplicate removal is needed.
    pairs = shared.where(first == F.col("_key")).select("l_rep", "r_rep", F.size("both").alias("overlap"))
    return pairs, lm, rm


def expand_groups(pairs: DataFrame, lm: DataFrame, rm: DataFrame) -> DataFrame:
    """Representative pairs -> record pairs."""
    return expand_pairs(pairs.select(F.col("l_rep").alias("l_id"), F.col("r_rep").alias("r_id"), "overlap"), lm, rm)


#: Ids of a group that travel in one row.
_TOGETHER = 512


def equal_records(e: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records that agree in ``cols`` under their smallest id, and who they are: ``(id, cols)``, ``(rep, id)``.

    A collection in which an id comes twice stays as it is, each id a group of its own.
    """
    if e.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NOT NULL AND n > 1").limit(1).count():
        return e.select("id", *[f"`{c}`" for c in cols]), e.where(F.col("id").isNotNull()).select(F.col("id").alias("rep"), "id").distinct()
    named = e.where(F.col("id").isNotNull()).select("id", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(cols)])
    groups = cut_lineage(named.groupBy(*[f"_{i}" for i in range(len(cols))]).agg(F.min("id").alias("rep")), "groups")
    same = reduce(lambda a, b: a & b, [named[f"_{i}"].eqNullSafe(groups[f"_{i}"]) for i in range(len(cols))], F.lit(True))
    members = cut_lineage(named.join(groups, same).select("rep", "id"), "members")
    return groups.select(F.col("rep").alias("id"), *[F.col(f"_{i}").alias(c) for i, c in enumerate(cols)]), members


def group_sizes(pairs: DataFrame, lm: DataFrame, rm: DataFrame, name: str) -> DataFrame:
    """Adds how many record pairs each pair of groups stands for."""
    size = lambda m, c: m.groupBy(F.col("rep").alias(c)).agg(F.count(F.lit(1)).alias(f"_n_{c}"))
    both = pairs.join(size(lm, "l_id"), "l_id").join(size(rm, "r_id"), "r_id")
    return both.select(*[f"`{c}`" for c in pairs.columns], (F.col("_n_l_id") * F.col("_n_r_id")).alias(name))


def expand_pairs(pairs: DataFrame, lm: DataFrame, rm: DataFrame) -> DataFrame:
    """Pairs of groups ``(l_id, r_id, ...)`` -> record pairs with the same other columns.

    The ids of a group travel as arrays, so no expanded row is shuffled.  A
    table of few bytes is dealt out first, as its rows may stand for very many.
    """
    if estimated_bytes(pairs) <= 64 * 1024 * 1024:
        pairs = pairs.repartition(8 * pairs.sparkSession.sparkContext.defaultParallelism, "l_id", "r_id")
    def packed(m, c):
        parts = m.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / _TOGETHER).alias("_parts"))
        return (m.join(parts, "rep").groupBy("rep", F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part"))
                .agg(F.collect_list(F.struct("id")).alias(f"_{c}")).select(F.col("rep").alias(c), f"_{c}"))
    rest = [f"`{c}`" for c in pairs.columns if c not in ("l_id", "r_id")]
    met = pairs.join(packed(lm, "l_id"), "l_id").join(packed(rm, "r_id"), "r_id").select(F.explode("_l_id").alias("_l"), "_r_id", *rest)
    out = met.select(F.col("_l.id").alias("l_id"), F.explode("_r_id").alias("_r"), *rest).select("l_id", F.col("_r.id").alias("r_id"), *rest)
    return out.select(*[f"`{c}`" for c in pairs.columns])


def _is_missing(attr: str) -> Column:
    return F.col(attr).isNull() | (F.trim(attr) == "")


def overlap_block(l: DataFrame, r: DataFrame, attr: str, n: int, allow_missing: bool = False,
                  equal_on: list[str] | None = None, heavy: int | None = 500, r_attr: str | None = None, kept: bool = False) -> DataFrame:
    """Candidates ``(l_id, r_id, overlap)`` that share at least n words of ``attr``.

    ``kept`` writes the pairs of equal token sets once, for callers that go
    through the candidates several times.

    ``allow_missing`` also pairs a record without a value with every record of
    the other side (overlap 0), as the semantics of that flag demand.
    """
    pairs, lm, rm = overlap_groups(l, r, attr, n, equal_on, heavy, r_attr)
    out = expand_groups(cut_lineage(pairs, "group_pairs") if kept else pairs, lm, rm)
    if allow_missing:
        r_attr = r_attr or attr
        lost_l, lost_r = l.where(_is_missing(attr)), r.where(_is_missing(r_attr))
        have_l = l.where(~_is_missing(attr))
        extra = cross_block(lost_l.select("id"), r.select("id")).unionByName(
            cross_block(have_l.select("id"), lost_r.select("id")))
        out = out.unionByName(extra.select(F.col("l_id"), F.col("r_id"), F.lit(0).alias("overlap")))
    return out




def cross_block(l: DataFrame, r: DataFrame, block_rows: int = 10_000) -> DataFrame:
    """All pairs, columns prefixed ``l_`` / ``r_``, ``_id`` derived from both ids.

    The product is laid out as a grid of (left block, right block) cells joined
    on the cell, so work and output spread evenly and nothing is broadcast.
    """
    n_l = max(1, math.ceil(l.count() / block_rows))
    n_r = max(1, math.ceil(r.count() / block_rows))
    lc = l.select(*[F.col(c).alias(f"l_{c}") for c in l.columns],
                  F.pmod(F.xxhash64("id"), F.lit(n_l)).cast("int").alias("_lb"),
                  F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("_rb"))
    rc = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns],
                  F.pmod(F.xxhash64("id"), F.lit(n_r)).cast("int").alias("_rb"),
                  F.explode(F.sequence(F.lit(0), F.lit(n_l - 1))).alias("_lb"))
    out = lc.join(rc, ["_lb", "_rb"]).drop("_lb", "_rb")
    return out.select(F.xxhash64("l_id", "r_id").alias("_id"), *out.columns)


def equal_groups(l: DataFrame, r: DataFrame, attr: str) -> DataFrame:
    """Equality blocks in compact form: one row per key with both sizes and the pair count."""
    a = l.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("key")).agg(F.count(F.lit(1)).alias("n_left"))
    b = r.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("key")).agg(F.count(F.lit(1)).alias("n_right"))
    return a.join(b, "key").withColumn("pairs", F.col("n_left") * F.col("n_right"))


def equal_block(l: DataFrame, r: DataFrame, attr: str) -> DataFrame:
    """Record pairs with the same non-missing value.

    Each key's right side is split over salts so that a frequent value is
    produced by many tasks.
    """
    size = equal_groups(l, r, attr).select("key", F.least(F.lit(512), F.ceil(F.col("pairs") / 1_000_000)).cast("int")
                                          .alias("salts"))
    a = l.select(F.col("id").alias("l_id"), F.col(attr).alias("key")).join(size, "key")
    b = r.select(F.col("id").alias("r_id"), F.col(attr).alias("key")).join(size, "key")
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    b = b.withColumn("salt", F.pmod(F.xxhash64("r_id"), F.col("salts")).cast("int")).drop("salts")
    return a.join(b, ["key", "salt"]).select("l_id", "r_id")


def overlap_filter(cand: DataFrame, l: DataFrame, r: DataFrame, attr: str, n: int) -> DataFrame:
    """Candidates that also share at least n words of ``attr``."""
    a = l.select(F.col("id").alias("l_id"), blocking_words(F.col(attr)).alias("_lt"))
    b = r.select(F.col("id").alias("r_id"), blocking_words(F.col(attr)).alias("_rt"))
    both = cand.join(a, "l_id").join(b, "r_id").withColumn("overlap", F.size(F.array_intersect("_lt", "_rt")))
    return both.where(F.col("overlap") >= n).drop("_lt", "_rt").select("l_id", "r_id", "overlap")


def drop_self(cand: DataFrame, unordered: bool = False) -> DataFrame:
    """Remove self matches; ``unordered`` keeps each pair once."""
    return cand.where(F.col("l_id") < F.col("r_id")) if unordered else cand.where(F.col("l_id") != F.col("r_id"))


def block_quality(cand: DataFrame, l: DataFrame, r: DataFrame, gt: DataFrame) -> DataFrame:
    """One row: candidates, reduction ratio, known matches, missed ones, recall."""
    c = cand.select("l_id", "r_id", F.lit(1).alias("c"), F.lit(0).alias("g"))
    g = gt.select("l_id", "r_id", F.lit(0).alias("c"), F.lit(1).alias("g"))
    per_pair = c.unionByName(g).groupBy("l_id", "r_id").agg(F.sum("c").alias("c"), F.max("g").alias("g"))
    counts = per_pair.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("g"), F.lit(0)).cast("long").alias("known"),
        F.coalesce(F.sum(F.when((F.col("g") == 1) & (F.col("c") == 0), 1).otherwise(0)), F.lit(0)).alias("missed"))
    counts = with_totals(counts, l.agg(F.count(F.lit(1)).alias("n_left")))
    counts = with_totals(counts, r.agg(F.count(F.lit(1)).alias("n_right")))
    return counts.select(
        "candidates", "known", "missed",
        (1 - F.try_divide(F.col("candidates").cast("double"), F.col("n_left") * F.col("n_right"))).alias("reduction_ratio"),
        F.try_divide((F.col("known") - F.col("missed")).cast("double"), F.col("known")).alias("recall"))
