"""Clustering of the similarity graph.

Order is total everywhere.  Matchings take the higher similarity first, then
the smaller tie key (``tie_key``), then left and right id: among equal weights
the tie key mixes the edges, so rounds of mutually best edges end after about
log n of them, where an order by ids would go along a chain of copies edge by
edge.  Forests take the higher similarity, left id, right id.  ``by`` columns
name independent graphs that are clustered side by side in the same jobs
(configurations of a search).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.runtime import cut_lineage, release


def prune(ed: DataFrame, t) -> DataFrame:
    """Edges with similarity at least ``t`` (a number or a column)."""
    return ed.where(F.col("sim") >= t)


def tie_key(l_id: Column, r_id: Column) -> Column:
    """Order among edges of equal weight: the first 60 bits of the MD5 of both ids with a colon between."""
    digest = F.md5(F.concat_ws(":", l_id.cast("string"), r_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _edges(ed: DataFrame, by: list[str]) -> DataFrame:
    return ed.select(*by, "l_id", "r_id", F.col("sim").cast("double").alias("sim"))


def _keyed(ed: DataFrame, by: list[str]) -> DataFrame:
    return _edges(ed, by).withColumn("mix", tie_key(F.col("l_id"), F.col("r_id")))


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _dominant(edges: DataFrame, by: list[str]) -> DataFrame | None:
    """Locally dominant matching ``(by, l_id, r_id, sim, mix)``: rounds of edges that are best for both of their records."""
    rest = edges
    accepted = []
    while True:
        best_l = (rest.groupBy(*by, "l_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "mix", "r_id")).alias("b"))
                  .select(*by, "l_id", F.col("b.r_id").alias("r_id"), (-F.col("b.s")).alias("sim"), F.col("b.mix").alias("mix")))
        best_r = (rest.groupBy(*by, "r_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "mix", "l_id")).alias("b"))
                  .select(*by, "r_id", F.col("b.l_id").alias("l_id")))
        mutual = cut_lineage(best_l.join(best_r, [*by, "l_id", "r_id"]).select(*by, "l_id", "r_id", "sim", "mix"), "mutual")
        if not _any(mutual):
            break
        accepted.append(mutual)
        used, rest = rest, cut_lineage(rest.join(mutual.select(*by, "l_id"), [*by, "l_id"], "left_anti")
                                       .join(mutual.select(*by, "r_id"), [*by, "r_id"], "left_anti")
                                       .select(*by, "l_id", "r_id", "sim", "mix"), "edges")
        if used is not edges:
            release(used)
    return reduce(DataFrame.unionByName, accepted) if accepted else None


def unique_mapping(ed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Greedy one-to-one matching, best edge first.

    Each round accepts all edges that are best for both of their records, then
    removes those records.  Under a total edge order this gives the same
    matching as scanning the edges one by one.  Rounds go on until no edge is
    left.  The per-record best edge is a combining aggregate, so a record with
    very many edges does not meet in one task.
    """
    by = by or []
    edges = cut_lineage(_keyed(ed, by), "edges")
    found = _dominant(edges, by)
    return (edges if found is None else found).select(*by, "l_id", "r_id", "sim")


def kiraly(ed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Approximate maximum stable matching: deferred acceptance with one promotion.

    The locally dominant matching is what proposals down every left record's
    list end in.  A left record that is left over, now or after it has been
    displaced, is promoted once: a right record prefers higher similarity, then
    a promoted proposer, then the smaller tie key.  Offers that a right record
    refuses now it refuses for ever, so each round a free record goes straight
    to the first one that takes it.  Without equal weights nobody does, and the
    promotion is one look.
    """
    by = by or []
    edges = cut_lineage(_keyed(ed, by), "edges")
    found = _dominant(edges, by)
    if found is None:
        return edges.select(*by, "l_id", "r_id", "sim")
    state = [*by, "l_id", "r_id", "sim", "mix", "promoted"]
    held = cut_lineage(found.withColumn("promoted", F.lit(0)), "held")
    free = cut_lineage(edges.select(*by, "l_id").distinct().join(held.select(*by, "l_id"), [*by, "l_id"], "left_anti")
                       .withColumn("promoted", F.lit(1)), "free")
    while _any(free):
        now = held.select(*by, "r_id", F.col("l_id").alias("_l"), F.struct("sim", "promoted", (-F.col("mix")).alias("m")).alias("_worth"))

        def taken(promoted: Column) -> Column:
            return F.col("_worth").isNull() | (F.struct("sim", promoted.alias("promoted"), (-F.col("mix")).alias("m")) > F.col("_worth"))
        seen = edges.join(free, [*by, "l_id"]).join(now, [*by, "r_id"], "left")
        step = F.when(taken(F.col("promoted")), F.col("promoted")).when(taken(F.lit(1)), 1)
        offers = (seen.withColumn("_step", step).where(F.col("_step").isNotNull()).groupBy(*by, "l_id")
                  .agg(F.min(F.struct("_step", (-F.col("sim")).alias("s"), "mix", "r_id")).alias("o"))
                  .select(*by, "l_id", "o.r_id", (-F.col("o.s")).alias("sim"), "o.mix", F.col("o._step").alias("promoted")))
        offers = cut_lineage(offers, "offers")
        won = (offers.groupBy(*by, "r_id").agg(F.max(F.struct("sim", "promoted", (-F.col("mix")).alias("m"), "l_id")).alias("w"))
               .select(*by, F.col("w.l_id").alias("l_id"), "r_id", F.col("w.sim").alias("sim"), (-F.col("w.m")).alias("mix"),
                       F.col("w.promoted").alias("promoted")))
        won = cut_lineage(won, "won")
        refused = offers.join(won.select(*by, "l_id"), [*by, "l_id"], "left_anti").select(*by, "l_id", "promoted")
        displaced = held.join(won.select(*by, "r_id"), [*by, "r_id"], "left_semi").select(*by, "l_id", "promoted")
        kept = held.join(won.select(*by, "r_id"), [*by, "r_id"], "left_anti").select(*state)
        old_held, old_free = held, free
        free = cut_lineage(refused.unionByName(displaced), "free")
        held = cut_lineage(kept.unionByName(won.select(*state)), "held")
        for used in (old_held, old_free, offers, won):
            release(used)
    return held.select(*by, "l_id", "r_id", "sim")


def best_match(ed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each right record keeps its best edge; each left record keeps the best of those."""
    by = by or []
    e = _edges(ed, by)
    per_r = (e.groupBy(*by, "r_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "l_id")).alias("b"))
             .select(*by, "r_id", F.col("b.l_id").alias("l_id"), F.col("b.s").alias("s")))
    return (per_r.groupBy(*by, "l_id").agg(F.min(F.struct("s", "r_id")).alias("b"))
            .select(*by, "l_id", F.col("b.r_id").alias("r_id"), (-F.col("b.s")).alias("sim")))


def _jump(parent: DataFrame, by: list[str], times: int = 2) -> DataFrame:
    """Follow parent pointers: each step doubles the distance."""
    for _ in range(times):
        up = parent.select(*by, F.col("node").alias("root"), F.col("root").alias("_next"))
        parent = parent.join(up, [*by, "root"]).select(*by, "node", F.col("_next").alias("root"))
    return parent


def _compose(maps: list[DataFrame], by: list[str]) -> DataFrame:
    """First-level nodes to their final root through the maps of all rounds."""
    out = maps[-1]
    for m in reversed(maps[:-1]):
        nxt = out.select(*by, F.col("node").alias("root"), F.col("root").alias("_next"))
        out = m.join(nxt, [*by, "root"], "left").select(*by, "node", F.coalesce("_next", "root").alias("root"))
    return out


def _node_edges(ed: DataFrame, by: list[str]) -> DataFrame:
    return ed.select(*by, F.concat(F.lit("l"), F.col("l_id").cast("string")).alias("u"),
                     F.concat(F.lit("r"), F.col("r_id").cast("string")).alias("v"))


def components(ed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Connected components ``(by, side, id, cluster_id)`` of the records that have an edge.

    Rounds of contraction: every node points to the smallest of itself and its
    neighbours (a combining aggregate, so a hub never meets in one task),
    pointers are followed, and edges are rewritten to the nodes pointed at.
    The graph shrinks every round; the loop ends when no edge is left.
    ``cluster_id`` is the smallest node name, ``l``/``r`` followed by the id.
    """
    by = by or []
    rest = cut_lineage(_node_edges(ed, by).distinct(), "components")
    maps = []
    while True:
        both = rest.unionByName(rest.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(
            *by, F.col("u").alias("node"), F.least("u", "m").alias("root"))
        step = cut_lineage(_jump(low, by), "roots")
        maps.append(step)
        ru = step.select(*by, F.col("node").alias("u"), F.col("root").alias("ru"))
        rv = step.select(*by, F.col("node").alias("v"), F.col("root").alias("rv"))
        used, rest = rest, cut_lineage(
            rest.join(ru, [*by, "u"]).join(rv, [*by, "v"]).where(F.col("ru") != F.col("rv"))
            .select(*by, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "components")
        release(used)
        if not _any(rest):
            break
    final = _compose(maps, by)
    out = final.select(*by, F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 2)").alias("id"),
                       F.col("root").alias("cluster_id"))
    return cut_lineage(out, "clusters") if len(maps) > 1 else out


def spanning_forest(ed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maximum spanning forest: at every threshold it has the components of the full graph.

    Each round every component picks its best outgoing edge.  By the cut
    property all picks belong to the forest of the total edge order.  Picks are
    followed a few steps and the groups contract, whether or not all of a
    round's picks are merged already.
    """
    by = by or []
    keys = ["l_id", "r_id", "sim"]
    start = ed.select(*by, "l_id", "r_id", F.col("sim").cast("double").alias("sim"),
                      F.concat(F.lit("l"), F.col("l_id").cast("string")).alias("u"),
                      F.concat(F.lit("r"), F.col("r_id").cast("string")).alias("v"))
    rest = cut_lineage(start, "forest")
    picked = []
    while _any(rest):
        ends = rest.unionByName(rest.select(*by, *keys, F.col("v").alias("u"), F.col("u").alias("v")))
        best = ends.groupBy(*by, "u").agg(F.min(F.struct((-F.col("sim")).alias("s"), "l_id", "r_id", "v")).alias("b"))
        chosen = cut_lineage(best.select(*by, "u", F.col("b.v").alias("v"), F.col("b.l_id").alias("l_id"),
                                         F.col("b.r_id").alias("r_id"), (-F.col("b.s")).alias("sim")), "picked")
        picked.append(chosen.select(*by, *keys))
        back = chosen.select(*by, F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("mutual"))
        # two groups that picked each other: the smaller name is their root
        parent = chosen.select(*by, "u", "v").join(back, [*by, "u", "v"], "left").select(
            *by, F.col("u").alias("node"),
            F.when(F.col("mutual") & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root"))
        step = cut_lineage(_jump(parent, by, 3), "roots")
        ru = step.select(*by, F.col("node").alias("u"), F.col("root").alias("ru"))
        rv = step.select(*by, F.col("node").alias("v"), F.col("root").alias("rv"))
        used, rest = rest, cut_lineage(rest.join(ru, [*by, "u"]).join(rv, [*by, "v"]).where(F.col("ru") != F.col("rv"))
                                       .select(*by, *keys, F.col("ru").alias("u"), F.col("rv").alias("v")), "forest")
        release(used)
    if not picked:
        return rest.select(*by, *keys)
    return reduce(DataFrame.unionByName, picked).distinct()


def complete(clusters: DataFrame, e1: DataFrame, e2: DataFrame) -> DataFrame:
    """Add records without a cluster as clusters of one."""
    ids = e1.select(F.lit("l").alias("side"), F.col("id").cast("string").alias("id")).unionByName(
        e2.select(F.lit("r").alias("side"), F.col("id").cast("string").alias("id")))
    alone = ids.join(clusters.select("side", "id"), ["side", "id"], "left_anti")
    return clusters.select("side", "id", "cluster_id").unionByName(
        alone.withColumn("cluster_id", F.concat("side", "id")))


def as_partition(matches: DataFrame) -> DataFrame:
    """One-to-one matches as clusters ``(side, id, cluster_id)``; the left record names the cluster."""
    name = F.concat(F.lit("l"), F.col("l_id").cast("string"))
    return matches.select(F.inline(F.array(
        F.struct(F.lit("l").alias("side"), F.col("l_id").cast("string").alias("id"), name.alias("cluster_id")),
        F.struct(F.lit("r").alias("side"), F.col("r_id").cast("string").alias("id"), name.alias("cluster_id")))))


MATCHERS = {
    "UniqueMappingClustering": unique_mapping,
    "KiralyMSMApproximateClustering": kiraly,
    "BestMatchClustering": best_match,
}
