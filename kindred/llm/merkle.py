"""Merkle manifest of a corpus: one tree a source, a tree of their roots, a proof for every row.

Nodes of a tree are numbered in order; every ``FAN`` neighbours make a node of
the next level until one is left.  A superblock is ``FAN ** DEEP`` neighbours:
so many levels are reduced inside one group, and only the superblocks' tops go
up.  On the way back each superblock is cogrouped with the outer nodes that its
rows need, which finishes the reduction inside, joins the proofs and folds them
in one place.  Digests move, texts do not; no group grows with a source.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import whole_rows
from kindred.runtime import cut_lineage, release

#: Children of a node, fields of a leaf in order.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are reduced inside one superblock: 4096 rows.
DEEP = 3
HEX = 64


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc: str = "doc", fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """Digest of a row: each field as ``-`` (null) or its UTF-8 byte count, a colon and the value; ``instead`` replaces fields."""
    values = [instead.get(c, F.col(f"{doc}.`{c}`")).cast("string") for c in fields]
    shown = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*shown).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def in_order(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of a row in its ``tree`` from 0, and ``n``, the rows of the tree; the result rests on a written table.

    Rows are dealt out by ranges of (tree, order), so a large tree is spread
    over many tasks; equal rows may be cut too.  Rows number themselves inside
    their range, and each range starts where the ranges of the tree before it end.
    """
    keys = [tree, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut_lineage(dealt.withColumn("_row", F.monotonically_increasing_id()).drop("_tie"), "in_order")
    part = F.shiftright("_row", 33)
    sizes = held.groupBy(F.col(tree), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(tree, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                          F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    return (held.withColumn("_part", part).join(starts, [tree, "_part"])
            .withColumn("at", F.col("_start") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_start"))


def _reduced(digests: list[str], n: int) -> list[list[str]]:
    """Levels of one superblock of a tree of ``n`` nodes, its own nodes first: each as the joined digests of its runs."""
    levels = []
    for _ in range(min(DEEP, height(n))):
        runs = ["".join(digests[i:i + FAN]) for i in range(0, len(digests), FAN)]
        levels.append(runs)
        digests = [sha(r) for r in runs]
    return levels


def _top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests, n = rows.sort_values("at")["digest"].tolist(), int(rows["n"].iloc[0])
    levels = _reduced(digests, n)
    top = sha(levels[-1][0]) if levels else digests[0]
    for _ in levels:
        n = -(-n // FAN)
    return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "n": [n], "digest": [top]})


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {FAN ** DEEP}"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``tree, at, n, digest`` from ``nodes`` up to one row a tree; each is written to the shared folder.

    A table is 4096 times smaller than the one below it, so a round more is
    needed only for 4096 times the rows.
    """
    tables = [nodes.select("tree", "at", "n", "digest")]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tables.append(cut_lineage(_blocks(tables[-1]).groupBy("tree", "block").applyInPandas(
            _top, "tree string, at bigint, n bigint, digest string"), "superblocks"))
    return tables


def _own_proof(levels: list[list[str]], i: int) -> tuple[list[int], list[str]]:
    """Places and joined siblings of the ``i``-th node of a superblock, level by level."""
    places, siblings = [], []
    for runs in levels:
        run, place = runs[i // FAN], i % FAN
        places.append(place)
        siblings.append(run[:HEX * place] + run[HEX * (place + 1):])
        i //= FAN
    return places, siblings


def _opened(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the nodes of a superblock: their own siblings, then those of the superblock."""
    nodes, above = nodes.sort_values("at"), outer.iloc[0]
    levels = _reduced(nodes["digest"].tolist(), int(nodes["n"].iloc[0]))
    own = [_own_proof(levels, i) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "at": nodes["at"], "digest": nodes["digest"],
                         "places": [[*p, *above["places"]] for p, _ in own], "siblings": [[*s, *above["siblings"]] for _, s in own],
                         "subroot": above["subroot"], "root": above["root"]})


PROOF = "places array<int>, siblings array<string>, subroot string, root string"


def descend(tables: list[DataFrame], outer: DataFrame) -> DataFrame:
    """``tree, at`` and the proof (``PROOF``) of every superblock over the lowest of ``tables``, from that of each tree's root.

    ``outer`` holds ``tree`` and the proof columns.  Rows: one for 4096 nodes.
    """
    proofs = outer.withColumn("at", F.lit(0).cast("bigint"))
    for nodes in reversed(tables[1:]):
        proofs = cut_lineage(_blocks(nodes).groupBy("tree", "block").cogroup(proofs.groupBy("tree", "at")).applyInPandas(
            _opened, f"tree string, at bigint, digest string, {PROOF}"), "outer_nodes").drop("digest")
    return proofs


def _finished(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Finishes a superblock: reduction inside, proofs, and what each presented leaf folds to."""
    leaves, above = leaves.sort_values("at"), outer.iloc[0]
    levels = _reduced(leaves["digest"].tolist(), int(leaves["n"].iloc[0]))
    outside = list(zip(above["places"], above["siblings"], strict=True))
    joined = "".join(above["siblings"])
    proofs, folded = [], []
    for i, node in enumerate(leaves["presented"]):
        places, siblings = _own_proof(levels, i)
        proofs.append(sha("".join(siblings) + joined))
        for place, others in [*zip(places, siblings, strict=True), *outside]:
            node = sha(others[:HEX * place] + node + others[HEX * place:])
        folded.append(node)
    return pd.DataFrame({"doc": leaves["doc"], "leaf": leaves["digest"], "subroot": above["subroot"], "root": above["root"],
                         "proof_sha256": proofs, "folded_root": folded, "verified": [f == above["root"] for f in folded]})


def manifest(rows: DataFrame) -> DataFrame:
    """Proof of every row of ``doc, tree, digest, presented`` and the columns of ``order``, a struct.

    ``tree`` is a string that is never null; trees are ordered by its UTF-8
    bytes, leaves of a tree by ``order``.  ``digest`` is the leaf,
    ``presented`` the leaf to be verified.  Returns ``doc, leaf, subroot, root,
    proof_sha256, folded_root, verified``.  ``doc`` has a type that strings can
    be cast back to; it travels as a string, so that nulls and large numbers stay exact.
    """
    kind = rows.schema["doc"].dataType
    leaves = in_order(rows.withColumn("doc", F.col("doc").cast("string")), "tree", ["order"])
    tables = climb(leaves)
    subroots = tables[-1].select("tree", F.col("digest"))
    sources = in_order(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", ["name"])
    named = cut_lineage(sources.withColumnRenamed("all", "tree"), "sources")
    upper = climb(named)
    root = upper[-1].select("tree", F.col("digest").alias("root"), F.lit("").alias("subroot"),
                            F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings"))
    opened = cut_lineage(_blocks(named).groupBy("tree", "block").cogroup(descend(upper, root).groupBy("tree", "at")).applyInPandas(
        _opened, f"tree string, at bigint, digest string, {PROOF}"), "source_proofs")
    outer = named.select("at", "name").join(opened, "at").select(
        F.col("name").alias("tree"), "places", "siblings", F.col("digest").alias("subroot"), "root")
    out = _blocks(leaves.drop("order")).groupBy("tree", "block").cogroup(descend(tables, outer).groupBy("tree", "at")).applyInPandas(
        _finished, "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    for t in [*tables[1:], *upper[1:]]:  # what is below them has been written
        release(t)
    return out.withColumn("doc", F.col("doc").cast(kind))


def documents(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Manifest of documents: one tree a ``source`` (null first), leaves by ``doc_id`` (null first), equal ids by digest.

    Where ``tampered`` (a condition on the struct ``doc``) holds, the leaf that
    is verified has its text's A-Z lower-cased.  Every null field is ``-``,
    null and empty text are told apart, and repeated rows are leaves each.  An
    empty table gives no rows.  Other columns take no part.  Returns ``doc_id``
    and the columns of ``manifest``.
    """
    own = leaf()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    presented = own if tampered is None else F.when(tampered, leaf(text=F.translate("doc.text", upper, lower))).otherwise(own)
    source = F.col("doc.source").cast("string")
    rows = whole_rows(docs).select(
        F.col("doc.doc_id").alias("doc"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("tree"),
        F.struct(F.col("doc.doc_id").alias("id"), own.alias("digest")).alias("order"), own.alias("digest"), presented.alias("presented"))
    return manifest(rows).withColumnRenamed("doc", "doc_id")
