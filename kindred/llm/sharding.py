"""Shards of near equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a 63-bit key: the CRC-32 of the text, so that equal texts
stand together, then 31 bits of a hash of ``doc_id``, so that a large group of
equal texts can be cut.  Each round counts exactly the bytes and rows below
many candidate boundaries; intervals that a wanted boundary falls into are
refined until they are small enough.  Then every row goes to its range in one
exchange and gets its place by sorting there.  Large inputs cut each shard into
more ranges, so a task never sorts a whole shard.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import whole_rows
from kindred.runtime import cut_lineage

#: Candidate boundaries in an interval per round, rows of one sorting task.
PROBES, RANGE_ROWS = 64, 1_000_000
TOP = 1 << 63


def sort_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The key of a row (0 up to 2**63 - 1) and the CRC-32 of its text (null: empty)."""
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return F.shiftleft(crc, 31).bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), 33)), crc


def _below(key: Column, edges: list[int]) -> Column:
    """How many of the ascending ``edges`` are at most ``key``: a binary search over a literal array."""
    n = len(edges)
    if not n:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    table = F.lit(edges).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))


def splitters(keyed: DataFrame, parts: int, tolerance: float = 0.0005) -> tuple[list[int], list[int], int]:
    """Boundaries that cut the bytes of ``keyed`` (``k``, ``size``) into ``parts`` near equal ranges.

    Returns the ``parts - 1`` boundaries, the exact rows below each, and all
    rows.  A boundary is final if the interval it lies in holds at most
    ``tolerance`` of a part's bytes, one row or one key.  Driver and plan hold
    at most ``parts * PROBES`` numbers.
    """
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    want = [total * j / parts for j in range(1, parts)]
    state = {j: (0, TOP) for j in range(len(want))}  # wanted boundary: the interval it lies in
    final: dict[int, tuple[int, int]] = {}
    while state and rows:
        edges = sorted({lo + (hi - lo) * i // PROBES for lo, hi in set(state.values()) for i in range(PROBES + 1)} - {TOP})
        found = {r["i"]: (r["b"], r["n"]) for r in keyed.groupBy(_below(F.col("k"), edges).alias("i")).agg(
            F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}  # one row an interval at most
        bytes_below, rows_below = [0], [0]
        for i in range(len(edges) + 1):
            b, n = found.get(i, (0, 0))
            bytes_below.append(bytes_below[-1] + b)
            rows_below.append(rows_below[-1] + n)
        # bytes_below[i + 1] are the bytes of keys below edges[i]
        marks = bytes_below[1:len(edges) + 1]
        for j in list(state):
            at = max(bisect.bisect_right(marks, want[j]) - 1, 0)
            lo, hi = edges[at], edges[at + 1] if at + 1 < len(edges) else TOP
            inside, n = bytes_below[at + 2] - bytes_below[at + 1], rows_below[at + 2] - rows_below[at + 1]
            if hi - lo <= 1 or n <= 1 or inside <= tolerance * total / parts:
                upper = bytes_below[at + 2] - want[j] < want[j] - bytes_below[at + 1]
                final[j] = (hi, rows_below[at + 2]) if upper else (lo, rows_below[at + 1])
                del state[j]
            else:
                state[j] = (lo, hi)
    return [final[j][0] if j in final else 0 for j in range(len(want))], [final[j][1] if j in final else 0 for j in range(len(want))], rows


def shard(docs: DataFrame, shards: int = 16, keep: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Places every row: ``doc`` (the columns ``keep``, null: all), ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``.

    The law is ``bytes``: shards have near equal sums of ``size`` (UTF-8 bytes
    of the text plus 1; null text has none).  ``slot`` is gapless from 0 in the
    order of the key.  Rows that agree in ``doc_id`` and text have one key and
    stay in one shard.  Fewer rows than shards leave shards empty; an empty
    table gives no rows.
    """
    rows = whole_rows(docs)
    text = F.col("doc.text")
    k, crc = sort_key(F.col("doc.doc_id"), text)
    held = F.col("doc") if keep is None else F.struct(*[F.col(f"doc.`{c}`") for c in keep])
    keyed = cut_lineage(rows.select(
        held.alias("doc"), F.col("doc.doc_id").alias("_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"), k.alias("k")), "keyed")
    each = max(1, -(-keyed.count() // (shards * range_rows)))
    edges, rows_below, n = splitters(keyed.select("k", "size"), shards * each)
    starts = [0, *rows_below]
    offset = [starts[i] - starts[i - i % each] for i in range(shards * each)]
    placed = keyed.withColumn("_range", _below(F.col("k"), edges))
    inside = Window.partitionBy("_range").orderBy("k", "_id")
    return placed.select(
        "doc", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("_range") / each).cast("int").alias("shard"),
        (F.row_number().over(inside) - 1 + F.get(F.lit(offset).cast("array<bigint>"), F.col("_range"))).cast("long").alias("slot"))
