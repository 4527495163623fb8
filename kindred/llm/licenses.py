"""License texts in documents, found by MinHash bands over text windows, with DataFrame functions only.

Texts are word sequences (lower case, letters and digits); a shingle is five
words.  Windows are four shingles long.  Those of a document begin at every
second shingle, those of a template at every one, so a copy of a template of
five shingles or more fills a document window that equals one of its own, and
one of four shares three of five shingles with some.  Each band is one minimum
of a window's hashes: equal windows meet in every band, windows of similarity
0.6 in one of six bands with probability 0.996.  A longer template has many
windows, so it is met even where words were changed.  Templates of less than
four shingles are looked up by single shingles.  What meets is verified: the
share of the template's shingles that the document has must reach ``share``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import whole_rows

WORDS, BANDS, SHARE = 5, 6, 0.8
#: Shingles of a window, and from one window of a document to the next.
WINDOW, STEP = 4, 2
#: A library with more window keys is refused: keys are literals of the plan.
MOST_KEYS = 200_000

#: Short notices and opening paragraphs of common licenses.
NOTICES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
           "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
           "persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                  "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
               "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
               "later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def templates(spark: SparkSession) -> DataFrame:
    """``license, text`` of the built-in notices."""
    return spark.createDataFrame(list(NOTICES.items()), "license string, text string")


def _with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``s``: hashes of the shingles in order.  Each step is a projection of its own, so nothing is evaluated twice."""
    df = df.withColumn("_w", F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    df = df.withColumn("_1", F.transform("_w", lambda x: F.xxhash64(x)))

    def joined(a: str, b: str, step: int) -> Column:
        n = F.greatest(F.size(b) - step, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, F.least(F.size(b), F.lit(step)) + 1, n), lambda x, y: F.xxhash64(x, y))
    for out, a, b, step in (("_2", "_1", "_1", 1), ("_4", "_2", "_2", 2), ("s", "_4", "_1", 4)):
        df = df.withColumn(out, joined(a, b, step))
    return df.drop("_w", "_1", "_2", "_4")


def _constant(band: int) -> Column:
    """Another order of the hashes for each band: their order after flipping the bits of a constant."""
    return F.lit((0x9E3779B97F4A7C15 * (band + 1) * (2 * band + 3)) % (1 << 64) - (1 << 63)).cast("long")


def _band_keys(window: Column) -> Column:
    """One key a band: the least hash of a window in the order of the band."""
    return F.array(*[F.xxhash64(F.lit(band), F.array_min(F.transform(window, _flip(band)))) for band in range(BANDS)])


def _flip(band: int):
    return lambda x: x.bitwiseXOR(_constant(band))


def _single_keys(shingles: Column) -> Column:
    return F.transform(shingles, lambda x: F.xxhash64(F.lit(-1), x))


def _window_keys(step: int) -> Column:
    """Keys of all windows of ``s`` that begin at every ``step``-th place; the last may be shorter."""
    n = F.size("s")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda at: _band_keys(F.slice("s", at, F.lit(WINDOW)))))


def _template_keys(library: DataFrame) -> DataFrame:
    """``license, key`` of every full window of every template, at all places; of each shingle if it has no full window."""
    n = F.size("s")
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    full = F.flatten(F.transform(starts, lambda at: _band_keys(F.slice("s", at, F.lit(WINDOW)))))
    keys = F.when(n >= WINDOW, full).otherwise(_single_keys(F.col("s")))
    return library.where(n > 0).select("license", F.explode(keys).alias("key")).distinct()


def scan(docs: DataFrame, library: DataFrame | None = None, share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """Matches: ``doc`` (the columns ``keep``, null: all), ``license``, ``containment``; one row a document row and license.

    ``library`` is ``license, text`` (null: the built-in notices).  Templates
    of less than five words, null or empty ones, and texts of less than five
    words, match nothing.  Repeated document rows match each; repeated
    templates of one name count once.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    library = library if library is not None else templates(spark)
    known = _with_shingles(library.where(F.col("license").isNotNull()).groupBy("license").agg(F.min("text").alias("text")), F.col("text"))
    names: dict[int, list[str]] = {}
    for name, key in _template_keys(known.select("license", "s")).limit(MOST_KEYS + 1).collect():
        names.setdefault(key, []).append(name)
    if sum(map(len, names.values())) > MOST_KEYS:
        raise ValueError(f"the library has more than {MOST_KEYS} window keys")
    rows = whole_rows(docs)
    text = F.col("doc.text")
    df = _with_shingles(rows, text).select(
        (F.col("doc") if keep is None else F.struct(*[F.col(f"doc.`{c}`") for c in keep])).alias("doc"), "s")
    if not names:
        return df.select("doc", F.lit("").alias("license"), F.lit(0.0).alias("containment")).where(F.lit(False))
    hits = F.array_distinct(F.filter(F.concat(_window_keys(STEP), _single_keys(F.col("s"))), lambda k: k.isin(list(names))))
    # no filter on the hits and an outer explode: a condition on them would be pushed down and computed again
    met = df.select("doc", "s", hits.alias("_hits"))
    table = F.broadcast(spark.createDataFrame([(k, n) for k, v in names.items() for n in v], "key bigint, license string")
                        .groupBy("key").agg(F.collect_set("license").alias("licenses")).agg(
                            F.map_from_entries(F.collect_list(F.struct("key", "licenses"))).alias("table")))  # one row, at most MOST_KEYS keys
    found = met.join(table, F.lit(True)).select("doc", "s", F.explode_outer(F.array_distinct(F.flatten(
        F.transform("_hits", lambda k: F.element_at("table", k))))).alias("license"))
    wanted = known.select("license", F.array_distinct("s").alias("t"))
    both = found.join(F.broadcast(wanted), "license").withColumn(
        "containment", F.size(F.array_intersect("t", "s")) / F.size("t"))
    return both.where(F.col("containment") >= share).select("doc", "license", F.round("containment", 6).alias("containment"))
