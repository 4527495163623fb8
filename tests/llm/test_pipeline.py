"""Every stage of the pipeline, and all of it, on a small corpus with nulls, repeats, copies and odd texts."""

import importlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import langid, quality, vocab

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = np.random.default_rng(11)
    letters = {"en": "etaoinshrdlu", "ru": "оеаинтсрвлкм"}
    common = {"en": "the of and to in is it that".split(), "ru": "и в не на что он как это".split()}

    def text(lang, n):
        make = lambda: "".join(rng.choice(list(letters[lang]), rng.integers(3, 9)))
        return " ".join(str(rng.choice(common[lang])) if rng.random() < 0.4 else make() for _ in range(n)) + "."
    rows = [(i, text(lang, 90), lang) for lang, base in (("en", 0), ("ru", 1000)) for i in range(base, base + 60)]
    first = rows[0][1].split()
    near = first.copy()
    near[50] = "changed"
    rows += [(2000, " ".join(near), "en"), (2001, rows[0][1], "en"), (2001, rows[0][1], "en"), (2002, rows[0][1].upper(), "en"),
             (None, rows[60][1], "ru"), (2003, None, "en"), (2004, "", None), (2005, "123 456 !!!", "en"), (2006, "short text here", "en"),
             (2007, "the cat sat " * 60, "en"), (2008, " ".join(f"W{i}!!%% |" for i in range(80)), "en"),
             (2009, " ".join(text("en", 60) for _ in range(40)), None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", 1) for r in corpus()], SCHEMA).repartition(3)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang) for r in df.collect())


def test_stages_are_those_of_the_task():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_what_has_a_learned_language(spark, docs):
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    all_rows, got = rows_of(docs), rows_of(kept)
    assert not got - all_rows
    gone = {r[0] for r in all_rows - got}
    assert {2003, 2004, 2005} <= gone and not gone & {*range(60), *range(1000, 1060), 2000, 2001, 2002, 2009}
    judged = langid.predict(docs, langid.fit(langid.training_rows(docs)))
    assert got == Counter((r.doc.doc_id, r.doc.text, r.doc.lang) for r in judged.where("accepted").collect())


def test_quality_stage_keeps_what_the_rules_keep(spark, docs):
    kept = corpus_pipeline.rules(spark, docs, "")
    assert kept.columns == docs.columns
    want = Counter()
    for r in quality.judge(docs).collect():
        words = (r.doc.text or "").split()
        seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        if r.kept:
            want[r.doc.doc_id, r.doc.text, r.doc.lang] += 1
    got = rows_of(kept)
    gone = {r[0] for r in rows_of(docs) - got}
    assert got == want and {2003, 2004, 2005, 2006, 2007, 2008} <= gone and not gone & {*range(60), *range(1000, 1060), 2009}


def groups_of(rows):
    sets = []
    for _, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= 80 * len(sets[i] | sets[j]) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    return part


def test_near_copies_stage_keeps_one_of_each_group(spark, docs):
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    by = defaultdict(list)
    for r, p in zip(rows, groups_of(rows), strict=True):
        by[p].append(r)
    lead = lambda rs: min(rs, key=lambda r: (r[0] is None, r[0] or 0))
    assert rows_of(kept) == Counter(lead(rs) for rs in by.values())


def check_packing(rows, packed):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(vocab.path(vocab.MODEL))
    want = Counter()
    for d, text, _ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_stage(spark, docs):
    check_packing([(r.doc_id, r.text, r.lang) for r in docs.collect()], corpus_pipeline.pack(spark, docs, "").collect())


def test_run_is_the_stages_one_after_the_other(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, str(tmp_path)).collect(), SCHEMA)
    kept = [(r.doc_id, r.text, r.lang) for r in left.collect()]
    assert {0, 1000} <= {r[0] for r in kept} and not {2000, 2001, 2002, 2007} & {r[0] for r in kept}
    check_packing(kept, corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_stages_of_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_the_entry_lists_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
