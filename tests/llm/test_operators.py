"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import bpe, html, jaccard, kdtree, langid, licenses, packing, quality, resample, sharding, vocab

SHINGLE_COUNTS = jaccard.shingle_counts
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, kept int, cid string, length int"
PROSE = "the cat and the dog of the house is in that garden with a tree for as long as it was there "


def table(spark, rows, schema=SCHEMA):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "s", "x", 1, "c", 3)[:8] for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(60)]
    near = words.copy()
    near[30] = "other"
    long_text = " ".join(f"q{i % 997} the" for i in range(20000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one two", "en"), (5, "ONE two", "xx"), (6, " ".join(words), "en"),
            (7, " ".join(near), "en"), (8, " ".join(words).upper(), "en"), (None, " ".join(words), "en"), (9, long_text, "de"),
            (10, "a b\nc d\n\nc d\nc d ", None), (10, "a b\nc d\n\nc d\nc d ", None), (11, (PROSE * 6)[:-1], "en"), (12, "日本語 🙂 émigré", "ja"),
            (13, "Released under the MIT License.", "en"), (14, PROSE + "Licensed under the Apache License, Version 2.0.", "en")]
    return table(spark, rows)


def pieces_of(text):
    return [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]


def test_quality_counts(docs):
    got = [(r.doc.doc_id, r.doc.text, r) for r in quality.judge(docs).collect()]
    assert len(got) == 16
    for _, text, r in got:
        w = pieces_of(text)
        seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if pieces_of(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    good = [(i, f"{PROSE}{'word' + str(i) + ' '}" * 1 + " ".join(f"{a}{i} the {a} of" for a in "abcdefghijklmnopqrstuvwxyz"), "en") for i in range(40)]
    bad = [(100, " ".join(f"W{i}!!%% |" for i in range(80)), "en")]
    kept = {r.doc.doc_id: r.kept for r in quality.judge(table(spark, good + bad)).collect()}
    assert all(kept[i] for i in range(40)) and not kept[100]
    assert quality.judge(table(spark, good[:1]).limit(0)).count() == 0


def test_quality_short_and_unlabelled(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    text = lambda n: " ".join(str(rng.choice(PROSE.split())) if rng.random() < 0.5 else word() for _ in range(n))
    junk = lambda n: " ".join(f"{w}{rng.choice(['%%%', '&&&', '***'])}" for w in text(n).split())
    good = [(i, text(150), "en") for i in range(40)]
    rows = [(100, junk(30), "en"), (101, junk(50), "en"), (102, junk(80), None), (103, junk(80), "xx"), (104, junk(40), None)]
    fine = [(200, text(25), "en"), (201, text(50), "en"), (202, text(80), None), (203, text(30), None),
            (204, " ".join("".join(rng.choice(list("оеаинтсрвлкмдпу"), rng.integers(2, 9))) for _ in range(80)) + ".", "ru")]
    got = {r.doc.doc_id: r for r in quality.judge(table(spark, good + rows + fine)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not [i for i, *_ in rows if got[i].kept] and not [i for i, *_ in good + fine if not got[i].kept]
    assert got[204].word_distance is None and got[204].char_distance is not None
    alone = quality.judge(table(spark, [(1, junk(80), None)])).first()
    assert alone.kept and alone.char_distance is None  # no reference at all


def test_js_distance(spark):
    p, q = [3, 0, 5], [1, 1, 2]
    got = spark.range(1).select(quality.js_distance(F.lit(p).cast("array<bigint>"), F.lit(q).cast("array<bigint>"))).first()[0]
    a, b = np.array(p) / 8, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(i * np.log2(i / j) for i, j in zip(x, m, strict=True) if i)
    assert got == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_kdtree_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5))
    rows = [(i, [float(x) for x in base[i % 40 if i % 3 else 0]]) for i in range(1500)]
    rows += [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 5), (5003, [float("inf")] * 5), (None, [1.0] * 5),
             (5004, [1.0, 2.0]), (5100, [2.0, 1.0]), (7, rows[7][1]), (5200, [])]
    v = kdtree.scaled(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    monkeypatch.setattr(kdtree, "LEAF", 16)
    got = defaultdict(list)
    for r in kdtree.top_k(v, v.where(F.col("vec_id") % 100 == 0), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: [int(np.floor(1024 * y)) for y in x] for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    for q in (i for i in ok if i % 100 == 0):
        all_ = sorted(((-sum(a * b for a, b in zip(ok[q], x, strict=True)), i) for i, x in ok.items() if i != q and len(x) == len(ok[q])))
        assert got[q] == [(i, -s) for s, i in all_[:10]]
    assert kdtree.top_k(v.limit(0), v.limit(0)).count() == 0


def components_of(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= 80 * len(sets[i] | sets[j]) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    low = {}
    for (d, _), p in zip(rows, part, strict=True):
        if d is not None:
            low[p] = min(low.get(p, d), d)
    return Counter((d, len(s), low.get(p)) for (d, _), s, p in zip(rows, sets, part, strict=True))


def test_jaccard_equals_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(70)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(150):  # families of edited texts, and texts that share a passage only
        base = [f"f{i % 12}x{j}" for j in range(80)] if i % 3 else passage + [f"u{i}x{j}" for j in range(30)]
        for _ in range(rng.integers(0, 3)):
            base[rng.integers(0, len(base))] = f"e{rng.integers(0, 9)}"
        rows.append((100 + i, " ".join(base)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, cid string")
    got = Counter(tuple(r) for r in jaccard.near_duplicates(df).collect())
    assert got == components_of(rows)


def test_word_hashes_tell_words_apart():
    import itertools
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abé", repeat=n)] + ["x" * n for n in range(1, 3000)]
    text = "\t ".join(words) + "\r\n"
    h = jaccard.word_hashes(text.encode())
    assert len(h) == len(words) == len(set(h.tolist()))
    assert (jaccard.word_hashes(text.upper().replace("É", "é").encode()) == h).all()
    shifted = jaccard.word_hashes(("\x0b zz " + text).encode())
    assert (shifted[1:] == h).all()
    assert len(jaccard.word_hashes(b"")) == len(jaccard.word_hashes(b" \n")) == 0
    assert len(jaccard.word_hashes("a\u00a0b".encode())) == 1


def test_word_hashes_tell_long_words_apart():
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))  # and its mirror: equal under any polynomial over 64-bit numbers
    other = morse.translate(str.maketrans("ab", "ba"))
    h = jaccard.word_hashes(f"{morse} {other} {morse.upper()}".encode())
    assert h[0] != h[1] and h[0] == h[2]


def test_any_counters_give_the_same_links(spark, docs, monkeypatch):
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join((passage if i % 2 else []) + [f"f{i // 4}x{j}" for j in range(60 + int(rng.integers(0, 6)))])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = components_of(rows)
    for counters in (1, 64, jaccard.COUNTERS):
        monkeypatch.setattr(jaccard, "shingle_counts", lambda d, w, n=counters: SHINGLE_COUNTS(d, w, n))
        assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == want


def test_jaccard_second_order(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i // 2}x{j}" for j in range(40)] + [f"only{i}"])) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == components_of(rows)


def near_copies_of_one(n, seed=4):
    """Texts around one passage, a third too far from it: pairs that share keys grow with the square of ``n``."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in range(150)], []
    for i in range(n):
        words = base.copy()
        for at in rng.integers(0, 140, int(rng.integers(1, 4))):
            words[at:at + int(rng.integers(1, 5))] = [f"x{i}y{at}"]
        out.append((i, " ".join(words)))
    return out


def test_jaccard_large_group_makes_few_pairs(spark, monkeypatch):
    rows, made, linked = near_copies_of_one(700), [], jaccard._linked

    def counted(pairs, *args):
        made.append(pairs.count())
        return linked(pairs, *args)
    monkeypatch.setattr(jaccard, "_linked", counted)
    got = Counter(tuple(r) for r in jaccard.near_duplicates(table(spark, [(*r, "en") for r in rows])).collect())
    assert got == components_of(rows)
    assert sum(made) <= 80 * len(rows)


def test_jaccard_outsiders_meet_few_members(spark):
    rows = spark.range(1100).select(F.lit(1).alias("key"), F.col("id").alias("cid"), F.lit(100).alias("n"), F.lit(0).alias("pos"))
    comp, made = spark.range(1000).select(F.col("id").alias("cid"), F.lit(0).cast("long").alias("comp")), []

    def linked(pairs):
        made.append(pairs.count())
        return pairs.where("a < 1000 and b >= 1000 and (a + b) % 10 = 0")
    assert jaccard._tiles(jaccard._with_groups(rows, comp), 80).count() == 104_950
    assert {r.comp for r in jaccard._joined(rows, comp, linked, 80).collect()} == {0} and sum(made) < 20_000


def test_jaccard_parts_make_every_pair_once(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(k), c, int(c % 7), 30 + c % 5, 0) for c in range(90) for k in rng.integers(0, 3, 2)],
                                 "key long, cid long, comp long, n long, pos long").distinct()
    pairs = lambda *part: [tuple(r) for r in jaccard._tiles(rows, 80, *part).collect()]
    parts = [pairs(16), pairs(4, 16), pairs(1, 4)]
    assert sorted(sum(parts, [])) == sorted(pairs()) and len(parts[0]) < len(parts[1]) < len(parts[2])


def test_jaccard_second_order_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i // 2}x{j}" for j in range(40)] + [f"only{i}"])) for i in range(24)]
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string")
    want = {r: 3 * c for r, c in components_of(rows).items()}
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == want


def test_one_of_each_keeps_rows(spark, docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 14]


def test_licenses(docs):
    got = {(r.doc.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == {(13, "mit-notice"), (14, "apache-2.0-notice")}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licenses_find_changed_templates(spark):
    words = licenses.NOTICES["mit"].split()
    words[20] = "thing"
    df = table(spark, [(1, f"{PROSE * 3} " + " ".join(words) + f" {PROSE * 3}", "en"), (2, PROSE * 5, "en")])
    assert [(r.doc.doc_id, r.license) for r in licenses.scan(df).collect()] == [(1, "mit")]


def test_resample(spark, docs):
    labels = spark.createDataFrame([(11, 1), (11, 0), (14, 1), (12, 0), (4, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    got = [(r.doc.doc_id, r.log_weight, r.score, r.selected) for r in resample.resample(docs, labels).collect()]
    assert len(got) == 16 and {d for d, w, _, _ in got if w is None} == {1, 2, 3}
    with_words = [g for g in got if g[1] is not None]
    k = round(0.5 * len(with_words))
    cut = sorted((g[2] for g in with_words if g[2] is not None), reverse=True)[k - 1]
    assert all(g[3] == (g[2] is not None and g[2] >= cut) for g in with_words)
    assert all(g[3] for g in ((r.doc.doc_id, r.log_weight, r.score, r.selected) for r in resample.resample(docs, labels.limit(0)).collect()) if g[2] is not None)


@pytest.mark.parametrize("effective", [None, 100.0])
def test_resample_weights_are_the_log_ratio_of_the_models(spark, docs, effective):
    labels = spark.createDataFrame([(11, 1), (14, 1), (14, 0), (12, 0), (10, 1), (99, 1)], "doc_id bigint, quality int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = np.zeros((2, resample.BUCKETS))
    for d, text in rows:
        for g in resample.grams(text or "").astype(int):
            counts[0, g] += 1
            counts[1, g] += d in (11, 14, 10)
    assert (resample.gram_counts(docs, labels.where("quality = 1").select("doc_id").distinct()) == counts).all()
    ratio = np.log((counts[1] + 1) / (counts[1] + 1).sum()) - np.log((counts[0] + 1) / (counts[0] + 1).sum())
    got = Counter((r.doc.doc_id, r.log_weight) for r in resample.resample(docs, labels, effective=effective).collect())
    want = Counter()
    for d, text in rows:
        r = ratio[resample.grams(text or "").astype(int)]
        want[d, None if not len(r) else float(r.sum() if effective is None else r.mean() * effective)] += 1
    near = lambda c: sorted((str(d), -1e9 if w is None else w) for d, w in c.elements())
    for (a, x), (b, y) in zip(near(got), near(want), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-4)


def test_resample_draws_in_proportion_to_the_weights(spark):
    n = 4000
    rows = spark.createDataFrame([(i, float(np.log(3.0)) if i % 2 else 0.0) for i in range(n)], "doc_id bigint, w double")
    scored = rows.withColumn("score", F.col("w") + resample.gumbel(3, F.col("doc_id")))
    share = resample.top(scored, "score", n // 20).where("selected").agg(F.avg((F.col("w") > 0).cast("int"))).first()[0]
    assert 0.68 < share < 0.82  # three to one


@pytest.fixture(scope="module")
def tiktoken_own():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=vocab.pattern(), mergeable_ranks=vocab.ranks(vocab.path(vocab.RANKS)), special_tokens={})


def test_bpe_equals_library(docs, tiktoken_own):
    out = bpe.decode(bpe.encode(docs)).collect()
    assert len(out) == 16
    for r in out:
        assert list(r.ids) == tiktoken_own.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()


def test_bpe_random_texts(tiktoken_own):
    rng = np.random.default_rng(1)
    parts = ["a", "ing", "tion", " ", " ", "  ", "\n", "'s", "1", "é", "日", "🙂", "---", "\x00", "\t", "\x1c", "\x85", "　", ",", "."]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)] + ["a" * 20000, " " * 20000, "=" * 9999]
    own = bpe.merges(vocab.path(vocab.RANKS))
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert list(ids) == tiktoken_own.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_packing(docs):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(vocab.path(vocab.MODEL))
    docs = docs.unionByName(table(docs.sparkSession, [(20, "to <|endoftext|> and<|endoftext|>.\n<|endoftext|>", "en")]))
    rows = packing.packed_documents(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*model.encode(r.text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows, 2048)
    assert packing.packed_documents(docs.limit(0)).count() == 0


def check_places(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packing_plan_is_tight():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.plan(counts)
    got = np.zeros(2049, dtype=np.int64)
    for t in plan:
        assert t.space(2048) >= 0
        for n, k in t.parts:
            got[n] += n and k * t.count
    assert (got == counts).all()
    assert sum(t.count for t in plan) <= 1.003 * -(-int(lengths.sum()) // 2048)


def test_nnls():
    rng = np.random.default_rng(0)
    cols = packing.patterns(12)
    h = rng.integers(0, 30, 13).astype(float)
    x = packing.nnls(cols, h)
    m = np.zeros((13, len(cols)))
    for i, c in enumerate(cols):
        for b in c[c > 0]:
            m[b, i] += 1
    m[0] = 0
    h[0] = 0
    gradient = m.T @ (h - m @ x)  # at the optimum no column can still gain
    assert (x >= 0).all() and gradient.max() < 1e-4 and np.abs(gradient[x > 1e-6]).max(initial=0) < 1e-4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="page"><div class="post-body"><h2>Title</h2><p>First <b>bold</b> &amp; <a href="x">link</a>
text.<p>Second<br>line</p><div class="advert">Buy now</div><p>Third</p><form>Name<button>Go</button></form><p>Fourth &eacute;</p></div></div>
<section id="comments"><p>A very long comment by a reader that goes on and on and on and on and on.</p></section><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text"), (5, "u", "<nav>a</nav>"), (5, "u", "<nav>a</nav>"),
            (6, "u", "<nav>x</nav><p>aside of it</p><article><h1>A</h1><p>b &lt c</p><footer>f</footer></article><p>rest of the page, long</p>"),
            (7, "u", "<p>" * 3000 + "deep"), (8, "u", "<div" * 3000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {1: "Title\nFirst bold & link text.\nSecond line\nThird\nFourth é", 2: "", 3: "", 4: "just text", 5: "",
                   6: "A\nb < c", 7: "deep", 8: ""}
    assert html.extract(df).count() == 9 and html.extract(df.limit(0)).count() == 0


PARAGRAPHS = [f"paragraph {i} " + "of the text " * 12 + "end" for i in range(5)]
MARKED = [('<main class="has-sidebar">%s</main>', ""), ('<article class="no-sidebar">%s</article>', ""), ('<div id="page" class="header-fixed">%s</div>', ""),
          ('<article><div class="article-header"><h1>A</h1></div><h2 id="related-work">B</h2><p class="notice">C</p><p class="ad">D</p>'
           '<section id="social-history">%s</section></article>', "A\nB\nC\n"),
          ('<div class="sidebar">%s</div><p>x</p>', None), ('<form><div>%s</div></form>', ""), ('<div class="sidebar"><main>%s</main></div>', "")]


@pytest.mark.parametrize("page, before", MARKED)
def test_html_marks_are_whole_names(page, before):
    text = "\n".join(PARAGRAPHS)
    got = html.main_text(page % "".join(f"<p>{x}" for x in PARAGRAPHS))
    assert got.startswith(text) if before is None else got == before + text


def test_html_readers_text_stays_away():
    long_comments = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    assert html.main_text(f"<div>A short body.</div><div id='comments'>{long_comments}</div><div class='share-buttons'>S</div>") == "A short body."


@pytest.mark.parametrize("page", ["<div>%s%s%s</div>", "<body>%s%s%s</body>", "<div><section>%s</section>%s<section>%s</section></div>",
                                  "<div><div>%s</div><div>%s</div><div>%s</div></div>"])
def test_html_hidden_list_splits_no_text(page):
    related = "<ul class='related'>" + "<li><a href='x'>link</a>" * 6 + "</ul>"
    parts = ["".join(f"<p>{x}</p>" for x in p) for p in (PARAGRAPHS[:3], PARAGRAPHS[3:])]
    assert html.main_text(page % (parts[0], related, parts[1])) == "\n".join(PARAGRAPHS)


def test_html_teaser_beside_body():
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    menu = "<nav>" + "<li>x" * 6 + "</nav>"
    assert html.main_text(f"<div><article><h3>Teaser</h3><p>more</p></article></div>{menu}<div id='body'>{body}</div>") == "\n".join(PARAGRAPHS)
    assert html.main_text(f"<article>{body}</article>{menu}<div>{PARAGRAPHS[0]}</div>") == "\n".join(PARAGRAPHS)


def check_shards(rows, texts, n):
    sizes = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(n))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc.doc_id, r.size, r.text_crc32) for r in rows) == want
    return sizes


@pytest.mark.parametrize("range_rows", [1_000_000, 7])
def test_sharding(spark, docs, range_rows):
    texts = [(i, "same text" if i % 3 else "x" * (i % 50)) for i in range(800)]
    rows = sharding.shard(spark.createDataFrame([(*t, 0) for t in texts], "doc_id bigint, text string, k int"), 16, range_rows=range_rows).collect()
    sizes = check_shards(rows, texts, 16)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 51
    check_shards(sharding.shard(docs, 4).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_language(spark):
    import os
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit("x"))
    rows = langid.predict(docs, langid.fit(langid.training_rows(docs))).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.doc.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.accepted for r in rows) >= 0.98 * len(rows)


def test_language_edges(spark, docs):
    model = langid.fit(langid.training_rows(docs))
    got = {r.doc.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3))
    assert set(r.lang_pred for r in got.values()) <= {"en", "de", "ja", "xx", "und"}
    none = langid.fit(langid.training_rows(docs.limit(0)))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_held_out(spark):
    got = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_digests(docs, tiktoken_own):
    ids = bpe.encode(docs, keep=["doc_id"])
    r = ids.where("doc_id = 4").select(F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("h")).first()
    assert r.h == hashlib.sha256(" ".join(map(str, tiktoken_own.encode_ordinary("one two"))).encode()).hexdigest()
