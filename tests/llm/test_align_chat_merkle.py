"""Alignment, chat formatting and the Merkle manifest against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import align, chat, merkle, vocab
from kindred.runtime import cut_lineage

PIECES = ["a", "b", "the ", " ", "\n", "\t", ".", ",", "'s", "日本", "é", "ﬁ", "🙂", "<|endoftext|>", "</s>", "12", "  ", "\r\n", "\xa0", "don't ",
          "\x00", "#*", "µ", "[INST]", "[\\/INST]", "<\\\\/s>", "unusual "]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(PIECES, rng.integers(0, 40))) for _ in range(n)]


# alignment

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(vocab.path(vocab.MODEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocab.path(align.PIECES))


def ends_of(ids, size):
    return np.cumsum([size(i) for i in ids]).tolist()


def brute_alignment(rows, libraries):
    a, b = libraries
    made = []
    for d, text in rows:
        x, y = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        bytes_a = [bytes(vocab.byte_characters()[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            made.append((d, [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        made.append((d, x, y, groups))
    held = Counter(pair for *_, groups in made for pair in {(p, q) for g, h in groups for p in g for q in h})
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for d, x, y, groups in made:
        links = [(p, q) for g, h in groups for p in g for q in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((d, len(x), len(y), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links),
                    sha(text) if groups else ""))
    return Counter(out)


COLUMNS = ["doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [0, 40, align.FREQUENT])
def test_alignment_equals_brute_force(spark, libraries, most):
    rows = [(1, None), (2, ""), (3, " "), (4, "▁"), (5, "a▁b c"), (6, "the cat sat"), (6, "the cat sat"), (None, "the cat"), (7, "a" * 3000),
            (8, "日本語" * 400), (9, "\n \n"), (10, "x " * 2000 + "end"), *((100 + i, t) for i, t in enumerate(random_texts(150, 4)))]
    df = spark.createDataFrame([(*r, 1, "r", 2) for r in rows], "doc_id bigint, text string, row int, pair string, n int").repartition(3)
    got = Counter(tuple(r) for r in align.count_links(align.align(df), most=most).select(*COLUMNS).collect())
    assert got == brute_alignment(rows, libraries)


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.count_links(align.align(df)).count() == 0


def test_alignment_gives_groups(spark):
    df = spark.createDataFrame([(1, "the cat's unusualness"), (2, None)], "doc_id bigint, text string")
    got = {r.doc.doc_id: r for r in align.align(df, with_groups=True).collect()}
    assert sha(got[1].groups) == got[1].groups_sha256 and got[1].groups.count(";") + 1 == got[1].n_groups
    assert got[2].groups == got[2].groups_sha256 == "" and got[2].pairs == []


def test_groups_of_random_ends():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        a, b, cuts_a, cuts_b, at, want = [], [], [0], [0], 0, []
        for _ in range(rng.integers(0, 4)):
            end, (p, q) = at + int(rng.integers(1, 60)), rng.random(2)
            own = [[x for x in range(at + 1, end) if rng.random() < z] + [end] for z in (p, q)]
            common = set(own[0]) & set(own[1]) - {end}
            starts = [[len(c)] + [len(c) + k + 1 for k, x in enumerate(o) if x in common] for c, o in zip((a, b), own, strict=True)]
            want += zip(*starts, strict=True)
            a, b, at = a + own[0], b + own[1], end
            cuts_a.append(len(a))
            cuts_b.append(len(b))
        got = align.groups(*(np.array(x, dtype=np.int64) for x in (a, b, cuts_a, cuts_b)))
        assert list(zip(*(g.tolist() for g in got), strict=True)) == want


def test_long_text_without_shared_cuts():
    a, b = np.arange(2, 200_000, 2), np.arange(1, 200_000, 2)
    a[-1] = b[-1] = 300_000
    got = align.groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert [g.tolist() for g in got] == [[0], [0]]


def test_encoders_equal_their_libraries(libraries):
    a, b = libraries
    texts = [t for t in random_texts(2000, 7) if t]
    ids_a, ids_b = align.tokenizers(vocab.path(vocab.MODEL), vocab.path(align.PIECES)).encode(texts)
    for t, x, y in zip(texts, ids_a, ids_b, strict=True):
        assert x.tolist() == a.encode(" " + t, add_special_tokens=False).ids and y.tolist() == b.encode(t)


def test_packer_equals_the_library_of_the_file():
    from tokenizers import Tokenizer
    for special in (False, True):
        model = Tokenizer.from_file(vocab.path(vocab.MODEL))
        model.encode_special_tokens = not special
        chunks = vocab.Chunks(vocab.json_packer(vocab.path(vocab.MODEL), special), 1000)
        texts = random_texts(1500, 9)
        for t, ids in zip(texts, chunks.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids
    every = [model.decode([i]) for i in range(50257)]
    every = [t for t in every if "�" not in t]
    for t, ids in zip(every, vocab.json_packer(vocab.path(vocab.MODEL), True)(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


# chat

def test_escapes_go_back():
    t = chat.DEFAULT
    for text in [*random_texts(2000, 3), "[[INST]", "<<\\/s>>", "[ROLE][/ROLE]", "[\\\\SYS]"]:
        escaped = t.escape(text)
        assert t.unescape(escaped) == text and not any(s in escaped for s in t.strings)


CHAT = "conv_id bigint, turn bigint, role string, text string, part int, whole string, ids int"


def conversations():
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, None), (2, 1, "assistant", ""), (3, None, "tool[/ROLE]", "x"),
            (3, 2, "assistant", "é🙂"), (3, 2, "assistant", "é🙂"), (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (4, 5, "user", "a" * 30000),
            (4, 6, "assistant", "[\\INST] " * 3000)]
    rng = np.random.default_rng(1)
    texts = random_texts(900, 5)
    rows += [(7, i, str(rng.choice(["user", "assistant", "system"])), t) for i, t in enumerate(texts)]  # a hot conversation
    rows += [(50 + i // 3, i % 3, ["system", "user", "assistant"][i % 3], t) for i, t in enumerate(texts[:300])]
    return rows


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    marks = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        esc = chat.DEFAULT.escape
        text = "".join((marks[r] if r in marks else f"[ROLE]{esc(r)}[/ROLE]") + esc(x) + "</s>" for _, r, x in turns)
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), len(text))
    return out


@pytest.mark.parametrize("most", [50, chat.PART])
def test_chat_reads_back(spark, most):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], CHAT).repartition(5)
    parts = cut_lineage(chat.format_turns(df, most=most))
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(parts).collect()}
    assert got == brute_chat(rows)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_written_form_gives_the_ids_again(spark):
    t, own = chat.DEFAULT, chat.Reader(chat.DEFAULT, vocab.path(vocab.RANKS))
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in conversations()], CHAT)
    import re
    cut = re.compile("(" + "|".join(map(re.escape, t.strings)) + ")")
    for r in chat.read_back(chat.format_turns(df)).join(chat.format_turns(df).select("conv_id", "part", "ids"), ["conv_id", "part"]).collect():
        ids = []
        for piece in cut.split(r.formatted):
            ids += [t.id(piece)] if piece in t.strings else own.model.encode([piece])[0].tolist()
        assert ids == list(r.ids)


# Merkle

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append([nodes[i:i + 16] for i in range(0, len(nodes), 16)])
        nodes = [sha("".join(r)) for r in levels[-1]]
    return nodes[0], levels


def proof_of(levels, i):
    out = []
    for runs in levels:
        out.append((i % 16, [x for j, x in enumerate(runs[i // 16]) if j != i % 16]))
        i //= 16
    return out


def brute_merkle(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r) for r in by[k]), key=lambda x: x[:3])
        trees[k] = leaves, *tree_of([x[2] for x in leaves])
    if not names:
        return Counter()
    root, upper = tree_of([trees[k][1] for k in names])
    out = []
    for at, k in enumerate(names):
        leaves, subroot, levels = trees[k]
        for i, (_, _, digest, r) in enumerate(leaves):
            proof, node = proof_of(levels, i) + proof_of(upper, at), digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = sha("".join(map(field, (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))))
            for place, others in proof:
                node = sha("".join([*others[:place], node, *others[place:]]))
            out.append((r[0], digest, subroot, root, sha("".join(x for _, s in proof for x in s)), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("case", ["empty", "one", "nulls", "many sources", "hot source", "large ids"])
def test_merkle_equals_brute_force(spark, case):
    rng = np.random.default_rng(2)
    rows = {
        "empty": [], "one": [(1, None, None, None, None)],
        "nulls": [(i, "a", None, i, f"Text {i} É") for i in range(16)] + [(None, None, "x", None, "")] * 2 + [(5, "", "y", 1, "A"), (5, "", "y", 1, None)],
        "many sources": [(i, [None, "", "b", "é", "z"][rng.integers(0, 5)] if i % 2 else f"s{i}", "en", 3, f"ABC{i % 7}") for i in range(150)],
        "hot source": [(i, "hot" if i % 6 else f"s{i % 9}", "en", 3, f"ABC{i % 7}") for i in range(5200)],
        "large ids": [((1 << 62) + i, "a", "en", 3, "X") for i in range(40)] + [(None, "a", "en", 3, "X")],
    }[case]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, at int, tree string")
    tampered = F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 5 == 0
    assert Counter(tuple(r) for r in merkle.documents(df.repartition(3), tampered).collect()) == brute_merkle(rows)


def test_merkle_without_tampering_verifies(spark):
    df = spark.createDataFrame([(i, "a", "en", 3, f"T{i}") for i in range(50)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert all(r.verified for r in merkle.documents(df).collect())
