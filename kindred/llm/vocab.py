"""Files of public tokenizers.  They are installed on every machine; their path is a parameter."""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Callable
from functools import cache

RANKS = "byte_bpe_50k.tiktoken"
MODEL = "byte_bpe_50k.json"


def path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@cache
def pattern() -> str:
    """The pattern that splits a text before the merges."""
    import public_tokenizers
    return public_tokenizers.PATTERN


@cache
def ranks(file: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a rank file."""
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def byte_level(file: str) -> tuple[dict[bytes, int], dict[str, int], bool]:
    """A byte-level JSON vocabulary: ids by token bytes, ids of special strings, and whether merges follow the ids."""
    with open(file, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
    of = byte_characters()
    ids = {bytes(of[c] for c in name): i for name, i in made["model"]["vocab"].items() if name not in special}
    joined = (m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in made["model"]["merges"])
    order = [made["model"]["vocab"][m] for m in joined]
    plain = not made.get("normalizer") and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not made["pre_tokenizer"].get("add_prefix_space")
    return ids, special, plain and order == sorted(order)


def json_packer(file: str, special: bool) -> Callable[[list[str]], list[bytes]]:
    """A function that gives the packed ids of strings as the library of the JSON file would, without added special tokens.

    ``special``: a special token's string inside a text stands for its id, else
    it is ordinary text.  Where merges follow the ids, as they do in byte-level
    files, ids are ranks and the faster library for ranks gives the same ids;
    other files and strings with special tokens go to the file's own library.
    """
    ids, names, ranked = byte_level(file)

    @cache
    def model():  # large, and rarely needed
        from tokenizers import Tokenizer
        made = Tokenizer.from_file(file)
        made.encode_special_tokens = not special
        return made

    def own(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in model().encode_batch(texts, add_special_tokens=False)]
    if not ranked:
        return own
    import tiktoken
    fast = tiktoken.Encoding(file, pat_str=pattern(), mergeable_ranks=ids, special_tokens={}).encode_ordinary

    def pack(texts: list[str]) -> list[bytes]:
        if special and names:
            return [own([t])[0] if any(s in t for s in names) else array("I", fast(t)).tobytes() for t in texts]
        return [array("I", fast(t)).tobytes() for t in texts]
    return pack


class Memo(dict):
    """Results of a function by key, forgotten all at once when more than ``most`` are held."""

    def __init__(self, fill, most: int):
        super().__init__()
        self._fill, self._most = fill, most

    def __missing__(self, key):
        if len(self) >= self._most:
            self.clear()
        value = self[key] = self._fill(key)
        return value


class Chunks:
    """Encodes texts by remembered chunks between single spaces and line ends.

    The pattern never lets a piece go on past the place before a single space,
    or before or after a single line end, that has other characters on both
    sides.  So texts can be cut there, and the chunks, unlike whole texts, come
    again and again.  A text with any other white space at such a place is
    encoded as a whole.  ``pack`` gives the packed ids of a list of strings.
    ``marks`` are characters that are pieces of their own after a letter.
    """

    def __init__(self, pack, most: int, marks: str = ".,"):
        self.pack, self.most = pack, most
        self.head: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.line_end, *tails = pack(["\n", *marks])
        self.tails = dict(zip(marks, tails, strict=True))

    def _learn(self, known: dict[str, bytes], chunks: list[str], lead: str) -> None:
        """Puts new chunks into ``known``; odd ones stay out."""
        new = []
        for c in chunks:
            if c and not (c[0].isspace() or c[-1].isspace()):
                if c[-1] in self.tails and c[-2:-1].isalpha() and (core := known.get(c[:-1])):
                    known[c] = core + self.tails[c[-1]]
                else:
                    new.append(c)
        known.update(zip(new, self.pack([lead + c for c in new]) if new else [], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; new chunks of all texts are learned at once."""
        if len(self.head) + len(self.inner) > self.most:
            self.head.clear()
            self.inner.clear()
        head, inner = self.head.get, self.inner.get
        made, gaps = [], []
        for i, text in enumerate(texts):
            lines = []
            for line in text.split("\n"):
                chunks = line.split(" ")
                found = list(map(inner, chunks))
                found[0] = head(chunks[0])
                if None in found:
                    gaps.append((i, found, chunks))
                lines.append(found)
            made.append(lines)
        self._learn(self.head, list(dict.fromkeys(c[0] for _, f, c in gaps if f[0] is None)), "")
        self._learn(self.inner, list(dict.fromkeys(c[k] for _, f, c in gaps for k in range(1, len(f)) if f[k] is None)), " ")
        odd = set()
        for i, found, chunks in gaps:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = ids = (inner if k else head)(chunks[k])
                    if ids is None:
                        odd.add(i)
        whole = dict(zip(sorted(odd), self.pack([texts[i] for i in sorted(odd)]) if odd else [], strict=True))
        return [whole[i] if i in whole else self.line_end.join([b"".join(x) for x in lines]) for i, lines in enumerate(made)]
