r"""Chat formatting at the level of tokens.

Every segment is encoded by itself and reserved ids, which no text can give,
are put between the segments; lengths of segments give their places by prefix
sums, and so does the loss mask, from +1 at the start of each learned segment
and -1 behind it.  In the written form reserved ids are control strings.  A
control string inside a text gets a backslash behind its first character, one
more if it has some already, so that reading back takes exactly one away.

The template: ``[SYS]``, ``[INST]`` or ``[/INST]`` opens a turn of the system,
the user or the assistant, ``[ROLE]name[/ROLE]`` one of any other role, and
``</s>`` ends each.  Learned are the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe, vocab

#: Most tokens of a part before it is closed, characters that are encoded at a time inside a task.
PART, CHARS = 8192, 1 << 20


@dataclass(frozen=True)
class Template:
    """Control strings; their reserved ids follow the vocabulary's from ``first``, in this order."""

    first: int = 50257
    roles: tuple[tuple[str, str], ...] = (("system", "[SYS]"), ("user", "[INST]"), ("assistant", "[/INST]"))
    name: str = "[ROLE]"
    text: str = "[/ROLE]"
    end: str = "</s>"
    learned: tuple[str, ...] = ("assistant",)
    strings: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "strings", (*(s for _, s in self.roles), self.name, self.text, self.end))

    def id(self, string: str) -> int:
        return self.first + self.strings.index(string)

    def escape(self, text: str) -> str:
        return _escapes(self).sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return _escapes(self).sub(lambda m: m[0].replace("\\", "", 1), text)


@cache
def _escapes(t: Template) -> re.Pattern:
    return re.compile("|".join(re.escape(s[0]) + r"\\*" + re.escape(s[1:]) for s in t.strings))


DEFAULT = Template()


class Writer:
    """Turns to ids and masks."""

    def __init__(self, template: Template, file: str):
        self.t, self.model = template, bpe.merges(file)
        if template.first < len(self.model.tokens):
            raise ValueError("reserved ids must follow the vocabulary")
        self.opens = {role: template.id(s) for role, s in template.roles}

    def write(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and loss mask of all turns one after the other, and the borders of the turns."""
        t, known = self.t, np.array([r in self.opens for r, _ in turns], dtype=bool)
        texts = self.model.encode([t.escape(x) for _, x in turns])
        names = self.model.encode(["" if k else t.escape(r) for k, (r, _) in zip(known, turns, strict=True)])
        n_text, n_name = (np.array(list(map(len, x)), dtype=np.int64) for x in (texts, names))
        ends = np.cumsum(1 + n_name + ~known + n_text + 1)
        start = ends - 1 - n_text  # of the text; its end is the place of the closing id
        first = np.concatenate(([0], ends[:-1])).astype(np.int64)[:len(turns)]
        size = int(ends[-1]) if len(ends) else 0
        ids, step = np.empty(size, dtype=np.int32), np.zeros(size + 1, dtype=np.int64)
        ids[first] = [self.opens.get(r, t.id(t.name)) for r, _ in turns]
        ids[start[~known] - 1] = t.id(t.text)
        ids[ends - 1] = t.id(t.end)
        for where, n, segments in ((start, n_text, texts), (first + 1, n_name, names)):
            place = np.arange(n.sum()) + np.repeat(where - (np.cumsum(n) - n), n)
            ids[place] = np.concatenate([*segments, np.empty(0, np.int32)])
        learned = np.array([r in t.learned for r, _ in turns], dtype=bool)
        np.add.at(step, start[learned], 1)
        np.add.at(step, ends[learned] - 1, -1)
        return ids, np.cumsum(step)[:-1].astype(bool), np.concatenate(([0], ends))


class Reader:
    """Ids and masks to turns; nothing but the ids and the template is used."""

    def __init__(self, template: Template, file: str):
        self.t, self.model = template, bpe.merges(file)
        self.roles = {template.id(s): role for role, s in template.roles}
        self.strings = {template.id(s): s for s in template.strings}

    def written(self, ids: np.ndarray) -> str:
        """The written form, with control strings."""
        marks = np.flatnonzero(ids >= self.t.first)
        out, at = [], 0
        for m in marks.tolist():
            out += [self.model.decode(ids[at:m]).decode(), self.strings[int(ids[m])]]
            at = m + 1
        return "".join([*out, self.model.decode(ids[at:]).decode()])

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """Role and text of each turn, unescaped."""
        t, out, role, at = self.t, [], "", 0
        for m in np.flatnonzero(ids >= t.first).tolist():
            mark = int(ids[m])
            if mark in self.roles:
                role = self.roles[mark]
            elif mark == t.id(t.text):
                role = t.unescape(self.model.decode(ids[at:m]).decode())
            elif mark == t.id(t.end):
                out.append((role, t.unescape(self.model.decode(ids[at:m]).decode())))
            at = m + 1
        return out

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """Texts under the mask, unescaped, one a run of learned tokens."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        return [self.t.unescape(self.model.decode(ids[a:b]).decode()) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _file(file: str | None) -> str:
    return file or vocab.path(vocab.RANKS)


def format_turns(turns: DataFrame, template: Template = DEFAULT, file: str | None = None, most: int = PART) -> DataFrame:
    """Token ids of conversations: ``conv_id, part, whole, ids, loss``; ``loss`` marks the learned tokens.

    Input: ``conv_id, turn, role, text``; other columns take no part.  Turns
    are ordered by ``turn`` (null first), equal ones by role and a hash of the
    text.  A null role or text counts as empty, a null ``conv_id`` is a
    conversation of its own.  Turns are dealt out by ranges of (conversation,
    turn), so one of any length is spread over tasks and parts: its parts
    ascend by ``part``, hold whole turns, and are closed at ``most`` tokens.
    ``whole`` is true where one row is surely all of its conversation.
    Repeated rows are turns each; an empty table gives no rows.
    """
    file = _file(file)
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    keys = ["conv_id", "turn", "role", "_hash", "_tie"]
    dealt = (rows.withColumn("_hash", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
             .repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text"))
    id_type = turns.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, whole boolean, ids array<int>, loss array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Writer(template, file)
        kind = None

        def made(held: list[tuple[object, list[tuple[str, str]]]]) -> pa.RecordBatch:
            ids, loss, borders = own.write([t for _, part in held for t in part])
            cuts, owner, at = [0], [], 0
            for conv, part in held:
                for k in range(len(part)):
                    if k and borders[at + k + 1] - cuts[-1] > most:
                        cuts.append(int(borders[at + k]))
                        owner.append(conv)
                at += len(part)
                cuts.append(int(borders[at]))
                owner.append(conv)
            whole = [owner[i] != owner[i - 1] and owner[i] != owner[i + 1] if 0 < i < len(owner) - 1 else False for i in range(len(owner))]
            offsets = pa.array(np.array(cuts, dtype=np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array(owner, kind), pa.array(whole), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                 pa.ListArray.from_arrays(offsets, pa.array(loss))], names=["conv_id", "whole", "ids", "loss"])
        held: list[tuple[object, list[tuple[str, str]]]] = []
        chars = 0
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chars > CHARS:
                    yield made(held)
                    held, chars = [], 0
                if not held or held[-1][0] != conv:
                    held.append((conv, []))
                held[-1][1].append((role, text))
                chars += len(text)
        if held:
            yield made(held)
    return dealt.mapInArrow(run, schema).withColumn("part", F.monotonically_increasing_id()).select("conv_id", "part", "whole", "ids", "loss")


def read_back(parts: DataFrame, template: Template = DEFAULT, file: str | None = None) -> DataFrame:
    """What the ids and masks of ``format_turns`` say: ``conv_id, part, whole, turns, learned, formatted``.

    ``turns`` are structs of role and text, ``learned`` the texts under the
    mask in order, ``formatted`` the written form with control strings.
    """
    file = _file(file)
    id_type = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(template, file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [(x.flatten().to_numpy(zero_copy_only=False), np.asarray(x.offsets) - np.asarray(x.offsets)[0])
                         for x in (part.column("ids"), part.column("loss"))]
                rows = [[x[o[i]:o[i + 1]] for x, o in lists] for i in range(part.num_rows)]
                turns = [[{"role": r, "text": t} for r, t in own.turns(ids)] for ids, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("conv_id", "part", "whole")),
                     pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                     pa.array([own.learned(ids, loss) for ids, loss in rows], pa.list_(pa.string())),
                     pa.array([own.written(ids) for ids, _ in rows], pa.string())],
                    names=["conv_id", "part", "whole", "turns", "learned", "formatted"])
    return parts.mapInArrow(run, f"conv_id {id_type}, part bigint, whole boolean, turns array<struct<role:string,text:string>>, "
                                 "learned array<string>, formatted string")


def digests(parts: DataFrame, template: Template = DEFAULT, file: str | None = None) -> DataFrame:
    """One row a conversation, read back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A digest needs its conversation's bytes in order.  Conversations that are
    one part are digested where they are; only the others are brought together,
    part after part, and run through the digest without being held.  ``parts``
    is read twice, so it should be a written table.
    """
    read = read_back(parts, template, file)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    found = read.select("conv_id", "part", "whole", F.size("turns").cast("long").alias("n_turns"), turns.alias("turns"),
                        F.array_join("learned", "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    alone = found.where("whole").select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
    names, schema = alone.columns, alone.schema
    many = found.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state = None, None

        def made(state: list) -> pa.RecordBatch:
            conv, n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (conv, kind), (n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()),
                (formatted, pa.int64()))], names=names)
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, n, turns, learned, formatted in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "n_turns", "turns", "learned", "formatted_chars")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield made(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(turns.encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += formatted
        if state is not None:
            yield made(state)
    return alone.unionByName(many.mapInArrow(run, schema))
