"""Main text of web pages by line-block distribution.

Markup is stripped first: every block element gives a line, and what stands in
scripts, forms, menus, notices and the like gives an empty line, since it holds
no text of the page.  Then text lengths are summed over windows of lines that
follow each other.  Text begins where the sums surge from zero and ends where
they dive to zero.  If that happens more than once, stretches of one article
element or one container (or of containers side by side, if most of their text
is no link) are one text, since what stands between them is hidden; the one with
the most text is the article.  Lines between surge and dive are kept, however
short.  An element that says it is the article decides, unless a container
outside of it holds more text.  Marks hide by whole names of class, id and role;
an element with most of the page's text, or around ``main``, is not hidden.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 256
#: Lines of a window.
WINDOW = 5
#: Elements whose content is no text, that are no text of the article, that begin a block, without an end tag.
RAW = frozenset("script style noscript template textarea title svg math iframe object select xmp".split())
ASIDE = frozenset("nav header footer aside form button menu dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
                  "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that mark advertising, and what readers wrote.
ADS = frozenset("ad ads adv advert advertisement advertising adsbygoogle promo promoted promotion sponsor sponsored".split())
REPLIES = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that belong to the article if they stand inside one.
OWN = frozenset("header masthead notice notices".split())
#: All words that mark what is not the article.
MARKS = ADS | REPLIES | OWN | frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies footer gdpr menu nav navbar navigation newsletter pager pagination popup "
    "related share sharing sidebar social subscribe subscription toolbar topbar widget widgets modal overlay complementary "
    "contentinfo search".split())
#: Words that say nothing beside a mark ("share-buttons"); beside a header or footer only the first ones.
PLACE = frozenset("site global top main bottom".split())
PLAIN = PLACE | frozenset("left right primary secondary list area box bar container wrapper wrap block inner outer holder panel button "
                          "buttons link links item items posts articles stories unit slot zone".split())
#: Elements of running text; of the marks only advertising hides them.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
#: Blocks that are no container: their lines belong to the block around them.
PARTS = TEXT | frozenset("ul ol li dl dt dd dir menu hr figure figcaption caption table tbody thead tfoot tr td th address center legend "
                         "details summary option".split())
#: Elements that say they hold the article; headers inside one belong to it.
ARTICLE = frozenset(("article", "main"))
#: Characters of a paragraph; a container with less outside of all article elements is no article.
PARAGRAPH = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]{2,}")
_SPACE = re.compile(r"\s+")


def _marks(token: str, article: bool) -> frozenset[str]:
    """The marks of one name of a class, id or role; none if it has words that are no marks ("has-sidebar", "related-work")."""
    words = frozenset(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
    marks = words & MARKS
    place = PLACE if not marks.isdisjoint(("header", "masthead", "footer", "banner")) else PLAIN
    return frozenset() if not words - marks <= place or article and marks <= OWN else marks


def _marked(name: str, attributes: str, article: bool) -> tuple[bool, frozenset[str]]:
    """Do the attributes hide the element from readers; the marks that say that it is not the article."""
    marks: frozenset[str] = frozenset()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, marks
        if key in ("class", "id", "role") and name not in ARTICLE and not (key == "id" and name[0] == "h" and name[1:].isdigit()):
            for token in value.split():
                marks |= _marks(token, article)
    return False, marks & ADS if name in TEXT else marks


class _Away:
    """An element that is not of the article, inside another one; ``fixed``: whatever it holds."""

    __slots__ = ("around", "fixed", "replies", "size", "hides")

    def __init__(self, around: _Away | None, fixed: bool, replies: bool):
        self.around, self.fixed, self.replies, self.size, self.hides = around, fixed, replies, 0, True


class Line(NamedTuple):
    """A block with text: "" if it is not of the article."""

    text: str
    prose: int      # characters outside of links
    article: int    # number of its article element (0: none)
    container: int  # number of the block that holds its paragraph (0: the page)
    parent: int     # number of the block around that (0: the page, or not to be asked)


class _Open:
    """The open elements; finds the last of a name without a walk."""

    def __init__(self):
        self.stack: list[tuple[str, _Away | None, int, int, int]] = []  # name, what hides it, numbers as in Line
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, away: _Away | None, article: int, container: int, parent: int) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, away, article, container, parent))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """An end tag closes the last element of its name; that of an inline element does not reach over a block."""
        if (where := self.at.get(name)) and (name in BLOCK or not self.blocks or self.blocks[-1] < where[-1]):
            self.cut(where[-1])

    def state(self) -> tuple[_Away | None, int, int, int]:
        return self.stack[-1][1:] if self.stack else (None, 0, 0, 0)


def _release(aways: list[_Away], total: int) -> None:
    """An element that holds most of the page's text is not hidden; what readers wrote is, unless it is all there is."""
    for a in reversed(aways):  # inner ones first
        if a.around:
            a.around.size += a.size
    for a in aways:
        most = a.size and (a.size == total if a.replies else 2 * a.size > total)
        a.hides = (a.hides and not most or a.fixed) or bool(a.around and a.around.hides)


def lines(page: str) -> list[Line]:
    """Blocks with text, in page order."""
    out: list[tuple[str, int, _Away | None, int, int, int]] = []
    text: list[str] = []
    aways: list[_Away] = []
    open_, articles, containers, at, linked = _Open(), 0, 0, 0, 0

    def end() -> None:
        nonlocal linked
        away, *place = open_.state()
        if words := _SPACE.sub(" ", entities.unescape("".join(text))).strip():
            out.append((words, max(len(words) - linked, 0), away, *place))
            if away:
                away.size += out[-1][1]
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if open_.at.get("a"):
            linked += len(piece)

    while m := _TOKEN.search(page, at):
        add(page[at:m.start()])
        at, name = m.end(), (m[1] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if page[m.start() + 1] == "/":
            away = open_.state()[0]
            if name in BLOCK:
                end()
            elif away and open_.stack[-1][0] == name:
                end()  # the end of a hidden inline element
            open_.close(name)
            continue
        if name in BLOCK:
            end()
        if name in RAW:
            close = _END[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            continue
        if name == "p":  # a paragraph ends where the next begins
            last = open_.blocks[-1] if open_.blocks else -1
            open_.cut(last if last >= 0 and open_.stack[last][0] == "p" else last + 1)
        away, article, container, parent = open_.state()
        gone, marks = _marked(name, m[2], bool(article)) if name not in ("body", "html") else (False, frozenset())
        if open_.at.get("pre"):
            marks = frozenset()  # colours of program text
        aside = name in ASIDE and not (name == "header" and article)
        fixed = gone or aside and name != "form"
        inner = away
        if (fixed or aside or marks) and not (away and away.fixed):
            inner = _Away(away, fixed, bool(marks) and marks <= REPLIES)
            aways.append(inner)
        if name == "main":  # what it stands in is not beside the article
            a = inner
            while a and not a.fixed and a.hides:
                a.hides, a = False, a.around
        if name in ARTICLE and not (article or inner and inner.fixed):
            articles += 1
            article = articles
        if inner is not away and not (away and away.hides) and name not in BLOCK:
            end()
        if name in BLOCK and name not in PARTS and name not in ("body", "html", "head"):
            containers += 1
            parent = 0 if name in ARTICLE else container
            container = containers
        open_.push(name, inner, article, container, parent)
    add(page[at:])
    end()
    _release(aways, sum(prose for _, prose, away, *_ in out if not (away and away.fixed)))
    return [Line("" if away and away.hides else words, prose, *place) for words, prose, away, *place in out]


def _decisive(found: list[Line]) -> bool:
    """Is the article an article element?  Not if some container outside of all of them holds more text, and a paragraph at least."""
    inside, outside = Counter(), Counter()
    for x in found:
        if x.text and x.article:
            inside[x.article] += x.prose
        elif x.text:
            for c in {x.container, x.parent or x.container}:
                outside[c] += x.prose
    most = max(outside.values(), default=0)
    return bool(inside) and (most < PARAGRAPH or most <= max(inside.values()))


def _places(found: list[Line], sizes: list[int]) -> set[tuple[str, int]]:
    """What makes a stretch one with another: an article element, a container, or the block around containers of prose."""
    seen = [x for x, n in zip(found, sizes, strict=True) if n]
    whole = 2 * sum(x.prose for x in seen) > sum(sizes)
    return ({("article", x.article) for x in seen if x.article} | {("block", x.container) for x in seen if whole or not x.container}
            | {("block", x.parent) for x in seen if whole and x.parent})


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, one line each; "" if there is none."""
    found = lines(page or "")
    if _decisive(found):
        found = [x if x.article else x._replace(text="") for x in found]  # the page says where its article is
    else:
        found = [x._replace(article=0) for x in found]
    sizes = [len(x.text) for x in found]
    sums = [sum(sizes[i:i + WINDOW]) for i in range(len(sizes))]  # of the window that begins here
    stretches: list[tuple[int, int]] = []
    at = 0
    while at < len(sums):
        if not sums[at]:
            at += 1
            continue
        dive = next((i for i in range(at, len(sums)) if not sums[i]), len(sums))
        stretches.append((at, dive))
        at = dive
    if not stretches:
        return ""
    places = [_places(found[a:b], sizes[a:b]) for a, b in stretches]
    at_place: dict[tuple[str, int], list[int]] = {}
    for i, known in enumerate(places):
        for p in known:
            at_place.setdefault(p, []).append(i)
    left = set(range(len(stretches)))
    best: list[int] = []
    while left:  # stretches of one place are one text
        group, more = [], [min(left)]
        left.discard(more[0])
        while more:
            group.append(i := more.pop())
            for p in places[i]:
                new = [j for j in at_place.pop(p, ()) if j in left]
                left.difference_update(new)
                more += new
        if sum(sum(sizes[slice(*stretches[i])]) for i in group) > sum(sum(sizes[slice(*stretches[i])]) for i in best):
            best = group
    return "\n".join(x.text for i in sorted(best) for x in found[slice(*stretches[i])] if x.text)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """Adds ``out``: the main text of ``html``; the columns ``keep`` (null: all) stay.

    Null or empty html, or a page without text of its own, gives "".  A column
    of the name ``out`` is replaced.  One row in, one row out, no shuffle.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c != out]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).alias("\x00html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = pa.array([main_text(x) for x in part.column(len(kept)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], texts], names=[*kept, out])
    return rows.mapInArrow(run, schema)
