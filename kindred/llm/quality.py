"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of a document are compared with the reference of its language:
character classes and common function words.  A reference is the sum of the
histograms of all documents with that language label, so it covers the whole
corpus and takes one pass.  The distance is the Jensen-Shannon distance (base
2, from 0 to 1).  Short texts have noisy histograms, so the limits of texts of
few words are wider: by what sampling adds to a squared distance, which falls
with one over the length, counted in characters for the classes and in words for
the common words.  A text without a label is compared with the nearest of all
references.  A label without a reference names a language that is not known
here: only the shares of letters, digits, white space and signs are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import whole_rows, words
from kindred.runtime import cut_lineage

#: Frequent function words of English, German, French and Spanish.
COMMON = ("the of and to in is it that with for on as are was "
          "der die das und ist von mit den zu ein auf nicht "
          "le la les de des et un une est que qui dans pour "
          "el los las y en del se por con para no").split()
#: Names of the character classes, in the order of the histogram.
CLASSES = ("lower", "lower_other", "upper", "digit", "space", "line", "sentence", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; distances are compared after rounding to 4 digits."""

    least_words: int = 20            # base rule: fewer words fail
    most_repeated_pct: int = 30      # base rule: more words in repeated 8-word windows fail
    least_chars: int = 100           # the classes have no say below so many characters
    full_words: int = 60             # the limits are wider below so many words
    full_chars: int = 600            # and, for the classes, below so many characters
    char_noise: float = 25.0         # added to the squared limit: times 1 / characters - 1 / full_chars
    word_noise: float = 2.0          # added to the squared limit: times 1 / words - 1 / full_words
    char_distance: float = 0.20
    word_distance: float = 0.36
    least_reference_words: int = 1000  # a language with fewer words in all gives no reference


def _counts(common: Column) -> Column:
    """How often each common word occurs: one letter a word, then one replacement a letter."""
    letter = {w: chr(0x30 + i) for i, w in enumerate(COMMON)}
    table = F.create_map(*[F.lit(x) for pair in letter.items() for x in pair])
    text = F.array_join(F.transform(common, lambda x: F.element_at(table, x)), "")
    # a one-element array gives the joined text a name that is evaluated once
    return F.transform(F.array(text), lambda t: F.array(*[
        (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("long") for c in letter.values()]))[0]


def _split(docs: DataFrame) -> DataFrame:
    """Words, common words and the rests of the text after taking out runs of letters and white space."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return (whole_rows(docs)
            .withColumn("w", words(F.col("doc.text")))
            .withColumn("rest", F.regexp_replace(text, "[a-zß-ÿ]+", ""))
            .withColumn("common", F.filter("w", lambda x: x.isin(COMMON)))
            .withColumn("marks", F.regexp_replace("rest", r"[\x20\x09-\x0D]+", "")))


def _histograms(split: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols`` and the two histograms as arrays of longs."""
    text, rest, marks = F.coalesce(F.col("doc.text"), F.lit("")), F.col("rest"), F.col("marks")
    def count(pattern: str, of: Column = marks) -> Column:
        return F.length(of) - F.length(F.regexp_replace(of, pattern, ""))
    df = (split.withColumn("n_words", F.size("w").cast("long"))
          .withColumn("word_chars", (F.length(text) - F.length(rest) + F.length(marks)).cast("long"))
          .withColumn("n_symbols", count(r"[#*$%&|<>]+").cast("long"))
          .withColumn("_upper", count(r"[A-ZÀ-Þ]+"))
          .withColumn("_digit", count(r"[0-9]+"))
          .withColumn("_sentence", count(r"[.,;:!?'\"()\-]+"))
          .withColumn("_line", count(r"\n+", rest))
          .withColumn("_low", F.length(text) - F.length(rest))
          # each lower-case letter beyond ASCII takes one more byte than it has characters
          .withColumn("_far", (F.octet_length(text) - F.length(text)) - (F.octet_length(rest) - F.length(rest)))
          .withColumn("_hits", _counts(F.col("common"))))
    chars = [F.col("_low") - F.col("_far"), F.col("_far"), F.col("_upper"), F.col("_digit"),
             F.length(rest) - F.length(marks) - F.col("_line"), F.col("_line"), F.col("_sentence"), F.col("n_symbols"),
             F.length(marks) - F.col("_upper") - F.col("_digit") - F.col("_sentence") - F.col("n_symbols")]
    return (df.withColumn("chars", F.array(*[c.cast("long") for c in chars]))
            .withColumn("hits", F.concat("_hits", F.array(F.col("n_words") - F.size("common"))))
            .drop("_upper", "_digit", "_sentence", "_line", "_low", "_far", "_hits", "rest", "marks"))


def signals(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts and histograms of every document, in one pass: ``doc`` with the columns ``keep`` (null: all) beside them."""
    h = _repeats(_histograms(_split(docs)))
    lines = F.filter(F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    h = h.withColumn("_lines", lines)
    row = F.col("doc") if keep is None else F.struct(*[F.col(f"doc.`{c}`") for c in keep])
    return h.select(row.alias("doc"), F.col("doc.lang").alias("lang"), "n_words", "word_chars", "n_symbols",
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                    "n_repeat_words", "chars", "hits")


def language_references(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language label: summed histograms ``ref_chars`` and ``ref_hits`` of its documents.

    ``found`` comes from ``signals``.  Every document counts that looks like
    prose: enough words, at most one symbol for ten words, at least one word in
    ten a common one.
    """
    last = F.element_at("hits", -1)
    prose = found.where(F.col("lang").isNotNull() & (F.col("n_words") >= rules.least_words)
                        & (10 * F.col("n_symbols") <= F.col("n_words")) & (10 * (F.col("n_words") - last) >= F.col("n_words")))
    def total(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    return (prose.groupBy(F.col("lang").alias("ref_lang"))
            .agg(total("chars", len(CLASSES)).alias("ref_chars"), total("hits", len(COMMON) + 1).alias("ref_hits"),
                 F.sum("n_words").alias("_w"))
            .where(F.col("_w") >= rules.least_reference_words).drop("_w"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts with positive sums."""
    def share(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(total, F.size(a)).alias("t")),
                           lambda x: x["v"].cast("double") / x["t"])
    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _signs(chars: Column) -> Column:
    """The character classes with all letters in one, whatever their script."""
    letter = sum([chars[CLASSES.index(c)] for c in ("lower_other", "upper", "other")], chars[CLASSES.index("lower")])
    return F.array(letter, *[chars[CLASSES.index(c)] for c in ("digit", "space", "line", "sentence", "symbol")])


def _far(ref: Column, foreign: Column) -> Column:
    """Distances ``c`` and ``w`` of both histograms from a reference, rounded, after what they are ordered by."""
    c = F.round(js_distance(F.col("_chars"), F.when(foreign, _signs(ref["ref_chars"])).otherwise(ref["ref_chars"])), 4)
    w = F.round(js_distance(F.col("hits"), ref["ref_hits"]), 4)
    # a one-element array gives both distances a name that is evaluated once
    return F.transform(F.array(F.struct(c.alias("c"), w.alias("w"))), lambda d: F.struct(
        F.when(foreign, d["c"]).otherwise(d["c"] + d["w"]).alias("by"), d["c"].alias("c"), d["w"].alias("w")))[0]


def _limit(limit: float, noise: float, n: Column, full: int, short: Column) -> Column:
    """The limit of a distance, wider for a text of few words with less than ``full`` characters or words."""
    more = noise * (1 / F.greatest(n, F.lit(1)) - 1 / full)
    return F.when(short & (n < full), F.sqrt(F.lit(limit * limit) + more)).otherwise(F.lit(limit))


def _repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in 8-word windows that occur twice or more.

    Windows are compared by 64-bit hashes made by doubling: two words, four
    words, eight words.  Only documents with an equal pair of windows sort
    their windows to find the places.
    """
    def pairs(a: str, step: int) -> Column:
        n = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(a, F.least(F.size(a), F.lit(step)) + 1, n), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("_1", F.transform("w", lambda x: F.xxhash64(x)))
    for a, b, step in (("_1", "_2", 1), ("_2", "_4", 2), ("_4", "_8", 4)):
        df = df.withColumn(b, pairs(a, step))
    df = df.withColumn("_again", F.size("_8") > F.size(F.array_distinct("_8")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(
        F.transform("_8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
    n = F.greatest(F.size("_s") - 1, F.lit(0))
    # neighbours in sorted order with the same window: both places count
    df = df.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.transform(
        F.filter(F.arrays_zip(F.slice("_s", 1, n).alias("a"), F.slice("_s", 2, n).alias("b")),
                 lambda x: x["a"]["h"] == x["b"]["h"]),
        lambda x: F.array(x["a"]["i"], x["b"]["i"]))))))
    m = F.size("_at")
    steps = F.zip_with(F.slice("_at", 1, F.greatest(m - 1, F.lit(0))), F.slice("_at", 2, F.greatest(m - 1, F.lit(0))),
                       lambda a, b: F.least(b - a, F.lit(8)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + F.when(m > 0, 8).otherwise(0)
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_1", "_2", "_4", "_8", "_again", "_s", "_at")


def judge(docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """Signals and verdict of every document.

    ``docs`` needs ``text`` and ``lang``; the columns ``keep`` (null: all) stay
    in ``doc``.  Returns ``doc``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``char_distance``,
    ``word_distance`` (null: not compared) and ``kept``.  The signals are
    written once to the shared folder: the references need all of them before
    the first verdict.

    Null or empty text: all counts 0, base failed.  No label: compared with the
    nearest reference.  A label whose documents have too few words in all: its
    shares of letters, digits, white space and signs are compared with the
    nearest reference, its common words are not.  If there is no reference at
    all, the base rules decide.
    Repeated rows are judged alike and each stays a row; an empty table gives
    no rows.  Any length of text is read whole.
    """
    h = cut_lineage(signals(docs, keep), "signals")
    h = h.withColumn("base_failed", (F.col("n_words") < rules.least_words)
                     | (100 * F.col("n_repeat_words") > rules.most_repeated_pct * F.col("n_words")))
    refs = language_references(h, rules)
    nearest = refs.agg(F.collect_list(F.struct("ref_chars", "ref_hits")).alias("_refs"))
    j = h.join(refs, F.col("lang") == F.col("ref_lang"), "left").crossJoin(F.broadcast(nearest))
    own = F.col("ref_lang").isNotNull()
    foreign = F.col("lang").isNotNull() & ~own
    j = (j.withColumn("_refs", F.when(own, F.array(F.struct("ref_chars", "ref_hits"))).otherwise(F.col("_refs")))
         .withColumn("_chars", F.when(foreign, _signs(F.col("chars"))).otherwise(F.col("chars")))
         .withColumn("_n", F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)))
    far = F.array_min(F.transform("_refs", lambda r: _far(r, foreign)))
    j = (j.withColumn("_d", F.when(F.col("n_words") > 0, far))
         .withColumn("char_distance", F.when(F.col("_n") >= rules.least_chars, F.col("_d.c")))
         .withColumn("word_distance", F.when((F.col("n_words") >= rules.least_words) & ~foreign, F.col("_d.w"))))
    short = F.col("n_words") < rules.full_words
    diverges = (F.coalesce(F.col("char_distance") > _limit(rules.char_distance, rules.char_noise, F.col("_n"), rules.full_chars, short), F.lit(False))
                | F.coalesce(F.col("word_distance") > _limit(rules.word_distance, rules.word_noise, F.col("n_words"), rules.full_words, short),
                             F.lit(False)))
    return j.withColumn("kept", ~F.col("base_failed") & ~diverges).select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance",
        "word_distance", "kept")
