"""Operator 7, benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers (digits or spelled), names (capitalised words, wherever they stand) and units (after a number) become
typed slots, all else is lowered; a text is then a row of template tokens.  Names in a row ("New York", "O'Neil")
and the words of a spelled number ("twenty-five", "3 million") are one slot.  ``NOT_NAMES``, words in capitals
throughout and other words without a small letter are words; so an item whose words at sentence starts were
lowered is found by its other windows alone.  Every window of ``WINDOW`` tokens of the
benchmark items is hashed and held by the executors; every window of every whole document is hashed in
place and looked up, so the documents are scanned once and not shuffled.  A window with more slots than
words says little as a template and is looked up with its values.  Each run of hits brings the document's
tokens of its diagonal (document position less item position), and there all windows are compared again:
equal benchmark values must stand for equal document values, and windows that hold a slot that breaks this
are dropped.  Of a benchmark value's several document values the benchmark's own holds, else the one of
most of its slots, else none.  Windows with more slots than words count when a window of words stands on
the same diagonal, or when their values agree too.  A document leaks an item when the windows left cover
``MIN_SHARE`` of the item's tokens or ``RUN`` of them in a row, be the slots filled anew or not.

Bounds: the window table is broadcast in blocks of at most ``BLOCK_WINDOWS`` narrow rows; a
larger benchmark takes one scan of the documents a block.  Items shorter than a window are looked up
whole, those of fewer than ``MIN_TOKENS`` tokens with their values, as their templates are too common.

Defined cases: null or empty texts match nothing, on either side; null ids are kept; repeated rows (equal
in id and text) are one; several items may match one document, and ties need no order; an empty table on
either side gives an empty result; extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage, free_name, narrow_ids

WINDOW = 8
MIN_TOKENS = 5
MIN_SHARE = 0.5
RUN = 13  # covered tokens in a row that are a leak whatever the item's length
BLOCK_WINDOWS = 500_000

# Slots: one mark before the value; POINT joins the parts of a value, END and PART are there while marking.  These
# control characters are taken out of texts first.
NUMBER, NAME, UNIT, POINT, END, PART = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"
# Units of measure, as they follow a number.
UNITS = ["kg", "g", "mg", "km", "m", "cm", "mm", "l", "ml", "s", "min", "h", "hour", "hours", "minute", "minutes",
         "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "mile", "miles",
         "meter", "meters", "metre", "metres", "inch", "inches", "foot", "feet", "pound", "pounds", "ounce", "ounces",
         "liter", "liters", "litre", "litres", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
         "degree", "degrees", "gram", "grams", "kilogram", "kilograms", "kilometer", "kilometers", "mph", "kmh"]

# Words of spelled numbers.
SPELLED = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
           "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
           "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen"]
# Words that begin sentences and are no names.
NOT_NAMES = ["a", "an", "the", "this", "that", "these", "those", "there", "here", "it", "its", "he", "she", "they", "we",
             "you", "his", "her", "their", "our", "your", "my", "who", "whose", "what", "which", "when", "where", "why",
             "how", "if", "in", "on", "at", "by", "for", "from", "of", "to", "with", "without", "and", "or", "but", "so",
             "as", "after", "before", "during", "since", "until", "while", "each", "every", "all", "some", "any", "no",
             "not", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "would",
             "should", "then", "now", "also", "let", "given", "find", "calculate", "compute", "determine", "solve",
             "suppose", "assume", "consider", "explain", "describe", "write", "choose", "answer", "question"]
_LETTER = r"[\p{L}\p{M}]"


def _one_of(words: list[str]) -> str:
    """Pattern of the words, grouped by first letter: a regex engine tries alternatives one by one."""
    heads = sorted({w[0] for w in words})
    return f"(?=[{''.join(heads)}])(?:" + "|".join(
        f"{h}(?:{'|'.join(w[1:] for w in words if w[0] == h)})" for h in heads) + ")"


_NAME = (rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?=\p{{Lu}})(?!{_one_of([w.capitalize() for w in NOT_NAMES + SPELLED])}(?!{_LETTER}))"
         rf"(\p{{Lu}}+\p{{Ll}}{_LETTER}*|\p{{Lu}}(?=['’]\p{{Lu}}\p{{Ll}}))")
_SPELLED = rf"(?=[a-z])(?<![\p{{L}}\p{{M}}{NAME}{POINT}])({_one_of(SPELLED)})(?!{_LETTER}|{POINT})"


def marked(text: Column) -> Column:
    """The text with its slots marked, lowered."""
    def joined(t: Column, mark: str, between: str) -> Column:
        for c in between:
            t = F.replace(t, F.lit(END + c + mark), F.lit(POINT))
        return t
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{PART}]+", "")
    t = joined(F.regexp_replace(t, _NAME, f"{NAME}$1{END}"), NAME, " '’-")
    t = F.regexp_replace(F.lower(F.replace(t, F.lit(END), F.lit(" "))), r"(?<=[0-9])[.,](?=[0-9])", POINT)
    t = F.regexp_replace(t, rf"([0-9][0-9{POINT}]*)", f" {NUMBER}$1{END}")
    t = joined(F.regexp_replace(t, _SPELLED, f"{PART}$1{END}"), PART, " -")
    t = F.replace(t, F.lit(PART), F.lit(f" {NUMBER}"))
    return F.regexp_replace(t, rf"{END} {{0,3}}({'|'.join(UNITS)})(?!{_LETTER})", f" {UNIT}$1 ")


def tokens(mark: Column) -> Column:
    """Words, and slots with their values."""
    return F.array_remove(F.split(mark, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{POINT}]+"), "")


def template(mark: Column) -> Column:
    """The same tokens, slots without their values."""
    return tokens(F.regexp_replace(mark, rf"([{NUMBER}-{UNIT}])[\p{{L}}\p{{M}}\p{{N}}{POINT}]+", "$1"))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    mark = marked(F.col(f"`{text}`"))
    return (benchmark.select(F.col(f"`{item_id}`").alias("item_id"), tokens(mark).alias("item_words"),
                             template(mark).alias("item_template"))
            .withColumn("n_tokens", F.size("item_template")).where(F.col("n_tokens") > 0).distinct())


def _n_words(part: Column) -> Column:
    for mark in (NUMBER, NAME, UNIT):
        part = F.array_remove(part, mark)
    return F.size(part)


def _by_value(part: Column, width: Column) -> Column:
    """Whether a window of template tokens has more slots than words, or is a short item."""
    return (2 * _n_words(part) < width) | (width < MIN_TOKENS)


def _windows(items: DataFrame) -> DataFrame:
    """``(key, before, item_row, at, width, n_tokens, by_value)`` of the items' windows; ``before`` is the key of the
    window one token earlier."""
    width = F.least(F.lit(WINDOW), F.col("n_tokens"))
    rows = items.select("item_row", "item_template", "item_words", "n_tokens", width.alias("width"),
                        F.explode(F.sequence(F.lit(1), F.col("n_tokens") - width + 1)).alias("at"))
    keyed = rows.select("*", *[_key("item_words", "item_template", at, F.col("width")).alias(name)
                               for name, at in (("key", F.col("at")), ("earlier", F.greatest(F.col("at") - 1, F.lit(1))))])
    return keyed.select("key", F.when(F.col("at") > 1, F.col("earlier")).alias("before"), "item_row", "at", "width",
                        "n_tokens", _by_value(F.slice("item_template", F.col("at"), F.col("width")), F.col("width"))
                        .alias("by_value"))


def _key(words: str, tmpl: str, at: Column, width: Column, values: bool = True) -> Column:
    """Hash of the window at ``at``; without ``values`` all windows are hashed as templates."""
    part = F.slice(tmpl, at, width)
    plain = F.xxhash64(part)
    return F.when(_by_value(part, width), F.xxhash64(F.slice(words, at, width))).otherwise(plain) if values else plain


def _compared(diagonal: DataFrame) -> DataFrame:
    """Adds ``ats``, the windows that count, and ``refilled``; positions are the item's, from 1."""
    n, width = F.col("n_tokens"), F.col("width")
    at = lambda a, p: F.get(a, p - 1)
    doc = lambda a, p: F.get(a, p - F.col("first"))
    inside = lambda a, p: (a <= p) & (p < a + width)
    same = F.transform(F.sequence(F.lit(1), n), lambda p: F.coalesce(at("item_template", p) == doc("tmpl", p), F.lit(False)))
    # bound by an array of one, or the planner puts it into the lambda and it runs again for every window
    stand = F.transform(F.array(same), lambda eq: F.filter(F.sequence(F.lit(1), n - width + 1),
                                                           lambda a: F.forall(F.slice(eq, a, width), lambda x: x)))
    d = diagonal.withColumn("stand", F.get(stand, F.lit(0)))
    d = d.withColumn("s", F.transform(
        F.filter(F.sequence(F.lit(1), n), lambda p: at("item_template", p).isin(NUMBER, NAME, UNIT)
                 & F.exists("stand", lambda a: inside(a, p))),
        lambda p: F.struct(p.alias("p"), at("item_words", p).alias("b"), doc("words", p).alias("d"))))
    own = lambda x: F.exists("s", lambda y: (y["b"] == x["b"]) & (y["d"] == y["b"]))
    most = lambda x: (2 * F.size(F.filter("s", lambda y: (y["b"] == x["b"]) & (y["d"] == x["d"])))
                      > F.size(F.filter("s", lambda y: y["b"] == x["b"])))
    d = d.withColumn("bad", F.filter("s", lambda x: (x["d"] != x["b"]) & (own(x) | ~most(x))))
    d = d.withColumn("good", F.filter("stand", lambda a: ~F.exists("bad", lambda x: inside(a, x["p"]))))
    words = F.exists("good", lambda a: ~_by_value(F.slice("item_template", a, width), width))
    anew = lambda a: F.exists("s", lambda x: inside(a, x["p"]) & (x["b"] != x["d"]))
    d = d.withColumn("ats", F.when(words, F.col("good")).otherwise(F.filter("good", lambda a: ~anew(a))))
    changed = F.filter("s", lambda x: (x["b"] != x["d"]) & F.exists("ats", lambda a: inside(a, x["p"])))
    return d.where(F.size("ats") > 0).withColumn(
        "refilled", F.size(F.array_distinct(F.transform(changed, lambda x: F.struct(x["b"], x["d"])))))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_tokens, n_covered, share, refilled)`` of every document and item that leak.

    ``refilled`` is the number of slots whose value differs from the benchmark's.
    """
    items = cut_lineage(_items(benchmark, item_id, item_text)
                        .withColumn("item_row", F.xxhash64(F.col("item_id").isNull(), "item_id", "item_words")))
    windows = cut_lineage(_windows(items))
    kinds = {r[0]: r[1] for r in windows.groupBy("width").agg(F.max("by_value")).collect()}  # at most WINDOW rows
    blocks = max(1, math.ceil(windows.count() / BLOCK_WINDOWS))
    mark = marked(F.col(f"`{text}`"))
    tokenised = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
                            tokens(mark).alias("words"), template(mark).alias("tmpl"))
    hits = None
    for width, values in sorted(kinds.items()) or [(WINDOW, False)]:
        key = lambda at: _key("words", "tmpl", at, F.lit(width), values)  # noqa: E731, B023
        # null for shorter texts; a filter on the size would be pushed below the tokens and take every text apart twice
        places = F.when(F.size("tmpl") >= width, F.sequence(F.lit(1), F.size("tmpl") - width + 1))
        rows = tokenised.select("*", F.explode(places).alias("i")).withColumn("k", key(F.col("i")))
        for b in range(blocks):
            some = windows.where((F.col("width") == width)
                                 & (F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == b))
            # a run of hits is told by its first window
            goes_on = (F.col("i") > 1) & (key(F.greatest(F.col("i") - 1, F.lit(1))) == F.col("before"))
            diagonal = F.col("i") - F.col("at")
            begin = F.greatest(diagonal + 1, F.lit(1))
            size = F.col("n_tokens") + diagonal - begin + 1
            hit = (rows.join(F.broadcast(some.select("key", "before", "item_row", "at", "n_tokens")),
                             F.col("k") == F.col("key"))
                   .where(~F.coalesce(goes_on, F.lit(False)))
                   .select("doc_id", "text_hash", "item_row", diagonal.alias("diagonal"), F.lit(width).alias("width"),
                           (begin - diagonal).alias("first"), F.slice("words", begin, size).alias("words"),
                           F.slice("tmpl", begin, size).alias("tmpl")))
            hits = hit if hits is None else hits.union(hit)
    # one row of each diagonal: its runs, equal rows of a table, or equal items, give the same tokens again
    found = hits.groupBy("doc_id", "text_hash", "item_row", "diagonal").agg(
        *[F.first(c).alias(c) for c in ("width", "first", "words", "tmpl")])
    ok = _compared(found.join(F.broadcast(items) if blocks == 1 else items, "item_row"))
    both = ok.groupBy("doc_id", "text_hash", "item_row").agg(
        F.first("item_id").alias("item_id"), F.first("n_tokens").alias("n_tokens"), F.first("width").alias("width"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"),
        F.sum("refilled").alias("refilled"))
    covered = F.col("width") + F.aggregate(
        F.sequence(F.lit(1), F.size("ats")), F.lit(0),
        lambda acc, i: acc + F.when(i == 1, 0).otherwise(
            F.least(F.col("width"), F.element_at("ats", i) - F.element_at("ats", F.greatest(i - 1, F.lit(1))))))
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("last"), F.lit(0).alias("longest"))

    def longer(acc, a):
        start = F.when((acc["last"] > 0) & (a - acc["last"] <= F.col("width")), acc["start"]).otherwise(a)
        return F.struct(start.alias("start"), a.alias("last"),
                        F.greatest(acc["longest"], a + F.col("width") - start).alias("longest"))

    run = F.aggregate("ats", none, longer, lambda acc: acc["longest"])
    return (both.withColumn("n_covered", covered).withColumn("share", F.col("n_covered") / F.col("n_tokens"))
            .where((F.col("share") >= min_share) | (run >= F.least(F.lit(RUN), F.col("n_tokens"))))
            .select("doc_id", "text_hash", "item_id", "n_tokens", "n_covered", "share", "refilled"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item."""
    found = cut_lineage(leaks(docs, benchmark, doc_id, text, item_id, item_text).select("doc_id", "text_hash").distinct())
    h = free_name(docs, "_hash")
    gone = narrow_ids(found.select(F.struct("doc_id", "text_hash").alias("g")))
    return (docs.withColumn(h, F.xxhash64(F.col(f"`{text}`")))
            .join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & (F.col(h) == F.col("g.text_hash")),
                  "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))
