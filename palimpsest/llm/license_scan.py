"""Operator 5, license scans: short notices found with a bounded number of edits.

A notice of ``k`` allowed edits is split into ``k + 1`` pieces: wherever the notice stands with at most
``k`` edits, one piece stands unchanged (pigeonhole).  One automaton finds all pieces in the
normalised text (words joined by single spaces); around each hit the ``regex`` library matches the
notice with bounded errors, which gives the span and the number of edits.  The places of the fixed
phrases are counted besides, and always keep their labels.

Every whole text is scanned in place; nothing is shuffled.

Defined cases: a null or empty text has no words, labels ``''`` and score 0; repeated rows are scanned
one by one; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices, as their normalised words stand, and the edits allowed (one in twelve characters).
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
EDITS_PER = 12

# words are runs of anything but x00-2F, x3A-60 and x7B-7F, after A-Z are lowered
_BYTES = bytes((i + 32 if 65 <= i <= 90 else 32 if i < 0x30 or 0x3A <= i < 0x61 or 0x7B <= i < 0x80 else i)
               for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edits_of(notice: str) -> int:
    return len(notice) // EDITS_PER


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits + 1`` pieces that together make up the notice."""
    n = edits_of(notice) + 1
    cuts = [round(i * len(notice) / n) for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def seeds() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    found: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for at, piece in pieces(notice):
            found.setdefault(piece, []).append((notice, at))
    for piece, where in found.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto


def fuzzy() -> dict[str, regex.Pattern]:
    return {n: regex.compile(f"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={edits_of(n)}}}") for n in NOTICES}


def method_spans(text: str, auto, patterns) -> list[tuple[int, int, str, int, str]]:
    """(start, end, label, edits, notice) in the normalised text, best first where they overlap."""
    windows: dict[str, list[list[int]]] = {}
    for end, (size, where) in auto.iter(text):
        for notice, at in where:
            k = edits_of(notice)
            start = end - size + 1 - at
            lo, hi = max(0, start - k), min(len(text), start + len(notice) + k)
            spans = windows.setdefault(notice, [])
            if spans and spans[-1][0] <= lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
    out = []
    for notice, spans in windows.items():
        for lo, hi in spans:
            for m in patterns[notice].finditer(text, lo, hi):
                if m.end() > m.start():
                    out.append((m.start(), m.end(), NOTICES[notice], sum(m.fuzzy_counts), notice))
    return sorted(set(out), key=lambda s: (s[3], s[0], s[1], s[2]))


def original_spans(text: str, spans):
    """The same spans in code points of the text as it stands (label, start, end, edits)."""
    words = [m.span() for m in _WORD.finditer(text.translate({i: chr(i + 32) for i in range(65, 91)}))]
    joined, where = 0, []
    for a, b in words:
        where.append((joined, a))
        joined += b - a + 1

    def back(pos: int) -> int:
        i = bisect.bisect_right(where, (pos, float("inf"))) - 1
        return where[i][1] + min(pos - where[i][0], words[i][1] - words[i][0])
    return sorted((label, back(s), back(e - 1) + 1, edits) for s, e, label, edits, _ in spans)


def base_places(joined: str) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand, in ``joined`` with spaces at both ends."""
    out = []
    for phrase, label in PHRASES.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = joined.find(f" {phrase} ", at + 1)
    return out


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, method_spans array<struct<label:string,start:int,stop:int,edits:int>>")


def scan(text: Column) -> Column:
    """Struct of ``FIELDS``; ``score`` is 1 for a fixed phrase, else the best notice's share of right characters."""
    def run(batches):
        auto, patterns = seeds(), fuzzy()
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                words = (t or "").encode().translate(_BYTES).split()
                joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
                base = base_places(joined)
                firsts, seen, before = [], 0, 0
                for at in sorted(at for at, _ in base):  # one sweep over the text
                    seen, before = seen + joined.count(" ", before, at), at
                    firsts.append(seen)
                spans = method_spans(joined[1:-1], auto, patterns) if words else []
                labels = {label for _, label in base}
                score = 1.0 if base else max((1 - e / len(n) for _, _, _, e, n in spans), default=0.0)
                rows.append((len(words), len(base), min(firsts, default=None), max(firsts, default=None),
                             ",".join(sorted(labels)), ",".join(sorted(labels | {s[2] for s in spans})), score,
                             [dict(zip(("label", "start", "stop", "edits"), s))
                              for s in original_spans(t, spans)] if spans else []))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                              "score", "method_spans"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, FIELDS)(text)
