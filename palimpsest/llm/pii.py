"""Operator 9, PII: detection on text that transducers have undisguised, with spans of the original.

The fixed patterns scan the text as it stands.  Then transducers normalise it: homoglyphs and other
scripts' digits become ASCII (one character for one), invisible characters go, ``[at]`` / ``(dot)`` and
spelled-out `` at `` / `` dot `` become ``@`` and ``.`` (`` at `` before a domain with a full stop only with a second
sign: a digit, ``.`` or ``_`` in the local part or a word of writing before it, and a public top-level domain), and runs of spelled digits become digits.  Each
transducer keeps the offsets, the same detectors run on the result, and spans that touch a rewritten
place are mapped back.  A mapped span that overlaps a span of the same kind is not added.

Every whole text is scanned in place; nothing is shuffled.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; an empty table
gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds in the order in which spans that start together are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def emails(text: str) -> list[Span]:
    """Local part, ``@``, domain: each ``@`` is looked at once, so no long run is tried from every place."""
    out, done = [], 0
    for m in DOMAIN.finditer(text):
        lo = max(done, text.rfind("@", done, m.start()) + 1)
        start = lo + len(text[lo:m.start()].rstrip(LOCAL))
        if start < m.start():
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, m.start())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def ips(text: str) -> list[Span]:
    return [(*m.span(), "ip") for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    return [(*m.span(), "card") for m in CARD.finditer(text)
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    return out + ips(text) + cards(text) + (phones(text) if "+" in text else [])


# ------------------------------------------------------------------------------- transducers
# Letters of other scripts that look like Latin ones.
_LOOKS = dict(zip("аеорсухіјѕһԁԛԝ" "АВЕКМНОРСТУХІЈЅ" "οανιρκ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                  "aeopcyxijshdqw" "ABEKMHOPCTYXIJS" "oavipk" "ABEZHIKMNOPTYX", strict=True))
_LOOKS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_LOOKS |= {"。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " "}
_DECIMALS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1)
             if unicodedata.decimal(chr(c), -1) >= 0}
_GLYPHS = str.maketrans(_DECIMALS | _LOOKS)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BRACKET = re.compile(r"\x20?[\[({<]\x20?(?:(at|@)|(dot|\.|punkt|punto|point))\x20?[\])}>]\x20?", re.I)
_BARE = re.compile(r"(?<=[A-Za-z0-9_%+-])(\x20at\x20)(?=[A-Za-z0-9-]+\x20dot\x20[A-Za-z])"
                   r"|(?<=[A-Za-z0-9-])(\x20dot\x20)(?=[A-Za-z][A-Za-z0-9-]*)", re.I)
# Top-level domains of more than two letters that a bare " at " is read before (two letters: any country).
_TOP = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "museum", "app", "dev", "online",
        "site", "shop", "store", "tech", "cloud", "email", "blog", "news", "live", "world", "agency", "xyz"]
_TLD = re.compile(r"(?<=[A-Za-z0-9_%+-])\x20at\x20(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\."
                  rf"(?:[a-z]{{2}}|[A-Z]{{2}}|{'|'.join(_TOP)}|xn--[A-Za-z0-9-]+)(?![A-Za-z0-9-]))")
_LOCAL_SIGN = re.compile(r"[A-Za-z][A-Za-z0-9%+-]*[0-9._][A-Za-z0-9._%+-]*\Z")
# Words that announce an address, in the languages of the corpus.
_CUE = re.compile(r"\b(?:e-?mails?|mail|contact|write to|reach|address|kontakt|schreib\w*|adresse?|correo|escrib\w*|"
                  r"contacto|courriel|[ée]crire|pisz|napisz|adres)\b[^\n@]{0,24}\Z", re.I)
_BEFORE = 64  # characters before a local part in which its sign and its cue are looked for


_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
            "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED_RUN = re.compile(rf"\b(plus[\x20-])?((?:{_DIGIT_WORD}|[0-9])(?:[\x20,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9]+))"
                          rf"{{6,}})\b", re.I)
_HAS_SPELLED = re.compile(rf"{_DIGIT_WORD}[\x20,.-]{{1,2}}{_DIGIT_WORD}[\x20,.-]", re.I)


def _announced(text: str, at: int) -> bool:
    """Whether a bare " at " at ``at`` has a second sign of an address."""
    before = text[max(0, at - _BEFORE):at]
    local = before[len(before.rstrip(LOCAL)):]
    return bool(_LOCAL_SIGN.match(local) or _CUE.search(before[:len(before) - len(local)]))


def _edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement), in order and apart from one another."""
    found = [(*m.span(), "") for m in _HIDDEN.finditer(text)]
    found += [(*m.span(), "@" if m[1] else ".") for m in _BRACKET.finditer(text)]
    if re.search(r"\x20dot\x20", text, re.I):
        found += [(*m.span(), "@" if m[1] else ".") for m in _BARE.finditer(text)]
    found += [(*m.span(), "@") for m in _TLD.finditer(text) if _announced(text, m.start())]
    if _HAS_SPELLED.search(text):
        for m in _SPELLED_RUN.finditer(text):
            digits = "".join(_SPELLED.get(w.lower(), w) for w in re.findall(r"[A-Za-z]+|[0-9]", m[2]))
            found.append((*m.span(), ("+" if m[1] else "") + digits))
    out, done = [], 0
    for a, b, r in sorted(found):
        if a >= done:
            out.append((a, b, r))
            done = b
    return out


def normalise(text: str) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """Normalised text; rewritten places as (start, end, source start, source end); places changed one for one."""
    plain = text if text.isascii() else text.translate(_GLYPHS)
    swapped = [i for i, (a, b) in enumerate(zip(plain, text)) if a != b] if plain != text else []
    parts, places, done, size = [], [], 0, 0
    for a, b, r in _edits(plain):
        parts += [plain[done:a], r]
        size += a - done
        places.append((size, size + len(r), a, b))
        size += len(r)
        done = b
    parts.append(plain[done:])
    return "".join(parts), places, swapped


def _sources(places, starts: list[int], ends: list[int], s: int, e: int) -> tuple[int, int, bool]:
    """Source span of ``s:e`` of the normalised text, and whether a rewritten place is inside; ``starts`` and ``ends``
    are those of the places."""
    i = bisect.bisect_left(ends, s)
    while i < len(places) and places[i][1] <= s and places[i][0] < s:
        i += 1
    touched = i < len(places) and places[i][0] < e
    before = places[i - 1] if i else (0, 0, 0, 0)
    start = places[i][2] if i < len(places) and places[i][0] <= s < places[i][1] else before[3] + s - before[1]
    j = bisect.bisect_left(starts, e) - 1
    last = places[j] if j >= 0 else (0, 0, 0, 0)
    end = last[3] if e <= last[1] and j >= 0 else last[3] + e - last[1]
    return start, end, touched


def _meeting(spans):
    """Whether a stretch meets one of the spans, in the logarithm of their number."""
    spans = sorted(s[:2] for s in spans)
    firsts, lasts = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))

    def meets(start: int, end: int) -> bool:
        k = bisect.bisect_left(firsts, end)
        return k > 0 and lasts[k - 1] > start
    return meets


def method_spans(text: str, base: list[Span]) -> list[Span]:
    plain, places, swapped = normalise(text)
    if plain == text:
        return []
    found = base_spans(plain)
    meets = _meeting(found)
    # spelled numbers of a phone's length, without a plus
    found += [(a, b, "phone") for a, b, _, _ in places if 10 <= b - a <= 15 and plain[a:b].isdigit() and not meets(a, b)]
    starts, ends = [p[0] for p in places], [p[1] for p in places]
    out = []
    for kind in KINDS:
        meets, done = _meeting([s for s in base if s[2] == kind]), 0
        for s, e, _ in sorted(f for f in found if f[2] == kind):  # in order, so the sources are in order too
            start, end, touched = _sources(places, starts, ends, s, e)
            k = bisect.bisect_left(swapped, start)
            if not touched and not (k < len(swapped) and swapped[k] < end):
                continue
            if start >= done and not meets(start, end):
                out.append((start, end, kind))
                done = end
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, KINDS.index(k), k, e) for s, e, k in spans))


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts.to_pylist():
        t = t or ""
        base = base_spans(t)
        rows.append((*[sum(k == kind for _, _, k in base) for kind in KINDS],
                     hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + method_spans(t, base))))
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      [f.split()[0] for f in FIELDS.split(", ")])


def scan(text: Column) -> Column:
    """Struct of ``FIELDS`` of a text."""
    return F.arrow_udf(_scan, FIELDS)(text)
