"""Column expressions for text: whitespace, escaping, the reference's regex predicates, rounding.

Every pattern here is written with explicit character classes instead of ``\\b``/``\\d``/``\\s`` so that
Java regex (Spark) and RE2 (the DuckDB oracle) give the same answer and both follow Python's Unicode
semantics: a word character is ``[\\pL\\pN_]``, a digit is ``\\p{Nd}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------------------------
# The 29 characters for which Python's str.isspace() is true (str.strip() / str.split()).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
            "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex class (Java and RE2 syntax).
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Line breaks of Python's universal-newline text reading.
LINE_BREAK = r"\r\n|\n|\r"
WORD = r"[\pL\pN_]"
NOT_WORD = r"[^\pL\pN_]"
# Score bonus: \d ; \b(kg|m|mm|cm|%|km|PLN|EUR|kW)\b ignoring case ; \b(19|20)\d{2}\b
DIGIT_RE = r"\p{Nd}"
SCORE_UNIT_WORDS = "kg|m|mm|cm|km|PLN|EUR|kW"
YEAR_RE = rf"(^|{NOT_WORD})(19|20)\p{{Nd}}{{2}}($|{NOT_WORD})"
# Labels: \b(kg|m|mm|cm|km|%)\b (case sensitive) ; \b\d+[.,]?\d*\b
LABEL_UNIT_WORDS = "kg|m|mm|cm|km"
NUMBER_RE = rf"(^|{NOT_WORD})\p{{Nd}}+($|{NOT_WORD})"
# Legal references on lower-cased text: \b(§|art\.|ust\.|pkt\.|dz\.u\.|poz\.)\b
LEGAL_RE = rf"{WORD}§{WORD}|(^|{NOT_WORD})(art|ust|pkt|dz\.u|poz)\.{WORD}"
# ----------------------------------------------------------------------------------------------

PERCENT_RE = rf"{WORD}%{WORD}"


def _word_alt(words: str) -> str:
    return rf"(^|{NOT_WORD})({words})($|{NOT_WORD})"


SCORE_UNIT_RE_JAVA = rf"(?iu){_word_alt(SCORE_UNIT_WORDS)}|{PERCENT_RE}"
SCORE_UNIT_RE_RE2 = rf"(?i){_word_alt(SCORE_UNIT_WORDS)}|{PERCENT_RE}"
LABEL_UNIT_RE = rf"{_word_alt(LABEL_UNIT_WORDS)}|{PERCENT_RE}"


def ustrip(c: Column) -> Column:
    """Python ``str.strip()``: ``trim`` with an explicit character set (no regex)."""
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """``not text.strip()`` (null counts as blank)."""
    return F.coalesce(ustrip(c) == F.lit(""), F.lit(True))


def word_count(c: Column) -> Column:
    """``len(text.split())``."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), rf"{WS_CLASS}+"), lambda x: x != ""))


def html_escape(c: Column) -> Column:
    """``html.escape(s, quote=True)``; ``&`` first."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for src, dst in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def has_digit(c: Column) -> Column:
    return c.rlike(DIGIT_RE)


def has_score_unit(c: Column) -> Column:
    return c.rlike(SCORE_UNIT_RE_JAVA)


def has_year(c: Column) -> Column:
    return c.rlike(YEAR_RE)


def has_label_unit(c: Column) -> Column:
    return c.rlike(LABEL_UNIT_RE)


def has_number(c: Column) -> Column:
    return c.rlike(NUMBER_RE)


def has_legal_ref(c: Column) -> Column:
    """Pattern applied to ``lower(text)`` as the reference does."""
    return F.lower(c).rlike(LEGAL_RE)


def round_half_up(c: Column, digits: int) -> Column:
    """``floor(x*10^d + 0.5) / 10^d``: the same bits in Spark and DuckDB (Python's ``round``
    can differ by one unit in the last place on exact-looking ties)."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def score_band(score: Column) -> Column:
    """``<3 low, <6 med, else high``."""
    return F.when(score < 3, "low").when(score < 6, "med").otherwise("high")


def short_fingerprint(sha1: Column) -> Column:
    """``sha1[:12]``."""
    return F.substring(F.coalesce(sha1, F.lit("")), 1, 12)
