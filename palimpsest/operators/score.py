"""Change score, semantic score, confidence, change type, analysis of changed entries.

All terms are column expressions.  Additions follow the reference's order (0.0, then +2.5, then the
ratio term, then the bonuses, then the type bonus) so the doubles are bit-identical to the
reference's before rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (clamp, has_digit, has_legal_ref, has_score_unit, has_year, round_half_up,
                              word_count)

# ---- fixed values of the reference's scoring -------------------------------------------------------
ADDED_DELETED_POINTS = 2.5
RATIO_WEIGHT = 6.0
DIGIT_POINTS = 0.8
UNIT_POINTS = 0.8
YEAR_POINTS = 0.6
IMAGE_TABLE_POINTS = 2.0
CONFIDENCE_CENTER = 0.85
CONFIDENCE_FALLBACK = 0.5
EDITORIAL_RATIO = 0.9
SUBSTANTIVE_LABELS = ["number", "amount", "date", "unit"]
# -----------------------------------------------------------------------------------------------------


def entry_texts(old_text: Column, new_text: Column) -> tuple[Column, Column, Column]:
    """``old.text or ''``, ``new.text or ''`` and ``old + ' ' + new``."""
    o = F.coalesce(old_text, F.lit(""))
    n = F.coalesce(new_text, F.lit(""))
    return o, n, F.concat(o, F.lit(" "), n)


def _term(cond: Column, points) -> Column:
    """``points`` when ``cond`` else ``0.0``: adding a skipped term adds exactly 0.0, so the running sum
    has the same bits as the reference's conditional ``+=`` chain (and the expression stays linear)."""
    return F.when(cond, points).otherwise(F.lit(0.0))


def change_score(change: Column, type_: Column, old_text: Column, new_text: Column, ratio: Column) -> Column:
    """clamp to [0, 10], round to 2 decimals."""
    _, _, combined = entry_texts(old_text, new_text)
    changed = change == "changed"
    s = F.lit(0.0)
    s = s + _term(change.isin("added", "deleted"), F.lit(ADDED_DELETED_POINTS))
    s = s + _term(changed, (F.lit(1.0) - ratio) * F.lit(RATIO_WEIGHT))
    s = s + _term(changed & has_digit(combined), F.lit(DIGIT_POINTS))
    s = s + _term(changed & has_score_unit(combined), F.lit(UNIT_POINTS))
    s = s + _term(changed & has_year(combined), F.lit(YEAR_POINTS))
    s = s + _term(type_.isin("image", "table"), F.lit(IMAGE_TABLE_POINTS))
    return round_half_up(clamp(s, 0.0, 10.0), 2)


def score_bonus(old_text: Column, new_text: Column) -> Column:
    """The text-pattern part of F1 for a changed pair (digit, unit, year), in the reference's order."""
    _, _, combined = entry_texts(old_text, new_text)
    s = F.lit(0.0) + _term(has_digit(combined), F.lit(DIGIT_POINTS))
    s = s + _term(has_score_unit(combined), F.lit(UNIT_POINTS))
    return s + _term(has_year(combined), F.lit(YEAR_POINTS))


def semantic_score(similarity: Column, ratio: Column) -> Column:
    """``round((1 - sim) * 10, 2)``, not clamped; without a similarity the ratio is used."""
    basis = F.coalesce(similarity, ratio)
    return round_half_up((F.lit(1.0) - basis) * F.lit(10.0), 2)


def confidence(similarity: Column) -> Column:
    """``round(1 - abs(0.85 - sim), 2)``; 0.5 when there is no similarity."""
    return F.when(similarity.isNotNull(),
                  round_half_up(F.lit(1.0) - F.abs(F.lit(CONFIDENCE_CENTER) - similarity), 2)) \
        .otherwise(F.lit(CONFIDENCE_FALLBACK))


def change_type(old_text: Column, new_text: Column, labels: Column, ratio: Column) -> Column:
    """first rule that matches wins."""
    o, n, combined = entry_texts(old_text, new_text)
    subst = F.arrays_overlap(F.coalesce(labels, F.array().cast("array<string>")),
                             F.array(*[F.lit(x) for x in SUBSTANTIVE_LABELS]))
    return (F.when(F.coalesce(subst, F.lit(False)), "substantive")
            .when(has_legal_ref(combined), "technical")
            .when(ratio > EDITORIAL_RATIO, "editorial")
            .when(word_count(o) != word_count(n), "formal")
            .otherwise("substantive"))


def significance(score: Column, sem: Column) -> Column:
    """``score * 0.6`` without a semantic score, else ``sem + score * 0.1``."""
    return F.when(sem.isNull(), score * F.lit(0.6)).otherwise(sem + score * F.lit(0.1))
