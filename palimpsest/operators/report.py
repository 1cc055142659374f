"""Statistics, ranking, table of contents, summary, facets.

Everything is a ``groupBy`` with partial aggregation or a window partitioned by document; nothing is
collected.  Tie-breaks follow the reference: top changes sort ``(score, idx)`` both descending; the
table of contents sorts by significance descending with ties in entry order (a stable sort); the
dominant change type is the most frequent one, ties going to the type seen first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import rank_within, slice_of
from ..functions.text import html_escape, round_half_up

# ---- fixed values ----------------------------------------------------------------------------------
CHANGE_VALUES = ["added", "deleted", "changed", "unchanged"]
TOC_LIMIT = 200
NO_CHANGES = "No significant changes detected in the document."
SENTENCE = ("The document contains ", " changes (out of ", " blocks), of which ", "% are of type <b>",
            "</b>. Dominant AI labels: ", ".")
# -----------------------------------------------------------------------------------------------------


def _counts(cat):
    return [F.sum(F.when(cat == v, 1).otherwise(0)).cast("bigint").alias(v) for v in CHANGE_VALUES]


def change_counts(changes: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """H1 (+H9): per document the four counters (zero-filled), ``unknown`` (no change value), ``other`` (an
    unexpected one) and ``total_blocks``, their sum.

    With ``docs`` (``doc_id`` of every compared document) documents without entries get zeros."""
    ch = F.coalesce(F.col("change"), F.lit("unknown"))
    rest = [F.sum((ch == "unknown").cast("bigint")).alias("unknown"),
            F.sum((~ch.isin(*CHANGE_VALUES, "unknown")).cast("bigint")).alias("other")]
    agg = changes.groupBy("doc_id").agg(*_counts(ch), *rest, F.count(F.lit(1)).alias("total_blocks"))
    if docs is None:
        return agg
    return docs.select("doc_id").join(agg, "doc_id", "left").na.fill(
        0, CHANGE_VALUES + ["unknown", "other", "total_blocks"])


def stats_by_type(changes: DataFrame) -> DataFrame:
    """H2: per document and effective type; an unexpected change value counts as ``changed``."""
    cat = F.when(F.col("change").isin(*CHANGE_VALUES), F.col("change")).otherwise(F.lit("changed"))
    return changes.groupBy("doc_id", "type").agg(*_counts(cat))


def stats_rollup(changes: DataFrame) -> DataFrame:
    """H3: H1 and H2 for (document, type), document and corpus in one pass (``rollup``)."""
    cat = F.when(F.col("change").isin(*CHANGE_VALUES), F.col("change")).otherwise(F.lit("changed"))
    return (changes.rollup("doc_id", "type")
            .agg(*_counts(cat), F.count(F.lit(1)).alias("total_blocks"),
                 F.grouping_id().alias("level")))


def top_changes(scored: DataFrame) -> DataFrame:
    """Non-unchanged entries ranked by ``(score desc, entry_idx desc)`` per document (a full ranking,
    in slices of equal score and near positions, see ``functions.ranking``)."""
    ch = scored.filter(F.col("change").isin("changed", "added", "deleted")).select(
        "doc_id", "entry_idx", "change", "score")
    return rank_within(ch, ["doc_id"], [F.col("score").desc(), F.col("entry_idx").desc()],
                       [(F.col("score"), False), (slice_of("entry_idx"), False)])


def toc(scored: DataFrame, limit: int | None = TOC_LIMIT) -> DataFrame:
    """I2-I4 + E13: the table of contents of each document, at most ``limit`` rows.

    The label is ``"{sem}/10"`` or ``"s={score}"``; the name is the entry's own ``type`` (changed entries
    have none, hence ``blk``)."""
    w = Window.partitionBy("doc_id").orderBy(F.col("toc_key").desc(), F.col("entry_idx").asc())
    own_type = F.when(F.col("change") == "changed", F.lit(None)).otherwise(F.col("type"))
    name = html_escape(F.coalesce(F.nullif(own_type, F.lit("")), F.lit("blk")))
    label = F.when(F.col("semantic_score").isNotNull(),
                   F.concat(F.col("semantic_score").cast("string"), F.lit("/10"))) \
        .otherwise(F.concat(F.lit("s="), F.col("score").cast("string")))
    ranked = (scored.filter(F.col("change").isin("changed", "added", "deleted"))
              .select("doc_id", "entry_idx", "change", "score", "semantic_score", "toc_key",
                      F.row_number().over(w).alias("rank"),
                      F.concat(F.lit("#"), F.col("entry_idx").cast("string"), F.lit("("), name, F.lit(") "), label)
                      .alias("toc_label")))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def corpus_top_k(scored: DataFrame, k: int) -> DataFrame:
    """I8: the ``k`` most significant changes of the whole corpus (``TakeOrderedAndProject``)."""
    return (scored.filter(F.col("change").isin("changed", "added", "deleted"))
            .orderBy(F.col("toc_key").desc(), F.col("doc_id").asc(), F.col("entry_idx").asc())
            .select("doc_id", "entry_idx", "change", "score", "semantic_score", "toc_key").limit(k))


def filter_changes(changes: DataFrame, change_values: Sequence[str] = (), types: Sequence[str] = (),
                   hide_unchanged: bool = False) -> DataFrame:
    """An empty selection means no filter; OR inside a facet, AND across facets."""
    out = changes
    if change_values:
        out = out.filter(F.col("change").isin(*change_values))
    if types:
        out = out.filter(F.col("type").isin(*types))
    if hide_unchanged:
        out = out.filter(F.col("change") != "unchanged")
    return out


def type_facets(changes: DataFrame) -> DataFrame:
    """Types of each document in first-seen order."""
    first = changes.groupBy("doc_id", "type").agg(F.min("entry_idx").alias("first_idx"))
    w = Window.partitionBy("doc_id").orderBy("first_idx")
    return first.select("doc_id", "type", "first_idx", F.row_number().over(w).alias("facet_pos"))


def _by_change_type(analyzed: DataFrame) -> DataFrame:
    """``(doc_id, ctype, cnt, first_idx, label_sets)``; ``ctype`` is null for entries that did not change."""
    changed = F.col("change") == "changed"
    ctype = F.when(changed, F.coalesce(F.nullif(F.col("change_type"), F.lit("")), F.lit("undefined")))
    return analyzed.groupBy("doc_id", ctype.alias("ctype")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("entry_idx").alias("first_idx"),
        F.collect_set(F.when(changed, F.coalesce("labels", F.array().cast("array<string>")))).alias("label_sets"))


def type_distribution(analyzed: DataFrame) -> DataFrame:
    """H4: changed entries by change type, whatever the types are (``''`` or null -> ``undefined``)."""
    return (_by_change_type(analyzed).filter(F.col("ctype").isNotNull())
            .select("doc_id", F.col("ctype").alias("change_type"), F.col("cnt").alias("n_changes"), "first_idx"))


def doc_summary(analyzed: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """H4-H9: one sentence per document.

    ``analyzed`` has ``doc_id, entry_idx, change, change_type, labels``.  Entries are counted by document and
    change type first (any type; partial aggregation), then the few rows of a document meet: the dominant
    type is the greatest ``(count, -first_idx)``.  Label sets are sets of label arrays (bounded by the small
    label vocabulary), flattened afterwards.  The share is rounded to one decimal."""
    is_type = F.col("ctype").isNotNull()
    g = _by_change_type(analyzed).groupBy("doc_id").agg(
        F.sum("cnt").alias("total_blocks"), F.sum(F.when(is_type, F.col("cnt")).otherwise(0)).alias("n_changed"),
        F.max(F.when(is_type, F.struct("cnt", (-F.col("first_idx")).alias("nf"), F.col("ctype").alias("t")))).alias("best"),
        F.flatten(F.collect_list("label_sets")).alias("label_sets"))
    g = g.select("doc_id", "total_blocks", "n_changed", "best",
                 F.array_join(F.array_sort(F.array_distinct(F.flatten("label_sets"))), ", ").alias("label_set"))
    out = g if docs is None else docs.select("doc_id").join(g, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("total_blocks", F.lit(0)).alias("total_blocks"),
                     F.coalesce("n_changed", F.lit(0)).cast("bigint").alias("n_changed"),
                     F.col("best.t").alias("dominant_type"), F.col("best.cnt").alias("dominant_count"), "label_set")
    share = round_half_up(F.col("dominant_count") / F.col("n_changed") * F.lit(100.0), 1)
    labels = F.when(F.col("label_set") == "", F.lit("none")).otherwise(F.col("label_set"))
    sentence = F.when(F.col("n_changed") == 0, F.lit(NO_CHANGES)).otherwise(F.concat(
        F.lit(SENTENCE[0]), F.col("n_changed").cast("string"), F.lit(SENTENCE[1]), F.col("total_blocks").cast("string"),
        F.lit(SENTENCE[2]), share.cast("string"), F.lit(SENTENCE[3]), F.col("dominant_type"), F.lit(SENTENCE[4]), labels,
        F.lit(SENTENCE[5])))
    return out.select("doc_id", "n_changed", "total_blocks", "dominant_type",
                      F.when(F.col("n_changed") > 0, share).alias("dominant_share"),
                      F.when(F.col("n_changed") > 0, labels).alias("label_set"), sentence.alias("summary"))
