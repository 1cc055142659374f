"""End-to-end comparison of two corpus snapshots.

``Comparison`` wires the operators into the reference's pipeline, lazily:

    blocks -> keys -> doc status -> alignment -> entries + payload
           -> character kernel (changed pairs only) -> score -> analysis -> stats / toc / summary

Every property returns a DataFrame; nothing runs until an action.  The only Python on the hot path
is the two Arrow kernels (block-key alignment of ordinary documents, character diff of changed
pairs); oversized documents align without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, report, score, text_align
from ..operators.celldiff import nested_table_diff, with_nested_markup
from ..operators.semantics import entity_labels, label_union
from ..operators.textdiff import with_text_diff
from ..functions.text import score_band


@dataclass
class Comparison:
    old_docs: DataFrame
    new_docs: DataFrame
    old_blocks: DataFrame
    new_blocks: DataFrame
    autojunk: bool = True
    max_udf_blocks: int = align.MAX_UDF_BLOCKS
    gazetteer: DataFrame | None = None
    use_similarity: bool = True
    old_lines: DataFrame | None = None
    new_lines: DataFrame | None = None
    small_range: int | None = None  # of route 2; None: align_frontier.SMALL_RANGE

    @classmethod
    def from_lines(cls, old_lines: DataFrame, new_lines: DataFrame, **kw) -> "Comparison":
        """Text corpora given as ``(doc_id, lines ARRAY<STRING>)`` per side (see ``text_align``)."""
        from ..sources.lines import lines_blocks
        return cls(old_lines.select("doc_id"), new_lines.select("doc_id"), lines_blocks(old_lines),
                   lines_blocks(new_lines), old_lines=old_lines, new_lines=new_lines, **kw)

    @property
    def text_mode(self) -> bool:
        return self.old_lines is not None and self.new_lines is not None

    # ---- C ------------------------------------------------------------------------------------------
    @property
    def status(self) -> DataFrame:
        if self.text_mode:
            return text_align.text_status(self.old_lines, self.new_lines, self.max_udf_blocks)
        return align.doc_status(self.old_docs, self.new_docs, self.old_blocks, self.new_blocks,
                                self.max_udf_blocks)

    @property
    def entries(self) -> DataFrame:
        if self.text_mode:
            return text_align.text_positions(self.old_lines, self.new_lines, self.autojunk, self.max_udf_blocks,
                                             self.small_range)
        return align.align_blocks(self.old_docs, self.new_docs, self.old_blocks, self.new_blocks,
                                  self.autojunk, self.max_udf_blocks, with_payload=False, small_range=self.small_range)

    @property
    def typed_entries(self) -> DataFrame:
        """Entries with their effective ``type``; of a text corpus, whose blocks are all paragraphs, no text moves."""
        if self.text_mode:
            return self.entries.withColumn("type", F.lit("paragraph"))
        return self.changes

    @property
    def changes(self) -> DataFrame:
        """One row per entry with both payloads (prefixed ``old_`` / ``new_``) and effective ``type``."""
        if self.text_mode:
            return text_align.text_changes(self.old_lines, self.new_lines, self.autojunk, self.max_udf_blocks,
                                           self.small_range)
        return align.align_blocks(self.old_docs, self.new_docs, self.old_blocks, self.new_blocks,
                                  self.autojunk, self.max_udf_blocks, small_range=self.small_range)

    # ---- D ------------------------------------------------------------------------------------------
    @property
    def detailed(self) -> DataFrame:
        """D1/D4/D6 + E7: ``ratio`` for changed entries, ``inline_html`` for paragraph pairs,
        ``table_changes`` (with ``inline_html`` in each changed cell) for table pairs."""
        ch = self.changes
        changed = F.col("change") == "changed"
        para = changed & (F.col("old_type") == "paragraph") & (F.col("new_type") == "paragraph")
        table = changed & (F.col("old_type") == "table") & (F.col("new_type") == "table")
        out = (with_text_diff(ch, F.when(changed, F.col("old_text")), F.when(changed, F.col("new_text")), "_k",
                               self.autojunk, with_tokens=self.use_similarity)
                .withColumn("ratio", F.when(changed, F.col("_k.ratio")))
                .withColumn("inline_html", F.when(para & F.col("old_text").isNotNull() & F.col("new_text").isNotNull(),
                                                  F.col("_k.inline_html")))
                .withColumn("table_changes", F.when(table, nested_table_diff(F.col("old_table"), F.col("new_table"))))
                .withColumn("similarity", F.when(changed, F.col("_k.similarity")) if self.use_similarity
                            else F.lit(None).cast("double"))
                .drop("_k"))
        return out if self.text_mode else with_nested_markup(out)  # a text corpus has no tables

    # ---- F ------------------------------------------------------------------------------------------
    @property
    def scored(self) -> DataFrame:
        d = self.detailed
        s = score.change_score(F.col("change"), F.col("type"), F.col("old_text"), F.col("new_text"), F.col("ratio"))
        return d.withColumn("score", s).withColumn("score_band", score_band(F.col("score")))

    @property
    def analyzed(self) -> DataFrame:
        """F5 on changed entries + I2 key on all entries."""
        sc = self.scored
        changed = F.col("change") == "changed"
        o = F.coalesce(F.col("old_text"), F.lit(""))
        n = F.coalesce(F.col("new_text"), F.lit(""))
        merged = F.concat(o, F.lit(" "), n)
        base = sc.withColumn("_merged", F.when(changed, merged))
        if self.gazetteer is not None:
            ents = entity_labels(base.filter(changed), ["doc_id", "entry_idx"], "_merged", self.gazetteer)
            base = base.join(ents, ["doc_id", "entry_idx"], "left")
            ent = F.col("entity_labels")
        else:
            ent = None
        sim = F.col("similarity")   # from the kernel pass (G3), null when similarity is off
        labels = label_union(F.col("_merged"), ent)
        out = (base.withColumn("labels", F.when(changed, labels))
               .withColumn("semantic_score", F.when(changed, score.semantic_score(sim, F.col("ratio"))))
               .withColumn("change_type", F.when(changed, score.change_type(F.col("old_text"), F.col("new_text"),
                                                                            F.col("labels"), F.col("ratio"))))
               .withColumn("confidence", F.when(changed, score.confidence(sim)))
               .drop("_merged"))
        if "entity_labels" in out.columns:
            out = out.drop("entity_labels")
        return out.withColumn("toc_key", score.significance(F.col("score"), F.col("semantic_score")))

    # ---- H / I --------------------------------------------------------------------------------------
    def manifest_ids(self) -> DataFrame:
        return (self.old_docs.select("doc_id").unionByName(self.new_docs.select("doc_id")).distinct())

    def change_counts(self) -> DataFrame:
        if self.text_mode:  # the opcodes hold the counts, and their join holds every document
            none = F.lit(0).cast("bigint")
            return text_align.text_counts(self.old_lines, self.new_lines, self.autojunk, self.max_udf_blocks,
                                          self.small_range).select(
                "doc_id", *report.CHANGE_VALUES, none.alias("unknown"), none.alias("other"), "total_blocks")
        return report.change_counts(self.entries, self.manifest_ids())

    def stats_by_type(self) -> DataFrame:
        if self.text_mode:  # all blocks of a text are paragraphs
            return self.change_counts().filter("total_blocks > 0").select(
                "doc_id", F.lit("paragraph").alias("type"), *report.CHANGE_VALUES)
        return report.stats_by_type(self.changes)

    def toc(self, limit: int | None = report.TOC_LIMIT) -> DataFrame:
        return report.toc(self.analyzed, limit)

    def summary(self) -> DataFrame:
        return report.doc_summary(self.analyzed, self.manifest_ids())
