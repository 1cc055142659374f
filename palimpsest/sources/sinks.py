"""Writing comparison results.

* ``write_changes_json`` (A11): one JSON object per entry (JSON Lines) with both sides' whole payload and all that
  was computed for it, UTF-8 with non-ASCII kept; null fields are left out, as keys are absent in the
  reference's entry dictionaries.
* ``write_report_rows`` (A12): what the report shows per entry, as Parquet partitioned by ``change``
  (so a reader of one change kind prunes the others).

Both are executor-side writers; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import PAYLOAD_FIELDS
from ..functions.text import score_band, short_fingerprint

ENTRY_COLUMNS = ["doc_id", "entry_idx", "change", "type", "old_pos", "new_pos",
                 *[f"{side}_{name}" for side in ("old", "new") for name, _ in PAYLOAD_FIELDS],
                 "inline_html", "table_changes", "score", "labels", "semantic_score", "change_type", "confidence"]


def ai_info_present(labels: Column, sem: Column, change_type: Column, conf: Column) -> Column:
    """Any of labels / semantic score / change type / confidence is present."""
    return (F.coalesce(F.size(labels) > 0, F.lit(False)) | sem.isNotNull()
            | F.coalesce(change_type != "", F.lit(False)) | conf.isNotNull())


def report_rows(analyzed: DataFrame) -> DataFrame:
    """The per-entry data of the report (A12 + E12-E15)."""
    text = F.coalesce(F.col("new_text"), F.col("old_text"))
    return analyzed.select(
        "doc_id", "entry_idx", "change", "type", "score", score_band(F.col("score")).alias("score_band"),
        "semantic_score", "change_type", "confidence",
        F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ", ").alias("labels"),
        ai_info_present(F.col("labels"), F.col("semantic_score"), F.col("change_type"), F.col("confidence"))
        .alias("ai_info"),
        short_fingerprint(F.coalesce(F.col("new_sha1"), F.col("old_sha1"))).alias("short_sha1"),
        text.alias("text"), F.when(F.col("change") == "changed", F.col("old_text")).alias("old_text"), "inline_html",
        *(["table_changes"] if "table_changes" in analyzed.columns else []))


def write_changes_json(changes: DataFrame, path: str) -> None:
    cols = [c for c in ENTRY_COLUMNS if c in changes.columns]
    changes.select(*cols).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_report_rows(analyzed: DataFrame, path: str) -> None:
    report_rows(analyzed).write.mode("overwrite").partitionBy("change").parquet(path)
