"""C1 index: the block keys of a snapshot, written once, joined without a shuffle.

A snapshot's ``(doc_id, n, keys)`` rows (8 bytes a line) are written as a table bucketed and sorted by
``doc_id``.  Two snapshots with the same number of buckets are then paired bucket by bucket: a comparison
with any later version reads the old keys as they are and hashes only the new texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import text_doc_keys

BUCKETS = 64  # of a table; choose it so that a bucket's keys fit an executor's memory a few times over


def write_index(lines: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``(doc_id, lines)`` as ``table`` in the session's catalog; one file a bucket."""
    keys = text_doc_keys(lines).select("doc_id", "n", "keys")
    (keys.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("doc_id")
     .mode("overwrite").saveAsTable(table))


def indexed_status(spark: SparkSession, old_table: str, new_table: str) -> DataFrame:
    """``doc_status`` of two indexed snapshots: ``doc_id, in_old, in_new, n_old, n_new, status``."""
    side = lambda t, p: spark.table(t).select("doc_id", F.col("n").alias(f"n_{p}"), F.col("keys").alias(f"{p}_keys"),
                                              F.lit(True).alias(f"in_{p}"))
    j = side(old_table, "old").join(side(new_table, "new"), "doc_id", "full_outer")
    status = (F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "added")
              .when(F.col("old_keys") == F.col("new_keys"), "unchanged").otherwise("changed"))
    return j.select("doc_id", *[F.coalesce(f"in_{p}", F.lit(False)).alias(f"in_{p}") for p in ("old", "new")],
                    *[F.coalesce(f"n_{p}", F.lit(0)).cast("bigint").alias(f"n_{p}") for p in ("old", "new")],
                    status.alias("status"))
