"""A2: any DataFrame (a worksheet, a table snapshot) as ``table`` blocks.

Cells become strings (null -> ``""``, no stripping).  A table is kept only when some cell is a
non-empty string.  Rows are grouped per block with ``collect_list`` + ``array_sort`` on a row
number, which is a bounded group only when a table fits one block; for whole-table snapshots
use the long-form cell diff (``operators.celldiff.snapshot_cell_diff``) instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import conform_blocks


def cell_text(c: Column) -> Column:
    """``"" if v is None else str(v)`` for string-like inputs."""
    return F.coalesce(c.cast("string"), F.lit(""))


def table_blocks(df: DataFrame, doc_col: str, row_order: Sequence[str], cell_cols: Sequence[str],
                 block_pos: int | str = 0, sheet: str | Column | None = None) -> DataFrame:
    """One ``table`` block per ``doc_col`` value.

    ``row_order`` fixes the row order inside a table (must be a total order); ``cell_cols`` are the
    cells of each row, already formatted as the caller wants them shown."""
    row = F.struct(*[F.col(c) for c in row_order],
                   F.array(*[cell_text(F.col(c)) for c in cell_cols]).alias("cells"))
    grouped = df.groupBy(F.col(doc_col).alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    table = F.transform(F.col("rows"), lambda r: r["cells"])
    pos = F.col(block_pos) if isinstance(block_pos, str) else F.lit(block_pos)
    out = grouped.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        pos.cast("int").alias("block_pos"),
        F.lit("table").alias("type"),
        table.alias("table"),
        (sheet if isinstance(sheet, Column) else F.lit(sheet)).cast("string").alias("sheet"),
    )
    return conform_blocks(keep_nonempty_tables(out))


def keep_nonempty_tables(blocks: DataFrame) -> DataFrame:
    """Worksheet rule: skip a table unless some cell is a non-empty string."""
    return blocks.filter(F.exists(F.col("table"), lambda r: F.exists(r, lambda c: c != "")))
