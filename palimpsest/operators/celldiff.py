"""Cell-level table diff.

Semantics: positional on ``(row, column)``; a missing row reads as ``[]`` and a missing cell as
``""``, so a missing cell against ``""`` is ``same``.  Not row-aligned: an inserted top row shifts
everything below it.

Two forms with one answer:

* ``nested_table_diff`` (D4): ``zip_with`` inside the row (no shuffle) -> the reference's nested
  ``ARRAY<ARRAY<STRUCT>>``; ``with_nested_markup`` puts the markup into its changed cells, ``cell_markup`` does so
  in long form.
* ``long_cell_diff`` (D5): cells in long form and a full outer join on ``(table, r, c)``; for tables
  too large for one row (whole-table snapshots keyed by a business key).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textdiff import blocks_markup, matching_blocks, with_text_diff

SHORT_CELLS = 64  # characters of both cells up to which a worker remembers their blocks
CELL_FIELDS = ("type", "text", "old", "new")


def cell_diff(old_cell: Column, new_cell: Column) -> Column:
    """D3 without markup: ``{type:'same', text}`` or ``{type:'changed', old, new}``."""
    o = F.coalesce(old_cell, F.lit(""))
    n = F.coalesce(new_cell, F.lit(""))
    same = o == n
    return F.struct(
        F.when(same, "same").otherwise("changed").alias("type"),
        F.when(same, o).alias("text"),
        F.when(~same, o).alias("old"),
        F.when(~same, n).alias("new"),
    )


def nested_table_diff(old_table: Column, new_table: Column) -> Column:
    """``zip_with`` pads the shorter side with nulls, which read as ``[]`` / ``""``."""
    empty_row = F.array().cast("array<string>")
    return F.zip_with(
        F.coalesce(old_table, F.array().cast("array<array<string>>")),
        F.coalesce(new_table, F.array().cast("array<array<string>>")),
        lambda o, n: F.zip_with(F.coalesce(o, empty_row), F.coalesce(n, empty_row), cell_diff))


def explode_nested(df: DataFrame, keys: Sequence[str], col: str = "table_changes") -> DataFrame:
    """Nested cell diffs -> long form ``(*keys, r, c, cell_type, text, old, new)``."""
    rows = df.select(*keys, F.posexplode(col).alias("r", "row"))
    cells = rows.select(*keys, "r", F.posexplode("row").alias("c", "cell"))
    return cells.select(*keys, "r", "c", F.col("cell.type").alias("cell_type"), F.col("cell.text").alias("text"),
                        F.col("cell.old").alias("old"), F.col("cell.new").alias("new"))


def long_cells(tables: DataFrame, keys: Sequence[str], table_col: str) -> DataFrame:
    """``ARRAY<ARRAY<STRING>>`` -> ``(*keys, r, c, v)``."""
    rows = tables.select(*keys, F.posexplode(table_col).alias("r", "row"))
    return rows.select(*keys, "r", F.posexplode("row").alias("c", "v"))


def long_cell_diff(old_cells: DataFrame, new_cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of long-form cells ``(*keys, c, v)``; missing -> ``""``."""
    j = old_cells.withColumnRenamed("v", "old_v").join(new_cells.withColumnRenamed("v", "new_v"),
                                                       list(keys), "full_outer")
    d = cell_diff(F.col("old_v"), F.col("new_v"))
    return j.select(*keys, d["type"].alias("cell_type"), d["text"].alias("text"),
                    d["old"].alias("old"), d["new"].alias("new"))


def snapshot_cell_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """D5 by business key: two snapshots of a table, rows paired on ``key``; cell ``c`` is the
    position of the column in ``columns``.  Output ``(k, c, cell_type, text, old, new)``."""
    both = (old.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"o{i}") for i, c in enumerate(columns)])
            .join(new.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"n{i}") for i, c in enumerate(columns)]),
                  "k", "full_outer"))
    cells = F.array(*[F.struct(F.lit(i).alias("c"), cell_diff(F.col(f"o{i}"), F.col(f"n{i}")).alias("d"))
                      for i in range(len(columns))])
    return both.select("k", F.inline(cells)).select(
        "k", "c", F.col("d.type").alias("cell_type"), F.col("d.text").alias("text"), F.col("d.old").alias("old"),
        F.col("d.new").alias("new"))


@lru_cache(maxsize=1 << 16)
def _short_blocks(old: str, new: str) -> list[tuple[int, int, int]]:
    return matching_blocks(old, new)


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` cut into lists as long as those of ``like``; null where they are."""
    lengths = like.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=like.is_null() if like.null_count else None)


def _cell_blocks(tables: pa.Array) -> pa.Array:
    """Matching blocks of every changed cell; nothing for cells that are the same."""
    rows = tables.flatten()
    cells = rows.flatten()
    old, new = (c.to_pylist() for c in cells.flatten())
    found, ends, same = [], [0], []
    for o, n in zip(old, new):
        same.append(o is None)
        if o is not None:
            found.extend(_short_blocks(o, n) if len(o) + len(n) <= SHORT_CELLS else matching_blocks(o, n))
        ends.append(len(found))
    a, b, n = (pa.array([m[i] for m in found], pa.int32()) for i in range(3))
    blocks = pa.StructArray.from_arrays([a, b, n], names=["a", "b", "n"])
    per_cell = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks, mask=pa.array(same, pa.bool_()))
    return _lists(tables, _lists(rows, per_cell))


def with_nested_markup(df: DataFrame, col: str = "table_changes") -> DataFrame:
    """D3/D4 whole: ``inline_html`` in every changed cell of a nested table diff (``col``; null stays null)."""
    texts = F.transform(F.col(col), lambda row: F.transform(row, lambda c: F.struct(c["old"].alias("old"), c["new"].alias("new"))))
    changed = F.exists(F.col(col), lambda row: F.exists(row, lambda c: c["type"] == "changed"))
    raw = f"_{col}_blocks"
    kernel = F.arrow_udf(_cell_blocks, "array<array<array<struct<a:int,b:int,n:int>>>>").asNondeterministic()
    d = df.withColumn(raw, kernel(F.when(changed, texts)))

    def cell(c, blocks):
        html = F.when(c["type"] == "changed", blocks_markup(blocks, c["old"], c["new"]))
        return F.struct(*[c[f].alias(f) for f in CELL_FIELDS], html.alias("inline_html"))
    none = F.lit(None).cast("array<struct<a:int,b:int,n:int>>")
    plain = F.transform(F.col(col), lambda row: F.transform(row, lambda c: cell(c, none)))
    marked = F.zip_with(F.col(col), F.col(raw), lambda row, blocks: F.zip_with(row, blocks, cell))
    return d.withColumn(col, F.when(changed, marked).otherwise(plain)).drop(raw)


def cell_markup(cells: DataFrame, autojunk: bool = True) -> DataFrame:
    """Adds ``inline_html`` to changed cells (the markup of D3) through the text kernel."""
    changed = F.col("cell_type") == "changed"
    d = with_text_diff(cells, F.when(changed, F.col("old")), F.when(changed, F.col("new")), "_cell", autojunk)
    return d.withColumn("inline_html", F.when(changed, F.col("_cell.inline_html"))).drop("_cell")
