"""D4/D6 for tables too large for one row.

A table is kept as slices of rows, ``(*keys, r, s, cells)``: slice ``s`` of row ``r`` holds the cells from
``s * CELLS`` on, at most ``CELLS`` of them, so neither a long table nor a wide row ever stands in one row or one
group.  Two snapshots meet in one full outer join on ``(*keys, r, s)``, which spreads a single huge table over all
tasks; inside a slice the cells are compared by ``zip_with``, as in the nested form.

Cells of both sides are counted per table (a partial aggregate).  Tables up to ``max_cells`` are nested again, first
slices to rows, then rows to the table; larger ones stay slices.  Both forms hold the same cells.

Rows of a table are numbered from 0 without gaps; a null row reads as ``[]`` and a null cell as ``""``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_within
from ..session import broadcast_if_small, cut_lineage
from .celldiff import cell_diff, explode_nested

CELLS = 512                # cells in a slice
MAX_TABLE_CELLS = 100_000  # cells of both sides; larger tables are not nested
_ROW = "array<string>"


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Sequence[tuple[Column, bool]],
                  cells: Column) -> DataFrame:
    """A2 for huge tables: ``(*keys, r, cells)``, rows numbered along ``order`` and then by the cells themselves;
    ``slices`` cut a table by value for the numbering (see ``functions.ranking``)."""
    rows = df.select(*keys, *[c for c in order if c not in keys], cells.cast(_ROW).alias("cells"))
    ranked = rank_within(rows, keys, [*[F.col(c) for c in order], F.col("cells")], slices, out="r")
    return ranked.select(*keys, (F.col("r") - 1).alias("r"), "cells")


def table_rows(tables: DataFrame, keys: Sequence[str], table_col: str = "table") -> DataFrame:
    """``ARRAY<ARRAY<STRING>>`` -> ``(*keys, r, cells)``."""
    return tables.select(*keys, F.posexplode(table_col).alias("r", "cells"))


def row_slices(rows: DataFrame, keys: Sequence[str], width: int = CELLS) -> DataFrame:
    """``(*keys, r, s, cells)``; a row without cells keeps one slice."""
    cells = F.coalesce("cells", F.array().cast(_ROW))
    last = F.greatest(F.ceil(F.size(cells) / width) - 1, F.lit(0)).cast("int")
    cut = rows.select(*keys, "r", cells.alias("cells"), F.explode(F.sequence(F.lit(0), last)).alias("s"))
    return cut.select(*keys, "r", "s", F.slice("cells", F.col("s") * width + 1, width).alias("cells"))


def sliced_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compares two tables of slices: ``(*keys, r, s, cells ARRAY<STRUCT>)``."""
    side = lambda df, name: df.withColumnRenamed("cells", name)
    both = side(old, "_old").join(side(new, "_new"), [*keys, "r", "s"], "full_outer")
    empty = F.array().cast(_ROW)
    return both.select(*keys, "r", "s", F.zip_with(F.coalesce("_old", empty), F.coalesce("_new", empty), cell_diff)
                       .alias("cells"))


def flat(diff: DataFrame, keys: Sequence[str], width: int = CELLS) -> DataFrame:
    """Slices of a diff in long form, as ``celldiff.explode_nested`` gives it."""
    cells = diff.select(*keys, "r", "s", F.posexplode("cells").alias("_at", "cell"))
    return cells.select(*keys, "r", (F.col("s") * width + F.col("_at")).alias("c"), F.col("cell.type").alias("cell_type"),
                        F.col("cell.text").alias("text"), F.col("cell.old").alias("old"), F.col("cell.new").alias("new"))


def nested(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slices back to ``(*keys, table_changes)``; only for tables that fit one row."""
    in_order = lambda at, value: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])
    rows = diff.groupBy(*keys, "r").agg(F.flatten(in_order("s", "cells")).alias("row"))
    return rows.groupBy(*keys).agg(in_order("r", "row").alias("table_changes"))


def large_tables(old_rows: DataFrame, new_rows: DataFrame, keys: Sequence[str], max_cells: int = MAX_TABLE_CELLS) -> DataFrame:
    """Keys of the tables with more than ``max_cells`` cells on both sides together; an empty row counts as one."""
    n = F.greatest(F.size(F.coalesce("cells", F.array().cast(_ROW))), F.lit(1)).cast("bigint").alias("_n")
    counted = old_rows.select(*keys, n).unionByName(new_rows.select(*keys, n)).groupBy(*keys).agg(F.sum("_n").alias("_n"))
    return counted.filter(F.col("_n") > max_cells).select(*keys)


def table_changes(old_rows: DataFrame, new_rows: DataFrame, keys: Sequence[str], max_cells: int = MAX_TABLE_CELLS,
                  width: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """D6 by size: ``(*keys, table_changes)`` of tables up to ``max_cells``, and the slices of the others' diffs."""
    keys = list(keys)
    big = broadcast_if_small(cut_lineage(large_tables(old_rows, new_rows, keys, max_cells)))
    slices = [row_slices(df, keys, width) for df in (old_rows, new_rows)]
    small = sliced_diff(*[s.join(big, keys, "left_anti") for s in slices], keys)
    large = sliced_diff(*[s.join(big, keys, "left_semi") for s in slices], keys)
    return nested(small, keys), large


def all_cells(old_rows: DataFrame, new_rows: DataFrame, keys: Sequence[str], max_cells: int = MAX_TABLE_CELLS,
              width: int = CELLS) -> DataFrame:
    """Both forms in long form: ``(*keys, r, c, cell_type, text, old, new)``."""
    small, large = table_changes(old_rows, new_rows, keys, max_cells, width)
    return explode_nested(small, keys).unionByName(flat(large, keys, width))
