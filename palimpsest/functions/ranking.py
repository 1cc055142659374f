"""Row numbers and running sums inside groups that may be huge.

A window ``partitionBy(g).orderBy(o)`` runs each group in one task.  Here a group is cut into slices by a
*value* that never falls along the order (``floor(entry_idx / SLICE)``, say), so the cut is the same
however the rows are partitioned or sampled:

1. the window runs per ``(g, slice)``;
2. slice totals, one row a slice, become offsets through a window over the slices of a group;
3. the offsets join back on ``(g, slice)``, by which the rows are partitioned already.

There is no size switch: small groups have one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 50_000  # positions in a slice


def slice_of(position: Column | str, size: int = SLICE) -> Column:
    """Slice of a position that counts up from 0."""
    return F.floor((F.col(position) if isinstance(position, str) else position) / size)


def _named(df: DataFrame, slices: Sequence[tuple[Column, bool]]) -> tuple[DataFrame, list[str], list[Column]]:
    names = [f"_slice{i}" for i in range(len(slices))]
    df = df.withColumns({n: c for n, (c, _) in zip(names, slices)})
    return df, names, [F.col(n).asc() if up else F.col(n).desc() for n, (_, up) in zip(names, slices)]


def _with_offsets(local: DataFrame, totals: DataFrame, keys: list[str], names: list[str], order: list[Column]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *names, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, [*keys, *names])


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: Sequence[tuple[Column, bool]],
                out: str = "rank") -> DataFrame:
    """``row_number() over (partition by keys order by order)``.

    ``order`` is a total order inside a group; ``slices`` are ``(column, ascending)`` without nulls, by which
    the rows are ordered too, only coarser."""
    keys = list(keys)
    s, names, by = _named(df, slices)
    local = s.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))
    totals = s.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_t"))
    return (_with_offsets(local, totals, keys, names, by)
            .withColumn(out, (F.col("_local") + F.col("_off")).cast("int")).drop("_local", "_off", *names))


def running_sum_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: Sequence[tuple[Column, bool]],
                       value: str, out: str) -> DataFrame:
    """Exclusive running sum ``sum(value) over (partition by keys order by order rows unbounded
    preceding .. 1 preceding)`` (0 for the first row); ``slices`` as in ``rank_within``."""
    keys = list(keys)
    s, names, by = _named(df, slices)
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = s.groupBy(*keys, *names).agg(F.sum(value).alias("_t"))
    return (_with_offsets(local, totals, keys, names, by)
            .withColumn(out, F.col("_local") + F.col("_off")).drop("_local", "_off", *names))


def running_max_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: Sequence[tuple[Column, bool]],
                       values: dict[str, Column]) -> DataFrame:
    """Adds, for every ``name: value``, the exclusive running maximum of ``value`` (null for the first row);
    ``order`` and ``slices`` as in ``rank_within``."""
    keys = list(keys)
    s, names, by = _named(df, slices)
    s = s.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumns({f"_l{i}": F.max(f"_v{i}").over(inside) for i in range(len(values))})
    totals = s.groupBy(*keys, *names).agg(*[F.max(f"_v{i}").alias(f"_t{i}") for i in range(len(values))])
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *names, *[F.max(f"_t{i}").over(before).alias(f"_o{i}") for i in range(len(values))])
    joined = local.join(offsets, [*keys, *names])
    return joined.select(*df.columns, *[F.greatest(f"_l{i}", f"_o{i}").alias(name) for i, name in enumerate(values)])
