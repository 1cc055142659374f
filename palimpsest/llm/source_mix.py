"""Operator 2, mixing sources to target weights: pivotal dependent rounding of copy counts.

A source of weight w gets ``target = min(cap * size, rate * w)`` words, with one ``rate`` for all sources
such that the targets add up to all sizes.  A document of its source starts with ``target / size``
copies: the whole copies are certain, the fraction is a probability.  Pivotal rounding settles the
fractions: two sides trade probability, keeping their expected words together, until one is 0 or 1.
Inside a bucket of about ``BUCKET_ROWS`` documents each document, from the largest down, trades with the
smaller ones together, which leaves at most one unsettled, a small one.  These residuals trade in pairs in
a reduction tree of ``FAN`` buckets a node, until a source has one left, which is settled by a last draw.
So the taken words of a source differ from its target by less than one (small) document.

Draws depend on the rows alone, so reruns agree.  A hot source has many buckets, and no group holds
more than a bucket; the texts are read once, to be measured, and never shuffled.

Defined cases: a null or empty text has size 0 and takes 0 words; null is a source of its own, last in
order; repeated rows are rounded one by one (equal rows may swap roles); a document may have a null
doc_id; an empty table gives an empty result; ``mix`` keeps extra columns whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage, free_name, in_small_batches

WEIGHTS = (5.0, 2.0, 1.0)  # by code point order of the source, repeating; null comes last
CAP = 3.0
BUCKET_ROWS = 2_000
FAN = 1_000


def _count(texts: pa.Array) -> pa.Array:
    return pa.array([len(t.encode().split()) if t else 0 for t in texts.to_pylist()], pa.int64())


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.arrow_udf(_count, "long")(text)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(source, size)`` of documents becomes ``(source, n, source_size, target)``.

    Ranks come from one sort of the source table: slices by range, numbered inside, moved on by the
    sizes of the slices before.  ``rate`` rises until no further source stops at its cap; each step is
    one aggregate row.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    per = cut_lineage(per.repartitionByRange(F.col("source").asc_nulls_last())
                      .withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.groupBy("slice").count().select(  # one row a slice
        "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    rank = F.row_number().over(inside) - 1 + F.col("shift")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = cut_lineage(per.join(F.broadcast(shift), "slice")
                      .select("source", "n", "source_size", weight.alias("weight")))
    whole = per.agg(F.sum("source_size")).first()[0] or 0
    rate, most = 0.0, F.col("source_size") * cap
    while True:
        full = F.col("weight") * rate > most
        row = per.agg(F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        left = whole - (row["full"] or 0.0)
        if not row["w"] or left / row["w"] <= rate * (1 + 1e-12):
            break
        rate = left / row["w"]
    return per.select("source", "n", "source_size", F.least(most, F.col("weight") * F.lit(rate)).alias("target"))


def _draw(*key) -> float:
    """A number in [0, 1) that depends on ``key`` alone."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(sizes: list[int], chances: list[float], key: tuple) -> list[float]:
    """Chances after trading: all 0 or 1 but for at most one (sizes are positive).

    A trade moves ``d`` words of chance from one document to the other, up or down with odds that keep
    both expectations.
    """
    out = list(chances)
    open_, eps = -1, 1e-9
    for i, a in enumerate(sizes):
        if not eps < out[i] < 1 - eps:
            out[i] = float(round(out[i]))
            continue
        if open_ < 0:
            open_ = i
            continue
        j, b = open_, sizes[open_]
        up = min(a * (1 - out[i]), b * out[j])
        down = min(a * out[i], b * (1 - out[j]))
        if _draw(*key, i) * (up + down) < down:
            out[i], out[j] = out[i] + up / a, out[j] - up / b
        else:
            out[i], out[j] = out[i] - down / a, out[j] + down / b
        left = []
        for k in (i, j):
            if eps < out[k] < 1 - eps:
                left.append(k)
            else:
                out[k] = float(round(out[k]))
        open_ = left[0] if left else -1
    return out


def _settle(level: int, last: bool):
    """Trades inside one ``(source, node)``; rows whose chance is 0 or 1 pass through."""
    def run(group: pa.Table) -> pa.Table:
        chance = group["chance"].to_numpy().copy()
        at = np.flatnonzero((chance > 0) & (chance < 1))
        if len(at):
            size = group["size"].to_numpy()
            at = at[np.lexsort((group["leaf"].to_numpy()[at], group["order"].to_numpy()[at], -size[at]))]
            key = (group["source"][0].as_py(), level, group["node"][0].as_py())
            done = pivot(size[at].tolist(), chance[at].tolist(), key)  # by falling size: what stays open is small
            chance[at] = [float(_draw(*key, "last") < c) if last and 0 < c < 1 else c for c in done]
        return group.set_column(group.column_names.index("chance"), "chance", pa.array(chance))
    return run


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    return cut_lineage(rows.groupBy("source", "node").applyInArrow(_settle(level, last), rows.schema))


def rounded(sized: DataFrame) -> DataFrame:
    """``sized(source, size, other columns...)`` gets ``source_size``, ``target`` and ``copies``."""
    sized = cut_lineage(sized)
    own = [c for c in sized.columns if c not in ("source", "size")]
    per = cut_lineage(targets(sized))
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    nodes = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = (sized.join(per.select(F.col("source").alias("s"), "n", "source_size", "target"),
                       F.col("source").eqNullSafe(F.col("s")))
            .select(*own, "source", "size", "source_size", "target", F.floor(ratio).alias("whole"),
                    (ratio - F.floor(ratio)).alias("chance"), F.xxhash64(F.lit("order"), *own, "size").alias("order"),
                    F.pmod(F.xxhash64(F.lit("node"), *own, "size"), nodes).alias("node")))
    first = _level(rows.withColumn("leaf", F.col("node")), 0, False)
    open_ = first.where("chance > 0 and chance < 1").select("source", "size", "order", "leaf", "node", "chance")
    most = per.agg(F.max(nodes)).first()[0] or 1
    level, settled = 0, None
    while True:  # nodes shrink FAN-fold a level
        level, most = level + 1, math.ceil(most / FAN)
        open_ = _level(open_.withColumn("node", F.floor(F.col("node") / FAN)), level, most == 1)
        done = open_.where("chance = 0 or chance = 1")
        settled = done if settled is None else settled.union(done)
        if most == 1:
            break
        open_ = open_.where("chance > 0 and chance < 1")
    last = settled.select(F.col("source").alias("s"), F.col("leaf").alias("l"), F.col("chance").alias("drawn"),
                          F.lit(True).alias("o"))
    unsettled = (F.col("chance") > 0) & (F.col("chance") < 1)  # one row at most of each (source, leaf)
    out = first.withColumn("u", unsettled).join(
        last, F.col("source").eqNullSafe(F.col("s")) & (F.col("leaf") == F.col("l")) & (F.col("u") == F.col("o")), "left")
    return out.select(*own, "source", "size", "source_size", "target",
                      (F.col("whole") + F.coalesce("drawn", "chance").cast("long")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (rows taken 0 times go).

    Decisions join back by two hashes of id, source and text.  Rows equal in all three share the copies
    that they got together: each the same number, the first ones one more for the remainder.
    """
    k1, k2 = free_name(docs, "_k1"), free_name(docs, "_k2")
    parts = [F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`")]
    marks = [F.lit(7).cast("int"), *[p.isNull() for p in parts], *parts]
    marked = in_small_batches(docs).withColumn(k1, F.xxhash64(*marks)).withColumn(k2, F.hash(*marks))
    taken = rounded(marked.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"),
                                  F.col(f"`{source}`").cast("string").alias("source"),
                                  n_words(F.col(f"`{text}`")).alias("size")))
    share = (taken.groupBy("k1", "k2").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n")).where("c > 0")
             .select(F.struct("*").alias("d")))
    d, nth = free_name(docs, "_d"), free_name(docs, "_nth")
    out = marked.join(share.withColumnRenamed("d", d), (F.col(k1) == F.col(f"{d}.k1")) & (F.col(k2) == F.col(f"{d}.k2")))
    out = out.withColumn(nth, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1)))
    copies = F.floor(F.col(f"{d}.c") / F.col(f"{d}.n")) + (F.col(nth) <= F.col(f"{d}.c") % F.col(f"{d}.n")).cast("long")
    return (out.withColumn(d, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
