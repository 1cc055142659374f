"""Group the changed entries of each document into ``k`` clusters.

The reference fits one KMeans per comparison on text vectors of the changed entries, with
``k = max(2, min(10, n // 5))`` and nothing below three changes.  Here every document is one small
KMeans problem, and all of them run together as a distributed Lloyd iteration in long form:

* a text vector is the term-frequency vector of ``(new.text or old.text).strip()`` (G5), stored as
  ``(doc, idx, tok, w)`` rows;
* a centroid is kept as integer sums ``s`` and a count ``m``, so distances are two exact integers and one
  division, and near-ties do not depend on the order of sums or on the partitioning;
* assignment joins each point with the at most 10 centroids of its own document (a bounded
  partner set, never all pairs), dot products come from a join on ``(doc, tok)``;
* the update is a ``groupBy(doc, cluster, tok)`` sum.

Initial centroids are drawn one by one, a point's chance in proportion to its squared distance from the nearest
centroid drawn before it (``seeds``); the draws are hashes of ``(document, point, number)``, so reruns agree.  The
reference's own draws depend on its model vectors and are not reproduced.  Rounds go on until no assignment changes
(or an earlier state comes back), documents that have come to their end leave them; lineage is cut each round with a reliable checkpoint.
Output is long form ``(doc_id, cluster, idx)`` (``idx`` = position in the changed-only list).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_within, slice_of
from ..session import broadcast_if_small, cut_lineage, stored
from .semantics import text_for_vector, tokens

# ---- fixed values of the reference's clustering rule ------------------------------------------------
MIN_CHANGES = 3
MIN_K, MAX_K, PER_CLUSTER = 2, 10, 5
# -------------------------------------------------------------------------------------------------------


def cluster_k(n):
    """``max(2, min(10, n // 5))`` (only for ``n >= 3``)."""
    return F.greatest(F.lit(MIN_K), F.least(F.lit(MAX_K), F.floor(n / PER_CLUSTER)))


def text_points(changes: DataFrame) -> DataFrame:
    """Changed entries -> ``(doc_id, idx, k)`` with ``idx`` the position among changed entries.  They are stored, so the
    alignment they come from runs once, whatever reads them."""
    ch = stored(changes.filter(F.col("change") == "changed").select(
        "doc_id", "entry_idx", text_for_vector(F.col("old_text"), F.col("new_text")).alias("vtext")), "changed")
    n = ch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_CHANGES)
    pts = rank_within(ch.join(n, "doc_id"), ["doc_id"], [F.col("entry_idx")], [(slice_of("entry_idx"), True)], out="idx")
    return stored(pts.select("doc_id", (F.col("idx") - 1).alias("idx"), "vtext", "n",
                             cluster_k(F.col("n")).cast("int").alias("k")), "points")


def text_vectors(points: DataFrame) -> DataFrame:
    """``(doc_id, idx, tok, w)`` term counts."""
    toks = points.select("doc_id", "idx", F.explode(tokens(F.col("vtext"))).alias("tok"))
    return stored(toks.groupBy("doc_id", "idx", "tok").agg(F.count(F.lit(1)).alias("w")), "vectors")


def draw(number: int) -> Column:
    """A number in (0, 1) for each point, from the first 13 hexadecimal digits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string"), F.lit(str(number))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def seeds(points: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(doc_id, idx, cluster)``, the points that the clusters of each document start from.

    Every point holds its exact squared distance to the nearest seed so far; a round joins the new seeds' vectors on
    ``(doc, tok)``, lowers the distances, and draws the next seed of all documents by an exponential race: the least
    ``-ln(u) / distance`` wins, which picks a point in proportion to its distance.  Points that equal a seed
    are never drawn, so a document with fewer different vectors than ``k`` gets one cluster for each of them."""
    norm = vectors.groupBy("doc_id", "idx").agg(F.sum(F.col("w") * F.col("w")).alias("pp"))
    state = cut_lineage(points.select("doc_id", "idx", "k").join(norm, ["doc_id", "idx"], "left")
                        .withColumn("pp", F.coalesce("pp", F.lit(0).cast("bigint"))).withColumn("far", F.lit(None).cast("bigint")))
    most = state.agg(F.max("k")).first()[0] or 0          # at most MAX_K
    chosen = None
    for number in range(most):
        open_ = state.filter(F.col("k") > number).filter(F.col("far").isNull() | (F.col("far") > 0))
        race = -F.log(draw(number)) / F.coalesce("far", F.lit(1)).cast("double")
        won = cut_lineage(open_.groupBy("doc_id").agg(F.min(F.struct(race.alias("e"), "idx", "pp", "k")).alias("b"))
                          .select("doc_id", F.col("b.idx").alias("idx"), F.col("b.pp").alias("ss"), F.col("b.k").alias("k"),
                                  F.lit(number).alias("cluster")))
        part = won.select("doc_id", "idx", "cluster")
        chosen = part if chosen is None else chosen.unionByName(part)
        if number + 1 < most:
            # a document that has all its seeds needs no more distances
            goes_on = F.col("k") > number + 1
            more = won.filter(goes_on)
            seed = cut_lineage(vectors.join(broadcast_if_small(more.select("doc_id", "idx")), ["doc_id", "idx"])
                               .select("doc_id", "tok", F.col("w").alias("s")))
            dots = vectors.join(broadcast_if_small(seed), ["doc_id", "tok"]).groupBy("doc_id", "idx").agg(F.sum(F.col("w") * F.col("s")).alias("dot"))
            d = F.col("pp") + F.col("ss") - 2 * F.coalesce("dot", F.lit(0))
            state = cut_lineage(state.filter(goes_on).join(more.select("doc_id", "ss"), "doc_id", "left").join(dots, ["doc_id", "idx"], "left")
                                .select("doc_id", "idx", "k", "pp", F.least("far", d).alias("far")))
    return points.select("doc_id", "idx", F.lit(0).alias("cluster")).limit(0) if chosen is None else chosen


def kmeans(points: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per-document Lloyd iterations until nothing changes; returns ``(doc_id, idx, cluster)``.  ``vectors`` are stored.

    A document whose assignment a round leaves as it was has come to its end (a round depends on nothing else).  Once
    half of the points are in such documents, the next rounds go on without them; the state that may come back is that of
    all documents."""
    pts = cut_lineage(points.select("doc_id", "idx", "k"))
    vec = vectors
    start = cut_lineage(seeds(pts, vec))
    cent = cut_lineage(vec.join(broadcast_if_small(start), ["doc_id", "idx"]).select("doc_id", "cluster", "tok", F.col("w").alias("s")))
    sizes = cut_lineage(start.select("doc_id", "cluster", F.lit(1).cast("bigint").alias("m")))
    seen: set[tuple] = set()
    ended, n_ended, sum_ended, last = [], 0, 0, None
    marks = [F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "idx", "cluster").cast("decimal(38,0)"))]
    while True:
        norm = cent.groupBy("doc_id", "cluster").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
        dots = (vec.join(broadcast_if_small(cent), ["doc_id", "tok"]).groupBy("doc_id", "idx", "cluster")
                .agg(F.sum(F.col("w") * F.col("s")).alias("dot")))
        # squared distance less the point's own norm: (|s|^2 - 2 m (p.s)) / m^2; a text without tokens has dot 0
        d = (F.coalesce("ss", F.lit(0)) - 2 * F.col("m") * F.coalesce("dot", F.lit(0))).cast("double") / (F.col("m") * F.col("m"))
        best = (pts.join(sizes, "doc_id").join(norm, ["doc_id", "cluster"], "left")
                .join(dots, ["doc_id", "idx", "cluster"], "left")
                .groupBy("doc_id", "idx").agg(F.min(F.struct(d.alias("d"), "cluster")).alias("b")))
        assign = cut_lineage(best.select("doc_id", "idx", F.col("b.cluster").alias("cluster")))
        n, total = assign.agg(*marks).first()
        state = (n_ended + n, sum_ended + (total or 0))
        if state in seen:
            return reduce(DataFrame.unionByName, ended, assign)
        seen.add(state)
        if last is not None:
            pairs = assign.join(last.withColumnRenamed("cluster", "_was"), ["doc_id", "idx"])
            moved = broadcast_if_small(cut_lineage(
                pairs.filter(F.col("cluster") != F.col("_was")).select("doc_id").distinct()))
            done = assign.join(moved, "doc_id", "left_anti")
            n_done, total = done.agg(*marks).first()
            if 2 * n_done >= n:
                ended.append(cut_lineage(done))
                n_ended, sum_ended = n_ended + n_done, sum_ended + (total or 0)
                pts, assign, sizes, cent = (cut_lineage(x.join(moved, "doc_id", "left_semi")) for x in (pts, assign, sizes, cent))
                vec = stored(vec.join(moved, "doc_id", "left_semi"), "vectors")
        last = assign
        now = assign.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("m"))
        sums = vec.join(broadcast_if_small(assign), ["doc_id", "idx"]).groupBy("doc_id", "cluster", "tok").agg(F.sum("w").alias("s"))
        # an emptied cluster keeps its centroid
        cent = cut_lineage(sums.unionByName(cent.join(now.select("doc_id", "cluster"), ["doc_id", "cluster"], "left_anti")))
        sizes = cut_lineage(now.unionByName(sizes.join(now.select("doc_id", "cluster"), ["doc_id", "cluster"], "left_anti")))


def cluster_changes(changes: DataFrame) -> DataFrame:
    """``(doc_id, cluster, idx)``; documents with fewer than 3 changed entries have no rows."""
    pts = text_points(changes)
    return kmeans(pts, text_vectors(pts)).select("doc_id", F.col("cluster").cast("int").alias("cluster"),
                                                 F.col("idx").cast("int").alias("idx"))
