"""C2 route 2: ordered alignment of oversized documents without collecting them.

The same matching blocks as ``difflib.SequenceMatcher(None, a, b)`` (``autojunk`` included), found by
joins and aggregates over all oversized documents at once, in rounds over *active ranges*
``(doc, alo, ahi, blo, bhi)`` (disjoint; ``rid = alo`` identifies a range inside its document).

**Window ids.**  Once, before the rounds, every window of 1, 2, 4, ... blocks that stands on both sides of
its document gets an id: a window of twice the length is the pair of its halves' ids, and the pair's id is the smallest
place where it stands (exact, no hash of ids).  Windows that only one side has are dropped, so no longer
window over them is built, and a document's levels end where all its shared windows are unique or none is shared.  Every level is one self-join on places and one
aggregation, linear in the blocks; equal blocks are never paired, so a line repeated 100,000 times on both sides
costs what any other lines do.  A window may start a match when none of its keys is *popular* in ``b`` (more than
``len(b)//100 + 1`` occurrences once ``len(b) >= 200``), as difflib's autojunk has it.

**A round.**  One aggregation over the windows inside the ranges counts both sides' windows by id.

* If at some level all shared windows of a range are unique on either side, they are a one-to-one map, and its
  diagonals are *all* common runs of that length or more.  A run that is in order with every other run (it begins
  after all runs before it end, and ends before all runs after it begin, on both sides) is bound to be chosen by
  the recursion: whatever longer run is chosen first, this one lies whole in the part that is left, and the recursion
  comes to it before any shorter run.  All such runs, and the longest (which the recursion chooses first), are
  committed at once.
* Otherwise the longest common run is found by lengthening: from the longest shared power of two, ever
  smaller powers are added as long as some pair of overlapping windows is shared; then its first place in ``a`` and,
  for that, in ``b``.
* Where keys are popular, runs are extended through any equal blocks by the same window ids, from the longest window
  down; a range without seeds extends from ``(alo, blo)``.  Order is then judged on the extended runs.  Documents without
  popular keys take no part in that.

Ranges split at the committed runs; ranges with one empty side or without a run become gaps, and so does what is left of
a range whose shared blocks were all in committed runs.  Segments, ranges and
the windows of every round are appended to tables under the checkpoint folder, partitioned by round, and read from there,
so neither the plan nor the lineage grows with the rounds.  Ranges of at most ``SMALL_RANGE`` blocks leave the loop
and are finished in one Arrow pass at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import types as T

from ..functions.keys import with_keys
from ..functions.ranking import SLICE, running_max_within, running_sum_within, slice_of
from ..session import broadcast_if_small, cut_lineage, ensure_checkpoint_dir

OPCODE_COLS = ["doc_id", "tag", "i1", "i2", "j1", "j2", "base"]


def _segments_to_opcodes(segments: DataFrame) -> DataFrame:
    """Segments ``(doc_id, i, j, lo, ln, is_match)`` in document order -> opcodes with ``base`` (the
    running entry count, in slices of old positions, so no document is one task)."""
    width = F.when(F.col("is_match"), F.col("lo")).otherwise(F.greatest("lo", "ln"))
    tag = (F.when(F.col("is_match"), "equal").when((F.col("lo") > 0) & (F.col("ln") > 0), "replace")
           .when(F.col("lo") > 0, "delete").otherwise("insert"))
    seg = segments.withColumn("w", width)
    seg = running_sum_within(seg, ["doc_id"], [F.col("i"), F.col("j")], [(slice_of("i"), True)], "w", "base")
    return seg.select(
        "doc_id", tag.alias("tag"), F.col("i").cast("int").alias("i1"), (F.col("i") + F.col("lo")).cast("int").alias("i2"),
        F.col("j").cast("int").alias("j1"), (F.col("j") + F.col("ln")).cast("int").alias("j2"),
        F.col("base").cast("int").alias("base"))


# Ranges with at most this many blocks (both sides) leave the loop and are finished in one Arrow pass at the end.
SMALL_RANGE = 4_000

RANGE_SEG_TYPE = T.ArrayType(T.StructType([
    T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("lo", T.LongType()),
    T.StructField("ln", T.LongType()), T.StructField("is_match", T.BooleanType())]))


def range_segments(alo: int, blo: int, a: list, b: list, b_seed: list) -> list[dict]:
    """Matches and gaps of one bounded range, identical to the whole-document recursion: difflib on the
    range with its seed table limited to keys that are not popular in the *whole* new side (``b_seed``
    carries that global flag), which is exactly what the loop does for big ranges."""
    sm = SequenceMatcher(None, a, b, autojunk=False)
    for key, seed in zip(b, b_seed):
        if not seed:
            sm.b2j.pop(key, None)
    out = []
    for tag, i1, i2, j1, j2 in sm.get_opcodes():
        out.append({"i": alo + i1, "j": blo + j1, "lo": i2 - i1, "ln": j2 - j1, "is_match": tag == "equal"})
    return out


@F.pandas_udf(RANGE_SEG_TYPE)
def _range_segments_udf(alo: pd.Series, blo: pd.Series, items: pd.Series) -> pd.Series:
    res = []
    for x0, y0, its in zip(alo, blo, items):
        rows = sorted((r["side"], r["pos"], r["key"], r["seed"]) for r in its)
        a = [k for side, _, k, _ in rows if side == "a"]
        b = [k for side, _, k, _ in rows if side == "b"]
        bs = [sd for side, _, _, sd in rows if side == "b"]
        res.append(range_segments(int(x0), int(y0), a, b, bs))
    return pd.Series(res)


class RoundStore:
    """Append-only tables of a run, partitioned by round, in a new folder beside the checkpoints."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/frontier-{uuid.uuid4().hex}"
        self.schemas: dict[str, T.StructType] = {}

    def put(self, name: str, number: int, df: DataFrame) -> DataFrame:
        """Writes a round of a table and gives it back as read."""
        path = f"{self.folder}/{name}/round={number}"
        self.schemas[name] = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, name: str) -> DataFrame:
        """All rounds of a table, with their number in ``round``."""
        schema = T.StructType([*self.schemas[name].fields, T.StructField("round", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def _seeded(blocks: DataFrame, docs: DataFrame, autojunk: bool) -> DataFrame:
    """Blocks of both sides with ``seed``: the key may be part of a match's start (difflib's b2j after autojunk)."""
    if not autojunk:
        return blocks.withColumn("seed", F.lit(True))
    long = docs.filter("n_new >= 200").select("doc_id", "n_new")
    often = (blocks.filter("side = 'b'").join(broadcast_if_small(long.select("doc_id").distinct()), "doc_id", "left_semi")
             .groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).join(long, "doc_id")
             .filter(F.col("c") > F.floor(F.col("n_new") / 100) + 1))
    often = broadcast_if_small(cut_lineage(often.select("doc_id", "key", F.lit(True).alias("often"))))
    return blocks.join(often, ["doc_id", "key"], "left").select(*blocks.columns, F.col("often").isNull().alias("seed"))


def _shared(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` that windows of both sides have, with the smallest place as ``id``, and ``single``: one window a side."""
    place = F.col("pos") * 2 + (F.col("side") == "b").cast("bigint")
    n = [F.sum((F.col("side") == side).cast("bigint")).alias(f"n{side}") for side in "ab"]
    return (windows.groupBy(*keys).agg(F.min(place).alias("id"), *n).filter("na > 0 AND nb > 0")
            .select(*keys, "id", (F.greatest("na", "nb") == 1).alias("single")))


def window_ids(store: RoundStore, blocks: DataFrame, loose: DataFrame) -> int:
    """Writes table ``levels``: round L has ``(doc_id, side, pos, id, seed, single)`` of every window of ``2^L`` blocks
    that both sides share; returns the number of levels.  No round looks beyond the first level at which all shared
    windows of a document are single (its ranges have some of these windows, so they are single there too), hence none is
    built, but for documents in ``loose``, whose runs are extended by windows of any key."""
    shared = _shared(blocks, ["doc_id", "key"])
    level = blocks.join(shared, ["doc_id", "key"]).select(
        "doc_id", "side", "pos", F.col("key").alias("id"), "seed", "single")
    level = store.put("levels", 0, level)
    n = 0
    while not level.isEmpty():  # windows double in length, so levels are the logarithm of the longest shared run
        n += 1
        open_docs = level.filter("NOT single").select("doc_id").unionByName(loose).distinct()
        level = level.join(broadcast_if_small(open_docs), "doc_id", "left_semi")
        ahead = level.select("doc_id", "side", (F.col("pos") - (1 << (n - 1))).alias("pos"), F.col("id").alias("y"),
                             F.col("seed").alias("seed_y"))
        pairs = level.join(ahead, ["doc_id", "side", "pos"]).select(
            "doc_id", "side", "pos", F.col("id").alias("x"), "y", (F.col("seed") & F.col("seed_y")).alias("seed"))
        level = store.put("levels", n, pairs.join(_shared(pairs, ["doc_id", "x", "y"]), ["doc_id", "x", "y"])
                          .select("doc_id", "side", "pos", "id", "seed", "single"))
    return n


def _places(ranges: DataFrame) -> DataFrame:
    """``(doc_id, side, pos, rid, stop)`` of every block place inside ranges (in two steps, so no array is long)."""
    out = None
    for side, lo, hi in (("a", "alo", "ahi"), ("b", "blo", "bhi")):
        cut = ranges.select("doc_id", "rid", F.col(hi).alias("stop"), F.explode(
            F.sequence(F.col(lo), F.col(hi) - 1, F.lit(SLICE).cast("bigint"))).alias("begin"))
        part = cut.select("doc_id", F.lit(side).alias("side"), F.explode(F.sequence(
            F.col("begin"), F.least(F.col("begin") + SLICE, F.col("stop")) - 1)).alias("pos"), "rid", "stop")
        out = part if out is None else out.unionByName(part)
    return out


RANGE = ["doc_id", "rid"]


def _ordered_runs(met: DataFrame, unique: DataFrame) -> DataFrame:
    """Runs ``(doc_id, rid, i, j, k, complete)`` of ranges whose shared windows of level ``level`` are unique on both sides;
    ``complete``: these are single blocks, so every shared block of the range is in a run."""
    pairs = met.join(unique, [*RANGE, "level"]).select(*RANGE, "i", "j", F.expr("shiftleft(1L, level)").alias("width"))
    before = pairs.select(*RANGE, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.lit(0).alias("begins"))
    flagged = pairs.join(before, [*RANGE, "i", "j"], "left").withColumn("begins", F.coalesce("begins", F.lit(1)))
    # a place of a has one window, so the windows of a run follow one another
    numbered = running_sum_within(flagged, RANGE, [F.col("i")], [(slice_of("i"), True)], "begins", "island")
    return (numbered.withColumn("island", F.col("island") + F.col("begins")).groupBy(*RANGE, "island")
            .agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count(F.lit(1)) + F.first("width") - 1).alias("k"),
                 (F.first("width") == 1).alias("complete")).drop("island"))


def _longest_run(windows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The longest common run ``(doc_id, rid, i, j, k)``, first in ``a``, then in ``b``, of every range; ``ranges`` has the
    level of the longest shared windows, ``windows`` the windows of that level."""
    w = cut_lineage(windows.join(ranges, [*RANGE, "level"]).select(*RANGE, "side", "pos", "id"))
    size = F.expr("shiftleft(1L, level)")
    lengths = cut_lineage(ranges.select(*RANGE, "level", size.alias("k")))
    most = lengths.agg(F.max("level")).first()[0]

    def overlapping(k: DataFrame) -> DataFrame:  # k: range, level, k (at most twice the windows' length)
        at = w.join(k.select(*RANGE, (F.col("k") - size).alias("off")), RANGE)
        ends = at.select(*RANGE, "side", (F.col("pos") - F.col("off")).alias("pos"), F.col("id").alias("y"))
        return at.select(*RANGE, "side", "pos", F.col("id").alias("x")).join(ends, [*RANGE, "side", "pos"])

    for m in range(most - 1, -1, -1):
        tried = lengths.filter(F.col("level") > m).withColumn("k", F.col("k") + (1 << m))
        stands = _shared(overlapping(tried), [*RANGE, "x", "y"]).select(*RANGE).distinct().withColumn("more", F.lit(1 << m))
        lengths = cut_lineage(lengths.join(stands, RANGE, "left").select(
            *RANGE, "level", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k")))
    first = (overlapping(lengths).groupBy(*RANGE, "x", "y")
             .agg(F.min(F.when(F.col("side") == "a", F.col("pos"))).alias("i"),
                  F.min(F.when(F.col("side") == "b", F.col("pos"))).alias("j"))
             .filter("i IS NOT NULL AND j IS NOT NULL")
             .groupBy(*RANGE).agg(F.min(F.struct("i", "j")).alias("m")))
    return first.join(lengths, RANGE).select(*RANGE, "m.i", "m.j", F.col("k"))


def _extended(runs: DataFrame, ranges: DataFrame, levels: DataFrame, top: int) -> DataFrame:
    """Runs lengthened on both sides through equal blocks of any key, inside their ranges.  ``s`` is the seeds' order:
    length, then smallest ``i``, then smallest ``j``."""
    order = F.struct(F.col("k").alias("len"), (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))
    r = runs.join(ranges.select(*RANGE, "alo", "ahi", "blo", "bhi"), RANGE).withColumn("s", order)
    for forward in (True, False):
        for n in [0, *range(top - 1, -1, -1)]:  # one block first: most runs end there
            h = 1 << n
            i = F.col("i") + F.col("k") if forward else F.col("i") - h
            j = F.col("j") + F.col("k") if forward else F.col("j") - h
            fits = ((i + h <= F.col("ahi")) & (j + h <= F.col("bhi"))) if forward else ((i >= F.col("alo")) & (j >= F.col("blo")))
            at = levels.filter(F.col("round") == n)
            a = at.filter("side = 'a'").select("doc_id", F.col("pos").alias("ai"), F.col("id").alias("ida"))
            b = at.filter("side = 'b'").select("doc_id", F.col("pos").alias("bj"), F.col("id").alias("idb"))
            found = (r.withColumn("ai", F.when(fits, i)).withColumn("bj", F.when(fits, j))
                     .join(a, ["doc_id", "ai"], "left").join(b, ["doc_id", "bj"], "left")
                     .withColumn("grew", F.coalesce(F.col("ida") == F.col("idb"), F.lit(False))))
            step = F.when(F.col("grew"), F.lit(h)).otherwise(F.lit(0))
            back = F.lit(0) if forward else step
            r = cut_lineage(found.select(*RANGE, "alo", "ahi", "blo", "bhi", "s", "grew", (F.col("i") - back).alias("i"),
                                         (F.col("j") - back).alias("j"), (F.col("k") + step).alias("k")))
            if n == 0 and r.filter("grew").isEmpty():
                break
    return r.filter("k > 0").groupBy(*RANGE, "i", "j", "k").agg(F.max("s").alias("s"))


def _committed(runs: DataFrame) -> DataFrame:
    """Of ``runs(doc_id, rid, i, j, k, s, complete)`` those in order with all others of their range, and the first by ``s``,
    with the ends ``pa, pb`` of the run before (null for a range's first) and the number of its range's runs."""
    slices = [(slice_of("i"), True)]
    back = [(slice_of("i"), False)]
    r = running_max_within(runs, RANGE, [F.col("i"), F.col("j")], slices,
                           {"a_before": F.col("i") + F.col("k"), "b_before": F.col("j") + F.col("k")})
    r = running_max_within(r, RANGE, [F.col("i").desc(), F.col("j").desc()], back,
                           {"a_after": -F.col("i"), "b_after": -F.col("j")})
    best = runs.groupBy(*RANGE).agg(F.max(F.struct("s", "i", "j", "k")).alias("best"), F.count(F.lit(1)).alias("n_runs"))
    true = F.lit(True)
    alone = (F.coalesce(F.col("a_before") <= F.col("i"), true) & F.coalesce(F.col("b_before") <= F.col("j"), true)
             & F.coalesce(-F.col("a_after") >= F.col("i") + F.col("k"), true)
             & F.coalesce(-F.col("b_after") >= F.col("j") + F.col("k"), true))
    first = (F.col("best.i") == F.col("i")) & (F.col("best.j") == F.col("j")) & (F.col("best.k") == F.col("k"))
    chosen = r.join(best, RANGE).filter(alone | first).select(*RANGE, "i", "j", "k", "complete", "n_runs")
    return running_max_within(chosen, RANGE, [F.col("i")], slices,
                              {"pa": F.col("i") + F.col("k"), "pb": F.col("j") + F.col("k")})


def _gap(lo: str, ahi: str, blo: str, bhi: str) -> list:
    return [F.col(lo).alias("i"), F.col(blo).alias("j"), (F.col(ahi) - F.col(lo)).alias("lo"),
            (F.col(bhi) - F.col(blo)).alias("ln")]


def _finish_small_ranges(small: DataFrame, blocks: DataFrame) -> DataFrame:
    """One Arrow pass over all small ranges: their blocks are grouped per range (bounded by
    ``SMALL_RANGE``) and aligned by ``range_segments``."""
    inside = blocks.join(_places(small), ["doc_id", "side", "pos"])
    g = inside.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("side", "pos", "key", "seed")).alias("items"))
    g = g.join(small.select("doc_id", "rid", "alo", "blo"), ["doc_id", "rid"])
    segs = g.select("doc_id", F.explode(_range_segments_udf.asNondeterministic()(
        F.col("alo"), F.col("blo"), F.col("items"))).alias("s"))
    return segs.select("doc_id", "s.*")


def frontier_segments(docs: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame,
                      autojunk: bool = True, small_range: int | None = None) -> DataFrame:
    """Matches and gaps ``(doc_id, i, j, lo, ln, is_match)`` of every document in ``docs``
    (``doc_id, n_old, n_new``)."""
    small_range = SMALL_RANGE if small_range is None else small_range
    store = RoundStore(docs.sparkSession)
    zero = F.lit(0).cast("bigint")
    ids = store.put("docs", 0, docs.select("doc_id", F.col("n_old").cast("bigint"), F.col("n_new").cast("bigint"))
                    .filter(F.col("n_old") + F.col("n_new") > 0))
    both = ids.filter((F.col("n_old") > 0) & (F.col("n_new") > 0))
    paired = broadcast_if_small(both.select("doc_id").distinct())
    sides = [with_keys(df).join(paired, "doc_id", "left_semi").select(
        "doc_id", F.lit(side).alias("side"), F.col("block_pos").cast("bigint").alias("pos"), F.col("key_hash").alias("key"))
        for side, df in (("a", old_blocks), ("b", new_blocks))]
    blocks = store.put("blocks", 0, _seeded(sides[0].unionByName(sides[1]), both, autojunk))
    store.put("segments", 0, ids.filter((F.col("n_old") == 0) | (F.col("n_new") == 0)).select(
        "doc_id", zero.alias("i"), zero.alias("j"), F.col("n_old").alias("lo"), F.col("n_new").alias("ln"),
        F.lit(False).alias("is_match")))
    small = (F.col("ahi") - F.col("alo") + F.col("bhi") - F.col("blo")) <= small_range
    ranges = store.put("ranges", 0, both.select(
        "doc_id", zero.alias("rid"), zero.alias("alo"), F.col("n_old").alias("ahi"), zero.alias("blo"),
        F.col("n_new").alias("bhi")).withColumn("small", small)).filter("NOT small")
    number = 0
    if not ranges.isEmpty():
        going = blocks.join(broadcast_if_small(ranges.select("doc_id").distinct()), "doc_id", "left_semi")
        loose = broadcast_if_small(cut_lineage(going.filter("NOT seed").select("doc_id").distinct()))
        any_loose = not loose.isEmpty()
        top = window_ids(store, going, loose)
        levels = store.all("levels")
        windows = levels.filter("seed").select(
            "doc_id", zero.alias("rid"), "side", "pos", F.col("round").alias("level"), "id")
    while not ranges.isEmpty():  # every round cuts a run out of a range or closes it, so ranges run out
        number += 1
        a, b = F.col("side") == "a", F.col("side") == "b"
        met = store.put("met", number, windows.groupBy(*RANGE, "level", "id").agg(
            F.sum(a.cast("bigint")).alias("na"), F.sum(b.cast("bigint")).alias("nb"),
            F.min(F.when(a, F.col("pos"))).alias("i"), F.min(F.when(b, F.col("pos"))).alias("j"))
            .filter("na > 0 AND nb > 0"))
        kinds = store.put("kinds", number, met.groupBy(*RANGE, "level").agg(F.max(F.greatest("na", "nb")).alias("most"))
                          .groupBy(*RANGE).agg(F.min(F.when(F.col("most") == 1, F.col("level"))).alias("unique"),
                                               F.max("level").alias("longest")))
        runs = _ordered_runs(met, kinds.filter("unique IS NOT NULL").select(*RANGE, F.col("unique").alias("level")))
        repeated = kinds.filter("unique IS NULL").select(*RANGE, F.col("longest").alias("level"))
        if not repeated.isEmpty():
            runs = runs.unionByName(_longest_run(windows, repeated).withColumn("complete", F.lit(False)))
        if any_loose:
            runs = store.put("found", number, runs)
        order = F.struct(F.col("k").alias("len"), (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))
        ordered = runs.withColumn("s", order)
        if any_loose:  # only where keys are popular can a run go on beyond its windows
            bare = ranges.join(kinds, RANGE, "left_anti").select(
                *RANGE, F.col("alo").alias("i"), F.col("blo").alias("j"), zero.alias("k"))
            seeds = runs.drop("complete").unionByName(bare).join(loose, "doc_id", "left_semi")
            extended = _extended(seeds, ranges, levels.join(loose, "doc_id", "left_semi"), top)
            ordered = ordered.join(loose, "doc_id", "left_anti").unionByName(extended.withColumn("complete", F.lit(False)))
        chosen = store.put("chosen", number, _committed(store.put("runs", number, ordered)))
        bounds = ranges.select(*RANGE, "alo", "ahi", "blo", "bhi")
        # a range's runs are all chosen and hold all shared blocks: nothing is shared between them
        more = F.max(~F.col("complete")) | (F.max("n_runs") > F.count(F.lit(1)))
        ends = chosen.groupBy(*RANGE).agg(F.max(F.col("i") + F.col("k")).alias("ea"), F.max(F.col("j") + F.col("k")).alias("eb"),
                                          more.alias("hit"))
        ended = bounds.join(ends, RANGE, "left")
        left = chosen.join(ended, RANGE).select(
            "doc_id", F.coalesce("pa", "alo").alias("alo"), F.col("i").alias("ahi"), F.coalesce("pb", "blo").alias("blo"),
            F.col("j").alias("bhi"), "hit")
        last = ended.select("doc_id", F.coalesce("ea", "alo").alias("alo"), "ahi", F.coalesce("eb", "blo").alias("blo"), "bhi",
                            F.coalesce("hit", F.lit(False)).alias("hit"))
        parts = store.put("parts", number, left.unionByName(last).filter((F.col("alo") < F.col("ahi")) | (F.col("blo") < F.col("bhi"))))
        goes_on = F.col("hit") & (F.col("alo") < F.col("ahi")) & (F.col("blo") < F.col("bhi"))
        matches = chosen.select("doc_id", "i", "j", F.col("k").alias("lo"), F.col("k").alias("ln"), F.lit(True).alias("is_match"))
        store.put("segments", number, matches.unionByName(
            parts.filter(~goes_on).select("doc_id", *_gap("alo", "ahi", "blo", "bhi"), F.lit(False).alias("is_match"))))
        ranges = store.put("ranges", number, parts.filter(goes_on).select(
            "doc_id", F.col("alo").alias("rid"), "alo", "ahi", "blo", "bhi").withColumn("small", small)).filter("NOT small")
        inside = windows.drop("rid").join(broadcast_if_small(ranges.select("doc_id").distinct()), "doc_id", "left_semi")
        windows = store.put("windows", number, inside.join(_places(ranges), ["doc_id", "side", "pos"])
                            .filter(F.expr("pos + shiftleft(1L, level) <= stop"))
                            .select(*RANGE, "side", "pos", "level", "id"))
    out = store.all("segments").drop("round")
    if small_range > 0:  # no range is empty
        out = out.unionByName(_finish_small_ranges(store.all("ranges").filter("small").drop("round"), blocks))
    return out


def frontier_opcodes(docs: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame,
                     autojunk: bool = True, small_range: int | None = None) -> DataFrame:
    """Opcodes ``(doc_id, tag, i1, i2, j1, j2, base)`` of oversized documents.

    ``docs`` has ``doc_id, n_old, n_new`` and optionally ``same`` (identical documents take one
    ``equal`` opcode without the loop)."""
    spark = docs.sparkSession
    if docs.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id bigint, tag string, i1 int, i2 int, j1 int, j2 int, base int")
    if "same" in docs.columns:
        same = docs.filter(F.col("same") & (F.col("n_old") > 0))
        rest = docs.filter(~F.col("same"))
    else:
        same = docs.limit(0)
        rest = docs
    eq = same.select("doc_id", F.lit("equal").alias("tag"), F.lit(0).alias("i1"), F.col("n_old").cast("int").alias("i2"),
                     F.lit(0).alias("j1"), F.col("n_new").cast("int").alias("j2"), F.lit(0).alias("base"))
    seg = frontier_segments(rest, old_blocks, new_blocks, autojunk, small_range)
    return eq.unionByName(_segments_to_opcodes(seg))
