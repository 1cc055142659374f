"""B7 without trust in hashes: block keys numbered by an exact dictionary of each document.

The distinct keys of both versions of a document get dense ids from 1, in the order of ``(hash, key)``, so two blocks
have one id exactly when their keys are equal, whatever the hash does.  Ids take the place of ``key_hash``; every
alignment route uses them as they are.  Numbering is cut by the hash's first byte (``functions.ranking``), so the
dictionary of a huge document is no single task's work.

The keys' texts move once, to be told apart: the distinct keys of every hash are counted.  Where a hash has one key, the
hash names it, and blocks get their ids by a join on the hash alone; only the keys of hashes with several are numbered
and joined by their texts.  The numbered blocks are stored, so no caller joins them again; it is chosen by the caller.
``collisions`` is the audit for those who stay with hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import block_key, key_hash
from ..functions.ranking import running_sum_within
from ..session import broadcast_if_small, stored


def _keyed(blocks: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    return blocks.withColumn("block_key", block_key()).withColumn("_hash", hash_of(F.col("block_key")))


def _distinct(old: DataFrame, new: DataFrame) -> DataFrame:
    part = ["doc_id", "_hash", "block_key"]
    return old.select(*part).unionByName(new.select(*part)).distinct()


def exact_keys(old_blocks: DataFrame, new_blocks: DataFrame,
               hash_of: Callable[[Column], Column] = key_hash) -> tuple[DataFrame, DataFrame]:
    """Both snapshots' blocks with ``key_hash`` = the dictionary's id of their key."""
    old, new = _keyed(old_blocks, hash_of), _keyed(new_blocks, hash_of)
    per_hash = stored(_distinct(old, new).groupBy("doc_id", "_hash").agg(F.count(F.lit(1)).alias("_n")), "exact-hashes")
    first = stored(running_sum_within(per_hash, ["doc_id"], [F.col("_hash")], [(F.shiftright("_hash", 56), True)],
                                      "_n", "_before"), "exact-ids")
    several = per_hash.filter("_n > 1").select("doc_id", "_hash")
    places = None
    if not several.isEmpty():
        few = broadcast_if_small(several)
        met = [side.join(few, ["doc_id", "_hash"], "left_semi") for side in (old, new)]
        order = Window.partitionBy("doc_id", "_hash").orderBy("_key")
        places = broadcast_if_small(stored(
            _distinct(*met).withColumnRenamed("block_key", "_key").withColumn("_place", F.row_number().over(order)), "exact-places"))

    def numbered(side: DataFrame) -> DataFrame:
        at = side.drop("key_hash").join(first, ["doc_id", "_hash"])
        if places is not None:
            at = at.withColumn("_key", F.when(F.col("_n") > 1, F.col("block_key"))).join(
                places, ["doc_id", "_hash", "_key"], "left")
        place = F.lit(1) if places is None else F.coalesce("_place", F.lit(1))
        return stored(at.withColumn("key_hash", (F.col("_before") + place).cast("bigint"))
                      .select(*side.drop("key_hash", "_hash", "block_key").columns, "key_hash"), "exact-blocks")
    return numbered(old), numbered(new)


def keys_per_hash(old_blocks: DataFrame, new_blocks: DataFrame,
                  hash_of: Callable[[Column], Column] = key_hash) -> DataFrame:
    """``(doc_id, key_hash, n_keys)``: how many keys of a document a hash stands for."""
    found = _distinct(_keyed(old_blocks, hash_of), _keyed(new_blocks, hash_of))
    return found.groupBy("doc_id", F.col("_hash").alias("key_hash")).agg(F.count(F.lit(1)).alias("n_keys"))


def collisions(old_blocks: DataFrame, new_blocks: DataFrame,
               hash_of: Callable[[Column], Column] = key_hash) -> DataFrame:
    """The hashes that stand for several keys of one document."""
    return keys_per_hash(old_blocks, new_blocks, hash_of).filter(F.col("n_keys") > 1)
