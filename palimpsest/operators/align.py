"""Document pairing (C1, C9, A10) and ordered block alignment.

Plan per corpus pair:

1. per side, key every block (``key_hash``) and count blocks per document (partial aggregate);
2. full-outer join of the two manifests on ``doc_id`` -> document status;
3. documents whose two key sequences differ are aligned:
   * route 1 (``size <= max_udf_blocks``): the two ``ARRAY<BIGINT>`` key arrays of a document go through
     one Arrow UDF that returns opcodes; only 8-byte hashes cross the JVM/Python boundary, the
     parallel axis is the document;
   * route 2 (oversized documents): the distributed frontier loop of ``align_frontier`` (joins,
     windows and aggregates only, no Python, no per-document collection);
4. opcodes are expanded to one entry per reference result item (``explode(sequence(..))``) and joined
   back to the block payloads on ``(doc_id, position)``.

Identical documents, and documents present on one side only, get their opcode natively without
alignment.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import StorageLevel

from ..functions.keys import PAYLOAD_COLS, effective_type, with_keys
from ..session import broadcast_if_small, cut_lineage

OPCODE_TYPE = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("i1", T.IntegerType()),
    T.StructField("i2", T.IntegerType()),
    T.StructField("j1", T.IntegerType()),
    T.StructField("j2", T.IntegerType()),
    T.StructField("base", T.IntegerType()),
])
OPCODES_TYPE = T.ArrayType(OPCODE_TYPE)

# Documents with more blocks than this (both sides together) take the distributed route.
MAX_UDF_BLOCKS = 20_000


def opcodes_with_base(a, b, autojunk: bool = True) -> list[dict]:
    """Opcodes of ``SequenceMatcher(None, a, b)`` plus ``base``: the index of the opcode's first entry
    in the reference's result list (``equal`` yields ``i2-i1`` entries, any other tag
    ``max(i2-i1, j2-j1)``)."""
    sm = SequenceMatcher(None, a, b, autojunk=autojunk)
    out, base = [], 0
    for tag, i1, i2, j1, j2 in sm.get_opcodes():
        out.append({"tag": tag, "i1": i1, "i2": i2, "j1": j1, "j2": j2, "base": base})
        base += (i2 - i1) if tag == "equal" else max(i2 - i1, j2 - j1)
    return out


def _make_opcode_udf(autojunk: bool):
    @F.pandas_udf(OPCODES_TYPE)
    def block_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
        res = []
        for x, y in zip(a, b):
            xs = [] if x is None else x.tolist()
            ys = [] if y is None else y.tolist()
            res.append(opcodes_with_base(xs, ys, autojunk))
        return pd.Series(res)
    # non-deterministic: keeps Catalyst from copying the call into pushed-down filters
    return block_opcodes.asNondeterministic()


_UDFS: dict[bool, object] = {}


def opcode_udf(autojunk: bool = True):
    if autojunk not in _UDFS:
        _UDFS[autojunk] = _make_opcode_udf(autojunk)
    return _UDFS[autojunk]


def _one_opcode(tag: str, n_old: Column, n_new: Column) -> Column:
    return F.array(F.struct(F.lit(tag).alias("tag"), F.lit(0).alias("i1"), n_old.cast("int").alias("i2"),
                            F.lit(0).alias("j1"), n_new.cast("int").alias("j2"), F.lit(0).alias("base")))


def manifest(docs: DataFrame) -> DataFrame:
    """Presence of a document on a side: its ``doc_id`` (and ``parse_error`` when the source has it)."""
    cols = [F.col("doc_id").cast("bigint").alias("doc_id")]
    cols.append(F.col("parse_error").cast("boolean").alias("parse_error") if "parse_error" in docs.columns
                else F.lit(False).alias("parse_error"))
    return docs.select(*cols)


def document_keys(keyed_blocks: DataFrame) -> DataFrame:
    """``(doc_id, keys ARRAY<BIGINT>)`` in ``block_pos`` order; ``block_pos`` is dense and 0-based."""
    return (keyed_blocks.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("block_pos", "key_hash"))).alias("kv"))
            .select("doc_id", F.transform("kv", lambda x: x["key_hash"]).alias("keys")))


def text_doc_keys(lines: DataFrame, lines_col: str = "lines") -> DataFrame:
    """Doc-level keys of a text snapshot computed inside each row: ``(doc_id, n, keys)`` from the
    ``ARRAY<STRING>`` of kept lines (no explode, no shuffle).  One row per present document."""
    hashed = F.transform(F.col(lines_col), lambda x: F.xxhash64(F.concat(F.lit("paragraph:"), x)))
    return lines.select("doc_id", F.size(lines_col).cast("bigint").alias("n"), hashed.alias("keys"))


def document_pairs(old_docs: DataFrame, new_docs: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame,
                   max_udf_blocks: int = MAX_UDF_BLOCKS, old_doc_keys: DataFrame | None = None,
                   new_doc_keys: DataFrame | None = None) -> DataFrame:
    """One row per document of either snapshot: presence, block counts, route, key arrays and
    ``same`` (the two key sequences are equal).

    With ``*_doc_keys`` (sources that know a document's keys inside its row, e.g. text) this is a
    single full-outer join of two doc-level tables.  Otherwise block counts come first (partial
    aggregation), and only documents within the route-1 bound are collected into arrays; oversized
    documents get an order-sensitive fingerprint instead.  The table is persisted because the
    status, route 1 and route 2 all read it."""
    if old_doc_keys is not None and new_doc_keys is not None:
        o = old_doc_keys.select("doc_id", F.lit(True).alias("in_old"), F.col("n").alias("n_old"),
                                F.col("keys").alias("old_keys"))
        n = new_doc_keys.select("doc_id", F.lit(True).alias("in_new"), F.col("n").alias("n_new"),
                                F.col("keys").alias("new_keys"))
        j = o.join(n, "doc_id", "full_outer")
        empty = F.array().cast("array<bigint>")
        pairs = j.select("doc_id",
                         F.coalesce("in_old", F.lit(False)).alias("in_old"),
                         F.coalesce("in_new", F.lit(False)).alias("in_new"),
                         F.lit(False).alias("parse_error"),
                         F.coalesce("n_old", F.lit(0)).cast("bigint").alias("n_old"),
                         F.coalesce("n_new", F.lit(0)).cast("bigint").alias("n_new"),
                         "old_keys", "new_keys",
                         (F.coalesce("old_keys", empty) == F.coalesce("new_keys", empty)).alias("same"))
        pairs = pairs.withColumn("route", F.when(F.col("n_old") + F.col("n_new") > max_udf_blocks, F.lit(2))
                                 .otherwise(F.lit(1)))
        return pairs.persist(StorageLevel.MEMORY_AND_DISK)
    all_big = max_udf_blocks <= 0  # every document with blocks takes route 2: fingerprints come with the counts
    n_old, n_new = ((_counted(b, side) if all_big else b.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{side}")))
                    for side, b in (("old", old_blocks), ("new", new_blocks)))
    prints = ["fp_old", "fp_new"] if all_big else []
    om = manifest(old_docs).withColumnRenamed("parse_error", "old_error").withColumn("in_old", F.lit(True))
    nm = manifest(new_docs).withColumnRenamed("parse_error", "new_error").withColumn("in_new", F.lit(True))
    counts = (om.join(nm, "doc_id", "full_outer")
              .join(n_old, "doc_id", "left").join(n_new, "doc_id", "left")
              .select("doc_id",
                      F.coalesce("in_old", F.lit(False)).alias("in_old"),
                      F.coalesce("in_new", F.lit(False)).alias("in_new"),
                      (F.coalesce("old_error", F.lit(False)) | F.coalesce("new_error", F.lit(False))).alias("parse_error"),
                      F.coalesce("n_old", F.lit(0)).alias("n_old"),
                      F.coalesce("n_new", F.lit(0)).alias("n_new"), *prints))
    counts = cut_lineage(counts.withColumn(
        "route", F.when(F.col("n_old") + F.col("n_new") > max_udf_blocks, F.lit(2)).otherwise(F.lit(1))))
    empty = F.array().cast("array<bigint>")
    if all_big:
        none = F.lit(None).cast("array<bigint>")
        st = counts.withColumn("old_keys", none).withColumn("new_keys", none)
    else:
        st = _with_keys_or_prints(counts, old_blocks, new_blocks)
    same = F.when(F.col("route") == 1, F.coalesce("old_keys", empty) == F.coalesce("new_keys", empty)) \
        .otherwise((F.col("n_old") == F.col("n_new")) & (F.col("fp_old") == F.col("fp_new")))
    pairs = st.select("doc_id", "in_old", "in_new", "parse_error", F.col("n_old").cast("bigint").alias("n_old"),
                      F.col("n_new").cast("bigint").alias("n_new"), "old_keys", "new_keys",
                      same.alias("same"), "route")
    return pairs.persist(StorageLevel.MEMORY_AND_DISK)


def _status(same: Column) -> Column:
    return (F.when(F.col("parse_error"), "parse_error")
            .when(~F.col("in_new"), "deleted")
            .when(~F.col("in_old"), "added")
            .when(F.col("n_old") + F.col("n_new") == 0, "unchanged")
            .when(same, "unchanged")
            .otherwise("changed"))


def doc_status(old_docs: DataFrame, new_docs: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame,
               max_udf_blocks: int = MAX_UDF_BLOCKS, old_doc_keys: DataFrame | None = None,
               new_doc_keys: DataFrame | None = None) -> DataFrame:
    """``doc_id, in_old, in_new, n_old, n_new, route, status`` for every document.

    ``status`` is ``deleted`` / ``added`` / ``unchanged`` / ``changed`` / ``parse_error``.  Presence
    comes from the manifests, not from the blocks: a present but blank document has no block rows."""
    pairs = document_pairs(old_docs, new_docs, old_blocks, new_blocks, max_udf_blocks, old_doc_keys, new_doc_keys)
    return pairs.select("doc_id", "in_old", "in_new", "n_old", "n_new", "route",
                        _status(F.col("same")).alias("status"))


def _with_keys_or_prints(counts: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """``counts`` with the key arrays of route-1 documents and the fingerprints of the others."""
    r1 = counts.filter((F.col("route") == 1) & ~F.col("parse_error")
                       & (F.col("n_old") + F.col("n_new") > 0)).select("doc_id")
    okeys = document_keys(with_keys(old_blocks).join(r1, "doc_id", "left_semi")).withColumnRenamed("keys", "old_keys")
    nkeys = document_keys(with_keys(new_blocks).join(r1, "doc_id", "left_semi")).withColumnRenamed("keys", "new_keys")
    fp_old = _fingerprints(old_blocks, counts).withColumnRenamed("fp", "fp_old")
    fp_new = _fingerprints(new_blocks, counts).withColumnRenamed("fp", "fp_new")
    return (counts.join(okeys, "doc_id", "left").join(nkeys, "doc_id", "left")
            .join(fp_old, "doc_id", "left").join(fp_new, "doc_id", "left"))


def _counted(blocks: DataFrame, side: str) -> DataFrame:
    """``(doc_id, n_<side>, fp_<side>)`` in one partial aggregate."""
    return with_keys(blocks).groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{side}"), _fingerprint().alias(f"fp_{side}"))


def _fingerprint() -> Column:
    return F.sum(F.xxhash64("block_pos", "key_hash").cast("decimal(38,0)"))


def _fingerprints(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Order-sensitive fingerprint of an oversized document without collecting it: the sum of
    ``xxhash64(position, key)`` (a partial aggregate).  Equal documents always agree; a false
    equality needs a 64-bit collision."""
    big = broadcast_if_small(counts.filter(F.col("route") == 2).select("doc_id"))
    kb = with_keys(blocks.join(big, "doc_id", "left_semi"))
    return kb.groupBy("doc_id").agg(_fingerprint().alias("fp"))


def route1_opcodes(pairs: DataFrame, autojunk: bool = True) -> DataFrame:
    """``(doc_id, ops ARRAY<opcode>)`` for every route-1 document with blocks, in one pass.  Only
    documents whose key arrays differ hand arrays to the Python UDF; the others pass nulls and
    take their single opcode natively."""
    s = pairs.filter((F.col("route") == 1) & ~F.col("parse_error") & (F.col("n_old") + F.col("n_new") > 0))
    differs = (F.col("n_old") > 0) & (F.col("n_new") > 0) & ~F.col("same")
    ops = (F.when(F.col("n_new") == 0, _one_opcode("delete", F.col("n_old"), F.lit(0)))
           .when(F.col("n_old") == 0, _one_opcode("insert", F.lit(0), F.col("n_new")))
           .when(~differs, _one_opcode("equal", F.col("n_old"), F.col("n_new")))
           .otherwise(opcode_udf(autojunk)(F.when(differs, F.col("old_keys")), F.when(differs, F.col("new_keys")))))
    return s.select("doc_id", ops.alias("ops"))


def document_opcodes(old_docs: DataFrame, new_docs: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame,
                     autojunk: bool = True, max_udf_blocks: int = MAX_UDF_BLOCKS,
                     old_doc_keys: DataFrame | None = None, new_doc_keys: DataFrame | None = None,
                     small_range: int | None = None) -> DataFrame:
    """Opcodes of every document, route 1 and route 2 together: ``(doc_id, tag, i1, i2, j1, j2, base)``."""
    from .align_frontier import frontier_opcodes
    pairs = document_pairs(old_docs, new_docs, old_blocks, new_blocks, max_udf_blocks, old_doc_keys, new_doc_keys)
    r1 = route1_opcodes(pairs, autojunk)
    r1 = r1.select("doc_id", F.explode("ops").alias("op")).select("doc_id", "op.*")
    big = pairs.filter((F.col("route") == 2) & ~F.col("parse_error")).select("doc_id", "n_old", "n_new", "same")
    r2 = frontier_opcodes(big, old_blocks, new_blocks, autojunk, small_range)
    return r1.unionByName(r2)


def expand_opcodes(ops: DataFrame) -> DataFrame:
    """C4-C7 natively: one row per result entry ``(doc_id, entry_idx, change, old_pos, new_pos)``.

    ``equal`` -> ``unchanged`` (old block); inside any other opcode the first ``min(lo, ln)`` offsets
    pair up as ``changed``, the rest are ``deleted`` (old side) or ``added`` (new side)."""
    lo = F.col("i2") - F.col("i1")
    ln = F.col("j2") - F.col("j1")
    width = F.when(F.col("tag") == "equal", lo).otherwise(F.greatest(lo, ln))
    t = ops.filter(width > 0).select("doc_id", "tag", "i1", "j1", "base",
                                     lo.alias("lo"), ln.alias("ln"),
                                     F.explode(F.sequence(F.lit(0), width - 1)).alias("t"))
    old_pos = F.when(F.col("t") < F.col("lo"), F.col("i1") + F.col("t"))
    new_pos = F.when(F.col("t") < F.col("ln"), F.col("j1") + F.col("t"))
    change = (F.when(F.col("tag") == "equal", "unchanged")
              .when(old_pos.isNotNull() & new_pos.isNotNull(), "changed")
              .when(old_pos.isNotNull(), "deleted").otherwise("added"))
    return t.select("doc_id", (F.col("base") + F.col("t")).cast("int").alias("entry_idx"), change.alias("change"),
                    old_pos.cast("int").alias("old_pos"), new_pos.cast("int").alias("new_pos"))


def _side(blocks: DataFrame, prefix: str, pos_name: str) -> DataFrame:
    return blocks.select("doc_id", F.col("block_pos").alias(pos_name),
                         *[F.col(c).alias(f"{prefix}{c}") for c in PAYLOAD_COLS])


def attach_payloads(entries: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """Join entries to block payloads on ``(doc_id, position)``.

    Unchanged / deleted rows take only the old block, added rows only the new one, changed rows both
    (as the reference does).  Entries are consumed once (so the alignment runs once).  A side that
    must not match gets a unique negative position instead of null, so those rows spread over all
    partitions instead of piling into the null-key partition.  The new side is joined first, while
    entry rows are still narrow."""
    salt = -(F.col("entry_idx") + 1)
    new_key = F.when(F.col("change").isin("changed", "added"), F.col("new_pos")).otherwise(salt)
    old_key = F.coalesce(F.col("old_pos"), salt)
    new_s = _side(new_blocks, "new_", "_npk")
    old_s = _side(old_blocks, "old_", "_opk")
    out = (entries.withColumn("_npk", new_key).withColumn("_opk", old_key)
           .join(new_s, ["doc_id", "_npk"], "left")
           .join(old_s, ["doc_id", "_opk"], "left")
           .drop("_npk", "_opk"))
    top_type = F.when(F.col("change") == "changed", F.lit(None).cast("string")) \
        .when(F.col("change") == "added", F.col("new_type")).otherwise(F.col("old_type"))
    return out.withColumn("type", effective_type(top_type, F.col("new_type"), F.col("old_type")))


def align_blocks(old_docs: DataFrame, new_docs: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame,
                 autojunk: bool = True, max_udf_blocks: int = MAX_UDF_BLOCKS,
                 with_payload: bool = True, old_doc_keys: DataFrame | None = None,
                 new_doc_keys: DataFrame | None = None, small_range: int | None = None) -> DataFrame:
    """The reference's result list for every document pair, one row per entry."""
    entries = expand_opcodes(document_opcodes(old_docs, new_docs, old_blocks, new_blocks, autojunk, max_udf_blocks,
                                              old_doc_keys, new_doc_keys, small_range))
    if not with_payload:
        return entries
    return attach_payloads(entries, old_blocks, new_blocks)


def rebuild_side(changes: DataFrame, side: str) -> DataFrame:
    """Unchanged + changed.new + added (in entry order) is the new side; unchanged + changed.old +
    deleted is the old side.  Output ``(doc_id, block_pos, text)``, equal to the input side."""
    if side == "new":
        kept = changes.filter(F.col("change").isin("unchanged", "changed", "added"))
        text = F.when(F.col("change") == "unchanged", F.col("old_text")).otherwise(F.col("new_text"))
    else:
        kept = changes.filter(F.col("change").isin("unchanged", "changed", "deleted"))
        text = F.col("old_text")
    # positions are re-derived from the entry order, so the check covers ordering too
    from ..functions.ranking import rank_within, slice_of
    r = rank_within(kept.select("doc_id", "entry_idx", text.alias("text")), ["doc_id"], [F.col("entry_idx")],
                    [(slice_of("entry_idx"), True)], out="rn")
    return r.select("doc_id", (F.col("rn") - 1).cast("int").alias("block_pos"), "text")


def documents_only_in(status: DataFrame, side: str) -> DataFrame:
    """Documents present in one snapshot only (``left_anti`` semantics on the manifests)."""
    flag = "in_old" if side == "old" else "in_new"
    other = "in_new" if side == "old" else "in_old"
    return status.filter(F.col(flag) & ~F.col(other)).select("doc_id", "n_old", "n_new")


def with_errors(status: DataFrame, errors: DataFrame) -> DataFrame:
    """A10: ``status`` with reader errors as the third side of the pairing.

    ``errors`` is the readers' manifest ``(doc_id, reason)`` of either snapshot, with one or more rows a document.  A
    document named there is ``parse_error`` whatever was read of it, also when no block of it arrived; its reasons stay
    in ``reasons`` (sorted; null for the others)."""
    told = errors.groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    none = {"in_old": F.lit(False), "in_new": F.lit(False), "n_old": F.lit(0), "n_new": F.lit(0)}
    joined = status.withColumn("_read", F.lit(True)).join(told.withColumn("_told", F.lit(True)), "doc_id", "full_outer")
    return joined.select("doc_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()],
                         F.when(F.col("_told"), F.lit("parse_error")).otherwise(F.col("status")).alias("status"), "reasons")
