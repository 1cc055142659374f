"""Alignment plan for text corpora (the reference's TXT path).

Input per side: ``(doc_id, lines ARRAY<STRING>)``, the stripped non-empty lines of each document (one
row per present document).  Two forms of one join on ``doc_id``:

* narrow: each side sends ``(doc_id, n, keys)``, 8 bytes a line.  Status, opcodes, entry positions and counts
  need nothing else, so no text is shuffled for them; counts are sums over a document's opcodes, without
  expanding entries;
* wide: each side sends its lines, for queries that return texts.  Entries take their text with
  ``element_at`` from the arrays already in the row, so there is no payload join.

Documents with more than ``max_udf_blocks`` lines on either side take the distributed route 2.  The output has
the schema of ``align.attach_payloads``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import PAYLOAD_FIELDS, effective_type
from ..session import broadcast_if_small, cut_lineage, stored
from . import align


def _hash_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.concat(F.lit("paragraph:"), x)))


def oversized_docs(old_lines: DataFrame, new_lines: DataFrame, max_udf_blocks: int) -> DataFrame | None:
    """Ids of documents with more than ``max_udf_blocks`` lines on either side, or ``None``.

    A side's ``bound`` column (an upper bound of the number of lines) is looked at first, so only texts that
    may be too long are split for it."""
    def long(df: DataFrame) -> DataFrame:
        if "bound" in df.columns:
            df = df.filter(F.col("bound") > max_udf_blocks)
        return df.filter(F.size("lines") > max_udf_blocks).select("doc_id")
    big = long(old_lines).unionByName(long(new_lines)).distinct()
    return None if big.limit(1).count() == 0 else cut_lineage(big)


def narrow_pairs(old_lines: DataFrame, new_lines: DataFrame, max_udf_blocks: int = align.MAX_UDF_BLOCKS) -> DataFrame:
    """Doc-level full outer join of keys: ``doc_id, in_old, in_new, n_old, n_new, old_keys, new_keys, same, route``."""
    o = align.text_doc_keys(old_lines).select("doc_id", F.col("n").alias("n_old"), F.col("keys").alias("old_keys"),
                                              F.lit(True).alias("in_old"))
    n = align.text_doc_keys(new_lines).select("doc_id", F.col("n").alias("n_new"), F.col("keys").alias("new_keys"),
                                              F.lit(True).alias("in_new"))
    empty = F.array().cast("array<bigint>")
    return o.join(n, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("in_old", F.lit(False)).alias("in_old"), F.coalesce("in_new", F.lit(False)).alias("in_new"),
        F.coalesce("n_old", F.lit(0)).cast("bigint").alias("n_old"), F.coalesce("n_new", F.lit(0)).cast("bigint").alias("n_new"),
        "old_keys", "new_keys",
        (F.coalesce("old_keys", empty) == F.coalesce("new_keys", empty)).alias("same"),
        F.when(F.greatest(F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))) > max_udf_blocks, 2)
        .otherwise(1).alias("route"))


def text_pairs(old_lines: DataFrame, new_lines: DataFrame, big: DataFrame | None) -> DataFrame:
    """Doc-level full outer join: ``doc_id, in_old, in_new, n_old, n_new, old_lines, new_lines, same``."""
    o = old_lines.select("doc_id", F.col("lines").alias("old_lines"), F.lit(True).alias("in_old"))
    n = new_lines.select("doc_id", F.col("lines").alias("new_lines"), F.lit(True).alias("in_new"))
    if big is not None:
        o = o.join(big, "doc_id", "left_anti")
        n = n.join(big, "doc_id", "left_anti")
    j = o.join(n, "doc_id", "full_outer")
    empty = F.array().cast("array<string>")
    return j.select("doc_id",
                    F.coalesce("in_old", F.lit(False)).alias("in_old"),
                    F.coalesce("in_new", F.lit(False)).alias("in_new"),
                    F.coalesce(F.size("old_lines"), F.lit(0)).cast("bigint").alias("n_old"),
                    F.coalesce(F.size("new_lines"), F.lit(0)).cast("bigint").alias("n_new"),
                    "old_lines", "new_lines",
                    (F.coalesce("old_lines", empty) == F.coalesce("new_lines", empty)).alias("same"))


def text_status(old_lines: DataFrame, new_lines: DataFrame, max_udf_blocks: int = align.MAX_UDF_BLOCKS) -> DataFrame:
    """C1/A10 for text corpora (same columns as ``align.doc_status``)."""
    status = (F.when(~F.col("in_new"), "deleted").when(~F.col("in_old"), "added")
              .when(F.col("same"), "unchanged").otherwise("changed"))
    return narrow_pairs(old_lines, new_lines, max_udf_blocks).select(
        "doc_id", "in_old", "in_new", "n_old", "n_new", "route", status.alias("status"))


def _pair_opcodes(autojunk: bool, old_keys: Column, new_keys: Column) -> Column:
    differs = (F.col("n_old") > 0) & (F.col("n_new") > 0) & ~F.col("same")
    udf = align.opcode_udf(autojunk)(F.when(differs, old_keys), F.when(differs, new_keys))
    return (F.when(F.col("n_new") == 0, align._one_opcode("delete", F.col("n_old"), F.lit(0)))
            .when(F.col("n_old") == 0, align._one_opcode("insert", F.lit(0), F.col("n_new")))
            .when(~differs, align._one_opcode("equal", F.col("n_old"), F.col("n_new")))
            .otherwise(udf))


def narrow_opcodes(old_lines: DataFrame, new_lines: DataFrame, autojunk: bool = True,
                   max_udf_blocks: int = align.MAX_UDF_BLOCKS) -> DataFrame:
    """``(doc_id, ops)`` of every document of route 1; documents without lines have no opcodes."""
    p = narrow_pairs(old_lines, new_lines, max_udf_blocks).filter("route = 1")
    return p.select("doc_id", F.when(F.col("n_old") + F.col("n_new") > 0, _pair_opcodes(
        autojunk, F.col("old_keys"), F.col("new_keys"))).alias("ops"))


def _key_blocks(lines: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest and blocks of the documents in ``big`` without their texts.  A document's keys are taken inside its row,
    so 8 bytes a line move, and are stored once for all that read them."""
    hashed = F.transform("lines", lambda x: F.xxhash64(F.concat(F.lit("paragraph:"), F.coalesce(x, F.lit("")))))
    keys = stored(lines.select("doc_id", hashed.alias("keys")).join(big, "doc_id", "left_semi"), "line-keys")
    blocks = keys.select("doc_id", F.posexplode("keys").alias("block_pos", "key_hash"))
    payload = [F.lit("paragraph" if name == "type" else None).cast(kind).alias(name) for name, kind in PAYLOAD_FIELDS]
    return keys.select("doc_id"), blocks.select("doc_id", "block_pos", *payload, "key_hash")


def _long_documents(old_lines: DataFrame, new_lines: DataFrame, big: DataFrame, autojunk: bool, payload: bool,
                    small_range: int | None = None) -> DataFrame:
    from ..sources.lines import lines_blocks
    big = broadcast_if_small(big)
    (old_docs, old_keys), (new_docs, new_keys) = _key_blocks(old_lines, big), _key_blocks(new_lines, big)
    entries = align.align_blocks(old_docs, new_docs, old_keys, new_keys, autojunk, max_udf_blocks=0,
                                 with_payload=False, small_range=small_range)
    if not payload:
        return entries
    return align.attach_payloads(entries, *[lines_blocks(df.join(big, "doc_id", "left_semi")) for df in (old_lines, new_lines)])


def text_positions(old_lines: DataFrame, new_lines: DataFrame, autojunk: bool = True,
                   max_udf_blocks: int = align.MAX_UDF_BLOCKS, small_range: int | None = None) -> DataFrame:
    """Entries without their texts: ``doc_id, entry_idx, change, old_pos, new_pos``."""
    ops = narrow_opcodes(old_lines, new_lines, autojunk, max_udf_blocks)
    cols = ["doc_id", "entry_idx", "change", "old_pos", "new_pos"]
    out = align.expand_opcodes(ops.select("doc_id", F.explode("ops").alias("op")).select("doc_id", "op.*")).select(*cols)
    big = oversized_docs(old_lines, new_lines, max_udf_blocks)
    if big is None:
        return out
    return out.unionByName(_long_documents(old_lines, new_lines, big, autojunk, False, small_range).select(*cols))


def text_counts(old_lines: DataFrame, new_lines: DataFrame, autojunk: bool = True,
                max_udf_blocks: int = align.MAX_UDF_BLOCKS, small_range: int | None = None) -> DataFrame:
    """H1 of every document: ``doc_id, added, deleted, changed, unchanged, total_blocks``."""
    def total(width) -> Column:
        return F.coalesce(F.aggregate("ops", F.lit(0).cast("bigint"), lambda acc, o: acc + width(o)), F.lit(0).cast("bigint"))
    lo, ln = (lambda o: o["i2"] - o["i1"]), (lambda o: o["j2"] - o["j1"])
    equal = lambda o: o["tag"] == "equal"
    counts = {
        "added": total(lambda o: F.when(equal(o), 0).otherwise(F.greatest(ln(o) - lo(o), F.lit(0)))),
        "deleted": total(lambda o: F.when(equal(o), 0).otherwise(F.greatest(lo(o) - ln(o), F.lit(0)))),
        "changed": total(lambda o: F.when(equal(o), 0).otherwise(F.least(lo(o), ln(o)))),
        "unchanged": total(lambda o: F.when(equal(o), lo(o)).otherwise(0)),
        "total_blocks": total(lambda o: F.greatest(lo(o), ln(o))),
    }
    out = narrow_opcodes(old_lines, new_lines, autojunk, max_udf_blocks).select(
        "doc_id", *[c.alias(k) for k, c in counts.items()])
    big = oversized_docs(old_lines, new_lines, max_udf_blocks)
    if big is None:
        return out
    long = _long_documents(old_lines, new_lines, big, autojunk, False, small_range)
    return out.unionByName(long.groupBy("doc_id").agg(
        *[F.sum((F.col("change") == k).cast("bigint")).alias(k) for k in list(counts)[:4]],
        F.count(F.lit(1)).alias("total_blocks")))


def text_entries(pairs: DataFrame, autojunk: bool = True) -> DataFrame:
    """Route-1 entries with payload taken from the row's own line arrays."""
    p = pairs.filter(F.col("n_old") + F.col("n_new") > 0)
    ops = p.select("doc_id", "old_lines", "new_lines", F.explode(_pair_opcodes(
        autojunk, _hash_lines(F.col("old_lines")), _hash_lines(F.col("new_lines")))).alias("op"))
    ops = ops.select("doc_id", "old_lines", "new_lines", "op.*")
    lo = F.col("i2") - F.col("i1")
    ln = F.col("j2") - F.col("j1")
    width = F.when(F.col("tag") == "equal", lo).otherwise(F.greatest(lo, ln))
    t = ops.filter(width > 0).select("doc_id", "old_lines", "new_lines", "tag", "i1", "j1", "base",
                                     lo.alias("lo"), ln.alias("ln"),
                                     F.explode(F.sequence(F.lit(0), width - 1)).alias("t"))
    old_pos = F.when(F.col("t") < F.col("lo"), F.col("i1") + F.col("t"))
    new_pos = F.when(F.col("t") < F.col("ln"), F.col("j1") + F.col("t"))
    change = (F.when(F.col("tag") == "equal", "unchanged")
              .when(old_pos.isNotNull() & new_pos.isNotNull(), "changed")
              .when(old_pos.isNotNull(), "deleted").otherwise("added"))
    e = t.select("doc_id", (F.col("base") + F.col("t")).cast("int").alias("entry_idx"), change.alias("change"),
                 old_pos.cast("int").alias("old_pos"), new_pos.cast("int").alias("new_pos"),
                 F.when(old_pos.isNotNull(), F.element_at("old_lines", old_pos + 1)).alias("_ot"),
                 F.when(new_pos.isNotNull() & (change != "unchanged"),
                        F.element_at("new_lines", new_pos + 1)).alias("_nt"))
    return _with_text_payload(e)


def _with_text_payload(e: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("doc_id", "entry_idx", "change", "old_pos", "new_pos")]
    for prefix, src in (("old_", "_ot"), ("new_", "_nt")):
        for name, dtype in PAYLOAD_FIELDS:
            if name == "type":
                cols.append(F.when(F.col(src).isNotNull(), F.lit("paragraph")).alias(prefix + name))
            elif name == "text":
                cols.append(F.col(src).alias(prefix + name))
            else:
                cols.append(F.lit(None).cast(dtype).alias(prefix + name))
    out = e.select(*cols)
    top_type = F.when(F.col("change") == "changed", F.lit(None).cast("string")) \
        .when(F.col("change") == "added", F.col("new_type")).otherwise(F.col("old_type"))
    return out.withColumn("type", effective_type(top_type, F.col("new_type"), F.col("old_type")))


def text_changes(old_lines: DataFrame, new_lines: DataFrame, autojunk: bool = True,
                 max_udf_blocks: int = align.MAX_UDF_BLOCKS, small_range: int | None = None) -> DataFrame:
    """C2-C7 for text corpora: every entry with its payload."""
    big = oversized_docs(old_lines, new_lines, max_udf_blocks)
    r1 = text_entries(text_pairs(old_lines, new_lines, big), autojunk)
    if big is None:
        return r1
    return r1.unionByName(_long_documents(old_lines, new_lines, big, autojunk, True, small_range).select(*r1.columns))
