"""Block schema and comparison keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One row per block.  The side (old / new) is implied by which snapshot a DataFrame belongs to.
PAYLOAD_FIELDS = [
    ("type", T.StringType()),
    ("text", T.StringType()),
    ("style", T.StringType()),
    ("bold", T.BooleanType()),
    ("italic", T.BooleanType()),
    ("underline", T.BooleanType()),
    ("color", T.StringType()),
    ("table", T.ArrayType(T.ArrayType(T.StringType()))),
    ("sheet", T.StringType()),
    ("rel_id", T.StringType()),
    ("sha1", T.StringType()),
    ("size", T.LongType()),
    ("filename", T.StringType()),
]
PAYLOAD_COLS = [n for n, _ in PAYLOAD_FIELDS]
BLOCK_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("block_pos", T.IntegerType())]
    + [T.StructField(n, t) for n, t in PAYLOAD_FIELDS]
)


def conform_blocks(df: DataFrame) -> DataFrame:
    """Any DataFrame with ``doc_id``, ``block_pos``, ``type`` and some payload columns becomes a
    ``blocks`` DataFrame: missing payload columns are typed nulls, column order is fixed."""
    cols = []
    for f in BLOCK_SCHEMA.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def table_key_text(table: Column) -> Column:
    """Cells joined with ``,``, rows with ``|`` (collisions such as ``[["a,b"]]`` vs ``[["a","b"]]``
    are kept on purpose: they are the reference's key)."""
    return F.array_join(F.transform(F.coalesce(table, F.array().cast("array<array<string>>")),
                                    lambda r: F.array_join(r, ",")), "|")


def block_key(type_: Column = None, text: Column = None, table: Column = None, sheet: Column = None,
              sha1: Column = None, rel_id: Column = None) -> Column:
    """The string the alignment compares."""
    type_ = F.col("type") if type_ is None else type_
    text = F.col("text") if text is None else text
    table = F.col("table") if table is None else table
    sheet = F.col("sheet") if sheet is None else sheet
    sha1 = F.col("sha1") if sha1 is None else sha1
    rel_id = F.col("rel_id") if rel_id is None else rel_id
    rows_key = table_key_text(table)
    return (
        F.when(type_ == "paragraph", F.concat(F.lit("paragraph:"), F.coalesce(text, F.lit(""))))
        .when(type_ == "table",
              F.when(F.coalesce(sheet, F.lit("")) != "",
                     F.concat(F.lit("table:"), sheet, F.lit(":"), rows_key))
              .otherwise(F.concat(F.lit("table:"), rows_key)))
        .when(type_ == "image",
              F.concat(F.lit("image:"), F.coalesce(F.nullif(sha1, F.lit("")), rel_id, F.lit(""))))
        .otherwise(F.coalesce(type_, F.lit("")))
    )


def key_hash(key: Column) -> Column:
    """64-bit hash used to compare blocks *within one document* (keys can be whole paragraphs
    long; only the hash crosses the shuffle and the Arrow boundary)."""
    return F.xxhash64(key)


def with_keys(blocks: DataFrame) -> DataFrame:
    """Adds ``block_key`` and ``key_hash``; blocks that bring their ``key_hash`` (``operators.exact_keys``) keep it."""
    keyed = blocks.withColumn("block_key", block_key())
    return keyed if "key_hash" in blocks.columns else keyed.withColumn("key_hash", key_hash(F.col("block_key")))


def effective_type(type_: Column, new_type: Column, old_type: Column) -> Column:
    """``type or new.type or old.type or 'unknown'``."""
    return F.coalesce(F.nullif(type_, F.lit("")), F.nullif(new_type, F.lit("")),
                      F.nullif(old_type, F.lit("")), F.lit("unknown"))
