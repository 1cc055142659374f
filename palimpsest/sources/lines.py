"""A1: text-line source.  Every line, stripped, becomes a paragraph block if non-empty.

The split, strip, filter and numbering all happen inside the row that holds the text
(array functions), so turning documents into blocks needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import conform_blocks
from ..functions.ranking import running_sum_within
from ..functions.text import ustrip
from ..session import broadcast_if_small


def kept_lines(text):
    """ARRAY<STRING> of stripped non-empty lines, in order (``block_pos`` = array index).

    Universal newlines break at ``\\r\\n``, ``\\n`` and ``\\r``.  Replacing ``\\r`` by ``\\n`` turns
    ``\\r\\n`` into ``\\n\\n``, i.e. one extra *empty* line, which the non-empty filter drops, so
    the kept lines are the same while the split needs no regex."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n", -1)
    return F.filter(F.transform(lines, ustrip), lambda x: x != "")


def lines_blocks(lines: DataFrame, lines_col: str = "lines") -> DataFrame:
    """``(doc_id, lines ARRAY<STRING>)`` -> ``blocks`` rows (position = array index)."""
    exploded = lines.select("doc_id", F.posexplode(F.col(lines_col)).alias("block_pos", "text"))
    return conform_blocks(exploded.withColumn("type", F.lit("paragraph")))


def line_bound(text):
    """Native upper bound of the kept-line count: line breaks + 1 (no array is built)."""
    t = F.coalesce(text, F.lit(""))
    n_lf = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    n_cr = F.length(t) - F.length(F.replace(t, F.lit("\r"), F.lit("")))
    return (n_lf + n_cr + 1).cast("bigint")


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, lines, bound)``: the input of ``Comparison.from_lines``."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), kept_lines(F.col(text_col)).alias("lines"),
                       line_bound(F.col(text_col)).alias("bound"))


def text_snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """A text corpus as ``(manifest, blocks, doc_keys)``: the kept-lines array is computed in each row,
    the blocks explode it, the doc-level keys hash it without leaving the row."""
    from ..operators.align import text_doc_keys
    lines = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), kept_lines(F.col(text_col)).alias("lines"))
    return lines.select("doc_id"), lines_blocks(lines), text_doc_keys(lines)


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` rows -> ``blocks`` rows (type ``paragraph``)."""
    exploded = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.posexplode(kept_lines(F.col(text_col))).alias("block_pos", "text"),
    )
    return conform_blocks(exploded.withColumn("type", F.lit("paragraph")))


def read_text_files(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Text files as documents: ``(doc_id, doc_name, text)``.

    Bytes are decoded as UTF-8 with invalid sequences replaced by U+FFFD (``errors="replace"``).
    ``doc_name`` is the path relative to ``root`` (so two snapshot folders pair by file name) and
    ``doc_id`` is its 64-bit hash."""
    raw = spark.read.format("binaryFile").load(path)
    name = _relative(F.col("path"), root or path)
    return raw.select(
        F.xxhash64(name).alias("doc_id"),
        name.alias("doc_name"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_text_blocks(spark: SparkSession, path: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Text files of any size as ``(manifest, blocks)``, equal to ``text_blocks(read_text_files(..))``.

    A file is read in splits (``spark.sql.files.maxPartitionBytes``), each by its own task, with lines that cross a
    split read by the task in which they begin.  A line's ``block_pos`` is its number among the split's kept lines plus
    the kept lines of the file's splits before; only one narrow row a split is gathered for that, and the lines
    stay where they were read.  Universal newlines (``\\n``, ``\\r``, ``\\r\\n``, also across splits) and
    invalid bytes are as in the row form; a byte order mark at a file's start is not part of its first line here.
    ``manifest`` is ``(doc_id, doc_name)`` of all files, blank ones included."""
    top = root or path
    files = spark.read.format("binaryFile").load(path).select(_relative(F.col("path"), top).alias("doc_name"))
    kept = (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    ustrip(F.make_valid_utf8(F.col("value"))).alias("text"))
            .filter(F.col("text") != "")
            # rows of a task count up in the order in which they are read, so those of a split do
            .withColumn("at", F.monotonically_increasing_id()))
    splits = kept.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = running_sum_within(splits, ["file"], [F.col("split")], [(F.floor(F.col("split") / (1 << 40)), True)], "n", "before")
    placed = kept.join(broadcast_if_small(before.drop("n")), ["file", "split"])
    name = _relative(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), top)
    blocks = placed.select(F.xxhash64(name).alias("doc_id"),
                           (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("block_pos"),
                           F.lit("paragraph").alias("type"), "text")
    return files.select(F.xxhash64("doc_name").alias("doc_id"), "doc_name"), conform_blocks(blocks)


def _relative(file: Column, root: str) -> Column:
    return F.regexp_replace(file, r"^(file:(//)?)?" + _regex_quote(root.rstrip("/").replace("file:", "") + "/"), "")


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$|?*+()[]{}\\" else ch for ch in s)
