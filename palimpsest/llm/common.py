"""What several operators share: table access, name-safe columns, word arrays and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage, read_table

__all__ = ["in_small_batches", "cut_lineage", "read_table", "with_fields", "free_name", "utf8", "WordArrays", "word_arrays",
           "mix64", "unit_interval", "bounded_sample", "components", "narrow_ids"]


BATCH_ROWS = 1_000  # texts that a Python worker holds at once


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to ``BATCH_ROWS`` rows if they were larger: whole texts cross to
    Python, and a batch of the usual 10,000 can take a large part of a worker's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def with_fields(df: DataFrame, struct: Column, fields: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` followed by ``fields`` of ``struct``, which is evaluated once."""
    tmp = free_name(df, "_s")
    return (df.select(*[F.col(f"`{c}`") for c in keep], struct.alias(tmp))
            .select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"{tmp}.{f}").alias(f) for f in fields]))


def unit_interval(*cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on ``cols`` alone, so reruns agree."""
    return ((F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53)))


def bounded_sample(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``; about twice as many meet to be sorted."""
    n = df.count()
    if n > rows:
        df = df.where(unit_interval(key) <= 2 * rows / n)
    return df.orderBy(F.xxhash64(key), key).limit(rows)


# ---------------------------------------------------------------------------------- word arrays
# Words are maximal runs of bytes outside x20 and x09-x0D; UTF-8 never has these bytes inside a
# longer character, so bytes and code points give the same words.

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = (~_SPACE).astype(np.uint8)
_KIND = _WORD * 2  # 0 space, 1 letters, digits and whatever is not ASCII, 2 the rest
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                                0xD6E8FEB86659FD93)]
_CHUNK = 1 << 17  # bytes of text whose 8-byte arrays are held at once; a longer text is held whole


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1; the longest table so far is kept up to four pieces' size."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, _CHUNK), base)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 4 * _CHUNK:
            _POWERS[int(base)] = table
    return table[:n]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets between them; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * np.dtype(width).itemsize)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets.astype(np.int64) - offsets[0]


class WordArrays:
    """Words of several texts: 64-bit hash, byte span, and ``first[i]:first[i+1]`` as the words of text ``i``.

    With ``punctuation`` a word also ends where letters and digits meet other characters.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool, punctuation: bool = False):
        if lower:
            raw = _LOWER[raw]
        kind = (_KIND if punctuation else _WORD)[raw]
        change = np.zeros(len(raw) + 1, bool)  # another kind starts here, or another text
        change[offsets] = True
        change[1:-1] |= kind[1:] != kind[:-1]
        begin, stop = change[:-1] & (kind > 0), change[1:] & (kind > 0)
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * _powers(_BASE_INV, len(raw))[self.start]
                          + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive words by first word, and which of them stay inside one text."""
        n = max(0, len(self.hash) - size + 1)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * _STEP[4] + self.hash[k:k + n] * _STEP[k % 4]
        inside = np.ones(n, bool)
        for k in range(1, size):  # a text that starts at word i+k ends the window of word i
            at = self.first[1:-1] - k
            inside[at[(at >= 0) & (at < n) & (self.first[1:-1] < len(self.hash))]] = False
        return mix64(total), inside


def word_arrays(texts: pa.Array, lower: bool, punctuation: bool = False):
    """Yields ``(position of the first text, number of texts, WordArrays)`` in bounded pieces."""
    raw, offsets = utf8(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        yield i, j - i, WordArrays(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower, punctuation)
        i = j


# ---------------------------------------------------------------------------------- components

def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every end of ``links(a, b)``; root is the smallest node of its component.

    Alternating large-star and small-star steps: every step is one aggregation and one join on the
    node, so no neighbourhood is gathered, and the number of rounds grows with the logarithm of the
    longest path.  Each round is checkpointed.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = cut_lineage(small.select("a", F.col("m").alias("b"))
                            .union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
                            .where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())


def narrow_ids(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` (a few narrow columns) marked for broadcast when it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
