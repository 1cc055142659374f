"""Operator 3, token-ID output: Parquet list columns with controlled row groups and page indexes.

Documents are dealt out by ranges of their id, sorted inside a range, encoded with the ``tokenizers``
library, ended with id 0 and written by Spark's Parquet writer as ``(doc_id, local_start, n_tokens,
ids)``.  ``ids`` is an ``array<int>`` in dictionary pages (ids are below 2^16, so a value takes at most
two bytes); ids that overflow a dictionary fall back to delta packing (writer version 2).  Small row
groups and pages with their column indexes let a reader fetch few documents by ``doc_id`` or read the
narrow columns alone.  One file holds one range, so file order is id order, and ``local_start`` is the
number of ids before the document in its file.

Encoding: with this tokenizer's splitting rule every piece between a non-space character and a
following single space or line break stands alone, so equal pieces of many texts are encoded once
(bounded cache, held as Arrow arrays) and their ids gathered; a text where the cut would be unsafe is encoded whole.  The ids are the library's.

Defined cases: a null or empty text has the end id alone; null ids come first; rows with equal ids are
ordered by a hash of the text, so their order is the same in reruns; equal rows are all written; an
empty table gives an empty result; extra columns are not written.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import in_small_batches
from palimpsest.session import ensure_checkpoint_dir

END_ID = 0
CACHE_PIECES = 700_000  # pieces held while a task runs
SLICE_BYTES = 6 << 20  # text encoded at once
KEPT_PIECES, SHORT = 300_000, 8  # beyond so many, pieces of at most so many characters are kept between tasks
JOINED = 2_000  # new pieces encoded in one text
PARQUET = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
           "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10),
           "parquet.page.row.count.limit": "2000", "compression": "zstd"}


def vocabulary() -> str:
    """Place of the public byte-level vocabulary (a parameter of ``write``)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# White space that makes a cut unsafe: any but single spaces and line breaks inside the text.
_UNSAFE = (r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
           r"|[ \n]{2}|^[ \n]|[ \n]$")


class Encoder:
    """Ids of many texts at once: Arrow splits them and numbers equal pieces, a piece is encoded once, and the ids of
    all pieces are gathered from one array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level token has one character a byte
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.cuts = len(self._ids("\n")) == 1 and self.width[self._ids("a ß 日")].sum() == len("a ß 日".encode())
        self._keep(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _keep(self, pieces: pa.Array, ids: pa.Array) -> None:
        """``ids[k]`` are the ids of ``pieces[k]``."""
        self.pieces, self.ids = pieces, ids

    def learn(self, new: pa.Array) -> None:
        """Encodes pieces in few texts; every piece starts where the splitting rule starts anew, so the bytes of the
        ids tell where it ends."""
        chunks = pc.if_else(pc.starts_with(new, "\n"), new, pc.binary_join_element_wise("", new, " "))
        joined = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(0, len(new), JOINED), len(new)].astype(np.int32)), chunks)
        ids = np.concatenate([self._ids(text) for text in pc.binary_join(joined, "").to_pylist()])
        sizes = np.asarray(pc.binary_length(chunks)).astype(np.int64)
        cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes), "right")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, cut].astype(np.int32)), pa.array(ids))
        self._keep(pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.ids, lists]))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``END_ID``, and their numbers of ids."""
        n = np.zeros(len(texts), np.int64)
        safe = np.full(len(texts), self.cuts) & np.asarray(pc.greater(pc.binary_length(texts), 0))
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        for a in self.added:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, a))
        safe &= ~np.asarray(unsafe)
        alone = np.flatnonzero(~safe)
        whole = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(
            texts.take(pa.array(alone)).to_pylist(), add_special_tokens=False)] if len(alone) else []
        n[alone] = [len(ids) + 1 for ids in whole]
        some = texts.filter(pa.array(safe)) if len(alone) else texts
        # the first piece gets a line break before it, whose one id makes room for the end id of the text before
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(some, "\n", " \n"), ""), " ")
        first = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        if len(self.pieces) > CACHE_PIECES:
            self.forget()
        at = pc.index_in(coded.dictionary, value_set=self.pieces)
        if at.null_count:
            new, known = coded.dictionary.filter(at.is_null()), len(self.pieces)
            self.learn(new)
            at = np.array(at.fill_null(-1))
            at[at < 0] = np.arange(known, known + len(new))
        taken = self.ids.take(pa.array(np.asarray(at)[np.asarray(coded.indices)]))
        begin = (np.asarray(taken.offsets) - taken.offsets[0].as_py())[first - first[0]]  # of every text's line break
        ended = np.append(np.asarray(taken.flatten()), np.int32(END_ID))
        ended[begin] = END_ID
        n[safe] = np.diff(begin)
        if not len(alone):
            return ended[1:], n
        start = np.r_[0, np.cumsum(n)]
        out = np.full(start[-1], END_ID, np.int32)
        cut = np.ones(start[-1], bool)  # places of the ids of texts cut into pieces
        for k, ids in zip(alone, whole):
            out[start[k]:start[k] + len(ids)] = ids
            cut[start[k]:start[k + 1]] = False
        out[cut] = ended[1:]
        return out, n

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return self.batch(pa.array([text], pa.string()))[0][:-1].astype("<u4").tobytes()

    def forget(self) -> None:
        """The shortest pieces are kept, at most ``KEPT_PIECES``: short ones are the frequent ones."""
        size = np.asarray(pc.utf8_length(self.pieces))
        upto = int(np.searchsorted(np.cumsum(np.bincount(size)), KEPT_PIECES, "right"))  # pieces of so many characters go
        kept = pa.array(size < min(upto, SHORT + 1))
        self._keep(self.pieces.filter(kept), self.ids.filter(kept))

    def rest(self) -> None:
        """Between tasks fewer pieces are kept, for the worker may serve other work."""
        if len(self.pieces) > KEPT_PIECES:
            self.forget()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone: gives freed memory back to the system
            ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary: Python workers outlive tasks, and so do its short pieces."""
    import tokenizers
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows ``lo`` to ``hi`` of at most ``SLICE_BYTES`` of text, or one longer text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(path), 0
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                values, n = encode.batch(part.column(1).cast(pa.string()))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(before + ends - n), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))],
                    names=["doc_id", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])
        encode.rest()
    return run


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None,
          ranges: int | None = None) -> None:
    """Writes the token files of ``docs`` to ``path`` in ascending id order."""
    rows = in_small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                       F.xxhash64(F.col(f"`{text}`")).alias("h"))
    if ranges is None:
        ranges = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = rows.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    out = dealt.select("doc_id", "t").mapInArrow(
        _encode(vocab or vocabulary()), "doc_id long, local_start long, n_tokens long, ids array<int>")
    out.write.options(**PARQUET).mode("errorifexists").parquet(path)


def _crc(ids: pa.Array) -> pa.Array:
    values, out = np.asarray(ids.values.fill_null(0)).astype("<u4"), np.zeros(len(ids), np.int64)
    cut = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        out[i] = zlib.crc32(values[a:b])
    return pa.array(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``; start counts the ids of all documents before.

    Only one row a file is gathered to place the files after one another.
    """
    rows = (spark.read.schema("doc_id long, local_start long, n_tokens long, ids array<int>").parquet(path)
            .withColumn("file", F.input_file_name()))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # part files are named by the number of their range: by length, then name, they are in id order
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.length("file"), "file")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = files.select(F.col("file").alias("f"), before.alias("shift"))
    return (rows.join(F.broadcast(shift), F.col("file") == F.col("f"))
            .select("doc_id", (F.col("shift") + F.col("local_start")).alias("start"), "n_tokens", "ids"))


def digest(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from what was read back."""
    return tokens.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"),
                         F.arrow_udf(_crc, "long")("ids").alias("ids_crc32"))


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
