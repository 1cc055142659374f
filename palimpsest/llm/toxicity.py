"""Operator 11, toxicity by compression distance: two zstandard dictionaries and calibrated window lengths.

A text, lower-cased and without ASCII punctuation, is cut into windows of ``WINDOW`` words.  Every window is
compressed alone with a dictionary of ordinary text and with one of toxic text, and the difference of the two lengths in
bytes is the window's distance.  A logistic curve over a text's greatest distance, its mean distance and what the
windows' distances have beyond ``FREE`` bytes (by the root of all windows) gives the score.

The ordinary dictionary is trained by zstandard on windows of ordinary texts.  A label speaks of a whole document,
most of whose windows are ordinary, so the toxic dictionary is the same one continued by the passages that mark
the toxic texts: the words whose number of distinct contexts (word before, word after; copies give the same
ones) is raised among toxic texts by more than chance (log odds less two standard errors above ``MIN_ODDS``), the
most telling nearest.  Both dictionaries share what is ordinary, so what differs is what is toxic, stems
of unseen forms included.

Learning: from labelled rows only whose crc32 of the id as text, modulo 4, is not 2, and only from texts and the
label.  Bounds: ``SAMPLE_ROWS`` rows of either label (those with the smallest hash of the id), ``SAMPLE_WINDOWS``
ordinary windows, ``PASSAGES`` words.  The sample is parted in two by id; the curve is fitted to rows that
the dictionaries of the other half have scored, weighed by the counts of all labelled rows, and the dictionaries in
use are those of both halves.

Defined cases: a null, empty or blank text has one empty window and so a low score; null ids are never held out nor
learnt from; several labels of one id count as toxic if one is; null labels are ignored; with labels of one kind the
score is constant, without labels it is 0; repeated rows are scored alike; an empty table gives an empty result;
extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_sample, cut_lineage

WINDOW = 6  # words
LEVEL = 2
FREE = 3  # bytes of distance that ordinary windows have by chance
DICTIONARY = 64 << 10  # bytes of the ordinary dictionary
MIN_ODDS = 1.8
SAMPLE_ROWS = 4_000  # of either label
SAMPLE_WINDOWS = 30_000
PASSAGES = 1_000
LONGEST = 400  # bytes of a window or a passage that is learnt from
THRESHOLD = 0.3
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Distance:
    """Window distances by two dictionaries; ``ordinary`` are windows, ``passages`` words, the most telling last."""

    def __init__(self, ordinary: list[bytes], passages: list[bytes]):
        try:
            size = max(256, min(DICTIONARY, sum(map(len, ordinary)) // 4))
            base = zstandard.train_dictionary(size, ordinary).as_bytes()
        except zstandard.ZstdError:  # too few windows to train on: their text itself
            base = b"".join(ordinary)[-DICTIONARY:]
        self.dictionaries = (base + b" ", base + b" " + b"".join(p + b" " for p in passages))

    def compressors(self):
        kept = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        out = []
        for raw in self.dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, **kept).compress)
        return out


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return [b" ".join(words[i:i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b""]


def features(texts: Iterable[str | None], distance: Distance) -> np.ndarray:
    """``(greatest distance, mean distance, distance beyond FREE by the root of the windows)`` of each text."""
    ordinary, toxic = distance.compressors()
    out = []
    for text in texts:
        d = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
        out.append((max(d), sum(d) / len(d), sum(x - FREE for x in d if x > FREE) / len(d) ** 0.5))
    return np.array(out, float).reshape(-1, 3)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic fit with a small ridge (Newton steps): intercept and one factor a feature."""
    x = np.c_[np.ones(len(x)), x]
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1)) * weight.sum() / max(1, len(x))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge,
                               x.T @ (weight * (y - p)) - ridge @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _learn(some: DataFrame) -> list[Distance]:
    """Dictionaries from the sampled ``(doc_id, text, toxic, half)`` rows of half 0, of half 1 and of both."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"), "")
    none = F.array(F.lit(""))
    zipped = F.arrays_zip(F.concat(none, F.col("w")).alias("before"), F.col("w").alias("word"),
                          F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), none).alias("after"))
    contexts = (some.withColumn("w", words).select("toxic", "half", F.explode(zipped).alias("c"))
                .select("toxic", "half", "c.*").where(F.col("word").isNotNull()).distinct())
    cells = [f"n{toxic}{half}" for toxic in (0, 1) for half in (0, 1)]
    counts = cut_lineage(contexts.groupBy("word").agg(*[
        F.sum(((F.col("toxic") == int(c[1])) & (F.col("half") == int(c[2]))).cast("long")).alias(c) for c in cells]))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cells]).first()
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(WINDOW)),
                      lambda i: F.concat(F.array_join(F.slice("w", i, WINDOW), " "), F.lit(" ")))
    pieces = cut_lineage(some.where("toxic = 0").withColumn("w", words).select("half", F.explode(cut).alias("p"))
                         .where((F.octet_length("p") <= LONGEST) & (F.length("p") > 1)).distinct())
    ordinary = [[r[0].encode() for r in bounded_sample(pieces.where(F.col("half") == h).select("p"), SAMPLE_WINDOWS // 2,
                                                       F.col("p")).collect()] for h in (0, 1)]
    out = []
    for halves in ((0,), (1,), (0, 1)):
        t, o = (sum((F.col(f"n{k}{h}") for h in halves), F.lit(0.5)) for k in (1, 0))
        all_t, all_o = (sum(total[f"n{k}{h}"] for h in halves) + 1 for k in (1, 0))
        odds = F.log(t / all_t) - F.log(o / all_o) - 2 * F.sqrt(1 / t + 1 / o)
        telling = (counts.where((t > 3) & (F.octet_length("word") <= LONGEST)).withColumn("odds", odds)
                   .where(F.col("odds") > MIN_ODDS).orderBy(F.desc("odds"), "word").limit(PASSAGES).select("word"))
        out.append(Distance([w for h in halves for w in ordinary[h]], [r[0].encode() for r in telling.collect()][::-1]))
    return out


class Model:
    """A pair of dictionaries and the curve over their features; ``curve`` is None without labels."""

    def __init__(self, distance: Distance, curve: np.ndarray | None):
        self.distance, self.curve = distance, curve

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        x = features(texts, self.distance)
        if self.curve is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          rows: int = SAMPLE_ROWS) -> Model:
    marked = (labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = dict(marked.groupBy("toxic").count().collect())  # two rows
    ids = [bounded_sample(marked.where(F.col("toxic") == k), rows, F.col("doc_id")) for k in (0, 1)]
    ids = cut_lineage(ids[0].union(ids[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))))
    # at most 2 * rows narrow rows are broadcast
    some = cut_lineage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
                       .join(F.broadcast(ids), "doc_id"))
    *halves, both = _learn(some)
    if not total:
        return Model(both, None)

    def measure(batches):
        for b in batches:
            half, out = np.asarray(b.column(1)), np.zeros((b.num_rows, 3))
            for k in (0, 1):
                out[half == k] = features(b.column(0).filter(pa.array(half == k)).to_pylist(), halves[1 - k])
            yield pa.RecordBatch.from_arrays([b.column(2), *[pa.array(c) for c in out.T]], names=["toxic", "a", "b", "c"])

    table = some.select("text", F.col("half").cast("int"), "toxic").mapInArrow(
        measure, "toxic int, a double, b double, c double")
    got = np.array([tuple(r) for r in table.orderBy("toxic", "a", "b", "c").collect()], float).reshape(-1, 4)
    n = {k: max(1, (got[:, 0] == k).sum()) for k in (0, 1)}
    weight = np.array([total.get(int(k), 0) / n[int(k)] for k in got[:, 0]])
    if not len(got) or set(total) != {0, 1}:  # labelled ids without a row, or one kind of label
        return Model(both, np.array([30.0 if 0 not in total else -30.0, 0, 0, 0]))
    return Model(both, _curve(got[:, 1:], got[:, 0], weight * len(got) / weight.sum()))


def score(text: Column, model: Model) -> Column:
    """Score between 0 and 1 of a text; higher is likelier toxic."""
    return F.arrow_udf(lambda texts: pa.array(np.round(model.scores(texts.to_pylist()), 6)), "double")(text)
