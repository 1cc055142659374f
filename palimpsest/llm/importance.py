"""Operator 6, quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models over ``BUCKETS`` hashed tokens (words and runs of punctuation) and token pairs:
the target model from documents labelled good, the raw model from every whole document of the corpus.  A
document's weight is the mean log of target over raw likelihood of its n-grams, stated for ``TYPICAL``
n-grams (a plain sum lets the models' small errors add up in long documents).  Weight plus Gumbel noise (from the id and text, so
reruns agree) is its key, and the ``k`` largest keys are a sample without replacement by weight.

``k`` is the share of good labels times the number of documents, unless given.  The k-th key is found by
counting keys digit by digit (16 bits a step, at most 65,536 counts), so no sort and no single task.

Bounds: the target model takes at most ``LABELLED`` good documents (smallest hash of the id), broadcast as
ids; each task sends one count a bucket.  Raw counts cover all documents.

Defined cases: a null or empty text has weight 0; repeated rows get equal keys and are kept or left together
(so a tie at the k-th key may keep more than k); with no good label there is nothing to aim at and all is
kept; an empty table gives an empty result; extra columns pass through ``resample``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_sample, cut_lineage, free_name, in_small_batches, unit_interval, word_arrays

BUCKETS = 1 << 14
LABELLED = 20_000
TYPICAL = 100  # n-grams that a document's weight is stated for


def _grams(words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text each belongs to."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    pairs, inside = words.windows(2)
    at = np.r_[words.hash, pairs[inside]] % np.uint64(BUCKETS)
    return at.astype(np.int64), np.r_[owner, owner[:len(pairs)][inside]]


def _counts(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, words in word_arrays(batch.column(0), lower=False, punctuation=True):
                total += np.bincount(_grams(words)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n  # at most BUCKETS rows
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          labelled: int = LABELLED) -> np.ndarray:
    """Log ratio of every bucket's share in the target and in the raw text."""
    good = bounded_sample(labels.where(F.col(label) == 1).select(F.col("doc_id").alias("_good"))
                          .where("_good IS NOT NULL").distinct(), labelled, F.col("_good"))
    target = _counts(docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").alias("i"))
                     .join(F.broadcast(good), F.col("i") == F.col("_good"), "left_semi").select("t"))
    if not target.any():
        return np.zeros(BUCKETS)
    raw = _counts(docs.select(F.col(f"`{text}`").alias("t")))
    share = [(c + 1) / (c.sum() + BUCKETS) for c in (target, raw)]
    return np.log(share[0]) - np.log(share[1])


def weight(text: Column, model: np.ndarray) -> Column:
    """Log importance weight of a text."""
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for at, n, words in word_arrays(texts, lower=False, punctuation=True):
            buckets, owner = _grams(words)
            total, size = np.bincount(owner, weights=model[buckets], minlength=n), np.bincount(owner, minlength=n)
            out[at:at + n] = TYPICAL * total / np.maximum(size, 1)
        return pa.array(out)

    return F.arrow_udf(run, "double")(text)


def kth_largest(keys: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a long column, None when there are no more than k rows.

    Counts by the top 16 bits, then the next 16 inside the right one, and so on.
    """
    if k >= keys.count():
        return None
    high, rest = None, keys.select((F.col(col)).alias("v"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("v", shift) if shift else F.col("v")
        counts = {r[0]: r[1] for r in rest.groupBy(digit.alias("d")).agg(F.count(F.lit(1))).collect()}
        for d in sorted(counts, reverse=True):
            if k <= counts[d]:
                high = d
                break
            k -= counts[d]
        rest = rest.where(digit == high)
    return high


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             k: int | None = None) -> DataFrame:
    """The rows of ``docs`` in the sample, with a struct ``importance`` of ``log_weight`` and ``gumbel_key``."""
    name = free_name(in_small_batches(docs), "importance")
    model = train(docs, labels, doc_id, text, label)
    w = docs.select("*", weight(F.col(f"`{text}`"), model).alias(name))
    noise = -F.log(-F.log(unit_interval(F.lit("gumbel"), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))))
    w = w.withColumn(name, F.struct(F.col(name).alias("log_weight"), (F.col(name) + noise).alias("gumbel_key")))
    order = F.floor(F.col(f"{name}.gumbel_key") * (1 << 20))  # steps of a millionth, as a long
    keys = cut_lineage(w.select(order.alias("v")))
    if k is None:
        row = labels.agg(F.avg((F.col(label) == 1).cast("double")), F.count(label)).first()
        share = row[0] if row[0] is not None else 1.0
        k = int(np.ceil(share * keys.count())) if model.any() else keys.count()
    least = kth_largest(keys, "v", k)
    return w if least is None else w.where(order >= F.lit(least))
