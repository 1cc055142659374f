"""Operator 4, secret scans: character Markov models of random strings and of ordinary words.

Two order-one models over characters are trained from labelled samples: random strings (the values
that the fixed patterns find in the sample, and strings drawn evenly over the usual alphabets) and
ordinary words (the sample's other words, in the cases that identifiers use, and joined as
identifiers join them; numbers and dates; repeated characters).  A token of ``MIN_TOKEN`` or more characters whose
log-likelihood ratio is ``MIN_RATIO`` or more a character adds a span of kind ``random``, of whatever
characters it is made.  The spans of the fixed patterns stay.

Bounds: the models are fitted on ``SAMPLE_ROWS`` documents (those with the smallest hash of the
id), on ``SAMPLE_WORDS`` words of each drawn at random, and collected as one table of character
pairs; the scan covers every whole text, in place, without a shuffle.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; an empty table
gives an empty result (and models from the drawn strings alone); extra columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_sample

# The base patterns, in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so a shorter one cannot hide a longer one

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_TOKEN = 16
MIN_RATIO = 0.9
SAMPLE_ROWS = 500
SAMPLE_WORDS = 200
DRAWN = 400  # drawn strings of each alphabet
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_INDEX = {c: i + 1 for i, c in enumerate(_ALPHABET)}  # 0: anything else, and the start of a token
_N = len(_ALPHABET) + 1
_RANDOM_ALPHABETS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
                     string.ascii_letters + string.digits + "_-", "0123456789abcdef", "0123456789ABCDEF",
                     string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits,
                     string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase, "0123456789abcdef--"]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns as (start, end, kind), code points, end exclusive."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _overlap(spans: list[tuple[int, int, str]]):
    """Whether a stretch meets one of the spans, in the logarithm of their number."""
    begins = sorted(s[:2] for s in spans)
    ends = list(itertools.accumulate((b for _, b in begins), max))
    firsts = [a for a, _ in begins]

    def meets(start: int, end: int) -> bool:
        k = bisect.bisect_left(firsts, end)
        return k > 0 and ends[k - 1] > start
    return meets


def _pairs(token: str, counts: np.ndarray, weight: float = 1.0) -> None:
    before = 0
    for c in token:
        at = _INDEX.get(c, 0)
        counts[before, at] += weight
        before = at


def _ordinary(words: list[str], rng: random.Random) -> list[str]:
    """Words as identifiers spell them, decimal numbers alone and joined as in dates, and repeated characters."""
    out = []
    for w in words:
        out += [w, w.lower(), w.upper(), w.capitalize()]
    for _ in range(len(words) // 4):
        parts = [w.lower() for w in rng.sample(words, 3)]
        out += ["_".join(parts), "-".join(parts), "/".join(parts), "".join(p.capitalize() for p in parts),
                "_".join(parts).upper(), f"{parts[0]}{rng.randrange(100)}"]
    signs = "+/_=-"
    out += [c * 40 for c in signs] + [(rng.choice(signs) + rng.choice(signs)) * 10, rng.choice(string.ascii_letters) * 20]
    out += [sign.join(f"{rng.randrange(10 ** k):0{k}}" for k in rng.choices((1, 2, 2, 3, 4), k=6)) for sign in "/_-"]
    return out + [str(rng.randrange(10 ** rng.randint(1, 18))) for _ in range(max(100, len(words) // 10))]


def sample_counts(texts: list[str], counts: np.ndarray) -> None:
    """Adds the character pairs of labelled tokens: ``counts[1]`` random strings, ``counts[0]`` others."""
    rng = random.Random(7)
    for text in texts:
        meets = _overlap(base_spans(text))
        words = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{2,}", text):
            if meets(*m.span()):
                if m.end() - m.start() >= MIN_TOKEN:
                    _pairs(m[0], counts[1])
            else:
                words.append(m[0])
        if len(words) >= 3:
            for w in _ordinary(rng.sample(words, min(len(words), SAMPLE_WORDS)), rng):
                _pairs(w, counts[0])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-likelihood ratio (random against ordinary) of every character pair."""
    some = bounded_sample(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                                      F.col(f"`{doc_id}`").alias("i")), rows, F.col("i")).select("t")

    def count(batches):
        counts = np.zeros((2, _N, _N))
        for b in batches:
            sample_counts(b.column(0).to_pylist(), counts)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)) for a in at] + [pa.array(counts[at])], names=["k", "a", "b", "n"])

    table = some.mapInArrow(count, "k int, a int, b int, n double").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, _N, _N))
    for k, a, b, n in table.collect():  # at most 2 * 70 * 70 cells
        counts[k, a, b] = n
    rng = random.Random(11)
    share = max(1.0, counts[1].sum() / (DRAWN * 30 * len(_RANDOM_ALPHABETS)))  # drawn strings weigh as much as found
    for alphabet in _RANDOM_ALPHABETS:
        for _ in range(DRAWN):
            _pairs("".join(rng.choices(alphabet, k=rng.randint(16, 44))), counts[1], share)
    counts += 0.5
    log = np.log(counts / counts.sum(axis=2, keepdims=True))
    return log[1] - log[0]


def ratio(token: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio a character."""
    at = [0, *[_INDEX.get(c, 0) for c in token]]
    return float(model[at[:-1], at[1:]].mean())


def random_spans(text: str, model: np.ndarray, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that look drawn at random, outside the spans already taken."""
    out, meets = [], _overlap(taken)
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if meets(s, e):
            continue
        if ratio(m[0], model) >= MIN_RATIO:
            out.append((s, e, "random"))
    return out


def listed(spans: list[tuple[int, int, str]], kinds: list[str]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, kinds.index(k), k, e) for s, e, k in spans))


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(text: Column, model: np.ndarray) -> Column:
    """Struct of ``FIELDS`` of a text."""
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            t = t or ""
            base = base_spans(t)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((*n, hashlib.sha256(listed(base, KINDS).encode()).hexdigest(),
                         listed(base + random_spans(t, model, base), KINDS)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          [f.split()[0] for f in FIELDS.split(", ")])

    return F.arrow_udf(run, FIELDS)(text)
