"""Operator 10, quality rules: rule failures by host, shrunk with an empirical beta prior.

1. Every document is measured over its whole text (words, symbols, repeated lines and windows).
2. ``base_failed`` is final.  The soft rules (symbol share, repeated lines, shouting, odd word length)
   only count as failures; failures and documents are summed by host.
3. For every rule a beta prior is fitted to the hosts' rates by moments, each host's rate is shrunk
   to it, and the host is condemned for the rule when even the low end of its posterior (mean less
   two standard deviations) is above ``max_rate``.
4. Host verdicts join back: a document goes when it breaks a rule that its host is condemned for.
   A document that breaks no rule stays, whatever its host.

Defined cases: a null or empty text has no words (all counts 0, base_failed); null hosts are one host;
repeated rows are counted and judged one by one; an empty table gives an empty result; extra columns
pass through ``judge`` untouched, whatever their names.

The texts are read twice (rates, verdicts) and never shuffled: only one row per host and task moves.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage, free_name, in_small_batches, narrow_ids, utf8, word_arrays

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words"]
SOFT_RULES = ["many_symbols", "many_dup_lines", "shouting", "odd_words"]
MAX_RATE = 0.5
WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER_LOW = np.zeros(256, bool)
_LETTER_LOW[ord("a"):ord("z") + 1] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more in ``words``, the first included."""
    grams = [tuple(words[i:i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    seen = Counter(grams)
    covered = np.zeros(len(words), bool)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered[i:i + WINDOW] = True
    return int(covered.sum())


def dup_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def _measure(texts: pa.Array) -> pa.Array:
    texts = texts.fill_null("") if texts.null_count else texts
    raw, offsets = utf8(texts)
    out = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    out["n_symbols"] = _per_text(_SYMBOLS[raw], offsets)
    for at, n, words in word_arrays(texts, lower=False):
        first, here = words.first, slice(at, at + n)
        out["n_words"][here] = np.diff(first)
        lo = offsets[at]
        span = raw[lo:offsets[at + n]]
        starts = np.zeros(len(span) + 1, np.int64)  # code points = bytes that do not continue one
        np.cumsum((span & 0xC0) != 0x80, out=starts[1:])
        chars = np.zeros(len(words.start) + 1, np.int64)
        np.cumsum(starts[words.end] - starts[words.start], out=chars[1:])
        out["word_chars"][here] = chars[first[1:]] - chars[first[:-1]]
        up, low = (np.zeros(len(span) + 1, np.int64) for _ in range(2))
        np.cumsum(_UPPER[span], out=up[1:])
        np.cumsum(_LETTER_LOW[span], out=low[1:])
        shout = ((up[words.end] - up[words.start]) > 1) & (low[words.end] == low[words.start])
        out["n_upper_words"][here] = _per_text(shout, first)
        grams, inside = words.windows(WINDOW)
        for k in range(n):
            lo_w, hi_w = first[k], first[k + 1] - WINDOW + 1
            if hi_w - lo_w < 2:
                continue
            g = np.sort(grams[lo_w:hi_w])
            if (g[1:] == g[:-1]).any():  # only texts with a repeated window are counted word by word
                out["n_repeat_words"][at + k] = repeated_words(texts[at + k].as_py().encode().split())
    for i, text in enumerate(texts.to_pylist()):
        out["n_dup_lines"][i], out["n_lines"][i] = dup_lines(text)
    return pa.StructArray.from_arrays([pa.array(out[m]) for m in MEASURES], MEASURES)


def measures(text: Column) -> Column:
    """Struct of ``MEASURES`` of a text."""
    return F.arrow_udf(_measure, ", ".join(f"{m} long" for m in MEASURES))(text)


def _base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def _soft(m: str) -> dict[str, Column]:
    c = lambda name: F.col(f"{m}.{name}")
    return {
        "many_symbols": 10 * c("n_symbols") > c("word_chars"),
        "many_dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "shouting": 10 * c("n_upper_words") > 5 * c("n_words"),
        "odd_words": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }


def host_verdicts(failures: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``failures(host, n, <rule>...)``, one row a host, becomes ``(host, bad_<rule>...)``.

    Beta prior by moments over the hosts: mean m and variance v of the rates give a strength
    m(1-m)/v - 1, at least 1.  The fit is one aggregate row, so hosts may be many.
    """
    rates = failures.select("host", "n", *SOFT_RULES)
    fit = rates.agg(*[F.avg(F.col(r) / F.col("n")).alias(f"m_{r}") for r in SOFT_RULES],
                    *[F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in SOFT_RULES])
    out = rates.crossJoin(F.broadcast(fit))  # one row on the right
    bad = []
    for r in SOFT_RULES:
        m = F.least(F.greatest(F.col(f"m_{r}"), F.lit(1e-6)), F.lit(1 - 1e-6))
        strength = F.greatest(m * (1 - m) / F.greatest(F.col(f"v_{r}"), F.lit(1e-9)) - 1, F.lit(1.0))
        a, b = m * strength + F.col(r), (1 - m) * strength + F.col("n") - F.col(r)
        mean = a / (a + b)
        bad.append((mean - 2 * F.sqrt(mean * (1 - mean) / (a + b + 1)) > max_rate).alias(f"bad_{r}"))
    return out.select("host", *bad)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with a struct ``quality``: the measures, ``base_failed`` and ``kept``.

    If ``docs`` has a column of that name already, the struct takes the name with a leading ``_``.
    """
    docs = in_small_batches(docs)
    name, key = free_name(docs, "quality"), free_name(docs, "_host")
    counts = docs.select(F.col(f"`{host}`").alias("host"), measures(F.col(f"`{text}`")).alias("m"))
    failures = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(c.cast("long")).alias(r) for r, c in _soft("m").items()])
    # verdicts are broadcast when hosts are few enough (counted), so the texts stay where they are
    verdicts = narrow_ids(cut_lineage(host_verdicts(failures, max_rate))).select(F.struct("*").alias(key))
    own = docs.withColumn(name, measures(F.col(f"`{text}`")))
    own = own.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col(f"{key}.host")), "left")
    broken = F.lit(False)
    for r, c in _soft(name).items():
        broken = broken | (F.coalesce(F.col(f"{key}.bad_{r}"), F.lit(False)) & c)
    failed = _base_failed(name)
    return own.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        *[F.col(f"{name}.{m}").alias(m) for m in MEASURES], failed.alias("base_failed"),
        (~failed & ~broken).alias("kept")).alias(name))


# The result of the registered query in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
          FROM (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4))),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM grams, range(5) AS o(k) WHERE n > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper
      FROM w LEFT JOIN covered c ON c.r = w.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > word_chars AS f1,
             10 * n_dup_lines > 3 * n_lines AS f2, 10 * n_upper > 5 * n_words AS f3,
             word_chars < 2 * n_words OR word_chars > 15 * n_words AS f4 FROM m),
h AS (SELECT source, k, count(*) AS n, count(*) FILTER (WHERE b) AS x
      FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS b FROM f) GROUP BY source, k),
fit AS (SELECT k, least(greatest(avg(x / n), 1e-6), 1 - 1e-6) AS mu, var_pop(x / n) AS v FROM h GROUP BY k),
post AS (SELECT source, k, mu * s + x AS a, (1 - mu) * s + n - x AS b
         FROM (SELECT h.*, mu, greatest(mu * (1 - mu) / greatest(v, 1e-9) - 1, 1.0) AS s FROM h JOIN fit USING (k))),
bad AS (SELECT source, max(k = 1 AND z) AS b1, max(k = 2 AND z) AS b2, max(k = 3 AND z) AS b3, max(k = 4 AND z) AS b4
        FROM (SELECT source, k, a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS z FROM post)
        GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (b1 AND f1 OR b2 AND f2 OR b3 AND f3 OR b4 AND f4) AS kept
FROM f JOIN bad ON bad.source IS NOT DISTINCT FROM f.source
"""
