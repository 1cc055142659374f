"""D1 + E7 (+ G3 counts): character-level diff of changed text pairs -> ``struct(ratio, inline_html[, similarity])``.

The Arrow kernel returns only the matching blocks of a pair, ``array<struct<a,b,n>>`` in order.  The ratio
(twice the matched length over both lengths) and the ``<del>/<ins>`` markup are column expressions over the
blocks, so a query that never reads the markup never builds it.  Token counts for the term-frequency cosine
come from a second, separate kernel that runs only when asked for.

Native short-circuits keep most rows out of Python: equal texts (ratio 1.0, markup = escaped text),
both empty (1.0) and one side empty (0.0, markup = one tag).
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_escape

BLOCKS_TYPE = "array<struct<a:int,b:int,n:int>>"
TOKENS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in ("dot", "norm_old", "norm_new")])


def token_products(a: str, b: str) -> tuple[int, int, int]:
    """``(sum tf_a*tf_b, sum tf_a^2, sum tf_b^2)`` over ``lower().split()`` tokens."""
    ca = Counter(a.lower().split())
    cb = Counter(b.lower().split())
    dot = sum(v * cb.get(t, 0) for t, v in ca.items())
    return dot, sum(v * v for v in ca.values()), sum(v * v for v in cb.values())


def matching_blocks(a: str, b: str, autojunk: bool = True) -> list[tuple[int, int, int]]:
    """Runs of equal characters ``(start in a, start in b, length)``, in order."""
    return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=autojunk).get_matching_blocks() if m.size]


def _make_kernels(autojunk: bool):
    @F.pandas_udf(BLOCKS_TYPE)
    def blocks(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else
                          [dict(zip("abn", m)) for m in matching_blocks(x, y, autojunk)] for x, y in zip(a, b)])

    @F.pandas_udf(TOKENS_TYPE)
    def products(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None or y is None else token_products(x, y) for x, y in zip(a, b)]
        return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") for i, c in enumerate(TOKENS_TYPE.names)})

    return blocks.asNondeterministic(), products.asNondeterministic()


_KERNELS: dict[bool, tuple] = {}


def kernels(autojunk: bool = True):
    if autojunk not in _KERNELS:
        _KERNELS[autojunk] = _make_kernels(autojunk)
    return _KERNELS[autojunk]


def _tagged(tag: str, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(f"<{tag}>"), html_escape(text), F.lit(f"</{tag}>"))).otherwise("")


def _cut(text: Column, start: Column, stop: Column) -> Column:
    return text.substr(start + 1, stop - start)


def blocks_ratio(blocks: Column, a: Column, b: Column) -> Column:
    """E7 from the blocks of two texts of which one at least is not empty."""
    matched = F.aggregate(blocks, F.lit(0), lambda total, m: total + m["n"])
    return F.lit(2.0) * matched / (F.length(a) + F.length(b))


def blocks_markup(blocks: Column, a: Column, b: Column) -> Column:
    """D1 from the blocks: before each block what only one side has, then the block; an empty block at the
    ends of both texts closes the list."""
    end = F.struct(F.length(a).alias("a"), F.length(b).alias("b"), F.lit(0).alias("n"))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))
    before, after = F.concat(F.array(start), blocks), F.concat(blocks, F.array(end))
    parts = F.zip_with(before, after, lambda p, m: F.concat(
        _tagged("del", _cut(a, p["a"] + p["n"], m["a"])), _tagged("ins", _cut(b, p["b"] + p["n"], m["b"])),
        html_escape(_cut(a, m["a"], m["a"] + m["n"]))))
    return F.array_join(parts, "")


def with_text_diff(df: DataFrame, old_text: Column, new_text: Column, out: str = "diff", autojunk: bool = True,
                   with_tokens: bool = False) -> DataFrame:
    """Adds ``out = struct(ratio, inline_html[, similarity])`` for two strings (nulls read as ``""``).

    Each kernel is evaluated once per row into a helper column (marked non-deterministic, so Catalyst
    neither copies it into pushed-down filters nor merges references).  Rows that the native short-circuits
    settle pass nulls and are skipped in Python."""
    a = F.coalesce(old_text, F.lit(""))
    b = F.coalesce(new_text, F.lit(""))
    nonempty = (F.length(a) > 0) & (F.length(b) > 0)
    blocks, products = kernels(autojunk)
    raw, tok = f"_{out}_blocks", f"_{out}_tokens"
    needs = nonempty & (a != b)
    d = df.withColumn(raw, blocks(F.when(needs, a), F.when(needs, b)))
    if with_tokens:
        d = d.withColumn(tok, products(F.when(nonempty, a), F.when(nonempty, b)))
    k = F.col(raw)
    ratio = (F.when(a == b, F.lit(1.0))
             .when(~nonempty, F.lit(0.0))
             .otherwise(blocks_ratio(k, a, b)))
    inline = (F.when(a == b, html_escape(a))
              .when(~nonempty, F.concat(_tagged("del", a), _tagged("ins", b)))
              .otherwise(blocks_markup(k, a, b)))
    fields = [ratio.alias("ratio"), inline.alias("inline_html")]
    if with_tokens:
        na, nb = F.col(f"{tok}.norm_old"), F.col(f"{tok}.norm_new")
        sim = F.when(F.coalesce(na, F.lit(0)) * F.coalesce(nb, F.lit(0)) == 0, F.lit(0.0)) \
            .otherwise(F.col(f"{tok}.dot").cast("double") / F.sqrt((na * nb).cast("double")))
        fields.append(sim.alias("similarity"))
    return d.withColumn(out, F.struct(*fields)).drop(raw, tok)


def strip_markup(inline: Column, keep: str) -> Column:
    """Invariant of D1: dropping ``<ins>`` runs and unwrapping ``<del>`` gives ``escape(old)``
    (``keep='old'``); the mirror gives ``escape(new)``."""
    drop, unwrap = ("ins", "del") if keep == "old" else ("del", "ins")
    out = F.regexp_replace(inline, rf"(?s)<{drop}>.*?</{drop}>", "")
    return F.regexp_replace(out, rf"</?{unwrap}>", "")
