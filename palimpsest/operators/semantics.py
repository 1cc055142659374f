"""Labels, entity lookup, text and vector similarity.

The reference asks a language model for entities and text vectors.  No model ships here, so:

* entities (G2) come from a *gazetteer* DataFrame ``(term, code)`` joined to the text's word sequences; the
  codes are mapped to labels by the reference's fixed code map.  The join is a broadcast only after
  the gazetteer's size has been checked;
* text similarity (G3) is the cosine of term-frequency vectors, computed in long form: tokens of both sides
  are exploded once, counted per ``(pair, token)`` and side, and summed.
  A long text spreads over many tasks (the shuffle key includes the token), and all sums are
  integers until the final division, so every engine gets the same bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, has_label_unit, has_number
from ..session import broadcast_if_small

# ---- fixed values: entity code -> label, as in the reference ----------------------------------
ENTITY_LABELS = {
    "PER": "person",
    "ORG": "organization",
    "LOC": "place",
    "GPE": "location",
    "DATE": "date",
    "MONEY": "amount",
    "PERCENT": "percent",
    "TIME": "time",
    "NUM": "number",
    "PRODUCT": "product",
    "WORK_OF_ART": "title/work",
}
# -----------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens (Python ``text.lower().split()``)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"{WS_CLASS}+"), lambda x: x != "")


def entity_code_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in ENTITY_LABELS.items() for x in kv])


# Between bare words: everything but letters and digits, with white space in it.  It begins where such a run begins, so a
# long run without white space is looked at once.
_OTHER = r"[^a-z0-9\p{L}\p{N}]"
_BETWEEN = rf"(?=[^a-z0-9])(?<!{_OTHER})[{_OTHER}&&[^{WS_CLASS[1:-1]}]]*+(?:[ \n]|{WS_CLASS}){_OTHER}*+"


def bare_tokens(text: Column) -> Column:
    """Lower-cased words without the punctuation around them ("France," is "france")."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.filter(F.split(padded, _BETWEEN), lambda t: t != "")


def entity_labels(texts: DataFrame, keys: Sequence[str], text_col: str, gazetteer: DataFrame) -> DataFrame:
    """``(*keys, entity_labels ARRAY<STRING>)`` for rows with at least one known entity.

    ``gazetteer`` has ``term`` (one or more words, matched case-insensitively against consecutive words, whatever
    punctuation stands around them) and ``code``; codes outside the reference's map are dropped, as the
    reference drops them."""
    label = F.element_at(entity_code_map(), F.col("code"))
    gz = (gazetteer.select(bare_tokens(F.col("term")).alias("words"), label.alias("label"))
          .filter(F.col("label").isNotNull() & (F.size("words") > 0))
          .select(F.array_join("words", " ").alias("term"), F.size("words").alias("n"), "label").distinct())
    lengths = [r[0] for r in gz.select("n").distinct().collect()]      # numbers of words in a term
    words = texts.select(*keys, bare_tokens(F.col(text_col)).alias("_w"))

    def grams(n: int) -> Column:
        if n == 1:
            return F.col("_w")
        places = F.sequence(F.lit(0), F.size("_w") - n)
        gram = lambda i: F.concat_ws(" ", *[F.get("_w", i + k) for k in range(n)])
        return F.when(F.size("_w") >= n, F.transform(places, gram)).otherwise(F.array().cast("array<string>"))
    found = [grams(n) for n in lengths]
    if not found:
        return words.select(*keys, F.array().cast("array<string>").alias("entity_labels")).limit(0)
    terms = words.select(*keys, F.explode(F.array_distinct(F.concat(*found))).alias("term"))
    hits = terms.join(broadcast_if_small(gz.select("term", "label")), "term")
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("entity_labels"))


def label_union(text: Column, entity: Column | None = None) -> Column:
    """G1: entity labels + ``unit`` (E4) + ``numbers`` (E5), distinct and sorted."""
    ent = F.coalesce(entity, F.array().cast("array<string>")) if entity is not None else F.array().cast("array<string>")
    extra = F.array(F.when(has_label_unit(text), F.lit("unit")), F.when(has_number(text), F.lit("numbers")))
    return F.array_sort(F.array_distinct(F.concat(ent, F.array_compact(extra))))


def tf_cosine(pairs: DataFrame, keys: Sequence[str], old_col: str, new_col: str) -> DataFrame:
    """``(*keys, dot, norm_old, norm_new, similarity)`` for every row of ``pairs``.

    ``similarity`` is 0.0 when either side is blank (no tokens), as the reference.  ``keys`` name a row.
    One explode of both sides: a token row knows its side, tokens are counted per side, and a pair without
    tokens keeps one row, so ``pairs`` is read once."""
    keys = list(keys)
    side = lambda col, name: F.transform(tokens(F.col(col)), lambda t: F.struct(t.alias("tok"), F.lit(name).alias("side")))
    rows = pairs.select(*keys, F.explode_outer(F.concat(side(old_col, "o"), side(new_col, "n"))).alias("t"))
    count = lambda name: F.sum(F.when(F.col("t.side") == name, 1).otherwise(0))
    per = rows.groupBy(*keys, F.col("t.tok").alias("tok")).agg(count("o").alias("a"), count("n").alias("b"))
    sums = per.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("norm_old"),
                                  F.sum(F.col("b") * F.col("b")).alias("norm_new"))
    sim = F.when((F.col("norm_old") == 0) | (F.col("norm_new") == 0), F.lit(0.0)) \
        .otherwise(F.col("dot").cast("double") / F.sqrt((F.col("norm_old") * F.col("norm_new")).cast("double")))
    return sums.select(*keys, "dot", "norm_old", "norm_new", sim.alias("similarity"))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two stored vectors (element order of the sums fixed: left to right)."""
    da = F.transform(a, lambda x: x.cast("double"))
    db = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(F.transform(da, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    nb = F.aggregate(F.transform(db, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


# ---- mean vectors ---------------------------------------------------------------------------------
VECTOR_DIMS = 32   # one for each hexadecimal digit of a token's MD5
NEAR = 2           # neighbours to either side that count
VECTOR_SCALE = 1000


def token_vectors(texts: DataFrame, text_col: str) -> DataFrame:
    """``(tok, vec ARRAY<BIGINT>)`` of every token of a corpus, by random projection of its neighbours.

    A neighbour ``u`` stands for ``VECTOR_DIMS`` signs, plus where the hexadecimal digit of ``md5(u)`` is 8 or more; its
    signs are the bits of one number, taken once a token of a text.  Each place of a token adds its neighbours' plus signs
    and their number to the token's sums before the shuffle, so what moves is one row a token and task, not one a pair
    of neighbours.  All sums are integers, so every partitioning gives the same bits.  A token without neighbours has the
    zero vector."""
    w = texts.select(tokens(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    signs = lambda t: F.conv(F.translate(F.md5(t), "0123456789abcdef", "0" * 8 + "1" * 8), 2, 10).cast("bigint")
    w = w.select("w", F.transform("w", signs).alias("b"))
    offsets = [o for o in range(-NEAR, NEAR + 1) if o]
    place = lambda i: F.struct(F.get("w", i).alias("tok"), *[
        F.when(i + o >= 0, F.get("b", i + o)).alias(f"b{k}") for k, o in enumerate(offsets)])
    rows = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), place)).alias("p")).select("p.*")
    near = [F.col(f"b{k}") for k in range(len(offsets))]
    total = lambda parts: F.sum(reduce(Column.__add__, parts))
    plus = [total([F.shiftright(F.coalesce(c, F.lit(0).cast("bigint")), VECTOR_DIMS - 1 - d).bitwiseAND(1) for c in near])
            .alias(f"s{d}") for d in range(VECTOR_DIMS)]
    sums = rows.groupBy("tok").agg(total([c.isNotNull().cast("bigint") for c in near]).alias("n"), *plus)
    each = [F.when(F.col("n") == 0, F.lit(0)).otherwise(
        F.floor((2 * F.col(f"s{d}") - F.col("n")) * F.lit(float(VECTOR_SCALE)) / F.col("n"))).cast("bigint") for d in range(VECTOR_DIMS)]
    return sums.select("tok", F.array(*each).alias("vec"))


def mean_vectors(points: DataFrame, keys: Sequence[str], text_col: str, vectors: DataFrame) -> DataFrame:
    """``(*keys, n_tokens, total ARRAY<BIGINT>, mean ARRAY<DOUBLE>)``, the mean of a text's token vectors; zeros for
    a text without tokens.  Tokens are counted per text before they meet their vectors; unknown ones count as zeros."""
    keys = list(keys)
    tf = (points.select(*keys, F.explode_outer(tokens(F.col(text_col))).alias("tok"))
          .groupBy(*keys, "tok").agg(F.count("tok").alias("w")))
    part = lambda d: F.coalesce(F.sum(F.col("w") * F.get("vec", F.lit(d))), F.lit(0)).alias(f"s{d}")
    # values are within VECTOR_SCALE: two bytes each; sums are taken where all tokens of a text are, not sent there
    short = vectors.select("tok", F.col("vec").cast("array<smallint>").alias("vec"))
    met = tf.join(short, "tok", "left").repartition(*keys)
    sums = met.groupBy(*keys).agg(F.sum("w").alias("n_tokens"), *[part(d) for d in range(VECTOR_DIMS)])
    total = F.array(*[F.col(f"s{d}") for d in range(VECTOR_DIMS)])
    mean = F.transform("total", lambda x: F.when(F.col("n_tokens") == 0, F.lit(0.0)).otherwise(x.cast("double") / F.col("n_tokens")))
    return sums.select(*keys, "n_tokens", total.alias("total")).withColumn("mean", mean)


def text_for_vector(old_text: Column, new_text: Column) -> Column:
    """``(new.text or old.text or '').strip()``."""
    from ..functions.text import ustrip
    return ustrip(F.coalesce(F.nullif(new_text, F.lit("")), F.nullif(old_text, F.lit("")), F.lit("")))
