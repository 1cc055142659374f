"""Operator 8, line dedup by a log-template tree of fixed depth; DataFrame functions only.

A line's tokens are its words; a word with a digit is a variable field (``<*>``).  The tree's first level is the
number of tokens, the second a path of tokens:

* the first ``LEAD`` tokens.  Inside such a leaf a position is a variable field too when no token stands there in at
  least ``CONSTANT`` of the leaf's distinct lines; a template is the line with its variable fields starred;
* the leading half of the tokens, for one variable field in the trailing half, and the trailing half, for one in
  the leading half.  Inside such a leaf lines are grouped by all tokens but one: lines that differ in one position
  only are a group, whatever other templates share the path, and that position is its field.

A template that would keep less than ``SIMILAR`` of its tokens counts for nothing, so lines that merely share a path
are not merged.  A line recurs when itself or a template of it occurs in ``MIN_DOCS`` documents or more; recurring
lines are dropped.

Every line is tokenised once and written with its hashes; later steps read the narrow columns, and texts only for
distinct lines of leaves that hold several.  A line that recurs by itself makes its templates recur, so only lines of
fewer than ``MIN_DOCS`` documents are joined to templates and no hot line is.

Defined cases: a null or empty text has no lines; blank lines are neither counted nor dropped; rows equal in
id and text are one document; an empty table gives an empty result; ``dedup`` keeps extra columns whatever
their names; a document whose lines all go keeps an empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name
from palimpsest.session import broadcast_if_small, cut_lineage, ensure_checkpoint_dir

LEAD = 3
MIN_DOCS = 2
CONSTANT = 0.5
SIMILAR = 0.7
FIELD = "<*>"
_GAP = r"[ \t\x0B\f\r]+"


def _document(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc, line, s)`` of every line with a word, numbered from 0; ``s`` has its tokens, one space between."""
    cut = docs.select(_document(doc_id, text).alias("doc"),
                      F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("line", "s"))
    # of the line as it stands: asked of the rewritten one, the filter would go below the rewriting and do it twice
    cut = cut.where(F.col("s").rlike(r"[^ \t\x0B\f\r]"))
    # the rarer a rewriting, the cheaper the test for it
    starred = F.when(F.col("s").rlike("[0-9]"), F.regexp_replace("s", r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)).otherwise(F.col("s"))
    single = F.when(F.col("s").rlike(r"[\t\x0B\f\r]|  |^ | $"), F.trim(F.regexp_replace("s", _GAP, " "))).otherwise(F.col("s"))
    return cut.withColumn("s", starred).withColumn("s", single)


def _written(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The lines as a table in the shared folder: ``(doc, line, plain, n, lead, front, back, s)``."""
    t = F.col("t")
    rows = _lines(docs, doc_id, text).withColumn("t", F.split("s", " "))
    n = F.size(t)
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc", "line", F.xxhash64("s").alias("plain"), n.alias("n"),
                       F.xxhash64(n, F.slice(t, 1, LEAD)).alias("lead"),
                       F.xxhash64(n, F.lit("front"), F.slice(t, F.lit(1), half)).alias("front"),
                       F.xxhash64(n, F.lit("back"), F.slice(t, half + 1, n)).alias("back"), "s")
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/lines-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _members(lines: DataFrame, path: str) -> DataFrame:
    """Distinct lines ``(leaf, plain, t)`` of the leaves that hold several, long enough for a variable field."""
    some = lines.where(F.col("n") - 1 >= SIMILAR * F.col("n")).select(F.col(path).alias("leaf"), "plain")
    leaves = some.groupBy("leaf").agg((F.min("plain") < F.max("plain")).alias("several")).where("several").select("leaf")
    own = lines.select(F.col(path).alias("leaf"), "plain", "s").join(broadcast_if_small(cut_lineage(leaves)), "leaf", "left_semi")
    return own.groupBy("leaf", "plain").agg(F.first("s").alias("s")).select("leaf", "plain", F.split("s", " ").alias("t"))


def _by_position(lines: DataFrame) -> DataFrame:
    """``(template, plain)`` of leaves by leading tokens: positions without a constant token are fields."""
    distinct = cut_lineage(_members(lines, "lead").select("leaf", "plain", F.array_join("t", " ").alias("s")))
    distinct = distinct.select("leaf", "plain", F.split("s", " ").alias("t"))
    at = distinct.select("leaf", F.posexplode("t").alias("pos", "token"))
    share = (at.groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf", "pos")
             .agg((F.max("n") / F.sum("n")).alias("top")))
    fields = (share.where(F.col("top") < CONSTANT).groupBy("leaf")
              .agg(F.sort_array(F.collect_list("pos")).alias("fields")))  # at most a line's positions
    starred = F.transform("t", lambda x, i: F.when(F.array_contains("fields", i), F.lit(FIELD)).otherwise(x))
    constant = F.size("t") - F.size(F.filter("starred", lambda x: x == FIELD))
    return (distinct.join(fields, "leaf").withColumn("starred", starred).where(constant >= SIMILAR * F.size("t"))
            .select(F.xxhash64("leaf", "starred").alias("template"), "plain"))


def _but_one(lines: DataFrame, path: str) -> DataFrame:
    """``(template, plain)`` of leaves by one half of the tokens: lines equal but for one position of the other half."""
    rows = _members(lines, path).withColumn("h", F.transform("t", lambda x, i: F.xxhash64(i, x)))
    n = F.size("t")
    rows = rows.select("plain", n.alias("n"), F.floor(n / 2).cast("int").alias("half"),
                       F.size(F.filter("t", lambda x: x != FIELD)).alias("constant"), "t", "h",
                       F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)).alias("all"))
    open_ = F.col("pos") >= F.col("half") if path == "front" else F.col("pos") < F.col("half")
    at = rows.select("plain", "n", "half", "constant", "all", F.posexplode(F.arrays_zip("t", "h")).alias("pos", "x"))
    rest = F.col("constant") - (F.col("x.t") != FIELD).cast("int")
    # all positions' hashes but one, in one step a position
    return at.where(open_ & (rest >= SIMILAR * F.col("n"))).select(
        F.xxhash64(F.lit("but one"), "n", "pos", F.col("all").bitwiseXOR(F.col("x.h"))).alias("template"), "plain")


def recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS
              ) -> tuple[DataFrame, DataFrame]:
    """``lines(doc, line, plain)`` of all documents, and the ``plain`` lines that recur, themselves or by a template."""
    lines = _written(docs, doc_id, text)
    pairs = lines.select("plain", "doc").distinct()
    counted = cut_lineage(pairs.groupBy("plain").agg(F.count(F.lit(1)).alias("n")))
    often = counted.where(F.col("n") >= min_docs).select("plain")
    named = cut_lineage(_by_position(lines).union(_but_one(lines, "front")).union(_but_one(lines, "back")))
    by_line = named.join(counted, "plain")
    sure = by_line.where(F.col("n") >= min_docs).select("template").distinct()
    rest = by_line.where(F.col("n") < min_docs).select("template", "plain")
    several = (rest.join(pairs, "plain").select("template", "doc").distinct().groupBy("template")
               .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template"))
    templated = named.join(sure.union(several).distinct(), "template", "left_semi").select("plain")
    return lines.select("doc", "line", "plain"), cut_lineage(often.union(templated).distinct())


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped)`` of every document; ``dropped`` lists line numbers, from 0."""
    lines, often = recurring(docs, doc_id, text, min_docs)
    per = (lines.join(broadcast_if_small(often.withColumn("often", F.lit(True))), "plain", "left").groupBy("doc")
           .agg(F.count_distinct("line").alias("n_lines"),
                F.sort_array(F.collect_set(F.when(F.col("often"), F.col("line")))).alias("gone")))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _document(doc_id, text).alias("doc")).distinct()
    return rows.join(per, "doc", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.concat_ws(",", F.col("gone").cast("array<string>")), F.lit("")).alias("dropped"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines of recurring templates."""
    lines, often = recurring(docs, doc_id, text, min_docs)
    d, g = free_name(docs, "_doc"), free_name(docs, "_gone")
    gone = (lines.join(often, "plain", "left_semi").groupBy("doc")
            .agg(F.collect_set("line").alias("gone")).select(F.col("doc").alias(d), F.col("gone").alias(g)))
    kept = F.when(F.col(g).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(
        F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains(g, i)), "\n"))
    out = docs.withColumn(d, _document(doc_id, text)).join(gone, d, "left")
    return out.select(*[kept.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns])


# The same result in DuckDB SQL; {lead}, {min_docs}, {constant} and {similar} are filled in.
SQL = r"""
WITH lines AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, n - 1 AS line,
         list_transform(list_filter(string_split_regex(s, '[ \t\x0B\f\r]+'), lambda x: x <> ''),
                        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s,
               generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM (SELECT DISTINCT doc_id, text FROM documents))),
paths AS (SELECT *, [CAST(len(tokens) AS VARCHAR)] || tokens[1:{lead}] AS leaf FROM lines WHERE len(tokens) > 0),
plain AS (SELECT DISTINCT leaf, tokens FROM paths),
places AS (SELECT leaf, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM plain),
share AS (SELECT leaf, pos, max(n) / sum(n) AS top
          FROM (SELECT leaf, pos, token, count(*) AS n FROM places GROUP BY ALL) GROUP BY leaf, pos),
fields AS (SELECT leaf, list(pos) AS f FROM share WHERE top < {constant} GROUP BY leaf),
starred AS (SELECT tokens, list_transform(tokens, lambda x, i: CASE WHEN list_contains(f, i) THEN '<*>' ELSE x END) AS s
            FROM plain JOIN fields USING (leaf)),
butone AS (SELECT tokens, pos, len(list_filter(tokens, lambda x: x <> '<*>')) - CAST(token <> '<*>' AS INT) AS rest,
                  tokens[1:pos - 1] || ['<*>'] || tokens[pos + 1:] AS s FROM places),
named AS (SELECT tokens, 'plain' AS kind, 0 AS pos, tokens AS template FROM plain
          UNION ALL SELECT tokens, 'leaf', 0, s FROM starred
                    WHERE len(list_filter(s, lambda x: x <> '<*>')) >= {similar} * len(tokens)
          UNION ALL SELECT tokens, 'but one', pos, s FROM butone WHERE rest >= {similar} * len(tokens)),
often AS (SELECT kind, pos, template FROM paths JOIN named USING (tokens)
          GROUP BY kind, pos, template HAVING count(DISTINCT (doc_id, h)) >= {min_docs}),
dropped AS (SELECT DISTINCT tokens FROM named SEMI JOIN often USING (kind, pos, template)),
gone AS (SELECT doc_id, h, line FROM paths SEMI JOIN dropped USING (tokens)),
per AS (SELECT doc_id, h, count(*) AS n_dropped, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS dropped
        FROM gone GROUP BY doc_id, h),
total AS (SELECT doc_id, h, count(*) AS n_lines FROM paths GROUP BY doc_id, h)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped
FROM (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS h FROM documents) d
LEFT JOIN total t ON t.doc_id IS NOT DISTINCT FROM d.doc_id AND t.h = d.h
LEFT JOIN per p ON p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.h = d.h
""".replace("{lead}", str(LEAD)).replace("{min_docs}", str(MIN_DOCS)).replace("{constant}", str(CONSTANT)).replace(
    "{similar}", str(SIMILAR))
