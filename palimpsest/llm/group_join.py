"""Operator 1, n-gram Jaccard join over a token-group matrix: exact components of similar documents.

A document's set holds the distinct hashes of its 5-word shingles; two documents link when
``100 * |A & B| >= 80 * |A | B|``.  Documents of equal sets are one class, and classes are compared:

1. Every class sends its prefix: of n tokens the first ``n - ceil(0.8 n) + 1`` in one global order, in
   which tokens seen often come last.  Linked classes share a prefix token in any such order, so the
   choice of often-seen tokens changes the cost, never the result.
2. Groups: a class is compared with one leader, the class among those it meets that has the fewest rare
   tokens.  Classes that link to leaders form groups, cut into chunks of about ``CHUNK`` classes.
3. Token-group matrix: one cell for every prefix token and group whose members hold it (their token
   union).  Joining the classes' tokens to the matrix and counting gives, for each class and group, the
   largest overlap that any member can have: the count, plus what lies behind the prefix.  Groups of a
   class's own component are left out, tokens seen in one component only are left out.
4. Only groups whose bound reaches the required overlap are opened, and their members are compared with
   the class on their full sets.
5. Components of all links by alternating stars; ids are the smallest doc_id of the component.

No step gathers the documents of a token, group or component: postings are counted and joined, texts
travel only for pairs whose bound holds, and lists are streamed in sorted order.  Hashes are 64 bits wide.

Defined cases: no words or null text: n_shingles 0, component_id is the document's own id; fewer than five
words: the whole sequence is the one token; null ids: compared like others, a component's id is the smallest
id that is not null (null if there is none); repeated rows: one class, each row is returned; empty table:
empty result; extra columns are ignored by ``join`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import components, cut_lineage, free_name, in_small_batches, mix64, narrow_ids, word_arrays

SHINGLE = 5
CHUNK = 64
OFTEN = 32  # classes that make a token an often-seen one
OFTEN_MOST = 200_000  # tokens kept as often-seen (8 bytes each, sent to every task)
LOCAL_TOKENS = 1 << 22  # tokens counted at once in a task
SALTS = 32  # parts that the postings of an often-seen token are dealt in


def token_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of every text."""
    for _, n, words in word_arrays(texts, lower=True):
        grams, _ = words.windows(SHINGLE)
        for k in range(n):
            a, b = words.first[k], words.first[k + 1]
            if b - a >= SHINGLE:
                g = np.sort(grams[a:b - SHINGLE + 1])
                yield g[np.r_[True, g[1:] != g[:-1]]]
            elif b > a:
                h = np.uint64(b - a)
                for x in words.hash[a:b]:
                    h = mix64((np.array([h]) + x) * np.uint64(0x9E3779B97F4A7C15))[0]
                yield np.array([h])
            else:
                yield np.empty(0, np.uint64)


def _class(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, n, c) of every document; (token, seen) of tokens seen often by this task."""
    held, size, known = [], 0, set()

    def often():
        tokens, seen = np.unique(np.concatenate(held), return_counts=True)
        at = seen >= 4
        none = pa.nulls(int(at.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none] * 4 + [pa.array(tokens[at].view(np.int64)), pa.array(seen[at])],
                                          names=["doc_id", "h", "n", "c", "token", "seen"])

    for batch in batches:
        n, c = [], []
        for tokens in token_sets(batch.column(1)):
            n.append(len(tokens))
            c.append(_class(tokens))
            if len(tokens) and c[-1] not in known:
                known.add(c[-1])
                held.append(tokens)
                size += len(tokens)
                if size >= LOCAL_TOKENS:
                    yield often()
                    held, size, known = [], 0, set()
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                                          pa.array(c, pa.int64()), none, none],
                                         names=["doc_id", "h", "n", "c", "token", "seen"])
    if held:
        yield often()


def _prefixes(often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            rows, prefix, stars = [], [], []
            for tokens in token_sets(batch.column(0)):
                n, c = len(tokens), _class(tokens)
                if not n or c in known:  # a class is sent once by a task
                    continue
                if len(known) >= 1_000_000:
                    known.clear()
                known.add(c)
                late = often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] == tokens if len(often) else \
                    np.zeros(n, bool)
                length = n - (4 * n + 4) // 5 + 1
                own = tokens[~late][:length]
                rest = tokens[late][:length - len(own)]
                prefix.append(np.r_[own, rest].view(np.int64))
                stars.append(np.r_[np.zeros(len(own), bool), np.ones(len(rest), bool)])
                rows.append((c, n, int(n - late.sum())))
            if rows:
                c, n, rare = (pa.array(x, pa.int64()) for x in zip(*rows))
                ends = pa.array(np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [c, n, rare, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefix))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(stars)))],
                    names=["c", "n", "rare", "tokens", "often"])
    return run


def _needed(a: Column, b: Column) -> Column:
    """Smallest overlap that links sets of sizes a and b: ceil(80 (a + b) / 180)."""
    return F.floor((4 * (a + b) + 8) / 9)


def _behind(n: Column) -> Column:
    """Tokens behind the prefix: ceil(0.8 n) - 1."""
    return F.floor((4 * n + 4) / 5) - 1


def _salt(often: Column) -> Column:
    """What sets the parts of an often-seen token (1, else 0) apart; the same again takes it off."""
    return F.when(often == 1, F.xxhash64(F.pmod("c", F.lit(SALTS)))).otherwise(F.lit(0).cast("long"))


def _near(a: Column, b: Column) -> Column:
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, c, text) sorted by q, the query's own row first: links that hold on the full sets."""
    q, mine = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            qs, cs, links = part.column(0).to_pylist(), part.column(1).to_pylist(), []
            for a, b, tokens in zip(qs, cs, token_sets(part.column(2))):
                if _class(tokens) != b:  # another row with the same id
                    continue
                if a == b:
                    q, mine = a, tokens
                elif a == q:
                    both = np.concatenate([mine, tokens])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= 80 * (len(both) - shared):
                        links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b)`` of the pairs ``(q, d)`` that link; texts are fetched by the classes' representatives."""
    pairs = cut_lineage(pairs)
    need = pairs.select("q", F.col("d").alias("c")).union(pairs.select("q", F.col("q").alias("c"))).distinct()
    reps = cut_lineage(classes.join(need.select("c").distinct(), "c", "left_semi").select("c", "rep"))
    found = (texts.join(narrow_ids(reps), F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "text"))
    rows = (need.join(found, "c").select("q", "c", "text").repartition("q")
            .sortWithinPartitions("q", (F.col("q") == F.col("c")).desc(), "c"))
    return cut_lineage(rows.mapInArrow(_compare, "a long, b long"))


def _h(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`"))


def classes_and_roots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``sets(doc_id, h, n, c)``, a row a document (h: hash of its text), and ``roots(c, root, component_id)``, a
    row a class with tokens."""
    texts = in_small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    measured = cut_lineage(docs.select(F.col(f"`{doc_id}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit("")), _h(text))
                           .mapInArrow(_measure, "doc_id long, h long, n long, c long, token long, seen long"))
    sets = measured.where("n IS NOT NULL").select("doc_id", "h", "n", "c")
    classes = cut_lineage(sets.where("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("rep")))
    often = (measured.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
             .where(F.col("seen") >= OFTEN).orderBy(F.desc("seen"), "token").limit(OFTEN_MOST))
    often = np.sort(np.array([r[0] for r in often.select("token").collect()], np.int64).view(np.uint64))

    prefix = texts.select("text").mapInArrow(
        _prefixes(often), "c long, n long, rare long, tokens array<long>, often array<boolean>")
    # a posting is three longs: the token (an often-seen one moved on by the salt of its class), the class, and
    # its sizes packed; they are dealt out before anything else is computed from them
    token, seen = F.col("t.tokens"), F.col("t.often").cast("long")
    post = (prefix.select("c", "n", "rare", F.explode(F.arrays_zip("tokens", "often")).alias("t"))
            .select(token.bitwiseXOR(_salt(seen)).alias("key"), "c",
                    (F.shiftleft("n", 32) + F.shiftleft("rare", 1) + seen).alias("packed"))
            .repartition("key"))
    seen, size = F.col("packed") % 2, F.shiftright("packed", 32)
    rare = F.shiftright("packed", 1) % (1 << 31)
    one = Window.partitionBy("key")
    met = (post.withColumn("lead", F.min(F.struct(rare.alias("rare"), size.alias("m"), "c")).over(one))
           .withColumn("last", F.max("c").over(one)).withColumn("first", F.min("c").over(one))
           .where((seen == 1) | (F.col("first") < F.col("last")))
           .select("key", "c", "packed", "lead").distinct())  # by the key they are dealt by: nothing moves
    met = cut_lineage(met.select(
        F.col("key").bitwiseXOR(_salt(seen)).alias("token"), "c",
        (F.shiftleft(size, 1) + seen).alias("n_often"), F.col("lead.c").alias("d"),
        (F.shiftleft("lead.rare", 32) + F.col("lead.m")).alias("rare_m")))
    met = met.select("token", "c", F.shiftright("n_often", 1).alias("n"), (F.col("n_often") % 2 == 1).alias("often"), "d",
                     "rare_m")
    lead = F.struct("rare_m", "d")
    late = met.where("often").groupBy("token").agg(F.min(lead).alias("lead"))  # at most OFTEN_MOST rows
    led = (met.where("NOT often").select("c", "n", lead.alias("lead")).union(
        met.where("often").join(F.broadcast(late), "token").select("c", "n", "lead"))
        .select("c", "n", F.col("lead.d").alias("d"), (F.col("lead.rare_m") % (1 << 32)).alias("m")).where("c <> d"))

    # groups: each class against the leader it shares most tokens with, if the bound allows a link
    counted = led.groupBy("c", "n", "d", "m").agg(F.count(F.lit(1)).alias("k"))
    n, m = F.col("n"), F.col("m")
    hopeful = counted.where(_near(n, m) & (F.col("k") + F.greatest(_behind(n), _behind(m)) >= _needed(n, m)))
    best = hopeful.groupBy("c").agg(F.max(F.struct("k", "d")).alias("best"))
    first = _verified(best.select(F.col("c").alias("q"), F.col("best.d").alias("d")), texts, classes)
    grouped = components(first)
    member = cut_lineage(classes.select("c", "n").join(grouped.withColumnRenamed("node", "c"), "c", "left")
                         .withColumn("root", F.coalesce("root", "c")))
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = (member.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / CHUNK)))
               .select("c", "n", "root", "size", F.xxhash64("root", "part").alias("g")))
    members = cut_lineage(members)
    groups = members.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))

    # matrix: one cell for a token and a group that holds it; queries meet it token by token
    rows = met.select("token", "c").join(members, "c").select("token", "c", "n", "root", "size", "g")
    across = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    rows = cut_lineage(rows.join(across.select("token"), "token", "left_semi"))
    matrix = (rows.select("token", "g", F.col("root").alias("root_g"), F.col("size").alias("size_g")).distinct()
              .join(groups, "g").withColumnRenamed("token", "token_g"))
    queries = rows.select("token", "c", "n", "root", "size")
    met_groups = queries.join(matrix, (F.col("token") == F.col("token_g"))
                              & ((F.col("size") < F.col("size_g"))
                                 | ((F.col("size") == F.col("size_g")) & (F.col("root") < F.col("root_g"))))
                              & (5 * F.col("hi") >= 4 * F.col("n")) & (5 * F.col("n") >= 4 * F.col("lo")))
    cells = met_groups.groupBy("c", "n", "g", "lo", "hi").agg(F.count(F.lit(1)).alias("k"))
    lo, hi = F.greatest(F.col("lo"), F.floor((4 * n + 4) / 5)), F.least(F.col("hi"), F.floor(5 * n / 4))
    opened = cells.where(F.col("k") + F.greatest(_behind(n), _behind(hi)) >= _needed(n, lo))
    inside = members.select("g", F.col("c").alias("d"), F.col("n").alias("m"))
    pairs = (opened.select("c", "n", "g", "k").join(inside, "g").where(
        _near(n, m) & (F.col("k") + F.greatest(_behind(n), _behind(m)) >= _needed(n, m)))
        .select(F.col("c").alias("q"), "d"))
    second = _verified(pairs, texts, classes)

    joined = components(first.union(second))
    by_root = (classes.join(joined.withColumnRenamed("node", "c"), "c", "left")
               .select("c", "rep", F.coalesce("root", "c").alias("root")))
    ids = by_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    return sets, cut_lineage(by_root.join(ids, "root").select("c", "root", "component_id"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    sets, roots = classes_and_roots(docs, doc_id, text)
    out = sets.where("n > 0").join(roots, "c", "left").select("doc_id", "n", "component_id").union(
        sets.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest id (of equal ids, the smallest
    hash of the text; of equal rows, any).  Documents without words all stay.
    """
    sets, roots = classes_and_roots(docs, doc_id, text)
    rows = cut_lineage(sets.where("n > 0").join(roots, "c").select("root", "doc_id", "h"))
    head = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("head"))
    marked = rows.join(head, "root").select("doc_id", "h", F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
                                            .alias("same_id"), (F.col("h") == F.col("head.h")).alias("same_text"))
    i, nth = free_name(docs, "_gone"), free_name(docs, "_nth")
    gone = marked.where("NOT (same_id AND same_text)").select(F.struct("doc_id", "h").alias(i)).distinct()
    here = (F.col(f"`{doc_id}`").cast("long"), _h(text))
    out = docs.join(gone, here[0].eqNullSafe(F.col(f"{i}.doc_id")) & (here[1] == F.col(f"{i}.h")), "left_anti")
    if marked.where("same_id AND same_text").groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        words = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        once = Window.partitionBy(*here).orderBy(F.lit(0))
        out = out.where(words).withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(nth).union(
            out.where(~words))
    return out


# The same result in DuckDB SQL, by comparing all documents that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM sizes UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON b.x = reach.y)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles,
       CASE WHEN z.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
FROM words d LEFT JOIN sizes z ON z.r = d.r
LEFT JOIN (SELECT reach.x, min(w.doc_id) AS component_id FROM reach JOIN words w ON w.r = reach.y GROUP BY reach.x) c
  ON c.x = d.r
"""
