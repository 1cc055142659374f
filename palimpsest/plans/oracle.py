"""DuckDB oracle SQL for the registered queries (same column names and types as ``plans.queries``).

Written independently of the Spark code, over the pre-registered views (``documents``, ``orders``,
...).  The sequence alignment, on blocks and on characters, is a recursive query of its own.
"""

from __future__ import annotations

from ..sources import fixtures as V
from ..sources.routing import READERS, UNSUPPORTED

# Patterns of this file, from the rules themselves: an edge of a word is a side where no letter, digit or
# underscore stands; a white-space character is one that Python strips.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                             0x202F, 0x205F, 0x3000]))
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WS_CHARS) + "]"
EDGE_L, EDGE_R, INNER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)", r"[\p{L}\p{N}_]"
DIGIT_RE = r"\p{Nd}"
SCORE_UNIT_RE_RE2 = rf"(?i){EDGE_L}(?:pln|eur|kw|km|kg|cm|mm|m){EDGE_R}|{INNER}%{INNER}"
YEAR_RE = rf"{EDGE_L}(?:19|20)\p{{Nd}}\p{{Nd}}{EDGE_R}"
LABEL_UNIT_RE = rf"{EDGE_L}(?:km|kg|cm|mm|m){EDGE_R}|{INNER}%{INNER}"
NUMBER_RE = rf"{EDGE_L}\p{{Nd}}+{EDGE_R}"
LEGAL_RE = rf"{INNER}§{INNER}|{EDGE_L}(?:dz\.u|art|pkt|poz|ust)\.{INNER}"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def _kept_lines(text: str) -> str:
    return (f"list_filter(list_transform(string_split(translate(coalesce({text}, ''), chr(13), chr(10)), chr(10)), "
            f"lambda x: trim(x, {WS_SQL})), lambda x: x <> '')")


def _revision_ctes() -> str:
    h = f"((doc_id * 31 + (i - 1) * 7) % {V.V1_H_MOD})"
    revise = (f"CASE WHEN doc_id % {V.V1_KEEP} = 0 THEN [x] "
              f"WHEN {h} = {V.V1_H_DROP} THEN []::VARCHAR[] "
              f"WHEN {h} = {V.V1_H_UNIT} THEN [x || {_lit(V.V1_UNIT_SUFFIX)}] "
              f"WHEN {h} = {V.V1_H_ARTICLE} THEN [replace(x, ' the ', ' a ')] "
              f"WHEN {h} = {V.V1_H_PREFIX} THEN [{_lit(V.V1_PREFIX)} || x] "
              f"WHEN {h} = {V.V1_H_INSERT} THEN [x, {_lit(V.V1_INSERT)} || CAST(i - 1 AS VARCHAR)] "
              f"ELSE [x] END")
    return f"""
dl AS (SELECT doc_id, {_kept_lines('text')} AS kl FROM documents),
old_docs AS (SELECT doc_id, kl FROM dl WHERE doc_id % 19 <> 0),
new_docs AS (SELECT doc_id, flatten(list_transform(kl, lambda x, i: {revise})) AS kl
             FROM dl WHERE doc_id % 17 <> 0 OR doc_id % 19 = 0),
old_blocks AS (SELECT doc_id, CAST(generate_subscripts(kl, 1) - 1 AS INTEGER) AS block_pos, unnest(kl) AS text
               FROM old_docs),
new_blocks AS (SELECT doc_id, CAST(generate_subscripts(kl, 1) - 1 AS INTEGER) AS block_pos, unnest(kl) AS text
               FROM new_docs),
old_keys AS (SELECT doc_id, count(*) AS n, list('paragraph:' || text ORDER BY block_pos) AS keys
             FROM old_blocks GROUP BY doc_id),
new_keys AS (SELECT doc_id, count(*) AS n, list('paragraph:' || text ORDER BY block_pos) AS keys
             FROM new_blocks GROUP BY doc_id),
status AS (
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.doc_id IS NOT NULL AS in_old, n.doc_id IS NOT NULL AS in_new,
         coalesce(ok.n, 0) AS n_old, coalesce(nk.n, 0) AS n_new,
         CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.doc_id IS NULL THEN 'added'
              WHEN coalesce(ok.keys, []::VARCHAR[]) = coalesce(nk.keys, []::VARCHAR[]) THEN 'unchanged'
              ELSE 'changed' END AS status
  FROM old_docs o FULL OUTER JOIN new_docs n ON o.doc_id = n.doc_id
  LEFT JOIN old_keys ok ON ok.doc_id = coalesce(o.doc_id, n.doc_id)
  LEFT JOIN new_keys nk ON nk.doc_id = coalesce(o.doc_id, n.doc_id))"""


def _mixed_ctes() -> str:
    """``_revision_ctes`` over documents of lines, a table and an image: a block's ``text`` is its key, ``size`` the
    rows of a table or the bytes of an image."""
    new_q = "CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END"
    def side(name: str, cells: str, html: str) -> str:
        return f"""
{name}_c AS ({cells}),
{name[0]}c AS ({_unpivot(name + '_c')}),
{name}_tab AS (SELECT doc_id, 'table:' || string_agg(c0 || ',' || c1 || ',' || c2, '|' ORDER BY r) AS text, count(*) AS size
               FROM {name}_c GROUP BY doc_id HAVING bool_or(c0 <> '' OR c1 <> '' OR c2 <> '')),
{name}_img AS (SELECT page_id AS doc_id, 'image:' || sha1({html}) AS text, CAST(strlen({html}) AS BIGINT) AS size FROM pages),
{name}_n AS (SELECT doc_id, len(kl) AS n FROM {name}_docs),
{name}_blocks AS (
  SELECT doc_id, block_pos, 'paragraph:' || text AS text, 'paragraph' AS type, CAST(NULL AS BIGINT) AS size FROM {name}_lines
  UNION ALL SELECT t.doc_id, CAST(n AS INTEGER), text, 'table', size FROM {name}_tab t JOIN {name}_n USING (doc_id)
  UNION ALL SELECT i.doc_id, CAST(n + CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER), i.text, 'image', i.size
            FROM {name}_img i JOIN {name}_n USING (doc_id) LEFT JOIN {name}_tab t ON t.doc_id = i.doc_id)"""
    rev = _revision_ctes()
    at = rev.index("old_keys AS")
    lines = rev[:at].replace("old_blocks AS", "old_lines AS").replace("new_blocks AS", "new_lines AS").rstrip().rstrip(",")
    new_html = "CASE WHEN page_id % 3 = 0 THEN html || 'x' ELSE html END"
    return (lines + "," + side("old", _line_cells("", "l_quantity"), "html") + ","
            + side("new", _line_cells("WHERE l_suppkey % 13 <> 0", new_q), new_html) + ",\n" + rev[at:])


_MIXED_ENTRIES = """,
mixed AS (SELECT e.doc_id, e.entry_idx, e.change, e.old_pos, e.new_pos, e.old_text, e.new_text, o.type AS o_type,
                 CASE WHEN e.change <> 'unchanged' THEN n.type END AS n_type, o.size AS o_size, n.size AS n_size,
                 CASE e.change WHEN 'added' THEN n.type WHEN 'changed' THEN coalesce(n.type, o.type) ELSE o.type END AS type
          FROM entries e LEFT JOIN old_blocks o ON o.doc_id = e.doc_id AND o.block_pos = e.old_pos
          LEFT JOIN new_blocks n ON n.doc_id = e.doc_id AND n.block_pos = e.new_pos)"""


def _frontier_sql(x: str, pairs: str, a: str, b: str) -> str:
    """Recursive CTE ``{x}seg(pid, kind, alo, ahi, blo, bhi)``: the matching blocks and gaps of
    ``SequenceMatcher(None, a, b)`` (autojunk included) for every ``pid`` of ``pairs(pid, n_old, n_new)``
    (both sides non-empty), from ``a(pid, i, k)`` and ``b(pid, j, k)``.  Each round, per active range:
    the longest run of consecutive matches on one diagonal whose key is not popular in ``b`` (more than
    ``len(b)//100 + 1`` occurrences once ``len(b) >= 200``), ties to the smallest ``i`` then ``j``; the run
    is extended through equal elements; the range splits around it."""
    return f""",
{x}nbn AS (SELECT pid, count(*) AS n FROM {b} GROUP BY pid),
{x}kc AS (SELECT pid, k, count(*) AS c FROM {b} GROUP BY pid, k),
{x}nb AS (SELECT b.pid, b.j, b.k, NOT (nbn.n >= 200 AND kc.c > nbn.n // 100 + 1) AS seed
       FROM {b} b JOIN {x}nbn nbn ON nbn.pid = b.pid JOIN {x}kc kc ON kc.pid = b.pid AND kc.k = b.k),
{x}seg(pid, kind, alo, ahi, blo, bhi) AS (
  SELECT pid, 'range', 0, n_old, 0, n_new FROM {pairs}
  UNION ALL
  (WITH r AS (SELECT pid, alo, ahi, blo, bhi FROM {x}seg WHERE kind = 'range'),
   m AS (SELECT r.pid, r.alo, o.i, n.j, o.i - n.j AS d
         FROM r JOIN {a} o ON o.pid = r.pid AND o.i >= r.alo AND o.i < r.ahi
                JOIN {x}nb n ON n.pid = r.pid AND n.j >= r.blo AND n.j < r.bhi AND n.k = o.k AND n.seed),
   isl AS (SELECT pid, alo, d, i, j, i - row_number() OVER (PARTITION BY pid, alo, d ORDER BY i) AS g FROM m),
   islands AS (SELECT pid, alo, min(i) AS si, min(j) AS sj, count(*) AS slen FROM isl GROUP BY pid, alo, d, g),
   best AS (SELECT pid, alo, si, sj, slen FROM (
              SELECT *, row_number() OVER (PARTITION BY pid, alo ORDER BY slen DESC, si, sj) AS rn FROM islands)
            WHERE rn = 1),
   rb AS (SELECT r.pid, r.alo, r.ahi, r.blo, r.bhi, coalesce(b.si, r.alo) AS si, coalesce(b.sj, r.blo) AS sj,
                 coalesce(b.slen, 0) AS slen
          FROM r LEFT JOIN best b ON b.pid = r.pid AND b.alo = r.alo),
   cmp AS (SELECT rb.pid, rb.alo, o.i, rb.si, rb.slen, (n.k IS NULL OR n.k <> o.k) AS bad
           FROM rb JOIN {a} o ON o.pid = rb.pid AND o.i >= rb.alo AND o.i < rb.ahi
                            AND (o.i < rb.si OR o.i >= rb.si + rb.slen)
           LEFT JOIN {x}nb n ON n.pid = rb.pid AND n.j = o.i - (rb.si - rb.sj) AND n.j >= rb.blo AND n.j < rb.bhi),
   ext AS (SELECT pid, alo, max(CASE WHEN i < si THEN i END) AS bb, min(CASE WHEN i >= si + slen THEN i END) AS ba
           FROM cmp WHERE bad GROUP BY pid, alo),
   mt0 AS (SELECT rb.pid, rb.alo, rb.ahi, rb.blo, rb.bhi, rb.si - rb.sj AS d,
                  greatest(coalesce(e.bb + 1, rb.alo), rb.alo, rb.blo + (rb.si - rb.sj)) AS mi,
                  least(coalesce(e.ba, rb.ahi), rb.ahi, rb.bhi + (rb.si - rb.sj)) AS me
           FROM rb LEFT JOIN ext e ON e.pid = rb.pid AND e.alo = rb.alo),
   mt AS (SELECT pid, alo, ahi, blo, bhi, least(mi, me) AS mi, least(mi, me) - d AS mj, me - least(mi, me) AS k
          FROM mt0)
   SELECT pid, 'match', mi, mi + k, mj, mj + k FROM mt WHERE k > 0
   UNION ALL SELECT pid, 'gap', alo, ahi, blo, bhi FROM mt WHERE k = 0
   UNION ALL SELECT pid, CASE WHEN mi > alo AND mj > blo THEN 'range' ELSE 'gap' END, alo, mi, blo, mj
             FROM mt WHERE k > 0 AND (mi > alo OR mj > blo)
   UNION ALL SELECT pid, CASE WHEN ahi > mi + k AND bhi > mj + k THEN 'range' ELSE 'gap' END, mi + k, ahi, mj + k, bhi
             FROM mt WHERE k > 0 AND (ahi > mi + k OR bhi > mj + k)))"""


def _alignment_ctes() -> str:
    """The reference's block alignment in SQL (after ``_revision_ctes``); gives ``entries``: doc_id,
    entry_idx, change, old_pos, new_pos, old_text, new_text, type."""
    return f""",
chg AS (SELECT doc_id AS pid, n_old, n_new FROM status WHERE status = 'changed' AND n_old > 0 AND n_new > 0),
ob AS (SELECT doc_id AS pid, block_pos AS i, text AS k FROM old_blocks WHERE doc_id IN (SELECT pid FROM chg)),
nb0 AS (SELECT doc_id AS pid, block_pos AS j, text AS k FROM new_blocks WHERE doc_id IN (SELECT pid FROM chg))
{_frontier_sql('blk_', 'chg', 'ob', 'nb0')},
segs AS (
  SELECT pid AS doc_id, alo AS i, blo AS j, ahi - alo AS lo, bhi - blo AS ln, kind = 'match' AS is_match
  FROM blk_seg WHERE kind IN ('match', 'gap')
  UNION ALL SELECT doc_id, 0, 0, n_old, n_new, status = 'unchanged' FROM status
            WHERE n_old + n_new > 0 AND (status <> 'changed' OR n_old = 0 OR n_new = 0)),
ops AS (SELECT *, CASE WHEN is_match THEN lo ELSE greatest(lo, ln) END AS w,
               coalesce(sum(CASE WHEN is_match THEN lo ELSE greatest(lo, ln) END) OVER (
                 PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
        FROM segs),
ent0 AS (SELECT doc_id, i, j, lo, ln, is_match, base, unnest(range(w)) AS t FROM ops WHERE w > 0),
entries AS (
  SELECT e.doc_id, CAST(e.base + e.t AS INTEGER) AS entry_idx,
         CASE WHEN e.is_match THEN 'unchanged' WHEN e.t < e.lo AND e.t < e.ln THEN 'changed'
              WHEN e.t < e.lo THEN 'deleted' ELSE 'added' END AS change,
         CAST(CASE WHEN e.t < e.lo THEN e.i + e.t END AS INTEGER) AS old_pos,
         CAST(CASE WHEN e.t < e.ln THEN e.j + e.t END AS INTEGER) AS new_pos,
         o.text AS old_text, CASE WHEN NOT e.is_match THEN n.text END AS new_text, 'paragraph' AS type
  FROM ent0 e
  LEFT JOIN old_blocks o ON o.doc_id = e.doc_id AND e.t < e.lo AND o.block_pos = e.i + e.t
  LEFT JOIN new_blocks n ON n.doc_id = e.doc_id AND e.t < e.ln AND n.block_pos = e.j + e.t)"""


def _ratio_ctes() -> str:
    """Character-level ratio of every changed entry (after ``_alignment_ctes``): ``ratios(doc_id,
    entry_idx, ratio)`` = ``2 * matched / (len(old) + len(new))``, 1.0 when both are empty."""
    return f""",
cp AS (SELECT doc_id, entry_idx, doc_id * 1000000 + entry_idx AS pid, coalesce(old_text, '') AS ot,
              coalesce(new_text, '') AS nt FROM entries WHERE change = 'changed'),
cpp AS (SELECT pid, length(ot) AS n_old, length(nt) AS n_new FROM cp
        WHERE ot <> nt AND length(ot) > 0 AND length(nt) > 0),
ca AS (SELECT pid, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS k
       FROM (SELECT pid, string_split(ot, '') AS s FROM cp WHERE pid IN (SELECT pid FROM cpp))),
cb AS (SELECT pid, generate_subscripts(s, 1) - 1 AS j, unnest(s) AS k
       FROM (SELECT pid, string_split(nt, '') AS s FROM cp WHERE pid IN (SELECT pid FROM cpp)))
{_frontier_sql('chr_', 'cpp', 'ca', 'cb')},
matched AS (SELECT pid, sum(ahi - alo) AS m FROM chr_seg WHERE kind = 'match' GROUP BY pid),
ratios AS (
  SELECT cp.doc_id, cp.entry_idx,
         CASE WHEN cp.ot = cp.nt THEN 1.0::DOUBLE
              WHEN length(cp.ot) = 0 OR length(cp.nt) = 0 THEN 0.0::DOUBLE
              ELSE 2.0::DOUBLE * CAST(coalesce(m.m, 0) AS DOUBLE) / CAST(length(cp.ot) + length(cp.nt) AS DOUBLE)
         END AS ratio
  FROM cp LEFT JOIN matched m ON m.pid = cp.pid)"""


def _analysis_ctes() -> str:
    """Scores and analysis of every entry (after ``_ratio_ctes``): ``an``."""
    comb = "(coalesce(old_text, '') || ' ' || coalesce(new_text, ''))"
    wc = lambda t: f"len(list_filter(string_split_regex(coalesce({t}, ''), '{WS_CLASS}+'), lambda x: x <> ''))"
    return f""",
tfa AS (SELECT doc_id, entry_idx, unnest({_tokens('old_text')}) AS tok FROM entries WHERE change = 'changed'),
tfb AS (SELECT doc_id, entry_idx, unnest({_tokens('new_text')}) AS tok FROM entries WHERE change = 'changed'),
tca AS (SELECT doc_id, entry_idx, tok, count(*) AS a FROM tfa GROUP BY ALL),
tcb AS (SELECT doc_id, entry_idx, tok, count(*) AS b FROM tfb GROUP BY ALL),
tj AS (SELECT coalesce(tca.doc_id, tcb.doc_id) AS doc_id, coalesce(tca.entry_idx, tcb.entry_idx) AS entry_idx,
              coalesce(a, 0) AS a, coalesce(b, 0) AS b
       FROM tca FULL OUTER JOIN tcb ON tca.doc_id = tcb.doc_id AND tca.entry_idx = tcb.entry_idx AND tca.tok = tcb.tok),
tsum AS (SELECT doc_id, entry_idx, sum(a * b) AS dot, sum(a * a) AS na, sum(b * b) AS nb FROM tj GROUP BY ALL),
sc AS (
  SELECT e.doc_id, e.entry_idx, e.change, e.type, r.ratio, {comb} AS comb,
         CASE WHEN coalesce(t.na, 0) = 0 OR coalesce(t.nb, 0) = 0 THEN 0.0::DOUBLE
              ELSE CAST(t.dot AS DOUBLE) / sqrt(CAST(t.na * t.nb AS DOUBLE)) END AS sim,
         0.0::DOUBLE AS s0,
         CASE WHEN e.change IN ('added', 'deleted') THEN s0 + 2.5::DOUBLE ELSE s0 END AS s1,
         CASE WHEN e.change = 'changed' THEN s1 + (1.0::DOUBLE - r.ratio) * 6.0::DOUBLE ELSE s1 END AS s2,
         CASE WHEN e.change = 'changed' AND regexp_matches(comb, {_lit(DIGIT_RE)}) THEN s2 + 0.8::DOUBLE ELSE s2 END AS s3,
         CASE WHEN e.change = 'changed' AND regexp_matches(comb, {_lit(SCORE_UNIT_RE_RE2)}) THEN s3 + 0.8::DOUBLE ELSE s3 END AS s4,
         CASE WHEN e.change = 'changed' AND regexp_matches(comb, {_lit(YEAR_RE)}) THEN s4 + 0.6::DOUBLE ELSE s4 END AS s5,
         CASE WHEN e.type IN ('image', 'table') THEN s5 + 2.0::DOUBLE ELSE s5 END AS s6,
         {_round('greatest(0.0::DOUBLE, least(10.0::DOUBLE, s6))', 2)} AS score,
         regexp_matches(comb, {_lit(LABEL_UNIT_RE)}) AS lu, regexp_matches(comb, {_lit(NUMBER_RE)}) AS ln,
         {wc('e.old_text')} AS wc_old, {wc('e.new_text')} AS wc_new
  FROM entries e LEFT JOIN ratios r ON r.doc_id = e.doc_id AND r.entry_idx = e.entry_idx
  LEFT JOIN tsum t ON t.doc_id = e.doc_id AND t.entry_idx = e.entry_idx),
an AS (
  SELECT doc_id, entry_idx, change, type, score,
         CASE WHEN score < 3 THEN 'low' WHEN score < 6 THEN 'med' ELSE 'high' END AS score_band,
         CASE WHEN change = 'changed' THEN
           CASE WHEN ln AND lu THEN 'numbers, unit' WHEN ln THEN 'numbers' WHEN lu THEN 'unit' ELSE '' END END AS labels,
         CASE WHEN change = 'changed' THEN
           list_filter(['numbers', 'unit'], lambda x: (x = 'numbers' AND ln) OR (x = 'unit' AND lu)) END AS label_list,
         CASE WHEN change = 'changed' THEN {_round('(1.0::DOUBLE - sim) * 10.0::DOUBLE', 2)} END AS semantic_score,
         CASE WHEN change = 'changed' THEN
           CASE WHEN lu THEN 'substantive'
                WHEN regexp_matches(lower(comb), {_lit(LEGAL_RE)}) THEN 'technical'
                WHEN ratio > 0.9 THEN 'editorial'
                WHEN wc_old <> wc_new THEN 'formal' ELSE 'substantive' END END AS change_type,
         CASE WHEN change = 'changed' THEN {_round('1.0::DOUBLE - abs(0.85::DOUBLE - sim)', 2)} END AS confidence
  FROM sc),
ank AS (SELECT *, CASE WHEN semantic_score IS NULL THEN score * 0.6::DOUBLE
                       ELSE semantic_score + score * 0.1::DOUBLE END AS toc_key FROM an)"""


def _messages_cte() -> str:
    return """
msgs AS (SELECT conv_id, role, turn, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS old_text,
                text AS new_text FROM conversations),
pairs AS (SELECT * FROM msgs WHERE old_text IS NOT NULL)"""


def _escape(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '{WS_CLASS}+'), lambda t: t <> '')"


def _round(x: str, d: int) -> str:
    s = float(10 ** d)
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def _tf_cosine_sql() -> str:
    return f"""
ta AS (SELECT conv_id, role, turn, unnest({_tokens('old_text')}) AS tok FROM pairs),
tb AS (SELECT conv_id, role, turn, unnest({_tokens('new_text')}) AS tok FROM pairs),
ca AS (SELECT conv_id, role, turn, tok, count(*) AS a FROM ta GROUP BY ALL),
cb AS (SELECT conv_id, role, turn, tok, count(*) AS b FROM tb GROUP BY ALL),
j AS (SELECT coalesce(ca.conv_id, cb.conv_id) AS conv_id, coalesce(ca.role, cb.role) AS role,
             coalesce(ca.turn, cb.turn) AS turn, coalesce(a, 0) AS a, coalesce(b, 0) AS b
      FROM ca FULL OUTER JOIN cb ON ca.conv_id = cb.conv_id AND ca.role = cb.role AND ca.turn = cb.turn
                                 AND ca.tok = cb.tok),
sums AS (SELECT conv_id, role, turn, CAST(sum(a * b) AS BIGINT) AS dot, CAST(sum(a * a) AS BIGINT) AS norm_old,
                CAST(sum(b * b) AS BIGINT) AS norm_new FROM j GROUP BY ALL),
sims AS (SELECT p.conv_id, p.role, p.turn, coalesce(s.dot, 0) AS dot, coalesce(s.norm_old, 0) AS norm_old,
                coalesce(s.norm_new, 0) AS norm_new,
                CASE WHEN coalesce(s.norm_old, 0) = 0 OR coalesce(s.norm_new, 0) = 0 THEN 0.0::DOUBLE
                     ELSE CAST(s.dot AS DOUBLE) / sqrt(CAST(s.norm_old * s.norm_new AS DOUBLE)) END AS similarity
         FROM pairs p LEFT JOIN sums s ON p.conv_id = s.conv_id AND p.role = s.role AND p.turn = s.turn)"""


def _line_cells(where: str, qty: str) -> str:
    """Rows ordered by (l_linenumber, l_partkey, l_suppkey), then by the cells themselves (a total order,
    as Spark's sort of the row structs)."""
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey,
                                                     c0, c1, c2) - 1 AS INTEGER) AS r, c0, c1, c2
FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey,
             coalesce(CAST(l_linenumber AS VARCHAR), '') AS c0, coalesce(l_returnflag, '') AS c1,
             coalesce(CAST(CAST({qty} AS DECIMAL(18,2)) AS VARCHAR), '') AS c2
      FROM lineitem {where})"""


def _unpivot(src: str) -> str:
    return (f"SELECT doc_id, r, 0 AS c, c0 AS v FROM {src} UNION ALL SELECT doc_id, r, 1, c1 FROM {src} "
            f"UNION ALL SELECT doc_id, r, 2, c2 FROM {src}")


def _cell_select(k: str) -> str:
    return (f"SELECT {k}, CAST(c AS INTEGER) AS c, CASE WHEN ov = nv THEN 'same' ELSE 'changed' END AS cell_type, "
            f"CASE WHEN ov = nv THEN ov END AS text, CASE WHEN ov <> nv THEN ov END AS old, "
            f"CASE WHEN ov <> nv THEN nv END AS new FROM j")


def oracle_sql() -> dict[str, str]:
    rev = _revision_ctes()
    msgs = _messages_cte()
    q: dict[str, str] = {}

    q["blocks_from_text"] = f"""WITH {rev}
SELECT 'old' AS side, doc_id, block_pos, text FROM old_blocks
UNION ALL SELECT 'new', doc_id, block_pos, text FROM new_blocks"""

    q["table_blocks"] = f"""WITH cells AS ({_line_cells('', 'l_quantity')})
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_rows,
       'table:' || string_agg(c0 || ',' || c1 || ',' || c2, '|' ORDER BY r) AS block_key
FROM cells GROUP BY doc_id"""

    q["content_sha1"] = """SELECT doc_id, sha1(text) AS sha1, CAST(strlen(text) AS BIGINT) AS size,
       substr(sha1(text), 1, 12) AS short_sha1 FROM documents"""

    readers = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in READERS.items())
    q["route_files"] = f"""WITH p AS (
  SELECT page_id, path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS ext
  FROM (SELECT page_id, CASE WHEN p LIKE '%://%' THEN regexp_extract(p, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) ELSE p END AS path
        FROM (SELECT page_id, url AS p FROM pages
              UNION ALL SELECT page_id, replace(url, '://', '/') || CASE page_id % 7 WHEN 0 THEN ' #3.docx' WHEN 1 THEN '.DOC'
                WHEN 2 THEN '?x.txt' WHEN 3 THEN '.xlsx' WHEN 4 THEN '/.xls' WHEN 5 THEN '.XLS' ELSE '.pdf' END FROM pages)))
SELECT page_id, ext, CASE WHEN ext = '' THEN NULL ELSE CASE ext {readers} END END AS reader,
       CASE WHEN (CASE WHEN ext = '' THEN NULL ELSE CASE ext {readers} END END) IS NULL
            THEN {_lit(UNSUPPORTED)} || ext END AS reason
FROM p"""

    q["doc_status"] = f"WITH {rev}\nSELECT doc_id, in_old, in_new, n_old, n_new, status FROM status"

    al = f"WITH RECURSIVE {rev}{_alignment_ctes()}"
    q["align_blocks"] = f"{al}\nSELECT doc_id, entry_idx, change, old_pos, new_pos FROM entries"
    q["changed_pairs"] = f"{al}\nSELECT doc_id, entry_idx, old_text, new_text FROM entries WHERE change = 'changed'"
    cnt = ", ".join(f"CAST(count(*) FILTER (WHERE change = '{c}') AS BIGINT) AS {c}"
                    for c in ("added", "deleted", "changed", "unchanged"))
    q["change_counts"] = f"""{al},
ids AS (SELECT doc_id FROM old_docs UNION SELECT doc_id FROM new_docs),
c AS (SELECT doc_id, {cnt}, CAST(count(*) AS BIGINT) AS total_blocks FROM entries GROUP BY doc_id)
SELECT ids.doc_id, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(changed, 0) AS changed,
       coalesce(unchanged, 0) AS unchanged, 0 AS unknown, 0 AS other, coalesce(total_blocks, 0) AS total_blocks
FROM ids LEFT JOIN c ON c.doc_id = ids.doc_id"""
    q["stats_by_type"] = f"{al}\nSELECT doc_id, type, {cnt} FROM entries GROUP BY doc_id, type"
    q["stats_rollup"] = f"""{al}
SELECT doc_id, type, {cnt}, CAST(count(*) AS BIGINT) AS total_blocks, CAST(grouping(doc_id, type) AS BIGINT) AS level
FROM entries GROUP BY ROLLUP (doc_id, type)"""
    q["change_ratio"] = f"{al}{_ratio_ctes()}\nSELECT doc_id, entry_idx, ratio FROM ratios"
    an = f"{al}{_ratio_ctes()}{_analysis_ctes()}"
    q["score_changes"] = f"{an}\nSELECT doc_id, entry_idx, change, type, score, score_band FROM an"
    q["analyze_changes"] = (f"{an}\nSELECT doc_id, entry_idx, labels, semantic_score, change_type, confidence "
                            f"FROM an WHERE change = 'changed'")
    q["top_changes"] = f"""{an}
SELECT doc_id, entry_idx, change, score,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, entry_idx DESC) AS INTEGER) AS rank
FROM an WHERE change IN ('changed', 'added', 'deleted')"""
    label = ("CASE WHEN semantic_score IS NOT NULL THEN CAST(semantic_score AS VARCHAR) || '/10' "
             "ELSE 's=' || CAST(score AS VARCHAR) END")
    name = "CASE WHEN change = 'changed' OR coalesce(type, '') = '' THEN 'blk' ELSE type END"
    q["toc"] = f"""{an},
t AS (SELECT doc_id, entry_idx, change, score, semantic_score, toc_key,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY toc_key DESC, entry_idx ASC) AS INTEGER) AS rank,
             '#' || CAST(entry_idx AS VARCHAR) || '(' || {_escape(name)} || ') ' || {label} AS toc_label
      FROM ank WHERE change IN ('changed', 'added', 'deleted'))
SELECT * FROM t WHERE rank <= 200"""
    q["corpus_top_k"] = f"""{an}
SELECT doc_id, entry_idx, change, score, semantic_score, toc_key FROM ank
WHERE change IN ('changed', 'added', 'deleted') ORDER BY toc_key DESC, doc_id ASC, entry_idx ASC LIMIT 100"""
    share = _round("CAST(dominant_count AS DOUBLE) / CAST(n_changed AS DOUBLE) * 100.0::DOUBLE", 1)
    q["doc_summary"] = f"""{an},
ids AS (SELECT doc_id FROM old_docs UNION SELECT doc_id FROM new_docs),
tot AS (SELECT doc_id, count(*) AS total_blocks FROM an GROUP BY doc_id),
c2 AS (SELECT doc_id, entry_idx, coalesce(nullif(change_type, ''), 'undefined') AS ctype, label_list
       FROM an WHERE change = 'changed'),
pt AS (SELECT doc_id, ctype, count(*) AS cnt, min(entry_idx) AS first_idx FROM c2 GROUP BY doc_id, ctype),
top AS (SELECT doc_id, ctype AS dominant_type, cnt AS dominant_count FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_idx ASC) AS rn FROM pt) WHERE rn = 1),
lab AS (SELECT doc_id, count(*) AS n_changed,
               array_to_string(list_sort(list_distinct(flatten(list(label_list)))), ', ') AS label_set FROM c2 GROUP BY doc_id),
j AS (SELECT ids.doc_id, coalesce(tot.total_blocks, 0) AS total_blocks, lab.n_changed, lab.label_set,
             top.dominant_type, top.dominant_count
      FROM ids LEFT JOIN tot ON tot.doc_id = ids.doc_id LEFT JOIN lab ON lab.doc_id = ids.doc_id
      LEFT JOIN top ON top.doc_id = ids.doc_id),
k AS (SELECT *, {share} AS share, CASE WHEN label_set = '' THEN 'none' ELSE label_set END AS labels FROM j)
SELECT doc_id, CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed, CAST(total_blocks AS BIGINT) AS total_blocks,
       dominant_type, share AS dominant_share, CASE WHEN n_changed > 0 THEN labels END AS label_set,
       CASE WHEN coalesce(n_changed, 0) = 0 THEN 'No significant changes detected in the document.'
            ELSE 'The document contains ' || CAST(n_changed AS VARCHAR) || ' changes (out of '
                 || CAST(total_blocks AS VARCHAR) || ' blocks), of which ' || CAST(share AS VARCHAR)
                 || '% are of type <b>' || dominant_type || '</b>. Dominant AI labels: ' || labels || '.' END AS summary
FROM k"""
    q["text_vectors"] = f"""{al},
tv AS (SELECT doc_id, entry_idx,
              trim(coalesce(nullif(new_text, ''), nullif(old_text, ''), ''), {WS_SQL}) AS vt
       FROM entries WHERE change = 'changed'),
tt AS (SELECT doc_id, entry_idx, unnest({_tokens('vt')}) AS token FROM tv)
SELECT doc_id, entry_idx, token, count(*) AS tf FROM tt GROUP BY doc_id, entry_idx, token"""
    q["doc_status_indexed"] = q["doc_status"]
    q["doc_status_errors"] = f"""WITH {rev}, routed AS ({q["route_files"]}),
bad AS (SELECT page_id AS doc_id, max(reason) AS reason FROM routed GROUP BY page_id HAVING count(reader) = 0)
SELECT coalesce(s.doc_id, b.doc_id) AS doc_id, coalesce(in_old, false) AS in_old, coalesce(in_new, false) AS in_new,
       coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new,
       CASE WHEN b.doc_id IS NOT NULL THEN 'parse_error' ELSE status END AS status, reason AS reasons
FROM status s FULL JOIN bad b ON b.doc_id = s.doc_id"""
    signs = ", ".join(f"sum(CASE WHEN substr(h, {d + 1}, 1) >= '8' THEN n ELSE -n END)" for d in range(32))
    means = ", ".join(f"CASE WHEN sum(w) = 0 THEN 0.0 ELSE CAST(coalesce(sum(w * vec[{d + 1}]), 0) AS DOUBLE) / sum(w) END"
                      for d in range(32))
    q["text_vectors_mean"] = f"""{al},
tv AS (SELECT doc_id, entry_idx,
              trim(coalesce(nullif(new_text, ''), nullif(old_text, ''), ''), {WS_SQL}) AS vt
       FROM entries WHERE change = 'changed'),
tf AS (SELECT doc_id, entry_idx, tok, count(*) AS w
       FROM (SELECT doc_id, entry_idx, unnest({_tokens('vt')}) AS tok FROM tv) GROUP BY ALL),
lists AS (SELECT row_number() OVER () AS r, {_tokens('text')} AS w FROM documents),
words AS (SELECT r, unnest(w) AS tok, unnest(range(len(w))) AS i FROM lists),
co AS (SELECT a.tok, b.tok AS near, count(*) AS n FROM words a JOIN (VALUES (-2), (-1), (1), (2)) AS o(k) ON true
       JOIN words b ON b.r = a.r AND b.i = a.i + o.k GROUP BY a.tok, b.tok),
sums AS (SELECT tok, sum(n) AS n, [{signs}] AS s FROM (SELECT *, md5(near) AS h FROM co) GROUP BY tok),
vecs AS (SELECT tok, list_transform(s, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000.0 / n) AS BIGINT)) AS vec FROM sums),
m AS (SELECT doc_id, entry_idx, CAST(sum(w) AS BIGINT) AS n_tokens, [{means}] AS mean
      FROM tf LEFT JOIN vecs ON vecs.tok = tf.tok GROUP BY doc_id, entry_idx)
SELECT doc_id, entry_idx, n_tokens, CAST(unnest(range(32)) AS INTEGER) AS dim, unnest(mean) AS value FROM m"""
    q["changes_json"] = f"{al}\nSELECT doc_id, entry_idx, change, type, old_pos, new_pos, old_text, new_text FROM entries"
    q["report_rows"] = f"""{an}
SELECT doc_id, entry_idx, change, type, score, score_band, semantic_score, change_type, confidence,
       coalesce(labels, '') AS labels,
       (coalesce(len(label_list) > 0, false) OR semantic_score IS NOT NULL
        OR coalesce(change_type <> '', false) OR confidence IS NOT NULL) AS ai_info
FROM an"""
    q["filter_changes"] = (f"{al}\nSELECT doc_id, entry_idx, change, type FROM entries "
                           f"WHERE change IN ('changed', 'added') AND type IN ('paragraph')")
    q["type_facets"] = f"""{al},
f AS (SELECT doc_id, type, min(entry_idx) AS first_idx FROM entries GROUP BY doc_id, type)
SELECT doc_id, type, CAST(first_idx AS INTEGER) AS first_idx,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) AS INTEGER) AS facet_pos FROM f"""
    q["added_docs"] = f"WITH {rev}\nSELECT doc_id, n_old, n_new FROM status WHERE NOT in_old AND in_new"
    q["deleted_docs"] = f"WITH {rev}\nSELECT doc_id, n_old, n_new FROM status WHERE in_old AND NOT in_new"
    q["rebuild_new"] = f"WITH {rev}\nSELECT doc_id, block_pos, text FROM new_blocks"
    q["rebuild_old"] = f"WITH {rev}\nSELECT doc_id, block_pos, text FROM old_blocks"

    msg_ratio = f"""WITH RECURSIVE {msgs},
mp AS (SELECT conv_id, role, turn, dense_rank() OVER (ORDER BY conv_id, role, turn) AS pid,
              coalesce(old_text, '') AS ot, coalesce(new_text, '') AS nt FROM pairs),
mpp AS (SELECT pid, length(ot) AS n_old, length(nt) AS n_new FROM mp WHERE ot <> nt AND length(ot) > 0 AND length(nt) > 0),
ma AS (SELECT pid, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS k
       FROM (SELECT pid, string_split(ot, '') AS s FROM mp WHERE pid IN (SELECT pid FROM mpp))),
mb AS (SELECT pid, generate_subscripts(s, 1) - 1 AS j, unnest(s) AS k
       FROM (SELECT pid, string_split(nt, '') AS s FROM mp WHERE pid IN (SELECT pid FROM mpp)))
{_frontier_sql('msg_', 'mpp', 'ma', 'mb')},
mm AS (SELECT pid, sum(ahi - alo) AS m FROM msg_seg WHERE kind = 'match' GROUP BY pid),
mr AS (SELECT conv_id, role, turn, ot, nt,
       CASE WHEN ot = nt THEN 1.0::DOUBLE WHEN length(ot) = 0 OR length(nt) = 0 THEN 0.0::DOUBLE
            ELSE 2.0::DOUBLE * CAST(coalesce(mm.m, 0) AS DOUBLE) / CAST(length(ot) + length(nt) AS DOUBLE) END AS ratio
       FROM mp LEFT JOIN mm ON mm.pid = mp.pid)"""
    q["text_ratio"] = f"{msg_ratio}\nSELECT conv_id, role, turn, ratio FROM mr"
    mcomb = "(ot || ' ' || nt)"
    mwc = lambda t: f"len(list_filter(string_split_regex({t}, '{WS_CLASS}+'), lambda x: x <> ''))"
    q["change_type"] = f"""{msg_ratio}
SELECT conv_id, role, turn,
       CASE WHEN regexp_matches({mcomb}, {_lit(LABEL_UNIT_RE)}) THEN 'substantive'
            WHEN regexp_matches(lower({mcomb}), {_lit(LEGAL_RE)}) THEN 'technical'
            WHEN ratio > 0.9 THEN 'editorial'
            WHEN {mwc('ot')} <> {mwc('nt')} THEN 'formal' ELSE 'substantive' END AS change_type
FROM mr"""

    q["inline_diff"] = f"""WITH {msgs}
SELECT conv_id, role, turn, {_escape('old_text')} AS old_view, {_escape('new_text')} AS new_view FROM pairs"""

    q["table_diff"] = f"""WITH
old_c AS ({_line_cells('', 'l_quantity')}),
new_c AS ({_line_cells('WHERE l_suppkey % 13 <> 0', 'CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END')}),
oc AS ({_unpivot('old_c')}),
nc AS ({_unpivot('new_c')}),
j AS (SELECT coalesce(oc.doc_id, nc.doc_id) AS doc_id, coalesce(oc.r, nc.r) AS r, coalesce(oc.c, nc.c) AS c,
             coalesce(oc.v, '') AS ov, coalesce(nc.v, '') AS nv
      FROM oc FULL OUTER JOIN nc ON oc.doc_id = nc.doc_id AND oc.r = nc.r AND oc.c = nc.c)
SELECT doc_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, cell_type, text, old, new
FROM ({_cell_select('doc_id, r')})"""

    def flag_cells(where: str, qty: str) -> str:
        return f"""SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                                   c0, c1, c2) - 1 AS r, c0, c1, c2
FROM (SELECT coalesce(l_returnflag, '') AS flag, l_orderkey, l_linenumber, l_partkey, l_suppkey,
             coalesce(CAST(l_orderkey AS VARCHAR), '') AS c0, coalesce(CAST(l_linenumber AS VARCHAR), '') AS c1,
             coalesce(CAST(CAST({qty} AS DECIMAL(18,2)) AS VARCHAR), '') AS c2 FROM lineitem {where})"""

    flags = [_unpivot(f"{x}_c").replace("doc_id", "flag") for x in ("old", "new")]
    q["big_table_diff"] = f"""WITH
old_c AS ({flag_cells('', 'l_quantity')}),
new_c AS ({flag_cells('WHERE l_suppkey % 13 <> 0', 'CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END')}),
oc AS ({flags[0]}),
nc AS ({flags[1]}),
j AS (SELECT coalesce(oc.flag, nc.flag) AS flag, coalesce(oc.r, nc.r) AS r, coalesce(oc.c, nc.c) AS c,
             coalesce(oc.v, '') AS ov, coalesce(nc.v, '') AS nv
      FROM oc FULL OUTER JOIN nc ON oc.flag = nc.flag AND oc.r = nc.r AND oc.c = nc.c)
SELECT flag, CAST(r AS INTEGER) AS r, c, cell_type, text, old, new FROM ({_cell_select('flag, r')})"""

    q["snapshot_cell_diff"] = f"""WITH
old_t AS (SELECT o_orderkey AS k, o_orderstatus AS c0, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS c1,
                 o_orderpriority AS c2 FROM orders WHERE o_orderkey % 29 <> 0),
new_t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS c0,
                 CAST(CAST(CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS DECIMAL(18,2))
                      AS VARCHAR) AS c1, o_orderpriority AS c2 FROM orders WHERE o_orderkey % 23 <> 0 OR o_orderkey % 29 = 0),
oc AS (SELECT k, 0 AS c, c0 AS v FROM old_t UNION ALL SELECT k, 1, c1 FROM old_t UNION ALL SELECT k, 2, c2 FROM old_t),
nc AS (SELECT k, 0 AS c, c0 AS v FROM new_t UNION ALL SELECT k, 1, c1 FROM new_t UNION ALL SELECT k, 2, c2 FROM new_t),
j AS (SELECT coalesce(oc.k, nc.k) AS k, coalesce(oc.c, nc.c) AS c, coalesce(oc.v, '') AS ov, coalesce(nc.v, '') AS nv
      FROM oc FULL OUTER JOIN nc ON oc.k = nc.k AND oc.c = nc.c)
SELECT CAST(k AS BIGINT) AS k, c, cell_type, text, old, new FROM ({_cell_select('k')})"""

    t = "coalesce(text, '')"
    q["text_predicates"] = f"""WITH {rev},
parts AS (SELECT doc_id, block_pos AS line, text FROM new_blocks
          UNION ALL SELECT doc_id, -1, regexp_replace(text, '[^ \\n]+', '', 'g') FROM documents)
SELECT doc_id, line,
  regexp_matches({t}, {_lit(DIGIT_RE)}) AS has_digit,
  regexp_matches({t}, {_lit(SCORE_UNIT_RE_RE2)}) AS has_score_unit,
  regexp_matches({t}, {_lit(YEAR_RE)}) AS has_year,
  regexp_matches({t}, {_lit(LABEL_UNIT_RE)}) AS has_label_unit,
  regexp_matches({t}, {_lit(NUMBER_RE)}) AS has_number,
  regexp_matches(lower({t}), {_lit(LEGAL_RE)}) AS has_legal_ref,
  CAST(len(list_filter(string_split_regex({t}, '{WS_CLASS}+'), lambda x: x <> '')) AS BIGINT) AS word_count,
  trim({t}, {WS_SQL}) = '' AS is_blank
FROM parts"""

    comb = "(coalesce(old_text, '') || ' ' || coalesce(new_text, ''))"
    q["score_bonus"] = f"""{al},
b AS (SELECT doc_id, entry_idx, regexp_matches({comb}, {_lit(DIGIT_RE)}) AS d,
             regexp_matches({comb}, {_lit(SCORE_UNIT_RE_RE2)}) AS u, regexp_matches({comb}, {_lit(YEAR_RE)}) AS y
      FROM entries WHERE change = 'changed'),
s1 AS (SELECT *, CASE WHEN d THEN 0.0::DOUBLE + 0.8::DOUBLE ELSE 0.0::DOUBLE END AS s FROM b),
s2 AS (SELECT *, CASE WHEN u THEN s + 0.8::DOUBLE ELSE s END AS s2 FROM s1)
SELECT doc_id, entry_idx, CASE WHEN y THEN s2 + 0.6::DOUBLE ELSE s2 END AS bonus FROM s2"""

    q["labels"] = f"""{al},
b AS (SELECT doc_id, entry_idx, regexp_matches({comb}, {_lit(LABEL_UNIT_RE)}) AS u,
             regexp_matches({comb}, {_lit(NUMBER_RE)}) AS n FROM entries WHERE change = 'changed')
SELECT doc_id, entry_idx, CASE WHEN n AND u THEN 'numbers, unit' WHEN n THEN 'numbers' WHEN u THEN 'unit'
                               ELSE '' END AS labels FROM b"""

    bare = lambda x: (f"list_filter(list_transform({_tokens(x)}, lambda t: regexp_replace(t, "  # noqa: E731
                      r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: t <> '')")
    q["entity_labels"] = f"""WITH
g0 AS (SELECT n_name AS term, 'location' AS label FROM nation UNION ALL SELECT r_name, 'place' FROM region
       UNION ALL SELECT p_name, 'product' FROM part
       UNION ALL SELECT regexp_extract(text, '^\\S+ \\S+'), 'title/work' FROM benchmark),
gz AS (SELECT DISTINCT {bare('term')} AS words, label FROM g0),
lengths AS (SELECT DISTINCT len(words) AS n FROM gz WHERE len(words) > 0),
docs AS (SELECT doc_id, {bare('text')} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, list_slice(w, i, i + n - 1) AS words
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, label FROM grams JOIN gz USING (words))
SELECT doc_id, string_agg(label, ', ' ORDER BY label) AS entity_labels FROM hits GROUP BY doc_id"""

    q["text_cosine"] = f"""WITH {msgs}, {_tf_cosine_sql()}
SELECT conv_id, role, turn, dot, norm_old, norm_new, {_round('similarity', 4)} AS similarity FROM sims"""

    q["semantic_score"] = f"""WITH {msgs}, {_tf_cosine_sql()}
SELECT conv_id, role, turn, {_round('(1.0::DOUBLE - similarity) * 10.0::DOUBLE', 2)} AS semantic_score,
       {_round('1.0::DOUBLE - abs(0.85::DOUBLE - similarity)', 2)} AS confidence FROM sims"""

    dot = "list_reduce(list_transform(a, lambda x, i: CAST(x AS DOUBLE) * CAST(b[i] AS DOUBLE)), lambda p, q: p + q)"
    na = "list_reduce(list_transform(a, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda p, q: p + q)"
    nb = "list_reduce(list_transform(b, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda p, q: p + q)"
    q["embedding_cosine"] = f"""WITH v AS (
  SELECT x.vec_id AS a_id, y.vec_id AS b_id, x.embedding AS a, y.embedding AS b
  FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0),
c AS (SELECT a_id, b_id, b, {dot} AS dot, {na} AS na, {nb} AS nb FROM v)
SELECT a_id, b_id, CASE WHEN b IS NULL THEN NULL WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE
                        ELSE {_round('dot / (sqrt(na) * sqrt(nb))', 4)} END AS cosine FROM c"""

    k = "CASE WHEN n >= 3 THEN CAST(greatest(2, least(10, n // 5)) AS BIGINT) END"
    q["cluster_k"] = f"""{al},
ids AS (SELECT doc_id FROM old_docs UNION SELECT doc_id FROM new_docs),
c AS (SELECT ids.doc_id, count(e.doc_id) AS n FROM ids
      LEFT JOIN (SELECT doc_id FROM entries WHERE change = 'changed') e ON e.doc_id = ids.doc_id GROUP BY ids.doc_id)
SELECT doc_id, n AS n_changed, {k} AS k FROM c"""
    q["cluster_members"] = f"""{al},
c AS (SELECT doc_id, count(*) AS n FROM entries WHERE change = 'changed' GROUP BY doc_id HAVING count(*) >= 3)
SELECT doc_id, CAST(unnest(range(n)) AS INTEGER) AS idx, CAST(1 AS BIGINT) AS n_clusters, true AS in_range FROM c"""
    rounds = "".join(f""",
won{c} AS MATERIALIZED (
  SELECT doc_id, idx, entry_idx, pp AS ss FROM far{c} WHERE k > {c} AND (far IS NULL OR far > 0)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -ln((CAST('0x' || substr(md5(doc_id || ':' || idx || ':{c}'), 1, 13)
    AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(far, 1)::DOUBLE, idx) = 1),
dot{c} AS (SELECT v.doc_id, v.entry_idx, sum(v.tf * s.tf) AS dot FROM won{c} w JOIN vec s USING (doc_id, entry_idx)
           JOIN vec v ON v.doc_id = s.doc_id AND v.token = s.token GROUP BY v.doc_id, v.entry_idx),
far{c + 1} AS MATERIALIZED (
  SELECT f.doc_id, f.idx, f.entry_idx, k, pp, least(far, CAST(pp + ss - 2 * coalesce(dot, 0) AS BIGINT)) AS far
  FROM far{c} f LEFT JOIN won{c} w ON w.doc_id = f.doc_id
  LEFT JOIN dot{c} d ON d.doc_id = f.doc_id AND d.entry_idx = f.entry_idx)""" for c in range(10))
    drawn = " UNION ALL ".join(f"SELECT doc_id, CAST({c} AS INTEGER) AS cluster, CAST(idx AS INTEGER) AS idx FROM won{c}"
                               for c in range(10))
    q["cluster_seeds"] = q["text_vectors"].replace("\nSELECT doc_id, entry_idx, token", "\n, vec AS MATERIALIZED (SELECT doc_id, "
                                                   "entry_idx, token") + f"""),
pts AS (SELECT doc_id, entry_idx, row_number() OVER (PARTITION BY doc_id ORDER BY entry_idx) - 1 AS idx,
               count(*) OVER (PARTITION BY doc_id) AS n FROM tv),
far0 AS MATERIALIZED (
  SELECT doc_id, idx, entry_idx, greatest(2, least(10, n // 5)) AS k, CAST(coalesce(pp, 0) AS BIGINT) AS pp, CAST(NULL AS BIGINT) AS far
  FROM pts LEFT JOIN (SELECT doc_id, entry_idx, sum(tf * tf) AS pp FROM vec GROUP BY doc_id, entry_idx) USING (doc_id, entry_idx)
  WHERE n >= 3){rounds}
{drawn}"""
    q["type_distribution"] = f"""{an}
SELECT doc_id, coalesce(nullif(change_type, ''), 'undefined') AS change_type, count(*) AS n_changes
FROM an WHERE change = 'changed' GROUP BY ALL"""
    q["hide_unchanged"] = f"{al}\nSELECT doc_id, entry_idx, change FROM entries WHERE change <> 'unchanged'"
    q["align_blocks_frontier"] = q["align_blocks"]
    q["cell_markup"] = q["table_diff"].replace(
        "SELECT doc_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, cell_type, text, old, new\nFROM (",
        f"SELECT doc_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {_escape('old')} AS old_view, "
        f"{_escape('new')} AS new_view\nFROM (") + " WHERE cell_type = 'changed'"
    mx = f"WITH RECURSIVE {_mixed_ctes()}{_alignment_ctes()}{_MIXED_ENTRIES}"
    q["mixed_changes"] = f"{mx}\nSELECT doc_id, entry_idx, change, type, old_pos, new_pos FROM mixed"
    q["mixed_changes_exact"] = q["mixed_changes"]
    q["key_collisions"] = f"""{mx}
SELECT doc_id, CAST(count(DISTINCT text) AS BIGINT) AS n_keys, CAST(count(DISTINCT text) AS BIGINT) AS n_hashes
FROM (SELECT doc_id, text FROM old_blocks UNION ALL SELECT doc_id, text FROM new_blocks) GROUP BY doc_id"""
    q["mixed_stats_by_type"] = f"{mx}\nSELECT doc_id, type, {cnt} FROM mixed GROUP BY doc_id, type"
    q["mixed_facets"] = f"""{mx},
f AS (SELECT doc_id, type, min(entry_idx) AS first_idx FROM mixed GROUP BY doc_id, type)
SELECT doc_id, type, first_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) AS INTEGER) AS facet_pos
FROM f"""
    man = f"""{mx},
mentries AS (SELECT doc_id, entry_idx, change, type, CASE WHEN o_type = 'paragraph' THEN old_text[11:] END AS old_text,
                    CASE WHEN n_type = 'paragraph' THEN new_text[11:] END AS new_text FROM mixed){
        (_ratio_ctes() + _analysis_ctes()).replace("FROM entries", "FROM mentries")}"""
    for name, of in (("mixed_scores", "score_changes"), ("mixed_toc", "toc"), ("mixed_summary", "doc_summary")):
        q[name] = man + q[of].removeprefix(an)
    q["mixed_json"] = f"""{mx},
cells AS (SELECT m.doc_id, m.entry_idx, count(*) FILTER (WHERE coalesce(oc.v, '') <> coalesce(nc.v, '')) AS n
          FROM (SELECT * FROM mixed WHERE change = 'changed' AND o_type = 'table' AND n_type = 'table') m
          JOIN (SELECT DISTINCT doc_id, r, c FROM (SELECT doc_id, r, c FROM oc UNION ALL SELECT doc_id, r, c FROM nc)) x USING (doc_id)
          LEFT JOIN oc ON oc.doc_id = x.doc_id AND oc.r = x.r AND oc.c = x.c
          LEFT JOIN nc ON nc.doc_id = x.doc_id AND nc.r = x.r AND nc.c = x.c GROUP BY m.doc_id, m.entry_idx)
SELECT m.doc_id, m.entry_idx, change, type, CASE WHEN o_type = 'paragraph' THEN old_text[11:] END AS old_text,
       CASE WHEN n_type = 'paragraph' THEN new_text[11:] END AS new_text,
       CASE WHEN o_type = 'image' THEN old_text[7:] END AS old_sha1,
       CASE WHEN n_type = 'image' THEN new_text[7:] END AS new_sha1,
       CASE WHEN o_type = 'image' THEN o_size END AS old_size, CASE WHEN n_type = 'image' THEN n_size END AS new_size,
       CASE WHEN o_type = 'table' THEN o_size END AS old_rows, CASE WHEN n_type = 'table' THEN n_size END AS new_rows,
       cells.n AS changed_cells, cells.n AS marked_cells
FROM mixed m LEFT JOIN cells ON cells.doc_id = m.doc_id AND cells.entry_idx = m.entry_idx"""
    return q
