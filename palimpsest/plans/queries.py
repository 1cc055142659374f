"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or fixtures Spark derives from them) in full; each document, order
and table is in one snapshot at least.  Column names and
types match the DuckDB oracles in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import block_key
from ..operators import celldiff, report
from ..operators.align import rebuild_side
from ..operators.semantics import entity_labels, label_union, tf_cosine, vector_cosine
from ..operators.score import confidence, score_bonus, semantic_score
from ..operators.textdiff import strip_markup, with_text_diff
from ..session import read_table
from ..sources import fixtures
from ..sources.routing import route_paths
from .compare import Comparison

Query = Callable[[SparkSession, str], DataFrame]


def revision(spark: SparkSession, sf_dir: str, **kw) -> Comparison:
    old, new = fixtures.revision_lines(read_table(spark, sf_dir, "documents"))
    return Comparison.from_lines(old, new, **kw)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity terms taken from the given tables: nation names (GPE), region names (LOC), part names
    (PRODUCT), the first two words of every benchmark item (WORK_OF_ART)."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit("GPE").alias("code"))
    r = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("term"), F.lit("LOC").alias("code"))
    p = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.lit("PRODUCT").alias("code"))
    b = read_table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^\S+ \S+", 0).alias("term"),
                                                      F.lit("WORK_OF_ART").alias("code"))
    return n.unionByName(r).unionByName(p).unionByName(b)


# ---- A: sources ------------------------------------------------------------------------------------
def q_blocks_from_text(spark, sf):
    old, new, ob, nb = fixtures.revision_blocks(spark, sf)
    o = ob.select(F.lit("old").alias("side"), "doc_id", "block_pos", "text")
    n = nb.select(F.lit("new").alias("side"), "doc_id", "block_pos", "text")
    return o.unionByName(n)


def q_table_blocks(spark, sf):
    t = fixtures.lineitem_tables(spark, sf)
    return t.select("doc_id", F.size("table").cast("bigint").alias("n_rows"), block_key().alias("block_key"))


def q_content_sha1(spark, sf):
    d = read_table(spark, sf, "documents")
    sha = F.sha1(F.col("text").cast("binary"))
    return d.select("doc_id", sha.alias("sha1"), F.octet_length("text").cast("bigint").alias("size"),
                    T.short_fingerprint(sha).alias("short_sha1"))


def q_route_files(spark, sf):
    """A9 over all URLs, and over file names made of them with every kind of suffix."""
    p = read_table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    tails = [" #3.docx", ".DOC", "?x.txt", ".xlsx", "/.xls", ".XLS", ".pdf"]
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (F.col("page_id") % len(tails) + 1).cast("int"))
    files = p.select("page_id", F.concat(F.replace(F.col("path"), F.lit("://"), F.lit("/")), tail).alias("path"))
    return route_paths(p.unionByName(files), "path").select("page_id", "ext", "reader", "reason")


# ---- C: pairing and alignment ----------------------------------------------------------------------
def q_doc_status(spark, sf):
    return revision(spark, sf).status.select("doc_id", "in_old", "in_new", "n_old", "n_new", "status")


def q_added_docs(spark, sf):
    st = revision(spark, sf).status
    return st.filter(~F.col("in_old") & F.col("in_new")).select("doc_id", "n_old", "n_new")


def q_deleted_docs(spark, sf):
    st = revision(spark, sf).status
    return st.filter(F.col("in_old") & ~F.col("in_new")).select("doc_id", "n_old", "n_new")


def q_align_blocks(spark, sf):
    return revision(spark, sf).entries.select("doc_id", "entry_idx", "change", "old_pos", "new_pos")


def q_changed_pairs(spark, sf):
    ch = revision(spark, sf).changes.filter(F.col("change") == "changed")
    return ch.select("doc_id", "entry_idx", "old_text", "new_text")


def q_change_ratio(spark, sf):
    d = revision(spark, sf).detailed.filter(F.col("change") == "changed")
    return d.select("doc_id", "entry_idx", "ratio")


def q_rebuild_new(spark, sf):
    return rebuild_side(revision(spark, sf).changes, "new")


def q_rebuild_old(spark, sf):
    return rebuild_side(revision(spark, sf).changes, "old")


# ---- D: fine-grained diff --------------------------------------------------------------------------
def _message_pairs(spark, sf):
    return fixtures.message_revisions(spark, sf).filter(F.col("old_text").isNotNull())


def q_inline_diff(spark, sf):
    """D1/D2 checked by its invariant: the markup minus insertions is ``escape(old)``, minus
    deletions ``escape(new)``."""
    p = with_text_diff(_message_pairs(spark, sf), F.col("old_text"), F.col("new_text"), "k")
    p = p.withColumn("inline_html", F.col("k.inline_html"))
    return p.select("conv_id", "role", "turn",
                    strip_markup(F.col("inline_html"), "old").alias("old_view"),
                    strip_markup(F.col("inline_html"), "new").alias("new_view"))


def q_text_ratio(spark, sf):
    p = with_text_diff(_message_pairs(spark, sf), F.col("old_text"), F.col("new_text"), "k")
    return p.select("conv_id", "role", "turn", F.col("k.ratio").alias("ratio"))


def q_table_diff(spark, sf):
    """Nested positional diff of each order's line table against its revision, in long form."""
    pairs = fixtures.lineitem_revision_pairs(spark, sf)
    nested = pairs.select("doc_id", celldiff.nested_table_diff(F.col("old_table"), F.col("new_table")).alias("table_changes"))
    return celldiff.explode_nested(nested, ["doc_id"]).select(
        "doc_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "cell_type", "text", "old", "new")


def q_big_table_diff(spark, sf):
    """D4/D6 by size: all lines of a return flag as one table, against their revision; large tables in slices."""
    from ..operators.big_tables import all_cells
    return all_cells(*fixtures.flag_tables(spark, sf), ["flag"]).select(
        "flag", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "cell_type", "text", "old", "new")


def q_snapshot_cell_diff(spark, sf):
    old, new = fixtures.order_tables(spark, sf)
    return celldiff.snapshot_cell_diff(old, new, "k", fixtures.ORDER_COLUMNS).select(
        F.col("k").cast("bigint").alias("k"), F.col("c").cast("int").alias("c"), "cell_type", "text", "old", "new")


# ---- E / F / G on message revisions ------------------------------------------------------------------
def _revised_pairs(spark, sf):
    """Changed entries of the document revision; the edits bring in units, years and legal references."""
    return revision(spark, sf).changes.filter(F.col("change") == "changed").select(
        "doc_id", "entry_idx", "old_text", "new_text")


def q_text_predicates(spark, sf):
    """E1-E6, E8, E11 over every line of the new snapshot, and over what is between a document's words."""
    _, new = fixtures.revision_lines(read_table(spark, sf, "documents"))
    d = read_table(spark, sf, "documents")
    gaps = d.select("doc_id", F.lit(-1).alias("line"), F.regexp_replace("text", r"[^ \n]+", "").alias("text"))
    lines = new.select("doc_id", F.posexplode("lines").alias("line", "text")).unionByName(gaps)
    t = F.coalesce(F.col("text"), F.lit(""))
    return lines.select("doc_id", "line", T.has_digit(t).alias("has_digit"), T.has_score_unit(t).alias("has_score_unit"),
                        T.has_year(t).alias("has_year"), T.has_label_unit(t).alias("has_label_unit"),
                        T.has_number(t).alias("has_number"), T.has_legal_ref(t).alias("has_legal_ref"),
                        T.word_count(t).cast("bigint").alias("word_count"), T.is_blank(t).alias("is_blank"))


def q_score_bonus(spark, sf):
    p = _revised_pairs(spark, sf)
    return p.select("doc_id", "entry_idx", score_bonus(F.col("old_text"), F.col("new_text")).alias("bonus"))


def q_labels(spark, sf):
    p = _revised_pairs(spark, sf)
    merged = F.concat(F.coalesce("old_text", F.lit("")), F.lit(" "), F.coalesce("new_text", F.lit("")))
    return p.select("doc_id", "entry_idx", F.array_join(label_union(merged), ", ").alias("labels"))


def q_entity_labels(spark, sf):
    d = read_table(spark, sf, "documents")
    e = entity_labels(d, ["doc_id"], "text", gazetteer(spark, sf))
    return e.select("doc_id", F.array_join("entity_labels", ", ").alias("entity_labels"))


def _pair_similarity(spark, sf):
    p = _message_pairs(spark, sf)
    return tf_cosine(p, ["conv_id", "role", "turn"], "old_text", "new_text")


def q_text_cosine(spark, sf):
    s = _pair_similarity(spark, sf)
    return s.select("conv_id", "role", "turn", "dot", "norm_old", "norm_new",
                    T.round_half_up(F.col("similarity"), 4).alias("similarity"))


def q_semantic_score(spark, sf):
    s = _pair_similarity(spark, sf)
    return s.select("conv_id", "role", "turn",
                    semantic_score(F.col("similarity"), F.lit(None).cast("double")).alias("semantic_score"),
                    confidence(F.col("similarity")).alias("confidence"))


def q_change_type(spark, sf):
    """F4 on message revisions: labels, legal references, the character ratio and word counts."""
    from ..operators.score import change_type
    p = with_text_diff(_message_pairs(spark, sf), F.col("old_text"), F.col("new_text"), "k")
    merged = F.concat(F.coalesce("old_text", F.lit("")), F.lit(" "), F.coalesce("new_text", F.lit("")))
    return p.select("conv_id", "role", "turn",
                    change_type(F.col("old_text"), F.col("new_text"), label_union(merged), F.col("k.ratio"))
                    .alias("change_type"))


def q_text_vectors(spark, sf):
    """The term-frequency vector (long form, the token is the dimension) of each changed entry's
    text, ``(new.text or old.text).strip()``."""
    from ..operators.semantics import text_for_vector, tokens
    ch = revision(spark, sf).changes.filter(F.col("change") == "changed")
    t = ch.select("doc_id", "entry_idx", F.explode(tokens(text_for_vector(F.col("old_text"), F.col("new_text"))))
                  .alias("token"))
    return t.groupBy("doc_id", "entry_idx", "token").agg(F.count(F.lit(1)).alias("tf"))


def q_text_vectors_mean(spark, sf):
    """The mean token vector of each changed entry's text; token vectors come from all documents."""
    from ..operators.semantics import mean_vectors, text_for_vector, token_vectors
    ch = revision(spark, sf).changes.filter(F.col("change") == "changed")
    points = ch.select("doc_id", "entry_idx", text_for_vector(F.col("old_text"), F.col("new_text")).alias("vtext"))
    m = mean_vectors(points, ["doc_id", "entry_idx"], "vtext", token_vectors(read_table(spark, sf, "documents"), "text"))
    return m.select("doc_id", "entry_idx", "n_tokens", F.posexplode("mean").alias("dim", "value"))


def q_doc_status_errors(spark, sf):
    """A10: document status with the readers' errors, here files whose every name has an unsupported suffix."""
    from ..operators.align import with_errors
    bad = q_route_files(spark, sf).groupBy(F.col("page_id").alias("doc_id")).agg(
        F.count("reader").alias("n"), F.max("reason").alias("reason")).filter("n = 0")
    s = with_errors(revision(spark, sf).status, bad.select("doc_id", "reason"))
    return s.select("doc_id", "in_old", "in_new", "n_old", "n_new", "status", F.array_join("reasons", ",").alias("reasons"))


def q_doc_status_indexed(spark, sf):
    """C1 from two snapshot indexes: written once, paired without an exchange."""
    import uuid
    from ..sources.snapshot_index import indexed_status, write_index
    run = uuid.uuid4().hex
    for side, lines in zip(("old", "new"), fixtures.revision_lines(read_table(spark, sf, "documents"))):
        write_index(lines, f"snapshot_{side}_{run}")
    return indexed_status(spark, f"snapshot_old_{run}", f"snapshot_new_{run}")


def q_embedding_cosine(spark, sf):
    v = fixtures.vector_pairs(spark, sf)
    return v.select("a_id", "b_id", T.round_half_up(vector_cosine(F.col("a"), F.col("b")), 4).alias("cosine"))


def q_cluster_k(spark, sf):
    """G7 per document: changed entries ``n``; no clusters below 3."""
    from ..operators.cluster import MIN_CHANGES, cluster_k
    n = F.col("n_changed")
    p = revision(spark, sf).change_counts().select("doc_id", F.col("changed").alias("n_changed"))
    return p.select("doc_id", "n_changed", F.when(n >= MIN_CHANGES, cluster_k(n)).cast("bigint").alias("k"))


# ---- F / H / I on the document revision ---------------------------------------------------------------
def q_score_changes(spark, sf):
    s = revision(spark, sf).scored
    return s.select("doc_id", "entry_idx", "change", "type", "score", "score_band")


def q_analyze_changes(spark, sf):
    a = revision(spark, sf).analyzed.filter(F.col("change") == "changed")
    return a.select("doc_id", "entry_idx", F.array_join("labels", ", ").alias("labels"), "semantic_score",
                    "change_type", "confidence")


def q_change_counts(spark, sf):
    return revision(spark, sf).change_counts()


def q_stats_by_type(spark, sf):
    return revision(spark, sf).stats_by_type()


def q_stats_rollup(spark, sf):
    return report.stats_rollup(revision(spark, sf).typed_entries)


def q_top_changes(spark, sf):
    return report.top_changes(revision(spark, sf).scored)


def q_toc(spark, sf):
    return revision(spark, sf).toc()


def q_doc_summary(spark, sf):
    return revision(spark, sf).summary()


def q_filter_changes(spark, sf):
    ch = revision(spark, sf).typed_entries
    return report.filter_changes(ch, ["changed", "added"], ["paragraph"]).select("doc_id", "entry_idx", "change", "type")


def q_type_facets(spark, sf):
    return report.type_facets(revision(spark, sf).typed_entries)


def q_corpus_top_k(spark, sf):
    return report.corpus_top_k(revision(spark, sf).analyzed, 100)


def _sink_dir(spark, name: str) -> str:
    """A fresh folder for a sink under the shared checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


def q_changes_json(spark, sf):
    """Entries written as JSON Lines and read back (explicit schema, absent keys -> null)."""
    from ..sources.sinks import write_changes_json
    path = _sink_dir(spark, "changes_json")
    ch = revision(spark, sf).changes
    write_changes_json(ch, path)
    schema = "doc_id bigint, entry_idx int, change string, type string, old_pos int, new_pos int, " \
             "old_text string, new_text string"
    return spark.read.schema(schema).json(path)


def q_report_rows(spark, sf):
    """A12 + E12-E15: report rows written as Parquet partitioned by ``change`` and read back."""
    from ..sources.sinks import write_report_rows
    path = _sink_dir(spark, "report_rows")
    write_report_rows(revision(spark, sf).analyzed, path)
    r = spark.read.parquet(path)
    return r.select("doc_id", "entry_idx", "change", "type", "score", "score_band", "semantic_score",
                    "change_type", "confidence", "labels", "ai_info")


def q_cluster_changes(spark, sf):
    from ..operators.cluster import cluster_changes
    a = revision(spark, sf).changes
    return cluster_changes(a)


def q_cluster_seeds(spark, sf):
    """The entries that the clusters of each document start from."""
    from ..operators.cluster import seeds, text_points, text_vectors
    pts = text_points(revision(spark, sf).changes)
    return seeds(pts, text_vectors(pts)).select("doc_id", F.col("cluster").cast("int").alias("cluster"),
                                                F.col("idx").cast("int").alias("idx"))


def q_cluster_members(spark, sf):
    """G6 by what must hold: every changed index of a document is in exactly one cluster, numbered below k."""
    c = q_cluster_changes(spark, sf)
    k = q_cluster_k(spark, sf).filter(F.col("k").isNotNull())
    return c.join(k, "doc_id").groupBy("doc_id", "idx").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min((F.col("cluster") >= 0) & (F.col("cluster") < F.col("k"))).alias("in_range"))


def q_type_distribution(spark, sf):
    return report.type_distribution(revision(spark, sf).analyzed).select("doc_id", "change_type", "n_changes")


def q_hide_unchanged(spark, sf):
    """I6."""
    return report.filter_changes(revision(spark, sf).entries, hide_unchanged=True).select(
        "doc_id", "entry_idx", "change")


def q_align_blocks_frontier(spark, sf):
    """C2-C7 by route 2 alone: every range of every document goes through the distributed rounds."""
    return revision(spark, sf, max_udf_blocks=0, small_range=0).entries.select("doc_id", "entry_idx", "change", "old_pos", "new_pos")


def q_cell_markup(spark, sf):
    """D3 in changed cells, checked by its invariant (see ``q_inline_diff``)."""
    pairs = fixtures.lineitem_revision_pairs(spark, sf)
    nested = celldiff.with_nested_markup(pairs.select(
        "doc_id", celldiff.nested_table_diff(F.col("old_table"), F.col("new_table")).alias("table_changes")))
    cells = nested.select("doc_id", F.posexplode("table_changes").alias("r", "row")).select(
        "doc_id", "r", F.posexplode("row").alias("c", "cell")).filter("cell.type = 'changed'")
    return cells.select("doc_id", "r", "c", strip_markup(F.col("cell.inline_html"), "old").alias("old_view"),
                        strip_markup(F.col("cell.inline_html"), "new").alias("new_view"))


# ---- documents of several block types -------------------------------------------------------------------
def mixed(spark: SparkSession, sf_dir: str, **kw) -> Comparison:
    return Comparison(*fixtures.mixed_revision(spark, sf_dir), **kw)


def q_mixed_changes(spark, sf):
    return mixed(spark, sf).changes.select("doc_id", "entry_idx", "change", "type", "old_pos", "new_pos")


def q_mixed_changes_exact(spark, sf):
    """B7 with exact dictionaries instead of hashes, all block types."""
    from ..operators.exact_keys import exact_keys
    old_docs, new_docs, old, new = fixtures.mixed_revision(spark, sf)
    return Comparison(old_docs, new_docs, *exact_keys(old, new)).changes.select(
        "doc_id", "entry_idx", "change", "type", "old_pos", "new_pos")


def q_key_collisions(spark, sf):
    """B7's audit: distinct keys and distinct hashes of every document's two versions."""
    from ..operators.exact_keys import keys_per_hash
    _, _, old, new = fixtures.mixed_revision(spark, sf)
    return keys_per_hash(old, new).groupBy("doc_id").agg(F.sum("n_keys").alias("n_keys"), F.count(F.lit(1)).alias("n_hashes"))


def q_mixed_stats_by_type(spark, sf):
    return mixed(spark, sf).stats_by_type()


def q_mixed_facets(spark, sf):
    return report.type_facets(mixed(spark, sf).changes)


def q_mixed_scores(spark, sf):
    """F1 with its bonus for tables and images."""
    return mixed(spark, sf).scored.select("doc_id", "entry_idx", "change", "type", "score", "score_band")


def q_mixed_toc(spark, sf):
    return mixed(spark, sf).toc()


def q_mixed_summary(spark, sf):
    return mixed(spark, sf).summary()


def q_mixed_json(spark, sf):
    """A11 with every kind of payload, read back."""
    from ..sources.sinks import write_changes_json
    path = _sink_dir(spark, "mixed_json")
    write_changes_json(mixed(spark, sf).detailed, path)
    schema = "doc_id bigint, entry_idx int, change string, type string, old_text string, new_text string, " \
             "old_table array<array<string>>, new_table array<array<string>>, old_sha1 string, new_sha1 string, " \
             "old_size bigint, new_size bigint, table_changes array<array<struct<type:string,inline_html:string>>>"
    r = spark.read.schema(schema).json(path)
    cells = F.flatten("table_changes")
    return r.select("doc_id", "entry_idx", "change", "type", "old_text", "new_text", "old_sha1", "new_sha1",
                    F.col("old_size"), F.col("new_size"), F.size("old_table").cast("bigint").alias("old_rows"),
                    F.size("new_table").cast("bigint").alias("new_rows"),
                    F.size(F.filter(cells, lambda c: c["type"] == "changed")).cast("bigint").alias("changed_cells"),
                    F.size(F.filter(cells, lambda c: c["inline_html"].isNotNull())).cast("bigint").alias("marked_cells"))


def queries() -> dict[str, Query]:
    return {
        "blocks_from_text": q_blocks_from_text,
        "table_blocks": q_table_blocks,
        "content_sha1": q_content_sha1,
        "route_files": q_route_files,
        "doc_status": q_doc_status,
        "added_docs": q_added_docs,
        "deleted_docs": q_deleted_docs,
        "align_blocks": q_align_blocks,
        "changed_pairs": q_changed_pairs,
        "change_ratio": q_change_ratio,
        "rebuild_new": q_rebuild_new,
        "rebuild_old": q_rebuild_old,
        "inline_diff": q_inline_diff,
        "text_ratio": q_text_ratio,
        "table_diff": q_table_diff,
        "snapshot_cell_diff": q_snapshot_cell_diff,
        "big_table_diff": q_big_table_diff,
        "text_predicates": q_text_predicates,
        "score_bonus": q_score_bonus,
        "labels": q_labels,
        "entity_labels": q_entity_labels,
        "text_cosine": q_text_cosine,
        "semantic_score": q_semantic_score,
        "embedding_cosine": q_embedding_cosine,
        "change_type": q_change_type,
        "text_vectors": q_text_vectors,
        "text_vectors_mean": q_text_vectors_mean,
        "doc_status_errors": q_doc_status_errors,
        "doc_status_indexed": q_doc_status_indexed,
        "cluster_k": q_cluster_k,
        "score_changes": q_score_changes,
        "analyze_changes": q_analyze_changes,
        "change_counts": q_change_counts,
        "stats_by_type": q_stats_by_type,
        "stats_rollup": q_stats_rollup,
        "top_changes": q_top_changes,
        "toc": q_toc,
        "doc_summary": q_doc_summary,
        "filter_changes": q_filter_changes,
        "type_facets": q_type_facets,
        "corpus_top_k": q_corpus_top_k,
        "cluster_changes": q_cluster_changes,
        "cluster_seeds": q_cluster_seeds,
        "cluster_members": q_cluster_members,
        "type_distribution": q_type_distribution,
        "hide_unchanged": q_hide_unchanged,
        "align_blocks_frontier": q_align_blocks_frontier,
        "cell_markup": q_cell_markup,
        "mixed_changes": q_mixed_changes,
        "mixed_changes_exact": q_mixed_changes_exact,
        "key_collisions": q_key_collisions,
        "mixed_stats_by_type": q_mixed_stats_by_type,
        "mixed_facets": q_mixed_facets,
        "mixed_scores": q_mixed_scores,
        "mixed_toc": q_mixed_toc,
        "mixed_summary": q_mixed_summary,
        "mixed_json": q_mixed_json,
        "changes_json": q_changes_json,
        "report_rows": q_report_rows,
    }
