"""Stats, rankings, summary."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import report


def entries(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, entry_idx int, change string, type string, score double, "
                                       "semantic_score double, change_type string, labels array<string>")


def test_counts_and_types(spark):
    df = entries(spark, [(1, 0, "added", "paragraph", 2.5, None, None, None),
                         (1, 1, "deleted", "table", 4.5, None, None, None),
                         (1, 2, "unchanged", "paragraph", 0.0, None, None, None),
                         (1, 3, "changed", "paragraph", 1.0, 2.0, "formal", []),
                         (1, 4, "changed", "image", 2.0, 10.0, "editorial", []),
                         (1, 5, "changed", "table", 3.0, 10.0, "editorial", [])])
    c = report.change_counts(df).first()
    assert (c.added, c.deleted, c.changed, c.unchanged, c.total_blocks) == (1, 1, 3, 1, 6)   # R22
    t = {r.type: (r.added, r.deleted, r.changed, r.unchanged) for r in report.stats_by_type(df).collect()}
    assert t == {"paragraph": (1, 0, 1, 1), "table": (0, 1, 1, 0), "image": (0, 0, 1, 0)}
    roll = {(r.doc_id, r.type): r.total_blocks for r in report.stats_rollup(df).collect()}
    assert roll[(None, None)] == 6 and roll[(1, None)] == 6


def test_top_changes_and_toc_tie_breaks(spark):
    df = entries(spark, [(1, 0, "added", "paragraph", 2.5, None, None, None),
                         (1, 1, "deleted", "paragraph", 2.5, None, None, None),
                         (1, 2, "unchanged", "paragraph", 9.0, None, None, None),
                         (1, 3, "changed", "paragraph", 1.0, 1.4, "formal", [])])
    df = df.withColumn("toc_key", F.when(F.col("semantic_score").isNull(), F.col("score") * 0.6)
                       .otherwise(F.col("semantic_score") + F.col("score") * 0.1))
    top = [r.entry_idx for r in report.top_changes(df).orderBy("rank").collect()]
    assert top == [1, 0, 3]                                  # (score, idx) both descending, no unchanged
    toc = report.toc(df).orderBy("rank").collect()
    assert [r.entry_idx for r in toc] == [0, 1, 3]           # stable: ties in entry order
    assert toc[2].toc_label == "#3(blk) 1.4/10" and toc[0].toc_label == "#0(paragraph) s=2.5"


def test_summary(spark):
    df = entries(spark, [(1, 0, "changed", "paragraph", 1.0, 1.0, "technical", ["date"]),
                         (1, 1, "changed", "paragraph", 1.0, 1.0, "formal", ["number"]),
                         (1, 2, "changed", "paragraph", 1.0, 1.0, "technical", ["unit"]),
                         (2, 0, "unchanged", "paragraph", 0.0, None, None, None),
                         (3, 0, "changed", "paragraph", 1.0, 1.0, "formal", []),
                         (3, 1, "changed", "paragraph", 1.0, 1.0, "", [])])
    s = {r.doc_id: r for r in report.doc_summary(df).collect()}
    assert s[1].summary == ("The document contains 3 changes (out of 3 blocks), of which 66.7% are of type "
                            "<b>technical</b>. Dominant AI labels: date, number, unit.")          # R21
    assert s[2].summary.startswith("No significant")                                               # R20
    assert s[3].dominant_type == "formal" and s[3].dominant_share == 50.0 and s[3].label_set == "none"


def test_filters_and_facets(spark):
    df = entries(spark, [(1, 0, "added", "table", 0.0, None, None, None), (1, 1, "changed", "paragraph", 0.0, None, None, None),
                         (1, 2, "unchanged", "paragraph", 0.0, None, None, None)])
    assert report.filter_changes(df).count() == 3
    assert report.filter_changes(df, ["changed", "added"], ["paragraph"]).count() == 1
    assert report.filter_changes(df, hide_unchanged=True).count() == 2
    f = [(r.type, r.facet_pos) for r in report.type_facets(df).orderBy("facet_pos").collect()]
    assert f == [("table", 1), ("paragraph", 2)]
    assert [r.entry_idx for r in report.corpus_top_k(df.withColumn("toc_key", F.lit(1.0)), 1).collect()] == [0]


@pytest.mark.parametrize("rows,parts", [(1_200_000, 1), (1_200_000, 8), (3_000_000, 64)])
def test_ranking_helpers_in_one_large_group(spark, rows, parts):
    """Exact ranks and running sums of a group of millions of rows, however it is partitioned."""
    from palimpsest.functions.ranking import rank_within, running_sum_within, slice_of
    df = spark.range(rows).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(rows)).alias("i")) \
        .repartition(parts).withColumn("v", F.col("i") % 5)
    ranked = rank_within(df, ["g"], [F.col("v").desc(), F.col("i").desc()], [(F.col("v"), False), (slice_of("i"), False)])
    per = rows // 5                                    # rows of each v: i = v, v + 5, v + 10, ...
    want = (4 - F.col("v")) * per + (per - F.floor(F.col("i") / 5))
    assert ranked.filter(F.col("rank") != want).count() == 0 and ranked.count() == rows
    summed = running_sum_within(df, ["g"], [F.col("i")], [(slice_of("i"), True)], "v", "cs")
    full, rest = F.floor(F.col("i") / 5), F.col("i") % 5
    assert summed.filter(F.col("cs") != full * 10 + rest * (rest - 1) / 2).count() == 0 and summed.count() == rows


def test_unexpected_changes_are_counted(spark):
    df = spark.createDataFrame([(1, 0, "added", "p"), (1, 1, "moved", "p"), (1, 2, None, "p")],
                               "doc_id long, entry_idx int, change string, type string")
    r = report.change_counts(df).first()
    assert (r.added, r.unknown, r.other, r.total_blocks) == (1, 1, 1, 3)


def test_any_change_type_may_dominate(spark):
    df = spark.createDataFrame([(1, 0, "changed", "odd", ["b"]), (1, 1, "changed", "odd", ["a"]), (1, 2, "changed", "", None),
                                (1, 3, "unchanged", None, None)],
                               "doc_id long, entry_idx int, change string, change_type string, labels array<string>")
    r = report.doc_summary(df).first()
    assert (r.dominant_type, r.n_changed, r.total_blocks, r.dominant_share, r.label_set) == ("odd", 3, 4, 66.7, "a, b")
    assert {(x.change_type, x.n_changes) for x in report.type_distribution(df).collect()} == {("odd", 2), ("undefined", 1)}
