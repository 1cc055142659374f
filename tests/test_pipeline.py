"""The whole pipeline on mixed block types (generic block path): D6 dispatch, F1 type bonus, F5 on
non-text pairs (reference consequences noted in the survey)."""

from pyspark.sql import functions as F

from palimpsest.functions.keys import conform_blocks
from palimpsest.plans.compare import Comparison

SCHEMA = "doc_id bigint, block_pos int, type string, text string, table array<array<string>>, sha1 string"


def test_mixed_blocks_pipeline(spark):
    old = conform_blocks(spark.createDataFrame([
        (1, 0, "paragraph", "value 12", None, None),
        (1, 1, "table", None, [["A", "B"], ["C", "D"]], None),
        (1, 2, "image", None, None, "abc"),
        (1, 3, "paragraph", "same", None, None)], SCHEMA))
    new = conform_blocks(spark.createDataFrame([
        (1, 0, "paragraph", "value 13 kg 2024", None, None),
        (1, 1, "table", None, [["A", "X"], ["C", "D"], ["E", "F"]], None),
        (1, 2, "image", None, None, "def"),
        (1, 3, "paragraph", "same", None, None)], SCHEMA))
    m = spark.createDataFrame([(1,)], "doc_id bigint")
    c = Comparison(m, m, old, new)
    rows = {r.entry_idx: r for r in c.analyzed.collect()}
    assert [rows[i].change for i in range(4)] == ["changed", "changed", "changed", "unchanged"]
    p, t, img, same = rows[0], rows[1], rows[2], rows[3]
    assert p.inline_html == "value 1<ins>3 kg </ins>2<ins>024</ins>" and p.table_changes is None
    assert t.inline_html is None and t.type == "table"
    cells = [[(x.type, x.text, x.old, x.new) for x in r] for r in t.table_changes]
    assert cells[0][1] == ("changed", None, "B", "X") and cells[2][0] == ("changed", None, "", "E")
    assert t.table_changes[0][1].inline_html == "<del>B</del><ins>X</ins>" and t.table_changes[0][0].inline_html is None
    assert p.score > 1.0                                            # digit + unit + year terms (R23)
    # a table pair has no text: ratio('', '') = 1.0, so the score is the type bonus alone
    assert t.ratio == 1.0 and t.score == 2.0
    # changed image/table: similarity 0 -> semantic score 10.0, confidence 0.15, editorial, no labels
    for r in (t, img):
        assert (r.semantic_score, r.confidence, r.change_type, r.labels) == (10.0, 0.15, "editorial", [])
    assert same.semantic_score is None and same.score == 0.0
    s = c.summary().first()
    assert s.summary.startswith("The document contains 3 changes (out of 4 blocks)")
    toc = c.toc().orderBy("rank").collect()
    assert [r.entry_idx for r in toc][:2] == [1, 2]               # 10 + score * 0.1 beats the paragraph
