"""Sources, keys and routing."""

import random
import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from palimpsest.functions.keys import block_key, conform_blocks
from palimpsest.sources.lines import read_text_files, text_blocks
from palimpsest.sources.routing import route_paths
from palimpsest.sources.tables import keep_nonempty_tables, table_blocks


def python_lines(text):
    import io
    return [ln.strip() for ln in io.StringIO(text, newline=None) if ln.strip()]


def test_text_blocks_match_python_line_reading(spark):
    texts = ["first line\nsecond line\n", "a\n\n   \nb\n", "x\r\ny\rz\n\x85 w  v", "", "  \t ", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in text_blocks(df).orderBy("doc_id", "block_pos").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in enumerate(texts):
        assert got.get(i, []) == python_lines(t), t         # R24


def test_text_files_with_invalid_bytes(spark):
    d = tempfile.mkdtemp(prefix="palimpsest-src-", dir="/tmp")
    with open(os.path.join(d, "a.txt"), "wb") as f:
        f.write(b"hello\n\x80\x80\nworld\n")
    docs = read_text_files(spark, d)
    rows = text_blocks(docs).orderBy("block_pos").collect()
    assert [r.text for r in rows][0::2] == ["hello", "world"] and len(rows) == 3 and rows[1].text   # R25
    assert docs.first().doc_name == "a.txt"


def test_table_blocks_and_keys(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, None, "2.5"), (2, 0, None, None)],
                               "t int, r int, c0 int, c1 string")
    b = {x.doc_id: x for x in table_blocks(df, "t", ["r"], ["c0", "c1"], sheet="Data").collect()}
    assert b[1].table == [["1", "a"], ["", "2.5"]] and b[1].sheet == "Data" and 2 not in b     # R26, R27
    k = conform_blocks(spark.createDataFrame(
        [(1, 0, "table", [["a,b"]], None), (1, 1, "table", [["a", "b"]], "S"), (1, 2, "image", None, None)],
        "doc_id bigint, block_pos int, type string, table array<array<string>>, sheet string"))
    keys = [r.k for r in k.select(block_key().alias("k")).orderBy("block_pos").collect()]
    assert keys == ["table:a,b", "table:S:a,b", "image:"]
    z = spark.createDataFrame([([["0", ""]],), ([["", ""]],)], "table array<array<string>>")
    assert keep_nonempty_tables(z).count() == 1


def test_route_files(spark):
    df = spark.createDataFrame([(p,) for p in ["a/b.DOCX", "x.doc", "t.txt", "s.xlsx", "s.xls", "r.pdf", ".bashrc",
                                               "http://h.example.com/x.txt?q=1", "https://m.example.net"]], "p string")
    got = [(r.ext, r.reader) for r in route_paths(df, "p").collect()]
    assert got == [(".docx", "docx"), (".doc", "docx"), (".txt", "txt"), (".xlsx", "xlsx"), (".xls", "xlsx"),
                   (".pdf", None), ("", None), (".txt", "txt"), ("", None)]                     # R29


def test_content_sha1(spark):
    df = spark.createDataFrame([(bytearray(b"imagedata"),)], "b binary")
    r = df.select(F.sha1("b").alias("h"), F.octet_length("b").alias("n")).first()
    assert (r.h, r.n) == (hashlib.sha1(b"imagedata").hexdigest(), 9)


def test_sinks(spark):
    import glob
    import json
    from palimpsest.sources.sinks import ai_info_present, write_changes_json, write_report_rows
    d = tempfile.mkdtemp(prefix="palimpsest-sink-", dir="/tmp")
    rows = [(1, 0, "unchanged", "paragraph", 0, 0, "Zażółć", None), (1, 1, "changed", "paragraph", 1, 1, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, entry_idx int, change string, type string, old_pos int, "
                                     "new_pos int, old_text string, new_text string")
    write_changes_json(df, f"{d}/json")
    lines = [json.loads(x) for f in glob.glob(f"{d}/json/*.json") for x in open(f, encoding="utf-8")]
    first = [x for x in lines if x["entry_idx"] == 0][0]
    assert "new_text" not in first and first["old_text"] == "Zażółć"          # absent key, non-ASCII kept
    a = df.withColumn("score", F.lit(1.0)).withColumn("labels", F.array().cast("array<string>")) \
        .withColumn("semantic_score", F.lit(None).cast("double")).withColumn("change_type", F.lit("")) \
        .withColumn("confidence", F.lit(None).cast("double")).withColumn("inline_html", F.lit(None).cast("string")) \
        .withColumn("old_sha1", F.lit(None).cast("string")).withColumn("new_sha1", F.lit(None).cast("string"))
    write_report_rows(a, f"{d}/rows")
    assert sorted(p.split("=")[-1] for p in glob.glob(f"{d}/rows/change=*")) == ["changed", "unchanged"]
    r = spark.read.parquet(f"{d}/rows").select("ai_info").distinct().collect()
    assert [x.ai_info for x in r] == [False]                                  # E15: nothing present
    assert spark.range(1).select(ai_info_present(F.array(F.lit("x")), F.lit(None), F.lit(""), F.lit(None))).first()[0]


def test_files_read_in_splits_equal_whole_files(spark, tmp_path):
    """40 files under 10 split sizes (25, from one byte on, when it was written): line breaks of every kind, also across splits, invalid bytes, blank files."""
    from palimpsest.sources.lines import read_text_blocks, read_text_files, text_blocks
    rnd = random.Random(8)
    pieces = [b"\n", b"\r", b"\r\n", b"\r\n", b"\n\n", b" ", b"\t", b"word", "größe".encode(), "日本".encode(), b"\xff", b"\xe2\x82",
              b"a", b" b ", b"\xc2\xa0", b"\x0b", b"\x1c"]
    folder = tmp_path / "in put"
    (folder / "deep+er").mkdir(parents=True)
    for k in range(38):
        data = b"".join(rnd.choice(pieces) for _ in range(rnd.randrange(200)))
        (folder / ("deep+er" if k % 3 == 0 else ".") / f"f {k}%.txt").write_bytes(data)
    (folder / "empty.txt").write_bytes(b"")
    (folder / "blank.txt").write_bytes(b"\r\n \r\n\r")
    files = read_text_files(spark, f"{folder}/*/*.txt", str(folder)).union(read_text_files(spark, f"{folder}/*.txt", str(folder)))
    want = sorted((r.doc_id, r.block_pos, r.text) for r in text_blocks(files).collect())
    assert len(want) > 300
    names = sorted((r.doc_id, r.doc_name) for r in files.collect())
    conf, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in [5, 1 << 20] + [rnd.randint(20, 400) for _ in range(8)]:
            spark.conf.set(conf, str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", str(rnd.choice([0, 1, 50])))
            got, seen = [], []
            for glob in (f"{folder}/*/*.txt", f"{folder}/*.txt"):
                manifest, blocks = read_text_blocks(spark, glob, str(folder))
                got += [(r.doc_id, r.block_pos, r.text) for r in blocks.collect()]
                seen += [(r.doc_id, r.doc_name) for r in manifest.collect()]
            assert (sorted(got), sorted(seen)) == (want, names), size
    finally:
        spark.conf.set(conf, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    from palimpsest.sources.lines import read_text_blocks
    (tmp_path / "big.txt").write_text("".join(f"line {k}\n" for k in range(200_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 17))
        _, blocks = read_text_blocks(spark, str(tmp_path))
        assert blocks.rdd.getNumPartitions() >= 16
        assert blocks.where("text <> concat('line ', block_pos)").count() == 0 and blocks.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_snapshot_index_pairs_without_an_exchange(spark):
    import uuid
    from palimpsest.operators.text_align import text_status
    from palimpsest.sources.snapshot_index import indexed_status, write_index
    old = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["x"]), (4, ["y"])], "doc_id long, lines array<string>")
    new = spark.createDataFrame([(1, ["a", "c"]), (2, []), (3, ["x"]), (5, ["z", "z"])], "doc_id long, lines array<string>")
    names = [f"{side}_{uuid.uuid4().hex}" for side in ("old", "new")]
    for name, lines in zip(names, (old, new)):
        write_index(lines, name, buckets=4)
    got = indexed_status(spark, *names)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(text_status(old, new).select(*got.columns).collect())
    assert {r.doc_id: r.status for r in got.collect()} == {1: "changed", 2: "unchanged", 3: "unchanged", 4: "deleted", 5: "added"}
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_status_with_reader_errors(spark):
    from palimpsest.operators.align import with_errors
    from palimpsest.operators.text_align import text_status
    old = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"]), (4, ["d"])], "doc_id long, lines array<string>")
    new = spark.createDataFrame([(1, ["a"]), (2, ["x"]), (4, []), (5, ["e"])], "doc_id long, lines array<string>")
    errors = spark.createDataFrame([(4, "bad zip"), (4, "again"), (4, "again"), (9, "not there")], "doc_id long, reason string")
    got = {r.doc_id: r for r in with_errors(text_status(old, new), errors).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "unchanged", 2: "changed", 3: "deleted", 4: "parse_error",
                                                     5: "added", 9: "parse_error"}
    assert got[4].reasons == ["again", "bad zip"] and got[1].reasons is None and not got[9].in_old and got[9].n_new == 0
    assert {r.status for r in with_errors(text_status(old, new), errors.where("false")).collect()} == {
        "unchanged", "changed", "deleted", "added"}


def test_mixed_revision_groups_named_orders_only_and_reads_its_inputs_once(spark):
    from palimpsest.sources.fixtures import mixed_revision
    d = tempfile.mkdtemp(prefix="palimpsest-mixed-", dir="/tmp")
    spark.createDataFrame([(1, "a\nb"), (2, "c"), (2, "d"), (None, "e")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(
        [(1, 1, 3, 13, "N", 2.0), (2, 2, 7, 5, "R", 1.0), (2, 1, 3, 13, "A", 4.0), (8, 1, 1, 1, "N", 1.0), (None, 1, 1, 1, "N", 1.0)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double"
    ).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "p"), (2, "q"), (9, "r")], "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    _, _, old, new = mixed_revision(spark, d)
    for side in (old, new):
        assert all("/stored/" in f for f in side.inputFiles())      # neither lineitem nor documents again
    rows = lambda side, kind: sorted((r.doc_id, r.block_pos, r.table) for r in side.filter(F.col("type") == kind).collect())
    t1, t2 = [["1", "N", "2.00"]], [["1", "A", "4.00"], ["2", "R", "1.00"]]
    assert rows(old, "table") == [(1, 2, t1), (2, 1, t2), (2, 1, t2)]
    assert rows(new, "table") == [(2, 1, [["2", "R", "2.00"]])] * 2  # order 1 has lost its only line
    assert [r[:2] for r in rows(old, "image")] == [(1, 3), (2, 2), (2, 2)]
    assert [r[:2] for r in rows(new, "image")] == [(1, 2), (2, 2), (2, 2)]
