"""Alignment against Python's difflib, both routes, and the rebuild invariant."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.keys import conform_blocks
from palimpsest.operators import align
from palimpsest.operators.align_frontier import frontier_opcodes
from palimpsest.operators.exact_keys import collisions, exact_keys
from palimpsest.plans.compare import Comparison


def check_entries(entries, a, b):
    """Entries ``(change, old_pos, new_pos)`` in order: both sides are complete and in order, the unchanged
    ones are the library's matching blocks, and between two blocks pairs come before what is left over."""
    assert [o for _, o, _ in entries if o is not None] == list(range(len(a)))
    assert [n for _, _, n in entries if n is not None] == list(range(len(b)))
    blocks = SequenceMatcher(None, a, b).get_matching_blocks()
    want = [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]
    assert [(o, n) for c, o, n in entries if c == "unchanged"] == want
    kinds = {(True, True): "changed", (True, False): "deleted", (False, True): "added"}
    assert all(c == kinds[o is not None, n is not None] for c, o, n in entries if c != "unchanged")
    gap = []
    for c in [c for c, _, _ in entries] + ["unchanged"]:
        if c != "unchanged":
            gap.append(c)
            continue
        assert gap == sorted(gap, key=lambda x: x != "changed") and not {"deleted", "added"} <= set(gap)
        gap = []


def blocks_df(spark, docs):
    rows = [(d, p, "paragraph", t) for d, lines in docs.items() for p, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id bigint, block_pos int, type string, text string")
    return conform_blocks(df)


def manifest_df(spark, docs):
    return spark.createDataFrame([(d,) for d in docs], "doc_id bigint")


def random_docs(seed, n_docs, alphabet, max_len):
    rnd = random.Random(seed)
    old, new = {}, {}
    for d in range(n_docs):
        a = [rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            op = rnd.random()
            if op < 0.3 and b:
                del b[rnd.randrange(len(b))]
            elif op < 0.6:
                b.insert(rnd.randint(0, len(b)), rnd.choice(alphabet))
            elif b:
                b[rnd.randrange(len(b))] = rnd.choice(alphabet)
        if rnd.random() < 0.2:
            b = [rnd.choice(alphabet) for _ in range(rnd.randint(0, max_len))]
        old[d], new[d] = a, b
    return old, new


def run_entries(spark, old, new, max_udf_blocks):
    entries = align.align_blocks(manifest_df(spark, old), manifest_df(spark, new), blocks_df(spark, old),
                                 blocks_df(spark, new), max_udf_blocks=max_udf_blocks, with_payload=False)
    got = {}
    for r in entries.collect():
        got.setdefault(r.doc_id, []).append((r.entry_idx, r.change, r.old_pos, r.new_pos))
    return {d: [x[1:] for x in sorted(v)] for d, v in got.items()}


@pytest.mark.parametrize("route_bound,small_range", [(10_000, None), (0, None), (0, 0), (0, 12)])
def test_entries_match_difflib(spark, monkeypatch, route_bound, small_range):
    """Route 1; route 2 finished in the Arrow pass; route 2 loop only; route 2 loop + Arrow pass."""
    import palimpsest.operators.align_frontier as AF
    if small_range is not None:
        monkeypatch.setattr(AF, "SMALL_RANGE", small_range)
    old, new = random_docs(7, 40, list("abcdefg"), 30)
    got = run_entries(spark, old, new, route_bound)
    for d in old:
        check_entries(got.get(d, []), old[d], new[d])


@pytest.mark.parametrize("small_range", [0, 150])
def test_frontier_matches_difflib_with_popular_elements(spark, monkeypatch, small_range):
    """Sequences of >= 200 elements with popular keys exercise the autojunk rule in route 2 (loop only,
    and loop + Arrow pass with the global popular set)."""
    import palimpsest.operators.align_frontier as AF
    monkeypatch.setattr(AF, "SMALL_RANGE", small_range)
    old, new = random_docs(11, 6, list("abc") + [f"w{i}" for i in range(40)], 400)
    got = run_entries(spark, old, new, 0)
    for d in old:
        check_entries(got.get(d, []), old[d], new[d])


def test_prefix_trimming_trap(spark):
    """a='xab', b='xbxab': the whole of a matches at b[2:], not at the shared leading x."""
    old, new = {1: list("xab")}, {1: list("xbxab")}
    for bound in (100, 0):
        got = run_entries(spark, old, new, bound)[1]
        check_entries(got, list("xab"), list("xbxab"))
        assert got == [("added", None, 0), ("added", None, 1), ("unchanged", 0, 2), ("unchanged", 1, 3), ("unchanged", 2, 4)]


def test_reference_cases(spark):
    """Unchanged carries the old block; A,B -> B,C; unknown types compare by name."""
    old = conform_blocks(spark.createDataFrame(
        [(1, 0, "paragraph", "Hello"), (2, 0, "paragraph", "A"), (2, 1, "paragraph", "B"), (3, 0, "weird", None)],
        "doc_id bigint, block_pos int, type string, text string"))
    new = conform_blocks(spark.createDataFrame(
        [(1, 0, "paragraph", "Hello"), (2, 0, "paragraph", "B"), (2, 1, "paragraph", "C"), (3, 0, "weird", None)],
        "doc_id bigint, block_pos int, type string, text string"))
    m = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    ch = align.align_blocks(m, m, old, new).orderBy("doc_id", "entry_idx").collect()
    assert [(r.doc_id, r.change, r.old_text, r.type) for r in ch] == [
        (1, "unchanged", "Hello", "paragraph"), (2, "deleted", "A", "paragraph"), (2, "unchanged", "B", "paragraph"),
        (2, "added", None, "paragraph"), (3, "unchanged", None, "weird")]
    assert ch[3].new_text == "C"


def test_image_change_pairs(spark):
    """Image sha abc -> def is one changed entry with both blocks."""
    o = conform_blocks(spark.createDataFrame([(1, 0, "image", "abc")], "doc_id bigint, block_pos int, type string, sha1 string"))
    n = conform_blocks(spark.createDataFrame([(1, 0, "image", "def")], "doc_id bigint, block_pos int, type string, sha1 string"))
    m = spark.createDataFrame([(1,)], "doc_id bigint")
    r = align.align_blocks(m, m, o, n).collect()
    assert len(r) == 1 and r[0].change == "changed" and (r[0].old_sha1, r[0].new_sha1) == ("abc", "def")
    assert r[0].type == "image"


def test_routes_agree_on_corpus(spark):
    from palimpsest.sources import fixtures
    from palimpsest.session import read_table
    ol, nl = fixtures.revision_lines(read_table(spark, "/root/testdata/sf0.001", "documents"))
    text = Comparison.from_lines(ol, nl).entries
    generic = Comparison.from_lines(ol, nl)
    generic.old_lines = generic.new_lines = None      # generic blocks path
    generic.max_udf_blocks = 0                         # everything through route 2
    cols = ["doc_id", "entry_idx", "change", "old_pos", "new_pos"]
    a = sorted(tuple(r) for r in text.select(*cols).collect())
    b = sorted(tuple(r) for r in generic.entries.select(*cols).collect())
    assert a == b


def test_registered_frontier_runs_in_the_loop_alone(spark, monkeypatch):
    import __spark_entry__ as E
    import palimpsest.operators.align_frontier as AF
    left, finish = [], AF._finish_small_ranges

    def recorded(small, state):
        left.append(small.count())
        return finish(small, state)

    monkeypatch.setattr(AF, "_finish_small_ranges", recorded)
    got = E.queries()["align_blocks_frontier"](spark, "/root/testdata/sf0.001").collect()
    want = E.queries()["align_blocks"](spark, "/root/testdata/sf0.001").collect()
    assert not any(left)
    assert sorted(map(str, got)) == sorted(map(str, want))


def _rounds(monkeypatch):
    """Records the rounds and the rows of every table that route 2 writes."""
    import palimpsest.operators.align_frontier as AF
    seen, put = [], AF.RoundStore.put

    def recorded(self, name, number, df):
        seen.append((name, number))
        return put(self, name, number, df)

    monkeypatch.setattr(AF.RoundStore, "put", recorded)
    return seen


def _segments(spark, a, b, autojunk=True):
    from palimpsest.operators.align_frontier import frontier_segments
    docs = spark.createDataFrame([(1, len(a), len(b))], "doc_id bigint, n_old bigint, n_new bigint")
    return frontier_segments(docs, blocks_df(spark, {1: a}), blocks_df(spark, {1: b}), autojunk, 0)


def _matches(rows):
    return sorted((r.i, r.j, r.lo) for r in rows if r.is_match)


def _library(a, b, autojunk=True):
    out = []
    for tag, i1, i2, j1, _ in SequenceMatcher(None, a, b, autojunk=autojunk).get_opcodes():
        if tag == "equal":
            out.append((i1, j1, i2 - i1))
    return out


def test_runs_in_order_take_one_round(spark, monkeypatch):
    """Eight runs, each shorter than the one before: the recursion is eight deep, the rounds are not."""
    a, b = [], []
    for r, size in enumerate(range(16, 8, -1)):
        run = [f"r{r}.{k}" for k in range(size)]
        a += run + [f"old{r}"]
        b += [f"new{r}"] + run
    seen = _rounds(monkeypatch)
    got = _segments(spark, a, b)
    assert _matches(got.collect()) == _library(a, b)
    assert max(n for name, n in seen if name == "chosen") <= 2
    relations = got._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    moved = [f"m{k}" for k in range(30)]  # crossing and repeated runs: more rounds, the same plan
    a, b = moved[10:20] + ["x"] * 5 + moved[:10] + ["y", "x", "z"] * 3, moved[:10] + ["x", "z"] * 4 + moved[10:20] + ["y", "x"] * 3
    longer = _segments(spark, a, b)
    assert _matches(longer.collect()) == _library(a, b)
    assert max(n for name, n in seen if name == "chosen") > 2
    assert longer._jdf.queryExecution().optimizedPlan().toString().count("Relation") == relations == 1


def test_one_line_repeated_pairs_nothing(spark, monkeypatch):
    n = 5_000
    seen = _rounds(monkeypatch)
    got = _segments(spark, ["x"] * n, ["y"] + ["x"] * (n + 3), autojunk=False).collect()
    assert sorted((r.i, r.j, r.lo, r.ln, r.is_match) for r in got) == [
        (0, 0, 0, 1, False), (0, 1, n, n, True), (n, n + 1, 0, 3, False)]
    assert max(k for name, k in seen if name == "chosen") == 1


def test_long_texts_are_aligned_by_stored_keys(spark, monkeypatch):
    """Route 2 of a text corpus gets keys stored once instead of texts, and collects none of them."""
    old, new = random_docs(5, 6, list("abcdef"), 20)
    seen, whole = [], align.align_blocks

    def recorded(old_docs, new_docs, *blocks, **kw):
        seen.extend(blocks[:2])
        return whole(old_docs, new_docs, *blocks, **kw)

    def collected(blocks):
        raise AssertionError("key arrays of route 1")

    monkeypatch.setattr(align, "align_blocks", recorded)
    monkeypatch.setattr(align, "document_keys", collected)
    sides = [spark.createDataFrame(list(d.items()), "doc_id bigint, lines array<string>") for d in (old, new)]
    c = Comparison.from_lines(*sides, max_udf_blocks=0, small_range=0)
    for rows in (c.entries, c.changes):
        got = rows.orderBy("doc_id", "entry_idx").collect()
        for d in old:
            check_entries([(r.change, r.old_pos, r.new_pos) for r in got if r.doc_id == d], old[d], new[d])
    for r in got:  # the texts are those of the places
        assert r.old_text == (None if r.old_pos is None else old[r.doc_id][r.old_pos])
        assert r.new_text == (new[r.doc_id][r.new_pos] if r.change in ("changed", "added") else None)
    assert len(seen) == 4
    for side in seen:
        assert side.inputFiles() and all("/stored/" in f for f in side.inputFiles())
        assert side.filter("text IS NOT NULL").isEmpty()


def test_single_lines_take_one_round_and_no_longer_windows(spark, monkeypatch):
    a = [f"l{k}" for k in range(40)]
    b = [x + "!" if k % 8 == 7 else x for k, x in enumerate(a)]
    seen = _rounds(monkeypatch)
    assert _matches(_segments(spark, a, b).collect()) == _library(a, b)
    assert max(n for name, n in seen if name == "chosen") == 1
    assert max(n for name, n in seen if name == "levels") == 1  # its table is empty


def test_only_documents_with_popular_keys_are_extended(spark, monkeypatch):
    import palimpsest.operators.align_frontier as AF
    extended, extend = set(), AF._extended

    def recorded(runs, *rest):
        extended.update(r.doc_id for r in runs.select("doc_id").collect())
        return extend(runs, *rest)

    monkeypatch.setattr(AF, "_extended", recorded)
    monkeypatch.setattr(AF, "SMALL_RANGE", 0)
    plain = [f"p{k}" for k in range(30)]
    often = [x for k in range(120) for x in (f"o{k}", "again")]
    old = {1: plain, 2: often, 3: plain[:9] * 3, 4: ["again"] * 5}
    new = {1: plain[15:] + ["x"] + plain[:15], 2: ["again", "new"] + often[40:] + ["again"] * 3 + often[:40],
           3: plain[3:9] * 4 + plain[:5], 4: ["x"] + ["again"] * 4}
    got = run_entries(spark, old, new, 0)
    for d in old:
        check_entries(got[d], old[d], new[d])
    assert extended == {2}


@pytest.mark.parametrize("route", ["udf", "rounds"])
def test_exact_keys_survive_forced_collisions(spark, route):
    old, new = random_docs(31, 8, "abcd", 14)
    two = lambda key: F.length(key).cast("bigint")  # noqa: E731  every line of one letter has one hash
    docs = [manifest_df(spark, d) for d in (old, new)]
    blocks = [blocks_df(spark, d) for d in (old, new)]
    assert collisions(*blocks, two).count() and not collisions(*blocks).count()
    keyed = exact_keys(*blocks, two)
    kw = {} if route == "udf" else {"max_udf_blocks": 0, "small_range": 0}
    got = Comparison(*docs, *keyed, **kw).changes.orderBy("doc_id", "entry_idx").collect()
    for d in old:
        check_entries([(r.change, r.old_pos, r.new_pos) for r in got if r.doc_id == d], old[d], new[d])
    assert {r.old_text for r in got if r.old_text is not None} <= set("abcd")


def test_exact_keys_of_all_block_types_nulls_and_empty_tables(spark):
    b = conform_blocks(spark.createDataFrame(
        [(1, 0, "paragraph", "x", None), (1, 1, "paragraph", None, None), (1, 2, "image", None, "s"), (1, 3, None, None, None),
         (2, 0, "paragraph", "x", None)], "doc_id bigint, block_pos int, type string, text string, sha1 string"))
    old, new = exact_keys(b, b.limit(0))
    assert sorted((r.doc_id, r.block_pos) for r in old.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert len({r.key_hash for r in old.filter("doc_id = 1").collect()}) == 4 and new.count() == 0
    assert old.filter("doc_id = 2").first().key_hash == 1      # ids are dense within a document


def test_exact_keys_joins_its_texts_once(spark):
    old, new = random_docs(7, 3, "abcd", 9)
    blocks = [blocks_df(spark, d) for d in (old, new)]
    for hash_of in ({}, {"hash_of": lambda key: F.length(key).cast("bigint")}):
        for before, side in zip(blocks, exact_keys(*blocks, **hash_of)):
            assert side.inputFiles() and all("/stored/" in f for f in side.inputFiles())
            assert side.count() == before.count()
            ids = side.groupBy("doc_id", "key_hash").agg(F.count_distinct("text").alias("n")).agg(F.max("n")).first()[0]
            assert ids == 1
