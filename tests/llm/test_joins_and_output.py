"""Operators 1, 2, 3, 6, 7 and 8 and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import group_join, importance, line_templates, source_mix, template_leaks, token_files
from palimpsest.llm.common import components
from palimpsest.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _shingles(t):
    w = WORD.findall(_lower(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _brute_components(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, j in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        k = len(sets[i] & sets[j])
        if 100 * k >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [(d, len(s), low[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("often", [3, 32])
def test_join_matches_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(group_join, "OFTEN", often)  # the choice of often-seen tokens never changes the result
    monkeypatch.setattr(group_join, "CHUNK", 2 * often)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 6)))
    common = [word() for _ in range(60)]
    rows = []
    for g in range(12):  # chains of near copies around the threshold, on top of a shared passage
        text = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(2, 25)):
            rows.append((len(rows), " ".join(text + (common if rng.random() < .5 else []))))
            at = rng.randrange(len(text))
            text = text[:at] + [word() for _ in range(rng.randint(0, 2))] + text[at + 1:]
    for _ in range(80):
        rows.append((len(rows), " ".join(common + [word() for _ in range(rng.randint(5, 18))])))
    base = [word() for _ in range(100)]
    for _ in range(150):  # one large group of near copies
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = word()
        rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["A b", "a  B", "a b c", "", None, "\n", rows[0][1].upper()])]
    got = group_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert _sorted(got) == _sorted(_brute_components(rows))


def test_join_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _sorted(queries()["op1_group_join"](spark, SF).collect()) == _sorted(_brute_components(rows))


def test_join_odd_tables(spark, odd_docs, no_docs):
    assert group_join.join(no_docs).count() == 0
    got = _sorted(group_join.join(odd_docs).collect())
    assert got == _sorted(_brute_components([(r.doc_id, r.text) for r in odd_docs.collect()]))
    kept = group_join.dedup(odd_docs)
    assert kept.columns == odd_docs.columns and group_join.dedup(no_docs).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None"]
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z x y z"), (2, "A b c d e f"), (None, "x y z x y z"), (1, "")],
                                 "doc_id long, text string")
    assert sorted(r.text for r in group_join.dedup(same).collect()) == ["", "a b c d e f", "x y z x y z"]


def test_components_of_a_path_and_a_star(spark):
    n = 300
    pairs = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 5000)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(n))


def _brute_targets(size_of):
    order = sorted(size_of, key=lambda s: (s is None, s))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(size_of.values())), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * size_of[s]:
                left += target[s] - 3 * size_of[s]
                target[s] = 3.0 * size_of[s]
                open_.discard(s)
    return target


def test_mix_targets_and_sizes(spark):
    rows = queries()["op2_source_mix"](spark, SF).collect()
    again = queries()["op2_source_mix"](spark, SF).collect()
    assert _sorted(rows) == _sorted(again)
    text = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size_of, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.size == len(WORD.findall(text[r.doc_id].text)) and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        size_of[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    want = _brute_targets(size_of)
    for s in size_of:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s]


def test_mix_caps_and_nulls(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate(
        [(2, "a"), (1, "a"), (500, "b"), (300, "b"), (400, "c"), (100, None), (0, "d"), (7, "é"), (9, "z")])],
        "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", source_mix.n_words(F.col("text")).alias("size"))
    got = source_mix.rounded(sized).collect()
    size_of = Counter()
    for r in got:
        size_of[r.source] += r["size"]
    want = _brute_targets(size_of)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
    assert {r.copies for r in got if r.source == "a"} == {3}  # stopped at three times its size


def test_rounding_keeps_chances_and_sums():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 400) for _ in range(60)), reverse=True)
    hits, off = np.zeros(len(sizes)), []
    for run in range(3000):
        out = source_mix.pivot(sizes, [0.37] * len(sizes), (run,))
        assert sum(0 < x < 1 for x in out) <= 1
        off.append(sum(a * x for a, x in zip(sizes, out)) - 0.37 * sum(sizes))
        hits += out
    assert max(map(abs, off)) < 1e-4 and abs(hits / 3000 - 0.37).max() < 0.05
    chances = [rng.random() for _ in sizes]
    for run in range(200):
        out = source_mix.pivot(sizes, chances, (run,))
        assert sum(0 < x < 1 for x in out) <= 1
        assert sum(a * (x - y) for a, x, y in zip(sizes, out, chances)) == pytest.approx(0, abs=1e-4)


def test_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BUCKET_ROWS", 20)
    monkeypatch.setattr(source_mix, "FAN", 3)
    sized = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot").otherwise("x").alias("source"),
                                     (F.col("id") % 37 + 1).alias("size"))
    got = source_mix.rounded(sized).collect()
    for s in ("hot", "x"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in mine) - mine[0].target) <= 37 and len(mine) in (1500, 500)


def test_mix_rows(spark, odd_docs, no_docs):
    assert source_mix.mix(no_docs).count() == 0
    out = source_mix.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert max(Counter(r.doc_id for r in out.collect() if r.doc_id not in (None, 1)).values()) <= 3


def _ids(rows):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(token_files.vocabulary())
    return [(d, tk.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]


def test_token_files_round_trip(spark, tmp_path, odd_docs, no_docs):
    odd = ["a  b", " a", "a ", "a\n\nb", "a\n b", "a \nb", "x<|endoftext|>y", " x y", "tab\tx y", "\n", "é\nß 'll don't",
           "...  ?!", "日本語 テキスト 1,234.5", "a" * 300, ""]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(100_000 + i, t) for i, t in enumerate(odd)] + [(200_000, None)]
    random.Random(4).shuffle(rows)
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), f"{tmp_path}/t")
    tokens = token_files.read(spark, f"{tmp_path}/t")
    digest = {r.doc_id: r for r in token_files.digest(tokens).collect()}
    ids = {r.doc_id: list(r.ids) for r in tokens.collect()}
    start = 0
    for d, want in sorted(_ids(rows)):
        assert ids[d] == want, d
        assert (digest[d].start, digest[d].n_tokens) == (start, len(want))
        assert digest[d].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    token_files.write(odd_docs, f"{tmp_path}/odd")
    assert _sorted((r.doc_id, list(r.ids)) for r in token_files.read(spark, f"{tmp_path}/odd").collect()) == _sorted(
        _ids([(r.doc_id, r.text) for r in odd_docs.collect()]))
    token_files.write(no_docs, f"{tmp_path}/none")
    assert token_files.digest(token_files.read(spark, f"{tmp_path}/none")).count() == 0


def test_encoder_keeps_few_pieces_between_tasks(monkeypatch):
    """Short pieces alone may be too many: what rests between tasks is bounded, and forgetting changes no id."""
    import pyarrow as pa
    monkeypatch.setattr(token_files, "KEPT_PIECES", 300)
    monkeypatch.setattr(token_files, "CACHE_PIECES", 500)
    encode = token_files.Encoder(token_files.vocabulary())
    for part in range(4):
        rows = [(k, " ".join(f"w{part}{k}x{i}" for i in range(50)) + ("\n\n" if k == 3 else "")) for k in range(20)]
        ids, n = encode.batch(pa.array([t for _, t in rows]))
        want = [w for _, w in _ids(rows)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        encode.rest()
        assert len(encode.pieces) <= 300
    assert [x.tolist() for x in encode.batch(pa.array([], pa.string()))] == [[], []]


def test_token_files_have_pages_and_dictionaries(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    token_files.write(spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/t", ranges=2)
    meta = pq.ParquetFile(glob.glob(f"{tmp_path}/t/*.parquet")[0]).metadata.row_group(0)
    names = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert names["doc_id"].has_column_index and names["doc_id"].has_offset_index
    assert any("DICTIONARY" in e or "DELTA" in e for e in names["ids.list.element"].encodings)


def test_lines_are_rewritten_once(spark):
    """The plan stars numbers in one place, not again in a filter, and lines without a word are left out."""
    docs = spark.createDataFrame([(1, "a 1  b\n \t\x0b\f\r \n\n7\r\n\tc d "), (2, ""), (3, None)], "doc_id long, text string")
    lines = line_templates._lines(docs, "doc_id", "text")
    assert sorted((r.line, r.s) for r in lines.collect()) == [(0, "a <*> b"), (3, "<*>"), (4, "c d")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_replace" in x]


def test_importance_prefers_the_target(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id for r in importance.resample(docs, train).select("doc_id").collect()}
    held = labels.where("doc_id % 2 = 1").collect()  # labels that training did not see
    share = {q: np.mean([r.doc_id in kept for r in held if r.quality == q]) for q in (0, 1)}
    assert share[1] > 0.95 and share[0] < 0.5, share
    lab = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, None), (2, None, None)], "doc_id long, quality int, toxic int")
    assert importance.resample(odd_docs, lab).columns == [*odd_docs.columns, "_importance"]
    assert importance.resample(no_docs, lab).count() == 0
    assert importance.resample(odd_docs, lab.where("false")).count() == 11  # nothing to aim at


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.randint(-10 ** 12, 10 ** 12) for _ in range(400)] + [5, 5, 5, -1, 0]
    keys = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 200, 404):
        assert importance.kth_largest(keys, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(keys, "v", 405) is None


def test_leaks_plain_and_refilled(spark, odd_docs, no_docs):
    bench = [(1, "A train leaves Boston at 30 km per hour while the other train from Boston goes 45 km further each day"),
             (2, "the quick brown fox jumps over lazy dogs near quiet rivers every single morning"), (3, "too short"), (4, None)]
    docs = [(10, "Intro. " + bench[0][1] + ". Outro."),
            (11, "Intro. A train leaves Madrid at 80 miles per hour while the other train from Madrid goes 99 miles further each day"),
            (12, "A train leaves Madrid at 80 km per hour while the other train from Lisbon goes 99 km further each day"),
            (13, "THE QUICK BROWN FOX JUMPS OVER LAZY DOGS NEAR QUIET RIVERS EVERY SINGLE MORNING"),
            (14, "the quick brown fox is unlike others and jumps over nothing at all in the evening hours of spring"), (15, None)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.refilled for r in template_leaks.leaks(d, b).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2)} and got[10, 1] == 0 and got[11, 1] > 0
    assert sorted(r.doc_id for r in template_leaks.clean(d, b).collect()) == [12, 14, 15]
    assert template_leaks.leaks(odd_docs, b).count() == 0 and template_leaks.leaks(no_docs, b).count() == 0
    assert template_leaks.clean(odd_docs, b.where("false")).count() == 11
    assert template_leaks.clean(odd_docs, b).columns == odd_docs.columns


def test_leaks_of_items_dense_in_slots(spark):
    """Windows of more slots than words count with their own values, or beside a window of words; a slot that breaks the
    pairing of values takes its own windows only."""
    sums = "Compute 12 + 7 * 3 - 4 / 2 and 9 + 8"
    mixed = "add the numbers that follow in this list and tell me 3 5 8 13 21 34 55 89 144 233"
    twice = ("we paid 30 coins for the first old wooden boat in town and then went on to ask for more boats until "
             "the owner would take no less than 30 coins again")
    bench = spark.createDataFrame([(1, sums), (2, mixed), (3, twice)], "item_id long, text string")
    docs = [(10, "Sums. " + sums + " now"), (11, sums.replace("12", "13").replace("9", "6")), (12, mixed),
            (13, mixed.replace("144", "145").replace(" 3 5 ", " 4 6 ")), (14, "no " + twice.replace("than 30", "than 31")),
            (15, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_covered, r.refilled) for r in template_leaks.leaks(d, bench).collect()}
    assert set(got) == {(10, 1), (12, 2), (13, 2), (14, 3)}, got
    assert got[10, 1] == (9, 9, 0) and got[12, 2] == (21, 21, 0) and got[13, 2] == (21, 21, 3)
    assert got[14, 3][1] < got[14, 3][0] and got[14, 3][2] == 0


def test_leaks_of_part_of_a_long_item_and_of_short_items(spark):
    long = " ".join(f"{a}{b}" for a in ("ta", "ne", "ri", "so", "lu", "ka") for b in "bcdfghjklm")  # 60 words
    words = long.split()
    bench = spark.createDataFrame([(1, long), (2, "zebra crossing at noon"), (3, "room 12"), (4, "...")], "item_id long, text string")
    docs = [(10, "he said " + " ".join(words[20:48]) + " and left"), (11, "he said " + " ".join(words[20:33]) + " and left"),
            (12, "he said " + " ".join(words[20:32]) + " and left"),
            (13, " ".join(words[:10]) + " or " + " ".join(words[30:40])), (14, "a zebra crossing at noon is seen"),
            (15, "a zebra crossing at night"), (16, "in room 12 it is"), (17, "in room 13 it is")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in template_leaks.leaks(d, bench).collect()}
    assert got == {(10, 1): 28, (11, 1): 13, (14, 2): 4, (16, 3): 2}


def test_slots_of_names_and_spelled_numbers(spark):
    from pyspark.sql import functions as F
    rows = [("Tom met O'Neil and Mary Ann McDonald. The twenty-five NASA men of New York paid 3 million dollars, Eve seven cents",
             "# met # and # the % nasa men of # paid % ? # % ?"), ("Seven At one", "% at %"), ("someone tenth x", "someone tenth x")]
    got = spark.createDataFrame(rows, "t string, want string").select(
        "want", F.array_join(template_leaks.template(template_leaks.marked(F.col("t"))), " ").alias("got")).collect()
    for r in got:
        assert r.got.translate({1: "%", 2: "#", 3: "?"}) == r.want


def test_leaks_of_refilled_questions(spark):
    apples = "Tom has 5 apples. Anna takes 2 of them. Tom buys 7 more. How many apples does Tom have?"
    train = "The train of McDonald leaves New York at seven and drives eighty miles before O'Neil gets off at the last stop"
    bench = spark.createDataFrame([(1, apples), (2, train)], "item_id long, text string")
    docs = [(10, "Bob has 8 apples. Carla takes 3 of them. Bob buys 4 more. How many apples does Bob have?"),
            (11, "Tom has five apples. Anna takes two of them. Tom buys seven more. How many apples does Tom have?"),
            (12, "The train of Smith leaves San Juan at 9 and drives 70 miles before Ann Lee gets off at the last stop"),
            (13, "Bob has 8 pears. Carla brings 3 boxes. Bob sells 4 of these. How many are left to Bob now?"),
            (14, "Bob has 8 apples. Carla takes 3 of them. Ann buys 4 more. How many apples does Zoe have?"),
            (15, "A bus of Smith reaches Rome at 9 after 70 miles, and Ann Lee gets on at the first stop")]
    got = {(r.doc_id, r.item_id): r.n_covered == r.n_tokens for r in
           template_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(10, 1): True, (11, 1): True, (12, 2): True}, got


_FRAMES = ["{a} has {m} {x} and gives {n} of them to {b} before the {y} of {c} closes, how many {x} does {a} keep",
           "{a} drives {m} miles from {c} to the {y} in {n} hours. {b} walks {k} miles back. How far is {b} from {c}?",
           "A {y} in {c} sells {m} {x} each day and {n} on a holiday. {a} buys {k} of them. How many are left for {b}?"]


def _question(rng, frame, x, y):
    names = rng.sample(["Tom", "Anna", "Mary Ann", "O'Neil", "McDonald", "Zoë", "Li Wei", "Bo"], 2)
    m, n, k = rng.sample([str(rng.randint(2, 9999)), "seven", "twenty-five", "3 million", f"{rng.randint(1, 99)}.5"], 3)
    return frame.format(a=names[0], b=names[1], c=rng.choice(["Rome", "New York", "San Juan de Luz"]), x=x, y=y,
                        m=m, n=n, k=k)


def test_leaks_of_generated_questions(spark):
    """200 questions filled anew, and as many about other things, against brute force on the generator's own key: the
    frame and its things, whatever the names, places and numbers."""
    import random
    rng = random.Random(5)
    things = [(x, y) for x in ("apples", "stamps", "coins", "pencils") for y in ("market", "museum", "bakery", "harbour")]
    known, other = things[::2], things[1::2]
    items = [(i, f, x, y) for i, (f, (x, y)) in enumerate([(f, t) for f in _FRAMES for t in known])]
    bench = spark.createDataFrame([(i, _question(rng, f, x, y)) for i, f, x, y in items], "item_id long, text string")
    docs, want = [], set()
    for d in range(200):
        i, f, x, y = rng.choice(items)
        docs.append((d, f"Some words first. {_question(rng, f, x, y)} And some after"))
        want.add((d, i))
    filler = "this is about {x} that nobody has ever seen near the old {y} of a town whose streets were empty that night"
    docs += [(1000 + d, filler.format(x=x, y=y) + f" when {d} men and Tom went home") for d, (x, y) in enumerate(other * 25)]
    got = {(r.doc_id, r.item_id) for r in template_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want & got) >= 0.9 * len(want), len(want & got)
    assert not any(d >= 1000 for d, _ in got)


def test_leaks_in_blocks_and_verbatim(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    whole = {(r.doc_id, r.item_id) for r in template_leaks.leaks(docs, bench).collect()}
    assert want and want == whole
    monkeypatch.setattr(template_leaks, "BLOCK_WINDOWS", 500)
    assert whole == {(r.doc_id, r.item_id) for r in template_leaks.leaks(docs, bench).collect()}


def _duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.sql(sql)


def test_line_templates(spark, odd_docs, no_docs):
    lines = [f"user {n} logged in from host{n} at noon today now" for n in range(6)]
    vary = [f"the nightly job on server {w} has ended well" for w in ("red", "green", "blue", "gray", "pink", "teal")]
    docs = [(i, f"own line number {'abcdef'[i] * 3} stays here\n{lines[i]}\n\n{vary[i]}") for i in range(6)]
    docs += [(9, "one two three " + " ".join("xyz"[:2] + c for c in "abcdefgh"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_templates.report(d).collect()}
    assert all(got[i][:2] == (3, got[i][1]) and {"1", "3"} <= set(got[i][2].split(",")) for i in range(6)) and got[9] == (1, 0, "")
    text = {r.doc_id: r.text for r in line_templates.dedup(d).collect()}
    assert text[9] == docs[-1][1] and "logged" not in text[0]
    assert line_templates.report(no_docs).count() == 0
    assert sorted(str(r.n_lines) for r in line_templates.report(odd_docs).collect()) == ["0"] * 4 + ["1"] * 6
    assert line_templates.dedup(odd_docs).columns == odd_docs.columns and line_templates.dedup(odd_docs).count() == 11


def test_line_templates_from_two_documents(spark):
    """A line of two documents goes; a line repeated in one document, or found once, stays."""
    docs = [(1, "this passage stands in two documents\nalone in this one document\ntwice in one text\ntwice in one text"),
            (2, "only the other text has this\nthis passage stands in two documents")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_templates.report(d).collect()}
    assert got == {1: (4, 1, "0"), 2: (2, 1, "1")}
    assert {r.doc_id: r.text for r in line_templates.dedup(d).collect()}[2] == "only the other text has this"


def test_registered_sql(spark):
    from palimpsest.llm.queries import oracle_sql
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, SF)
        rel = _duck(f"SELECT {', '.join(df.columns)} FROM ({sql})", documents=f"{SF}/documents.parquet")
        assert _sorted(df.collect()) == _sorted(rel.fetchall()), name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    for r in kept.collect():
        assert len(WORD.findall(r.text)) >= 10
    one = corpus_pipeline.ngram_join(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in one.collect()} == {d for d, n, c in _brute_components(rows) if d == c}
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {d for d, t in rows if not any(b in t for b in bench)}
    assert kept.columns == one.columns == clean.columns == docs.columns


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and max(Counter(r.doc_id for r in out).values()) <= 3
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    (_, ids), = _ids([(out[0].doc_id, texts[out[0].doc_id])])
    assert out[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
