"""Operators 11, 12 and 13 against plain readings of their rules."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import toxicity, turn_repair, word_runs
from palimpsest.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------------------------------ op12

def _runs(w, least=12):
    """Maximal stretches by trying every period."""
    found, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= 2 * q and (s, i + q) not in seen:  # smaller periods came before
                seen.add((s, i + q))
                if i + q - s >= least:
                    found.append((s, i + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _looped(doc_id, w):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def _digest12(doc_id, text):
    w = _looped(doc_id, WORDS.findall(text or ""))
    runs = _runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES12 = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_generated_words():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [str(rng.randrange(rng.choice([1, 2, 3, 6]))) for _ in range(rng.randint(0, 70))]
            if len(w) > 4 and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = rng.randint(1, max(1, (len(w) - a) // 2))
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        least = rng.choice([2, 12])
        got = list(word_runs.scan_texts([" ".join(w).encode() for w in texts], least))
        assert [(n, list(r)) for n, r, _ in got] == [(len(w), _runs(w, least)) for w in texts]


def test_long_runs_take_no_quadratic_time():
    for n, p in ((400_000, 1), (400_000, 7), (400_000, 150_000)):
        words = [b"%d" % (i % p) for i in range(n)]
        ((count, runs, rest),) = word_runs.scan_texts([b" ".join(words)])
        assert (count, list(runs), rest) == (n, [(0, n, p)], b" ".join(words[:p]))


def test_op12_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in NAMES12) for r in queries()["op12_word_runs"](spark, SF).collect()}
    want = {r.doc_id: _digest12(r.doc_id, r.text) for r in docs if len(r.text or "") < 20_000}
    assert {i: got[i] for i in want} == want and len(got) == len(docs)
    assert sum(x[0] for x in want.values()) > 5


def test_op12_odd_documents(spark, odd_docs, no_docs):
    scan = word_runs.scan(word_runs.looped(F.col("text"), F.col("doc_id")))

    def out(df):
        return df.select("doc_id", "text", scan.alias("s")).select(
            "doc_id", "text", *[c.alias(k) for k, c in word_runs.digest(F.col("s")).items()]).collect()
    rows = out(odd_docs)
    assert len(rows) == odd_docs.count()
    for r in rows:
        if len(r.text or "") < 20_000:
            assert tuple(r[2:]) == _digest12(r.doc_id, r.text), r
    (long,) = [r for r in rows if len(r.text or "") > 20_000]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 60_000, 5_000)
    assert out(no_docs) == []


# ------------------------------------------------------------------------------------------ op13

def _cheapest(codes):
    """Least (cost, audit) over the grammar states, turn by turn."""
    n = len(codes)

    @lru_cache(None)
    def best(i, state, inserts):
        out = [(0, "")] if i == n and state in "0a" else []
        after = "u" if state in "0sa" else "a"
        if inserts < 3:
            c, a = best(i, after, inserts + 1)
            out.append((c + 3, "I" + a))
        if i < n:
            c, a = best(i + 1, state, 0)
            out.append((c + 4, "D" + a))
            if codes[i] != "x":
                late = 3 * codes[i].isupper()
                for to in [after] + ["s"] * (state == "0"):
                    if codes[i].lower() == to:
                        c, a = best(i + 1, to, 0)
                        out.append((c + late, "K" + a))
                    elif to != "s":
                        c, a = best(i + 1, to, 0)
                        out.append((c + late + 3, "R" + a))
        return min(out, default=(10 ** 9, ""))

    return best(0, "0", 0)


def _plain_repair(rows):
    """The contract over one conversation's ``(turn, role, text)`` rows in order."""
    faults, seen, codes = [0, 0, 0], set(), ""
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not last:
            faults[0] += 1
            code = "x"
        elif (role, text) in seen:
            faults[1] += 1
            code = "x"
        elif last[-1] not in ".!?":
            faults[2] += 1
            code = code.upper()
        seen.add((role, text))
        codes += code
    roles = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = _cheapest(codes)
    made, state, at = [], "0", 0
    for edit in audit:
        if edit != "I":
            _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit in "IR":
            role, text = "assistant" if state == "u" else "user", "" if edit == "I" else text
        state = role[0]
        made.append(f"{role}:{text}")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest())


def _damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        mine += [(turn, role, text)] * ((h != 0) + (h == 3))
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _got13(turns, damage=True):
    rows, present = turn_repair.damaged(turns) if damage else (turns, None)
    got = turn_repair.audits(turn_repair.faulty(rows, present)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[1:]) for r in got}


def test_blocks_against_the_grammar():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice("ssuuuaaaUAxxoO"[rng.randrange(3):]) for _ in range(rng.randint(1, 12)))
        ends = turn_repair.align_block(codes, turn_repair.NOTHING, True)
        assert min(ends.values()) == _cheapest(codes), codes


def test_op13_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[1:]) for r in queries()["op13_turn_repair"](spark, SF).collect()}
    want = {c: _plain_repair(r) for c, r in _damaged(rows).items()}
    assert got == want and any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_op13_odd_and_long_conversations(spark):
    rng = random.Random(9)
    texts = ["Yes.", "No", " ", "", None, "Why?  \n", "Yes.", "end!", "a\x85"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < .1 else turn, rng.choice(["system", "user", "assistant", "tool", None, ""]),
                         rng.choice(texts)))
    for conv, n in ((100, 16), (101, 17), (102, 33), (103, 150)):  # block edges and beyond
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < .4 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, f"{turn}{rng.choice(['.', '.', '.', ''])}"))
    rows += [(None, 1, "user", "Null id."), (None, None, None, None), (200, 5, "user", "Same."), (200, 5, "user", "Same.")]
    turns = _turns(spark, rows).withColumn("fault", F.lit(9)).withColumn("here", F.lit("x"))
    want = {c: _plain_repair(r) for c, r in _damaged(rows).items()}
    assert _got13(turns) == want
    gone = [c for c, r in _damaged(rows).items() if not r]
    assert gone and all(want[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    assert _got13(turns.where("false")) == {}
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert _got13(_turns(spark, shuffled).repartition(7)) == want


def test_op13_repaired_turns(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    faults = turn_repair.faulty(*turn_repair.damaged(turns))
    audits = turn_repair.audits(faults)
    made = {}
    for r in turn_repair.repaired(faults, audits).collect():
        made.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    for r in audits.collect():
        rows = sorted(made.get(r.conv_id, []))
        assert [p for p, _ in rows] == list(range(len(rows)))
        assert hashlib.sha256("\n".join(t for _, t in rows).encode()).hexdigest() == r.repaired_sha256


# ------------------------------------------------------------------------------------------ op11

def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values, inverse, n = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    rank[order] = (np.cumsum(n) - (n - 1) / 2)[inverse]
    y = np.asarray(label)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_op11_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries()["op11_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("toxic is not null").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    auc = _auc([r.score for r in held], [r.toxic for r in held])
    caught = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    wrong = sum(r.predicted for r in held if not r.toxic) / sum(not r.toxic for r in held)
    assert auc > 0.85 and caught > 0.7 and wrong < 0.06, (auc, caught, wrong)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "schuft", "halunke"]) + rng.choice(["", "en", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int"))


def test_op11_learns_from_its_share_only(spark, spoken):
    docs, labels = spoken
    model = toxicity.train(docs, labels)
    a, b = model.scores(["schuft und halunke sind grobians immer wieder hier", "abend nor stein am hatte lumer oder nicht"])
    assert a > 0.5 > 0.2 > b
    # flipping the labels of held-out rows and naming other columns changes nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id")), flipped)
    texts = [r.text for r in docs.limit(50).collect()]
    assert (model.scores(texts) == other.scores(texts)).all()


def test_op11_odd_documents(spark, spoken, odd_docs, no_docs):
    docs, labels = spoken
    model = toxicity.train(docs, labels)
    got = odd_docs.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("score"),
                          toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == odd_docs.count()
    assert [r.score for r in got] == [round(float(model.scores([r.text])[0]), 6) for r in got]
    assert all(r.score < 0.3 for r in got if not (r.text or "").strip()) and not any(r.h for r in got if r.doc_id is None)
    assert no_docs.select(toxicity.score(F.col("text"), model)).collect() == []
    empty = toxicity.train(docs, labels.where("false"))
    assert list(empty.scores(["x", None])) == [0, 0]
    assert toxicity.train(docs.where("false"), labels).scores([None])[0] < 0.3
    assert toxicity.train(docs, labels.where("toxic = 1")).scores(["x"])[0] > 0.9


# --------------------------------------------------------- rules of operators 2, 4 and 5 that were lost before

def test_short_documents_beside_a_long_one_vary_one_by_one():
    from palimpsest.llm.source_mix import pivot
    sizes, taken = [5_000] + [2] * 1_499, []
    for draw in range(30):
        out = pivot(sizes, [0.4] * 1_500, ("s", 0, draw))
        assert sum(0 < c < 1 for c in out) <= 1
        assert abs(sum(s * c for s, c in zip(sizes, out)) - 0.4 * sum(sizes)) < 1e-3  # a trade keeps the words
        taken.append(sum(c == 1 for c in out[1:]))
    assert sum(0 < t < 1_499 for t in taken) >= 25 and len(set(taken)) > 5


def test_both_notices_are_found():
    from palimpsest.llm import license_scan
    text = "releasd under the mit license released under the mit license"
    spans = license_scan.method_spans(text, license_scan.seeds(), license_scan.fuzzy())
    assert {(s, e) for s, e, label, _, _ in spans if label == "mit"} >= {(0, 29), (30, 60)}


def test_many_spans_in_one_text_take_no_quadratic_time(spark):
    import time

    from palimpsest.llm import license_scan, secrets
    from palimpsest.llm.common import with_fields
    model = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    text = " ".join(f"{k:032x} word{k}" for k in range(60_000))
    begin = time.time()
    assert len(secrets.base_spans(text)) == 60_000 and isinstance(secrets.random_spans(text, model, secrets.base_spans(text)), list)
    docs = spark.createDataFrame([(1, "cc by " * 300_000)], "doc_id long, text string")
    row = with_fields(docs, license_scan.scan(F.col("text")), ["n_base", "first_word", "last_word"], ["doc_id"]).first()
    assert tuple(row) == (1, 300_000, 0, 599_998) and time.time() - begin < 60


# ------------------------------------------------------------------------------ op8: groups inside a leaf

def _dropped(spark, texts):
    from palimpsest.llm import line_templates
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_lines, r.dropped) for r in line_templates.report(docs).collect()}


def test_templates_that_share_a_path(spark):
    names = [f"{x}{y}" for x in ("an", "bo", "cy", "di") for y in ("ra", "la", "to")]
    one = [f"Posted in the {w} section by our staff with kind regards always today" for w in names]
    two = [f"Posted in the town of origin under the name {w} with best wishes" for w in names]
    three = [f"Posted in the morning after breakfast and before lunch by friend {w} again" for w in names]
    user = [f"User {w} logged in from the west office" for w in names]
    plain = [" ".join(f"{w}{k}{chr(97 + j)}" for k, j in zip("abcdefgh", range(8))) for w in names]
    got = _dropped(spark, ["\n".join(x) for x in zip(one, two, three, user, plain)])
    assert set(got.values()) == {(5, "0,1,2,3")}
    for lines in (one, two, three, user):
        assert set(_dropped(spark, lines).values()) == {(1, "0")}


def test_templates_need_two_documents_and_enough_constants(spark):
    got = _dropped(spark, ["User ann logged in today\nUser bob logged in today", "a b c\na b d", "a b e\nx y z w v", "x y q p v"])
    assert got == {0: (2, ""), 1: (2, ""), 2: (2, ""), 3: (1, "")}
    assert _dropped(spark, ["w " * 30_000 + "left", "w " * 30_000 + "right", None, "", " \t \n"]) == {
        0: (1, "0"), 1: (1, "0"), 2: (0, ""), 3: (0, ""), 4: (0, "")}
