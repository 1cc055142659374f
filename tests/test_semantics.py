"""Labels, entity lookup, similarities, clustering."""

from collections import Counter
import hashlib
import math
import random

from pyspark.sql import functions as F

from palimpsest.operators.cluster import cluster_changes, seeds, text_points, text_vectors
from palimpsest.operators.semantics import bare_tokens, entity_labels, label_union, tf_cosine, vector_cosine


def test_labels_unit_numbers(spark):
    df = spark.createDataFrame([("Waga: 10 kg i 2.5 cm",), ("tekst bez danych",)], "t string")
    got = [r.l for r in df.select(label_union(F.col("t")).alias("l")).collect()]
    assert got == [["numbers", "unit"], []]                 # R12, R13


def test_bare_tokens_of_long_punctuation(spark):
    """A long run of punctuation is looked at once, wherever it stands."""
    run = "$" * 200_000
    rows = [(1, f"a{run}b, (c) -- d's."), (2, f"{run} x\u00a0\u00c9a\t{run}"), (3, ""), (4, None), (5, " -- "), (6, f"{run}y\n\n z{run}")]
    got = {r.id: list(r.w) for r in spark.createDataFrame(rows, "id int, t string").select("id", bare_tokens(F.col("t")).alias("w")).collect()}
    assert got == {1: [f"a{run}b", "c", "d's"], 2: ["x", "\u00e9a"], 3: [], 4: [], 5: [], 6: ["y", "z"]}


def test_entity_labels_from_gazetteer(spark):
    texts = spark.createDataFrame([(1, "Jan Kowalski works at ACME in Paris"), (2, "nothing here")], "id int, t string")
    gz = spark.createDataFrame([("kowalski", "PER"), ("acme", "ORG"), ("paris", "GPE"), ("here", "FAC")],
                               "term string, code string")
    got = {r.id: r.entity_labels for r in entity_labels(texts, ["id"], "t", gz).collect()}
    assert got == {1: ["location", "organization", "person"]}     # R14; unknown codes dropped
    words = spark.createDataFrame([("small ring", "PRODUCT"), ("France", "GPE"), ("New York City", "GPE")], "term string, code string")
    t = spark.createDataFrame([(1, "A Small, ring."), (2, "in (France), today"), (3, "ring small"), (4, None),
                               (5, "to new york city!")], "id int, t string")
    assert {r.id: r.entity_labels for r in entity_labels(t, ["id"], "t", words).collect()} == {
        1: ["product"], 2: ["location"], 5: ["location"]}
    merged = label_union(F.lit("x 5"), F.array(F.lit("person")))
    assert spark.range(1).select(merged.alias("l")).first().l == ["numbers", "person"]


def py_cos(a, b):
    ca, cb = Counter(a.lower().split()), Counter(b.lower().split())
    na, nb = sum(v * v for v in ca.values()), sum(v * v for v in cb.values())
    if not na or not nb:
        return 0.0
    return sum(v * cb[t] for t, v in ca.items()) / math.sqrt(na * nb)


def test_tf_cosine(spark):
    pairs = [(1, "a b c", "a b d"), (2, "", "tekst"), (3, "x x y", "x y y"), (4, "Same", "same")]
    df = spark.createDataFrame(pairs, "id int, o string, n string")
    got = {r.id: r.similarity for r in tf_cosine(df, ["id"], "o", "n").collect()}
    for i, o, n in pairs:
        assert abs(got[i] - py_cos(o, n)) < 1e-12
    assert got[2] == 0.0                                     # R15


def test_vector_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<float>, b array<float>")
    assert [r.c for r in df.select(vector_cosine("a", "b").alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_cluster_changes_invariants(spark):
    rows = [(1, i, "changed", f"old {i}", ("alpha beta" if i % 2 else "gamma delta") + f" {i}") for i in range(6)]
    rows += [(2, 0, "changed", "a", "b"), (2, 1, "unchanged", "c", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, entry_idx int, change string, old_text string, new_text string")
    got = cluster_changes(df).collect()
    d1 = [r for r in got if r.doc_id == 1]
    assert sorted(r.idx for r in d1) == list(range(6))       # every changed index exactly once (R19)
    assert len({r.cluster for r in d1}) <= 2                 # k = max(2, min(10, 6 // 5)) = 2
    assert not [r for r in got if r.doc_id == 2]             # fewer than 3 changes -> no clusters


def test_mean_vectors(spark):
    import hashlib
    from palimpsest.operators.semantics import NEAR, VECTOR_DIMS, mean_vectors, token_vectors
    corpus = ["red fox red", "a fox", "alone", "", None, "the the the the " * 300 + "fox"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "id long, text string")
    sums: dict[str, list[int]] = {}
    for t in corpus:
        w = (t or "").split()
        for i, x in enumerate(w):
            v = sums.setdefault(x, [0] * (VECTOR_DIMS + 1))
            for u in w[max(0, i - NEAR):i] + w[i + 1:i + 1 + NEAR]:
                v[-1] += 1
                for d, c in enumerate(hashlib.md5(u.encode()).hexdigest()):
                    v[d] += 1 if c >= "8" else -1
    want = {x: [s * 1000 // v[-1] if v[-1] else 0 for s in v[:-1]] for x, v in sums.items()}
    one, eight = ({r.tok: r.vec for r in token_vectors(docs.repartition(n), "text").collect()} for n in (1, 8))
    assert one == eight == want
    points = spark.createDataFrame([(1, "fox red unknown"), (2, ""), (3, None), (4, "alone")], "id long, text string")
    got = {r.id: r for r in mean_vectors(points, ["id"], "text", token_vectors(docs, "text")).collect()}
    assert got[1].mean == [(a + b) / 3 for a, b in zip(want["fox"], want["red"])]
    assert [got[i].n_tokens for i in (1, 2, 3, 4)] == [3, 0, 0, 1] and all(set(got[i].mean) == {0.0} for i in (2, 3, 4))


def _clusters(points, k, doc):
    """Brute force: weighted starts, then Lloyd rounds until a state comes back."""
    vecs = [Counter(p.lower().split()) for p in points]
    dist = lambda p, q: sum((p[t] - q[t]) ** 2 for t in set(p) | set(q))
    far, chosen = [None] * len(vecs), []
    for number in range(k):
        u = [(int(hashlib.md5(f"{doc}:{i}:{number}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52 for i in range(len(vecs))]
        race = [(-math.log(u[i]) / (1 if far[i] is None else far[i]), i) for i in range(len(vecs)) if far[i] != 0]
        if not race:
            break
        chosen.append(min(race)[1])
        far = [dist(v, vecs[chosen[-1]]) if f is None else min(f, dist(v, vecs[chosen[-1]])) for v, f in zip(vecs, far)]
    cent = [(vecs[i], 1) for i in chosen]
    seen = []
    while True:
        def d(v, c):
            s, m = c
            return float(sum(x * x for x in s.values()) - 2 * m * sum(v[t] * s[t] for t in v)) / (m * m)
        assign = [min((d(v, c), j) for j, c in enumerate(cent))[1] for v in vecs]
        if assign in seen:
            return chosen, assign
        seen.append(assign)
        for j in range(len(cent)):
            mine = [v for v, a in zip(vecs, assign) if a == j]
            if mine:
                cent[j] = (sum(mine, Counter()), len(mine))


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(4)
    docs = {d: [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(n)]
            for d, n, words in ((1, 60, "abcdefgh"), (2, 25, "xyz"), (3, 3, "ab"), (4, 55, "abcdefghijklmnop"))}
    docs[5] = ["same text"] * 40 + ["other"]           # fewer different vectors than k = 8
    docs[6] = ["", "", ""]
    rows = [(d, i, "changed", "old", t or None) for d, texts in docs.items() for i, t in enumerate(texts)]
    rows[-3:] = [(6, i, "changed", None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, entry_idx int, change string, old_text string, new_text string")
    pts = text_points(df)
    starts = sorted(tuple(r) for r in seeds(pts, text_vectors(pts)).select("doc_id", "cluster", "idx").collect())
    expected = {d: _clusters(t, max(2, min(10, len(t) // 5)), d) for d, t in docs.items()}
    assert starts == sorted((d, c, i) for d, (chosen, _) in expected.items() for c, i in enumerate(chosen))
    got = sorted((r.doc_id, r.idx, r.cluster) for r in cluster_changes(df.repartition(3)).collect())
    assert got == sorted((d, i, c) for d, (_, assign) in expected.items() for i, c in enumerate(assign))
    assert {c for d, _, c in got if d == 5} == {0, 1} and {c for d, _, c in got if d == 6} == {0}
    assert max(c for d, _, c in got if d == 1) == 9


def test_clusters_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, entry_idx int, change string, old_text string, new_text string")
    assert cluster_changes(df).collect() == []


def test_clusters_read_the_alignment_once_and_leave_ended_documents(spark, monkeypatch):
    from palimpsest.operators import cluster
    rows = [(d, i, "changed", "old", "a b" if i % 2 else "c d") for d in range(6) for i in range(4)]
    rnd = random.Random(9)
    rows += [(9, i, "changed", "old", " ".join(rnd.choice("abcdefgh") for _ in range(5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, entry_idx int, change string, old_text string, new_text string")
    names = []
    keep = cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda x, name: names.append(name) or keep(x, name))
    got = sorted((r.doc_id, r.idx, r.cluster) for r in cluster_changes(df).collect())
    texts = {d: [r[4] for r in rows if r[0] == d] for d in {r[0] for r in rows}}
    assert got == sorted((d, i, c) for d, t in texts.items()
                         for i, c in enumerate(_clusters(t, max(2, min(10, len(t) // 5)), d)[1]))
    assert names[:3] == ["changed", "points", "vectors"]


def test_token_vectors_move_one_row_a_token(spark):
    from palimpsest.operators.semantics import mean_vectors, token_vectors
    docs = spark.createDataFrame([(1, "a b a b a c"), (2, "c a")], "id long, text string")
    vectors = token_vectors(docs, "text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(vectors).count("Exchange hashpartitioning") == 1       # no second one for pairs of neighbours
    assert "smallint" in plan(mean_vectors(docs, ["id"], "text", vectors))
