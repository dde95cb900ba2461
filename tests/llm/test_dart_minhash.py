import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdq.llm import dart_minhash as dm


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    """Smallest id of each row's class, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (both := sum((a & b).values())) / (sum(a.values()) + sum(b.values()) - both) >= dm.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    return [min(x for x in ids[root(i)] if x is not None) if any(x is not None for x in ids[root(i)]) else None for i in range(len(rows))]


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.random()}"
    return " ".join(out)


def corpus(rnd):
    word = lambda: "".join(rnd.choices("etaoinshr", k=4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(60, 300))]
        for _ in range(rnd.randint(1, 6)):
            rows.append((n, edited(rnd, base, rnd.randint(0, len(base) // 30))))
            n += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(60):  # unrelated texts that share a passage
        rows.append((n, passage + " " + " ".join(word() for _ in range(rnd.randint(5, 80)))))
        n += 1
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r for r in dm.near_duplicates(docs).verdict.collect()}
    assert {i: got[i].class_id for i, _ in rows} == dict(zip([i for i, _ in rows], classes(rows), strict=True))
    assert all(r.kept == (r.id == r.class_id) for r in got.values())


def test_hot_class_of_near_copies(spark):
    """A third of all rows are variants of one text; the class is found whole, without comparing all pairs."""
    rnd = random.Random(3)
    base = ["".join(rnd.choices("etaoinshr", k=4)) for _ in range(200)]
    rows = [(i, edited(rnd, base, 1) if i % 3 == 0 else " ".join("".join(rnd.choices("etaoinshr", k=5)) for _ in range(30))) for i in range(450)]
    found = dm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sizes = Counter(r.class_id for r in found.verdict.collect())
    assert sizes[0] == 150 and len(sizes) == 301
    assert found.kept_rows().count() == 301


def test_odd_documents_and_empty_table(odd_docs, no_docs):
    found = dm.near_duplicates(odd_docs, carry=odd_docs.columns)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = Counter((r.id, r.class_id) for r in found.verdict.collect())
    want = Counter((i, c if (t or "").split() else i) for (i, t), c in zip(rows, classes(rows), strict=True))
    assert got == want
    assert found.kept_rows().select("row.*").columns == odd_docs.columns
    assert dm.near_duplicates(no_docs).verdict.count() == 0


def test_agreement_of_coordinates_is_weighted_jaccard():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 52, 400).astype(np.uint64)
    w = rng.integers(1, 40, (2, 400)) * (rng.random((2, 400)) < 0.7)
    w[1, :250] = w[0, :250]
    rows = [(i, e, x) for i in range(2) for e, x in zip(pool, w[i], strict=True) if x]
    text, element, weight = (np.array(c) for c in zip(*rows, strict=True))
    sig = dm.signatures(text.astype(np.int64), element.astype(np.uint64), weight.astype(np.int64), 2, 4000)
    true = np.minimum(w[0], w[1]).sum() / np.maximum(w[0], w[1]).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03
    # a signature doesn't depend on what else is in the batch
    alone = dm.signatures(np.zeros((text == 1).sum(), np.int64), element[text == 1].astype(np.uint64), weight[text == 1].astype(np.int64), 1, 4000)
    assert (alone[0] == sig[1]).all()


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 90)] + [(200, 201), (205, 201)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in dm.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}
    for _ in edges or [None]:
        for u, v in edges:
            lo = min(parent.get(u, u), parent.get(v, v))
            parent[u] = parent[v] = lo
    assert got == {n: r for n, r in parent.items() if n != r}


def test_pivots_repeat_in_few_copies(spark):
    pairs = spark.range(1000).select(F.col("id").alias("node"), F.lit(-1).cast("long").alias("pivot"))
    element = lambda n: np.arange(n, n + 4, dtype=np.uint64).tobytes()
    rows = [(i, element(0 if i % 2 else 50), np.ones(4, "<u4").tobytes()) for i in range(-1, 1000)]
    shingle_sets = spark.createDataFrame(rows, "node long, elements binary, weights binary")
    assert dm.verified(pairs, shingle_sets).count() == 500


def test_leftovers_of_a_large_bucket_are_compared_in_blocks(spark, monkeypatch):
    """Chains of variants: most are not linked to the pivot but to each other, so classes need the second comparison."""
    monkeypatch.setattr(dm, "MEMBERS_AT_ONCE", 8)
    monkeypatch.setattr(dm, "HOME", 6)
    monkeypatch.setattr(dm, "ASKS_PER_COPY", 3)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("etaoinshr", k=5))
    base, rows = [word() for _ in range(150)], []
    for chain in range(6):
        words = list(base)
        for i in rnd.sample(range(150), 8):
            words[i] = word()
        for _ in range(12):  # each differs from the one before by one to three words
            for i in rnd.sample(range(150), rnd.randint(1, 3)):
                words[i] = word()
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.class_id for r in dm.near_duplicates(docs).verdict.collect()}
    want = dict(zip([i for i, _ in rows], classes(rows), strict=True))
    assert got == want and 1 < len(set(want.values())) < 40


def test_likely_pairs_and_exact_check():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    short = rng.integers(0, 256, (6, dm.COORDINATES)).astype(np.uint8)
    short[1], short[3] = short[0], short[0]
    short[3, : dm.COORDINATES - dm.LIKELY + 1] += 1  # one place too few
    m = {"node": np.arange(6), "root": np.array([0, 1, 2, 3, 4, 0]), "home": np.zeros(6, int), "weight": np.array([10, 9, 9, 10, 10, 10]), "minor": np.arange(6) > 0}
    q = {k: v[1:] for k, v in m.items()}
    assert [(x.tolist(), y.tolist()) for x, y in dm.likely(q, short[1:], m, short) if len(x)] == [([0], [0])]
    sets = lambda *rows: {"elements": [np.array(r, np.uint64).tobytes() for r in rows], "weights": [np.ones(len(r), "<u4").tobytes() for r in rows]}
    texts = pa.table({"node": [1, 2, 3], "root": [1, 2, 3], **sets(range(10), range(9), range(5, 15))})
    asks = pa.table({"node": [7], "root": [0], "others": [[np.array([1, 3], np.int64).tobytes()]], **sets(range(10))})
    assert dm._checked(asks, texts).to_pylist() == [{"u": 1, "v": 0}]  # 2 is alike but was not asked for, 3 is not alike
