import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdq.llm import periodic_runs, queries


def brute_runs(words):
    """Every period, word by word: maximal stretches of equal words at that distance, least period only."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(words[i : j + q - d] == words[i + d : j + q] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = min(runs, key=lambda r: (-r[1] * math.lcm(*(x[2] for x in runs)) // r[2], r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(kept)))


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: contract(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 5


def random_words(rnd):
    n = rnd.choice([0, 1, 5, 6, 20, 100, 400, 900])
    a = [str(rnd.randrange(rnd.choice([1, 2, 3, 50]))) for _ in range(n)]
    for _ in range(rnd.randrange(4) if n > 8 else 0):
        q, s = rnd.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 33, 50, 64, 100, 150]), rnd.randrange(n)
        unit = [str(rnd.randrange(rnd.choice([2, 3, 40]))) for _ in range(q)]
        inner = rnd.choice([1, 2, 3, q])  # some units repeat within themselves
        for i in range(s, min(n, s + rnd.randrange(int(3.8 * q) + 1, 9 * q + 6))):
            place = (i - s) % q
            a[i] = unit[place % inner if place < q * 3 // 4 else place]
    return [w.encode() for w in a]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_nested_and_neighbouring_periods(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        docs = [random_words(rnd) for _ in range(rnd.randrange(1, 6))]
        n, starts, lengths, periods, best, collapsed = periodic_runs._columns(docs)
        for i, d in enumerate(docs):
            want = brute_runs(d)
            assert list(zip(starts[i].as_py(), lengths[i].as_py(), periods[i].as_py(), strict=True)) == want and n[i].as_py() == len(d)
            kept = [w for j, w in enumerate(d) if not any(s + q <= j < s + length for s, length, q in want)]
            assert collapsed[i].as_py() == b" ".join(kept).decode()


def test_long_periods_are_found():
    rng = np.random.default_rng(1)
    unit = [str(x).encode() for x in rng.integers(0, 1 << 30, 3000)]
    words = [b"x"] * 5 + unit * 4 + unit[:17] + [b"y"]
    _, starts, lengths, periods, _, _ = periodic_runs._columns([words])
    assert (starts[0].as_py(), lengths[0].as_py(), periods[0].as_py()) == ([5], [12_017], [3000])


def test_synchronising_set_is_locally_consistent():
    rng = np.random.default_rng(5)
    scale, n = 16, 400
    piece = rng.integers(0, 1 << 60, n).astype(np.uint64)
    both = np.concatenate([piece, rng.integers(0, 1 << 60, 57).astype(np.uint64), piece])
    chosen = set(periodic_runs.synchronising_set(both.copy(), scale, np.zeros(len(both), bool)).tolist())
    first = {i for i in chosen if i + scale < n}
    assert first == {i - n - 57 for i in chosen if n + 57 <= i and i - n - 57 + scale < n}
    assert all(any(i + j in chosen for j in range(scale)) for i in range(n - 3 * scale)) and len(first) < n // 4


def test_ties_take_the_smallest_start():
    words = b"a b a b a b a b x c d c d c d c d".split()
    _, starts, _, _, best, _ = periodic_runs._columns([words])
    assert starts[0].as_py() == [0, 9] and best[0].as_py() == 0
    assert periodic_runs.longest([(3, 8, 2), (0, 16, 4), (9, 9, 2)]) == (9, 9, 2)


def test_odd_documents_and_empty_table(spark, odd_docs, no_docs):
    got = periodic_runs.periodic_runs(odd_docs, carry=odd_docs.columns).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        words = (r.row.text or "").encode().split()
        if len(words) < 3000:
            assert list(zip(r.starts, r.lengths, r.periods, strict=True)) == brute_runs(words)
        elif set(words) == {b"word"}:
            assert (r.starts, r.lengths, r.periods, r.collapsed) == ([0], [20_000], [1], "word")
    assert periodic_runs.periodic_runs(no_docs).count() == 0
    assert periodic_runs.run_facts(odd_docs).filter(F.col("runs_sha256").isNull()).count() == 0
