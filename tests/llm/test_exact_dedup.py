import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdq.llm import exact_dedup as ed


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=200), st.integers(0, 40))
def test_golomb_round_trip(values, k):
    a = np.array(sorted(values), np.int64)
    if len(a) and (a[-1] >> k) > 5_000_000:
        k = 47
    assert (ed.decode(ed.encode(a, k), k) == a).all()


def test_golomb_is_near_the_entropy():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 40, 10_000))
    k = ed.rice_parameter(1 << 40, len(a))
    assert len(ed.encode(a, k)) * 8 / len(a) < np.log2((1 << 40) / len(a)) + 2


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        ids = [x for x in g if x is not None]
        out.append((i, min(ids) if ids else None, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_documents(odd_docs):
    got = ed.exact_dedup(odd_docs, carry=odd_docs.columns).cache()
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(((r.id, r.keep_id, r.group_size, r.digest) for r in got.collect()), key=str) == brute(rows)
    # exactly one row of each group stays, also among repeated rows; carried columns keep their names
    assert got.filter("kept").count() == got.select("digest").distinct().count()
    assert got.select("row.*").columns == odd_docs.columns


def test_empty_table(no_docs):
    assert ed.exact_dedup(no_docs).count() == 0


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    texts = ["aa", "ab", "aa", "b", "ac", "ab", "ab", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = ed.exact_dedup(docs, digest=lambda t: F.substring(t, 1, 1)).collect()
    assert {r.id: (r.keep_id, r.group_size, r.kept) for r in got} == {
        0: (0, 2, True), 2: (0, 2, False), 1: (1, 3, True), 5: (1, 3, False), 6: (1, 3, False), 3: (3, 1, True), 4: (4, 1, True),
        7: (7, 2, True), 8: (7, 2, False)}


def test_false_suspects_of_short_fingerprints_stay(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 350).cast("string")).alias("text"))
    got = ed.exact_dedup(docs, bits=8)
    assert got.filter("kept").count() == 350 and got.filter("group_size = 2").count() == 100


def test_a_third_of_all_rows_equal(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same  text").otherwise(F.col("id").cast("string")).alias("text"))
    got = ed.exact_dedup(docs)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000 AND keep_id = 0").count() == 1000
