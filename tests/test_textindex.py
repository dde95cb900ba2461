"""Positional index against plain substring search."""

import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkdq.operators import proposals as G
from sparkdq.operators import textindex
from sparkdq.operators.textindex import TextIndex

WORDS = ["foo", "bar", "Foo", "ba", "o", "über", "x1", "42", "a"]
GAPS = [" ", ", ", "  ", "-", "\n", "."]


def _texts(rng, n):
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(9))]
        yield rng.choice(["", "", " ", "("]) + "".join(w + rng.choice(GAPS) for w in words[:-1]) + (words[-1] + rng.choice(["", ".", " "]) if words else "")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs = list(enumerate(_texts(rng, 50))) + [(100, None), (101, ""), (102, "--"), (103, "foo bar " * 400 + "end"), (104, "bar foo"), (None, "foo zzz")]
    phrases = {"zzz", "foo zzz bar foo", "", ", ,", "bar foo bar", "o", " ", "bar end", "oo ba"}
    while len(phrases) < 150:
        t = rng.choice(docs[:50])[1]
        if t:
            a = rng.randrange(len(t))
            p = t[a:a + rng.randrange(1, 30)]
            phrases.add(p.upper() if rng.random() < 0.2 else p)
    phrases = list(enumerate(sorted(phrases))) + [(999, None)]
    return (docs, phrases, spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(phrases, "pid int, phrase string"))


def _expected(docs, phrases):
    return {(d, p) for d, t in docs if t and d is not None for p, q in phrases if q and q.lower() in t.lower()}


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    index, docs = TextIndex(spark, str(tmp_path_factory.mktemp("ix") / "ix"), buckets=4), corpus[2]
    index.add(docs.where("doc_id % 2 = 0"), "even")
    for _ in range(2):  # a repeated batch replaces itself
        index.add(docs.where("doc_id % 2 = 1 OR doc_id IS NULL"), "odd")
    return index


def test_finds_what_contains_finds(corpus, index):
    docs, phrases, _, p = corpus
    got = [(r["doc"], r["pid"]) for r in index.find(p, "phrase", ["pid"]).collect()]
    assert len(got) == len(set(got)) and set(got) == _expected(docs, phrases)
    assert {r["pid"] for r in index.phrases_found(p, "phrase", ["pid"]).collect()} == {p for _, p in _expected(docs, phrases)}


def test_vocabulary_counts(index, corpus):
    terms = {r["term"]: r["n"] for r in index.terms().collect()}
    assert terms["end"] == 1 and terms["42"] == sum(1 for d, t in corpus[0] if t and d is not None for w in _split(t) if w == "42")


def _split(text):
    import re
    return re.findall(r"[^\W_]+", text.lower())


def test_no_text_is_read_again(index, corpus):
    plan = index.find(corpus[3], "phrase", ["pid"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "low#" not in plan
    assert "text#" not in plan and "doc_id#" not in plan


def test_keys_name_one_document(spark, index, corpus, tmp_path):
    with pytest.raises(ValueError, match="occurs twice"):
        index.add(spark.createDataFrame([(1, "again")], "doc_id int, text string"), "more")
    other = TextIndex(spark, str(tmp_path / "ix"))
    with pytest.raises(ValueError, match="occurs twice"):
        other.add(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id int, text string"), "b")
    with pytest.raises(ValueError, match="name a folder"):
        other.add(corpus[2], "../b")
    assert index.find(corpus[3].where("phrase = 'again'"), "phrase", ["pid"]).count() == 0


def test_empty_tables(spark, corpus, tmp_path):
    none = TextIndex(spark, str(tmp_path / "ix"))
    none.add(corpus[2].limit(0), "b")
    assert none.find(corpus[3], "phrase", ["pid"]).count() == 0


def test_verdicts_equal_those_over_texts(spark, index, corpus):
    quote = next(t for _, t in corpus[0] if t and len(t) > 12)
    rows = [("F1", "normalize_email", "d", (None, "email", None, None, None, None, None), [("P", quote), ("Q", "not there at all")], 0.9),
            ("F2", "normalize_email", "d", (None, "email", None, None, None, None, None), [("Q", " ")], 0.9)]
    props = spark.createDataFrame(rows, f"id string, action string, description string, params {G.PARAMS_TYPE}, policy_refs {G.REF_TYPE}, confidence double")
    flat = lambda v: sorted((r["id"], r["status"], r["notes"]) for r in v.collect())
    assert flat(G.verdicts(props, index)) == flat(G.verdicts(props, corpus[2].where(F.col("doc_id").isNotNull())))


def test_a_part_has_one_row_per_term(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=2)
    index.add(spark.createDataFrame([(i, "foo bar, foo " * 50) for i in range(40)], "doc_id int, text string").coalesce(1), "b")
    rows = {r["term"]: r for r in index._table("postings").collect()}
    assert len(rows) == index._table("postings").count() == 4  # two words, two gaps
    assert len(rows["foo"]["doc"]) == len(rows["foo"]["pos"]) == rows["foo"]["n"] == 4000
    assert sorted(rows[", "]["doc"]) == list(range(40)) and rows[", "]["pos"] == []


def test_parts_hold_every_occurrence(monkeypatch, corpus):
    cut = [(d, [w for w in re.split(r"[\W_]+", t.lower()) if w], re.split(r"[^\W_]+", t.lower())) for d, t in corpus[0] if t is not None and d is not None]
    batch = lambda rows: pa.RecordBatch.from_pydict({c: list(x) for c, x in zip("dwg", zip(*rows))}).rename_columns(["doc", "w", "g"])
    monkeypatch.setattr(textindex, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(textindex, "PART_WORDS", 25)
    parts = [b.to_pylist() for b in textindex._inverted(iter([batch(cut[:20]), batch(cut[20:])]))]
    assert len(parts) > 5 and len({r["part"] for p in parts for r in p}) == len(parts)
    got, gaps = set(), set()
    for p in parts:
        name = {r["id"]: r["term"] for r in p} | {textindex.NONE: None}
        assert len({r["term"] for r in p}) == len(p)
        for r in p:
            assert r["n"] == len(r["doc"])
            if r["pos"]:
                got |= {(r["term"], d, i, *map(name.get, x)) for d, i, *x in zip(r["doc"], r["pos"], r["prev"], r["before"], r["after"], r["next"], strict=True)}
            else:
                gaps |= {(d, r["term"]) for d in r["doc"]}
    assert got == {(w, d, i, ws[i - 1] if i else None, gs[i] or None, gs[i + 1] or None, ws[i + 1] if i + 1 < len(ws) else None)
                   for d, ws, gs in cut for i, w in enumerate(ws)}
    assert gaps == {(d, g) for d, _, gs in cut for g in gs if g}
