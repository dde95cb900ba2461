import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from sparkdq.llm import source_divergence as sd

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, least_docs=3, ranks=200):
    """(lang, source, text) rows -> result rows, by plain loops."""
    seen, count, groups = defaultdict(set), Counter(), set()
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            seen[lang, w].add(i)
            count[lang, source, w] += 1
    kept = defaultdict(list)
    for (lang, w), docs in seen.items():
        if len(docs) >= least_docs:
            kept[lang].append(w)
    out = []
    for lang, source in groups:
        v, mine = len(kept[lang]), [s for x, s in groups if x == lang]
        n = {s: sum(count[lang, s, w] for w in kept[lang]) for s in mine}
        p = {s: {w: 1 + 10**9 * (count[lang, s, w] + 1) // (n[s] + v) for w in kept[lang]} for s in mine}
        whole = {w: 1 + 10**9 * (sum(count[lang, s, w] for s in mine) + 1) // (sum(n.values()) + v) for w in kept[lang]}
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(p[source][w], p[s][w]) for w in kept[lang])) for s in mine if s != source]
        terms = [(w, f(p[source][w], whole[w])) for w in kept[lang] if count[lang, source, w] and p[source][w] > whole[w]]
        for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in sd.divergence(docs, **how).collect())


def corpus(rnd, n):
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefgh", "abcdefghi", "ABCDefghij", "naïve", "É", "é", "日本語テキスト", "日本語", "x" * 40, "x" * 41, "x" * 300]
    words += ["".join(rnd.choices("abé", k=rnd.randrange(1, 12))) for _ in range(60)]
    return [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "é", None]), rnd.choice([" ", "1", "\x00", "_"]).join(rnd.choices(words, k=rnd.randrange(0, 40)))) for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(5), 80) + [("fr", "only", "seul"), ("xx", "s1", ""), ("xx", "s2", None), ("en", "s1", None)]
    want = brute(rows)
    assert run(spark, rows) == want and {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want if r[0] == "xx")
    # Small chunks, blocks and tiles give the same.
    for name, value in (("CHUNK_WORDS", 60), ("ROWS_PER_BLOCK", 25), ("CELLS", 16)):
        monkeypatch.setattr(sd, name, value)
    assert run(spark, rows, ranks=3) == brute(rows, ranks=3)


def test_refinement_discards_rare_prefixes_and_keeps_exact_terms():
    terms = sorted([b"a", b"abcd", b"abcde", b"abcdefgh", b"abcdefghi", b"zzzzz", b"z" * 40, b"z" * 45])
    size, shared = np.array([len(t) for t in terms]), sd.common(terms)
    assert shared.tolist() == [0, 1, 4, 5, 8, 0, 5, 40]
    begins, complete = sd.groups_of(size, shared, np.arange(len(terms)), 4)
    assert begins.tolist() == [0, 1, 2, 5] and complete.tolist() == [True, True, False, False]
    alive, kept, width = sd.refine(size, shared, [[0b0110]])  # 'abcd' kept; 'abcd...' survives; 'a' and 'zzzz...' go
    assert [terms[i] for i in alive] == [b"abcde", b"abcdefgh", b"abcdefghi"] and [terms[i] for i in kept] == [b"abcd"] and width == 8
    assert [terms[i] for i in alive[sd.groups_of(size, shared, alive, 8)[0]]] == [b"abcde", b"abcdefgh", b"abcdefghi"]
    assert sd.refine(size, shared, [None])[0].tolist() == [] == sd.refine(size, shared, [None])[1].tolist()


def test_shares_are_exact_beyond_64_bits():
    count = np.array([0, 1, 10**13, (1 << 62) - 1])
    assert sd.shares(count, 1 << 62).tolist() == [1 + 10**9 * (int(c) + 1) // (1 << 62) for c in count]


def test_odd_documents_and_empty_table(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in sd.divergence(odd_docs, least_docs=2).collect())
    assert got == brute(rows, least_docs=2)
    assert sd.divergence(no_docs).count() == 0


def test_parts_stay_small(spark):
    """A task holds few postings at a time, however many a chunk of texts has; a first prefix is in one part, a document's source beside it."""
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnop", repeat=5), 600_000)]
    docs = spark.createDataFrame([("en", "s1", " ".join(words)), ("en", "s2", "aaaaa pppp"), ("en", "s3", "1")], "lang string, source string, text string").coalesce(1)
    parts = docs.mapInArrow(sd._parts, sd.PARTS).collect()
    at = [np.frombuffer(p.docs, "<i4") for p in parts]
    assert sum(map(len, at)) == 600_002 and max(map(len, at)) <= 300_000
    assert [set(p.sources) for p in parts] == [{"s1", "s2", "s3"}, {"s1"}, {"s1", "s2"}]
    assert [Counter(p.sources[i] for i in np.frombuffer(p.of, "<i4")[a]) for p, a in zip(parts, at, strict=True)][0]["s2"] == 1
    firsts = [{p.terms[e - 5 : e][:4] for e in np.frombuffer(p.ends, "<i4") if e >= 5} for p in parts[:2]]
    assert not firsts[0] & firsts[1]


def test_small_parts_equal_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(6), 60)
    for name, value in (("READ_BYTES", 300), ("CHUNK_WORDS", 200), ("PART_POSTINGS", 5)):
        monkeypatch.setattr(sd, name, value)
    assert run(spark, rows) == brute(rows)
