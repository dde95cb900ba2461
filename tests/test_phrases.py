import random
from collections import Counter

from sparkdq.operators import phrases as ph
from sparkdq.plans import registry

registry.load_all()


def brute(texts, phrases):
    """(group, text) rows: leftmost-longest whole-word matches by plain search."""
    terms = sorted({ph.normal(p) for p in phrases if p and ph.normal(p)}, key=len, reverse=True)
    out = Counter()
    for g, t in texts:
        t, i = ph.normal(t or ""), 0
        while i < len(t):
            for p in terms:
                j = i + len(p)
                if t.startswith(p, i) and not (i and ph.is_word(t[i - 1]) and ph.is_word(p[0])) and not (j < len(t) and ph.is_word(t[j]) and ph.is_word(p[-1])):
                    out[g, p] += 1
                    i = j - 1
                    break
            i += 1
    return out


def test_leftmost_longest_whole_words(spark):
    rnd = random.Random(6)
    words = ["new", "york", "city", "times", "new york", "é", "a-b", "x_1", "o'neil", "1"]
    phrases = ["New York", "new  york city", "york city times", "city", "é a-b", "times new", "x_1", "o'neil 1", "-b", None, " ", "city", "new york"]
    texts = [(rnd.choice(["s1", "s2", None]), rnd.choice([" ", "\n", "  "]).join(rnd.choices(words, k=rnd.randrange(0, 30)))) for _ in range(200)]
    texts += [("s1", None), ("s1", "newyork new yorkers NEW\tYORK"), ("s2", "x_12 x_1 o'neil 1")]
    df = spark.createDataFrame(texts, "phrase string, text string").repartition(3)  # a group column named like the result's
    terms = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = brute(texts, phrases)
    for bound in (ph.SHARD_BYTES, 40):  # one automaton, and terms in several shards
        got = {(r.g, r.phrase): r.n for r in ph.phrase_counts(df.withColumnRenamed("phrase", "g"), "text", ["g"], terms, shard_bytes=bound).collect()}
        assert got == dict(want)
    assert any(" " in p for _, p in want)
    assert ph.phrase_counts(df, "text", ["text"], terms.limit(0)).count() == 0 == ph.phrase_counts(df.limit(0), "text", ["text"], terms).count()


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, [" ".join(w[:n]) for w in items for n in (3, 5)])
    assert {(r.source, r.phrase): r.n for r in registry.QUERIES["d_phrase_hits"](spark, sf).collect()} == dict(want) and want
