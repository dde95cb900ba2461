import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdq.llm import language_id, quality, queries, samples, subword, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op9_language_id"](spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.98), ("op10_toxicity", "toxic", 0.93)])
def test_labels_held_out(spark, name, label, least):
    """At sf0.1: sf0.01 has too few toxic labels to learn from."""
    large = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").filter("held_out").collect()
    one, none = [r.score for r in got if r[label] == 1], [r.score for r in got if r[label] == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in none])
    assert auc > least and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_odd_documents_and_no_rows(spark, odd_docs, no_docs):
    carry = odd_docs.columns
    trained = language_id.train(table(spark, "documents"), per_class=40)
    for model in (trained, language_id.train(no_docs)):
        got = language_id.identify(odd_docs, model, carry).collect()
        assert len(got) == odd_docs.count()
        for r in got:
            assert (r.lang_pred == "und") == (not model.names or not any(map(str.isalpha, r.row.text or "")))
    labelled = table(spark, "documents").join(table(spark, "labels"), "doc_id")
    one_class = labelled.filter("toxic = 0 AND quality = 1").limit(30)
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        for rows in (labelled.limit(80), one_class, no_docs.withColumn(label, F.lit(1))):
            rated = module.rate(odd_docs, module.train(rows, per_class=40), carry)
            assert rated.count() == odd_docs.count() and rated.filter("score BETWEEN 0 AND 1").count() == odd_docs.count()
            assert rated.select("row.*").columns == carry
        assert module.rate(no_docs, module.train(rows), ["doc_id"]).count() == 0
    assert language_id.identify(no_docs, trained, ["doc_id"]).count() == 0


def test_unseen_misspellings_share_ngrams(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 8)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rnd.randint(5, 120))]
        if i % 4 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["vexgrommel", "blorkwitz"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    clean, bad = " ".join(word() for _ in range(80)), " ".join([*(word() for _ in range(40)), "vexgromel,", *(word() for _ in range(40))])
    score = model.score(model.levels(*toxicity._flat(subword.WordScores(model.logits), [clean, bad, ""])))
    assert score[1] > 0.5 > score[0]
    assert score[2] == model.score(np.zeros(1))[0]


def test_length_alone_makes_no_text_toxic():
    """Clean texts of random words: the worst run rises with length, what is left of it doesn't."""
    rng = np.random.default_rng(5)
    lens = np.concatenate([rng.integers(10, 3000, 300), [0, 1, 5, 6]])
    values = rng.standard_normal(lens.sum())
    worst = toxicity.worst_runs(values, lens, 6)
    model = toxicity.ToxicityModel(np.zeros((2, 1), np.float32), 6, 1.0, 0.0)
    assert np.array_equal(model.levels(values, lens), worst)
    clean = np.arange(len(lens)) < 300
    model.trend = toxicity.length_trend(worst, lens, clean, 6)
    left = model.levels(values, lens)
    assert np.corrcoef(worst[clean], np.log(lens[clean]))[0, 1] > 0.4 > 0.1 > abs(np.corrcoef(left[clean], np.log(lens[clean]))[0, 1])
    assert left[300] == 0 and abs(left[301] - worst[301]) < 1e-12
    assert toxicity.length_trend(worst, lens, ~clean, 6) == 0.0  # too few to tell


def test_worst_runs_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    lens = rng.integers(0, 12, 40)
    values = rng.standard_normal(lens.sum())
    got, at = toxicity.worst_runs(values, lens, 4), 0
    for g, n in zip(got, lens, strict=True):
        v, at = values[at : at + n], at + n
        w = min(4, n)
        assert abs(g - (max(v[i : i + w].mean() for i in range(n - w + 1)) if n else 0)) < 1e-9


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(features=5, hidden=4, gate=3)
    model.w = {k: v.astype(np.float64) + 0.1 for k, v in model.w.items()}
    x, passages, y = rng.standard_normal((9, 5)), np.array([2, 1, 4, 2]), np.array([0, 1, 1, 0])

    def loss():
        z = model.forward(x, passages)["logit"]
        return float((np.log1p(np.exp(z)) - y * z).mean())

    f = model.forward(x, passages)
    grads = model.gradients(f, (1 / (1 + np.exp(-f["logit"])) - y) / len(y))
    for k, g in grads.items():
        at = tuple(0 for _ in g.shape)
        model.w[k][at] += 1e-6
        up = loss()
        model.w[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5, k
        model.w[k][at] += 1e-6


def test_vocabulary_bounds_do_not_change_scores():
    rng = np.random.default_rng(1)
    logits = rng.standard_normal((1 << 10, 2)).astype(np.float32)
    texts = [" ".join(str(rng.integers(0, 500)) for _ in range(50)) for _ in range(30)]
    large = subword.WordScores(logits).of(texts)[0]
    small = subword.WordScores(logits, max_words=20)
    assert np.allclose(large, np.concatenate([small.of([t])[0] for t in texts]), atol=1e-6)
    encoder, bounded = quality.PassageEncoder(), quality.PassageEncoder(max_words=20)
    assert np.allclose(encoder.encode(texts)[0], np.concatenate([bounded.encode([t])[0] for t in texts]), atol=1e-5)


def test_sample_keeps_every_label_and_learns_from_long_texts(spark):
    """A label whose rows all hold one text, one with a single row, and one with only very long texts stay in the sample."""
    rows = [(i, "a", "same text") for i in range(3000)] + [(5000, "b", "alone")] + [(6000 + i, "c", f"long{i} " * 500) for i in range(40)]
    rows += [(None, "d", f"text {i}") for i in range(50)] + [(7000, None, "x"), (7001, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    for columns in (["doc_id", "lang", "text"], ["lang", "text"]):
        sample, counts = samples.labelled_sample(docs.select(*columns), "lang", 10, 200)
        got = [r["lang"] for r in sample.to_pylist()]
        assert counts == {"a": 3000, "b": 1, "c": 40, "d": 50} and {x: got.count(x) for x in "abcd"} == {"a": 1, "b": 1, "c": 10, "d": 10}
        assert max(len(r["text"]) for r in sample.to_pylist()) == 200


def test_labels_of_their_own_give_the_same_sample(spark):
    """Labels joined by id: the same texts are drawn as from labelled rows; conflicting, missing and repeated labels are defined."""
    docs = [(i, f"text {i}") for i in range(400)] + [(400, None), (None, "no id"), (7, "a second text of 7"), (401, "unlabelled")]
    labels = [(i, int(i % 9 == 0)) for i in range(400)] + [(400, 1), (None, 1), (3, 0), (5, 1), (9999, 1), (401, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3)
    joined = docs.join(labels.distinct(), "doc_id")
    pairs = lambda sample: sorted((r["toxic"], r["text"]) for r in sample[0].to_pylist())
    for per_class in (10, 1000):
        one = samples.labelled_sample(joined, "toxic", per_class, 100)
        two = samples.labelled_sample(docs, "toxic", per_class, 100, labels=labels)
        assert pairs(one) == pairs(two) and one[1] == two[1] and len(pairs(one)) >= 20
    none = samples.labelled_sample(docs, "toxic", 10, 6, labels=labels.limit(0))
    assert none[0].num_rows == 0 and none[1] == {}


def test_cuts_are_the_lowest_draws(spark):
    """Against sorting: many rows, few rows, one draw shared by all rows, and draws that lie high."""
    rng = np.random.default_rng(4)
    draws = {"many": rng.integers(-2**63, 2**63 - 1, 5000), "few": rng.integers(-2**63, 2**63 - 1, 7),
             "same": np.full(3000, 2**63 - 1), "high": rng.integers(2**62, 2**63 - 1, 2000)}
    rows = [(v, int(d)) for v, ds in draws.items() for d in ds]
    table = spark.createDataFrame(rows, "lang string, draw long").repartition(6)
    cuts = samples._cuts(table, "lang", 20, {v: len(d) for v, d in draws.items()})
    assert cuts == {v: int(np.sort(d)[min(20, len(d)) - 1]) for v, d in draws.items()}
    assert samples._cuts(table.limit(0), "lang", 20, {}) == {}
