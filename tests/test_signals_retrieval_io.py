import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from sparkdq.operators import policy_checks as T
from sparkdq.operators import retrieval as R
from sparkdq.operators import signals as S
from sparkdq.sources import io


def test_entity_counts(spark, pii_sample):
    e = {(r["column"], r["class"]): r["n"] for r in S.entity_counts(pii_sample, ["name", "address", "signup_date", "notes"]).collect()}
    assert e[("name", "PERSON")] == 2  # john, jane
    assert e[("address", "GPE")] == 5
    assert e[("signup_date", "DATE")] == 6
    assert ("notes", "PERSON") in e  # present, zero counts kept


def test_risk_scores(spark):
    ent = spark.createDataFrame([("email", "PERSON", 1), ("email", "DATE", 2), ("name", "PERSON", 30)],
                                "column string, class string, n bigint")
    sim = spark.createDataFrame([("email", "email", 0.8), ("email", "name", 0.1), ("name", "name", 0.9),
                                 ("id", "dob", 0.71)], "column string, class string, similarity double")
    r = {x["column"]: x["risk_score"] for x in S.risk_scores(ent, sim, has_email_check=True).collect()}
    assert r == {"email": 5 + 8 + 40 + 10, "name": 100, "id": 45}
    lv = spark.createDataFrame([(70,), (40,), (39,)], "s int").select(S.risk_level("s")).collect()
    assert [x[0] for x in lv] == ["HIGH", "MEDIUM", "LOW"]


def test_exemplar_similarity_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(20, 8))
    ex = rng.normal(size=(6, 8))
    vdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id int, embedding array<double>")
    edf = spark.createDataFrame([("a" if i < 3 else "b", [float(x) for x in v]) for i, v in enumerate(ex)],
                                "class string, embedding array<double>")
    got = {(r["vec_id"], r["class"]): r["similarity"] for r in S.exemplar_similarity(vdf, edf).collect()}
    cos = (vecs @ ex.T) / (np.linalg.norm(vecs, axis=1)[:, None] * np.linalg.norm(ex, axis=1)[None, :])
    for i in range(20):
        assert abs(got[(i, "a")] - round(cos[i, :3].mean(), 3)) < 1.1e-3
        assert abs(got[(i, "b")] - round(cos[i, 3:].mean(), 3)) < 1.1e-3
    # Vectors and exemplars without length change nothing for the others.
    odd = spark.createDataFrame([(100, [0.0] * 8), (101, None), (102, [float("nan")] * 8)], vdf.schema)
    odd_ex = spark.createDataFrame([("a", [0.0] * 8), ("b", None), ("a", [float("nan")] * 8)], edf.schema)
    more = {(r["vec_id"], r["class"]): r["similarity"] for r in S.exemplar_similarity(vdf.unionByName(odd), edf.unionByName(odd_ex)).collect()}
    assert {k: v for k, v in more.items() if k[0] < 100} == got
    assert all(v is None for k, v in more.items() if k[0] >= 100) and len(more) == 46


def test_terms_and_order_columns(spark):
    df = spark.createDataFrame([("a", "see C++ and e.mail, exmail or c"), ("b", "John went")], "name string, text string")
    assert {(r["term"], r["n"]) for r in S.term_hits(df, "text", ["name"], ["c++", "e.mail", "c"]).collect()} == {("c++", 1), ("e.mail", 1), ("c", 1)}
    e = {(r["column"], r["class"]): r["n"] for r in S.entity_counts(df, sample_rows=20, order_by=["name"]).collect()}
    assert e[("text", "PERSON")] == 1 and ("name", "PERSON") in e


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = rng.normal(size=(200, 5))
    qs = rng.normal(size=(7, 5))
    ddf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(docs)], "vec_id int, embedding array<double>")
    qdf = spark.createDataFrame([(100 + i, [float(x) for x in v]) for i, v in enumerate(qs)], "query_id int, embedding array<double>")
    for block in (100, 3):
        got = R.top_k(ddf, qdf, k=4, docs_per_block=40, queries_per_block=block).collect()
        res = {}
        for r in got:
            res.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        for i, q in enumerate(qs):
            want = list(np.argsort(((docs - q) ** 2).sum(axis=1), kind="stable")[:4])
            assert [v for _, v in sorted(res[100 + i])] == want


def test_top_k_cosine_string_ids_ties(spark):
    rng = np.random.default_rng(5)
    docs = np.round(rng.normal(size=(300, 4)), 1)
    docs[50:60] = docs[0]  # exact ties, broken by id
    qs = np.round(rng.normal(size=(5, 4)), 1)
    qs[0] = docs[0]
    ddf = spark.createDataFrame([(f"d{i:03d}", [float(x) for x in v]) for i, v in enumerate(docs)],
                                "vec_id string, embedding array<float>").repartition(4)
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "query_id int, embedding array<double>")
    for metric in ("cosine", "l2"):
        got = {}
        for r in R.top_k(ddf, qdf, k=7, metric=metric, docs_per_block=50).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        d32 = docs.astype(np.float32).astype(np.float64)
        for i, q in enumerate(qs):
            if metric == "l2":
                dist = ((d32 - q) ** 2).sum(axis=1)
            else:
                dist = 1 - (d32 @ q) / (np.linalg.norm(d32, axis=1) * np.linalg.norm(q))
            want = sorted(range(len(docs)), key=lambda j: (round(dist[j], 9), f"d{j:03d}"))[:7]
            assert [v for _, v in sorted(got[i])] == [f"d{j:03d}" for j in want]


def test_top_k_plan_has_group_limit(spark):
    ddf = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id int, embedding array<double>")
    qdf = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, embedding array<double>")
    plan = R.top_k(ddf, qdf, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_top_k_odd_rows(spark):
    ddf = spark.createDataFrame([(None, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [2.0, 0.0])],
                                "vec_id bigint, embedding array<double>")
    qdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "query_id int, embedding array<double>")
    for metric, want in (("l2", {(1, None), (2, 2), (3, 6)}), ("cosine", {(1, 6), (2, None)})):
        got = R.top_k(ddf, qdf, k=3, metric=metric).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, *w) for q in (1, 3) for w in want}
    assert R.top_k(ddf.limit(0), qdf).count() == 0 and R.top_k(ddf, qdf.limit(0)).count() == 0


def test_csv_cells(spark, tmp_path):
    from sparkdq.sources import io

    rows = [(1, 'a "quoted" b'), (2, "x\ny, z"), (3, "c:\\dir\\"), (4, None), (5, "  pad  "), (6, '"')]
    df = spark.createDataFrame(rows, "id int, t string")
    io.write_table(df, f"{tmp_path}/c", "csv")
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/c", "id int, t string").collect())) == rows


def test_publish_modes_and_failures(spark, tmp_path):
    from sparkdq.sources import io

    old, new = spark.range(3), spark.range(10)
    target = f"{tmp_path}/target"
    go = lambda df, audit, **kw: io.write_audit_publish(df, f"{tmp_path}/staging", target, audit, **kw)
    assert go(old, lambda d: True, mode="A")["published"]
    assert not go(new, lambda d: False, mode="A")["published"] and spark.read.parquet(target).count() == 3

    def broken(d):
        raise RuntimeError("audit broke")

    r = go(new, broken)
    assert not r["published"] and "audit broke" in r["warning"] and spark.read.parquet(target).count() == 3
    r = go(new, lambda d: d.count() == 7, mode="B", repropose=lambda d, n: d.limit(10 - 3 * n))
    assert r["published"] and r["attempts"] == 2 and spark.read.parquet(target).count() == 7
    assert go(new, lambda d: False)["warning"] and spark.read.parquet(target).count() == 10
    import os
    assert sorted(os.listdir(tmp_path)) == ["staging", "target"] and os.listdir(f"{tmp_path}/staging") == []


def test_flatten_dedupe_and_combined(spark):
    df = spark.createDataFrame([(1, ["  a ", "b"]), (2, ["a", ""]), (3, None)], "doc_id int, text array<string>")
    out = {r["text"]: (r["doc_id"], r["n_copies"]) for r in R.flatten_dedupe(df).collect()}
    assert out == {"a": (1, 2), "b": (1, 1)}
    assert sorted(map(tuple, R.flatten_dedupe(df, with_text=False).collect())) == [(1, 1), (1, 2)]
    hits = spark.createDataFrame([(1, 2, 20), (1, 1, 10)], "query_id int, rank int, doc_id int")
    docs = spark.createDataFrame([(10, "x"), (20, "y")], "doc_id int, text string")
    assert R.combined_text(hits, docs).first()["combined_text"] == "x\n\ny"


def test_term_hits_and_text_matches(spark):
    df = spark.createDataFrame([("s", "Health data and a NATIONAL ID; date of birth. mail me at a.b@x.org or +1 (202) 555-0101")],
                               "source string, text string")
    t = {r["term"]: r["n"] for r in S.term_hits(df, "text", ["source"]).collect()}
    assert t == {"health": 1, "national id": 1, "date of birth": 1}
    m = {r["kind"]: r["n_matches"] for r in S.text_matches(df, "text", ["source"]).collect()}
    assert m == {"email": 1, "phone": 1}


def test_policy_checks(spark, dq_sample):
    flagged = T.row_flags(dq_sample, T.default_row_checks("2024-01-01"))
    clean, bad = T.quarantine(flagged)
    assert clean.count() + bad.count() == 11 and bad.count() > 0
    assert {r["id"] for r in T.duplicate_ids(dq_sample).collect()} == {10}
    req = {r["column"]: r["n"] for r in T.required_nulls(dq_sample, ["email", "phone", "nope"]).collect()}
    assert req == {"email": 2, "phone": 2}
    audit = T.mask_audit(dq_sample, [{"action": "mask_email", "params": {"column": "email"}},
                                     {"action": "redact_address", "params": {"column": "name"}}]).collect()
    assert [(a["action"], a["rows_changed"]) for a in audit] == [("mask_email", 9), ("redact_address", 11)]


def test_check_suite(spark, pii_sample):
    names = T.PII_FALLBACK_CHECKS + ("unknown",)
    rows = T.run_checks(pii_sample, names).collect()
    assert {r["check"] for r in rows} == {"schema_check", "ner_check", "email_regex", "phone_regex"}


def test_csv_roundtrip_and_history(spark):
    base = tempfile.mkdtemp(prefix="sparkdq-test-")
    p = os.path.join(base, "in.csv")
    with open(p, "w") as f:
        f.write("id,email,price\n1,NA,1.5\n2,a@b.c,null\n3,, -2\n4,x,abc\n")
    df = io.read_csv(spark, p, "id bigint, email string, price double").orderBy("id").collect()
    assert [r["email"] for r in df] == [None, "a@b.c", None, "x"]
    assert [r["price"] for r in df] == [1.5, None, -2.0, None]
    hist = os.path.join(base, "memory.json")
    with open(hist, "w") as f:
        json.dump({"fix_history": [{"dataset": "d", "timestamp": 1, "plan": {"proposed_fixes": [
            {"id": "F1", "action": "drop_duplicates", "description": "x", "params": {},
             "policy_refs": [{"policy_id": "P", "quote": "q"}], "confidence": 0.9}], "questions_to_user": []},
            "post_validation": {"accepted": True, "notes": "ok", "confidence": 0.9}},
            {"dataset": "d", "timestamp": 2, "plan": {"proposed_fixes": [], "questions_to_user": []}}]}, f)
    runs = io.explode_runs(io.read_nested_history(spark, hist)).collect()
    assert len(runs) == 2 and runs[0]["action"] == "drop_duplicates" and runs[1]["action"] is None


def test_write_audit_publish_modes(spark, dq_sample):
    base = tempfile.mkdtemp(prefix="sparkdq-wap-")
    r = io.write_audit_publish(dq_sample, f"{base}/s", f"{base}/t", lambda d: False, mode="A")
    assert r["published"] is False and not os.path.exists(f"{base}/t")
    calls = []

    def again(df, attempt):
        calls.append(attempt)
        return df.dropDuplicates()

    r = io.write_audit_publish(dq_sample, f"{base}/s2", f"{base}/t2", lambda d: d.count() == 10, mode="B",
                               repropose=again)
    assert r["published"] and r["attempts"] == 2 and calls == [1]
    r = io.write_audit_publish(dq_sample, f"{base}/s3", f"{base}/t3", lambda d: False, mode="C")
    assert r["published"] and r["warning"]
    assert spark.read.parquet(f"{base}/t3").count() == 11
