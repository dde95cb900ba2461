from pyspark.sql import functions as F

from sparkdq.operators import proposals as G
from sparkdq.operators import profile as P
from sparkdq.operators.textjoin import contains_join

POLICY_TEXT = "Data quality rules\n" + "\n".join(f"- {p}" for p in G.KNOWN_POLICIES.values())


def _docs(spark):
    return spark.createDataFrame([("dq", POLICY_TEXT), ("other", "Nothing relevant here.")], "doc_id string, text string")


def _props(spark, fixes):
    schema = (f"id string, action string, description string, params {G.PARAMS_TYPE}, "
              f"policy_refs {G.REF_TYPE}, confidence double")
    return spark.createDataFrame(fixes, schema)


def _p(column=None, subset=None, strategy=None, value=None):
    return (subset, column, strategy, value, None, None, None)


def test_trailing_full_stop_quote_rejected(spark):
    kp = G.KNOWN_POLICIES
    fixes = [
        ("F1", "normalize_email", "d", _p("email"), [("RAG-P1", kp["RAG-P1"] + ".")], 0.9),
        ("F2", "drop_duplicates", "d", _p(subset=["id"]), [("RAG-P4", kp["RAG-P4"])], 0.9),
        ("F3", "impute_nulls", "d", _p("email", strategy="constant", value=""), [("RAG-P7", kp["RAG-P7"])], 0.8),
        ("F4", "remove_negative_values", "d", _p("price"), [("RAG-P5", "  " + kp["RAG-P5"].upper() + " ")], 0.9),
    ]
    v = {r["id"]: r for r in G.verdicts(_props(spark, fixes), _docs(spark)).collect()}
    assert v["F1"]["status"] == "rejected"
    assert v["F1"]["notes"].startswith("Policy quote not found in RAG: '")
    assert v["F1"]["notes"].endswith("No valid policy_refs matched the RAG text.")
    assert all(v[i]["status"] == "accepted" and v[i]["notes"] == "Policy validated." for i in ("F2", "F3", "F4"))
    ov = G.overall(G.verdicts(_props(spark, fixes), _docs(spark))).first()
    assert (ov["overall_decision"], ov["n_rejected"]) == ("revise", 1)
    # G4 keeps F1's reference: the canonical phrase (not the quote) is in the text.
    kept = G.canonical_refs(_props(spark, fixes), G.policies_frame(spark), _docs(spark))
    assert {r["id"]: len(r["policy_refs"]) for r in kept.collect()}["F1"] == 1
    acc = {r["id"] for r in G.accepted_actions(G.verdicts(_props(spark, fixes), _docs(spark))).collect()}
    assert acc == {"F2", "F3", "F4"}
    assert G.accepted_actions(G.verdicts(_props(spark, fixes), _docs(spark)), partial_ok=False).count() == 0


def test_gates_and_notes_order(spark):
    fixes = [("F9", "truncate", None, _p("nope"), [("X", "   "), ("RAG-P3", G.KNOWN_POLICIES["RAG-P3"])], None)]
    r = G.verdicts(_props(spark, fixes), _docs(spark), columns=["id", "email"]).first()
    assert r["status"] == "rejected"
    assert r["notes"] == ("Action 'truncate' not allowed. ; Column 'nope' not present. ; "
                          "Low confidence (0.0) - threshold 0.7 ; Empty policy quote")
    assert [x["policy_id"] for x in r["policy_refs"]] == ["RAG-P3"]


def test_no_proposals_accept(spark):
    assert G.overall(G.verdicts(_props(spark, []), _docs(spark))).first()["overall_decision"] == "accept"


def test_extract_and_validate(spark):
    good = '{"proposed_fixes":[{"id":"a","description":"d","action":"x","params":{},"policy_refs":[{"policy_id":"p","quote":"q"}],"confidence":1}]}'
    rows = [(1, good), (2, "Sure! " + good + " thanks"), (3, '{"proposed_fixes":[{"id":"a"}]}'),
            (4, "nothing"), (5, '{"proposed_fixes":[]}'), (6, '{"x": 1}'),
            (7, good.replace('[{"policy_id":"p","quote":"q"}]', '["q"]'))]
    df = spark.createDataFrame(rows, "k int, raw string")
    out = {r["k"]: r for r in G.parse_plans(df).collect()}
    assert [out[i]["schema_valid"] for i in range(1, 8)] == [True, True, False, False, True, False, False]
    assert out[4]["json_text"] is None and out[2]["json_text"] == good
    q = {r["k"]: r["question"] for r in G.plan_questions(G.parse_plans(df), ["k"]).collect()}
    assert q == {3: G.QUESTION_NO_GROUNDED_FIX, 4: G.QUESTION_NO_JSON, 6: G.QUESTION_NO_JSON,
                 7: G.QUESTION_NO_GROUNDED_FIX}


def test_contains_join_few_phrases(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "lazy dog sleeps here"), (3, "")],
                                 "doc_id int, text string")
    ph = spark.createDataFrame([("a", "quick brown fox"), ("b", "ck brown fo"), ("c", "DOG"), ("d", ""),
                                ("e", "brown cat jumps")], "pid string, phrase string")
    found = lambda p: {(r["doc_id"], r["pid"]) for r in contains_join(docs, "text", p, "phrase").collect()}
    assert found(ph) == {(1, "a"), (1, "b"), (2, "c")}
    assert found(ph.where("pid in ('a', 'e')")) == {(1, "a")}
    assert found(ph.limit(0)) == set()


def test_propose_and_validate_results(spark, dq_sample):
    from sparkdq.operators import fixes as FX
    from sparkdq.plans.fix_queries import ACCEPTED_PLAN
    from sparkdq.plans.grounding_queries import rules_frame

    prof = P.profile(dq_sample)
    props = {r["id"]: r for r in G.propose(prof, rules_frame(spark), G.policies_frame(spark)).collect()}
    assert set(props) == {"R1:table", "R2:email", "R2:phone", "R2:price", "R3:email", "R4:price"}
    assert props["R1:table"]["policy_refs"][0]["policy_id"] == "RAG-P4"
    after = FX.apply_fixes(dq_sample, ACCEPTED_PLAN, ["name"])
    active = G.policy_inventory(G.policies_frame(spark, {"RAG-P5": G.KNOWN_POLICIES["RAG-P5"]}), _docs(spark))
    r = G.validate_results(P.evaluate(dq_sample, after), P.profile(after), active).first()
    assert (r["accepted"], r["notes"], r["confidence"]) == (True, "Improved and compliant", 0.9)
    r2 = G.validate_results(P.evaluate(dq_sample, dq_sample), P.profile(dq_sample), active).first()
    assert (r2["accepted"], r2["confidence"]) == (False, 0.2)
    assert r2["notes"] == "Negative price values remain while policy prohibits negatives."


def test_split_known_columns(spark):
    fixes = [("A", "mask_email", "d", _p("email"), [], 0.9), ("B", "mask_email", "d", _p("nope"), [], 0.9)]
    kept, q = G.split_known_columns(_props(spark, fixes), ["email"])
    assert [r["id"] for r in kept.collect()] == ["A"]
    assert q.first()["question"] == "Column nope not found for action B"


def test_verdicts_independent_of_row_order(spark):
    kp = G.KNOWN_POLICIES
    fixes = [(f"F{i}", "normalize_email", "d", _p("email"),
              [("RAG-P1", kp["RAG-P1"] + ("." if i % 2 else "")), ("X", " ")], 0.5 + i / 20) for i in range(8)]
    a = sorted(G.verdicts(_props(spark, fixes), _docs(spark)).collect(), key=lambda r: r["id"])
    b = sorted(G.verdicts(_props(spark, list(reversed(fixes))).repartition(5), _docs(spark).repartition(3)).collect(),
               key=lambda r: r["id"])
    assert a == b


def test_contains_join_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    words = ["alpha", "be", "c", "delta", "Éclair", "x9", "fox", "über", "--", "a.b", "p5"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ",", ".", " -"]) for _ in range(rnd.randint(0, 12)))
             for _ in range(40)]
    phrases = set()
    for t in texts:
        if len(t) > 1:
            i = rnd.randrange(len(t))
            phrases.add(t[i:i + rnd.randint(1, 25)])
    phrases |= {"zzz", "-", " -", ". ", "q", "FOX", "über de", "be c"}
    phrases = sorted(p for p in phrases if p)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ph = spark.createDataFrame(list(enumerate(phrases)), "pid int, phrase string")
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p.lower() in t.lower()}
    found = lambda: {(r["doc_id"], r["pid"]) for r in contains_join(docs, "text", ph, "phrase").collect()}
    assert found() == want
    # With size-based broadcasting off, the same plan runs as sort-merge joins.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in contains_join(docs, "text", ph, "phrase")._jdf.queryExecution().executedPlan().toString()
        assert found() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_ids_of_several_plans_stay_apart(spark):
    quote = G.KNOWN_POLICIES["RAG-P1"]
    fix = lambda ref: ("F1", "normalize_email", "d", _p("email"), [("RAG-P1", ref)], 0.9)
    good = _props(spark, [fix(quote)]).withColumn("plan", F.lit("good"))
    bad = _props(spark, [fix("invented quote")]).withColumn("plan", F.lit("bad"))
    none = _props(spark, [(None, *fix(quote)[1:])]).withColumn("plan", F.lit("no id"))
    props = good.unionByName(bad).unionByName(none).unionByName(none)
    v = G.verdicts(props, _docs(spark), key_cols=["plan"])
    assert sorted((r["plan"], r["status"], len(r["policy_refs"])) for r in v.collect()) == [
        ("bad", "rejected", 0), ("good", "accepted", 1), ("no id", "accepted", 1), ("no id", "accepted", 1)]
    assert {r["plan"]: r["overall_decision"] for r in G.overall(v, ["plan"]).collect()} == {"bad": "revise", "good": "accept", "no id": "accept"}
    assert {r["plan"] for r in G.accepted_actions(v, False, ["plan"], ["plan"]).collect()} == {"good", "no id"}
    assert G.accepted_actions(v, partial_ok=False).count() == 0
    # G4 goes by the policy's own phrase, whatever the quote says
    kept = G.canonical_refs(props, G.policies_frame(spark), _docs(spark))
    assert sorted((r["plan"], r["policy_refs"][0]["quote"]) for r in kept.collect()) == [
        ("bad", "invented quote"), ("good", quote), ("no id", quote), ("no id", quote)]


def test_masking_flow(spark):
    plan = ('{"proposed_actions":[{"id":"A1","action":"mask_email","params":{"column":"email"},'
            '"policy_refs":[{"source":"rules","quote":" dog sleeps "},{"source":"x","quote":""}],"confidence":"0.8"},'
            '{"id":"A2","action":"drop","params":{"column":"nope"},"policy_refs":[],"confidence":0.1}]}')
    raw = spark.createDataFrame([(1, plan), (2, "no"), (3, '{"proposed_fixes":[]}')], "k int, raw string")
    plans = G.parse_pii_plans(raw)
    assert {r["k"]: r["question"] for r in G.plan_questions(plans, ["k"], pii=True).collect()} == {2: G.PII_QUESTION_NO_PLAN, 3: G.PII_QUESTION_NO_PLAN}
    props = G.plan_fixes(plans, ["k"], "proposed_actions")
    docs = spark.createDataFrame([(1, "a Dog sleeps here")], "doc_id int, text string")
    v = {r["id"]: r for r in G.verdicts(props, docs, columns=["email"], key_cols=["k"], pii=True).collect()}
    assert (v["A1"]["status"], v["A1"]["notes"]) == ("accepted", "Policy quote not found: '...'")
    assert v["A2"]["notes"] == ("Action 'drop' not allowed. ; Column 'nope' not present. ; No valid policy_refs matched. ; "
                                "Low confidence 0.1 < 0.70")
    reasons = G.suggested_changes(G.verdicts(props, docs, columns=["email"], pii=True), pii=True).collect()
    assert [(r["id"], r["reason"]) for r in reasons] == [("A2", v["A2"]["notes"])]


def test_masked_columns_are_compared(spark):
    long = lambda rows: spark.createDataFrame(rows, "column string, metric string, value double")
    before = long([("email", "risk_score", 50.0), ("name", "ner_PERSON", 3.0), ("other", "risk_score", 1.0)])
    assert G.validate_masks(before, long([("email", "risk_score", 0.0), ("other", "risk_score", 9.0)]), ["email", "name"]).first()["accepted"]
    assert not G.validate_masks(before, before, ["email", "name"]).first()["accepted"]
    assert not G.validate_masks(before, long([("email", "risk_score", 60.0)]), ["email", "name"]).first()["accepted"]
