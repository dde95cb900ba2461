"""Registered queries: proposals, grounding and verdicts.

Proposals are derived from the driver tables by expression: one proposal per
``benchmark`` item whose first reference quotes the item's whole text (found
in ``documents`` when a document carries the passage) and whose second
reference is blank or a paraphrase.  Documents are the whole ``documents``
table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proposals as G
from ..operators import profile as P
from ..operators.textjoin import phrases_found
from ..sources.tables import fixture, fixture_ctes, read_table
from .fix_queries import F9_SQL, _score_sql, cleaned_customer
from .registry import register

ACTIONS = [*G.FIX_ACTIONS, "truncate_table"]
COLUMNS = ["id", "email", "email", "phone", "price", "nope"]
DC_COLUMNS = ["id", "name", "email", "phone", "signup_date", "price"]


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def bench_proposals(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    k = (F.col("item_id") % 6).cast("int") + 1
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), k)
    column = F.element_at(F.array(*[F.lit(c) for c in COLUMNS]), k)
    params = F.struct(
        F.when(action == "drop_duplicates", F.array(F.lit("id"))).alias("subset"),
        column.alias("column"),
        F.when(action == "impute_nulls", F.lit("constant")).alias("strategy"),
        F.when(action == "impute_nulls", F.lit("")).alias("value"),
        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("repl"),
        F.lit(None).cast("string").alias("salt"))
    second = F.when(F.col("item_id") % 3 == 0, F.lit("   ")).otherwise(F.concat("text", F.lit(" (paraphrased)")))
    refs = F.array(
        F.struct(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("policy_id"), F.col("text").alias("quote")),
        F.struct(F.lit("X").alias("policy_id"), second.alias("quote")))
    return b.select(
        F.col("item_id"), F.concat(F.lit("plan"), (F.col("item_id") % 2).cast("string")).alias("plan_id"),
        F.when(F.col("item_id") % 13 != 5, F.concat(F.lit("F"), F.floor(F.col("item_id") / 2).cast("string"))).alias("id"),
        action.alias("action"), F.lit("d").alias("description"), params.alias("params"), refs.alias("policy_refs"),
        (((F.col("item_id") % 10) * 10 + 5).cast("double") / 100).alias("confidence"))


def bench_policies(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("policy_id"), F.col("text").alias("phrase"))


def bench_verdicts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return G.verdicts(bench_proposals(spark, sf_dir), docs, "text", columns=DC_COLUMNS, key_cols=["plan_id", "item_id"])


def _sq(text: str) -> str:
    return text.replace("'", "''")


PROPS_CTE = f"""props AS (
  SELECT item_id, concat('plan', CAST(item_id % 2 AS VARCHAR)) AS plan_id,
         CASE WHEN item_id % 13 <> 5 THEN concat('F', CAST(item_id // 2 AS VARCHAR)) END AS id, text,
         list_extract({_sql_list(ACTIONS)}, CAST(item_id % 6 AS INTEGER) + 1) AS action,
         list_extract({_sql_list(COLUMNS)}, CAST(item_id % 6 AS INTEGER) + 1) AS col,
         CAST((item_id % 10) * 10 + 5 AS DOUBLE) / 100 AS confidence
  FROM benchmark),
refs AS (
  SELECT item_id, 0 AS ref_pos, concat('B', CAST(item_id AS VARCHAR)) AS policy_id, text AS quote FROM props
  UNION ALL
  SELECT item_id, 1, 'X', CASE WHEN item_id % 3 = 0 THEN '   ' ELSE concat(text, ' (paraphrased)') END FROM props),
r AS (SELECT *, regexp_replace(quote, '^\\s+|\\s+$', '', 'g') AS q FROM refs),
f AS (SELECT r.*, (q <> '' AND EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(r.q)))) AS found
      FROM r),
m AS (SELECT item_id, count(*) FILTER (WHERE found) AS n_matched,
             string_agg(CASE WHEN found THEN policy_id END, ',' ORDER BY ref_pos) AS matched_ids
      FROM f GROUP BY item_id)"""


def _verdict_cte(pii: bool) -> str:
    allowed = G.MASK_ACTIONS if pii else G.FIX_ACTIONS
    low = (f"concat('Low confidence ', CAST(confidence AS VARCHAR), ' < {G.CONFIDENCE_THRESHOLD:.2f}')" if pii else
           f"concat('Low confidence (', CAST(confidence AS VARCHAR), ') - threshold {G.CONFIDENCE_THRESHOLD}')")
    missing = "Policy quote not found: ''" if pii else "Policy quote not found in RAG: ''"
    empty = "" if pii else f"WHEN q = '' THEN '{_sq(G.NOTE_EMPTY_QUOTE)}'"
    low_ord, ref_ord = (5, 2) if pii else (2, 3)
    return f"""{PII_PROPS_CTE if pii else PROPS_CTE},
g AS (SELECT p.*, p.action NOT IN {tuple(allowed)} AS bad_action,
             (p.col IS NULL OR p.col NOT IN {tuple(DC_COLUMNS)}) AS bad_col,
             p.confidence < {G.CONFIDENCE_THRESHOLD} AS low, coalesce(m.n_matched, 0) = 0 AS no_match,
             coalesce(m.n_matched, 0) AS n_matched, m.matched_ids
      FROM props p LEFT JOIN m USING (item_id)),
n AS (
  SELECT item_id, 0 AS ord, 0 AS sub, CASE WHEN bad_action THEN concat('Action ''', action, ''' not allowed.') END AS note FROM g
  UNION ALL SELECT item_id, 1, 0, CASE WHEN bad_col THEN concat('Column ''', coalesce(col, 'None'), ''' not present.') END FROM g
  UNION ALL SELECT item_id, {low_ord}, 0, CASE WHEN low THEN {low} END FROM g
  UNION ALL SELECT item_id, {ref_ord}, ref_pos, CASE {empty} WHEN NOT found THEN concat('{missing}', left(q, 60), '...''') END FROM f
  UNION ALL SELECT item_id, 4, 0, CASE WHEN no_match THEN '{G.PII_NOTE_NO_MATCH if pii else G.NOTE_NO_MATCH}' END FROM g),
v AS (
  SELECT g.item_id, g.plan_id, g.id, g.action, g.col AS "column",
         CASE WHEN bad_action OR bad_col OR low OR no_match THEN 'rejected' ELSE 'accepted' END AS status,
         coalesce((SELECT string_agg(note, ' ; ' ORDER BY ord, sub) FROM n WHERE n.item_id = g.item_id AND note IS NOT NULL),
                  '{G.NOTE_VALIDATED}') AS notes,
         CAST(n_matched AS INTEGER) AS n_matched, coalesce(matched_ids, '') AS matched_policy_ids
  FROM g)"""


#: The masking flow's proposals: as above with its actions, sources instead of policy ids, one plan without a fault.
PII_ACTIONS = list(G.MASK_ACTIONS) + ["drop_table"]
PII_COLUMNS = ["email", "phone", "name", "name", "email", "nope"]
PII_PROPS_CTE = f"""props AS (
  SELECT item_id, CASE WHEN item_id % 6 < 5 AND item_id % 10 >= 7 AND EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))
                       THEN 'clean' ELSE concat('plan', CAST(item_id % 2 AS VARCHAR)) END AS plan_id,
         concat('A', CAST(item_id % 7 AS VARCHAR)) AS id, text,
         list_extract({_sql_list(PII_ACTIONS)}, CAST(item_id % 6 AS INTEGER) + 1) AS action,
         list_extract({_sql_list(PII_COLUMNS)}, CAST(item_id % 6 AS INTEGER) + 1) AS col,
         CAST((item_id % 10) * 10 + 5 AS DOUBLE) / 100 AS confidence
  FROM benchmark b),""" + PROPS_CTE.split("FROM benchmark),", 1)[1]


def _flat_verdicts(v):
    return v.select("plan_id", "item_id", "id", "action", F.col("params.column").alias("column"), "status", "notes",
                    F.size("policy_refs").cast("int").alias("n_matched"),
                    F.array_join(F.transform("policy_refs", lambda x: x["policy_id"]), ",").alias("matched_policy_ids"))


@register("g_verdicts", f"WITH {_verdict_cte(False)}\nSELECT * FROM v")
def g_verdicts(spark, sf_dir):
    """Per-proposal verdicts grounded in the whole document table."""
    return _flat_verdicts(bench_verdicts(spark, sf_dir))


@register("g_overall", f"""WITH {_verdict_cte(False)}
SELECT plan_id, CASE WHEN count(*) FILTER (WHERE status = 'rejected') > 0 THEN 'revise' ELSE 'accept' END AS overall_decision,
       count(*) AS n_proposals, count(*) FILTER (WHERE status = 'rejected') AS n_rejected FROM v GROUP BY plan_id""")
def g_overall(spark, sf_dir):
    """Overall decision."""
    return G.overall(bench_verdicts(spark, sf_dir), ["plan_id"])


@register("g_suggested_changes", f"""WITH {_verdict_cte(False)}
SELECT plan_id, id, '{G.NOTE_SUGGESTION}' AS note FROM v WHERE status = 'rejected'""")
def g_suggested_changes(spark, sf_dir):
    """One suggestion per rejected proposal."""
    return G.suggested_changes(bench_verdicts(spark, sf_dir), ["plan_id"])


@register("f_accepted_actions", f"""WITH {_verdict_cte(False)}
SELECT item_id, id, action, "column" FROM v WHERE status = 'accepted'""")
def f_accepted_actions(spark, sf_dir):
    """accepted actions even when the plan is 'revise' (data-quality flow)."""
    return G.accepted_actions(bench_verdicts(spark, sf_dir), key_cols=["item_id"]).select("item_id", "id", "action", F.col("params.column").alias("column"))


@register("g_policy_inventory", """
SELECT d.doc_id, concat('B', CAST(b.item_id AS VARCHAR)) AS policy_id
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def g_policy_inventory(spark, sf_dir):
    """Which documents contain which policy phrase (whole benchmark texts as phrases)."""
    return G.policy_inventory(bench_policies(spark, sf_dir), read_table(spark, sf_dir, "documents"))


@register("g_canonical_refs", f"""WITH {PROPS_CTE},
present AS (SELECT DISTINCT concat('B', CAST(b.item_id AS VARCHAR)) AS policy_id
            FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text))))
SELECT r.item_id, CAST(r.ref_pos AS INTEGER) AS ref_pos, r.policy_id, r.quote
FROM refs r JOIN present USING (policy_id)""")
def g_canonical_refs(spark, sf_dir):
    """Keep references whose policy is known and whose canonical phrase is in the documents."""
    kept = G.canonical_refs(bench_proposals(spark, sf_dir), bench_policies(spark, sf_dir),
                            read_table(spark, sf_dir, "documents"))
    return kept.select("item_id", F.posexplode("policy_refs").alias("ref_pos", "ref")).select(
        "item_id", F.col("ref_pos").cast("int").alias("ref_pos"), F.col("ref.policy_id").alias("policy_id"),
        F.col("ref.quote").alias("quote"))


@register("g_split_known_columns", f"""WITH {PROPS_CTE}
SELECT item_id, col IN {tuple(DC_COLUMNS)} AS kept,
       CASE WHEN col NOT IN {tuple(DC_COLUMNS)} THEN concat('Column ', col, ' not found for action ', coalesce(id, 'None')) END AS question
FROM props""")
def g_split_known_columns(spark, sf_dir):
    """Proposals on unknown columns become questions."""
    props = bench_proposals(spark, sf_dir)
    kept, questions = G.split_known_columns(props, DC_COLUMNS, ["item_id"])
    return (kept.select("item_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("question"))
            .unionByName(questions.select("item_id", F.lit(False).alias("kept"), "question")))


# ---------------------------------------------------------------- masking flow

def pii_proposals(spark, sf_dir):
    """Proposals of the masking flow; those without a fault make up the plan ``clean``."""
    b = read_table(spark, sf_dir, "benchmark")
    docs = read_table(spark, sf_dir, "documents")
    found = phrases_found(docs, "text", b, "text", ["item_id"]).withColumn("_found", F.lit(True))
    k = (F.col("item_id") % 6).cast("int") + 1
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), k)
    null = F.lit(None).cast("string")
    params = F.struct(F.lit(None).cast("array<string>").alias("subset"), pick(PII_COLUMNS).alias("column"),
                      *[null.alias(x) for x in ("strategy", "value", "pattern", "repl", "salt")])
    second = F.when(F.col("item_id") % 3 == 0, F.lit("   ")).otherwise(F.concat("text", F.lit(" (paraphrased)")))
    refs = F.array(F.struct(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("source"), F.col("text").alias("quote")),
                   F.struct(F.lit("X").alias("source"), second.alias("quote")))
    clean = (F.col("item_id") % 6 < 5) & (F.col("item_id") % 10 >= 7) & F.coalesce("_found", F.lit(False))
    return b.join(found, "item_id", "left").select(
        "item_id", F.when(clean, "clean").otherwise(F.concat(F.lit("plan"), (F.col("item_id") % 2).cast("string"))).alias("plan_id"),
        F.concat(F.lit("A"), (F.col("item_id") % 7).cast("string")).alias("id"), pick(PII_ACTIONS).alias("action"),
        F.lit("d").alias("description"), params.alias("params"), refs.alias("policy_refs"),
        (((F.col("item_id") % 10) * 10 + 5).cast("double") / 100).alias("confidence"))


def pii_verdicts(spark, sf_dir):
    return G.verdicts(pii_proposals(spark, sf_dir), read_table(spark, sf_dir, "documents"), "text", columns=DC_COLUMNS,
                      key_cols=["plan_id", "item_id"], pii=True)


@register("g_pii_verdicts", f"WITH {_verdict_cte(True)}\nSELECT * FROM v")
def g_pii_verdicts(spark, sf_dir):
    """G3, G5-G8 of the masking flow: its gate order, notes and sources."""
    return pii_verdicts(spark, sf_dir).select(
        "plan_id", "item_id", "id", "action", F.col("params.column").alias("column"), "status", "notes",
        F.size("policy_refs").cast("int").alias("n_matched"),
        F.array_join(F.transform("policy_refs", lambda x: x["source"]), ",").alias("matched_policy_ids"))


@register("g_pii_suggested_changes", f"""WITH {_verdict_cte(True)}
SELECT item_id, id, notes AS reason FROM v WHERE status = 'rejected'""")
def g_pii_suggested_changes(spark, sf_dir):
    """G8 of the masking flow: the reason is the verdict's notes."""
    return G.suggested_changes(pii_verdicts(spark, sf_dir), ["item_id"], pii=True)


@register("f_pii_actions", f"""WITH {_verdict_cte(True)}
SELECT plan_id, item_id, action, "column" FROM v WHERE plan_id NOT IN (SELECT plan_id FROM v WHERE status = 'rejected')""")
def f_pii_actions(spark, sf_dir):
    """F10 of the masking flow: all actions of plans in which nothing is rejected."""
    return G.accepted_actions(pii_verdicts(spark, sf_dir), partial_ok=False, key_cols=["plan_id", "item_id"],
                              plan_cols=["plan_id"]).select(
        "plan_id", "item_id", "action", F.col("params.column").alias("column"))


# ---------------------------------------------------------------- G10 / G12 over model-style answers

def conversation_answers(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    fid = F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    params = F.struct(F.lit("email").alias("column"))
    refs = F.array(F.struct(F.concat(F.lit("B"), F.col("turn").cast("string")).alias("policy_id"),
                            F.col("text").alias("quote")))
    conf = ((F.col("turn") % 10) * 10).cast("double") / 100
    full = F.struct(fid.alias("id"), F.lit("normalize_email").alias("action"), F.col("text").alias("description"),
                    params.alias("params"), refs.alias("policy_refs"), conf.alias("confidence"))
    plan = F.to_json(F.struct(F.array(full).alias("proposed_fixes"),
                              F.array().cast("array<string>").alias("questions_to_user")))
    missing_keys = F.to_json(F.struct(F.array(F.struct(fid.alias("id"), F.lit("normalize_email").alias("action")))
                                      .alias("proposed_fixes")))
    flat_refs = F.to_json(F.struct(F.array(F.struct(
        fid.alias("id"), F.lit("normalize_email").alias("action"), F.col("text").alias("description"),
        params.alias("params"), F.array("text").alias("policy_refs"), conf.alias("confidence"))).alias("proposed_fixes")))
    k = F.col("turn") % 5
    raw = (F.when(k == 0, plan).when(k == 1, F.concat(F.lit("Sure: "), plan, F.lit(" bye")))
           .when(k == 2, missing_keys).when(k == 3, F.col("text")).otherwise(flat_refs))
    return c.select("conv_id", "turn", raw.alias("raw"))


ANSWERS_SQL = """
WITH c AS (SELECT conv_id, turn, text, concat('C', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS fid,
                  CAST((turn % 10) * 10 AS DOUBLE) / 100 AS conf FROM conversations),
a AS (
  SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN to_json({'proposed_fixes': [{'id': fid, 'action': 'normalize_email', 'description': text,
                  'params': {'column': 'email'}, 'policy_refs': [{'policy_id': concat('B', CAST(turn AS VARCHAR)), 'quote': text}],
                  'confidence': conf}], 'questions_to_user': []::VARCHAR[]})::VARCHAR
    WHEN 1 THEN concat('Sure: ', to_json({'proposed_fixes': [{'id': fid, 'action': 'normalize_email', 'description': text,
                  'params': {'column': 'email'}, 'policy_refs': [{'policy_id': concat('B', CAST(turn AS VARCHAR)), 'quote': text}],
                  'confidence': conf}], 'questions_to_user': []::VARCHAR[]})::VARCHAR, ' bye')
    WHEN 2 THEN to_json({'proposed_fixes': [{'id': fid, 'action': 'normalize_email'}]})::VARCHAR
    WHEN 3 THEN text
    ELSE to_json({'proposed_fixes': [{'id': fid, 'action': 'normalize_email', 'description': text,
                  'params': {'column': 'email'}, 'policy_refs': [text], 'confidence': conf}]})::VARCHAR END AS raw
  FROM c),
j AS (SELECT conv_id, turn,
             CASE WHEN json_valid(raw) THEN raw
                  WHEN regexp_extract(raw, '(\\{[\\s\\S]*\\})', 1) <> '' AND json_valid(regexp_extract(raw, '(\\{[\\s\\S]*\\})', 1))
                  THEN regexp_extract(raw, '(\\{[\\s\\S]*\\})', 1) END AS js FROM a),
s AS (SELECT conv_id, turn, js,
             coalesce(json_type(js) = 'OBJECT' AND json_type(js, '$.proposed_fixes') = 'ARRAY'
               AND coalesce(list_bool_and(list_transform(json_extract(js, '$.proposed_fixes[*]'),
                     lambda fx: json_type(fx) = 'OBJECT'
                           AND list_has_all(json_keys(fx), ['id', 'description', 'action', 'params', 'policy_refs', 'confidence'])
                           AND json_type(fx, '$.policy_refs') = 'ARRAY'
                           AND coalesce(list_bool_and(list_transform(json_extract(fx, '$.policy_refs[*]'),
                                 lambda r: json_type(r) = 'OBJECT' AND list_has_all(json_keys(r), ['policy_id', 'quote']))), true))), true),
               false) AS schema_valid
      FROM j)
SELECT conv_id, turn, js IS NOT NULL AS has_json, schema_valid,
       CASE WHEN schema_valid THEN CAST(json_array_length(js, '$.proposed_fixes') AS INTEGER) END AS n_fixes,
       CASE WHEN js IS NULL OR NOT coalesce(json_type(js) = 'OBJECT' AND list_contains(json_keys(js), 'proposed_fixes'), false)
            THEN '{QUESTION_NO_JSON}'
            WHEN NOT schema_valid THEN '{QUESTION_NO_GROUNDED_FIX}' END AS question
FROM s"""


@register("g_parse_plans", ANSWERS_SQL.replace("{QUESTION_NO_JSON}", G.QUESTION_NO_JSON).replace("{QUESTION_NO_GROUNDED_FIX}", G.QUESTION_NO_GROUNDED_FIX))
def g_parse_plans(spark, sf_dir):
    """JSON extraction, schema validation and fallback questions."""
    plans = G.parse_plans(conversation_answers(spark, sf_dir), "raw")
    return plans.select(
        "conv_id", "turn", F.col("json_text").isNotNull().alias("has_json"), "schema_valid",
        F.when(F.col("schema_valid"), F.size("plan.proposed_fixes")).cast("int").alias("n_fixes"),
        G.plan_question().alias("question"))


# ---------------------------------------------------------------- G1, G9

RULES = [
    # rule_id, metric, min_value, action, strategy, value, subset, policy_id, confidence
    ("R1", "dup_rows", 0.0, "drop_duplicates", None, None, ["id"], "RAG-P4", 0.9),
    ("R2", "null_count", 0.0, "impute_nulls", "constant", "", None, "RAG-P7", 0.8),
    ("R3", "email_invalid_count", 0.0, "normalize_email", None, None, None, "RAG-P1", 0.75),
    ("R4", "negative_count", 0.0, "remove_negative_values", None, None, None, "RAG-P5", 0.9),
]


def rules_frame(spark):
    return spark.createDataFrame(
        RULES, "rule_id string, metric string, min_value double, action string, strategy string, "
               "value_param string, subset array<string>, policy_id string, confidence double")


def _rules_sql():
    rows = ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, '{r[3]}', '{r[7]}', CAST({r[8]} AS DOUBLE))" for r in RULES)
    return f"(VALUES {rows}) AS rules(rule_id, metric, min_value, action, policy_id, confidence)"


def _policies_sql():
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(G.KNOWN_POLICIES.items()))
    return f"(VALUES {rows}) AS pol(policy_id, phrase)"


def _g1_oracle():
    from .profile_queries import _profile_oracle

    prof = _profile_oracle()
    return (f"""WITH prof AS ({prof})
SELECT concat(rule_id, ':', coalesce(prof."column", 'table')) AS id, rules.action, prof."column" AS "column",
       rules.policy_id, pol.phrase AS quote, rules.confidence
FROM prof JOIN {_rules_sql()} ON prof.metric = rules.metric
LEFT JOIN {_policies_sql()} ON rules.policy_id = pol.policy_id
WHERE prof.value > rules.min_value""")


@register("g_propose", _g1_oracle())
def g_propose(spark, sf_dir):
    """G1: rule table joined to the profile of dirty_customer."""
    prof = P.profile(fixture(spark, sf_dir, "dirty_customer"))
    props = G.propose(prof, rules_frame(spark), G.policies_frame(spark))
    return props.select("id", "action", F.col("params.column").alias("column"),
                        F.col("policy_refs")[0]["policy_id"].alias("policy_id"),
                        F.col("policy_refs")[0]["quote"].alias("quote"), "confidence")


G9_SQL = F9_SQL.replace("\nSELECT id, name, coalesce(email, '') AS email",
                        ", after_t AS (\nSELECT id, name, coalesce(email, '') AS email", 1) + f"""),
ev AS (SELECT {_score_sql('dirty_customer')} AS b, {_score_sql('after_t')} AS a),
act AS (SELECT count(*) AS n FROM documents WHERE contains(lower(text), lower('{G.KNOWN_POLICIES["RAG-P5"]}'))),
neg AS (SELECT count(*) FILTER (WHERE price < 0) AS n FROM after_t)
SELECT (ev.a < ev.b) AND NOT (act.n > 0 AND neg.n > 0) AS accepted,
       CASE WHEN (ev.a < ev.b) AND NOT (act.n > 0 AND neg.n > 0) THEN 'Improved and compliant'
            WHEN act.n > 0 AND neg.n > 0 THEN 'Negative price values remain while policy prohibits negatives.'
            ELSE 'No improvement detected' END AS notes,
       CAST(CASE WHEN (ev.a < ev.b) AND NOT (act.n > 0 AND neg.n > 0) THEN 0.9 ELSE 0.2 END AS DOUBLE) AS confidence
FROM ev, act, neg"""


@register("g_validate_results", G9_SQL)
def g_validate_results(spark, sf_dir):
    """Post-execution validation of the cleaned table."""
    before = fixture(spark, sf_dir, "dirty_customer")
    after = cleaned_customer(spark, sf_dir)
    after_profile = P.profile(after)
    ev = P.evaluate_profiles(P.profile(before), after_profile)
    p5 = G.policies_frame(spark, {"RAG-P5": G.KNOWN_POLICIES["RAG-P5"]})
    active = G.policy_inventory(p5, read_table(spark, sf_dir, "documents"))
    return G.validate_results(ev, after_profile, active)
