"""Proposals, policy grounding and verdicts.

A proposal row: ``id, action, description, params struct<...>,
policy_refs array<struct<policy_id, quote>>, confidence``.  Grounding looks
quotes up in a document table (the retrieved policy texts) with a
containment join; everything per proposal is a grouped aggregate, so the
proposal table and the document table can both be large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .fixes import FIX_ACTIONS
from .masks import MASK_ACTIONS
from .profile import row_digest
from .textindex import TextIndex
from .textjoin import contains_join, phrases_found

# Fixed values that must equal the reference's behaviour.
# Canonical policy phrases of the data-quality rules text, by policy id.
KNOWN_POLICIES = {
    "RAG-P1": "Emails must follow the pattern: `username@domain.com`",
    "RAG-P2": "Phone numbers should include only valid characters (digits, spaces, dashes, parentheses).",
    "RAG-P3": "Required fields (e.g., email, phone) must not be null.",
    "RAG-P4": "Remove duplicate rows based on unique identifiers (e.g., `id`).",
    "RAG-P5": "Validate that numeric fields have no negative values unless explicitly allowed.",
    "RAG-P6": "Check that dates (e.g., `signup_date`) are not in the future.",
    "RAG-P7": "Null values should be imputed with appropriate defaults or flagged.",
}
CONFIDENCE_THRESHOLD = 0.7
NOTE_EMPTY_QUOTE = "Empty policy quote"
NOTE_NO_MATCH = "No valid policy_refs matched the RAG text."
NOTE_VALIDATED = "Policy validated."
NOTE_SUGGESTION = "Policy grounding missing. Consider asking the user to confirm this fix or provide policy text."
QUESTION_NO_JSON = "LLM did not return valid JSON — rerun?"
QUESTION_NO_GROUNDED_FIX = "No conservative fix could be produced with policy grounding; please advise."
# Texts of the masking flow.
PII_QUESTION_NO_PLAN = "LLM failed or no valid proposals; please advise."
PII_NOTE_NO_MATCH = "No valid policy_refs matched."
REQUIRED_FIX_KEYS = ("id", "description", "action", "params", "policy_refs", "confidence")
JSON_OBJECT_RE = r"(\{[\s\S]*\})"

PARAMS_TYPE = ("struct<subset:array<string>,column:string,strategy:string,value:string,"
               "pattern:string,repl:string,salt:string>")
REF_TYPE = "array<struct<policy_id:string,quote:string>>"
PII_REF_TYPE = "array<struct<source:string,quote:string>>"


def _plan_schema(name: str, ref_type: str) -> str:
    # A confidence may come as a number or as text: it is read as text and cast.
    fix = (f"struct<id:string,action:string,description:string,params:{PARAMS_TYPE},policy_refs:{ref_type},confidence:string>")
    return f"struct<{name}:array<{fix}>,questions_to_user:array<struct<question:string,related_columns:array<string>>>>"


PLAN_SCHEMA = _plan_schema("proposed_fixes", REF_TYPE)
PII_PLAN_SCHEMA = _plan_schema("proposed_actions", PII_REF_TYPE)


def policies_frame(spark: SparkSession, policies: dict[str, str] | None = None) -> DataFrame:
    """The policy table ``(policy_id, phrase)``."""
    items = sorted((policies or KNOWN_POLICIES).items())
    return spark.createDataFrame(items, "policy_id string, phrase string")


# ---------------------------------------------------------------- G10 / G12

def extract_json(raw: Column | str) -> Column:
    """The JSON text of a model answer: whole text, else first ``{`` to last ``}``."""
    r = F.col(raw) if isinstance(raw, str) else raw
    inner = F.regexp_extract(r, JSON_OBJECT_RE, 1)
    return (F.when(F.try_parse_json(r).isNotNull(), r)
            .when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def _has_keys(obj: Column, keys: Sequence[str]) -> Column:
    k = F.json_object_keys(obj)
    return F.coalesce(F.forall(F.array(*[F.lit(x) for x in keys]), lambda x: F.array_contains(k, x)),
                      F.lit(False))


def schema_valid(json_text: Column | str) -> Column:
    """Plan has a ``proposed_fixes`` list whose every fix holds the six keys
    and a ``policy_refs`` list of objects with ``policy_id`` and ``quote``.
    One bad fix invalidates the whole plan."""
    t = F.col(json_text) if isinstance(json_text, str) else json_text
    fixes_txt = F.get_json_object(t, "$.proposed_fixes")
    fixes = F.from_json(fixes_txt, "array<string>")

    def fix_ok(fx: Column) -> Column:
        refs_txt = F.get_json_object(fx, "$.policy_refs")
        refs = F.from_json(refs_txt, "array<string>")
        refs_ok = F.json_array_length(refs_txt).isNotNull() & F.forall(
            refs, lambda r: _has_keys(r, ("policy_id", "quote")))
        return _has_keys(fx, REQUIRED_FIX_KEYS) & F.coalesce(refs_ok, F.lit(False))

    return F.coalesce(
        _has_keys(t, ("proposed_fixes",)) & F.json_array_length(fixes_txt).isNotNull() & F.forall(fixes, fix_ok),
        F.lit(False))


def parse_plans(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """G10 + G12: adds ``json_text``, ``plan`` (typed struct) and ``schema_valid``."""
    out = df.withColumn("json_text", extract_json(raw_col))
    return (out.withColumn("plan", F.from_json("json_text", PLAN_SCHEMA))
            .withColumn("schema_valid", schema_valid("json_text")))


def parse_pii_plans(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """G10 + G12 of the masking flow: a plan is usable when it has ``proposed_actions``."""
    out = df.withColumn("json_text", extract_json(raw_col))
    usable = _has_keys(F.col("json_text"), ("proposed_actions",)) & F.json_array_length(
        F.get_json_object("json_text", "$.proposed_actions")).isNotNull()
    return (out.withColumn("plan", F.from_json("json_text", PII_PLAN_SCHEMA))
            .withColumn("schema_valid", F.coalesce(usable, F.lit(False))))


def plan_fixes(plans: DataFrame, key_cols: Sequence[str], name: str = "proposed_fixes") -> DataFrame:
    """Proposal rows of the schema-valid plans (one row per fix, ``fix_pos`` its place); ``name``: the plan's list."""
    return (plans.where("schema_valid")
            .select(*key_cols, F.posexplode(f"plan.{name}").alias("fix_pos", "fix"))
            .select(*key_cols, "fix_pos", "fix.*")
            .withColumn("confidence", F.col("confidence").try_cast("double")))


def plan_question(pii: bool = False) -> Column:
    """The fallback question of a parsed plan row (null when the plan is usable)."""
    if pii:
        return F.when(~F.col("schema_valid"), F.lit(PII_QUESTION_NO_PLAN))
    return (F.when(F.col("json_text").isNull() | ~F.coalesce(
        F.array_contains(F.json_object_keys("json_text"), "proposed_fixes"), F.lit(False)), F.lit(QUESTION_NO_JSON))
            .when(~F.col("schema_valid"), F.lit(QUESTION_NO_GROUNDED_FIX)))


def plan_questions(plans: DataFrame, key_cols: Sequence[str], pii: bool = False) -> DataFrame:
    """The fallback question of every plan that cannot be used."""
    return (plans.select(*key_cols, plan_question(pii).alias("question"))
            .where(F.col("question").isNotNull())
            .withColumn("related_columns", F.array().cast("array<string>")))


# ---------------------------------------------------------------- G1

def propose(profile_long: DataFrame, rules: DataFrame, policies: DataFrame) -> DataFrame:
    """G1: rules joined to the profile.

    ``rules(rule_id, metric, min_value, action, strategy, value, subset,
    policy_id, confidence)``: a rule fires for each profile row of its metric
    whose value exceeds ``min_value``; ``column`` comes from the profile row.
    The policy's canonical phrase is the quote.
    """
    fired = profile_long.join(rules, "metric").where(F.col("value") > F.col("min_value"))
    fired = fired.join(policies, "policy_id", "left")
    params = F.struct(
        F.col("subset"), F.col("column"), F.col("strategy"), F.col("value_param").alias("value"),
        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("repl"),
        F.lit(None).cast("string").alias("salt"))
    return fired.select(
        F.concat_ws(":", "rule_id", F.coalesce("column", F.lit("table"))).alias("id"),
        "action",
        F.concat(F.col("action"), F.lit(" because "), F.col("metric"), F.lit(" = "),
                 F.col("value").cast("bigint").cast("string")).alias("description"),
        params.alias("params"),
        F.when(F.col("phrase").isNotNull(),
               F.array(F.struct(F.col("policy_id"), F.col("phrase").alias("quote"))))
        .otherwise(F.array().cast(REF_TYPE)).alias("policy_refs"),
        F.col("confidence").cast("double").alias("confidence"),
    )


# ---------------------------------------------------------------- G2 / G4

def _phrases_found(docs: DataFrame | TextIndex, text_col: str, phrases: DataFrame, phrase_col: str, key_cols: list[str]) -> DataFrame:
    if isinstance(docs, TextIndex):
        return docs.phrases_found(phrases, phrase_col, key_cols)
    return phrases_found(docs, text_col, phrases, phrase_col, key_cols)


def policy_inventory(policies: DataFrame, docs: DataFrame | TextIndex, text_col: str = "text",
                     doc_key: str = "doc_id") -> DataFrame:
    """``(doc_id, policy_id)`` for every document containing a policy phrase (case-insensitive).

    Here and below ``docs`` may be a ``TextIndex``: then no text is read, however often texts are asked for phrases.
    """
    if isinstance(docs, TextIndex):
        return docs.find(policies, "phrase", ["policy_id"]).select(F.col("doc").alias(doc_key), "policy_id")
    j = contains_join(docs.select(doc_key, text_col), text_col, policies.select("policy_id", "phrase"), "phrase")
    return j.select(doc_key, "policy_id")


def exploded_refs(props: DataFrame) -> DataFrame:
    """One row per policy reference and distinct proposal row: ``_row, ref_pos, ref`` and the trimmed quote ``q``.

    ``_row`` is a digest of the whole proposal: proposals of several plans may share ids or have none, and rows that
    are equal in every column have the same references and the same verdict.
    """
    return (props.select("_row", F.posexplode("policy_refs").alias("ref_pos", "ref")).distinct()
            .withColumn("q", strip_ws(F.coalesce("ref.quote", F.lit("")))))


def canonical_refs(props: DataFrame, policies: DataFrame, docs: DataFrame | TextIndex, text_col: str = "text") -> DataFrame:
    """Keep references whose policy id is known and whose canonical phrase
    (not the quote) occurs in the documents; ``policy_refs`` is rebuilt in order."""
    present = _phrases_found(docs, text_col, policies, "phrase", ["policy_id"])
    keyed = props.withColumn("_row", row_digest(props))
    refs = exploded_refs(keyed).withColumn("policy_id", F.col("ref.policy_id"))
    kept = refs.join(present, "policy_id", "left_semi")
    agg = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("ref_pos", "ref"))).alias("_r"))
    refs = F.coalesce(F.transform("_r", lambda x: x["ref"]), F.array().cast(props.schema["policy_refs"].dataType))
    return keyed.join(agg, "_row", "left").withColumn("policy_refs", refs).drop("_r", "_row")


# ---------------------------------------------------------------- G3, G5-G8

def verdicts(props: DataFrame, docs: DataFrame | TextIndex, text_col: str = "text",
             columns: Sequence[str] | None = None, allowed_actions: Sequence[str] | None = None,
             threshold: float = CONFIDENCE_THRESHOLD, key_cols: Sequence[str] = (), pii: bool = False) -> DataFrame:
    """Per-proposal verdict: ``key_cols``, ``id``, ``status``, ``notes``, matched ``policy_refs``.

    Checks: allowed action (G6), column exists (G7, when ``columns``),
    confidence (G5, missing = 0.0), each reference's trimmed quote found
    case-insensitively in some document (G3), at least one matched reference.
    Notes come in that order; in the masking flow (``pii``) the references come
    before the confidence and the note texts are that flow's.  ``key_cols``
    (a plan's key, a position) are carried along.
    """
    allowed = allowed_actions if allowed_actions is not None else MASK_ACTIONS if pii else FIX_ACTIONS
    keyed = props.withColumn("_row", row_digest(props))
    refs = exploded_refs(keyed)
    quotes = refs.select("q").where(F.col("q") != "").distinct()
    found = _phrases_found(docs, text_col, quotes, "q", ["q"]).withColumn("found", F.lit(True))
    refs = refs.join(found, "q", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    missing = F.concat(F.lit("Policy quote not found: '" if pii else "Policy quote not found in RAG: '"), F.substring("q", 1, 60), F.lit("...'"))
    note = F.when(~F.col("found"), missing)
    if not pii:
        note = F.when(F.col("q") == "", F.lit(NOTE_EMPTY_QUOTE)).otherwise(note)
    per = refs.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("ref_pos", note.alias("note")))).alias("ref_notes"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("ref_pos", "ref")))).alias("matched"))
    v = keyed.join(per, "_row", "left")
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    column = F.col("params.column")
    checks = [(~F.coalesce(F.col("action").isin(*allowed), F.lit(False)),
               F.concat(F.lit("Action '"), F.coalesce("action", F.lit("None")), F.lit("' not allowed.")))]
    if columns is not None:
        checks.append((column.isNull() | ~F.coalesce(column.isin(*columns), F.lit(False)),
                       F.concat(F.lit("Column '"), F.coalesce(column, F.lit("None")), F.lit("' not present."))))
    low = conf < threshold
    low_note = (F.concat(F.lit("Low confidence "), conf.cast("string"), F.lit(f" < {threshold:.2f}")) if pii else
                F.concat(F.lit("Low confidence ("), conf.cast("string"), F.lit(f") - threshold {threshold}")))
    none = F.array().cast(props.schema["policy_refs"].dataType)
    matched = F.coalesce(F.transform("matched", lambda x: x["ref"]), none)
    no_match = F.size(matched) == 0
    gates = F.array(*[F.when(c, n) for c, n in checks])
    low_notes = F.array(F.when(low, low_note))
    ref_notes = F.concat(F.coalesce(F.transform("ref_notes", lambda x: x["note"]), F.array().cast("array<string>")),
                         F.array(F.when(no_match, F.lit(PII_NOTE_NO_MATCH if pii else NOTE_NO_MATCH))))
    notes = F.filter(F.concat(gates, ref_notes, low_notes) if pii else F.concat(gates, low_notes, ref_notes), lambda x: x.isNotNull())
    rejected = no_match | low
    for c, _ in checks:
        rejected = rejected | c
    return v.select(
        *key_cols, "id", "action", "params", F.coalesce("description", F.lit("")).alias("description"), conf.alias("confidence"),
        F.when(rejected, F.lit("rejected")).otherwise(F.lit("accepted")).alias("status"),
        F.when(F.size(notes) > 0, F.array_join(notes, " ; ")).otherwise(F.lit(NOTE_VALIDATED)).alias("notes"),
        matched.alias("policy_refs"))


def overall(verdict_df: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """``overall_decision, n_proposals, n_rejected``, one row (one per ``key_cols``); no proposals -> accept."""
    return verdict_df.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("n_proposals"),
        F.count_if(F.col("status") == "rejected").alias("n_rejected"),
    ).select(*key_cols, F.when(F.col("n_rejected") > 0, F.lit("revise")).otherwise(F.lit("accept")).alias("overall_decision"),
             "n_proposals", "n_rejected")


def suggested_changes(verdict_df: DataFrame, key_cols: Sequence[str] = (), pii: bool = False) -> DataFrame:
    """One suggestion per rejected proposal; in the masking flow its ``reason`` is the verdict's notes."""
    text = F.col("notes").alias("reason") if pii else F.lit(NOTE_SUGGESTION).alias("note")
    return verdict_df.where(F.col("status") == "rejected").select(*key_cols, "id", text)


# ---------------------------------------------------------------- G7 / G11, F10, G9

def split_known_columns(props: DataFrame, columns: Sequence[str], key_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(proposals on existing columns, one question per other proposal)."""
    col = F.col("params.column")
    known = F.coalesce(col.isin(*columns), F.lit(False)) if columns else F.lit(False)
    kept = props.where(known)
    questions = props.where(~known).select(
        *key_cols, F.concat(F.lit("Column "), F.coalesce(col, F.lit("None")), F.lit(" not found for action "),
                 F.coalesce("id", F.lit("None"))).alias("question"),
        F.array().cast("array<string>").alias("related_columns"))
    return kept, questions


def accepted_actions(verdict_df: DataFrame, partial_ok: bool = True, key_cols: Sequence[str] = (),
                     plan_cols: Sequence[str] = ()) -> DataFrame:
    """``{action, params}`` of accepted proposals.

    ``partial_ok=True`` (data-quality flow): accepted ones even when the plan is
    ``revise``.  ``partial_ok=False`` (masking flow): all proposals of a plan
    (``plan_cols``; without them the whole table is one plan), but only when
    none of it is rejected.  ``key_cols`` are carried along.
    """
    out = [*key_cols, "id", "action", "params"]
    if partial_ok:
        return verdict_df.where(F.col("status") == "accepted").select(*out)
    plan = F.struct(F.lit(0), *plan_cols)
    revised = verdict_df.where(F.col("status") == "rejected").select(plan.alias("_plan")).distinct()
    return verdict_df.withColumn("_plan", plan).join(revised, "_plan", "left_anti").select(*out)


def validate_masks(before_long: DataFrame, after_long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """G9 (masking flow): one row ``accepted, notes, confidence`` from two personal-data profiles.

    Accepted when no masked column still has a greater risk score or entity count than before, and at least one is
    smaller.  A profile metric that is absent counts as 0.
    """
    watched = (F.col("metric") == "risk_score") | F.col("metric").startswith("ner_")
    one = lambda df, sign: df.where(watched & F.col("column").isin(*columns)).select("column", "metric", (F.col("value") * sign).alias("v"))
    change = one(before_long, -1).unionByName(one(after_long, 1)).groupBy("column", "metric").agg(F.sum("v").alias("d"))
    got = change.agg(F.count_if(F.col("d") > 0).alias("worse"), F.count_if(F.col("d") < 0).alias("better"))
    ok = (F.col("worse") == 0) & (F.col("better") > 0)
    return got.select(ok.alias("accepted"), F.when(ok, F.lit("Sensitive signals reduced in the masked columns."))
                      .when(F.col("worse") > 0, F.lit("A masked column shows more sensitive signals than before."))
                      .otherwise(F.lit("No sensitive signal was reduced.")).alias("notes"),
                      F.when(ok, F.lit(0.9)).otherwise(F.lit(0.2)).alias("confidence"))


def validate_results(evaluation: DataFrame, after_profile: DataFrame, policy_active: DataFrame,
                     nonneg_metric: str = "negative_count") -> DataFrame:
    """G9 (data-quality): accepted when the score improved and, if the no-negatives
    policy is present in the texts (``policy_active`` non-empty), no negative value remains.

    Inputs are one-row / long DataFrames; the result is one row
    ``accepted, notes, confidence``.
    """
    neg = after_profile.where(F.col("metric") == nonneg_metric).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("v")).select(F.lit("neg").alias("k"), F.col("v"))
    act = policy_active.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("act").alias("k"), "v")
    imp = evaluation.select(F.lit("imp").alias("k"), F.col("improved").cast("double").alias("v"))
    kv = imp.unionByName(neg).unionByName(act).agg(*[
        F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("imp", "neg", "act")])
    improved = F.col("imp") > 0
    compliant = ~((F.col("act") > 0) & (F.col("neg") > 0))
    ok = improved & compliant
    notes = (F.when(ok, F.lit("Improved and compliant"))
             .when(~compliant, F.lit("Negative price values remain while policy prohibits negatives."))
             .otherwise(F.lit("No improvement detected")))
    return kv.select(ok.alias("accepted"), notes.alias("notes"),
                     F.when(ok, F.lit(0.9)).otherwise(F.lit(0.2)).alias("confidence"))
