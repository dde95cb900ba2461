"""Registered queries: whole flows around the checks - comparison of profiles (P11), validation of masking (G9), quarantine
(T6), audit log (T11), publish modes (S3), ingest of files (S4), nested history (S6), repeated saves (S7) and grounding
over a positional index (G2-G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy_checks as T
from ..operators import profile as P
from ..operators import proposals as G
from ..operators import querylog as QL
from ..operators import retrieval as R
from ..operators.masks import apply_masks
from ..operators.textindex import TextIndex
from ..operators.util import exact_sum, narrowed
from ..session import scratch_path
from ..sources import io
from ..sources.tables import fixture, fixture_ctes, read_table
from .fix_queries import F9_SQL, _score_sql, cleaned_customer
from .grounding_queries import DC_COLUMNS, PROPS_CTE, _flat_verdicts, _verdict_cte, bench_policies, bench_proposals
from .mask_queries import _mask_email_sql, _mask_phone_sql
from .profile_queries import _pii_sql, _profile_sql
from .registry import register
from .source_queries import AUDIT_ACTIONS

DC = fixture_ctes("dirty_customer")
#: The cleaned table as one more common table expression, ``after_t``.
AFTER_CTE = F9_SQL.replace("\nSELECT id, name, coalesce(email, '') AS email", ", after_t AS (\nSELECT id, name, coalesce(email, '') AS email", 1) + ")\n"


@register("p_compare", AFTER_CTE + f"""
SELECT coalesce(b."column", a."column") AS "column", coalesce(b.metric, a.metric) AS metric, b.value AS "before", a.value AS "after"
FROM ({_profile_sql('dirty_customer')}) b FULL JOIN ({_profile_sql('after_t')}) a
ON b."column" IS NOT DISTINCT FROM a."column" AND b.metric = a.metric""")
def p_compare(spark, sf_dir):
    """P11 in detail: every metric of the profile before and after the accepted plan."""
    return P.compare_profiles(P.profile(fixture(spark, sf_dir, "dirty_customer")), P.profile(cleaned_customer(spark, sf_dir)))


MASKS = [{"action": "hash_name", "params": {"column": "name"}}, {"action": "mask_email", "params": {"column": "email"}},
         {"action": "mask_phone", "params": {"column": "phone"}}, {"action": "redact_address", "params": {"column": "signup_date"}}]
MASKED_CTE = DC.rstrip() + f""", masked AS (
  SELECT id, substr(sha256(name), 1, 12) AS name, {_mask_email_sql('email')} AS email, {_mask_phone_sql('phone')} AS phone,
         CASE WHEN signup_date IS NULL OR regexp_matches(signup_date, '^\\s*$') THEN signup_date ELSE '[REDACTED]' END AS signup_date, price
  FROM dirty_customer)
"""


@register("g_validate_masks", MASKED_CTE + f"""
SELECT worse = 0 AND better > 0 AS accepted,
       CASE WHEN worse = 0 AND better > 0 THEN 'Sensitive signals reduced in the masked columns.'
            WHEN worse > 0 THEN 'A masked column shows more sensitive signals than before.'
            ELSE 'No sensitive signal was reduced.' END AS notes,
       CAST(CASE WHEN worse = 0 AND better > 0 THEN 0.9 ELSE 0.2 END AS DOUBLE) AS confidence
FROM (SELECT count(*) FILTER (WHERE d > 0) AS worse, count(*) FILTER (WHERE d < 0) AS better FROM (
  SELECT "column", metric, sum(v) AS d FROM (
    SELECT "column", metric, -value AS v FROM ({_pii_sql('dirty_customer')}) b UNION ALL SELECT "column", metric, value FROM ({_pii_sql('masked')}) a) s
  WHERE (metric = 'risk_score' OR starts_with(metric, 'ner_')) AND "column" IN ('name', 'email', 'phone', 'signup_date') GROUP BY ALL) t) u""")
def g_validate_masks(spark, sf_dir):
    """G9 of the masking flow: personal-data profiles before and after masking compared on the masked columns."""
    before = fixture(spark, sf_dir, "dirty_customer")
    return G.validate_masks(P.profile_pii(before), P.profile_pii(apply_masks(before, MASKS)), [m["params"]["column"] for m in MASKS])


@register("t_quarantine", DC + """
SELECT id, name, email, phone, signup_date, price,
       CASE WHEN coalesce(NOT coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false), false)
              OR coalesce(NOT regexp_matches(phone, '^[0-9 ()\\-]+$'), false)
              OR coalesce(TRY_CAST(signup_date AS DATE) > DATE '2024-01-01', false) OR coalesce(price < 0, false) OR email IS NULL
            THEN 'quarantine' ELSE 'clean' END AS went_to
FROM dirty_customer""")
def t_quarantine(spark, sf_dir):
    """Flagged rows and clean rows written to folders of their own, read back."""
    flagged = T.row_flags(fixture(spark, sf_dir, "dirty_customer"), T.default_row_checks("2024-01-01"))
    root, out = scratch_path(spark, "quarantine"), None
    for name, rows in zip(("clean", "quarantine"), T.quarantine(flagged)):
        io.write_table(rows, f"{root}/{name}")
        part = spark.read.parquet(f"{root}/{name}").drop("dq_flags").withColumn("went_to", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("t_audit_log", DC + f"""
SELECT run_id, 'dirty_customer' AS dataset, step, action, "column", rows_changed FROM (
  SELECT 0 AS step, 'mask_email' AS action, 'email' AS "column",
         count(*) FILTER (WHERE {_mask_email_sql('email')} IS DISTINCT FROM email) AS rows_changed FROM dirty_customer
  UNION ALL SELECT 1, 'mask_phone', 'phone', count(*) FILTER (WHERE {_mask_phone_sql('phone')} IS DISTINCT FROM phone) FROM dirty_customer) a,
  (VALUES ('audit-1'), ('audit-2')) AS r(run_id)""")
def t_audit_log(spark, sf_dir):
    """Audit rows of two runs appended (the second one twice, which changes nothing), read back."""
    path, df = scratch_path(spark, "audit"), fixture(spark, sf_dir, "dirty_customer")
    for run in ("audit-1", "audit-2", "audit-2"):
        io.append_audit(T.mask_audit(df, AUDIT_ACTIONS), path, run, "dirty_customer")
    return io.read_history(spark, path).select("run_id", "dataset", "step", "action", "column", "rows_changed")


@register("s_publish_modes", AFTER_CTE + f""", s AS (SELECT {_score_sql('dirty_customer')} AS b, {_score_sql('after_t')} AS a,
  (SELECT count(*) FROM dirty_customer) AS nb, (SELECT count(*) FROM after_t) AS na)
SELECT 'B' AS mode, CAST(a < b AS BOOLEAN) AS published, CAST(2 AS INTEGER) AS attempts, a < b AS audit_passed, CASE WHEN a < b THEN na END AS num_rows,
       CASE WHEN a < b THEN CAST(a AS BIGINT) END AS score FROM s
UNION ALL SELECT 'C', true, 1, false, nb, CAST(b AS BIGINT) FROM s""")
def s_publish_modes(spark, sf_dir):
    """S3: mode B publishes the second candidate after the unchanged table failed its audit, mode C publishes with a warning."""
    before, root = fixture(spark, sf_dir, "dirty_customer"), scratch_path(spark, "wap")
    base = P.profile(before)

    def audit(staged):
        return bool(P.evaluate_profiles(base, P.profile(staged)).first()["improved"])

    out = None
    for mode in "BC":
        target = f"{root}/{mode}/published"
        r = io.write_audit_publish(before, f"{root}/{mode}/staging", target, audit, mode=mode, max_retries=1,
                                   repropose=lambda df, attempt: cleaned_customer(spark, sf_dir))
        told = [F.lit(mode).alias("mode"), F.lit(r["published"]).alias("published"), F.lit(r["attempts"]).alias("attempts"), F.lit(r["audit_passed"]).alias("audit_passed")]
        prof = P.profile(spark.read.parquet(target)) if r["published"] else base.where("false")
        row = prof.agg(F.max(F.when(F.col("metric") == "num_rows", F.col("value"))).cast("bigint").alias("num_rows"),
                       F.sum(F.when(F.col("metric").isin(*P.SCORE_METRICS), F.col("value"))).cast("bigint").alias("score")).select(*told, "num_rows", "score")
        out = row if out is None else out.unionByName(row)
    return out


@register("s_ingest_files", """
SELECT item_id, concat('v1 ', text) AS text, 'first' AS batch FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT item_id, concat('v2 ', text), 'second' FROM benchmark WHERE item_id % 2 = 1""")
def s_ingest_files(spark, sf_dir):
    """Whole files read as documents and appended to a store: known ids stay as they are, a repeated batch changes nothing."""
    root, store = scratch_path(spark, "files"), scratch_path(spark, "store")
    items = read_table(spark, sf_dir, "benchmark")

    def files(version, rows):
        path = f"{root}/{version}"
        rows.select("item_id", F.concat(F.lit(f"{version} "), "text").alias("text")).write.partitionBy("item_id").text(path)
        read = R.read_documents(spark, path)  # Spark ends every file with a line break
        return read.select(F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))

    R.append_documents(files("v1", items.where("item_id % 2 = 0")), store, "first", key="item_id")
    every = files("v2", items)
    for _ in range(2):
        R.append_documents(every, store, "second", key="item_id")
    return spark.read.parquet(store).select("item_id", "text", "batch")


@register("s_nested_history", f"""WITH {PROPS_CTE}
SELECT item_id AS run_ts, plan_id AS dataset, item_id % 2 = 0 AS accepted, id, action, col AS "column", confidence, 2 AS n_refs, text AS quote FROM props""")
def s_nested_history(spark, sf_dir):
    """Nested run histories, one document per line, read with a schema and flattened to one row per proposal."""
    refs = F.struct("id", "action", "description", F.struct("params.subset", "params.column", "params.strategy", "params.value").alias("params"),
                    "policy_refs", "confidence")
    run = F.struct(F.col("plan_id").alias("dataset"), F.col("item_id").alias("timestamp"), F.struct(F.array(refs).alias("proposed_fixes")).alias("plan"),
                   F.struct((F.col("item_id") % 2 == 0).alias("accepted")).alias("post_validation"))
    path = scratch_path(spark, "nested")
    bench_proposals(spark, sf_dir).select(F.to_json(F.struct(F.array(run).alias("fix_history"))).alias("value")).write.text(path)
    runs = io.explode_runs(io.read_nested_history(spark, path, one_per_line=True))
    return runs.select("run_ts", "dataset", "accepted", "id", "action", F.col("params.column").alias("column"), "confidence",
                       F.size("policy_refs").cast("int").alias("n_refs"), F.col("policy_refs")[0]["quote"].alias("quote"))


@register("s_query_batches", fixture_ctes("query_log") + """
SELECT query_id % 2 AS batch, count(*) AS n, sum(bytes_scanned)::BIGINT AS bytes_scanned, true AS saved FROM query_log
WHERE NOT coalesce(regexp_replace(original_sql, '^\\s+|\\s+$', '', 'g') = '', true) GROUP BY ALL""")
def s_query_batches(spark, sf_dir):
    """Query records saved in two batches, one of them twice; nothing is stored twice."""
    # The total is counted beyond 64 bits; it is bigint, as in the SQL, unless it does not fit one.
    valid, _ = QL.split_blank(fixture(spark, sf_dir, "query_log"), "original_sql")
    records = valid.select("query_id", "original_sql", "rewritten_sql", "bytes_scanned", "rows_read", "slot_ms")
    path = scratch_path(spark, "query_batches")
    errors = [io.try_append_query_runs(records.where(F.col("query_id") % 2 == k), path, str(k)) for k in (0, 1, 1)]
    totals = spark.read.parquet(path).groupBy(F.col("batch").cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum("bytes_scanned").alias("bytes_scanned")).withColumn("saved", F.lit(not any(errors)))
    told = scratch_path(spark, "query_batch_totals")
    totals.write.parquet(told)  # one row per batch
    return narrowed(spark.read.schema(totals.schema).parquet(told), "bytes_scanned")


def bench_index(spark, sf_dir) -> TextIndex:
    """All documents in a positional index, added in two batches."""
    index, docs = TextIndex(spark, scratch_path(spark, "index")), read_table(spark, sf_dir, "documents")
    index.add(docs.where(F.col("doc_id") % 2 == 0), "even")
    index.add(docs.where(F.col("doc_id") % 2 != 0), "odd")
    return index


@register("g_index_inventory", """
SELECT d.doc_id, concat('B', CAST(b.item_id AS VARCHAR)) AS policy_id
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def g_index_inventory(spark, sf_dir):
    """G2 over a positional index: no text is read when the phrases are looked up."""
    return G.policy_inventory(bench_policies(spark, sf_dir), bench_index(spark, sf_dir))


@register("g_index_verdicts", f"""WITH {_verdict_cte(False)},
present AS (SELECT DISTINCT concat('B', CAST(b.item_id AS VARCHAR)) AS policy_id
            FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))),
k AS (SELECT item_id, count(*) AS n_kept FROM refs JOIN present USING (policy_id) GROUP BY item_id)
SELECT v.*, CAST(coalesce(k.n_kept, 0) AS INTEGER) AS n_canonical FROM v LEFT JOIN k USING (item_id)""")
def g_index_verdicts(spark, sf_dir):
    """G3-G8 over one positional index: two rounds of grounding, by quotes and by canonical phrases."""
    index, props = bench_index(spark, sf_dir), bench_proposals(spark, sf_dir)
    v = _flat_verdicts(G.verdicts(props, index, columns=DC_COLUMNS, key_cols=["plan_id", "item_id"]))
    kept = G.canonical_refs(props, bench_policies(spark, sf_dir), index)
    return v.join(kept.select("item_id", F.size("policy_refs").cast("int").alias("n_canonical")), "item_id", "left")
