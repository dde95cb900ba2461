"""Registered queries: sources and sinks (S1-S3, S5-S8), head sample (P7), negatives (V2),
check suite (V4) and the written-policy checks (T2-T6, T8-T11)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import policy_checks as T
from ..operators import profile as P
from ..operators import proposals as G
from ..operators import querylog as QL
from ..operators import signals as S
from ..session import scratch_path
from ..sources import io
from ..sources.tables import fixture, fixture_ctes, read_table
from .fix_queries import F9_SQL, cleaned_customer
from .grounding_queries import _verdict_cte, bench_verdicts
from .mask_queries import _mask_email_sql, _mask_phone_sql
from .profile_queries import DC_COLS, _null_cond
from .registry import register
from .signal_queries import _entity_sql

DC = fixture_ctes("dirty_customer")
DC_SCHEMA = "id bigint, name string, email string, phone string, signup_date string, price double"


@register("s_read_csv", """
SELECT doc_id, concat('a "quoted" cell, with' || chr(10) || 'a line break and c:\\dir\\', ' ', text) AS text,
       CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, source, CASE WHEN doc_id % 5 > 0 THEN n_chars END AS n_chars FROM documents""")
def s_read_csv(spark, sf_dir):
    """Documents written as CSV with quotes, line breaks, backslashes and missing tokens, read back with a schema."""
    df = read_table(spark, sf_dir, "documents")
    awkward = 'a "quoted" cell, with\na line break and c:\\dir\\'
    cells = df.select("doc_id", F.concat(F.lit(awkward), F.lit(" "), "text").alias("text"),
                      F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("NA").alias("lang"), "source",
                      F.when(F.col("doc_id") % 5 > 0, F.col("n_chars").cast("string")).otherwise("null").alias("n_chars"))
    path = scratch_path(spark, "csv")
    io.write_table(cells, path, "csv")
    return io.read_csv(spark, path, df.select("doc_id", "text", "lang", "source", "n_chars").schema)


@register("s_infer_csv", """
SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 > 0 THEN n_chars::DOUBLE END AS n_chars,
       doc_id % 2 = 0 AS is_even, doc_id + 0.5::DOUBLE AS half, n_chars AS signed FROM documents""")
def s_infer_csv(spark, sf_dir):
    """Documents written as untyped CSV cells, read back with the types that their values show."""
    df = read_table(spark, sf_dir, "documents")
    cells = df.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("NA").alias("lang"),
                      F.when(F.col("doc_id") % 5 > 0, F.col("n_chars").cast("string")).otherwise("null").alias("n_chars"),
                      F.when(F.col("doc_id") % 2 == 0, "True").otherwise("False").alias("is_even"),
                      F.concat(F.col("doc_id").cast("string"), F.lit(".5")).alias("half"), F.concat(F.lit(" +"), F.col("n_chars").cast("string")).alias("signed"))
    path = scratch_path(spark, "csv")
    io.write_table(cells, path, "csv")
    return io.read_csv_inferred(spark, path)


@register("s_write_audit_publish", F9_SQL)
def s_write_audit_publish(spark, sf_dir):
    """S3: stage the cleaned table, audit (score improved), publish, read the target back."""
    before = fixture(spark, sf_dir, "dirty_customer")
    after = cleaned_customer(spark, sf_dir)
    root = scratch_path(spark, "wap")

    before_profile = P.profile(before)

    def audit(staged):
        return bool(P.evaluate_profiles(before_profile, P.profile(staged)).first()["improved"])

    res = io.write_audit_publish(after, f"{root}/staging", f"{root}/published", audit, mode="A")
    if not res["published"]:
        raise RuntimeError(res["warning"])
    return spark.read.parquet(f"{root}/published")


def written_verdicts(spark, sf_dir):
    """The verdicts of all plans, computed once; the runs appended below filter them."""
    path = scratch_path(spark, "verdicts")
    bench_verdicts(spark, sf_dir).write.partitionBy("plan_id").parquet(path)
    return spark.read.parquet(path)


@register("s_run_history", f"""WITH {_verdict_cte(False)}
SELECT concat('run-', v.plan_id) AS run_id, 'benchmark' AS dataset, v.id, v.action, "column", confidence, n_matched, status, notes,
       true AS accepted, 'checked' AS validation_notes, NULL::VARCHAR AS question
FROM v JOIN props USING (item_id)""")
def s_run_history(spark, sf_dir):
    """One run per plan appended with its full records (one of them twice, which changes nothing), read back."""
    path, v = scratch_path(spark, "history"), written_verdicts(spark, sf_dir)
    plans = sorted(r["plan_id"] for r in v.select("plan_id").distinct().collect())
    for plan in [*plans, *plans[-1:]]:
        io.append_run(v.where(F.col("plan_id") == plan), path, f"run-{plan}", "benchmark", True, "checked", 0.9)
    back = io.read_history(spark, path)
    return back.select("run_id", "dataset", "id", "action", F.col("params.column").alias("column"), "confidence",
                       F.size("policy_refs").cast("int").alias("n_matched"), "status", "notes", "accepted", "validation_notes", "question")


@register("s_history_summary", f"""WITH {_verdict_cte(False)}
SELECT 'benchmark' AS dataset, action, count(DISTINCT plan_id) AS n_runs, count(*) AS n_proposed,
       count(*) FILTER (WHERE status = 'accepted') AS n_accepted
FROM v GROUP BY action""")
def s_history_summary(spark, sf_dir):
    """Proposals and acceptances per data set and action over all runs."""
    path, v = scratch_path(spark, "history"), written_verdicts(spark, sf_dir)
    for plan in sorted(r["plan_id"] for r in v.select("plan_id").distinct().collect()):
        io.append_run(v.where(F.col("plan_id") == plan), path, plan, "benchmark")
    return io.history_summary(io.read_history(spark, path))


@register("s_query_records", fixture_ctes("query_log") + """
SELECT query_id, original_sql, rewritten_sql, bytes_scanned,
       CAST(len(regexp_extract_all(original_sql, '(?i)\\bjoin\\b')) AS INTEGER) AS joins_before,
       CASE WHEN rewritten_sql IS NOT NULL THEN CAST(len(regexp_extract_all(rewritten_sql, '(?i)\\bjoin\\b')) AS INTEGER) END AS joins_after,
       true AS has_created_at FROM query_log
WHERE NOT coalesce(regexp_replace(original_sql, '^\\s+|\\s+$', '', 'g') = '', true)""")
def s_query_records(spark, sf_dir):
    """Non-blank requests stored with their statistics before and after, line diff and creation time, read back."""
    valid, _ = QL.split_blank(fixture(spark, sf_dir, "query_log"), "original_sql")
    diff = QL.line_diff(valid, "query_id", "original_sql", "rewritten_sql")
    full = QL.compare(valid, "original_sql", "rewritten_sql", "bytes_scanned").join(diff, "query_id")
    path = scratch_path(spark, "query_runs")
    io.append_query_runs(full, path)
    back = spark.read.parquet(path)
    return back.select("query_id", "original_sql", "rewritten_sql", "bytes_scanned",
                       F.col("before_query_text_stats.num_joins").alias("joins_before"),
                       F.col("after_query_text_stats.num_joins").alias("joins_after"), F.col("created_at").isNotNull().alias("has_created_at"))


TYPE_MAP_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE lower(data_type) END"""


#: Columns of the driver tables, for the catalogue's oracle: missing values are counted column by column.
TABLE_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _catalog_sql() -> str:
    counts = "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS name, count(*) AS num_rows, count(*) - count({c}) AS num_missing FROM {t}"
        for t, names in TABLE_COLUMNS.items() for c in names.split())
    return f"""
WITH counts AS ({counts})
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS name, {TYPE_MAP_SQL} AS type,
       CASE WHEN data_type LIKE '%[]' THEN 'REPEATED' ELSE 'NULLABLE' END AS mode,
       CASE {TYPE_MAP_SQL} WHEN 'bigint' THEN 'int64' WHEN 'int' THEN 'int64' WHEN 'double' THEN 'float64'
            WHEN 'float' THEN 'float64' WHEN 'string' THEN 'object' WHEN 'boolean' THEN 'bool'
            WHEN 'timestamp_ntz' THEN 'datetime64[ns]' ELSE 'object' END AS dtype_name,
       CAST(NULL AS VARCHAR) AS description, num_rows, num_missing
FROM information_schema.columns c JOIN counts USING (table_name) WHERE c.column_name = counts.name"""


@register("s_schema_catalog", _catalog_sql())
def s_schema_catalog(spark, sf_dir):
    """Schema catalogue of the driver tables with their row and missing counts."""
    out = None
    for t in TABLE_COLUMNS:
        c = P.schema_catalog(read_table(spark, sf_dir, t), t)
        out = c if out is None else out.unionByName(c)
    return out


@register("p_head_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def p_head_sample(spark, sf_dir):
    """First ten orders by key (a top-k report)."""
    return P.head_sample(read_table(spark, sf_dir, "orders"), ["o_orderkey"], 10)


def _neg_string_sql(expr: str, rel: str) -> str:
    return (f"SELECT CASE WHEN count(*) FILTER (WHERE {expr} IS NOT NULL AND TRY_CAST({expr} AS DOUBLE) IS NULL) > 0 "
            f"THEN 0 ELSE count(*) FILTER (WHERE TRY_CAST({expr} AS DOUBLE) < 0) END FROM {rel}")


@register("v_negative_counts", DC + f"""
SELECT 'customer' AS table_name, 'c_acctbal' AS "column", (SELECT count(*) FILTER (WHERE c_acctbal < 0) FROM customer) AS negative_count
UNION ALL SELECT 'supplier', 's_acctbal', (SELECT count(*) FILTER (WHERE s_acctbal < 0) FROM supplier)
UNION ALL SELECT 'customer', 'c_acctbal_text', ({_neg_string_sql('CAST(c_acctbal AS VARCHAR)', 'customer')})
UNION ALL SELECT 'dirty_customer', 'signup_date', ({_neg_string_sql('signup_date', 'dirty_customer')})""")
def v_negative_counts(spark, sf_dir):
    """V2: negatives on numeric columns, and on text columns (0 when any value is not numeric)."""
    cust = read_table(spark, sf_dir, "customer")
    supp = read_table(spark, sf_dir, "supplier")
    dc = fixture(spark, sf_dir, "dirty_customer")
    ctext = cust.select(F.col("c_acctbal").cast("string").alias("c_acctbal_text"))

    def one(df, table, col):
        return df.agg(P.negative_count_expr(df, col).cast("bigint").alias("negative_count")).select(
            F.lit(table).alias("table_name"), F.lit(col).alias("column"), "negative_count")

    return (one(cust, "customer", "c_acctbal").unionByName(one(supp, "supplier", "s_acctbal"))
            .unionByName(one(ctext, "customer", "c_acctbal_text"))
            .unionByName(one(dc, "dirty_customer", "signup_date")))


def _check_suite_sql():
    parts = ["SELECT 'schema_check' AS \"check\", c AS \"column\", concat('type:', t) AS metric, 1.0::DOUBLE AS value "
             "FROM (VALUES ('id', 'bigint'), ('name', 'string'), ('email', 'string'), ('phone', 'string'), "
             "('signup_date', 'string'), ('price', 'double')) AS s(c, t)"]
    for c in DC_COLS:
        parts.append(f"SELECT 'null_check', '{c}', 'null_count', CAST(count(*) FILTER (WHERE {_null_cond(c)}) AS DOUBLE) "
                     f"FROM dirty_customer")
    parts.append("SELECT 'duplicate_check', NULL, 'dup_rows', CAST(coalesce(sum(n - 1), 0) AS DOUBLE) FROM "
                 "(SELECT *, count(*) AS n FROM dirty_customer GROUP BY ALL) g")
    parts.append("SELECT 'format_check', 'email', 'email_invalid_count', CAST(count(*) FILTER (WHERE NOT coalesce("
                 "regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false)) AS DOUBLE) FROM dirty_customer")
    parts.append("SELECT 'format_check', 'price', 'negative_count', CAST(count(*) FILTER (WHERE price < 0) AS DOUBLE) "
                 "FROM dirty_customer")
    return DC + "\nUNION ALL ".join(parts)


@register("v_check_suite", _check_suite_sql())
def v_check_suite(spark, sf_dir):
    """V4: the data-quality fallback check list over dirty_customer."""
    return T.run_checks(fixture(spark, sf_dir, "dirty_customer"))


def _pii_suite_sql() -> str:
    values = "\n       UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM dirty_customer WHERE {c} IS NOT NULL"
                                        for c in ("name", "email", "phone", "signup_date"))
    rows = ", ".join(f"('{w}', '{c}')" for c, ws in S.DEFAULT_GAZETTEER.items() for w in ws)
    terms = "|".join(re.escape(t) for t in sorted(S.SENSITIVE_TERMS, key=len, reverse=True))
    return DC.rstrip() + f""",
{_entity_sql(values, '"column"', f"(VALUES {rows}) AS gaz(word, class)")}
SELECT 'schema_check' AS "check", c AS "column", concat('type:', t) AS metric, 1.0::DOUBLE AS value
FROM (VALUES ('id', 'bigint'), ('name', 'string'), ('email', 'string'), ('phone', 'string'), ('signup_date', 'string'), ('price', 'double')) AS s(c, t)
UNION ALL SELECT 'ner_check', "column", class, CAST(n AS DOUBLE) FROM ent
UNION ALL SELECT 'email_regex', 'email', 'email_invalid_count', CAST(count(*) FILTER (WHERE NOT coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false)) AS DOUBLE) FROM dirty_customer
UNION ALL SELECT 'phone_regex', 'phone', 'phone_invalid_count', CAST(count(*) FILTER (WHERE NOT coalesce(regexp_matches(regexp_replace(phone, '[\\s().-]', '', 'g'), '^\\+[1-9][0-9]{{6,14}}$'), false)) AS DOUBLE) FROM dirty_customer
UNION ALL SELECT 'sensitive_terms_check', "column", term, CAST(count(*) AS DOUBLE)
FROM (SELECT "column", unnest(regexp_extract_all(lower(value), '\\b({terms})\\b', 1)) AS term FROM v) x GROUP BY ALL"""


@register("v_check_suite_pii", _pii_suite_sql())
def v_check_suite_pii(spark, sf_dir):
    """V4: the masking flow's fallback check list over dirty_customer."""
    return T.run_checks(fixture(spark, sf_dir, "dirty_customer"), T.PII_FALLBACK_CHECKS)


@register("t_policy_checks", DC + """
SELECT 'required_not_null' AS "check", 'email' AS "column", count(*) FILTER (WHERE email IS NULL) AS n FROM dirty_customer
UNION ALL SELECT 'required_not_null', 'phone', count(*) FILTER (WHERE phone IS NULL) FROM dirty_customer
UNION ALL SELECT 'future_date', 'signup_date', count(*) FILTER (WHERE TRY_CAST(signup_date AS DATE) > DATE '2024-01-01') FROM dirty_customer
UNION ALL SELECT 'not_numeric', 'phone', count(*) FILTER (WHERE phone IS NOT NULL AND TRY_CAST(phone AS DOUBLE) IS NULL) FROM dirty_customer
UNION ALL SELECT 'phone_chars', 'phone', count(*) FILTER (WHERE NOT regexp_matches(phone, '^[0-9 ()\\-]+$')) FROM dirty_customer""")
def t_policy_checks(spark, sf_dir):
    """Required fields, future dates, type consistency, phone characters."""
    from ..functions import checks as C

    df = fixture(spark, sf_dir, "dirty_customer")
    req = T.required_nulls(df, ["email", "phone"]).select(F.lit("required_not_null").alias("check"), "column", "n")
    one = df.agg(F.count_if(C.date_in_future("signup_date", "2024-01-01")).alias("f"),
                 F.count_if(C.not_numeric("phone")).alias("t"),
                 F.count_if(~C.phone_chars_ok("phone")).alias("p"))
    rest = one.select(F.inline(F.array(
        F.struct(F.lit("future_date").alias("check"), F.lit("signup_date").alias("column"), F.col("f").cast("bigint").alias("n")),
        F.struct(F.lit("not_numeric").alias("check"), F.lit("phone").alias("column"), F.col("t").cast("bigint").alias("n")),
        F.struct(F.lit("phone_chars").alias("check"), F.lit("phone").alias("column"), F.col("p").cast("bigint").alias("n")))))
    return req.unionByName(rest)


@register("t_duplicate_ids", DC + "SELECT id, count(*) AS n FROM dirty_customer GROUP BY id HAVING count(*) > 1")
def t_duplicate_ids(spark, sf_dir):
    """T5: identifiers occurring more than once."""
    return T.duplicate_ids(fixture(spark, sf_dir, "dirty_customer"))


@register("t_row_flags", DC + """
SELECT id, name, concat_ws(',',
  CASE WHEN NOT coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false) THEN 'email_invalid' END,
  CASE WHEN NOT regexp_matches(phone, '^[0-9 ()\\-]+$') THEN 'phone_chars' END,
  CASE WHEN TRY_CAST(signup_date AS DATE) > DATE '2024-01-01' THEN 'future_date' END,
  CASE WHEN price < 0 THEN 'price_negative' END,
  CASE WHEN email IS NULL THEN 'email_missing' END) AS dq_flags
FROM dirty_customer""")
def t_row_flags(spark, sf_dir):
    """Per-row flags of failed checks."""
    flagged = T.row_flags(fixture(spark, sf_dir, "dirty_customer"), T.default_row_checks("2024-01-01"))
    return flagged.select("id", "name", F.array_join("dq_flags", ",").alias("dq_flags"))


@register("t_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def t_retention(spark, sf_dir):
    """Events within 10 days before 2024-01-31."""
    return T.retention(read_table(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00", 10).select("event_id")


@register("t_forget", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def t_forget(spark, sf_dir):
    """Drop the documents listed for deletion (toxic labels)."""
    subjects = read_table(spark, sf_dir, "labels").where("toxic = 1")
    return T.forget(read_table(spark, sf_dir, "documents"), subjects, "doc_id").select("doc_id")


@register("t_consent", """
WITH c AS (SELECT DISTINCT user_id, 'purchase' AS event_type FROM events WHERE event_type = 'signup')
SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.event_type = e.event_type)""")
def t_consent(spark, sf_dir):
    """Keep purchase events of users who signed up (consent by subject and purpose)."""
    ev = read_table(spark, sf_dir, "events")
    consents = ev.where("event_type = 'signup'").select("user_id", F.lit("purchase").alias("event_type")).distinct()
    return T.consent(ev, consents, ["user_id", "event_type"]).select("event_id")


AUDIT_ACTIONS = [
    {"action": "mask_email", "description": "personal address", "params": {"column": "email"}, "policy_refs": [{"policy_id": "GDPR-4", "quote": "mask"}]},
    {"action": "mask_phone", "params": {"column": "phone"}, "policy_refs": [{"policy_id": "GDPR-4", "quote": "mask"}]},
    {"action": "unknown", "params": {"column": "name"}},
]


@register("t_mask_audit", DC + f"""
SELECT 0 AS step, 'mask_email' AS action, 'email' AS "column", 'personal address' AS reason, 'GDPR-4' AS policy_id, 'mask' AS quote,
       count(*) FILTER (WHERE {_mask_email_sql('email')} IS DISTINCT FROM email) AS rows_changed FROM dirty_customer
UNION ALL
SELECT 1, 'mask_phone', 'phone', NULL, 'GDPR-4', 'mask',
       count(*) FILTER (WHERE {_mask_phone_sql('phone')} IS DISTINCT FROM phone) FROM dirty_customer""")
def t_mask_audit(spark, sf_dir):
    """Audit rows (action, column, policy, rows changed) for a masking action list."""
    return T.mask_audit(fixture(spark, sf_dir, "dirty_customer"), AUDIT_ACTIONS)
