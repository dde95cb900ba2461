"""Registered queries: tables that grow by batches (P4-P8, T5, F4), numbering plans (V3), figures counted while writing
(S3, T11) and subjects removed from stored tables (T9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbering as N
from ..operators import policy_checks as T
from ..operators.batches import KeyStore, ProfileHistory, distinct_counts, quantile, rank_error
from ..operators.masks import apply_masks
from ..operators.stored import forget_stored, retain_stored
from ..session import scratch_path
from ..sources import io
from ..sources.tables import fixture, fixture_ctes, read_table
from .mask_queries import _mask_email_sql, _mask_phone_sql
from .profile_queries import _profile_sql
from .registry import register
from .source_queries import AUDIT_ACTIONS

DC = fixture_ctes("dirty_customer")


def dirty_batches(spark, sf_dir):
    """``dirty_customer`` as it came in: the table, its exact copies, its near copies."""
    fixture(spark, sf_dir, "dirty_customer")
    near = "SELECT id, concat(name, ' II') AS name, email, phone, signup_date, price FROM dc_base WHERE id % 23 = 0"
    return {"table": spark.table("dc_base"), "copies": spark.sql("SELECT * FROM dc_base WHERE id % 10 = 0"), "near": spark.sql(near)}


@register("p_profile_batches", DC + f"""SELECT * FROM ({_profile_sql('dirty_customer')}) p
UNION ALL SELECT 'price', 'median_in_bound', 1.0 UNION ALL SELECT 'id', 'distinct_in_bound', 1.0""")
def p_profile_batches(spark, sf_dir):
    """The profile of three batches, one of them added twice, from their states and digests; the merged
    sketches' median and distinct count are compared with the whole table."""
    history = ProfileHistory(spark, scratch_path(spark, "history"))
    for name, rows in dirty_batches(spark, sf_dir).items():
        history.add(rows, name)
    history.add(dirty_batches(spark, sf_dir)["copies"], "copies")
    whole, state = fixture(spark, sf_dir, "dirty_customer"), history.state()
    median = quantile(state, "price").scalar()
    there = F.count("price")
    off = F.greatest(F.count_if(F.col("price") < median) - there / 2, there / 2 - F.count_if(F.col("price") <= median))
    near = distinct_counts(state).where("column = 'id'").select("n_distinct").scalar()
    facts = whole.agg(F.array(
        F.struct(F.lit("price").alias("column"), F.lit("median_in_bound").alias("metric"), (off <= there * rank_error(800)).cast("double").alias("value")),
        F.struct(F.lit("id").alias("column"), F.lit("distinct_in_bound").alias("metric"),
                 (F.abs(near / F.count_distinct("id") - 1) < 0.04).cast("double").alias("value"))).alias("f"))
    return history.profile().unionByName(facts.select(F.inline("f")))


@register("t_duplicate_ids_batches", DC + """
SELECT 'stored' AS what, id, count(*) AS n, CAST(NULL AS BIGINT) AS n_stored FROM dirty_customer GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'near', b.id, 1, (SELECT count(*) FROM dc_base x WHERE x.id = b.id) + CASE WHEN b.id % 10 = 0 THEN 1 ELSE 0 END
FROM dc_base b WHERE b.id % 23 = 0""")
def t_duplicate_ids_batches(spark, sf_dir):
    """T5 across batches: which ids of the last batch are known already, then the ids that occur more than once in all."""
    store, batches = KeyStore(spark, scratch_path(spark, "ids")), dirty_batches(spark, sf_dir)
    for name in ("table", "copies"):
        store.add(batches[name], name, ["id"])
    path = scratch_path(spark, "known")
    store.known(batches["near"], ["id"]).write.parquet(path)
    store.add(batches["near"], "near", ["id"])
    return store.repeated().select(F.lit("stored").alias("what"), "id", "n", F.lit(None).cast("bigint").alias("n_stored")).unionByName(
        spark.read.parquet(path).select(F.lit("near").alias("what"), "id", "n", "n_stored"))


PLAN_SQL = """SELECT concat(CAST(n_nationkey + 10 AS STRING)) AS prefix, n_name AS country, 7 AS min_digits, 9 AS max_digits FROM nation
UNION ALL SELECT concat(CAST(n_nationkey + 10 AS STRING), '00'), concat(n_name, ' mobile'), 6, 6 FROM nation WHERE n_regionkey <> 2"""
CALLS_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN concat('555-', CAST(c_custkey AS STRING))
  ELSE concat('+', CAST(c_nationkey + 10 + c_custkey % 3 * 5 AS STRING), ' (', CAST(c_custkey % 4 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END, ') ',
              lpad(CAST(c_custkey AS STRING), CAST(6 + c_custkey % 5 AS INT), '0')) END AS phone FROM customer"""


@register("v_phone_plan", f"""WITH plan AS ({PLAN_SQL}), calls AS ({CALLS_SQL}),
d AS (SELECT id, phone, CASE WHEN regexp_matches(regexp_replace(phone, '[\\s().-]', '', 'g'), '^\\+[1-9][0-9]{{6,14}}$')
      THEN substr(regexp_replace(phone, '[\\s().-]', '', 'g'), 2) END AS digits FROM calls),
m AS (SELECT d.*, p.* FROM d LEFT JOIN plan p ON starts_with(d.digits, p.prefix)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(p.prefix) DESC NULLS LAST) = 1)
SELECT id, phone, prefix AS plan_prefix, country AS plan_country,
       coalesce(length(digits) - length(prefix) BETWEEN min_digits AND max_digits, false) AS plan_ok FROM m""")
def v_phone_plan(spark, sf_dir):
    """V3 by numbering plan: prefixes and lengths made from ``nation``, a number for every customer."""
    for name in ("nation", "customer"):
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    return N.match_plan(spark.sql(CALLS_SQL), "phone", spark.sql(PLAN_SQL))


@register("s_publish_observed", DC + f"""
SELECT 'email' AS "column", 'rows_changed' AS metric, count(*) FILTER (WHERE {_mask_email_sql('email')} IS DISTINCT FROM email) AS value FROM dirty_customer
UNION ALL SELECT 'phone', 'rows_changed', count(*) FILTER (WHERE {_mask_phone_sql('phone')} IS DISTINCT FROM phone) FROM dirty_customer
UNION ALL SELECT NULL, 'num_rows', count(*) FROM dirty_customer UNION ALL SELECT NULL, 'published_rows', count(*) FROM dirty_customer
UNION ALL SELECT 'email', 'null_count', count(*) FILTER (WHERE email IS NULL) FROM dirty_customer
UNION ALL SELECT 'price', 'negative_count', count(*) FILTER (WHERE price < 0) FROM dirty_customer""")
def s_publish_observed(spark, sf_dir):
    """Audit rows of masking, and the figures a publication is judged by, counted while the tables are written."""
    df, root = fixture(spark, sf_dir, "dirty_customer"), scratch_path(spark, "observed")
    audit = T.mask_and_audit(df, AUDIT_ACTIONS, f"{root}/masked")
    metrics = {"num_rows": F.count(F.lit(1)), "email_null": F.count_if(F.col("email").isNull()), "negative": F.count_if(F.col("price") < 0)}
    told = io.write_audit_publish(apply_masks(df, AUDIT_ACTIONS), f"{root}/staging", f"{root}/published", lambda m: m["num_rows"] > 0, mode="A", metrics=metrics)["metrics"]
    facts = [(None, "num_rows", told["num_rows"]), ("email", "null_count", told["email_null"]), ("price", "negative_count", told["negative"])]
    published = spark.read.parquet(f"{root}/published").agg(F.count(F.lit(1)).alias("value"))
    return (audit.select("column", F.lit("rows_changed").alias("metric"), F.col("rows_changed").alias("value"))
            .unionByName(spark.createDataFrame(facts, "column string, metric string, value bigint"))
            .unionByName(published.select(F.lit(None).cast("string").alias("column"), F.lit("published_rows").alias("metric"), "value")))


@register("t_forget_stored", """
SELECT event_id, user_id, event_type, ts FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.event_id % 7 = 0)
  AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS""")
def t_forget_stored(spark, sf_dir):
    """T9, T8 on a stored table: users who signed up under a listed event are removed, then old rows; only files with such rows
    are written again, and a second run finds none."""
    events, path = read_table(spark, sf_dir, "events"), scratch_path(spark, "stored")
    events.select("event_id", "user_id", "event_type", "ts").write.partitionBy("event_type").parquet(path)
    subjects = events.where("event_type = 'signup' AND event_id % 7 = 0")
    last = str(events.agg(F.max("ts").cast("timestamp_ntz").cast("string")).first()[0])
    for _ in range(2):
        told = [forget_stored(spark, path, subjects, "user_id", ["event_type"]), retain_stored(spark, path, "ts", last, 10, partition_by=["event_type"])]
    if any(t["rewritten"] for t in told):
        raise RuntimeError("removed rows were found again")
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "ts")
