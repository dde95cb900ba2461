"""Registered queries: query-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import querylog as QF
from ..operators import linediff as LD
from ..operators import querylog as QL
from ..sources.tables import fixture, fixture_ctes, read_table
from .registry import register

QLOG = fixture_ctes("query_log")

STATIC_SQL = """
  coalesce(regexp_matches({s}, '(?i)select\\s+\\*'), false) AS select_star,
  CAST(len(regexp_extract_all({s}, '(?i)\\bjoin\\b')) AS INTEGER) AS num_joins,
  array_to_string(regexp_extract_all({s}, '(?i)(row_number|rank|dense_rank|lag|lead)\\s*\\(', 1), '|') AS window_functions,
  array_to_string(regexp_extract_all({s}, '(?i)(DATE\\([^)]*\\)|CAST\\([^)]* AS DATE\\))', 1), '|') AS non_sargable_predicates,
  coalesce(regexp_matches({s}, '(?i)(WHERE|AND)\\s+.*event_date'), false) AS partition_filters_used"""


def _flat_static(df, sql_col):
    st = QF.static_stats(sql_col)
    return df.select(
        "query_id",
        st["select_star"].alias("select_star"),
        st["num_joins"].alias("num_joins"),
        F.array_join(st["window_functions"], "|").alias("window_functions"),
        F.array_join(st["non_sargable_predicates"], "|").alias("non_sargable_predicates"),
        st["partition_filters_used"].alias("partition_filters_used"),
    )


@register("q_static_stats", QLOG + "SELECT query_id," + STATIC_SQL.format(s="original_sql") + " FROM query_log")
def q_static_stats(spark, sf_dir):
    """Q1-Q5 over every logged query."""
    return _flat_static(fixture(spark, sf_dir, "query_log"), "original_sql")


HEUR_SQL = QLOG + """, s AS (
  SELECT query_id, bytes_scanned,
         len(regexp_extract_all(original_sql, '(?i)\\bjoin\\b')) AS nj,
         coalesce(regexp_matches(original_sql, '(?i)(WHERE|AND)\\s+.*event_date'), false) AS pf
  FROM query_log)
SELECT query_id, bytes_scanned,
       CASE WHEN nj > 1 THEN 'shuffle' ELSE 'broadcast' END AS join_type,
       CAST(trunc(CAST(bytes_scanned AS DOUBLE) * CASE WHEN nj > 1 THEN 0.12::DOUBLE ELSE 0.02::DOUBLE END) AS BIGINT) AS shuffle_bytes,
       pf AS partition_pruning, pf AS cluster_pruning,
       CASE WHEN CAST(bytes_scanned AS DOUBLE) * CASE WHEN nj > 1 THEN 0.12::DOUBLE ELSE 0.02::DOUBLE END > 1e9
            THEN 'large' ELSE 'small' END AS join_build_size
FROM s"""


@register("q_heuristics", HEUR_SQL)
def q_heuristics(spark, sf_dir):
    """Q6 (scan bytes as an input column) and Q7 cost heuristics."""
    df = QL.report(fixture(spark, sf_dir, "query_log"), "original_sql", "bytes_scanned")
    return df.select("query_id", "bytes_scanned", "report.plan_stats.*")


REPORT_SQL = QLOG + ", st AS (SELECT query_id, original_sql, bytes_scanned, rows_read, slot_ms," + STATIC_SQL.format(s="original_sql") + """ FROM query_log)
SELECT query_id, bytes_scanned, rows_read, slot_ms, select_star, num_joins, window_functions, non_sargable_predicates, partition_filters_used,
       CASE WHEN num_joins > 1 THEN 'shuffle' ELSE 'broadcast' END AS join_type, partition_filters_used AS partition_pruning
FROM st"""


@register("q_report", REPORT_SQL)
def q_report(spark, sf_dir):
    """Q8: the whole report of every query: text statistics, scan figures (Q6) and plan statistics."""
    df = QL.report(fixture(spark, sf_dir, "query_log"), "original_sql", "bytes_scanned", ("bytes_scanned", "rows_read", "slot_ms"))
    st = F.col("report.query_text_stats")
    return df.select("query_id", "report.scan_stats.*", st["select_star"].alias("select_star"), st["num_joins"].alias("num_joins"),
                     F.array_join(st["window_functions"], "|").alias("window_functions"),
                     F.array_join(st["non_sargable_predicates"], "|").alias("non_sargable_predicates"),
                     st["partition_filters_used"].alias("partition_filters_used"),
                     F.col("report.plan_stats.join_type").alias("join_type"), F.col("report.plan_stats.partition_pruning").alias("partition_pruning"))


COMPARE_SQL = QLOG + """, s AS (
  SELECT query_id, bytes_scanned, rewritten_sql,
         len(regexp_extract_all(original_sql, '(?i)\\bjoin\\b')) AS jb,
         CASE WHEN rewritten_sql IS NOT NULL THEN len(regexp_extract_all(rewritten_sql, '(?i)\\bjoin\\b')) END AS ja,
         coalesce(regexp_matches(original_sql, '(?i)select\\s+\\*'), false) AS sb,
         CASE WHEN rewritten_sql IS NOT NULL THEN coalesce(regexp_matches(rewritten_sql, '(?i)select\\s+\\*'), false) END AS sa
  FROM query_log)
SELECT query_id, sb AS select_star_before, sa AS select_star_after,
       CAST(jb AS INTEGER) AS num_joins_before, CAST(ja AS INTEGER) AS num_joins_after,
       CAST(trunc(CAST(bytes_scanned AS DOUBLE) * CASE WHEN jb > 1 THEN 0.12::DOUBLE ELSE 0.02::DOUBLE END) AS BIGINT) AS shuffle_bytes_before,
       CASE WHEN rewritten_sql IS NOT NULL THEN CAST(trunc(CAST(bytes_scanned AS DOUBLE) * CASE WHEN ja > 1 THEN 0.12::DOUBLE ELSE 0.02::DOUBLE END) AS BIGINT) END AS shuffle_bytes_after,
       CAST(ja - jb AS INTEGER) AS delta_num_joins
FROM s"""


@register("q_compare", COMPARE_SQL)
def q_compare(spark, sf_dir):
    """Q9: original vs rewritten statistics; a missing rewrite gives nulls."""
    df = QL.compare(fixture(spark, sf_dir, "query_log"), "original_sql", "rewritten_sql", "bytes_scanned")
    return df.select(
        "query_id",
        F.col("before_query_text_stats.select_star").alias("select_star_before"),
        F.col("after_query_text_stats.select_star").alias("select_star_after"),
        F.col("before_query_text_stats.num_joins").alias("num_joins_before"),
        F.col("after_query_text_stats.num_joins").alias("num_joins_after"),
        F.col("before_plan_stats.shuffle_bytes").alias("shuffle_bytes_before"),
        F.col("after_plan_stats.shuffle_bytes").alias("shuffle_bytes_after"),
        F.col("delta_num_joins").cast("int").alias("delta_num_joins"),
    )


LINES_SQL = QLOG + """, l AS (
  SELECT query_id, unnest(string_split(regexp_replace(original_sql, '(\\r\\n|[\\n\\r])$', ''), chr(10))) AS line, -1 AS d
  FROM query_log WHERE original_sql IS NOT NULL AND rewritten_sql IS NOT NULL
  UNION ALL
  SELECT query_id, unnest(string_split(regexp_replace(rewritten_sql, '(\\r\\n|[\\n\\r])$', ''), chr(10))) AS line, 1 AS d
  FROM query_log WHERE original_sql IS NOT NULL AND rewritten_sql IS NOT NULL)
SELECT query_id, line, CAST(sum(d) AS INTEGER) AS delta FROM l GROUP BY query_id, line HAVING sum(d) <> 0"""


@register("q_line_changes", LINES_SQL)
def q_line_changes(spark, sf_dir):
    """Q11 detail: multiset line difference per query."""
    return QL.line_changes(fixture(spark, sf_dir, "query_log"), "query_id", "original_sql", "rewritten_sql")


DIFF_SQL = LINES_SQL.replace("SELECT query_id, line, CAST(sum(d) AS INTEGER) AS delta FROM l GROUP BY query_id, line HAVING sum(d) <> 0",
                             """, c AS (SELECT query_id, line, sum(d) AS delta FROM l GROUP BY query_id, line HAVING sum(d) <> 0),
agg AS (SELECT query_id, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS a,
               sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS r FROM c GROUP BY query_id)
SELECT q.query_id,
       CASE WHEN q.rewritten_sql IS NOT NULL AND q.original_sql IS NOT NULL THEN CAST(coalesce(a, 0) AS INTEGER) END AS lines_added,
       CASE WHEN q.rewritten_sql IS NOT NULL AND q.original_sql IS NOT NULL THEN CAST(coalesce(r, 0) AS INTEGER) END AS lines_removed
FROM query_log q LEFT JOIN agg ON q.query_id = agg.query_id""")


@register("q_line_diff", DIFF_SQL)
def q_line_diff(spark, sf_dir):
    """Q11 summary: lines added / removed per query (null without a rewrite)."""
    return QL.line_diff(fixture(spark, sf_dir, "query_log"), "query_id", "original_sql", "rewritten_sql")


@register("q_diff_hunks")
def q_diff_hunks(spark, sf_dir):
    """Q11: unified hunks of every rewritten query (a shortest script has no SQL form; the tests hold it against brute force)."""
    return LD.diff_hunks(fixture(spark, sf_dir, "query_log"), "query_id", "original_sql", "rewritten_sql")


@register("s_split_blank", QLOG + """
SELECT query_id, CASE WHEN coalesce(regexp_replace(original_sql, '^\\s+|\\s+$', '', 'g') = '', true)
                      THEN 'rejected' ELSE 'valid' END AS status
FROM query_log""")
def s_split_blank(spark, sf_dir):
    """Blank SQL goes to the rejects side."""
    valid, rejects = QL.split_blank(fixture(spark, sf_dir, "query_log"), "original_sql")
    return valid.select("query_id", F.lit("valid").alias("status")).unionByName(
        rejects.select("query_id", F.lit("rejected").alias("status")))


FENCED_SQL = """
SELECT conv_id, turn,
       CASE WHEN role = 'assistant' THEN concat('Here is the rewrite:', chr(10), '```sql', chr(10), text, chr(10), '```', chr(10), 'Done.')
            WHEN role = 'user' THEN concat('``` ', text)
            ELSE text END AS raw
FROM conversations"""


@register("q_extract_fence", "WITH fenced AS (" + FENCED_SQL + """)
SELECT conv_id, turn,
       CASE WHEN regexp_matches(raw, '```(.*?)```', 's')
            THEN regexp_replace(regexp_extract(raw, '```(.*?)```', 1, 's'), '^\\s+|\\s+$', '', 'g') END AS extracted
FROM fenced""")
def q_extract_fence(spark, sf_dir):
    """Q10: fenced block of a model answer (language tag kept); none -> null."""
    read_table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(FENCED_SQL).select("conv_id", "turn", QF.extract_fence("raw").alias("extracted"))


REVIEW_LEVELS = "('low', 'medium', 'high', 'very_high', 'extreme')"


@register("q_validate_reviews", """
WITH r AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'system' THEN text
              ELSE to_json({'recommendations': [text], 'risk_flags': [role],
                            'sql_quality_score': length(text) % 120,
                            'complexity': list_extract(['low', 'medium', 'high', 'very_high', 'extreme'], CAST(turn % 5 AS INTEGER) + 1)})::VARCHAR
         END AS review
  FROM conversations),
j AS (SELECT conv_id, turn, CASE WHEN json_valid(review) AND starts_with(ltrim(review), '{') THEN review END AS js FROM r)
SELECT conv_id, turn,
       CAST(json_array_length(js, '$.recommendations') AS INTEGER) AS n_recommendations,
       CAST(json_extract(js, '$.sql_quality_score') AS DOUBLE) AS sql_quality_score,
       json_extract_string(js, '$.complexity') AS complexity,
       coalesce(js IS NOT NULL AND json_type(js, '$.recommendations') = 'ARRAY' AND json_type(js, '$.risk_flags') = 'ARRAY'
                AND CAST(json_extract(js, '$.sql_quality_score') AS DOUBLE) BETWEEN 0 AND 100
                AND json_extract_string(js, '$.complexity') IN ('low', 'medium', 'high', 'very_high'), false) AS review_valid
FROM j""")
def q_validate_reviews(spark, sf_dir):
    """Q12: review JSON shape check (arrays present, score 0..100, known complexity)."""
    conv = read_table(spark, sf_dir, "conversations")
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "very_high", "extreme")])
    review = F.when(F.col("role") == "system", F.col("text")).otherwise(F.to_json(F.struct(
        F.array("text").alias("recommendations"), F.array("role").alias("risk_flags"),
        (F.length("text") % 120).alias("sql_quality_score"),
        F.element_at(levels, (F.col("turn") % 5).cast("int") + 1).alias("complexity"))))
    df = QL.validate_reviews(conv.select("conv_id", "turn", review.alias("review")), "review")
    return df.select("conv_id", "turn",
                     F.size("review_parsed.recommendations").cast("int").alias("n_recommendations"),
                     F.col("review_parsed.sql_quality_score").alias("sql_quality_score"),
                     F.col("review_parsed.complexity").alias("complexity"), "review_valid")
