"""Static statistics and cost heuristics over SQL text columns (Q1-Q5, Q7, Q10).

All patterns are plain case-insensitive regular expressions that do not know
about comments or string literals, exactly like the statistics they mirror.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, strip_ws

# Fixed values that must equal the reference's behaviour.
SELECT_STAR_RE = r"(?i)select\s+\*"
JOIN_RE = r"(?i)\bjoin\b"
WINDOW_FN_RE = r"(?i)(row_number|rank|dense_rank|lag|lead)\s*\("
NON_SARGABLE_RE = r"(?i)(DATE\([^)]*\)|CAST\([^)]* AS DATE\))"
SHUFFLE_SHARE_MULTI_JOIN = 0.12
SHUFFLE_SHARE_OTHER = 0.02
LARGE_BUILD_BYTES = 1e9
FENCE_RE = r"(?s)```(.*?)```"


def partition_filter_re(partition_col: str = "event_date") -> str:
    # (?d): only \n ends a line, so ".*" stays on one line as in the original.
    return rf"(?id)(WHERE|AND)\s+.*{re.escape(partition_col)}"


def select_star(sql: Column | str) -> Column:
    return as_col(sql).rlike(SELECT_STAR_RE)


def num_joins(sql: Column | str) -> Column:
    return F.regexp_count(as_col(sql), F.lit(JOIN_RE)).cast("int")


def window_functions(sql: Column | str) -> Column:
    return F.regexp_extract_all(as_col(sql), F.lit(WINDOW_FN_RE), F.lit(1))


def non_sargable_predicates(sql: Column | str) -> Column:
    return F.regexp_extract_all(as_col(sql), F.lit(NON_SARGABLE_RE), F.lit(1))


def partition_filters_used(sql: Column | str, partition_col: str = "event_date") -> Column:
    return as_col(sql).rlike(partition_filter_re(partition_col))


def static_stats(sql: Column | str, partition_col: str = "event_date") -> Column:
    """Q1-Q5 as one struct column."""
    s = as_col(sql)
    return F.struct(
        select_star(s).alias("select_star"),
        num_joins(s).alias("num_joins"),
        window_functions(s).alias("window_functions"),
        non_sargable_predicates(s).alias("non_sargable_predicates"),
        partition_filters_used(s, partition_col).alias("partition_filters_used"),
    )


def heuristics(static_col: Column | str, bytes_col: Column | str) -> Column:
    """Q7: shuffle estimate and join guess from the join count and scanned bytes."""
    st = as_col(static_col)
    b = as_col(bytes_col).cast("double")
    multi = st["num_joins"] > 1
    est = b * F.when(multi, F.lit(SHUFFLE_SHARE_MULTI_JOIN)).otherwise(F.lit(SHUFFLE_SHARE_OTHER))
    return F.struct(
        F.when(multi, F.lit("shuffle")).otherwise(F.lit("broadcast")).alias("join_type"),
        est.cast("bigint").alias("shuffle_bytes"),
        st["partition_filters_used"].alias("partition_pruning"),
        st["partition_filters_used"].alias("cluster_pruning"),
        F.when(est > LARGE_BUILD_BYTES, F.lit("large")).otherwise(F.lit("small")).alias("join_build_size"),
    )


def extract_fence(text: Column | str) -> Column:
    """Q10: first text between triple back-ticks, trimmed; null when none."""
    t = as_col(text)
    return F.when(t.rlike(FENCE_RE), strip_ws(F.regexp_extract(t, FENCE_RE, 1)))
