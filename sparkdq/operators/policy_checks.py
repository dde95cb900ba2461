"""Checks that exist only as written policy (T1-T11) and the named check suite (V4)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import checks as C
from ..sources.io import write_table
from . import profile as P
from .masks import mask_expr
from .util import col


def required_nulls(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``(column, n)`` missing values of each required column (one scan)."""
    cols = [c for c in required if c in df.columns]
    one = df.agg(*[F.count_if(P.missing(df, c)).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("n"))
                                          for c in cols])))


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """T5: identifiers that occur more than once, ``(id, n)``."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def row_flags(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``dq_flags`` array of the names of the checks a row fails (null check = pass)."""
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("dq_flags", flags)


def quarantine(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows with at least one flag)."""
    bad = F.size("dq_flags") > 0
    return flagged.where(~bad), flagged.where(bad)


def default_row_checks(as_of: str = "2024-01-01") -> dict[str, Column]:
    return {
        "email_invalid": ~C.email_valid("email"),
        "phone_chars": ~C.phone_chars_ok("phone"),
        "future_date": C.date_in_future("signup_date", as_of),
        "price_negative": F.col("price") < 0,
        "email_missing": F.col("email").isNull(),
    }


def retention(df: DataFrame, ts_col: str, as_of: str, days: int, keep_missing: bool = False) -> DataFrame:
    """Keep rows not older than ``days`` before ``as_of`` (a fixed instant, for repeatability).

    Rows without a time can't be shown to be recent: they go, unless ``keep_missing``.
    """
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    recent = F.col(ts_col) >= cutoff
    return df.where(recent | F.col(ts_col).isNull() if keep_missing else recent)


def forget(df: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Drop every row of a listed subject (anti join)."""
    return df.join(subjects.select(key).distinct(), key, "left_anti")


def consent(df: DataFrame, consents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep rows whose (subject, purpose) has consent (semi join)."""
    return df.join(consents.select(*keys), list(keys), "left_semi")


def mask_audit(df: DataFrame, actions: Iterable[Mapping]) -> DataFrame:
    """One audit row per applied masking action with the rows it changed.

    ``(step, action, column, reason, policy_id, quote, rows_changed)``: the
    reason is the action's description; all counts come from one aggregate over
    the staged projections.
    """
    staged, steps = _masked_with_marks(df, actions)
    if not steps:
        return _audit_rows(df, steps, {})
    one = staged.agg(*[F.count_if(F.col(f"_s{s[0]}_chg")).alias(f"c{s[0]}") for s in steps])
    return one.select(F.inline(F.array(*[_audit_row(s, F.col(f"c{s[0]}")) for s in steps])))


def mask_and_audit(df: DataFrame, actions: Iterable[Mapping], path: str, fmt: str = "parquet") -> DataFrame:
    """T11 while masking (M6): write the masked table to ``path`` and return its audit rows (``mask_audit``), counted by the
    writing tasks, so the input is read once."""
    staged, steps = _masked_with_marks(df, actions)
    seen = Observation()
    if steps:
        staged = staged.observe(seen, *[F.count_if(F.col(f"_s{s[0]}_chg")).alias(f"c{s[0]}") for s in steps])
    write_table(staged.select(*[col(c) for c in df.columns]), path, fmt)
    return _audit_rows(df, steps, seen.get if steps else {})


def _masked_with_marks(df: DataFrame, actions: Iterable[Mapping]) -> tuple[DataFrame, list[tuple]]:
    """The masked table with a mark per step in rows that it changed, and the steps."""
    staged = df
    steps = []
    for i, a in enumerate(actions):
        p = dict(a.get("params") or {})
        c = p.get("column")
        if not c or c not in df.columns:
            continue
        e = mask_expr(a.get("action"), c, p)
        if e is None:
            continue
        prev = f"_s{i}_prev"
        staged = staged.withColumn(prev, F.col(c).cast("string")).withColumn(c, e)
        refs = a.get("policy_refs") or [{}]
        steps.append((i, a.get("action"), c, refs[0].get("policy_id", refs[0].get("source")), refs[0].get("quote"), a.get("description")))
        staged = staged.withColumn(f"_s{i}_chg", ~F.col(c).eqNullSafe(F.col(prev)))
    return staged, steps


AUDIT_SCHEMA = "step int, action string, column string, reason string, policy_id string, quote string, rows_changed bigint"


def _audit_row(s: tuple, n: Column) -> Column:
    return F.struct(F.lit(s[0]).alias("step"), F.lit(s[1]).alias("action"), F.lit(s[2]).alias("column"),
                    F.lit(s[5]).cast("string").alias("reason"), F.lit(s[3]).cast("string").alias("policy_id"), F.lit(s[4]).cast("string").alias("quote"),
                    n.cast("bigint").alias("rows_changed"))


def _audit_rows(df: DataFrame, steps: list[tuple], counts: Mapping[str, int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(s[0], s[1], s[2], s[5], s[3], s[4], counts[f"c{s[0]}"]) for s in steps], AUDIT_SCHEMA)


# ---------------------------------------------------------------- V4

DQ_FALLBACK_CHECKS = ("schema_check", "null_check", "duplicate_check", "format_check")
PII_FALLBACK_CHECKS = ("schema_check", "ner_check", "email_regex", "phone_regex", "sensitive_terms_check")
CHECK_ROW_SCHEMA = "check string, column string, metric string, value double"


def run_checks(df: DataFrame, names: Sequence[str] = DQ_FALLBACK_CHECKS, email_cols=("email",),
               nonneg_cols=("price",), phone_cols=("phone",)) -> DataFrame:
    """V4: union of the named checks as ``(check, column, metric, value)`` rows.

    schema_check: one row per column (metric ``type:<type>``); null_check: null
    counts; duplicate_check: duplicate rows; format_check: invalid e-mails and
    negatives; email_regex / phone_regex: invalid e-mails / phones; ner_check:
    entity counts; sensitive_terms_check: sensitive-term hits per column.
    Unknown names are ignored.
    """
    from . import signals as S

    spark = df.sparkSession
    parts = []
    prof_metrics = {
        "null_check": ["null_count"], "duplicate_check": ["dup_rows"],
        "format_check": ["email_invalid_count", "negative_count"],
        "email_regex": ["email_invalid_count"], "phone_regex": ["phone_invalid_count"],
    }
    wanted = [n for n in names if n in prof_metrics]
    if wanted:
        prof = P.profile(df, email_cols, nonneg_cols, phone_cols, include_null_percent=False,
                         include_dups="duplicate_check" in names)
        for n in wanted:
            parts.append(prof.where(F.col("metric").isin(*prof_metrics[n])).select(
                F.lit(n).alias("check"), "column", "metric", "value"))
    if "schema_check" in names:
        rows = [("schema_check", f.name, f"type:{f.dataType.simpleString()}", 1.0) for f in df.schema.fields]
        parts.append(spark.createDataFrame(rows, CHECK_ROW_SCHEMA))
    if "ner_check" in names:
        parts.append(S.entity_counts(df).select(F.lit("ner_check").alias("check"), "column",
                                                F.col("class").alias("metric"), F.col("n").cast("double").alias("value")))
    if "sensitive_terms_check" in names:
        vals = S.unpivot_strings(df)
        parts.append(S.term_hits(vals, "value", ["column"]).select(
            F.lit("sensitive_terms_check").alias("check"), "column", F.col("term").alias("metric"),
            F.col("n").cast("double").alias("value")))
    if not parts:
        return spark.createDataFrame([], CHECK_ROW_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
