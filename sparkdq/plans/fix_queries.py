"""Registered queries: repair actions and before/after evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixes as FX
from ..operators import profile as P
from ..sources.tables import fixture, fixture_ctes
from .registry import register

COLS = "id, name, email, phone, signup_date, price"
DC = fixture_ctes("dirty_customer")

# The plan recorded as accepted by the reference's only accepted DQ run.
ACCEPTED_PLAN = [
    {"action": "drop_duplicates", "params": {"subset": ["id"]}},
    {"action": "impute_nulls", "params": {"column": "email", "strategy": "constant", "value": ""}},
    {"action": "remove_negative_values", "params": {"column": "price"}},
]
ORDER = ["name"]


def _dc(spark, sf_dir):
    return fixture(spark, sf_dir, "dirty_customer")


def _round_price(df):
    return df.withColumn("price", F.round("price", 6))


@register("f_drop_duplicates_all", DC + "SELECT DISTINCT * FROM dirty_customer")
def f_drop_duplicates_all(spark, sf_dir):
    """full-row distinct."""
    return FX.drop_duplicates(_dc(spark, sf_dir))


F2_SQL = DC + f"""
SELECT {COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY name NULLS FIRST, email NULLS FIRST,
         phone NULLS FIRST, signup_date NULLS FIRST, price NULLS FIRST) AS rn
  FROM dirty_customer) t
WHERE rn = 1"""


@register("f_drop_duplicates_subset", F2_SQL)
def f_drop_duplicates_subset(spark, sf_dir):
    """one row per id, first by name."""
    return FX.drop_duplicates(_dc(spark, sf_dir), ["id", "no_such_column"], ORDER)


@register("f_impute_mean", DC + """
SELECT id, name, email, phone, signup_date,
       round(coalesce(price, (SELECT avg(price) FROM dirty_customer)), 6) AS price
FROM dirty_customer""")
def f_impute_mean(spark, sf_dir):
    """missing price -> mean of present prices."""
    return _round_price(FX.impute_nulls(_dc(spark, sf_dir), "price", "mean"))


@register("f_impute_median", DC + """
SELECT id, name, email, phone, signup_date,
       round(coalesce(price, (SELECT median(price) FROM dirty_customer)), 6) AS price
FROM dirty_customer""")
def f_impute_median(spark, sf_dir):
    """missing price -> exact median of present prices."""
    return _round_price(FX.impute_nulls(_dc(spark, sf_dir), "price", "median"))


@register("f_impute_constant", DC + """
SELECT id, name, coalesce(email, '') AS email, coalesce(phone, 'unknown') AS phone, signup_date, price
FROM dirty_customer""")
def f_impute_constant(spark, sf_dir):
    """constant fill; mean asked on a text column falls back to the constant."""
    df = FX.impute_nulls(_dc(spark, sf_dir), "email")
    return FX.impute_nulls(df, "phone", "mean", "unknown")


@register("f_normalize_email", DC + """
SELECT id, name, lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g')) AS email, phone, signup_date, price
FROM dirty_customer""")
def f_normalize_email(spark, sf_dir):
    """trim white space and lower-case e-mails."""
    return FX.normalize_email(_dc(spark, sf_dir))


@register("f_regex_clean", DC + """
SELECT id, name, email, regexp_replace(phone, '[^0-9+]', '', 'g') AS phone,
       regexp_replace(signup_date, '([0-9]{4})-([0-9]{2})-([0-9]{2})', '\\3/\\2/\\1', 'g') AS signup_date, price
FROM dirty_customer""")
def f_regex_clean(spark, sf_dir):
    """strip phone separators; reorder dates with Python-style group references."""
    df = FX.regex_clean(_dc(spark, sf_dir), "phone", "[^0-9+]")
    return FX.regex_clean(df, "signup_date", r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"\3/\2/\g<1>")


@register("f_remove_negative", DC + """
SELECT id, name, email, phone, signup_date, CASE WHEN price < 0 THEN NULL ELSE price END AS price
FROM dirty_customer""")
def f_remove_negative(spark, sf_dir):
    """F8: negative price -> null."""
    return FX.remove_negative_values(_dc(spark, sf_dir), "price")


F9_SQL = DC + f""", dedup AS (
  SELECT {COLS} FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY name NULLS FIRST, email NULLS FIRST,
           phone NULLS FIRST, signup_date NULLS FIRST, price NULLS FIRST) AS rn
    FROM dirty_customer) t WHERE rn = 1)
SELECT id, name, coalesce(email, '') AS email, phone, signup_date,
       CASE WHEN price < 0 THEN NULL ELSE price END AS price
FROM dedup"""


def cleaned_customer(spark, sf_dir):
    return FX.apply_fixes(_dc(spark, sf_dir), ACCEPTED_PLAN + [{"action": "no_such_action"}], ORDER)


@register("f_apply_fixes", F9_SQL)
def f_apply_fixes(spark, sf_dir):
    """the accepted three-action plan (plus an unknown action that is skipped)."""
    return cleaned_customer(spark, sf_dir)


def _score_sql(rel: str) -> str:
    return (f"(SELECT count(*) FILTER (WHERE NOT coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+'), false))"
            f" + count(*) FILTER (WHERE price < 0)"
            f" + (SELECT coalesce(sum(n - 1), 0) FROM (SELECT *, count(*) AS n FROM {rel} GROUP BY ALL) g)"
            f" FROM {rel})")


EVAL_SQL = F9_SQL.replace("\nSELECT id, name, coalesce(email, '') AS email", ", after_t AS (\nSELECT id, name, coalesce(email, '') AS email", 1) + f""")
SELECT CAST({_score_sql('dirty_customer')} AS BIGINT) AS before_score,
       CAST({_score_sql('after_t')} AS BIGINT) AS after_score,
       CAST({_score_sql('after_t')} AS BIGINT) < CAST({_score_sql('dirty_customer')} AS BIGINT) AS improved"""


@register("p_evaluate", EVAL_SQL)
def p_evaluate(spark, sf_dir):
    """Quality score before and after the accepted plan."""
    return P.evaluate(_dc(spark, sf_dir), cleaned_customer(spark, sf_dir))
