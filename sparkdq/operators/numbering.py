"""Phone numbers against a numbering plan (V3): longest prefix, country and length.

The plan is a table ``prefix, country, min_digits, max_digits``: digits after the ``+`` that begin a number, and how many
digits may follow them.  The longest prefix of the plan that begins a number decides, also when its lengths don't fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import PHONE_E164_RE, PHONE_STRIP_RE
from .util import col

MAX_PREFIX = 7  # an E.164 country code and destination code together; longer plan rows are refused


def digits(c: Column) -> Column:
    """The digits of an international number, separators removed; null for any other text."""
    plain = F.regexp_replace(c.cast("string"), PHONE_STRIP_RE, "")
    return F.when(plain.rlike(PHONE_E164_RE), F.substr(plain, F.lit(2)))


def match_plan(df: DataFrame, column: str, plan: DataFrame) -> DataFrame:
    """``df`` with ``plan_prefix``, ``plan_country`` and ``plan_ok``.

    ``plan_ok`` is false for a missing value, a text that is no international number, a number without a prefix in the
    plan, and one whose length fits no row of its longest prefix; it is never null.  ``plan_country`` is the country of
    the first fitting row of that prefix in alphabetic order, else of its first row.  Plan rows without a prefix are
    ignored; repeated rows change nothing.

    One equi-join per prefix length that the plan has (at most ``MAX_PREFIX``, the only thing the driver sees), so no row
    is multiplied and nothing is sorted; the plan's side has at most one row per prefix.
    """
    row = F.struct("country", F.col("min_digits").cast("int").alias("low"), F.col("max_digits").cast("int").alias("high"))
    by_prefix = plan.where(F.col("prefix").isNotNull()).groupBy(F.col("prefix").cast("string").alias("prefix")).agg(F.sort_array(F.collect_set(row)).alias("rows"))
    lengths = sorted((r["n"] for r in by_prefix.groupBy(F.length("prefix").alias("n")).count().collect()), reverse=True)
    if lengths and (lengths[0] > MAX_PREFIX or lengths[-1] < 1):
        raise ValueError(f"prefixes must have 1 to {MAX_PREFIX} digits, the plan has lengths {lengths}")
    out = df.withColumn("_digits", digits(col(column)))
    for n in lengths:
        side = by_prefix.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("rows").alias(f"_r{n}"))
        # A number has more digits than any prefix, so the beginning is always n long.
        out = out.join(side, F.substring("_digits", 1, n) == F.col(f"_p{n}"), "left")
    none = F.lit(None)
    prefix = F.coalesce(*[F.col(f"_p{n}") for n in lengths], none.cast("string"))
    rows = F.coalesce(*[F.col(f"_r{n}") for n in lengths], none.cast("array<struct<country:string,low:int,high:int>>"))
    rest = F.length("_digits") - F.length("_prefix")
    fitting = F.filter("_rows", lambda r: rest.between(r["low"], r["high"]))
    out = out.withColumns({"_prefix": prefix, "_rows": rows}).withColumn("_fit", fitting)
    return out.select(*[col(c) for c in df.columns], F.col("_prefix").alias("plan_prefix"),
                      F.coalesce(F.get(F.col("_fit"), F.lit(0)), F.get(F.col("_rows"), F.lit(0)))["country"].alias("plan_country"),
                      F.coalesce(F.size("_fit") > 0, F.lit(False)).alias("plan_ok"))


def plan_invalid_count(df: DataFrame, column: str, plan: DataFrame) -> DataFrame:
    """V3: ``column, metric, value``, the number of values that the plan doesn't allow."""
    return match_plan(df, column, plan).agg(F.count_if(~F.col("plan_ok")).cast("double").alias("value")).select(
        F.lit(column).alias("column"), F.lit("phone_invalid_count").alias("metric"), "value")
