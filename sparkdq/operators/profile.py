"""Whole-table profiling (P1-P11, V1-V3) in long form.

``profile`` returns one row per (column, metric): ``column`` is null for
table-level metrics.  Every additive metric comes from a single aggregate over
one scan; the duplicate-row count is one extra grouped aggregate whose partial
(map-side) step collapses repeated rows before the shuffle, so a hot row value
never lands in one task as many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import email_valid, phone_ok
from .util import col

# Metrics that make up the quality score (P10): the invalid kinds plus duplicates.
SCORE_METRICS = ("email_invalid_count", "negative_count", "phone_invalid_count", "dup_rows")

# pandas dtype names for the schema report.
PANDAS_DTYPE = {
    "bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64",
    "double": "float64", "float": "float64", "string": "object", "boolean": "bool",
    "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "object",
}

LONG_SCHEMA = "column string, metric string, value double"


def _is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def missing(df: DataFrame, c: str) -> Column:
    """Missing as pandas sees it: null, or NaN for floating columns."""
    x = col(c)
    if _is_fractional(df.schema[c].dataType):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def negative_count_expr(df: DataFrame, c: str, strict: bool = False) -> Column:
    """V2: number of negative values.

    Numeric column: plain count.  String column: every present value must cast
    to double, otherwise the count is 0 (``strict=False``, the reference
    behaviour); ``strict=True`` counts over the castable values only.
    """
    dt = df.schema[c].dataType
    if isinstance(dt, T.NumericType):
        return F.count_if(col(c) < 0)
    x = col(c).cast("string").try_cast("double")
    neg = F.count_if(x < 0)
    if strict:
        return neg
    bad = F.count_if(col(c).isNotNull() & x.isNull())
    return F.when(bad > 0, F.lit(0)).otherwise(neg)


def canonical(c: Column, dt: T.DataType) -> Column:
    """``c`` in a form whose JSON text is equal exactly when grouping sees the values as equal.

    -0.0 is folded into 0.0 and NaN is one value, timestamps keep microseconds, binary becomes hex; arrays, structs and
    maps are treated the same way inside, at any depth.
    """
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("double").cast("string"))
    if isinstance(dt, T.BinaryType):
        return F.hex(c)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, dt.elementType))
    if isinstance(dt, T.MapType):
        entry = T.StructType([T.StructField("key", dt.keyType), T.StructField("value", dt.valueType)])
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(canonical(e, entry))))
    if isinstance(dt, T.StructType):
        inside = F.struct(*[canonical(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dt.fields)])
        return F.when(c.isNotNull(), inside)
    return c if isinstance(dt, T.StringType) else c.cast("string")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a canonical text of the whole row; a missing field is left out of it, so it never equals a value."""
    return F.sha2(F.to_json(F.struct(*[canonical(col(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(df.schema.fields)])), 256)


def dup_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (missing equals missing), one row ``dup_rows``.

    Rows are grouped by a 256-bit digest of their canonical text, so the
    shuffle carries 32 bytes per distinct row and task whatever the row's width
    or column types; partial aggregation collapses copies map-side.
    """
    return (df.groupBy(row_digest(df).alias("_h")).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("dup_rows")))


def profile(
    df: DataFrame,
    email_cols: Sequence[str] = ("email",),
    nonneg_cols: Sequence[str] = ("price",),
    phone_cols: Sequence[str] = (),
    strict: bool = False,
    include_null_percent: bool = True,
    include_dups: bool = True,
    max_aggs_per_pass: int = 600,
) -> DataFrame:
    """P1, P4, P5, P6, V1, V2, V3 in long form ``(column, metric, value)``.

    Absent role columns are skipped, like the reference's name lookups.  All
    additive metrics share one scan; a very wide table is split into passes of
    at most ``max_aggs_per_pass`` aggregates so generated code stays compact.
    """
    cols = df.columns
    email_cols = [c for c in email_cols if c in cols]
    nonneg_cols = [c for c in nonneg_cols if c in cols]
    phone_cols = [c for c in phone_cols if c in cols]

    n = F.count(F.lit(1))
    entries: list[tuple[str | None, str, Column]] = [(None, "num_rows", n)]
    for c in cols:
        nulls = F.count_if(missing(df, c))
        entries.append((c, "null_count", nulls))
        if include_null_percent:
            entries.append((c, "null_percent", F.try_divide(nulls.cast("double"), n.cast("double"))))
    for c in email_cols:
        entries.append((c, "email_invalid_count", F.count_if(~email_valid(col(c)))))
    for c in phone_cols:
        entries.append((c, "phone_invalid_count", F.count_if(~phone_ok(col(c)))))
    for c in nonneg_cols:
        entries.append((c, "negative_count", negative_count_expr(df, c, strict)))

    long = None
    for start in range(0, len(entries), max_aggs_per_pass):
        chunk = list(enumerate(entries))[start:start + max_aggs_per_pass]
        one_row = df.agg(*[e[2].cast("double").alias(f"m{i}") for i, e in chunk])
        rows = F.array(*[
            F.struct(F.lit(c).cast("string").alias("column"), F.lit(metric).alias("metric"),
                     F.col(f"m{i}").alias("value"))
            for i, (c, metric, _) in chunk
        ])
        part = one_row.select(F.inline(rows))
        long = part if long is None else long.unionByName(part)
    if include_dups:
        long = long.unionByName(
            dup_rows(df).select(F.lit(None).cast("string").alias("column"), F.lit("dup_rows").alias("metric"),
                                F.col("dup_rows").cast("double").alias("value"))
        )
    return long


def quality_score(profile_long: DataFrame) -> DataFrame:
    """P10: sum of the invalid-kind metrics and duplicate rows (one row ``score``)."""
    return profile_long.agg(
        F.coalesce(F.sum(F.when(F.col("metric").isin(*SCORE_METRICS), F.col("value"))), F.lit(0.0))
        .cast("bigint").alias("score")
    )


def evaluate(before: DataFrame, after: DataFrame, **profile_args) -> DataFrame:
    """``before_score, after_score, improved`` (strictly lower is better) of two tables."""
    return evaluate_profiles(profile(before, **profile_args), profile(after, **profile_args))


def evaluate_profiles(before_long: DataFrame, after_long: DataFrame) -> DataFrame:
    """P11 on two finished profiles; both scores come from one aggregate."""
    sides = before_long.select(F.lit("before").alias("side"), "metric", "value").unionByName(
        after_long.select(F.lit("after").alias("side"), "metric", "value"))
    counted = F.col("metric").isin(*SCORE_METRICS)
    score = lambda side: F.coalesce(F.sum(F.when(counted & (F.col("side") == side), F.col("value"))), F.lit(0.0)).cast("bigint")
    return (sides.agg(score("before").alias("before_score"), score("after").alias("after_score"))
            .withColumn("improved", F.col("after_score") < F.col("before_score")))


def compare_profiles(before_long: DataFrame, after_long: DataFrame) -> DataFrame:
    """P11 detail: ``column, metric, before, after`` (full outer, null-safe on column)."""
    b = before_long.select(F.col("column").alias("b_column"), F.col("metric").alias("b_metric"),
                           F.col("value").alias("before"))
    a = after_long.select(F.col("column").alias("a_column"), F.col("metric").alias("a_metric"),
                          F.col("value").alias("after"))
    j = b.join(a, F.col("b_column").eqNullSafe(F.col("a_column")) & (F.col("b_metric") == F.col("a_metric")), "full")
    return j.select(F.coalesce("b_column", "a_column").alias("column"),
                    F.coalesce("b_metric", "a_metric").alias("metric"), "before", "after")


def schema_catalog(df: DataFrame, table: str | None = None) -> DataFrame:
    """One row per field: ordinal, name, type, mode, dtype_name, description, num_rows, num_missing.

    Names and types come from the schema; the last two are one aggregate over the table.
    """
    rows = []
    for i, f in enumerate(df.schema.fields, start=1):
        if isinstance(f.dataType, T.ArrayType):
            mode = "REPEATED"
        elif not f.nullable:
            mode = "REQUIRED"
        else:
            mode = "NULLABLE"
        t = f.dataType.simpleString()
        values = (table, i, f.name, t, mode, PANDAS_DTYPE.get(t, "object"), f.metadata.get("comment"))
        names = ("table_name", "ordinal", "name", "type", "mode", "dtype_name", "description")
        rows.append(F.struct(*[(F.lit(v) if n == "ordinal" else F.lit(v).cast("string")).alias(n) for n, v in zip(names, values)],
                             F.col("n").alias("num_rows"), F.col(f"m{i}").alias("num_missing")))
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, f.name)).alias(f"m{i}")
                                                     for i, f in enumerate(df.schema.fields, start=1)])
    return counted.select(F.inline(F.array(*rows)))


def head_sample(df: DataFrame, order_by: Sequence[str | Column], n: int = 10) -> DataFrame:
    """First ``n`` rows in an explicit order (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def profile_pii(df: DataFrame, email_cols: Sequence[str] = ("email",), phone_cols: Sequence[str] = ("phone",),
                nonneg_cols: Sequence[str] = ("price",), gazetteer: DataFrame | None = None,
                column_vectors: DataFrame | None = None, exemplars: DataFrame | None = None) -> DataFrame:
    """The personal-data profile in long form ``(column, metric, value)``.

    Row count, null counts, invalid e-mail / phone counts, negatives (P1, P4,
    V1-V3), entity counts per column as ``ner_<CLASS>`` (D1, every column read
    as text), similarity to class exemplars as ``sim_<class>`` when column-name
    vectors ``(column, embedding)`` and ``exemplars (class, embedding)`` are
    given (D2), and ``risk_score`` per column (D3).  The head sample (P7) is
    :func:`head_sample`.
    """
    from . import signals as S

    spark = df.sparkSession
    base = profile(df, email_cols, nonneg_cols, phone_cols, include_null_percent=False, include_dups=False)
    if column_vectors is not None and exemplars is not None:
        sims = S.exemplar_similarity(column_vectors, exemplars, id_col="column")
    else:
        sims = spark.createDataFrame([(c, None, None) for c in df.columns], "column string, class string, similarity double")
    # One row per column: the risk score and the entity counts come out of the same grouping.
    ent = S.entity_counts(df, list(df.columns), gazetteer)
    has_email = any(c in df.columns for c in email_cols)
    risk = S.risk_scores(ent, sims, key="column", has_email_check=has_email, with_counts=True)
    long = F.array(F.struct(F.lit("risk_score").alias("metric"), F.col("risk_score").cast("double").alias("value")), *[
        F.struct(F.lit(f"ner_{c}").alias("metric"), F.col(f"e_{c}").cast("double").alias("value")) for c in S.ENTITY_CLASSES])
    out = base.unionByName(risk.select("column", F.inline(long)).where("value IS NOT NULL"))
    if column_vectors is None or exemplars is None:
        return out
    return out.unionByName(sims.where(F.col("class").isNotNull()).select(
        "column", F.concat(F.lit("sim_"), F.col("class")).alias("metric"), F.col("similarity").alias("value")))
