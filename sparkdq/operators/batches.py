"""Figures of a table that grows by batches, without reading earlier batches again.

``KeyStore`` keeps how often every key (a whole row, or chosen columns) has occurred: per batch one row per distinct key,
known by its SHA-256 digest, in files bucketed by it.  Totals and look-ups read the store in place; only the keys of a new
batch are shuffled.  ``profile_state`` folds a batch into one row per (column, metric): counts, and KLL and HyperLogLog
sketches.  Such states of any batches merge into the state of all.  ``ProfileHistory`` keeps both and returns the profile
(P8) of everything that was added.

A batch is known by an id; adding it again replaces it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import email_valid, phone_ok
from ..sources.io import folder_name, make_folder, stored_batches
from .profile import missing, row_digest
from .util import col, quoted

STATE_SCHEMA = "column string, metric string, value bigint, sketch binary"
QUANTILES, DISTINCT = "quantiles", "distinct"


class KeyStore:
    """How often every key has occurred, below ``path`` (a shared folder).

    The first batch decides the key's columns and types, and the number of buckets (the session's shuffle partitions,
    unless given).  Nulls are values of a key like any other; rows of an empty batch change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"key_store_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"

    def add(self, df: DataFrame, batch: str, columns: Sequence[str] | None = None) -> None:
        """Count the keys of a batch: its values of ``columns``, all columns by default."""
        folder_name(batch)
        keys = self._keys(df, columns)
        if not stored_batches(self.spark, f"{self.path}/kind"):
            buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            one = self.spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(self._ddl(keys)).alias("ddl"))
            one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/kind/batch=all")
        kind = self._declare()
        if kind["ddl"] != self._ddl(keys):
            raise ValueError(f"the store holds keys of {kind['ddl']}, the batch has {self._ddl(keys)}")
        view = f"{self.name}_batch"
        keys.createOrReplaceTempView(view)
        try:
            self.spark.sql(f"INSERT OVERWRITE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def counts(self) -> DataFrame:
        """``key`` (digest), the key's columns, ``n``: occurrences in all batches; a grouping without a shuffle."""
        return self._total(self._table())

    def repeated(self) -> DataFrame:
        """T5: the key's columns and ``n`` of the keys that occur more than once."""
        return self.counts().where("n > 1").drop("key")

    def dup_rows(self) -> DataFrame:
        """P6 over all batches, one row ``dup_rows``."""
        return self.counts().agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("dup_rows"))

    def known(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The distinct keys of a batch that is not added yet: its columns, ``n`` there, and ``n_stored`` in the store (0: new)."""
        keys = self._keys(df, columns)
        if not stored_batches(self.spark, f"{self.path}/kind"):
            return keys.drop("key").withColumn("n_stored", F.lit(0).cast("bigint"))
        stored = self._total(self._table()).select("key", F.col("n").alias("n_stored"))
        return keys.join(stored, "key", "left").drop("key").withColumn("n_stored", F.coalesce("n_stored", F.lit(0).cast("bigint")))

    def close(self) -> None:
        """Forget the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _keys(self, df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
        columns = list(columns or df.columns)
        values = df.select(*[col(c) for c in columns])
        if len(columns) < len(df.columns) and {"key", "n", "batch"} & set(columns):
            raise ValueError("key, n and batch are the store's own names: rename these columns")
        whole = len(columns) == len(df.columns)  # of whole rows only the digests are kept
        kept = [] if whole else [F.first(col(c)).alias(f"v{i}") for i, c in enumerate(columns)]
        counted = values.withColumn("_key", F.unhex(row_digest(values))).groupBy("_key").agg(*kept, F.count(F.lit(1)).alias("_n"))
        names = [] if whole else [F.col(f"v{i}").alias(c) for i, c in enumerate(columns)]
        return counted.select(F.col("_key").alias("key"), *names, F.col("_n").alias("n"))

    @staticmethod
    def _ddl(keys: DataFrame) -> str:
        return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in keys.schema.fields)

    def _declare(self):
        kind = self.spark.read.parquet(f"{self.path}/kind/batch=all").first()
        make_folder(self.spark, f"{self.path}/keys")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({kind['ddl']}, batch string) USING parquet PARTITIONED BY (batch) "
                       f"CLUSTERED BY (key) INTO {kind['buckets']} BUCKETS LOCATION '{self.path}/keys'")
        self.spark.catalog.recoverPartitions(self.name)
        return kind

    def _table(self) -> DataFrame:
        self._declare()
        return self.spark.table(self.name)

    @staticmethod
    def _total(table: DataFrame) -> DataFrame:
        values = [c for c in table.columns if c not in ("key", "n", "batch")]
        # Rows of one digest hold the same values, so the first of them is no choice.
        return table.groupBy("key").agg(*[F.first(col(c)).alias(c) for c in values], F.sum("n").alias("n"))


# States ------------------------------------------------------------------------------------------

def rank_error(k: int) -> float:
    """How far the rank of a KLL quantile may be off, as a share of all values (99 % confidence, Apache DataSketches)."""
    return 2.296 / k ** 0.9021


def profile_state(df: DataFrame, email_cols: Sequence[str] = ("email",), nonneg_cols: Sequence[str] = ("price",),
                  phone_cols: Sequence[str] = (), k: int = 800) -> DataFrame:
    """The mergeable state of a batch: ``column, metric, value, sketch``, one scan.

    Counts are those of ``profile.profile``; of a text column that should not be negative, the values that are no number
    are counted too, since any of them makes the count 0.  Numeric columns have a quantile sketch of size ``k``, all
    columns of plain types a distinct-count sketch.  Missing values are in neither.
    """
    there = set(df.columns)
    entries: list[tuple[str | None, str, Column | None, Column | None]] = [(None, "num_rows", F.count(F.lit(1)), None)]
    for f in df.schema.fields:
        c, present = col(f.name), ~missing(df, f.name)
        entries.append((f.name, "null_count", F.count_if(missing(df, f.name)), None))
        if isinstance(f.dataType, T.NumericType):
            value = F.when(present, c.cast("double"))
            entries.append((f.name, QUANTILES, None, F.call_function("kll_sketch_agg_double", value, F.lit(k))))
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            entries.append((f.name, DISTINCT, None, F.hll_sketch_agg(F.when(present, c.cast("string")), 14)))
    entries += [(c, "email_invalid_count", F.count_if(~email_valid(col(c))), None) for c in email_cols if c in there]
    entries += [(c, "phone_invalid_count", F.count_if(~phone_ok(col(c))), None) for c in phone_cols if c in there]
    for c in [c for c in nonneg_cols if c in there]:
        if isinstance(df.schema[c].dataType, T.NumericType):
            entries.append((c, "negative_count", F.count_if(col(c) < 0), None))
        else:
            number = col(c).cast("string").try_cast("double")
            entries.append((c, "negative_count", F.count_if(number < 0), None))
            entries.append((c, "no_number_count", F.count_if(col(c).isNotNull() & number.isNull()), None))
    one = df.agg(*[(n if n is not None else s).alias(f"m{i}") for i, (_, _, n, s) in enumerate(entries)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).cast("string").alias("column"), F.lit(m).alias("metric"),
                 (F.col(f"m{i}") if n is not None else F.lit(None)).cast("bigint").alias("value"),
                 (F.col(f"m{i}") if s is not None else F.lit(None)).cast("binary").alias("sketch"))
        for i, (c, m, n, s) in enumerate(entries)])))


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all batches from the rows of their states; a group has one row per batch and merges before the shuffle."""
    of = lambda m: F.when(F.col("metric") == m, F.col("sketch"))
    merged = states.groupBy("column", "metric").agg(
        F.sum("value").alias("value"), F.call_function("kll_merge_agg_double", of(QUANTILES)).alias("q"), F.hll_union_agg(of(DISTINCT), False).alias("d"))
    return merged.select("column", "metric", "value", F.when(F.col("metric") == QUANTILES, F.col("q"))
                         .when(F.col("metric") == DISTINCT, F.col("d")).alias("sketch"))


def profile_of_state(state: DataFrame) -> DataFrame:
    """P8 without duplicate rows: ``column, metric, value``, equal to ``profile.profile(..., include_dups=False)``."""
    counts = state.where(F.col("sketch").isNull() & F.col("value").isNotNull())
    by_column = counts.groupBy("column").pivot("metric", ["num_rows", "null_count", "email_invalid_count", "phone_invalid_count",
                                                           "negative_count", "no_number_count"]).agg(F.first("value"))
    rows = F.max("num_rows").over(Window.partitionBy())  # the window holds one row per column of the profiled table
    long = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in (
        ("num_rows", F.col("num_rows")), ("null_count", F.col("null_count")),
        ("email_invalid_count", F.col("email_invalid_count")), ("phone_invalid_count", F.col("phone_invalid_count")),
        ("negative_count", F.when(F.coalesce("no_number_count", F.lit(0)) > 0, F.when(F.col("negative_count").isNotNull(), 0)).otherwise(F.col("negative_count"))))])
    # A share exists for every column, null when there are no rows.
    share = F.when(F.col("column").isNotNull(), F.struct(F.lit("null_percent").alias("metric"), F.try_divide(F.col("null_count").cast("double"), rows.cast("double")).alias("value")))
    out = by_column.select("column", F.filter(long, lambda e: e["value"].isNotNull()).alias("m"), share.alias("s"))
    return out.select("column", F.inline(F.concat("m", F.array_compact(F.array("s")))))


def quantile(state: DataFrame, column: str, q: float = 0.5) -> DataFrame:
    """The approximate quantile of a numeric column, one row ``value`` (null without values); see ``rank_error``."""
    sketch = F.first(F.when((F.col("column") == column) & (F.col("metric") == QUANTILES), F.col("sketch")), ignorenulls=True)
    some = F.call_function("kll_sketch_get_n_double", F.col("s")) > 0
    return state.agg(sketch.alias("s")).select(
        F.when(F.col("s").isNotNull() & some, F.call_function("kll_sketch_get_quantile_double", F.col("s"), F.lit(float(q)))).alias("value"))


def distinct_counts(state: DataFrame) -> DataFrame:
    """``column, n_distinct``: approximate distinct present values (standard error 0.8 %)."""
    return state.where(F.col("metric") == DISTINCT).select("column", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def impute_approx_median(df: DataFrame, column: str, state: DataFrame) -> DataFrame:
    """F4, opt-in: missing values become the median that ``state`` knows, within its rank error; the exact median
    (``fixes.impute_nulls``) stays the default.  A column without values keeps its nulls."""
    fill = quantile(state, column).scalar()
    return df.select(*[(F.when(missing(df, c), fill).otherwise(col(c).cast("double")).alias(c) if c == column else col(c)) for c in df.columns])


class ProfileHistory:
    """The profile of all batches added below ``path``: the batches' states, and a ``KeyStore`` of whole rows.

    ``add`` reads its batch twice (counts and sketches; digests) and no earlier batch; arguments are those of
    ``profile_state`` and must be the same for every batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, **state_args):
        self.spark, self.path, self.state_args = spark, path.rstrip("/"), state_args
        self.rows = KeyStore(spark, f"{self.path}/rows", buckets)

    def add(self, df: DataFrame, batch: str) -> None:
        state = profile_state(df, **self.state_args)
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/states/batch={folder_name(batch)}")
        self.rows.add(df, batch)

    def state(self) -> DataFrame:
        return merge_states(self.spark.read.parquet(f"{self.path}/states").drop("batch"))

    def profile(self) -> DataFrame:
        """P8 of everything added, duplicates across batches counted."""
        dups = self.rows.dup_rows().select(F.lit(None).cast("string").alias("column"), F.lit("dup_rows").alias("metric"), F.col("dup_rows").cast("double").alias("value"))
        return profile_of_state(self.state()).unionByName(dups)

    def close(self) -> None:
        self.rows.close()
