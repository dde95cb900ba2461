"""Exact column statistics that stay distributed."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .util import col


def _values(df: DataFrame, c: str) -> DataFrame:
    x = col(c).cast("double")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        x = F.nanvl(x, F.lit(None).cast("double"))
    return df.select(x.alias("x")).where(F.col("x").isNotNull())


def mean(df: DataFrame, c: str) -> Column:
    """Mean of the non-missing values (NaN is missing) as a scalar subquery: no job runs until it is used."""
    return _values(df, c).agg(F.avg("x")).scalar()


def exact_median(df: DataFrame, c: str) -> float | None:
    """Exact median (mean of the two middle values), like pandas / DuckDB ``median``.

    Values are mapped to 64-bit integers in their own order, and the rank is
    followed down that integer's bits, ``BITS`` at a time: one grouped count per
    step, each of at most ``2 ** BITS`` rows, says which range holds the rank.
    Four passes over one written column find the value, however the values lie
    and however often one repeats; every size of input takes the same steps.
    """
    x = _written(_values(df, c).select(_ordered(F.col("x")).alias("o")))
    n = x.count()
    if n == 0:
        return None
    a = _value_at(x, (n - 1) // 2)
    return a if n % 2 else (a + _value_at(x, n // 2)) / 2.0


BITS = 16


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "column")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _ordered(x: Column) -> Column:
    """The double's bits as an integer that sorts like the double (0.0 and -0.0 alike)."""
    b = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(x == 0, F.lit(0.0)).otherwise(x)).cast("bigint")
    return F.when(b < 0, b.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(b)


def _value_at(x: DataFrame, rank: int) -> float:
    low, size = None, 64
    rows = x
    while size:
        size -= BITS
        part = F.shiftright("o", size)
        for value, count in sorted(rows.groupBy(part.alias("p")).count().collect()):  # at most 2 ** BITS rows
            if rank < count:
                low = value
                break
            rank -= count
        rows = rows.where(part == low)
    return _double(low)


def _double(o: int) -> float:
    bits = o if o >= 0 else o ^ ((1 << 63) - 1)
    return struct.unpack("<d", struct.pack("<q", bits))[0]
