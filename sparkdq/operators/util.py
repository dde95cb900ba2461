"""Small helpers for column names and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def exact_sum(name: str) -> Column:
    """Sum of a whole-number column as decimal(38,0): the sum of bigints may not fit a bigint."""
    return F.sum(col(name).cast("decimal(28,0)"))


def narrowed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the whole-number column ``name`` as bigint if all its values fit one, else as it is.  Reads the column once."""
    fits = df.agg(F.count_if(col(name).isNotNull() & col(name).try_cast("bigint").isNull()) == 0).first()[0]
    return df.withColumn(name, col(name).cast("bigint")) if fits else df
