"""Rows kept where they were read: a written table whose tasks can be addressed.

``stage`` writes a DataFrame once into the shared folder, without a shuffle.
Each writing task becomes a *part*: its rows carry ``_part`` (task number) and
``_pos`` (position in the task).  The table is bucketed by ``_part``, so a join
or grouping on ``_part`` reads it in place and only the other, small side
(dictionaries, bitmaps, fingerprints) is shuffled.  The numbers are data in a
committed table, so a lost executor can't change them later.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdq.session import scratch_path

PART, POS = "_part", "_pos"
_WORD = 63  # positions per bitmap word: the sign bit stays unused


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, numbered: bool = False, rows_per_part: int | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed by part and return it with ``_part`` and ``_pos``.

    With ``numbered`` the rows already carry ``_part`` (an executor-side step set it).  ``rows_per_part`` splits a
    task's rows into several parts, for steps that hold one part in memory.
    """
    spark = df.sparkSession
    if not numbered:
        pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        part = F.spark_partition_id().cast("bigint")
        part = part if rows_per_part is None else part * (1 << 33) + F.floor(pos / rows_per_part)
        df = df.select("*", part.alias(PART), pos.alias(POS))
    name = f"staged_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
       .bucketBy(shuffle_partitions(spark), PART).saveAsTable(name))
    _note(path, name)
    return spark.table(name)


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled once by ``key`` and written as a table bucketed and sorted by it: later joins on ``key`` read it in place."""
    spark = df.sparkSession
    name, n = f"keyed_{uuid.uuid4().hex}", shuffle_partitions(spark)
    path = scratch_path(spark, name)
    (df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path)
       .bucketBy(n, key).sortBy(key).saveAsTable(name))
    _note(path, name)
    return spark.table(name)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, computes once."""
    spark = df.sparkSession
    path = scratch_path(spark, "written")
    df.write.option("compression", "zstd").parquet(path)
    _note(path, None)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """Owns what operators stage while it is entered: ``with Scope(spark) as s: ...`` and, once results are written, ``s.close()``.

    Folders and tables of other scopes, or made outside any, are never touched.  Scopes may be nested; the inner one owns.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self._tokens = spark, [], []

    def __enter__(self) -> Scope:
        self._tokens.append(_scope.set(self))
        return self

    def __exit__(self, *exc) -> None:
        _scope.reset(self._tokens.pop())

    def close(self) -> None:
        """Remove its folders and tables; results that still read them must have been written before."""
        for path, table in self.made:
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.made.clear()


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def _note(path: str, table: str | None) -> None:
    scope = _scope.get()
    if scope is not None:
        scope.made.append((path, table))


def trimmed(run):
    """A ``mapInArrow`` body that gives freed memory back to the system when its task ends: workers outlive tasks."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()  # Arrow keeps what it frees, too
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def bitmaps(picks: DataFrame) -> DataFrame:
    """``(_part, _pos)`` rows as one array of 63-bit words per part (JVM side, at most one bit per row of a part)."""
    words = (picks.groupBy(PART, F.floor(F.col(POS) / _WORD).cast("int").alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(POS) % _WORD).cast("int"))).alias("b")))
    m = words.groupBy(PART).agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("top"))
    return m.select(PART, F.transform(F.sequence(F.lit(0), F.col("top")),
                                      lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("_bits"))


def bit_set(bits: Column, pos: Column) -> Column:
    """Whether position ``pos`` is set; false beyond the end or without a bitmap."""
    word = F.get(bits, F.floor(pos / _WORD).cast("int"))
    return F.coalesce(F.call_function("getbit", word, (pos % _WORD).cast("int")) == 1, F.lit(False))


def marked(table: DataFrame, picks: DataFrame, name: str = "_marked") -> DataFrame:
    """All rows of a staged table with a boolean: is ``(_part, _pos)`` among ``picks``?  The table isn't shuffled."""
    b = bitmaps(picks).withColumnRenamed(PART, "_bpart").hint("shuffle_hash")
    j = table.join(b, table[PART] == b["_bpart"], "left")
    return j.select(*[table[c] for c in table.columns], bit_set(F.col("_bits"), table[POS]).alias(name))
