"""Rows removed from a table in place (T8, T9): only files that hold such a row are written again.

``remove_rows`` finds the files, writes what stays of them below ``_forget`` in the table's folder (readers skip names
that begin with an underscore), then writes the list of files to replace, and last deletes these and moves the new ones
in.  A run that is cut off before the list is complete has changed nothing; one cut off later is finished by
``recover``, which every run calls first.  Between the deletes and the moves a reader misses rows, but never sees a
removed one again.  One run at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import folder
from .policy_checks import forget, retention

WORK = "_forget"


def remove_rows(spark: SparkSession, path: str, gone: Callable[[DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame],
                partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Leave ``kept(table)`` in the Parquet table at ``path``; ``gone(table)`` must be all other rows.

    Returns the numbers of ``files`` before and ``rewritten``.  ``partition_by`` names the table's partition columns, in
    order.  The names of the files to write again are all that reaches the driver, which lists files to read them anyway.
    """
    path = path.rstrip("/")
    recover(spark, path)
    table = spark.read.option("basePath", path).parquet(path)
    if missing := [c for c in partition_by if c not in table.columns]:
        raise ValueError(f"{missing} are no columns of {path}")
    hit = gone(table.withColumn("_file", F.col("_metadata.file_path"))).select("_file").distinct()
    old = [_plain(spark, r["_file"]) for r in hit.collect()]
    files = len(table.inputFiles())
    if old:
        work = f"{path}/{WORK}/{uuid.uuid4().hex}"
        touched = spark.read.schema(table.schema).option("basePath", path).parquet(*old)
        out = kept(touched).select(*table.columns).write
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{work}/new")
        spark.createDataFrame([(x,) for x in old], "value string").coalesce(1).write.text(f"{work}/old")  # its _SUCCESS decides
        _finish(spark, path, work)
    return {"files": files, "rewritten": len(old)}


def forget_stored(spark: SparkSession, path: str, subjects: DataFrame, key: str, partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Remove every row of a listed subject; rows without a key stay."""
    names = subjects.select(key).distinct()
    return remove_rows(spark, path, lambda t: t.join(names, key, "left_semi"), lambda t: forget(t, names, key), partition_by)


def retain_stored(spark: SparkSession, path: str, ts_col: str, as_of: str, days: int, keep_missing: bool = False,
                  partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Remove rows older than ``days`` before ``as_of``, and those without a time unless ``keep_missing``."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    old = F.coalesce(F.col(ts_col) < cutoff, F.lit(not keep_missing))
    return remove_rows(spark, path, lambda t: t.where(old), lambda t: retention(t, ts_col, as_of, days, keep_missing), partition_by)


def recover(spark: SparkSession, path: str) -> int:
    """Finish the runs at ``path`` that were cut off after their list was complete, and clear the others; how many there were."""
    fs, work = folder(spark, f"{path.rstrip('/')}/{WORK}")
    runs = [f.getPath().toString() for f in fs.listStatus(work)] if fs.exists(work) else []
    for run in runs:
        if fs.exists(folder(spark, f"{run}/old/_SUCCESS")[1]):
            _finish(spark, path.rstrip("/"), run)
        else:
            fs.delete(folder(spark, run)[1], True)
    return len(runs)


def _finish(spark: SparkSession, path: str, work: str) -> None:
    """Delete the listed files, then move the new ones to where they belong; each step may be repeated."""
    fs, new = folder(spark, f"{work}/new")
    for row in spark.read.text(f"{work}/old").collect():
        fs.delete(folder(spark, row["value"])[1], False)
    if fs.exists(new):
        root, found = fs.makeQualified(new).toString(), fs.listFiles(new, True)
        moves = []
        while found.hasNext():
            at = found.next().getPath()
            if not at.getName().startswith(("_", ".")):
                moves.append(at)
        for at in moves:  # the names hold the writing job's own id, so they are new in the table
            _, to = folder(spark, path + at.toString()[len(root):])
            fs.mkdirs(to.getParent())
            if not fs.rename(at, to):
                raise OSError(f"{at.toString()} can't be moved to {to.toString()}")
    fs.delete(folder(spark, work)[1], True)


def _plain(spark: SparkSession, uri: str) -> str:
    """A file's path from the form in which ``_metadata`` gives it, percent-encoded."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()
