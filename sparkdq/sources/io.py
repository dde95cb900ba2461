"""Sources and sinks (S1-S7): CSV / Parquet scans, table writes, write-audit-publish,
run history and query records.

Writes go to paths the caller names (on a cluster: a shared folder such as
the one in ``spark.checkpoint.dir``); no data is collected to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens pandas reads as missing by default.
PANDAS_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# One quoting rule for both directions: a quote inside a cell is doubled, nothing else is special in it.
CSV_CELLS = {"quote": '"', "escape": '"', "multiLine": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False,
             "ignoreTrailingWhiteSpace": False}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             missing_tokens: Sequence[str] = PANDAS_MISSING_TOKENS) -> DataFrame:
    """Header CSV with an explicit schema; missing tokens become null.

    Every column is read as text, missing tokens are nulled, then each column
    is ``try_cast`` to its target type (ANSI-safe: a bad value becomes null).
    Quoted cells may hold separators, doubled quotes, line breaks and
    backslashes.  A cell with a line break keeps a file from being split, so
    large inputs should come as many files.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = spark.read.schema(text_schema).options(**CSV_CELLS).option("header", True).csv(path)
    toks = list(missing_tokens)
    cols = []
    for f in schema.fields:
        c = F.when(F.col(f.name).isin(toks), F.lit(None)).otherwise(F.col(f.name))
        if not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


# Forms that pandas reads as whole numbers, numbers and truth values; white space around numbers is ignored.
_INTEGER, _TRUTH = r"^[ \t]*[+-]?[0-9]+[ \t]*$", ("True", "TRUE", "true", "False", "FALSE", "false")
_NUMBER = r"(?i)^[ \t]*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)[ \t]*$"


def column_types(text: DataFrame, missing_tokens: Sequence[str] = PANDAS_MISSING_TOKENS) -> DataFrame:
    """The type pandas infers for every column of a table of texts: ``column``, ``position``, ``dtype``, ``type``, ``missing``.

    A column climbs a lattice: all values whole numbers that fit 64 bits (``int64``; ``uint64`` for larger ones without
    a sign), all numbers (``float64``), all truth values (``bool``), else ``object``.  Missing cells turn whole numbers
    into ``float64`` and truth values into ``object`` (their Spark ``type`` stays boolean); a column of missing cells
    alone is ``float64``, one of an empty table ``object``.  All columns are folded in one aggregate over one scan.
    """
    aggs, n = [], len(text.columns)
    for i, name in enumerate(text.columns):
        c = F.col(f"`{name}`")
        there = c.isNotNull() & ~c.isin(list(missing_tokens))
        whole = there & c.rlike(_INTEGER)
        large = F.trim(F.regexp_replace(c, r"[ \t]", "")).try_cast("decimal(38,0)")
        fits = c.rlike(_INTEGER) & F.regexp_replace(c, r"[ \t]", "").try_cast("bigint").isNotNull()
        aggs.append(F.struct(
            F.lit(name).alias("column"), F.lit(i).alias("position"), F.count_if(~there).alias("missing"), F.count_if(there).alias("there"),
            F.count_if(whole).alias("whole"), F.count_if(there & fits).alias("fit"),
            F.count_if(whole & large.between(F.lit("0").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))).alias("unsigned"),
            F.count_if(there & c.rlike(_NUMBER)).alias("numbers"), F.count_if(there & c.isin(*_TRUTH)).alias("truths")).alias(f"c{i}"))
    facts = text.agg(*aggs).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(n)])))
    every = lambda x: F.col(x) == F.col("there")
    some, full = F.col("there") > 0, F.col("missing") == 0
    # Whole numbers beyond 64 bits stay text when nothing is missing, like in pandas.
    dtype = (F.when(~some, F.when(full, "object").otherwise("float64"))
             .when(every("fit"), F.when(full, "int64").otherwise("float64"))
             .when(every("whole") & full, F.when(every("unsigned"), "uint64").otherwise("object"))
             .when(every("numbers"), "float64")
             .when(every("truths"), F.when(full, "bool").otherwise("object")).otherwise("object"))
    kind = (F.when(some & every("truths"), "boolean").when(F.col("dtype") == "int64", "bigint").when(F.col("dtype") == "uint64", "decimal(20,0)")
            .when(F.col("dtype") == "float64", "double").otherwise("string"))
    return facts.withColumn("dtype", dtype).select("column", "position", "dtype", kind.alias("type"), "missing")


def read_csv_inferred(spark: SparkSession, path: str, missing_tokens: Sequence[str] = PANDAS_MISSING_TOKENS) -> DataFrame:
    """Header CSV whose column types are inferred like pandas does (``column_types``), then cast in one pass.

    Two scans: one aggregate (a row per column reaches the driver) and the typed read.
    """
    raw = spark.read.options(**CSV_CELLS).option("header", True).option("inferSchema", False).csv(path)
    if not raw.columns:
        return raw
    types = {r["column"]: r["type"] for r in column_types(raw, missing_tokens).collect()}
    cols = []
    for name in raw.columns:
        c = F.when(~F.col(f"`{name}`").isin(list(missing_tokens)), F.col(f"`{name}`"))
        if types[name] != "string":
            c = F.regexp_replace(c, r"[ \t]", "").try_cast(types[name])
        cols.append(c.alias(name))
    return raw.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write a directory of files (no single-file promise)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**{k: v for k, v in CSV_CELLS.items() if k != "multiLine"}).option("header", True).option("quoteAll", True).option("nullValue", "")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_observed(df: DataFrame, path: str, metrics: Mapping[str, Column], fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: Sequence[str] = ()) -> dict:
    """S2 with figures: write ``df`` and return the aggregates ``metrics`` of its rows, counted by the writing tasks.

    The data is computed once.  The figures come from the write's last stage, whose tasks count once each even when they
    are run again.
    """
    if not metrics:
        write_table(df, path, fmt, mode, partition_by)
        return {}
    seen = Observation()
    write_table(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), path, fmt, mode, partition_by)
    return seen.get


def folder(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = folder(spark, path)
    fs.mkdirs(p)


def stored_batches(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches below ``path``, from the names of its folders ``batch=<id>``."""
    fs, root = folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Make the folder ``staged`` the folder ``target`` by renames, without copying data.

    An earlier target is set aside first and put back when the second rename
    fails, then removed; a reader sees the old or the new data, or for a moment
    none, but never a mixture.
    """
    fs, new = folder(spark, staged)
    _, old = folder(spark, target)
    _, aside = folder(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
    if old.getParent() is not None:
        fs.mkdirs(old.getParent())
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{target} can't be set aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{staged} can't be published as {target}")
    if had:
        fs.delete(aside, True)


def write_audit_publish(df: DataFrame, staging_path: str, target_path: str,
                        audit: Callable[[DataFrame], bool] | Callable[[dict], bool], mode: str = "C", max_retries: int = 2,
                        repropose: Callable[[DataFrame, int], DataFrame] | None = None,
                        fmt: str = "parquet", metrics: Mapping[str, Column] | None = None) -> dict:
    """S3: stage the candidate, audit the staged copy, publish when the mode allows.

    Mode ``A``: a failed audit stops (nothing published).  Mode ``B``: a failed
    audit asks ``repropose(candidate, attempt)`` for a new candidate, up to
    ``max_retries`` times.  Mode ``C`` (default): publish with a warning.  The
    staged folder itself becomes the target; staged data that is not published is
    removed.  When writing, auditing or publishing raises, the target is as
    before and the error is in the result as ``warning``.  With ``metrics`` the
    candidate's figures are counted while it is staged (``write_observed``);
    ``audit`` judges them instead of reading the staged table, and the result
    holds them as ``metrics``.
    """
    spark = df.sparkSession
    attempt, candidate = 0, df
    while True:
        stage = f"{staging_path.rstrip('/')}/attempt={attempt}"
        try:
            figures = write_observed(candidate, stage, metrics or {}, fmt)
            ok = bool(audit(figures if metrics else spark.read.format(fmt).load(stage)))
            if ok or mode == "C":
                publish(spark, stage, target_path)
                return {"published": True, "audit_passed": ok, "attempts": attempt + 1,
                        "warning": None if ok else "published although the audit failed"} | ({"metrics": figures} if metrics else {})
        except Exception as e:
            _remove(spark, stage)
            return {"published": False, "audit_passed": False, "attempts": attempt + 1, "warning": f"{type(e).__name__}: {str(e)[:300]}"}
        _remove(spark, stage)
        if mode == "B" and repropose is not None and attempt < max_retries:
            attempt += 1
            candidate = repropose(candidate, attempt)
            continue
        return {"published": False, "audit_passed": False, "attempts": attempt + 1, "warning": "audit failed"}


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = folder(spark, path)
    fs.delete(p, True)


def append_run(verdicts: DataFrame, path: str, run_id: str, dataset: str,
               accepted: bool | None = None, notes: str | None = None, confidence: float | None = None,
               questions: DataFrame | None = None) -> None:
    """Append one run to the history table, one row per proposal or question (long form).

    A proposal's row holds its whole record: description, parameters, matched
    references, confidence, status and notes; a question's row only
    ``question``.  Run-level fields repeat on each row.  The rows of a run are
    one folder named by its id, so writing a run again replaces it.
    """
    run = [F.lit(dataset).alias("dataset"), F.unix_timestamp().alias("run_ts"), F.lit(accepted).cast("boolean").alias("accepted"),
           F.lit(notes).cast("string").alias("validation_notes"), F.lit(confidence).cast("double").alias("validation_confidence")]
    null = F.lit(None).cast("string").alias("question")
    rows = verdicts.select(*run, "id", "action", "description", "params", "policy_refs", "confidence", "status", "notes", null)
    if questions is not None:
        asked = questions.select(*run, F.col("question"))
        rows = rows.unionByName(asked, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={folder_name(run_id)}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a history; ``run_id`` comes from the folders' names."""
    return spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("string"))


def history_summary(history: DataFrame) -> DataFrame:
    """Proposals and acceptances per (dataset, action)."""
    return history.where(F.col("question").isNull()).groupBy("dataset", "action").agg(
        F.countDistinct("run_id").alias("n_runs"),
        F.count(F.lit(1)).alias("n_proposed"),
        F.count_if(F.col("status") == "accepted").alias("n_accepted"))


NESTED_HISTORY_SCHEMA = (
    "fix_history array<struct<dataset:string,timestamp:bigint,"
    "plan:struct<proposed_fixes:array<struct<id:string,action:string,description:string,"
    "params:struct<subset:array<string>,column:string,strategy:string,value:string,pattern:string,repl:string>,"
    "policy_refs:array<struct<policy_id:string,quote:string>>,confidence:double>>,"
    "questions_to_user:array<struct<question:string,related_columns:array<string>>>>,"
    "post_validation:struct<accepted:boolean,notes:string,confidence:double>>>"
)


def read_nested_history(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Read nested JSON run histories with an explicit schema: one document a file, or ``one_per_line``, which lets
    a large file be split."""
    return spark.read.schema(NESTED_HISTORY_SCHEMA).option("multiLine", not one_per_line).json(path)


def explode_runs(nested: DataFrame) -> DataFrame:
    """One row per proposed fix of every run in a nested history."""
    runs = nested.select(F.posexplode("fix_history").alias("run_pos", "run"))
    return runs.select("run_pos", F.col("run.dataset").alias("dataset"), F.col("run.timestamp").alias("run_ts"),
                       F.col("run.post_validation.accepted").alias("accepted"),
                       F.explode_outer("run.plan.proposed_fixes").alias("fix")).select(
        "run_pos", "dataset", "run_ts", "accepted", "fix.*")


def folder_name(name: str) -> str:
    """``name``, if it can name a folder of a store."""
    if not name or not all(c.isalnum() or c in "-_." for c in name) or name.startswith("."):
        raise ValueError(f"{name!r} can't name a folder: letters, digits, '-', '_' and '.' only")
    return name


def append_query_runs(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append query records (texts, line diff, statistics before and after, scan figures, as the caller has them);
    ``created_at`` defaults to now.

    With ``batch`` the records are a folder of that name, so writing them again replaces them instead of storing them
    twice; don't mix both forms in one store.
    """
    out = df if "created_at" in df.columns else df.withColumn("created_at", F.current_timestamp())
    if batch is None:
        out.write.mode("append").parquet(path)
    else:
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={folder_name(batch)}")


def try_append_query_runs(df: DataFrame, path: str, batch: str) -> str | None:
    """Like ``append_query_runs``, but a failed save is reported, not raised: None, or the error's text.

    The request that the records describe goes on; the same batch can be saved later.
    """
    try:
        append_query_runs(df, path, batch)
    except Exception as e:
        return f"{type(e).__name__}: {str(e)[:300]}"
    return None


def append_audit(audit: DataFrame, path: str, run_id: str, dataset: str) -> None:
    """Append a run's audit rows (``policy_checks.mask_audit``) beside its history; a repeated run replaces them."""
    (audit.withColumn("dataset", F.lit(dataset)).withColumn("run_ts", F.unix_timestamp())
     .write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={folder_name(run_id)}"))
