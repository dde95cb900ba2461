import os

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparkdq.llm import exact_dedup, queries
from sparkdq.llm.stage import Scope, keyed, stage, written
from sparkdq.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def left(spark):
    tables = {t.name for t in spark.catalog.listTables() if t.name.startswith(("staged_", "keyed_"))}
    return tables, {f for f in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file://")) if f.startswith(("staged_", "keyed_", "written"))}


def test_scope_removes_its_own_and_nothing_else(spark):
    outside = stage(spark.range(5).toDF("id"))
    before = left(spark)
    with Scope(spark) as outer:
        mine = written(spark.range(7).toDF("id"))
        with Scope(spark) as inner:
            docs = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
            result = exact_dedup.exact_dedup(docs).filter("kept")
            keyed(docs, "doc_id")
            assert result.count() == 7
    assert left(spark) != before
    inner.close()
    assert mine.count() == 7
    outer.close()
    assert left(spark) == before and outside.count() == 5


def test_results_of_others_survive_a_pipeline_run(spark):
    first = queries.QUERIES["op1_exact_dedup"](spark, SF)
    before = left(spark)
    result = cp.run(spark, SF)
    tables, folders = left(spark)
    assert tables == before[0] and len(folders - before[1]) == 1  # the result alone
    again = cp.run(spark, SF)
    assert first.count() == 200 and result.exceptAll(again).count() == 0 == again.exceptAll(result).count() and result.count() > 50


def test_pipeline_stages_with_odd_rows(spark, odd_docs, no_docs):
    """Nulls, repeated rows, null ids and extra columns whose names clash: every stage gives rows of documents."""
    for docs in (odd_docs, no_docs):
        for name, f in cp.STAGES:
            got = f(spark, docs, "odd")
            if name != "BPE encoding":
                assert got.columns == cp.COLUMNS
            assert got.count() <= docs.count() and (got.count() > 0) == (docs is odd_docs)
