"""Stores that are appended to: documents, query records, audit rows."""

import pytest

from sparkdq.operators import retrieval as R
from sparkdq.plans.flow_queries import s_query_batches
from sparkdq.sources import io


def test_documents_are_appended_once(spark, tmp_path):
    store = str(tmp_path / "store")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    assert R.append_documents(docs([("a", "1"), ("a", "0"), ("b", None)]), store, "one").count() == 2
    for _ in range(2):
        assert [r["doc_id"] for r in R.append_documents(docs([("a", "new"), ("c", "3")]), store, "two").collect()] == ["c"]
    got = {(r["doc_id"], r["text"]) for r in spark.read.parquet(store).collect()}
    assert got == {("a", "0"), ("b", None), ("c", "3")}
    assert io.stored_batches(spark, store) == ["one", "two"]
    assert io.stored_batches(spark, str(tmp_path / "nowhere")) == []


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    got = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "one\ntwo\n" and not got.get("b.txt")


def test_a_failed_save_is_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "select 1")], "query_id int, original_sql string")
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    assert io.try_append_query_runs(rows, str(blocked), "b") is not None
    store = str(tmp_path / "runs")
    assert [io.try_append_query_runs(rows, store, "b") for _ in range(2)] == [None, None]
    assert spark.read.parquet(store).count() == 1
    assert "can't name a folder" in io.try_append_query_runs(rows, store, "../b")


def test_run_ids_name_folders(spark, tmp_path):
    audit = spark.createDataFrame([(0, "mask_email", "email", 3)], "step int, action string, column string, rows_changed bigint")
    for run in ("a", "b", "b"):
        io.append_audit(audit, str(tmp_path / "audit"), run, "d")
    assert sorted(r["run_id"] for r in io.read_history(spark, str(tmp_path / "audit")).collect()) == ["a", "b"]
    for bad in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            io.append_audit(audit, str(tmp_path / "audit"), bad, "d")


def test_query_batches_total_beyond_64_bits(spark, tmp_path):
    ids = [2, 4, 10 ** 12, 10 ** 12 + 2, 1]  # each product fits 64 bits
    rows = [(i, 1, "click", "p") for i in ids]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, props string").selectExpr(
        "*", "TIMESTAMP'2024-01-01 00:00:00' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["batch"]: (r["n"], int(r["bytes_scanned"]), r["saved"]) for r in s_query_batches(spark, str(tmp_path)).collect()}
    assert got == {0: (4, sum(i * 7777777 for i in ids[:4]), True), 1: (1, 7777777, True)}


def test_query_batches_total_is_bigint_where_it_fits(spark, tmp_path):
    spark.createDataFrame([(2, 1, "click", "p")], "event_id bigint, user_id bigint, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert s_query_batches(spark, str(tmp_path)).schema["bytes_scanned"].dataType.simpleString() == "bigint"
