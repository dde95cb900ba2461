"""Rows removed from stored tables, and figures counted while writing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkdq.operators import policy_checks as T
from sparkdq.operators import stored as S
from sparkdq.operators.masks import apply_masks
from sparkdq.sources import io

ACTIONS = [{"action": "mask_email", "params": {"column": "email"}, "description": "d"}, {"action": "mask_phone", "params": {"column": "phone"}},
           {"action": "hash_name", "params": {"column": "absent"}}, {"action": "redact_address", "params": {"column": "email"}}]


def names(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([None, *range(40)]), r.choice(["a b", "c%d", "e=f", None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "user int, kind string, n int")
    path = str(tmp_path / "t")
    df.orderBy("user").write.option("maxRecordsPerFile", 20).partitionBy("kind").parquet(path)
    return path, rows


def stored(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("user", "kind", "n").collect()), key=lambda r: r[2])


def test_only_files_with_a_subject_are_written_again(spark, table):
    path, rows = table
    before = names(path)
    held = {r["f"] for r in spark.read.parquet(path).where("user in (3, 4)").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    subjects = spark.createDataFrame([(3,), (4,), (4,), (None,), (99,)], "user int")
    told = S.forget_stored(spark, path, subjects, "user", ["kind"])
    assert told == {"files": len(before), "rewritten": len(held)} and 0 < len(held) < len(before)
    assert stored(spark, path) == [r for r in rows if r[0] not in (3, 4)]
    after = names(path)
    assert len(before & after) == len(before) - len(held)
    assert S.forget_stored(spark, path, subjects, "user", ["kind"])["rewritten"] == 0 and names(path) == after
    assert not [d for d in os.listdir(path) if d == S.WORK and os.listdir(os.path.join(path, d))]


def test_everything_may_go_but_the_table_stays_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("x", F.lit("t")).write.parquet(path)
    S.forget_stored(spark, path, spark.range(10), "id")
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id", "x"]
    assert S.forget_stored(spark, path, spark.range(10), "id")["rewritten"] == 0


def test_a_run_cut_off_is_finished_or_undone(spark, table, monkeypatch):
    path, rows = table
    subjects = spark.createDataFrame([(5,)], "user int")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the list is complete, nothing is replaced yet
        m.setattr(S, "_finish", stop)
        with pytest.raises(KeyboardInterrupt):
            S.forget_stored(spark, path, subjects, "user", ["kind"])
    assert stored(spark, path) == rows
    assert S.recover(spark, path) == 1 and stored(spark, path) == [r for r in rows if r[0] != 5]
    os.makedirs(f"{path}/{S.WORK}/other/new")  # no list
    assert S.recover(spark, path) == 1 and S.recover(spark, path) == 0
    assert stored(spark, path) == [r for r in rows if r[0] != 5]
    with pytest.raises(ValueError, match="no columns"):
        S.forget_stored(spark, path, subjects, "user", ["nothing"])


def test_retention_in_place_equals_the_plain_form(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 9 != 0, F.expr("timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(cast(id as int))")).alias("ts"))
    for keep in (True, False):
        path = str(tmp_path / str(keep))
        df.repartitionByRange(10, "id").write.parquet(path)
        told = S.retain_stored(spark, path, "ts", "2024-01-31", 30, keep)
        want = {r["id"] for r in T.retention(df, "ts", "2024-01-31", 30, keep).collect()}
        assert {r["id"] for r in spark.read.parquet(path).collect()} == want
        assert told["rewritten"] < told["files"] or not keep


def test_figures_counted_while_writing(spark, tmp_path, pii_sample):
    audit = T.mask_and_audit(pii_sample, ACTIONS, str(tmp_path / "m"))
    assert [tuple(r) for r in audit.collect()] == [tuple(r) for r in T.mask_audit(pii_sample, ACTIONS).collect()]
    assert audit.schema == T.mask_audit(pii_sample, ACTIONS).schema or audit.columns == T.mask_audit(pii_sample, ACTIONS).columns
    masked = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, apply_masks(pii_sample, ACTIONS).collect()))
    assert T.mask_and_audit(pii_sample, [], str(tmp_path / "n")).count() == 0 and spark.read.parquet(str(tmp_path / "n")).count() == 6
    none = T.mask_and_audit(pii_sample.where("id > 99"), ACTIONS, str(tmp_path / "e"))
    assert [r["rows_changed"] for r in none.collect()] == [0, 0, 0]


def test_publication_judged_by_observed_figures(spark, tmp_path, dq_sample):
    metrics = {"n": F.count(F.lit(1)), "bad": F.count_if(F.col("price") < 0)}
    run = lambda df, mode: io.write_audit_publish(df, str(tmp_path / "s"), str(tmp_path / "t"), lambda m: m["bad"] == 0, mode=mode, metrics=metrics)
    assert run(dq_sample, "A")["published"] is False and not (tmp_path / "t").exists()
    told = run(dq_sample.where("price >= 0"), "A")
    assert told["published"] and told["metrics"] == {"n": 9, "bad": 0} and spark.read.parquet(str(tmp_path / "t")).count() == 9
    assert run(dq_sample, "C")["metrics"] == {"n": 11, "bad": 1}
    assert io.write_observed(dq_sample.limit(0), str(tmp_path / "z"), metrics) == {"n": 0, "bad": 0}
