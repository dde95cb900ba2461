import os
import tempfile

from dq_helpers import as_dict
from pyspark.sql import functions as F

from sparkdq import streaming as ST
from sparkdq.functions import masks as M
from sparkdq.operators import profile as P
from sparkdq.operators.batches import ProfileHistory


def test_mask_and_profile_stream(spark, dq_sample):
    base = tempfile.mkdtemp(prefix="sparkdq-stream-")
    src = os.path.join(base, "src")
    dq_sample.repartition(3).write.parquet(src)
    schema = ", ".join(f"{n} {t}" for n, t in dq_sample.dtypes)
    s = ST.read_stream(spark, src, schema, max_files_per_trigger=1)
    q = ST.mask_stream(s, [{"action": "mask_email", "params": {"column": "email"}}],
                       os.path.join(base, "out"), os.path.join(base, "ck1"))
    q.awaitTermination()
    got = sorted((r["id"], r["email"]) for r in spark.read.parquet(os.path.join(base, "out")).collect())
    want = sorted((r["id"], r["e"]) for r in dq_sample.select("id", M.mask_email("email").alias("e")).collect())
    assert got == want
    q2 = ST.profile_stream(ST.read_stream(spark, src, schema, max_files_per_trigger=1), os.path.join(base, "prof"),
                           os.path.join(base, "ck2"))
    q2.awaitTermination()
    prof = spark.read.parquet(os.path.join(base, "prof"))
    total = prof.where("metric = 'num_rows'").agg(F.sum("value")).first()[0]
    assert total == 11 and prof.select("batch_id").distinct().count() >= 1


def test_profiles_of_a_stream_survive_a_repeated_micro_batch(spark, dq_sample, tmp_path):
    src = str(tmp_path / "src")
    dq_sample.repartition(3).write.parquet(src)
    schema = ", ".join(f"{n} {t}" for n, t in dq_sample.dtypes)
    for checkpoint in ("ck1", "ck2"):  # a lost checkpoint: every micro-batch comes again
        for start, path in ((ST.profile_stream, "prof"), (ST.profile_history_stream, "hist")):
            args = {"buckets": 2} if path == "hist" else {}
            start(ST.read_stream(spark, src, schema, max_files_per_trigger=1), str(tmp_path / path), str(tmp_path / f"{checkpoint}-{path}"), **args).awaitTermination()
    prof = spark.read.parquet(str(tmp_path / "prof"))
    assert prof.where("metric = 'num_rows'").agg(F.sum("value")).first()[0] == 11
    assert as_dict(ProfileHistory(spark, str(tmp_path / "hist")).profile()) == as_dict(P.profile(dq_sample))
