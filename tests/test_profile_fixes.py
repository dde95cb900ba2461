import math

from dq_helpers import as_dict
from pyspark.sql import functions as F

from sparkdq.operators import fixes as FX
from sparkdq.operators import profile as P
from sparkdq.operators import stats
from sparkdq.plans.fix_queries import ACCEPTED_PLAN


def test_dq_profile_golden(dq_sample):
    p = as_dict(P.profile(dq_sample))
    assert p[(None, "num_rows")] == 11
    assert p[("email", "null_count")] == 2 and p[("phone", "null_count")] == 2 and p[("price", "null_count")] == 1
    assert p[("id", "null_count")] == 0
    assert math.isclose(p[("email", "null_percent")], 2 / 11)
    assert p[(None, "dup_rows")] == 1
    assert p[("email", "email_invalid_count")] == 3
    assert p[("price", "negative_count")] == 1
    assert P.quality_score(P.profile(dq_sample)).first()["score"] == 5


def test_accepted_plan_golden(dq_sample):
    after = FX.apply_fixes(dq_sample, ACCEPTED_PLAN, order_by=["name"])
    assert after.count() == 10
    p = as_dict(P.profile(after))
    assert p[("price", "null_count")] == 2 and p[("email", "null_count")] == 0
    assert p[("email", "email_invalid_count")] == 3
    assert p[("price", "negative_count")] == 0 and p[(None, "dup_rows")] == 0
    ev = P.evaluate(dq_sample, after).first()
    assert (ev["before_score"], ev["after_score"], ev["improved"]) == (5, 3, True)


def test_empty_frame_profile(spark):
    df = spark.createDataFrame([], "id bigint, email string, price double")
    p = as_dict(P.profile(df))
    assert p[(None, "num_rows")] == 0
    assert p[("email", "null_percent")] is None
    assert p[(None, "dup_rows")] == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "id bigint, price double")
    assert as_dict(P.profile(df))[("price", "null_count")] == 2
    filled = FX.impute_nulls(df, "price", "mean").orderBy("id").collect()
    assert [r["price"] for r in filled] == [1.0, 1.0, 1.0]


def test_negative_count_on_text_column(spark):
    df = spark.createDataFrame([("1.5",), ("-2",), (None,)], "price string")
    assert as_dict(P.profile(df))[("price", "negative_count")] == 1
    bad = spark.createDataFrame([("1.5",), ("-2",), ("abc",)], "price string")
    assert as_dict(P.profile(bad))[("price", "negative_count")] == 0
    assert as_dict(P.profile(bad, strict=True))[("price", "negative_count")] == 1


def test_email_anchor_semantics(spark):
    df = spark.createDataFrame([("a@b.c@d",), ("@a@b.c",), ("x@y.z",), (None,)], "email string")
    assert as_dict(P.profile(df))[("email", "email_invalid_count")] == 2


def test_drop_duplicates_subset_keeps_first(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (2, "z", None)], "id bigint, name string, price double")
    out = {r["id"]: r["name"] for r in FX.drop_duplicates(df, ["id"], ["name"]).collect()}
    assert out == {1: "a", 2: "z"}
    assert FX.drop_duplicates(df, ["nope"]).count() == 3  # no known column -> no-op


def test_impute_median_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 10.0), (5, 4.0)], "id bigint, x double")
    got = {r["id"]: r["x"] for r in FX.impute_nulls(df, "x", "median").collect()}
    assert got[3] == 3.0
    s = spark.createDataFrame([(1, None), (2, "a")], "id bigint, t string")
    got = {r["id"]: r["t"] for r in FX.impute_nulls(s, "t", "mean", "zz").collect()}
    assert got[1] == "zz"


def test_exact_median_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    for vals in (np.concatenate([rng.normal(size=5000), np.full(3000, 0.25)]), np.arange(1, 1002, dtype=float),
                 np.concatenate([rng.normal(size=300) * 1e300, [0.0, -0.0]]), np.array([-5.0, -7.0]), np.array([3.5])):
        df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "`a.x` double").repartition(7)
        assert stats.exact_median(df, "a.x") == float(np.median(vals))
    assert stats.exact_median(df.limit(0), "a.x") is None


def test_normalize_and_regex_clean(spark):
    df = spark.createDataFrame([(" A@B.COM\t",), (None,)], "email string")
    out = [r["email"] for r in FX.normalize_email(df).collect()]
    assert out == ["a@b.com", None]
    out2 = [r["email"] for r in FX.normalize_email(df, missing_as_text=True).collect()]
    assert out2 == ["a@b.com", "nan"]
    d = spark.createDataFrame([("2023-01-05",)], "d string")
    got = FX.regex_clean(d, "d", r"(\d{4})-(\d{2})-(\d{2})", r"\3/\2/\g<1> $").first()["d"]
    assert got == "05/01/2023 $"


def test_remove_negative_keeps_type(spark):
    df = spark.createDataFrame([(1, -3), (2, 4)], "id bigint, n int")
    out = FX.remove_negative_values(df, "n")
    assert dict(out.dtypes)["n"] == "int"
    assert sorted([r["n"] for r in out.collect()], key=lambda v: (v is not None, v)) == [None, 4]


def test_repartition_invariance(dq_sample):
    a = sorted(P.profile(dq_sample.repartition(1)).collect(), key=str)
    b = sorted(P.profile(dq_sample.repartition(17)).collect(), key=str)
    assert a == b


def test_dup_rows_plus_distinct_equals_rows(dq_sample):
    p = as_dict(P.profile(dq_sample))
    assert p[(None, "dup_rows")] + dq_sample.distinct().count() == p[(None, "num_rows")]


def test_fix_idempotence(dq_sample):
    once = FX.apply_fixes(dq_sample, ACCEPTED_PLAN, order_by=["name"])
    twice = FX.apply_fixes(once, ACCEPTED_PLAN, order_by=["name"])
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)


def test_schema_catalog(spark):
    df = spark.createDataFrame([(1, [1.0])], "id bigint, v array<double>")
    rows = P.schema_catalog(df, "t").collect()
    assert [(r["name"], r["type"], r["mode"], r["dtype_name"]) for r in rows] == [
        ("id", "bigint", "NULLABLE", "int64"), ("v", "array<double>", "REPEATED", "object")]


def test_head_sample_plan(dq_sample):
    plan = P.head_sample(dq_sample, ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_wide_table_passes_agree(spark):
    cols = [f"c{i}" for i in range(40)]
    rows = [tuple(None if (r + i) % 7 == 0 else r * i for i in range(40)) for r in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in cols))
    one = sorted(P.profile(df).collect(), key=str)
    many = sorted(P.profile(df, max_aggs_per_pass=7).collect(), key=str)
    assert one == many and len(one) == 1 + 2 * 40 + 1


def test_checkpoint_barriers_same_result(spark, dq_sample):
    plan = [{"action": "drop_duplicates", "params": {"subset": ["id"]}},
            {"action": "impute_nulls", "params": {"column": "price", "strategy": "median"}}]
    a = sorted(FX.apply_fixes(dq_sample, plan, ["name"]).collect(), key=str)
    b = sorted(FX.apply_fixes(dq_sample, plan, ["name"], checkpoint_barriers=True).collect(), key=str)
    assert a == b


def test_entity_counts_with_model(spark, pii_sample):
    import pandas as pd

    from sparkdq.operators import signals as S

    def fake_model(s: pd.Series) -> pd.Series:
        return s.map(lambda v: ["PERSON"] * v.count(" ") + (["DATE"] if v[:2] in ("19", "20") else []))

    e = {(r["column"], r["class"]): r["n"] for r in
         S.entity_counts_with_model(pii_sample, fake_model, ["name", "signup_date"]).collect()}
    assert e[("name", "PERSON")] == 6 and e[("signup_date", "DATE")] == 6 and e[("name", "GPE")] == 0


def test_dup_rows_equals_grouping(spark):
    import datetime as dt
    import random

    rnd = random.Random(5)
    ts = [dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 2), None]
    fl = [0.0, -0.0, float("nan"), 1.5, None]
    st = ['a"b', "a\\b", "", None, "{\"x\":1}", "é"]
    rows = [(rnd.choice(fl), rnd.choice(st), rnd.choice(ts), rnd.choice([b"\x00", b"\xff", None]),
             rnd.choice([[1, 2], [], None]), rnd.choice([None, 1, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "f double, s string, t timestamp, b binary, a array<int>, i int")
    assert P.dup_rows(df).first()["dup_rows"] == len(rows) - df.distinct().count()
    nested = df.selectExpr("array(f, 1.0D) AS `x.a`", "named_struct('t', t, 'f', f) AS y", "array(t) AS z", "array(named_struct('b', b)) AS w")
    assert P.dup_rows(nested).first()["dup_rows"] == len(rows) - nested.distinct().count()
    maps = df.selectExpr("map('a', f, 'b', 0.0D) AS m")
    flat = df.selectExpr("f + 0.0D AS f").distinct().count()
    assert P.dup_rows(maps).first()["dup_rows"] == len(rows) - flat


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1, "A@B.C", -1.0), (1, None, 2.0), (1, None, 2.0)], "`k.1` int, `e.mail` string, `p ``x` double")
    prof = {(r["column"], r["metric"]): r["value"] for r in P.profile(df, ["e.mail"], ["p `x"]).collect()}
    assert (prof[("e.mail", "null_count")], prof[("p `x", "negative_count")], prof[(None, "dup_rows")]) == (2, 1, 1)
    out = FX.apply_fixes(df, [{"action": "drop_duplicates", "params": {"subset": ["k.1", "p `x"]}},
                              {"action": "normalize_email", "params": {"column": "e.mail"}},
                              {"action": "remove_negative_values", "params": {"column": "p `x"}},
                              {"action": "impute_nulls", "params": {"column": "p `x", "strategy": "mean"}}])
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "a@b.c", 2.0), (1, None, 2.0)]


def test_python_groups_in_regex_clean(spark):
    df = spark.createDataFrame([("2023-01-05",)], "d string")
    got = FX.regex_clean(df, "d", r"(?P<y>\d{4})-(?P<m>\d{2})-(\d{2})", r"\g<m>/\g<1>0 \g<3> $").first()["d"]
    assert got == "01/20230 05 $"
