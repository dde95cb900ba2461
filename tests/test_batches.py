"""Stores and states of batches against the same figures taken from the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from dq_helpers import as_dict
from sparkdq.operators import batches as B
from sparkdq.operators import numbering as N
from sparkdq.operators import policy_checks as T
from sparkdq.operators import profile as P

DDL = "id bigint, name string, email string, phone string, price double, `odd, name` array<int>"


def rows(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, 1, 2, 3, 40 + seed]), r.choice([None, "", "a"]), r.choice([None, "x@y.z", "bad"]), r.choice([None, "+15550001111", "5"]),
             r.choice([None, float("nan"), 0.0, -0.0, -1.5, r.random()]), r.choice([None, [1], [1, None]])) for _ in range(n)]


@pytest.fixture(scope="module")
def parts(spark):
    return {f"b{i}": spark.createDataFrame(rows(i, n), DDL) for i, n in enumerate((200, 0, 1, 150))}


@pytest.fixture(scope="module")
def whole(parts):
    out = None
    for p in parts.values():
        out = p if out is None else out.unionByName(p)
    return out


def test_history_equals_the_profile_of_everything(spark, tmp_path, parts, whole):
    h = B.ProfileHistory(spark, str(tmp_path / "h"), buckets=4, phone_cols=["phone"])
    for name, p in [*parts.items(), ("b3", parts["b3"])]:  # the last batch twice
        h.add(p, name)
    assert as_dict(h.profile()) == as_dict(P.profile(whole, phone_cols=["phone"]))
    h.close()  # as in a later session: the table is declared again from its files
    again = B.ProfileHistory(spark, str(tmp_path / "h"), phone_cols=["phone"])
    assert as_dict(again.profile()) == as_dict(P.profile(whole, phone_cols=["phone"]))


def test_a_replaced_batch_counts_once_with_its_new_rows(spark, tmp_path):
    store = B.KeyStore(spark, str(tmp_path / "s"), buckets=3)
    ids = lambda *x: spark.createDataFrame([(i, "t") for i in x], "id int, text string")
    store.add(ids(1, 1, 2), "a", ["id"])
    store.add(ids(2, 3), "b", ["id"])
    store.add(ids(3, 4), "b", ["id"])
    assert {(r["id"], r["n"]) for r in store.repeated().collect()} == {(1, 2)}
    assert {(r["id"], r["n"], r["n_stored"]) for r in store.known(ids(1, 4, 4, 9), ["id"]).collect()} == {(1, 1, 2), (4, 2, 1), (9, 1, 0)}
    store.add(ids(), "a", ["id"])  # an empty batch in place of the first
    assert {(r["id"], r["n"]) for r in store.counts().select("id", "n").collect()} == {(3, 1), (4, 1)}
    with pytest.raises(ValueError, match="holds keys"):
        store.add(ids(1).select(F.col("id").cast("string")), "c", ["id"])
    with pytest.raises(ValueError, match="can't name a folder"):
        store.add(ids(1), "../c", ["id"])


def test_null_keys_and_several_columns(spark, tmp_path, parts, whole):
    store = B.KeyStore(spark, str(tmp_path / "s"))
    fresh = store.known(parts["b0"], ["id", "n"] if "n" in parts["b0"].columns else ["id"])
    assert {r["n_stored"] for r in fresh.collect()} == {0}
    for name, p in parts.items():
        store.add(p, name, ["id"])
    want = {(r["id"], r["n"]) for r in T.duplicate_ids(whole, "id").collect()}
    assert {(r["id"], r["n"]) for r in store.repeated().collect()} == want and None in {i for i, _ in want}
    pairs = B.KeyStore(spark, str(tmp_path / "p"))
    for name, p in parts.items():
        pairs.add(p, name, ["id", "odd, name"])
    assert pairs.counts().count() == whole.select("id", "`odd, name`").distinct().count()


def test_columns_with_the_store_s_own_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 5)], "key int, batch string, n int")
    store = B.KeyStore(spark, str(tmp_path / "s"))
    store.add(df, "x", ["key", "batch", "n"])
    assert store.dup_rows().first()[0] == 0
    some = B.KeyStore(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="own names"):
        some.add(df, "x", ["key", "batch"])


def test_the_store_is_read_in_place(spark, tmp_path):
    store = B.KeyStore(spark, str(tmp_path / "s"), buckets=8)
    store.add(spark.range(1000), "a")
    plan = store.counts()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.known(spark.range(500, 1500))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1  # the new batch alone


def test_quantiles_stay_within_their_error(spark, tmp_path):
    values = [random.Random(i).lognormvariate(0, 3) for i in range(20_000)]
    parts = [spark.createDataFrame([(v,) for v in values[i::3]], "x double") for i in range(3)]
    states = None
    for p in parts:
        s = B.profile_state(p, k=200)
        states = s if states is None else states.unionByName(s)
    merged = B.merge_states(states).cache()
    values.sort()
    for q in (0.01, 0.5, 0.9):
        got = B.quantile(merged, "x", q).first()["value"]
        rank = sum(v <= got for v in values) / len(values)
        assert abs(rank - q) <= B.rank_error(200) + 1 / len(values)
    assert abs(B.distinct_counts(merged).first()["n_distinct"] / 20_000 - 1) < 0.04


def test_approximate_median_fills_and_nothing_stays_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (9.0,), (float("nan"),)], "x double")
    state = B.merge_states(B.profile_state(df))
    assert sorted(r["x"] for r in B.impute_approx_median(df, "x", state).collect()) == [1.0, 2.0, 2.0, 2.0, 9.0]
    empty = df.where("x IS NULL")
    assert [r["x"] for r in B.impute_approx_median(empty, "x", B.merge_states(B.profile_state(empty))).collect()] == [None]


def test_text_that_is_no_number_makes_the_negative_count_zero(spark):
    a, b = spark.createDataFrame([("-1",), ("2",)], "price string"), spark.createDataFrame([("x",), (None,)], "price string")
    merged = lambda *x: as_dict(B.profile_of_state(B.merge_states(x[0] if len(x) == 1 else x[0].unionByName(x[1]))))
    assert merged(B.profile_state(a))["price", "negative_count"] == 1
    assert merged(B.profile_state(a), B.profile_state(b)) == as_dict(P.profile(a.unionByName(b), include_dups=False))


PLAN = [("1", "North", 10, 10), ("1242", "Island", 7, 7), ("44", "Isles", 9, 10), ("44", "Isles", 9, 10), ("7", "B", 10, 10), ("7", "A", 9, 9), (None, "none", 1, 9)]


def by_loop(text):
    plain = "".join(c for c in text or "" if c not in " ().-\t\n")
    if not (plain[:1] == "+" and plain[1:].isascii() and plain[1:].isdigit() and 7 <= len(plain) - 1 <= 15 and plain[1] != "0"):
        return None, None, False
    digits = plain[1:]
    prefix = max((p for p, *_ in PLAN if p and digits.startswith(p)), key=len, default=None)
    if prefix is None:
        return None, None, False
    found = sorted(r for r in PLAN if r[0] == prefix)
    fit = [r for r in found if r[2] <= len(digits) - len(prefix) <= r[3]]
    return prefix, (fit or found)[0][1], bool(fit)


def test_numbers_against_a_plan(spark):
    r = random.Random(5)
    texts = [None, "", "+", "+1", "+1 (242) 555-0101", "+1 202 555 0101", "+1242 5550101", "+12425550", "+44 20 7946 0958", "+7 999 123 45 67", "+7 999 123 456",
             "+999 123 4567", "+0123456789", "12025550101", "+1٢025550101", "+1" * 3000]
    texts += ["+" + r.choice(["1", "1242", "124", "44", "4", "7"]) + "".join(r.choice("0123456789 -") for _ in range(r.randint(3, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "prefix int, phone string, rows string")
    plan = spark.createDataFrame(PLAN, "prefix string, country string, min_digits int, max_digits int")
    got = {x["prefix"]: (x["plan_prefix"], x["plan_country"], x["plan_ok"]) for x in N.match_plan(df, "phone", plan).collect()}
    assert got == {i: by_loop(t) for i, t in enumerate(texts)}
    bad = sum(not by_loop(t)[2] for t in texts)
    assert N.plan_invalid_count(df, "phone", plan).first()["value"] == bad
    assert N.match_plan(df, "phone", plan.limit(0)).where("plan_ok OR plan_country IS NOT NULL").count() == 0
    assert N.match_plan(df.limit(0), "phone", plan).count() == 0
    with pytest.raises(ValueError, match="prefixes must have"):
        N.match_plan(df, "phone", plan.withColumn("prefix", F.lit("123456789")))
