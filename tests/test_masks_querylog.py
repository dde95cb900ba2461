from pyspark.sql import functions as F

from sparkdq.functions import checks as C
from sparkdq.functions import masks as M
from sparkdq.functions import querylog as QF
from sparkdq.operators import querylog as QL
from sparkdq.operators.masks import apply_masks
from sparkdq.operators import profile as P

EDGE = [(1, None), (2, ""), (3, "  "), (4, "x"), (5, "a@b"), (6, "ab@c"), (7, "abc@d.e"), (8, "john.doe@x.y@z"),
        (9, "@q"), (10, "+1-123-456-7890"), (11, "12 34"), (12, "n/a")]


def _edge(spark):
    return spark.createDataFrame(EDGE, "id int, v string")


def test_mask_email_edges(spark):
    got = {r["id"]: r["m"] for r in _edge(spark).select("id", M.mask_email("v").alias("m")).collect()}
    assert [got[i] for i in range(1, 10)] == [None, "", "  ", "x", "a@b", "a*@c", "a*c@d.e", "j******e@x.y@z", "@q"]
    short = {r["id"]: r["m"] for r in _edge(spark).select("id", M.mask_email("v", mask_short=True).alias("m")).collect()}
    assert short[5] == "*@b"


def test_mask_phone_edges(spark):
    got = {r["id"]: r["m"] for r in _edge(spark).select("id", M.mask_phone("v").alias("m")).collect()}
    assert got[10] == "+1********90" and got[11] == "****" and got[12] == "" and got[3] == "  " and got[1] is None
    df = spark.createDataFrame([("345-678-9012",)], "p string")
    assert df.select(M.mask_phone("p")).first()[0] == "34******12"


def test_hash_redact_mask(spark):
    import hashlib

    df = spark.createDataFrame([("Ann",), (None,), ("  ",)], "n string")
    rows = df.select(M.hash_value("n", "s").alias("h"), M.redact("n").alias("r"), M.mask_column("n").alias("m")).collect()
    assert rows[0]["h"] == hashlib.sha256(b"Anns").hexdigest()[:12]
    assert rows[1]["h"] is None and rows[1]["r"] is None and rows[1]["m"] is None
    assert rows[0]["r"] == "[REDACTED]" and rows[2]["r"] == "  " and rows[2]["m"] == "[MASKED]"


def test_pii_golden(pii_sample):
    p = {(r["column"], r["metric"]): r["value"] for r in
         P.profile(pii_sample, phone_cols=["phone"], include_dups=False).collect()}
    assert p[(None, "num_rows")] == 6
    assert p[("email", "null_count")] == 1 and p[("phone", "null_count")] == 1 and p[("notes", "null_count")] == 3
    assert p[("email", "email_invalid_count")] == 2
    assert p[("phone", "phone_invalid_count")] == 5
    out = apply_masks(pii_sample, [{"action": "mask_email", "params": {"column": "email"}},
                                   {"action": "redact_address", "params": {"column": "address"}},
                                   {"action": "nope", "params": {"column": "name"}},
                                   {"action": "mask_phone", "params": {"column": "missing"}}]).orderBy("id").collect()
    assert [r["email"] for r in out][:4] == ["j******e@example.com", "j********h@example", None,
                                             "a*************s@example.com"]
    assert all(r["address"] == "[REDACTED]" for r in out) and out[0]["name"] == "John Doe"


def test_mask_idempotence(spark):
    df = _edge(spark)
    once = df.select("id", M.redact("v").alias("a"), M.mask_column("v").alias("b"))
    twice = once.select("id", M.redact("a").alias("a"), M.mask_column("b").alias("b"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_phone_and_domain(spark):
    df = spark.createDataFrame([("+1 (202) 555-0101",), ("555-0101",), (None,)], "p string")
    assert [r[0] for r in df.select(C.phone_ok("p")).collect()] == [True, False, False]
    e = spark.createDataFrame([("a@b.com",), ("x",)], "e string")
    assert [r[0] for r in e.select(M.mask_domain_only("e")).collect()] == ["b.com", "x"]


def test_static_stats_golden(spark):
    df = spark.createDataFrame([("SELECT * FROM tbl WHERE salary > 50000 ORDER BY salary DESC",),
                                ("select x, lag (y) over w, percent_rank() over w from a join b join c where x=1 and d.event_date > 1",),
                                ("select TO_DATE(x), cast(y AS DATE) from t where x = 1\n, event_date",)], "sql string")
    rows = df.select(QF.static_stats("sql").alias("s")).collect()
    s0, s1, s2 = (r["s"] for r in rows)
    assert (s0.select_star, s0.num_joins, s0.window_functions, s0.non_sargable_predicates,
            s0.partition_filters_used) == (True, 0, [], [], False)
    assert s1.num_joins == 2 and s1.window_functions == ["lag", "rank"] and s1.partition_filters_used
    assert s2.non_sargable_predicates == ["DATE(x)", "cast(y AS DATE)"] and s2.partition_filters_used is False


def test_heuristics_golden(spark):
    df = spark.createDataFrame([(2, False, 10**10), (1, False, 10**10), (0, True, 10**10)],
                               "nj int, pf boolean, b bigint")
    st = F.struct(F.col("nj").alias("num_joins"), F.col("pf").alias("partition_filters_used"))
    rows = df.select(QF.heuristics(st, "b").alias("h")).collect()
    assert (rows[0].h.join_type, rows[0].h.shuffle_bytes, rows[0].h.join_build_size) == ("shuffle", 1_200_000_000, "large")
    assert (rows[1].h.join_type, rows[1].h.shuffle_bytes, rows[1].h.join_build_size) == ("broadcast", 200_000_000, "small")
    assert rows[2].h.partition_pruning is True


def test_fence_and_diff(spark):
    df = spark.createDataFrame([(1, "x ```sql\nSELECT 1\n``` y", "a\nb\n", "a\nc"), (2, "none", "a", None)],
                               "id int, raw string, b string, a string")
    f = {r["id"]: r["f"] for r in df.select("id", QF.extract_fence("raw").alias("f")).collect()}
    assert f == {1: "sql\nSELECT 1", 2: None}
    d = {r["id"]: (r["lines_added"], r["lines_removed"]) for r in QL.line_diff(df, "id", "b", "a").collect()}
    assert d == {1: (1, 1), 2: (None, None)}


def test_validate_reviews(spark):
    df = spark.createDataFrame([('{"recommendations": [], "risk_flags": ["x"], "sql_quality_score": 80, "complexity": "low"}',),
                                ('{"recommendations": [], "risk_flags": [], "sql_quality_score": 120, "complexity": "low"}',),
                                ("not json",)], "review string")
    assert [r["review_valid"] for r in QL.validate_reviews(df).collect()] == [True, False, False]


from hypothesis import given, settings, strategies as st


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcxyz.", min_size=1, max_size=8),
                          st.text(alphabet="abc.", min_size=0, max_size=6)), min_size=1, max_size=8))
def test_mask_email_keeps_domain_and_length(spark, pairs):
    vals = [f"{l}@{d}" for l, d in pairs]
    df = spark.createDataFrame([(v,) for v in vals], "e string")
    out = [r[0] for r in df.select(M.mask_email("e")).collect()]
    for v, m in zip(vals, out):
        local, dom = v.split("@", 1)
        assert len(m) == len(v) and m.endswith("@" + dom) and m[0] == local[0]
        if len(local) > 2:
            assert m[len(local) - 1] == local[-1] and set(m[1:len(local) - 1]) <= {"*"}


def test_line_diff_merge_matches_grouped_changes(spark):
    import random
    from collections import Counter

    rnd = random.Random(3)
    pool = ["select a", "from t", "", "  ", "where x = 1", "join b", "Éte"]
    rows = []
    for i in range(60):
        b = "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))
        a = "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))
        rows.append((i, b, a if i % 7 else None))
    df = spark.createDataFrame(rows, "id int, b string, a string")
    got = {r["id"]: (r["lines_added"], r["lines_removed"]) for r in QL.line_diff(df, "id", "b", "a").collect()}
    ch = {}
    for r in QL.line_changes(df, "id", "b", "a").collect():
        add, rem = ch.get(r["id"], (0, 0))
        ch[r["id"]] = (add + max(r["delta"], 0), rem + max(-r["delta"], 0))
    for i, b, a in rows:
        if a is None:
            assert got[i] == (None, None)
            continue
        cb, ca = Counter(b.splitlines()), Counter(a.splitlines())
        want = (sum((ca - cb).values()), sum((cb - ca).values()))
        assert got[i] == want == ch.get(i, (0, 0))


def test_split_lines_like_splitlines(spark):
    texts = ["a\n\n", "a\n", "\n", "\n\n", "a\r\nb\r\n", "a\n\nb", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["l"] for r in df.select(QL.split_lines("t").alias("l")).collect()]
    assert got == [t.splitlines() for t in texts]
    assert not spark.range(1).select(C.phone_chars_ok(F.lit("555-0101\n")).alias("ok")).first()["ok"]
