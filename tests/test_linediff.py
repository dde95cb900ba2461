import difflib
import random

from sparkdq.operators import linediff as ld
from sparkdq.plans import registry


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def rebuilt(a, parts):
    """The new text from the old one and its hunks, checking every kept and removed line."""
    out, at = [], 0
    for a0, a1, b0, b1, lines in parts:
        out += a[at:a0]
        assert len(out) == b0
        assert [x[1:] for x in lines if x[0] in " -"] == a[a0:a1]
        out += [x[1:] for x in lines if x[0] in " +"]
        assert len(out) == b1
        at = a1
    return out + a[at:]


def test_scripts_are_shortest_and_rebuild_the_text():
    rnd = random.Random(2)
    for _ in range(1500):
        letters = "ab" if rnd.random() < 0.5 else "abcdefgh"
        a, b = ([rnd.choice(letters) for _ in range(rnd.randrange(0, 14))] for _ in range(2))
        changes = ld.edits(a, b)
        assert sum(e[1] - e[0] + e[3] - e[2] for e in changes) == len(a) + len(b) - 2 * lcs(a, b), (a, b)
        for context in (0, 1, 3):
            assert rebuilt(a, ld.hunks(a, b, context)) == b


def test_unique_shortest_scripts_equal_difflib(spark):
    rnd, rows = random.Random(4), [(0, None, "x"), (1, "x", None), (2, "same\ntext", "same\ntext"), (3, "", "new"), (4, "old", ""), (5, "a\r\nb", "a\nb\n")]
    for i in range(6, 60):
        a = [f"line {j} {rnd.random()}" for j in range(rnd.randrange(1, 60))]  # all different: one shortest script
        b = [x if rnd.random() < 0.85 else f"changed {rnd.random()}" for x in a if rnd.random() > 0.1]
        for _ in range(rnd.randrange(3)):
            b.insert(rnd.randrange(len(b) + 1), f"new {rnd.random()}")
        rows.append((i, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows, "id int, before string, after string").repartition(3)
    got = {}
    for r in sorted(ld.diff_hunks(df, "id", "before", "after").collect(), key=lambda r: (r.id, r.hunk)):
        got.setdefault(r.id, []).extend(r.body.split("\n"))
    want = {i: list(difflib.unified_diff(a.splitlines(), b.splitlines(), "before.sql", "after.sql", lineterm=""))[2:] for i, a, b in rows if a is not None and b is not None}
    assert got == {i: d for i, d in want.items() if d}


def test_long_texts_need_little_memory():
    a = [str(i) for i in range(60_000)]
    b = a[:100] + ["x"] + a[101:30_000] + a[30_005:] + ["end"]
    assert ld.edits(a, b) == [(100, 101, 100, 101), (30_000, 30_005, 30_000, 30_000), (60_000, 60_000, 59_995, 59_996)]


def test_registered_query_rebuilds_every_rewrite(spark):
    from sparkdq.plans import querylog_queries as q

    sf = "/root/testdata/sf0.001"
    texts = {r.query_id: (r.original_sql, r.rewritten_sql) for r in q.fixture(spark, sf, "query_log").collect()}
    got = {}
    for r in registry.QUERIES["q_diff_hunks"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.before_start - 1, r.before_start - 1 + r.before_lines, r.after_start - 1, r.after_start - 1 + r.after_lines, r.body.split("\n")[1:]))
    assert got
    for i, (a, b) in texts.items():
        if a is not None and b is not None:
            assert rebuilt(a.splitlines(), sorted(got.get(i, []), key=lambda h: h[0])) == b.splitlines()
