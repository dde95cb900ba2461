import random
from collections import defaultdict

from sparkdq.llm import line_dedup


def brute(rows, least_chars=40, least_docs=5):
    """(id, text) rows in table order -> (n_lines, n_dropped, kept text) of each."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for _, t in rows]
    where = defaultdict(set)
    for i, lines in enumerate(split):
        for x in lines:
            if len(key(x)) >= least_chars:
                where[key(x)].add(i)
    last = {k: max(v, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)) for k, v in where.items() if len(v) >= least_docs}
    out = []
    for i, lines in enumerate(split):
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    got = line_dedup.line_dedup(docs, carry=["n"], **how).applied().collect()
    return [r[1:] for r in sorted(((r.row.n, r.n_lines, r.n_dropped, r.text) for r in got))]


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"{c * 20} shared line number {c * 19}" for c in "abcdefgh"] + ["short"] * 3 + [""]
    vary = [lambda x: x, str.upper, lambda x: f" \t{x}\x0c ", lambda x: x + "!"]
    rows = [(i // 2 if i % 7 else None, "\n".join(rnd.choice(vary)(rnd.choice(pool)) for _ in range(rnd.randrange(0, 9)))) for i in range(60)]
    rows += [(3, None), (4, ""), (5, "\n\n"), (59, "\n".join([pool[0]] * 40_000)), (58, "é" * 40), *[(i, "É" * 40 + "\n" + "é" * 40) for i in range(50, 56)]]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_chars=1, least_docs=2) == brute(rows, 1, 2)


def test_one_line_in_every_document_and_many_parts(spark):
    line = "this line stands in every single document of the table"
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('{line}', char(10), 'own ', id) AS text").repartition(17)
    got = {r.row.doc_id: (r.n_dropped, r.text) for r in line_dedup.line_dedup(docs).applied().collect()}
    assert got == {i: (int(i < 2999), f"own {i}" if i < 2999 else f"{line}\nown {i}") for i in range(3000)}


def test_keep_bitmaps_lose_nothing_else(spark):
    import numpy as np
    import zlib

    text = "a\nb\n\nc"
    keep = zlib.compress(np.packbits([1, 0, 1, 1], bitorder="little").tobytes())
    assert line_dedup.kept_lines(text, keep) == ["a", "", "c"] and line_dedup.kept_lines(text, None) == text.split("\n")


def test_odd_documents_and_empty_table(spark, odd_docs, no_docs):
    found = line_dedup.line_dedup(odd_docs, carry=odd_docs.columns)
    got = found.applied().collect()
    assert len(got) == odd_docs.count()
    for r in got:  # no line is in five documents
        assert (r.text, r.n_dropped, r.n_lines) == (r.row.text or "", 0, (r.row.text or "").count("\n") + 1)
    assert line_dedup.line_dedup(no_docs).applied().count() == 0
