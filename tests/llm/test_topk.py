import math
import random

import pytest
from pyspark.sql import functions as F

from sparkdq.llm import topk_search as ts


def brute(rows, k):
    ints = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.append((i, [math.floor(256 * x) for x in v]))
    out = set()
    for n, (i, v) in enumerate(ints):
        if i is not None and i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j if j is not None else 0, j) for m, (j, w) in enumerate(ints) if m != n]
            out |= {(i, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)}
    return out


def run(spark, rows, k=5, **limits):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ts.top_k(df, F.col("vec_id") % 50 == 0, k, **limits).collect()
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})
    return {(r.query_id, r["rank"], r.id, r.score) for r in got}


@pytest.mark.parametrize("limits", [{}, {"candidates": 60, "queries": 2, "bins": 8}])
def test_against_brute_force(spark, limits):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(320)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a third alike: ties at the top of a query that resembles them
    rows += [(2000, [1.0] * 6), (2001, None), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [0.3, 0.3]), (2050, None), (None, [0.5] * 6)]
    assert run(spark, rows, **limits) == brute(rows, 5)


def test_few_rows_large_values_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e6, -3.0]), (2, [1e6, -3.0]), (50, [-1e6, 5e5])]
    assert run(spark, rows) == brute(rows, 5)  # fewer than k others; products past 2 ** 53
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, []) == set() and run(spark, [(1, [1.0]), (2, [2.0])]) == set()
    assert run(spark, [(0, [0.0] * 3), (1, [0.0] * 3), (3, [0.0] * 3)], k=1) == {(0, 1, 1, 0)}
