"""Line diffs with hunks (Q11): shortest edit scripts by Myers' O(ND) search in linear space.

Both texts of a pair stand in one row, so nothing is shuffled: rows go through Arrow
batches, one pair at a time, and a pair needs memory in proportion to its lines.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .querylog import split_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def middle_snake(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """A run of equal items (x0, y0, x1, y1), perhaps empty, in the middle of a shortest script from ``a`` to ``b``.

    Furthest reaching paths grow from both ends, one edit at a time; where they meet is half of a shortest path.
    """
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    off = most + 1
    ahead, back = [0] * (2 * off + 1), [0] * (2 * off + 1)
    for d in range(most + 1):
        for mine, other, forward in ((ahead, back, True), (back, ahead, False)):
            for k in range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2):
                down = k == -d or k != d and mine[off + k - 1] < mine[off + k + 1]
                x = mine[off + k + 1] if down else mine[off + k - 1] + 1
                x0 = x
                while x < n and x - k < m and (a[x] == b[x - k] if forward else a[n - 1 - x] == b[m - 1 - x + k]):
                    x += 1
                mine[off + k] = x
                far = d - 1 if forward else d
                if bool(delta & 1) == forward and abs(delta - k) <= far and x + other[off + delta - k] >= n:
                    return (x0, x0 - k, x, x - k) if forward else (n - x, m - x + k, n - x0, m - x0 + k)
    raise AssertionError("paths from both ends always meet")


def edits(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """The changed stretches (a0, a1, b0, b1) of a shortest edit script, in order, with equal items between them."""
    gone, new = [False] * len(a), [False] * len(b)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            gone[a0:a1], new[b0:b1] = [True] * (a1 - a0), [True] * (b1 - b0)
        else:
            x0, y0, x1, y1 = middle_snake(a[a0:a1], b[b0:b1])
            todo += [(a0, a0 + x0, b0, b0 + y0), (a0 + x1, a1, b0 + y1, b1)]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        x, y = i, j
        while i < len(a) and gone[i]:
            i += 1
        while j < len(b) and new[j]:
            j += 1
        if (x, y) != (i, j):
            out.append((x, i, y, j))
        else:
            i, j = i + 1, j + 1
    return out


def hunks(a: Sequence[str], b: Sequence[str], context: int = 3) -> list[tuple[int, int, int, int, list[str]]]:
    """Unified hunks (a0, a1, b0, b1, marked lines): changes at most ``2 * context`` equal lines apart share one."""
    groups: list[list] = []
    for e in edits(a, b):
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for g in groups:
        lead, tail = min(context, g[0][0]), min(context, len(a) - g[-1][1])
        lines = [" " + x for x in a[g[0][0] - lead : g[0][0]]]
        for e, following in itertools.zip_longest(g, g[1:]):
            lines += ["-" + x for x in a[e[0] : e[1]]] + ["+" + x for x in b[e[2] : e[3]]]
            lines += [" " + x for x in a[e[1] : following[0] if following else e[1] + tail]]
        out.append((g[0][0] - lead, g[-1][1] + tail, g[0][2] - lead, g[-1][3] + tail, lines))
    return out


def _span(start: int, end: int) -> str:
    """A range of a hunk header: first line and length; an empty range names the line before it."""
    return str(start + 1) if end - start == 1 else f"{start + (end > start)},{end - start}"


HUNKS = "hunk int, before_start bigint, before_lines bigint, after_start bigint, after_lines bigint, removed bigint, added bigint, body string"


def _hunks(context: int):
    def run(batches):
        for b in batches:
            at, out = [], []
            for i, (x, y) in enumerate(zip(b.column("_a").to_pylist(), b.column("_b").to_pylist(), strict=True)):
                for n, (a0, a1, b0, b1, lines) in enumerate(hunks(x, y, context), 1):
                    at.append(i)
                    head = f"@@ -{_span(a0, a1)} +{_span(b0, b1)} @@"
                    out.append((n, a0 + 1, a1 - a0, b0 + 1, b1 - b0, sum(t[0] == "-" for t in lines), sum(t[0] == "+" for t in lines), "\n".join([head, *lines])))
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at, pa.int64())), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]],
                                             names=["_id", *[c.split()[0] for c in HUNKS.split(", ")]])

    return run


def diff_hunks(df: DataFrame, id_col: str, before_col: str, after_col: str, context: int = 3) -> DataFrame:
    """Q11: the unified diff of every row's two texts, one row per hunk: ``id_col`` and the columns of ``HUNKS``.

    Line numbers start at 1.  ``body`` is the hunk as text, its header first; the hunks of a row in order, after the
    two file headers, are its unified diff.  Scripts are shortest; where several are, one is chosen the same way every
    time.  Equal texts give no rows, nor does a row whose text is missing on either side; repeated ids repeat.
    """
    both = df.where(F.col(before_col).isNotNull() & F.col(after_col).isNotNull()).select(
        F.col(id_col).alias("_id"), split_lines(before_col).alias("_a"), split_lines(after_col).alias("_b"))
    schema = T.StructType([both.schema["_id"], *T.StructType.fromDDL(HUNKS).fields])
    return both.mapInArrow(_hunks(context), schema).withColumnRenamed("_id", id_col)
