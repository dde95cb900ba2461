"""Exact top-k search by distributed histogram selection.

All vectors are dealt into candidate blocks and the queries into query blocks;
every (candidate block, query block) pair is scored in one task as a matrix
product.  A round counts the scores of each query in equal-width bins; the bins'
global sums show which bin holds the k-th score, and the next round refines that
bin, until a bin is one integer: the k-th value.  A last pass keeps the scores
at or above it and breaks ties by the smaller id.  A block leaves out bins below
its own k-th score, which can't hold the global one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

CANDIDATES, QUERIES, BINS = 4096, 2048, 4096  # rows per block, queries per block, bins per round
EXACT = 1 << 53  # integers below are exact in double arithmetic


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, x as double; null for vectors that are null or hold null or non-finite parts."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * 256)))


def matrix(column: pa.ChunkedArray, dim: int, exact: bool) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``dim``; as doubles when products stay exact, else as Python integers."""
    lists = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.Array) else column.combine_chunks()
    lens = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), dim), np.float64 if exact else object)
    row = np.repeat(np.arange(len(lists)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat if exact else flat.astype(object)
    return out


def blocks_of_scores(cands: pa.Table, queries: pa.Table, dim: int, exact: bool):
    """(first query, scores as integers, mask of the query's own row) for a few queries at a time."""
    c, q = matrix(cands.column("v"), dim, exact), matrix(queries.column("q_v"), dim, exact)
    row, own = cands.column("row").to_numpy(), queries.column("q_row").to_numpy()
    for lo in range(0, len(q), 64):
        scores = q[lo : lo + 64] @ c.T
        yield lo, scores.astype(np.int64) if exact else scores, own[lo : lo + 64, None] == row[None, :]


def _histogram(dim: int, exact: bool, bins: int):
    def run(cands: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        if len(cands) and len(queries):
            low, span, width, need, row = (queries.column(x).to_numpy() for x in ("low", "span", "width", "need", "q_row"))
            for lo, scores, own in blocks_of_scores(cands, queries, dim, exact):
                n = len(scores)
                above_low = scores - low[lo : lo + n, None]
                inside = (above_low >= 0) & (above_low < span[lo : lo + n, None]) & ~own
                at = above_low // width[lo : lo + n, None]
                flat = (np.arange(n)[:, None] * bins + at)[inside].astype(np.int64)
                counts = np.bincount(flat, minlength=n * bins).reshape(n, bins)
                above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
                i, b = np.nonzero((counts > 0) & (above < need[lo : lo + n, None]))
                for o, v in zip(out, (row[lo + i], b, counts[i, b]), strict=True):
                    o.append(v)
        return pa.table({n: pa.array(np.concatenate(o), pa.int64()) for n, o in zip(("row", "bin", "n"), out, strict=True)})

    return run


def _select(dim: int, exact: bool):
    def run(cands: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(cands) and len(queries):
            least, need, row = (queries.column(x).to_numpy() for x in ("low", "need", "q_row"))
            ids = cands.column("id").combine_chunks()
            by_id = pc.sort_indices(ids).to_numpy()  # nulls last
            for lo, scores, own in blocks_of_scores(cands, queries, dim, exact):
                for j in range(len(scores)):
                    s, mine = scores[j][by_id], ~own[j][by_id]
                    over, tied = np.flatnonzero((s > least[lo + j]) & mine), np.flatnonzero((s == least[lo + j]) & mine)[: need[lo + j]]
                    got = np.concatenate([over, tied])
                    out[0].append(np.full(len(got), row[lo + j]))
                    out[1].append(by_id[got])
                    out[2].append(s[got].astype(np.int64))
            picked = pa.array(np.concatenate(out[1]).astype(np.int64))
            return pa.table({"row": np.concatenate(out[0]).astype(np.int64), "id": ids.take(picked), "score": np.concatenate(out[2])})
        return pa.table({"row": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS,
          candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other rows.

    ``is_query`` is a condition on ``vectors``.  Returns ``query_id``, ``rank`` (from 1), ``id`` and ``score``; fewer
    than ``k`` rows for a query only if there are fewer other rows.  Ties go to the smaller id, null ids last.  A row
    is told from its copies by its place in a written table, so copies of a query's row are its candidates.  Vectors
    that are null or hold null or non-finite components take no part; a shorter vector counts as ending in zeros.
    """
    part = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"),
                          quantised(F.col(f"`{vector_col}`")).alias("v")).filter("v IS NOT NULL")
    table = written(part.withColumn("row", F.monotonically_increasing_id()))
    n, asked, dim, most = table.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dim, most, c_blocks, q_blocks = dim or 0, int(most or 0), -(-n // candidates) or 1, -(-asked // queries) or 1
    bound = dim * most * most
    exact = bound < EXACT
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    cands = table.select("id", "row", "v", deal(c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    asking = table.filter("q").select("row", "v", deal(q_blocks).alias("qb"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("q_cb")
    bound = min(bound, (1 << 62) - 1)
    width = -(-(2 * bound + 1) // bins)
    state = table.filter("q").select("row", F.lit(-bound).cast("bigint").alias("low"),
                                              F.lit(2 * bound + 1).cast("bigint").alias("span"), F.lit(width).cast("bigint").alias("width"), F.lit(k).cast("bigint").alias("need"))

    def pairs(function, ddl: str) -> DataFrame:
        mine = asking.join(state, "row").select(F.col("row").alias("q_row"), F.col("v").alias("q_v"), F.col("qb").alias("q_qb"),
                                                "low", "span", "width", "need", spread)
        return cands.groupBy("cb", "qb").cogroup(mine.groupBy("q_cb", "q_qb")).applyInArrow(function, ddl)

    while n and asked:
        counts = pairs(_histogram(dim, exact, bins), "row bigint, bin bigint, n bigint").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin"))
        hit = (counts.withColumn("upto", F.sum("n").over(down)).join(state, "row")
               .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
               .select("row", "bin", (F.col("upto") - F.col("n")).alias("above")))
        finer = -(-width // bins)
        # A query with fewer than k other rows has no k-th score: it keeps the lowest bound, which admits every score,
        # and its empty span takes no part in later rounds.
        state = written(state.join(hit, "row", "left").select(
            "row", F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.col("low") + F.col("bin") * F.col("width")).alias("low"),
            F.when(F.col("bin").isNull(), F.lit(0)).otherwise(F.lit(width)).cast("bigint").alias("span"), F.lit(finer if width > 1 else 1).cast("bigint").alias("width"), (F.col("need") - F.coalesce("above", F.lit(0))).alias("need")))
        if width == 1:
            break
        width = finer
    found = pairs(_select(dim, exact), "row bigint, id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(table.filter("q").select("row", F.col("id").alias("query_id")), "row").select("query_id", F.col("rank").cast("int"), "id", "score")
