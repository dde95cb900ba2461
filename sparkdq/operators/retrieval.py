"""Exact nearest-document retrieval and document-text handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..sources.io import stored_batches


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group, ``(group, embedding array<double>)``.

    Partial aggregation runs per (group, position) before the shuffle, so a
    hot group costs one buffer per position, not a list of its rows.
    """
    pos = vectors.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
    means = pos.groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(vec_col))


DOCS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 1024


def _matrix(column, dim: int):
    """Rows of a list column of ``dim`` components each."""
    import numpy as np

    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _block_top_k(k: int, metric: str, dim: int):
    """Body of one (document block, query block) pair: each query's ``k`` nearest documents of the block.

    Distances are summed over the dimensions in order, as the Spark expressions do.
    """
    def run(docs, queries):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        if len(docs) and len(queries):
            by_id = pc.sort_indices(docs.column("_did"))  # nulls last
            docs = docs.take(by_id)
            x, q = _matrix(docs.column("_dv"), dim), _matrix(queries.column("_qv"), dim)
            square = lambda m: sum((m[:, j] * m[:, j] for j in range(dim)), np.zeros(len(m)))
            xx = square(x)
            for n in range(len(q)):
                d = np.zeros(len(x))
                for j in range(dim):
                    d += (x[:, j] - q[n, j]) * (x[:, j] - q[n, j]) if metric == "l2" else x[:, j] * q[n, j]
                at = np.arange(len(x))
                if metric == "cosine":
                    length = np.sqrt(xx) * np.sqrt(square(q[n : n + 1])[0])
                    at = np.flatnonzero(length > 0)  # a vector without length has no direction
                    d = 1.0 - d[at] / length[at]
                near = at[np.argsort(d, kind="stable")[:k]]
                out.append((n, near, np.sort(d, kind="stable")[:k]))
        rows = pa.array([n for n, near, _ in out for _ in near], pa.int64())
        picked = pa.array(np.concatenate([near for _, near, _ in out]).astype(np.int64) if out else [], pa.int64())
        distance = pa.array(np.concatenate([d for _, _, d in out]) if out else [], pa.float64())
        return pa.table({"_q": queries.column("_q").take(rows), "_did": docs.column("_did").take(picked), "distance": distance})

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 3, metric: str = "l2", doc_id: str = "vec_id",
          query_id: str = "query_id", vec_col: str = "embedding", docs_per_block: int = DOCS_PER_BLOCK,
          queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The ``k`` nearest documents of every query, ``(query_id, rank, doc_id, distance)``.

    Exact search.  Documents and distinct query vectors are dealt into blocks by
    a hash; every pair of blocks is one group that a task scores with numpy,
    keeping the ``k`` nearest documents per query, and ``row_number() <= k``
    merges those.  Neither side passes through the driver and any number of
    queries takes the same way.  ``metric``: ``l2`` (squared Euclidean) or
    ``cosine`` (1 - cosine similarity; vectors without length are left out).
    Ties go to the smaller document id, null ids last.  Vectors that are missing,
    have a missing or NaN element, or not the queries' length (the most frequent
    one) are skipped.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    whole = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    d = docs.select(F.col(doc_id).alias("_did"), F.col(vec_col).cast("array<double>").alias("_dv")).where(whole(F.col("_dv")))
    q = queries.select(F.col(query_id).alias("_qid"), F.col(vec_col).cast("array<double>").alias("_qv")).where(whole(F.col("_qv")))
    size = q.agg(F.mode(F.size("_qv")), F.count(F.lit(1))).first()
    dim, n_q = size[0] or 0, size[1]
    n_d = d.count()
    d_blocks, q_blocks = -(-n_d // docs_per_block) or 1, -(-n_q // queries_per_block) or 1
    # Equal query vectors have equal hits: each is searched once, under a key made of the vector.
    keyed = q.where(F.size("_qv") == dim).withColumn("_q", F.xxhash64(F.to_json(F.struct("_qv"))))
    once = keyed.select("_q", "_qv").distinct()
    deal = lambda h, n: F.pmod(h, F.lit(n)).cast("int")
    left = d.where(F.size("_dv") == dim).select("_did", "_dv", deal(F.xxhash64("_did", F.to_json(F.struct("_dv"))), d_blocks).alias("_db"),
                                               F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("_qb"))
    right = once.select("_q", "_qv", deal(F.col("_q"), q_blocks).alias("_b2"), F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))).alias("_b1"))
    schema = f"_q bigint, _did {docs.schema[doc_id].dataType.simpleString()}, distance double"
    near = left.groupBy("_db", "_qb").cogroup(right.groupBy("_b1", "_b2")).applyInArrow(_by_value(_block_top_k(k, metric, dim)), schema)
    best = Window.partitionBy("_q").orderBy("distance", F.asc_nulls_last("_did"))
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(keyed.select("_q", "_qid"), "_q").select(F.col("_qid").alias(query_id), "rank", F.col("_did").alias(doc_id), "distance")


def _by_value(function):
    """``function`` so pickled that executors need not have this library on their path."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return function


def flatten_dedupe(df: DataFrame, text_col: str = "text", order_col: str = "doc_id",
                   fields: Sequence[str] = ("document", "text", "content"), with_text: bool = True) -> DataFrame:
    """R2: one row per distinct stripped, non-empty text: ``(order_col, text, n_copies)``.

    A nested text column (array, or array of structs with one of ``fields``)
    is flattened first.  The first-seen row (smallest ``order_col``) is kept.
    Partial aggregation collapses copies map-side, so a text repeated in a
    third of the rows costs one buffer per task.  With ``with_text=False`` the
    result is ``(order_col, n_copies)`` and rows are grouped by the SHA-256
    digest of the stripped text, so the shuffle carries 32 bytes per distinct
    text and task instead of the text itself.
    """
    t = df.schema[text_col].dataType.simpleString()
    x = df
    if t.startswith("array"):
        x = x.select(order_col, F.explode_outer(text_col).alias(text_col))
        t = x.schema[text_col].dataType.simpleString()
    if t.startswith("struct"):
        names = [f for f in fields if f in x.schema[text_col].dataType.fieldNames()]
        x = x.withColumn(text_col, F.coalesce(*[F.col(f"{text_col}.{f}").cast("string") for f in names]))
    s = x.select(
        order_col, strip_ws(F.col(text_col).cast("string")).alias("_t")).where(F.col("_t") != "")
    if not with_text:
        return s.groupBy(F.sha2("_t", 256)).agg(F.min(order_col).alias(order_col),
                                                F.count(F.lit(1)).alias("n_copies")).select(order_col, "n_copies")
    return s.groupBy("_t").agg(F.min(order_col).alias(order_col), F.count(F.lit(1)).alias("n_copies")).select(
        order_col, F.col("_t").alias(text_col), "n_copies")


def combined_text(hits: DataFrame, docs: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id",
                  text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """The texts of each query's hits joined in rank order, ``(query_id, combined_text)``.

    Only the k hits of a query are concatenated (never a whole corpus).
    """
    j = hits.join(docs.select(F.col(doc_id), F.col(text_col)), doc_id)
    return j.groupBy(query_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text_col))), lambda s: s[text_col]),
                     sep).alias("combined_text"))


def read_documents(spark, path: str) -> DataFrame:
    """Whole text files below ``path`` as ``(doc_id, text)``; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def append_documents(new_docs: DataFrame, store: str, batch: str, key: str = "doc_id", order_by: Sequence[str] = ()) -> DataFrame:
    """Add to the Parquet store below ``store`` what ``ingest`` finds new, as the folder of ``batch``; the batch as stored.

    A batch added again is compared with the other batches only and replaces its folder, so a retry stores nothing twice.
    """
    spark = new_docs.sparkSession
    others = [b for b in stored_batches(spark, store) if b != batch]
    if others:
        existing = spark.read.parquet(*[f"{store}/batch={b}" for b in others])
    else:
        existing = new_docs.select(key).where(F.lit(False))
    target = f"{store.rstrip('/')}/batch={batch}"
    ingest(new_docs, existing, key, order_by).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def ingest(new_docs: DataFrame, existing: DataFrame, key: str = "doc_id", order_by: Sequence[str] = ()) -> DataFrame:
    """Documents of ``new_docs`` whose id is not stored yet, one row per new id.

    The first row by ``order_by`` (then by the other columns) is kept.  Append
    the result to the store; an id already present is kept, not replaced.
    """
    from .fixes import drop_duplicates

    fresh = drop_duplicates(new_docs, [key], list(order_by))
    return fresh.join(existing.select(key), key, "left_anti").select(*new_docs.columns)
