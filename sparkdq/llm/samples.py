"""Bounded samples of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _below(label: str, cuts: dict) -> Column:
    keep = F.lit(False)
    for value, cut in cuts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (F.col("draw") <= cut))
    return keep


def _cuts(drawn: DataFrame, label: str, per_class: int, counts: dict) -> dict:
    """The ``per_class``-th lowest draw of every label (the highest, if it has fewer rows).

    Draws are spread evenly over 64 bits, so only rows under twice the expected cut are ranked, however many a label
    has; the room is widened for a label that shows too few there (repeated ids share a draw).
    """
    share = {v: min(1.0, 2 * (per_class + 50) / n) for v, n in counts.items()}
    cuts = {}
    while share:
        room = {v: min(int(s * 2**64) - 2**63, 2**63 - 1) for v, s in share.items()}
        first = F.row_number().over(Window.partitionBy(label).orderBy("draw"))
        near = drawn.filter(_below(label, room)).withColumn("n", first).filter(F.col("n") <= per_class)
        got = {r[0]: (r[1], r[2]) for r in near.groupBy(label).agg(F.count(F.lit(1)), F.max("draw")).collect()}
        cuts |= {v: got[v][1] for v, s in share.items() if v in got and (s >= 1 or got[v][0] >= per_class)}
        share = {v: min(1.0, s * 8) for v, s in share.items() if v not in cuts and s < 1}
    return cuts


def labelled_sample(rows: DataFrame, label: str, per_class: int, max_chars: int, id_col: str = "doc_id", seed: int = 7,
                    labels: DataFrame | None = None) -> tuple[pa.Table, dict]:
    """The ``per_class`` rows of each label whose ids hash lowest, as distinct (label, ``text``), and all labels' row counts.

    Rows are drawn by their ids, whatever their texts, rows without an id (or a table without that column) by their
    texts; the lowest of each label are taken, so every label has some.  A text longer than ``max_chars`` is learned from by a passage of that length
    at a drawn position; it counts like any other.  Rows that share an id are drawn together, at most twice the bound.

    ``labels`` holds (``id_col``, ``label``) when the rows themselves have no label.  Then ids alone meet the labels, and
    only the drawn ones, at most twice ``per_class`` a label, are sent to the texts: no text is shuffled to be drawn.
    """
    texts = rows.filter(F.col("text").isNotNull())
    by_id = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    if labels is not None:
        marked = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label).distinct()
        drawn = texts.select(id_col).join(marked, id_col).select(id_col, label, by_id.alias("draw"))
    else:
        who = F.xxhash64("text", F.lit(seed))  # a place would not be the same in both passes
        if id_col in rows.columns:
            who = F.when(F.col(id_col).isNull(), who).otherwise(by_id)
        drawn = texts.filter(F.col(label).isNotNull()).select(label, "text", who.alias("draw"))
    counts = {r[0]: r[1] for r in drawn.groupBy(label).count().collect()}
    bound = 2 * per_class * max(1, len(counts))
    some = drawn.filter(_below(label, _cuts(drawn.select(label, "draw"), label, per_class, counts)))
    if labels is not None:
        some = texts.select(id_col, "text").join(F.broadcast(some.orderBy("draw", label).limit(bound).distinct()), id_col)
    start = F.pmod(F.xxhash64("draw", F.lit(seed)), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1
    passage = F.substring("text", start.cast("int"), F.lit(max_chars)).alias("text")
    return some.select(label, passage).distinct().orderBy(F.xxhash64("text"), label).limit(bound).toArrow(), counts
