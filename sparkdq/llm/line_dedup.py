"""Line dedup by range-partitioned hashes; the answer is a bitmap per document, not text.

1. Rows are staged where they are read, with the 128-bit hash of every line's key.
2. Each part sends one message per distinct hash: how many of its documents hold the
   line, and the largest of them.  A line that a third of all documents share is
   one message per part.
3. Messages are dealt by ranges of the hash and sorted by hash, then by document and
   position, last first.  One pass over a range meets every hash's first
   occurrence in that order, the one that stays, and counts documents; when they
   reach the threshold the parts are told which document stays.
4. The parts turn the answers into one compressed keep bitmap per document that loses
   a line.  Texts never leave their part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import PART, POS, shuffle_partitions, stage, written

LEAST_CHARS, LEAST_DOCS = 40, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """Lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def line_hash(key: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def messages(staged: DataFrame) -> DataFrame:
    """``hash``, ``_part``, ``docs`` (documents of the part that hold it) and ``last`` (id and place of the largest); not shuffled."""
    held = staged.select(PART, POS, "id", F.explode(F.array_distinct("hashes")).alias("hash"))
    return held.groupBy(PART, "hash").agg(F.count("*").alias("docs"), F.max(F.struct("id", POS)).alias("last"))


def _first_occurrences(least_docs: int):
    """Of a sorted range: the messages of every hash that enough documents hold, with the document that stays."""

    def run(batches):
        hash_, held, stays, docs = None, [], None, 0
        for b in batches:
            out = []
            for h, part, pos, n in zip(*(b.column(c).to_pylist() for c in ("hash", PART, POS, "docs")), strict=True):
                if h != hash_:
                    hash_, held, stays, docs = h, [], (part, pos), 0
                docs += n
                if docs < least_docs:
                    held.append(part)  # fewer than least_docs messages
                else:
                    out += [(p, h, *stays) for p in [*held, part]]
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                                             names=[PART, "hash", "stays_part", "stays_pos"])

    return run


def _bitmaps(t: pa.Table, answers: pa.Table) -> pa.Table:
    """Compressed keep bitmaps of one part's documents, by position; null for a document that keeps every line."""
    part, keeps = 0, []
    if len(answers) and len(t):
        part = t.column(PART)[0].as_py()
        stays = dict(zip(answers.column("hash").to_pylist(), zip(*(answers.column(c).to_pylist() for c in ("stays_part", "stays_pos")), strict=True), strict=True))
        keeps = [None] * (max(t.column(POS).to_pylist()) + 1)
        for pos, n, at, hashes in zip(*(t.column(c).to_pylist() for c in (POS, "n_lines", "at", "hashes")), strict=True):
            gone = [i for i, h in zip(at, hashes, strict=True) if stays.get(h, (part, pos)) != (part, pos)]
            if gone:
                keep = np.ones(n, bool)
                keep[gone] = False
                keeps[pos] = zlib.compress(np.packbits(keep, bitorder="little").tobytes())
    return pa.table({PART: pa.array([part] * bool(keeps), pa.int64()), "keeps": pa.array([keeps] * bool(keeps), pa.list_(pa.binary()))})


class LineDedup:
    """``rows``: staged ``row``, ``id``, ``text``, ``n_lines``; ``bitmaps``: per ``_part`` the keep bitmaps of its documents by ``_pos``."""

    def __init__(self, rows: DataFrame, bitmaps: DataFrame):
        self.rows, self.bitmaps = rows, bitmaps

    def applied(self) -> DataFrame:
        """``row``, ``n_lines`` (before), ``n_dropped`` and ``text``, the kept lines joined by a line feed.  Rows are met in place."""
        b = self.bitmaps.withColumnRenamed(PART, "_bpart").hint("shuffle_hash")
        j = self.rows.join(b, self.rows[PART] == b["_bpart"], "left").select("row", "n_lines", "text", F.get("keeps", F.col(POS).cast("int")).alias("keep"))
        schema = T.StructType([self.rows.schema["row"], *T.StructType.fromDDL("n_lines bigint, n_dropped bigint, text string").fields])
        return j.mapInArrow(_apply, schema)


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    parts = text.split("\n")
    if keep is None:
        return parts
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(parts), bitorder="little").tolist()
    return [p for p, k in zip(parts, bits, strict=True) if k]


def _apply(batches):
    for b in batches:
        kept = [kept_lines(t or "", k) for t, k in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), strict=True)]
        n = b.column("n_lines").to_numpy()
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_lines"), pa.array(n - np.fromiter(map(len, kept), np.int64, len(kept))),
                                          pa.array(map("\n".join, kept), pa.string())], names=["row", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
               least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> LineDedup:
    """Keep bitmaps of the documents whose lines other documents hold too.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at least ``least_chars``
    code points found in at least ``least_docs`` documents stay only in the document with the largest id, there in all
    its lines.  Every row is a document of its own; null ids are smallest, and of rows that share the largest id the
    last of the staged table keeps the line.  Null and empty texts are one empty line, which is never dropped.  An
    empty table gives no rows.  ``carry`` columns travel in the struct ``row``, so any names are safe.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*[col(c) for c in carry or [id_col]]).alias("row"), col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    split = lines(F.col("text"))
    long = F.filter(F.transform(split, lambda line, i: F.struct(i.alias("i"), key(line).alias("key"))), lambda x: F.length(x["key"]) >= least_chars)
    rows = rows.withColumn("long", long).select("row", "id", "text", F.size(split).cast("bigint").alias("n_lines"), F.col("long.i").alias("at"),
                                                F.transform("long.key", line_hash).alias("hashes"))
    staged = stage(rows)
    ranged = written(messages(staged)).repartitionByRange(shuffle_partitions(spark), "hash").sortWithinPartitions(
        "hash", F.col("last.id").desc_nulls_last(), F.col(PART).desc())
    answers = ranged.select("hash", PART, f"last.{POS}", "docs").mapInArrow(
        _first_occurrences(least_docs), f"{PART} bigint, hash binary, stays_part bigint, stays_pos bigint")
    found = staged.select(PART, POS, "n_lines", "at", "hashes").groupBy(PART).cogroup(answers.groupBy(PART)).applyInArrow(
        _bitmaps, f"{PART} bigint, keeps array<binary>")
    return LineDedup(staged, written(found))
