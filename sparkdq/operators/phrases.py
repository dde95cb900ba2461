"""Phrases of several words in free text (D1, D5): an Aho-Corasick automaton over a term table.

One pass per text and set of terms, whatever their number, and no row per word.  The
terms' bytes are summed before anything is shipped; a table above the bound is dealt
into shards by hash, and each text meets every shard.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SHARD_BYTES = 16_000_000  # of phrases in one automaton


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def normal(text: str) -> str:
    """Lower-cased, white-space runs as one space."""
    return " ".join(text.lower().split())


class Automaton:
    """Finds phrases as whole words, leftmost first, of those that begin together the longest, without overlap."""

    def __init__(self, phrases: Sequence[str]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for p in phrases:
            self.tree.add_word(p, p)
        if len(self.tree):
            self.tree.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int]]:
        """All whole-word matches (begin, end) in a normal text."""
        if not len(self.tree):
            return []
        n = len(text)
        out = []
        for last, p in self.tree.iter(text):
            a, b = last + 1 - len(p), last + 1
            if not (a and is_word(text[a - 1]) and is_word(text[a])) and not (b < n and is_word(text[b]) and is_word(text[b - 1])):
                out.append((a, b))
        return out


def leftmost_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, end = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, b))
            end = b
    return out


def _found(phrases: Sequence[str]):
    def run(batches):
        automaton = Automaton(phrases)
        for b in batches:
            at, names, begins, ends = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                text = normal(t or "")
                spans = automaton.spans(text)
                if spans:
                    at.append(i)
                    begins.append([s[0] for s in spans])
                    ends.append([s[1] for s in spans])
                    names.append([text[x:y] for x, y in spans])
            yield pa.RecordBatch.from_arrays([b.column("group").take(pa.array(at, pa.int64())), b.column("row").take(pa.array(at, pa.int64())),
                                              pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                                             names=["group", "row", "begins", "ends", "names"])

    return run


def _chosen(batches):
    """Per batch the counts of the matches that stay, summed over its texts."""
    for b in batches:
        counts: Counter = Counter()
        coded = pa.array([repr(g) for g in b.column("group").to_pylist()], pa.string()).dictionary_encode()
        first: dict[int, int] = {}
        for i, (g, *spans) in enumerate(zip(coded.indices.to_pylist(), *(b.column(c).to_pylist() for c in ("begins", "ends", "names")), strict=True)):
            first.setdefault(g, i)
            text = {(x, y): p for x, y, p in zip(*spans, strict=True)}
            counts.update((g, text[s]) for s in leftmost_longest(list(text)))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([b.column("group").take(pa.array([first[g] for g, _ in keys], pa.int64())), pa.array([p for _, p in keys], pa.string()),
                                          pa.array([counts[k] for k in keys], pa.int64())], names=["group", "phrase", "n"])


def phrase_counts(df: DataFrame, text_col: str, group_by: Sequence[str], terms: DataFrame, phrase_col: str = "phrase",
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(group_by..., phrase, n)``: how often each phrase of ``terms`` stands in the texts of a group.

    Texts and phrases are lower-cased and white-space runs count as one space.  A phrase matches as whole words (no
    letter, digit or underscore may go on at an end that is one); of matches that overlap the leftmost counts, of those
    that begin together the longest.  Null and blank phrases are ignored, repeated ones count once, null texts hold
    none; groups and phrases without a match have no row.

    The phrases are collected shard by shard, each shard's bytes bounded by ``shard_bytes``; matches of a text's shards
    meet by its row before the overlap rule, so shards do not change the result.
    """
    word = F.trim(F.regexp_replace(F.lower(F.col(phrase_col)), r"\s+", " "))
    distinct = terms.select(word.alias("phrase")).filter("phrase <> ''").distinct()
    size = distinct.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    shards = max(1, -(-size // max(1, shard_bytes // 2)))  # half the bound on average: hashes spread evenly
    group = F.struct(*[F.col(f"`{c}`") for c in group_by])
    rows = df.select(group.alias("group"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["group"], *T.StructType.fromDDL("row bigint, begins array<int>, ends array<int>, names array<string>").fields])
    found = None
    for i in range(shards):
        mine = [r["phrase"] for r in distinct.filter(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == i).collect()]
        part = rows.mapInArrow(_found(mine), schema)
        found = part if found is None else found.unionByName(part)
    if shards > 1:
        found = found.groupBy("group", "row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "names")])
    counted = found.mapInArrow(_chosen, T.StructType([rows.schema["group"]]).add("phrase", "string").add("n", "long"))
    return counted.groupBy("group", "phrase").agg(F.sum("n").alias("n")).select("group.*", "phrase", "n")
