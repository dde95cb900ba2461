"""Runs of repeated words by string synchronising sets.

A *run* is a stretch of words with smallest period q, at least four periods long,
that can't be extended on either side.  Texts become word numbers, texts after one
another with a border that equals nothing.

* Small periods (under ``SMALL``) are found by comparing the words with themselves,
  shifted by each of them.
* At every dyadic scale s = SMALL, 2 SMALL, ... a synchronising set is selected:
  position i is in it when the least hash of the length-s contexts at i .. i+s is
  that of i or of i+s.  Contexts of a period up to s/4 take no part: they lie in the
  runs of smaller periods found before, so these regions add no positions.  Whether
  i is selected depends on the 2s words from i alone, and every s positions hold one
  unless the 3s - 1 words there have such a small period.
* A run of period q with s <= q < 2s therefore holds a selected position i among its
  first s, and i + q is the next one with an equal context of 2s words.  So
  neighbouring selected positions of equal context propose (i, distance), each
  proposal is extended word by word to its whole run, and none is missed.

Hashes only select and propose: equal contexts have equal hashes, and a collision
merely proposes what the extension then refutes.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import trimmed

SMALL = 8  # periods below are found by shifting; the first scale; a power of two
EXPONENT, LEAST = 4, 6
BYTES_AT_ONCE = 1_000_000
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m, step = x, 1
    while 2 * step <= width:
        m, step = np.minimum(m[:-step], m[step:]), 2 * step
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def small_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (begin, end, period) of periods under SMALL and at least EXPONENT periods long."""
    out, seen = [], set()
    for q in range(1, SMALL):
        if len(words) < EXPONENT * q:
            break
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        begin, end = turn[::2], turn[1::2] + q
        for b, e in zip(*(x[end - begin >= EXPONENT * q].tolist() for x in (begin, end)), strict=True):
            if (b, e) not in seen:  # else a smaller period of the same stretch
                seen.add((b, e))
                out.append((b, e, q))
    return out


def agreement(words: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many words agree from ``a`` and ``b`` on, in direction ``step``; at most ``limit``."""
    done, block = 0, 64
    while done < limit:
        n = min(block, limit - done)
        x, y = (words[p + done : p + done + n] if step > 0 else words[p - done - n + 1 : p - done + 1][::-1] for p in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, block = done + n, 4 * block
    return done


def extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch of ``period`` around ``at`` and ``at + period``."""
    right = agreement(words, at, at + period, len(words) - at - period, 1)
    left = agreement(words, at - 1, at - 1 + period, at, -1)
    return at - left, at + period + right


def synchronising_set(context: np.ndarray, scale: int, omitted: np.ndarray) -> np.ndarray:
    """Selected positions, from the hashes of all contexts of ``scale`` words and the highly periodic ones among them."""
    hashed = mixed(context)
    hashed[omitted] = _LAST
    if len(hashed) <= scale:
        return np.empty(0, np.int64)
    least = sliding_minimum(hashed, scale + 1)
    chosen = (least == hashed[: len(least)]) | (least == hashed[scale:])
    return np.flatnonzero(chosen & (least != _LAST))


def runs_of(words: np.ndarray, lens: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (begin, end, period) of texts laid after one another, ``lens`` words each, last border included.

    ``words``: word numbers; each text's last is a border that equals no other number.
    """
    found = small_runs(words)
    scale = SMALL
    begin = np.cumsum(lens) - lens
    while True:
        long = lens > EXPONENT * scale  # borders not counted: texts that can hold a run of this scale
        if not long.any():
            return found
        # Only these texts, with their places in the whole.
        size = lens[long]
        shift = np.repeat(begin[long] - (np.cumsum(size) - size), size)
        here = np.arange(len(shift)) + shift
        part = words[here]
        context, width = mixed(part.astype(np.uint64) + np.uint64(1)), 1
        while width < scale:
            context, width = mixed(context[:-width] * np.uint64(3) + context[width:]), 2 * width
        omitted = np.zeros(len(context), bool)
        for b, e, q in found:
            if q <= scale // 4 and e - b >= scale:
                x = np.searchsorted(here, b)
                if x < len(here) and here[x] == b:
                    omitted[x : x + e - b - scale + 1] = True
        chosen = synchronising_set(context, scale, omitted)
        chosen = chosen[chosen + 2 * scale <= len(part)]
        double = mixed(context[chosen] * np.uint64(3) + context[chosen + scale])
        order = np.argsort(double, kind="stable")
        double, at = double[order], chosen[order]
        gap = np.diff(at)
        pair = np.flatnonzero((double[1:] == double[:-1]) & (gap >= scale) & (gap < 2 * scale))
        proposed = sorted(zip(gap[pair].tolist(), at[pair].tolist(), strict=True))
        period, until = 0, 0
        for q, i in proposed:
            if q == period and i + q <= until:  # inside the stretch just found
                continue
            b, e = extended(part, i, q)
            period, until = q, e
            if e - b >= EXPONENT * q and e - b >= q + 2 * scale and is_smallest(part, b, q):
                found.append((b + int(shift[b]), e + int(shift[b]), q))
        scale *= 2


def is_smallest(words: np.ndarray, begin: int, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller one: a smaller would divide it."""
    one = words[begin : begin + 2 * period]
    return not any(period % d == 0 and np.array_equal(one[:-d], one[d:]) for d in range(1, period // 2 + 1) if period % d == 0)


# Per text ---------------------------------------------------------------------------------------

def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The contract's change of texts whose id hashes to a multiple of ten: words from ``a`` on repeat with period ``p``."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    one = words[a : a + p]
    return words[:a] + (one * (-(-(n - a) // p)))[: n - a]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run (start, length, period) with the greatest length / period, exactly; ties: smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        left, right = r[1] * best[2], best[1] * r[2]
        if left > right or left == right and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return list(itertools.compress(words, keep.tolist()))


SCHEMA = "n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, best int, collapsed string"


def _find(change):
    def run(batches):
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
            at = 0
            while at < len(b):
                lo, size, rows = at, 0, []
                while at < len(b) and (size < BYTES_AT_ONCE or at == lo):
                    size += len(texts[at] or b"")
                    rows.append(change((texts[at] or b"").split(), ids[at]))
                    at += 1
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, at - lo), *_columns(rows)],
                                                 names=["row", "n_words", "starts", "lengths", "periods", "best", "collapsed"])

    return trimmed(run)


def _columns(rows: list[list[bytes]]) -> list[pa.Array]:
    lens = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for r in rows for w in [*r, None] if w is not None), np.int64, int(lens.sum()) - len(rows))
    border = np.cumsum(lens) - 1
    whole = np.empty(int(lens.sum()), np.int64)
    is_word = np.ones(len(whole), bool)
    is_word[border] = False
    whole[is_word], whole[border] = words, len(number) + np.arange(len(rows))
    found: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    runs = runs_of(whole, lens)
    for (b, e, q), text in zip(runs, np.searchsorted(border, [r[0] for r in runs], "left").tolist(), strict=True):
        if e - b >= LEAST:
            start = b - int(border[text]) + int(lens[text]) - 1
            found[text].append((start, e - b, q))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    lists = [pa.array([[r[i] for r in f] for f in found], pa.list_(pa.int64())) for i in range(3)]
    best = [f.index(longest(f)) if f else None for f in found]
    kept = [b" ".join(without_repeats(r, f)).decode() for r, f in zip(rows, found, strict=True)]
    return [pa.array(lens - 1), *lists, pa.array(best, pa.int32()), pa.array(kept, pa.string())]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                  change=lambda words, doc_id: words) -> DataFrame:
    """All runs of every whole text's words (split at ASCII white space), and the text without their repeats.

    Returns ``row`` (struct of ``carry``, default the id), ``n_words``, ``starts`` (numbers of first words), ``lengths``
    and ``periods`` by start, then period, ``best`` (the place in these lists of the run with the greatest length /
    period; ties: smallest start, then period; null without runs) and ``collapsed`` (kept words joined by one space).
    ``change(words, id)`` may replace a text's words first.  Null and empty texts have no words, no runs and an empty
    ``collapsed``.  Rows are independent, so repeated rows and ids give repeated results; carried columns travel in a
    struct, so any names are safe.  Empty tables give no rows.  One pass, no shuffle: texts of about 1 MB are taken
    together, a longer one alone.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*[col(c) for c in carry or [id_col]]).alias("row"), col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(change), T.StructType([rows.schema["row"], *T.StructType.fromDDL(SCHEMA).fields]))


def run_facts(docs: DataFrame) -> DataFrame:
    """Per document the figures of the contract, from the operator's lists."""
    found = periodic_runs(docs, carry=["doc_id"], change=planted)
    places = F.sequence(F.lit(0), F.size("starts") - 1)
    line = lambda i: F.concat_ws(",", *[F.get(c, i) for c in ("starts", "lengths", "periods")])
    lines = F.when(F.size("starts") > 0, F.concat(F.array_join(F.transform(places, line), "\n"), F.lit("\n"))).otherwise("")
    start, length, period = (F.get(c, F.col("best")) for c in ("starts", "lengths", "periods"))
    return found.select("row.doc_id", F.size("starts").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                        F.expr("1000 * get(lengths, best) DIV get(periods, best)").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
