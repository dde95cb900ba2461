"""Divergence of sources by their terms, kept by iceberg prefix refinement.

1. Every task turns its texts into *parts*: the sorted distinct terms of a chunk of
   texts of one language, the documents of each, and how often.  A chunk's terms are
   cut into several parts between first prefixes, so that later steps hold little at a
   time.  A prefix' documents of a chunk are in one part, so distinct-document counts
   add up over parts.
2. Level by level (byte prefixes of 4, 8, 16, ...) each part counts the documents of
   every prefix of its remaining terms; counts are summed over parts, and prefixes
   below the threshold are discarded, with every term that begins with them.  Parts
   learn the outcome as bitmaps.  A term no longer than the prefix is complete; the
   last level leaves exactly the complete kept terms.
3. Counts of kept terms go, one row per part and term, to blocks of terms, which merge
   them into one row per term with the count of every source.
4. Totals give the smoothed integer shares p and q.  Each block compares all sources of
   its language over its terms and returns sums per pair of sources and its own best
   terms per source, so neither a language nor a source is gathered in one task.

All arithmetic is in integers: shares in decimals, differences in 64 bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import PART, POS, bitmaps, stage, trimmed, written

LEAST_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
FIRST_BYTES = 4  # the first level; each next one doubles it
CHUNK_WORDS = 5_000_000
READ_BYTES = 4 << 20  # of text cut into words at once
PART_POSTINGS = 1 << 18  # pairs of term and document in a part, more if its one first prefix has more
ROWS_PER_BLOCK = 50_000
CELLS = 1 << 18  # sources x terms compared at once
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Numbers(dict):
    """Distinct values numbered as they come."""

    def __missing__(self, value) -> int:
        n = self[value] = len(self)
        return n


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of ASCII letters and characters above U+007F, A-Z lower-cased, in UTF-8: those of all texts, and how many each text has."""
    joined = np.frombuffer(b"".join([b" ", b" ".join(texts), b" "]).translate(_TERM_BYTES), np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, borders + 1))


# Parts ------------------------------------------------------------------------------------------

class _Chunk:
    """Texts of one language that a task has read."""

    def __init__(self):
        self.sources = Numbers()
        self.words, self.lens, self.of = [], [], []

    def add(self, sources: list[str], texts: list[bytes]) -> None:
        words, lens = words_of(texts)
        self.words.append(words)
        self.lens.append(lens)
        self.of += map(self.sources.__getitem__, sources)

    def _postings(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sorted terms, where the documents of each begin, these, how often, and the source of each document.

        Documents are numbered by source, so that a term's documents of one source lie together.
        """
        words = pa.chunked_array(self.words).unify_dictionaries()
        self.words.clear()
        names = words.chunk(0).dictionary
        order = pc.sort_indices(names)
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(len(names))
        lens, of = np.concatenate(self.lens), np.array(self.of, np.int64)
        by_source = np.argsort(of, kind="stable")
        number = np.empty(len(of), np.int32)
        number[by_source] = np.arange(len(of))
        packed = np.empty(len(words), np.int64)
        at = 0
        for c in words.chunks:
            packed[at : at + len(c)] = place[c.indices.to_numpy()]
            at += len(c)
        del words, c, place
        packed <<= 32
        packed |= np.repeat(number, lens)
        packed.sort()
        first = np.flatnonzero(np.append(packed[:1] >= 0, packed[1:] != packed[:-1]))
        times = np.diff(np.append(first, len(packed))).astype("<i4")
        packed = packed[first]
        docs = (packed & 0xFFFFFFFF).astype("<i4")
        packed >>= 32
        starts = np.append(np.flatnonzero(np.append(packed[:1] >= 0, packed[1:] != packed[:-1])), len(packed))
        return names.take(order), starts, docs, times, of[by_source]

    def columns(self, postings: int):
        """Columns of each part of about so many postings.  The first has all sources of the chunk, the others those of their terms."""
        names, starts, docs, times, of = self._postings()
        sources = list(self.sources)
        first = pc.binary_slice(names, 0, FIRST_BYTES)
        free = np.append(0, np.flatnonzero(pc.not_equal(first[1:], first[:-1]).to_numpy(zero_copy_only=False)) + 1)  # a part may begin there
        cuts = free[np.flatnonzero(np.diff(starts[free] // postings, prepend=-1))]
        for lo, hi in itertools.pairwise([*cuts.tolist(), len(names)]):
            some, at = names[lo:hi], slice(starts[lo], starts[hi])
            used = np.zeros(len(of), bool)
            used[docs[at]] = True
            mine = of[used]
            held = np.unique(mine) if lo else np.arange(len(sources))
            size = pc.binary_length(some).to_numpy(zero_copy_only=False)
            yield {"terms": b"".join(listed := some.to_pylist()), "ends": np.cumsum(size).astype("<i4").tobytes(),
                   "common": common(listed).astype("<i4").tobytes(), "starts": (starts[lo : hi + 1] - starts[lo]).astype("<i4").tobytes(),
                   "docs": (np.cumsum(used) - 1)[docs[at]].astype("<i4").tobytes(), "times": times[at].tobytes(),
                   "of": np.searchsorted(held, mine).astype("<i4").tobytes(), "sources": [sources[i] for i in held.tolist()]}


def common(names: list[bytes], width: int = 32) -> np.ndarray:
    """How many first bytes each of the sorted terms shares with the one before it."""
    if not names:
        return np.empty(0, np.int64)
    m = np.array(names, f"S{width}").view(np.uint8).reshape(len(names), width)  # terms hold no zero byte, which is the filling
    out = np.zeros(len(names), np.int64)
    out[1:] = np.logical_and.accumulate((m[1:] == m[:-1]) & (m[1:] > 0), axis=1).sum(1)
    for i in np.flatnonzero(out == width).tolist():
        x, y = names[i - 1], names[i]
        while out[i] < min(len(x), len(y)) and x[out[i]] == y[out[i]]:
            out[i] += 1
    return out


PARTS = f"{PART} bigint, lang string, terms binary, ends binary, common binary, starts binary, docs binary, times binary, of binary, sources array<string>"
_TYPES = [(PART, pa.int64()), ("lang", pa.string()), *((c, pa.binary()) for c in ("terms", "ends", "common", "starts", "docs", "times", "of")),
          ("sources", pa.list_(pa.string()))]


@trimmed
def _parts(batches):
    """Rows of each language and chunk of about CHUNK_WORDS words."""
    number = itertools.count(TaskContext.get().partitionId() << 33)
    chunks: dict[str, _Chunk] = {}
    size = 0

    def flush():
        for lang in list(chunks):
            for columns in chunks.pop(lang).columns(PART_POSTINGS):
                row = {PART: next(number), "lang": lang} | columns
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in _TYPES], names=[c for c, _ in _TYPES])

    for b in batches:
        langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
        texts = b.column("text").cast(pa.binary())
        bounds = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // READ_BYTES
        cuts = np.append(np.flatnonzero(np.diff(bounds, prepend=-1)), len(b))
        for lo, hi in itertools.pairwise(cuts.tolist()):
            by_lang: dict[str, list[int]] = {}
            for i in range(lo, hi):
                by_lang.setdefault(langs[i], []).append(i)
            for lang, rows in by_lang.items():
                chunk = chunks.setdefault(lang, _Chunk())
                chunk.add([sources[i] for i in rows], [texts[i].as_py() or b"" for i in rows])
                size += len(chunk.words[-1]) + len(rows)
            if size >= CHUNK_WORDS:
                yield from flush()
                size = 0
    yield from flush()


# Levels -----------------------------------------------------------------------------------------

def groups_of(size: np.ndarray, shared: np.ndarray, alive: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of a level begins among the ``alive`` terms, and which groups are complete terms.

    ``size``: bytes of every term of the sorted dictionary; ``shared``: first bytes in common with the term before.  A
    term of at most ``width`` bytes is a group of its own; longer ones are grouped by their first ``width`` bytes.
    Terms stay alive by whole groups, so a group's neighbours are its neighbours in the dictionary too.
    """
    complete = size <= width
    begins = complete | (shared < width)
    begins[1:] |= complete[:-1]
    begins = np.flatnonzero(begins[alive])
    return begins, complete[alive[begins]]


def refine(size: np.ndarray, shared: np.ndarray, answers: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """Term numbers that are still open after the ``answers`` of the levels so far, those kept for good, and the next level's width."""
    alive, kept, width = np.arange(len(size)), [np.empty(0, np.int64)], FIRST_BYTES
    for words in answers:
        begins, complete = groups_of(size, shared, alive, width)
        bits = np.zeros(len(begins), bool)
        if words:
            at = np.arange(len(begins))
            w = np.array(words, np.int64)
            inside = at // 63 < len(w)
            bits[inside] = (w[at[inside] // 63] >> (at[inside] % 63)) & 1
        of = np.diff(np.append(begins, len(alive)))
        kept.append(alive[np.repeat(bits & complete, of)])
        alive = alive[np.repeat(bits & ~complete, of)]
        width *= 2
    return alive, np.sort(np.concatenate(kept)), width


def _read(b: pa.RecordBatch, r: int, levels: int, *packed: str) -> tuple:
    """Of a staged part: its terms, the state of the refinement, and the ``packed`` columns."""
    ends, shared, *rest = (np.frombuffer(b.column(c)[r].as_buffer(), "<i4").astype(np.int64) for c in ("ends", "common", *packed))
    offsets = np.append(0, ends).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), b.column("terms")[r].as_buffer()])
    size = np.diff(offsets).astype(np.int64)
    return terms, size, shared, refine(size, shared, [b.column(f"bits{i}")[r].as_py() for i in range(levels)]), rest


LEVEL = f"{PART} bigint, {POS} bigint, lang string, prefix binary, complete boolean, n bigint"


def _level(levels: int):
    """Documents of the part per prefix of the next level."""

    def run(batches):
        for b in batches:
            for r in range(len(b)):
                terms, size, shared, (alive, _, width), (starts, docs) = _read(b, r, levels, "starts", "docs")
                if not len(alive):
                    continue
                begins, complete = groups_of(size, shared, alive, width)
                n = np.diff(starts)[alive]
                of = np.diff(np.append(begins, len(alive)))
                group = np.repeat(np.arange(len(begins)), of)
                # Distinct documents only need looking for in prefixes of several terms.
                count = np.add.reduceat(n, begins)
                several = of > 1
                if several.any():
                    mine = np.flatnonzero(several[group])
                    at = np.repeat(starts[alive[mine]] - (np.cumsum(n[mine]) - n[mine]), n[mine]) + np.arange(n[mine].sum())
                    pairs = np.unique((np.repeat(group[mine], n[mine]) << 32) | docs[at])
                    count = np.where(several, np.bincount(pairs >> 32, minlength=len(begins)), count)
                prefix = pc.binary_slice(terms.take(pa.array(alive[begins])), 0, width)
                part, lang = b.column(PART)[r].as_py(), b.column("lang")[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begins), part), pa.int64()), pa.array(np.arange(len(begins)), pa.int64()), pa.repeat(lang, len(begins)),
                     prefix, pa.array(complete, pa.bool_()), pa.array(count, pa.int64())], names=[PART, POS, "lang", "prefix", "complete", "n"])

    return trimmed(run)


def in_place(staged: DataFrame, told: DataFrame, column: str, name: str) -> DataFrame:
    """``told``'s column (one row per part) beside every row of the staged table, which isn't shuffled."""
    b = told.select(F.col(PART).alias("_bpart"), F.col(column).alias(name)).hint("shuffle_hash")
    return staged.join(b, staged[PART] == b["_bpart"], "left").drop("_bpart")


def kept_terms(staged: DataFrame, least_docs: int) -> tuple[DataFrame, int, int]:
    """The staged parts with one bitmap column per level, until every surviving prefix is a complete term; number of
    levels; number of kept terms, summed over parts.

    A prefix has at most one row per part, so the window over a prefix is a small share of its task's rows.
    """
    levels = kept = 0
    parts = staged
    while True:
        whole = Window.partitionBy("prefix", "lang", "complete")
        counts = parts.drop("times", "of", "sources").mapInArrow(_level(levels), LEVEL).withColumn("all", F.sum("n").over(whole))
        often = written(counts.filter(F.col("all") >= least_docs).select(PART, POS, "complete"))
        parts = in_place(parts, written(bitmaps(often)), "_bits", f"bits{levels}")
        levels += 1
        left = {r["complete"]: r["count"] for r in often.groupBy("complete").count().collect()}
        kept += left.get(True, 0)
        if not left.get(False):
            return parts, levels, kept


# Counts -----------------------------------------------------------------------------------------

COUNTS = "lang string, term string, sources binary, counts binary"


def _packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary rows of an array, cut at ``cut``."""
    offsets = ((cut - cut[0]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[cut[0]:cut[-1]].tobytes())])


def _kept_counts(levels: int):
    """One row per kept term of a part: numbers of its sources (``numbers``: of the language) and the counts there."""

    def run(batches):
        for b in batches:
            for r in range(len(b)):
                terms, _, _, (_, kept, _), (starts, docs, times, of) = _read(b, r, levels, "starts", "docs", "times", "of")
                if not len(kept):
                    continue
                source = np.array(b.column("numbers")[r].as_py(), np.int64)[of]
                n = np.diff(starts)[kept]
                at = np.repeat(starts[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = (np.repeat(np.arange(len(kept)), n) << 32) | source[docs[at]]
                begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))  # a term's documents are ordered by source
                count = np.add.reduceat(times[at], begins).astype("<i8")
                cell = cell[begins]
                cut = np.searchsorted(cell >> 32, np.arange(len(kept) + 1))
                names, lang = (cell & 0xFFFFFFFF).astype("<i4"), b.column("lang")[r].as_py()
                for lo in range(0, len(kept), 50_000):
                    some, at = kept[lo : lo + 50_000], cut[lo : lo + 50_001]
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), terms.take(pa.array(some)).cast(pa.string()), _packed(names, at), _packed(count, at)],
                                                     names=["lang", "term", "sources", "counts"])

    return trimmed(run)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed binary rows, and how many each row has."""
    size = np.dtype(kind).itemsize
    data, lens = [b""], [np.empty(0, np.int64)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        at = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4).astype(np.int64) if len(c) else np.zeros(1, np.int64)
        lens.append(np.diff(at) // size)
        if at[-1] > at[0]:
            data.append(c.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes())
    return np.frombuffer(b"".join(data), kind).astype(np.int64), np.concatenate(lens)


def _cells(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, source and count of every cell of packed rows."""
    source, lens = _joined(t.column("sources"), "<i4")
    return np.repeat(np.arange(len(lens)), lens), source, _joined(t.column("counts"), "<i8")[0]


def _merged(t: pa.Table) -> pa.Table:
    """One row per term of a block, its counts summed over parts."""
    row, source, count = _cells(t)
    coded = pc.dictionary_encode(t.column("term").combine_chunks())
    cell, inverse = np.unique((coded.indices.to_numpy().astype(np.int64)[row] << 32) | source, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, inverse, count)
    n = len(coded.dictionary)
    cut = np.searchsorted(cell >> 32, np.arange(n + 1))
    return pa.table({"lang": pa.repeat(t.column("lang")[0].as_py(), n), "block": pa.array(np.full(n, t.column("block")[0].as_py()), pa.int64()),
                     "term": coded.dictionary, "sources": _packed((cell & 0xFFFFFFFF).astype("<i4"), cut), "counts": _packed(total.astype("<i8"), cut)})


def _sums(batches):
    """Occurrences of kept terms per source, summed over a batch of merged rows."""
    for b in batches:
        t = pa.Table.from_batches([b])
        row, source, count = _cells(t)
        langs = Numbers()
        lang = np.fromiter(map(langs.__getitem__, t.column("lang").to_pylist()), np.int64, len(t))
        cell, inverse = np.unique((lang[row] << 32) | source, return_inverse=True)
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, inverse, count)
        names = list(langs)
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in (cell >> 32).tolist()], pa.string()), pa.array(cell & 0xFFFFFFFF, pa.int64()),
                                          pa.array(total, pa.int64())], names=["lang", "g", "n"])


# Divergence -------------------------------------------------------------------------------------

def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    if count.size == 0 or int(count.max()) < (1 << 62) // SCALE:
        return 1 + SCALE * (count + 1) // total
    return np.array([1 + SCALE * (int(c) + 1) // total for c in count.ravel()], np.int64).reshape(count.shape)


RESULT = "lang string, g bigint, h bigint, term string, value bigint"


def _compare(ranks: int):
    """Of one block: per ordered pair of sources the sum over its terms, and per source its ``ranks`` best terms."""

    def run(terms: pa.Table, info: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(terms) and len(info):
            lang, v = terms.column("lang")[0].as_py(), info.column("v")[0].as_py()
            sources = info.column("g").to_numpy()
            totals = np.zeros(len(sources), np.int64)
            totals[sources] = info.column("n").to_numpy()
            g = len(sources)
            row, source, count = _cells(terms)
            name = np.array(terms.column("term").to_pylist(), object)
            pairs = np.zeros((g, g), np.int64)
            best: list[list] = [[] for _ in range(g)]
            step = max(1, CELLS // g)
            cut = np.searchsorted(row, np.arange(0, len(name) + step, step))
            for k, (x, y) in enumerate(itertools.pairwise(cut.tolist())):
                here = name[k * step : (k + 1) * step]
                c = np.zeros((g, len(here)), np.int64)
                c[source[x:y], row[x:y] - k * step] = count[x:y]
                p = np.stack([shares(c[i], int(totals[i]) + v) for i in range(g)])
                q = shares(c.sum(0), int(totals.sum()) + v)
                for i in range(g):
                    d = p[i] - p
                    pairs[i] += (d * d // p).sum(1)
                    d = p[i] - q
                    f = d * d // q
                    mine = np.flatnonzero((c[i] > 0) & (d > 0))
                    if len(mine) > ranks:  # ties of the last rank stay for now
                        least = np.partition(f[mine], len(mine) - ranks)[len(mine) - ranks]
                        mine = mine[f[mine] >= least]
                    best[i] += zip((-f[mine]).tolist(), here[mine].tolist(), strict=True)
                    if len(best[i]) > 4 * ranks:
                        best[i] = sorted(best[i], key=lambda r: (r[0], r[1].encode()))[:ranks]
            out += [(lang, i, j, None, int(pairs[i, j])) for i in range(g) for j in range(g) if i != j]
            out += [(lang, i, None, t, -f) for i in range(g) for f, t in sorted(best[i], key=lambda r: (r[0], r[1].encode()))[:ranks]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(("lang", "g", "h", "term", "value"), kinds, strict=True))})

    return run


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS,
               ranks: int = RANKS) -> DataFrame:
    """How far every source's use of its language's kept terms departs from each other source's and from the language's.

    A language keeps the V terms in at least ``least_docs`` of its documents (every row is a document; repeated rows and
    ids count each).  A group (lang, source), and a language as a whole, gives a kept term that occurs ``count`` times
    there p = 1 + floor(10^9 (count + 1) / (N + V)), N being the sum of its counts.  f = floor((p - q)^2 / q).

    Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.  Part ``pair``: ``item`` is each other source
    of the language, ``value`` the sum of f over all kept terms with the other's shares as q (0 without kept terms).
    Part ``term``: ``item`` is a kept term with a count and p > q, q the language's share; ranks up to ``ranks``.  Ranks
    start at 1, by value descending, then item by UTF-8.  Null texts, languages and sources count as ''.  A language
    with one source has no pairs; an empty table gives no rows; other columns are not read.

    A language's list of sources meets each of its blocks of terms; the pairs are the square of that list, so it is
    bounded by the root of the result.
    """
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    slim = docs.select(col(text_col).alias("text"), col(lang_col).alias("lang"), col(source_col).alias("source"))
    staged = stage(slim.mapInArrow(_parts, PARTS), numbered=True)
    # Every occurring group, numbered within its language.
    groups = staged.select("lang", F.explode("sources").alias("source")).distinct()
    groups = written(groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1))
    parts, levels, rows = kept_terms(staged, least_docs)
    held = staged.select(PART, "lang", F.posexplode("sources").alias("i", "source")).join(groups, ["lang", "source"])
    numbers = held.groupBy(PART).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda x: x["g"]).alias("g"))
    counts = in_place(parts, written(numbers), "g", "numbers").mapInArrow(_kept_counts(levels), COUNTS)
    blocks = max(1, -(-rows // ROWS_PER_BLOCK))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    merged = written(counts.select("*", block).groupBy("lang", "block").applyInArrow(_merged, "lang string, block bigint, " + COUNTS[len("lang string, "):]))
    kept = merged.groupBy("lang").agg(F.count("*").alias("v"))
    totals = merged.select("lang", "sources", "counts").mapInArrow(_sums, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    known = written(groups.join(kept, "lang", "left").join(totals, ["lang", "g"], "left")
                    .select("lang", "source", "g", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    info = written(merged.select("lang", "block").distinct().join(known, "lang").select("lang", "block", "g", "n", "v"))
    found = written(merged.groupBy("lang", "block").cogroup(info.groupBy("lang", "block")).applyInArrow(_compare(ranks), RESULT))
    name = known.select("lang", "g", "source")
    other = known.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    sums = found.filter("h IS NOT NULL").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = name.join(other, "lang").filter("g <> h").join(sums, ["lang", "g", "h"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    terms = found.filter("term IS NOT NULL").join(name, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= ranks))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
