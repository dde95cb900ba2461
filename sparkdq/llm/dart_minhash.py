"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles (weight: how often each
occurs).  Darts are thrown by hashing at regions of the plane weight x rank of
every element; the regions double in size, each gets a Poisson number of darts of
its area.  A dart counts when it lies below the element's weight and below a rank
limit that makes about k (ln k + 3) darts hit a text, whatever its size.  Per
coordinate the earliest dart stays; coordinates of two texts agree with
probability equal to their weighted Jaccard similarity.

Texts whose coordinates agree in a band share a bucket.  No bucket is expanded into pairs:

1. Every text is compared exactly, by its shingles, with one pivot: of the members of all its buckets the one with the
   most company.  Variants of a text meet that text; links found merge classes.
2. In buckets that still hold several classes, members outside the largest class are compared with all members of other
   classes inside a task, by signatures of one byte per coordinate.  Only likely pairs leave it, packed per text.
3. Likely pairs are checked exactly where their texts' shingles lie together (texts of one pivot have one *home*), and
   only links between classes leave the task.

So no pair of different classes within a bucket stays uncompared, whatever the bucket's size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import PART, POS, keyed, marked, shuffle_partitions, stage, trimmed, written
from .subword import Vocabulary

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 6
COORDINATES = BANDS * ROWS
TEXTS_AT_ONCE, CHARS_AT_ONCE = 200, 300_000
PAIRS_PER_PIVOT_COPY = 256
MEMBERS_AT_ONCE, BYTES_AT_ONCE = 2048, 32_000_000  # of a bucket, compared in one group; bytes of signatures compared at once
HOME, ASKS_PER_COPY = 512, 512  # texts whose shingles lie together; texts compared with one copy of them
LIKELY = COORDINATES * 62 // 100  # agreeing coordinates of a pair that is compared: 6 standard deviations below 0.8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson_steps(level: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson number of mean 2 ** level."""
    mean = 2.0**level
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    log = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(log))


class Shingler:
    """Weighted shingle sets of texts; words are hashed once per task while the vocabulary fits its bound."""

    def __init__(self, max_words: int = 120_000, max_chars: int = 4_000_000):
        self.max_words, self.max_chars = max_words, max_chars
        self.vocabulary, self.hashes, self.used = Vocabulary(), np.empty(0, np.uint64), 0

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts in order, and the number of words of each text."""
        import xxhash

        if len(self.vocabulary) > self.max_words or self.vocabulary.chars > self.max_chars:
            self.vocabulary, self.used = Vocabulary(), 0
        ids, lens = self.vocabulary.number(texts)
        new = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.vocabulary.fresh]
        if self.used + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes[: self.used], np.empty(self.used + 2 * len(new), np.uint64)])
        self.hashes[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.vocabulary.fresh = []
        return self.hashes[ids], lens

    def elements(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, weight) sorted by text and shingle, and a 128-bit digest (two numbers) of each text's word sequence.

        A text of one to four words has one shingle of all its words; a text without words has none.
        """
        word, lens = self.words(texts)
        count = np.where(lens >= SHINGLE, lens - SHINGLE + 1, np.minimum(lens, 1))
        text = np.repeat(np.arange(len(texts)), count)
        end = np.cumsum(lens)
        at = (end - lens)[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        h = np.zeros(len(text), np.uint64)
        for j in range(SHINGLE):
            inside = at + j < end[text]
            h = mix((h ^ np.where(inside, word[np.minimum(at + j, len(word) - 1)] if len(word) else 0, np.uint64(j))) * _ODD)
        packed = np.sort((text.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.empty(0, np.int64)
        weight = np.diff(first, append=len(packed))
        place = np.arange(len(word)) - np.repeat(end - lens, lens)
        digest = []
        for salt in (_ODD, np.uint64(0xC2B2AE3D27D4EB4F)):
            mixed = np.concatenate([[0], np.cumsum(mix((word + salt) ^ mix(place.astype(np.uint64) + salt)))]).astype(np.uint64)
            digest.append(mix(mixed[end] - mixed[end - lens] + lens.astype(np.uint64)))
        return (packed[first] >> np.uint64(52)).astype(np.int64), packed[first] & np.uint64((1 << 52) - 1), weight, np.stack(digest, 1)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int = COORDINATES) -> np.ndarray:
    """One row of ``k`` coordinates per text: the rank of the earliest dart.  Rows of texts without elements are 0."""
    total = np.bincount(text, weight, texts)
    out = np.zeros(texts * k, np.uint64)
    limit = k * (np.log(k) + 3) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        chosen = np.zeros(texts, bool)
        chosen[todo] = True
        mine = np.flatnonzero(chosen[text])
        found = []
        for rank_level in itertools.count():
            here = mine[limit[text[mine]] > 2**rank_level - 1]
            if not len(here):
                break
            for level in itertools.count():
                heavy = here[weight[here] > 2**level - 1]
                if not len(heavy):
                    break
                found.append(_darts(text[heavy], element[heavy], weight[heavy], limit, level, rank_level, k))
        best = np.sort(np.concatenate(found))
        slot = (best >> np.uint64(48)).astype(np.int64)
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(best) else np.empty(0, bool)
        hit = np.zeros(texts * k, bool)
        hit[slot[first]] = True
        out[slot[first]] = best[first] & np.uint64((1 << 48) - 1)
        todo = todo[~hit.reshape(texts, k)[todo].all(1)]  # a coordinate without a dart: look further along the ranks
        limit = limit * 2
    return out.reshape(texts, k)


def _darts(text, element, weight, limit, level: int, rank_level: int, k: int) -> np.ndarray:
    """Darts of one region of every element that count: text and coordinate above, rank (33 binary places) below."""
    seed = mix(element * _ODD + np.uint64(64 * level + rank_level + 1))
    n = np.searchsorted(poisson_steps(level + rank_level), unit(seed))
    of = np.repeat(np.arange(len(text)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a = mix(seed[of] + (nth + 1).astype(np.uint64) * _ODD)
    b = mix(a + _ODD)
    rank = (1 << rank_level) - 1 + (1 << rank_level) * unit(b)
    counts = rank < limit[text[of]]
    if level:
        counts &= (1 << level) - 1 + (1 << level) * unit(a) < weight[of]
    of, rank, c = of[counts], rank[counts], mix(b[counts] + _ODD) % np.uint64(k)
    slot = text[of].astype(np.uint64) * np.uint64(k) + c
    return (slot << np.uint64(48)) | (rank * 2.0**33).astype(np.uint64)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band of every row."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, rows.shape[:2])
    for j in range(ROWS):
        h = mix((h ^ rows[:, :, j]) * _ODD)
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (sorted elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


# Executor-side steps ----------------------------------------------------------------------------

def _slices(b: pa.RecordBatch):
    """A batch in slices of bounded text, with their texts."""
    at = 0
    while at < len(b):
        n = size = 0
        part = b.slice(at, TEXTS_AT_ONCE)
        texts = [t or "" for t in part.column("text").to_pylist()]
        while n < len(texts) and (size < CHARS_AT_ONCE or not n):
            size += len(texts[n])
            n += 1
        yield part.slice(0, n), texts[:n]
        at += n


@trimmed
def _sketch(batches):
    shingler = Shingler()
    for b in batches:
        for part, texts in _slices(b):
            text, element, weight, digest = shingler.elements(texts)
            signature = signatures(text, element, weight, len(texts))
            keys, short = band_keys(signature), (mix(signature) & np.uint64(255)).astype(np.uint8)
            total = np.bincount(text, weight, len(texts)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column(PART), part.column(POS), part.column("id"), *[pa.array(np.ascontiguousarray(digest[:, i]).view(np.int64)) for i in (0, 1)], pa.array(total), lists,
                 pa.array([r.tobytes() for r in short], pa.binary())], names=[PART, POS, "id", "digest", "digest2", "weight", "bands", "short"])


@trimmed
def _shingles(batches):
    shingler = Shingler()
    for b in batches:
        for part, texts in _slices(b):
            text, element, weight, _ = shingler.elements(texts)
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([
                part.column("node"), pa.array([element[x:y].tobytes() for x, y in itertools.pairwise(cut)], pa.binary()),
                pa.array([weight[x:y].astype("<u4").tobytes() for x, y in itertools.pairwise(cut)], pa.binary())], names=["node", "elements", "weights"])


@trimmed
def _linked(batches):
    read = lambda e, w: (np.frombuffer(e, np.uint64), np.frombuffer(w, "<u4").astype(np.int64))
    for b in batches:
        for lo in range(0, len(b), 500):
            part = b.slice(lo, 500)
            r = part.to_pydict()
            yes = [similarity(read(e, w), read(f, v)) >= SIMILARITY
                   for e, w, f, v in zip(r["elements"], r["weights"], r["p_elements"], r["p_weights"], strict=True)]
            yield part.filter(pa.array(yes)).select(part.schema.names[:-4])


# A row's place as one number ---------------------------------------------------------------------

def node_of_place() -> Column:
    return F.shiftleft(PART, 33) + F.col(POS)


def place_of(node: str) -> list[Column]:
    return [F.shiftright(node, 33).alias(PART), F.col(node).bitwiseAND(F.lit((1 << 33) - 1)).alias(POS)]


# Classes ----------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges`` (``u``, ``v``) that are not the smallest of their component.

    Alternates large-star and small-star steps until the edges are stars around roots; each step is a minimum per node
    and a join, so hubs are pre-aggregated and no component is gathered.  Every pass is written to the shared folder.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest neighbour itself keeps its edge
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller node, and none of those has one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("is_root")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("is_root")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("is_root").alias("is_root")).filter("up > 1 OR up + is_root > 1").take(1)


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Of distinct pairs ``(node, pivot)`` those at least SIMILARITY alike, by their whole shingle sets.

    The other columns of ``pairs`` are kept.  A pivot's set is copied once for every few hundred of its pairs, so a pivot of many pairs is no hot key.
    """
    per_pivot = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PAIRS_PER_PIVOT_COPY).cast("int").alias("copies"))
    salted = pairs.join(per_pivot, "pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")).drop("copies")
    one = salted.join(shingles, "node")
    held = per_pivot.join(shingles.select(F.col("node").alias("pivot"), F.col("elements").alias("p_elements"), F.col("weights").alias("p_weights")), "pivot")
    two = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return one.join(two, ["pivot", "salt"]).select(*pairs.columns, "elements", "weights", "p_elements", "p_weights").mapInArrow(_linked, pairs.schema)


def pivots_of(members: DataFrame) -> DataFrame:
    """``(node, pivot)``: of the members of all its buckets the one with the most company (ties: the smallest)."""
    rank = F.struct("company", (-F.col("node")).alias("first"))
    top = members.groupBy("key").agg(F.max(rank).alias("p"))
    best = members.select("key", "node").join(top, "key").groupBy("node").agg(F.max("p").alias("p"))
    return best.select("node", (-F.col("p.first")).alias("pivot"))


def with_homes(pivots: DataFrame) -> DataFrame:
    """``(node, home)``: texts of one pivot lie together, many in several homes of about HOME texts, few with others'."""
    sizes = pivots.groupBy("pivot").agg(F.count("*").alias("n"))
    homes = max(1, -(-pivots.count() // HOME))
    own = F.xxhash64("pivot", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / HOME)))
    return pivots.join(sizes, "pivot").select("node", F.when(F.col("n") > HOME, own).otherwise(F.pmod(F.xxhash64("pivot"), F.lit(homes))).alias("home"))


class _Bucket:
    """Members of one block of a bucket, as arrays."""

    FIELDS = ("node", "root", "home", "weight", "minor")

    def __init__(self):
        self.at, self.rows, self.short = None, {f: [] for f in self.FIELDS}, []

    def add(self, rows: dict, short: np.ndarray) -> None:
        for f in self.FIELDS:
            self.rows[f].append(rows[f])
        self.short.append(short)

    def whole(self) -> tuple[dict, np.ndarray]:
        if len(self.short) > 1:
            self.rows, self.short = {f: [np.concatenate(v)] for f, v in self.rows.items()}, [np.concatenate(self.short)]
        return {f: v[0] for f, v in self.rows.items()}, self.short[0]


def likely(q: dict, q_short: np.ndarray, m: dict, m_short: np.ndarray):
    """Index pairs (query, member) of different classes that may be linked: each pair of a block once.

    Signatures must agree in at least LIKELY places: a pair of similarity 0.8 agrees in 144 of 180 places on average, with
    a standard deviation of 5.4, so fewer than 111 happen to one such pair in a thousand million.
    """
    step = max(1, BYTES_AT_ONCE // (COORDINATES * len(m_short)))
    for lo in range(0, len(q_short), step):
        part = slice(lo, lo + step)
        node, root, weight = (q[f][part, None] for f in ("node", "root", "weight"))
        fits = (root != m["root"]) & ~(m["minor"] & (node > m["node"])) & (np.minimum(weight, m["weight"]) >= SIMILARITY * np.maximum(weight, m["weight"]) - 1e-9)
        i, j = np.nonzero(fits)
        for at in range(0, len(i), BYTES_AT_ONCE // COORDINATES):
            x, y = i[at : at + BYTES_AT_ONCE // COORDINATES] + lo, j[at : at + BYTES_AT_ONCE // COORDINATES]
            yes = np.count_nonzero(q_short[x] == m_short[y], axis=1) >= LIKELY
            yield x[yes], y[yes]


@trimmed
def _compared(batches):
    """Of sorted blocks of buckets (members first, then queries): per query and home the likely others, packed."""
    bucket = _Bucket()
    for b in batches:
        if not len(b):
            continue
        key, block, query = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "query"))
        rows = {f: b.column(f).to_numpy(zero_copy_only=False) for f in _Bucket.FIELDS}
        short = np.frombuffer(b"".join(b.column("short").to_pylist()), np.uint8).reshape(len(b), COORDINATES)
        turn = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
        out = []
        for x, y in itertools.pairwise([0, *turn.tolist(), len(b)]):
            at = (key[x], block[x])
            if bucket.at != at:
                bucket = _Bucket()
                bucket.at = at
            some = {f: v[x:y] for f, v in rows.items()}
            if not query[x]:
                bucket.add(some, short[x:y])
            elif bucket.short:
                m, m_short = bucket.whole()
                for i, j in likely(some, short[x:y], m, m_short):
                    order = np.lexsort((m["home"][j], i))
                    i, j = i[order], j[order]
                    home = m["home"][j]
                    cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (home[1:] != home[:-1])])) if len(i) else np.empty(0, np.int64)
                    out += [(int(home[c]), int(some["node"][i[c]]), int(some["root"][i[c]]), m["node"][j[c:d]].tobytes())
                            for c, d in itertools.pairwise([*cut.tolist(), len(i)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                         names=["home", "node", "root", "others"])


def _checked(asks: pa.Table, texts: pa.Table) -> pa.Table:
    """Links between classes: every asking text against the texts it asks for, exactly, by their shingles."""
    found = set()
    if len(asks) and len(texts):
        sets = [np.frombuffer(e, np.uint64) for e in texts.column("elements").to_pylist()]
        weights = [np.frombuffer(w, "<u4") for w in texts.column("weights").to_pylist()]
        element, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(e) for e in sets])
        order = np.argsort(element, kind="stable")
        element, of, weight = element[order], of[order], np.concatenate(weights)[order].astype(np.int64)
        total = np.array([int(w.sum()) for w in weights])
        node, root = texts.column("node").to_numpy(), texts.column("root").to_numpy()
        for r in range(len(asks)):
            e, w = np.frombuffer(asks.column("elements")[r].as_py(), np.uint64), np.frombuffer(asks.column("weights")[r].as_py(), "<u4").astype(np.int64)
            lo, hi = np.searchsorted(element, e, "left"), np.searchsorted(element, e, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(of[at], np.minimum(np.repeat(w, n), weight[at]), len(sets))
            asked = np.isin(node, np.frombuffer(b"".join(asks.column("others")[r].as_py()), np.int64))
            mine = asks.column("root")[r].as_py()
            for other in np.unique(root[asked & (both / (w.sum() + total - both) >= SIMILARITY)]).tolist():
                found.add((max(mine, other), min(mine, other)))
    return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})


def remaining_links(members: DataFrame, nodes: DataFrame, homes: DataFrame, roots: DataFrame, shingles: DataFrame) -> DataFrame:
    """``(u, v)`` links between classes within buckets.  ``nodes``: node, weight, short.

    A bucket's members are dealt into blocks of about MEMBERS_AT_ONCE; those outside its largest class are copied to each.
    A home meets the texts that ask for its own in portions of about ASKS_PER_COPY.
    """
    labelled = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_class = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = per_class.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("classes")).filter("classes > 1")
    open_ = open_.select("key", F.col("main.root").alias("main"), F.ceil(F.col("n") / MEMBERS_AT_ONCE).cast("int").alias("blocks"))
    known = nodes.join(homes, "node")
    rows = written(labelled.join(open_, "key").withColumn("minor", F.col("root") != F.col("main")).drop("main"))
    carried = rows.join(known, "node")
    fields = ["key", "block", "query", "node", "root", "home", "weight", "minor", "short"]
    own = carried.withColumns({"block": F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"), "query": F.lit(False)})
    asking = carried.filter("minor").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "query": F.lit(True)})
    both = own.select(*fields).unionByName(asking.select(*fields)).repartition(shuffle_partitions(members.sparkSession), "key", "block")
    asks = written(both.sortWithinPartitions("key", "block", "query").mapInArrow(_compared, "home bigint, node bigint, root bigint, others binary"))
    asks = written(asks.groupBy("home", "node", "root").agg(F.collect_list("others").alias("others")))
    per_home = asks.groupBy("home").agg(F.ceil(F.count("*") / ASKS_PER_COPY).cast("int").alias("copies"))
    dealt = asks.join(per_home, "home").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")).drop("copies").join(shingles, "node")
    there = rows.select("node", "root").distinct().join(homes, "node").join(per_home, "home").join(shingles, "node")
    there = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("salt", *[F.col(c).alias(c) for c in ("home", "node", "root", "elements", "weights")])
    return dealt.groupBy("home", "salt").cogroup(there.groupBy("home", "salt")).applyInArrow(_checked, "u bigint, v bigint")


def link_classes(members: DataFrame, nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes that share a class with a smaller node, from bucket members ``(key, node, company)``."""
    pivots = written(pivots_of(members))
    first = verified(pivots.filter("node <> pivot"), shingles)
    roots = written(components(first.select(F.col("node").alias("u"), F.col("pivot").alias("v"))))
    links = remaining_links(members, nodes, written(with_homes(pivots)), roots, shingles)
    # The links found join whole classes: only their roots are merged.
    merged = written(components(links).select(F.col("node").alias("root"), F.col("root").alias("top")))
    moved = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(merged.select(F.col("root").alias("node"), F.col("top").alias("root"))))


class NearDuplicates:
    """``rows``: the staged documents (``row``, ``id``, ``text``); ``verdict``: node, id, class_id, class_size, kept."""

    def __init__(self, rows: DataFrame, verdict: DataFrame):
        self.rows, self.verdict = rows, verdict

    def kept_rows(self) -> DataFrame:
        """``row`` of the document that stays of each class; the staged rows aren't shuffled."""
        return marked(self.rows, self.verdict.filter("NOT kept").select(*place_of("node"))).filter("NOT _marked").select("row")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> NearDuplicates:
    """Classes of documents linked, directly or through others, by a similarity of at least SIMILARITY.

    Words are lower-cased and split at white space.  Documents without words (null, empty) are classes of their own.
    Of each class the row with the smallest id stays, null ids last, rows that share an id by their place in the staged
    table.  Texts of equal words are one node of the search.  ``carry`` columns travel in the struct ``row``.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = stage(docs.select(F.struct(*[col(c) for c in carry or [id_col]]).alias("row"), col(id_col).alias("id"), col(text_col).cast("string").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{PART} bigint, {POS} bigint, id {kind}, digest bigint, digest2 bigint, weight bigint, bands array<bigint>, short binary"
    sketch = stage(rows.select(PART, POS, "id", "text").mapInArrow(_sketch, schema), numbered=True)
    same = ["digest", "digest2", "weight"]
    some = sketch.filter("weight > 0")
    firsts = written(some.groupBy(*same).agg(F.min(node_of_place()).alias("first")))
    banded = marked(sketch, firsts.select(*place_of("first"))).filter("_marked").select(node_of_place().alias("node"), "weight", "bands", "short")
    keys = banded.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keys.join(shared, "key"))
    # The text that others are variants of shares more buckets with more texts than the variants share with each other.
    popular = written(members.groupBy("node").agg(F.sum("n").alias("company")))
    members = written(members.drop("n").join(popular, "node"))
    picked = marked(rows, popular.select(*place_of("node"))).filter("_marked")
    shingles = keyed(picked.select(node_of_place().alias("node"), "text").mapInArrow(_shingles, "node bigint, elements binary, weights binary"), "node")
    nodes = written(marked(sketch, popular.select(*place_of("node"))).filter("_marked").select(node_of_place().alias("node"), "weight", "short"))
    roots = link_classes(members, nodes, shingles)
    first = firsts.join(roots.withColumnRenamed("node", "first"), "first", "left")
    classed = some.select(node_of_place().alias("node"), "id", *same).join(first, same).select("node", "id", F.coalesce("root", "first").alias("class"))
    classed = written(classed.unionByName(sketch.filter("weight = 0").select(node_of_place().alias("node"), "id", node_of_place().alias("class"))))
    who = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("node").alias("node"))
    groups = classed.groupBy("class").agg(F.min(who).alias("first"), F.count("*").alias("class_size"))
    verdict = classed.join(groups, "class").select("node", "id", F.col("first.id").alias("class_id"), "class_size", (F.col("first.node") == F.col("node")).alias("kept"))
    return NearDuplicates(rows, verdict)
