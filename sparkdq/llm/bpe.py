"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts every text where its low bits are
zero, so passages that documents share are cut alike wherever they stand.  A
chunk's *body* lies between its first and last likely token border, a space after a
visible character; what two bodies leave between them is their join.  Cuts and
keys are found once, when texts are staged in parts of bounded bytes.  Bodies found in several
parts are encoded once by one owner, and their ids travel to the parts that use them; bodies repeated inside a part are
encoded once there, and the rest by remembered pieces between borders.

Where a reused body meets its neighbour, the last piece before and the first piece
after are encoded again as one text: the ids must be those of both sides.  If they
are not, the stretch is widened on both sides until its first and last piece agree
with the neighbours' ids, at most to the whole text, and its ids replace theirs.
Decoding concatenates the bytes of all ids; a reused body must decode to its own
bytes, else it is encoded anew.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import PART, stage, trimmed, written

WINDOW = 16
CHUNK_BITS = 10  # chunks of 1 KB on average
PART_BYTES = 16_000_000  # of text in a part, or one text
AT_ONCE = 1_000_000  # bytes of text worked on at once, or one text
REUSED = b"\xff"  # before the key of a reused body where pieces stand: no piece begins so


def gear() -> np.ndarray:
    """A fixed random 32-bit number for every byte value."""
    return np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, table: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Ends (exclusive) of the chunks that the rolling hash ends in ``data``; never inside a UTF-8 character."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    h, step, m = table[data], 1, 0x9E3779B1
    while step < WINDOW:
        h = h[:-step] * np.uint32(m) + h[step:]
        m, step = m * m & 0xFFFFFFFF, 2 * step
    ends = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + WINDOW
    ends = ends[ends < len(data)]
    return ends[(data[ends] & 0xC0) != 0x80]


def borders(data: np.ndarray) -> np.ndarray:
    """Likely token borders: a space after a visible ASCII character or one from U+00C0 to U+07FF (none is white space)."""
    at = np.flatnonzero(data[1:] == 0x20) + 1
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    return at[((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))]


def bodies(data: bytes, table: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the bodies of a text's chunks, in order."""
    view = np.frombuffer(data, np.uint8)
    border = borders(view)
    ends = np.append(cuts(view, table), len(view))
    begins = np.concatenate([[0], ends[:-1]])
    first, last = np.searchsorted(border, begins, "left"), np.searchsorted(border, ends, "right") - 1
    some = last > first
    return list(zip(border[first[some]].tolist(), border[last[some]].tolist(), strict=True))


def key(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


class Codec:
    """The tokenizer, and the bytes of each id."""

    def __init__(self, tokenizer_json: str, max_pieces: int = 300_000):
        check(tokenizer_json)
        self.pieces: dict[bytes, bytes] = {}  # piece -> ids
        self.changed: dict[bytes, bytes] = {}  # piece -> what its ids decode to, where that differs
        self.agreed: set[bytes] = set()  # two pieces whose ids are the same together
        self.max_pieces = max_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in visible}
        byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        vocabulary = self.tokenizer.get_vocab(True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = added.get(i) or bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def know(self, cut: list[list[bytes]]) -> list[bytes]:
        """Make the ids of all pieces known; returns those to ``forget`` after use: only short pieces are remembered, up to a bound."""
        if len(self.pieces) > self.max_pieces:
            self.pieces, self.changed, self.agreed = {}, {}, set()
        new = [p for p in set(itertools.chain.from_iterable(cut)).difference(self.pieces) if not p.startswith(REUSED)]
        self.learn(new)
        return [p for p in new if len(p) > 64]

    def forget(self, pieces: list[bytes]) -> None:
        for p in pieces:
            self.pieces.pop(p, None)
            self.changed.pop(p, None)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit integers) of each text, by its pieces."""
        cut = [pieces_of(t) for t in texts]
        long = self.know(cut)
        out = [b"".join(map(self.pieces.__getitem__, c)) for c in cut]
        self.forget(long)
        return out

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as the tokenizer gives them, without pieces."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def disagreeing(self, windows: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
        """Neighbouring pieces (of known ids) whose ids differ when they are encoded as one text."""
        new = [w for w in windows if w[0] + w[1] not in self.agreed]
        out = set()
        for w, ids in zip(new, self.whole([a + b for a, b in new]), strict=True):
            if ids == self.pieces[w[0]] + self.pieces[w[1]]:
                self.agreed.add(w[0] + w[1])
            else:
                out.add(w)
        return out

    def repaired(self, pieces: list[bytes], joins: list[int]) -> bytes:
        """Ids of a text given as pieces of known ids; ``joins``: numbers of pieces at which neighbours disagreed.

        Around a join pieces are encoded again as one text; the stretch grows on both sides until its first and last
        piece have the ids they had, or it is the whole text.
        """
        out, done = [], 0
        for j in joins:
            if j < done:
                continue
            width = 2
            while True:
                lo, hi = max(done, j - width), min(len(pieces), j + width)
                ids = self.whole([b"".join(pieces[lo:hi])])[0]
                first, last = self.pieces[pieces[lo]], self.pieces[pieces[hi - 1]]
                if (lo == 0 or ids.startswith(first) and lo > done) and (hi == len(pieces) or ids.endswith(last)):
                    break
                if lo == done and done:  # begin anew: the stretch before was too short
                    return self.whole([b"".join(pieces)])[0]
                width *= 2
            out += [self.pieces[p] for p in pieces[done:lo]]
            out.append(ids)
            done = hi
        return b"".join(out + [self.pieces[p] for p in pieces[done:]])

    def learn(self, pieces: list[bytes], at_once: int = 2000) -> None:
        """Encode and decode pieces.  Those with visible characters and a space before them are encoded in a row, which costs
        far less than one by one, and told apart by the byte lengths of their tokens.
        """
        sure = [p for p in pieces if p[0] == 0x20 and (0x20 < p[-1] < 0x7F or p[-1] >= 0x80 and 0xC3 <= p[-2] <= 0xDF)]
        groups = [sure[i : i + at_once] for i in range(0, len(sure), at_once)]
        groups += [[p] for p in set(pieces).difference(sure)]
        coded = self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, coded, strict=True):
            ids = np.array(e.ids, "<u4")
            whole, decoded = ids.tobytes(), self.decode(ids)
            at = np.cumsum([0] + [len(p) for p in group])
            token = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), at, "right")).tolist() if len(group) > 1 else [0, len(whole)]
            at = at.tolist() if len(group) > 1 else [0, len(decoded)]
            for p, x, y, i, j in zip(group, at, at[1:], token, token[1:], strict=False):
                self.pieces[p] = whole[i:j]
                if decoded[x:y] != p:
                    self.changed[p] = decoded[x:y]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def check(tokenizer_json: str) -> None:
    """Raise for a tokenizer whose tokens may reach across a space after a visible character, or change the text."""
    d = json.loads(tokenizer_json)
    pre = d.get("pre_tokenizer") or {}
    known = d["model"].get("type") == "BPE" and not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not known or d["model"].get("dropout") or any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in d.get("added_tokens") or []):
        raise ValueError("not a byte-level BPE tokenizer without normaliser, prefix space or added tokens that hold a space")


def pieces_of(data: bytes) -> list[bytes]:
    """A text cut at its borders."""
    at = [0, *borders(np.frombuffer(data, np.uint8)).tolist(), len(data)] if data else []
    return [data[x:y] for x, y in itertools.pairwise(at)]


def _slices(texts: list[bytes]):
    """Bounds of slices of texts of about AT_ONCE bytes, at most 2,000 texts."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE or i - lo >= 2000:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@trimmed
def _chunked(batches):
    """Texts in parts of about PART_BYTES, with begin and end of their chunks' bodies and the bodies' keys."""
    table, number, size = gear(), TaskContext.get().partitionId() << 33, 0
    for b in batches:
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        for lo, hi in _slices(texts):
            parts, spans, keys = [], [], []
            for data in texts[lo:hi]:
                if size >= PART_BYTES:
                    number, size = number + 1, 0
                size += len(data) + 100
                found = bodies(data, table)
                parts.append(number)
                spans.append(np.array(found, "<u4").tobytes())
                keys.append([key(data[x:y]) for x, y in found])
            some = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), some.column("row"), some.column("text"), pa.array(spans, pa.binary()), pa.array(keys, pa.list_(pa.binary()))],
                                             names=[PART, "row", "text", "spans", "keys"])


_codecs: dict[str, Codec] = {}  # of this process; one at most


class Lazy:
    """The codec, made at first use and kept for the process' later groups and tasks: pieces that one task has learnt, bounded
    as ever, serve the next."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer_json = tokenizer_json

    def get(self) -> Codec:
        if self.tokenizer_json not in _codecs:
            _codecs.clear()
            _codecs[self.tokenizer_json] = Codec(self.tokenizer_json)
        return _codecs[self.tokenizer_json]

    def forget(self) -> None:
        """After a failure: a codec may hold what the failed group would have taken back."""
        _codecs.clear()


def _rows(docs: pa.Table):
    """Text, spans and keys of every document, in slices of bounded text; null is empty."""
    texts = docs.column("text").cast(pa.binary())
    for lo in range(0, len(docs), 500):
        some = [t or b"" for t in texts.slice(lo, 500).to_pylist()]
        spans, keys = (docs.column(c).slice(lo, 500).to_pylist() for c in ("spans", "keys"))
        for x, y in _slices(some):
            yield [(t, np.frombuffer(s, "<u4").reshape(-1, 2).tolist(), k) for t, s, k in zip(some[x:y], spans[x:y], keys[x:y], strict=True)]


def _kept_clean(lazy: Lazy, run):
    """``run`` that leaves no codec behind when it fails."""
    def guarded(docs: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return run(docs, other)
        except BaseException:
            lazy.forget()
            raise

    return guarded


def _encode_owned(lazy: Lazy):
    def run(docs: pa.Table, owned: pa.Table) -> pa.Table:
        wanted, out = set(owned.column("key").to_pylist()), []
        for rows in _rows(docs) if wanted else []:
            found = {}
            for data, spans, keys in rows:
                for (x, y), k in zip(spans, keys, strict=True):
                    if k in wanted:
                        found[k] = data[x:y]
                        wanted.discard(k)
            if found:
                out += zip(found, lazy.get().encode(list(found.values())), strict=True)
            if not wanted:
                break
        return pa.table({"key": pa.array([r[0] for r in out], pa.binary()), "ids": pa.array([r[1] for r in out], pa.binary())})

    return _kept_clean(lazy, run)


def reused(codec: Codec, rows: list, given: dict[bytes, bytes], ends: dict[bytes, tuple[bytes, bytes]]) -> list[list[bytes]]:
    """Every text as pieces and marks of reused bodies, whose ids are among the codec's pieces and whose first and last pieces are in ``ends``."""
    out = []
    for data, spans, keys in rows:
        border = [0, *borders(np.frombuffer(data, np.uint8)).tolist(), len(data)] if data else []
        at, seq = 0, []
        for (x, y), k in zip(spans, keys, strict=True):
            if k not in given:
                continue
            mark = REUSED + k
            i, j = bisect.bisect_left(border, x), bisect.bisect_left(border, y)
            if mark not in codec.pieces:
                if codec.decode(np.frombuffer(given[k], "<u4")) != data[x:y]:
                    del given[k]
                    continue
                codec.pieces[mark] = given[k]
            ends[k] = (data[border[i] : border[i + 1]], data[border[j - 1] : border[j]])
            seq += [data[p:q] for p, q in itertools.pairwise(border[at : i + 1])]
            seq.append(mark)
            at = j
        seq += [data[p:q] for p, q in itertools.pairwise(border[at:])]
        out.append(seq)
    return out


def _assemble(lazy: Lazy):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        codec, ids, decoded = lazy.get(), [], []
        given = dict(zip(shared.column("key").to_pylist(), shared.column("ids").to_pylist(), strict=True))
        times = Counter(k for c in docs.column("keys").chunks for k in c.flatten().to_pylist())
        inside = {k for k, n in times.items() if n > 1 and k not in given}  # repeated in this part alone
        for rows in _rows(docs):
            first = {}
            for data, spans, keys in rows:
                first |= {k: data[x:y] for (x, y), k in zip(spans, keys, strict=True) if k in inside}
            given |= zip(first, codec.encode(list(first.values())), strict=True)
            inside -= first.keys()
            ends: dict[bytes, tuple[bytes, bytes]] = {}
            seqs = reused(codec, rows, given, ends)
            long = codec.know([*seqs, *ends.values()])
            # A reset of the remembered pieces forgets marks: set them again.
            codec.pieces |= {REUSED + k: given[k] for k in ends}
            left, right = (lambda p: ends[p[1:]][1] if p[:1] == REUSED else p), (lambda p: ends[p[1:]][0] if p[:1] == REUSED else p)
            joins = [[i for i in range(1, len(s)) if s[i][:1] == REUSED or s[i - 1][:1] == REUSED] for s in seqs]
            bad = codec.disagreeing({(left(s[i - 1]), right(s[i])) for s, at in zip(seqs, joins, strict=True) for i in at})
            for (data, _, _), s, at in zip(rows, seqs, joins, strict=True):
                if bad and any((left(s[i - 1]), right(s[i])) in bad for i in at):
                    cut = pieces_of(data)
                    again = codec.know([cut])
                    ids.append(codec.repaired(cut, list(range(1, len(cut)))))
                    decoded.append(codec.decode(np.frombuffer(ids[-1], "<u4")).decode("utf-8", "replace"))
                    codec.forget(again)
                    continue
                ids.append(b"".join(map(codec.pieces.__getitem__, s)))
                same = not codec.changed or codec.changed.keys().isdisjoint(s)
                decoded.append((data if same else codec.decode(np.frombuffer(ids[-1], "<u4"))).decode("utf-8", "replace"))
            codec.forget([*long, *(REUSED + k for k in ends)])
        return pa.table({"row": docs.column("row"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    return _kept_clean(lazy, run)


def encode_decode(docs: DataFrame, tokenizer_json: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """Ids (little-endian 32-bit integers) of every whole text and the text they decode to.

    Returns ``row`` (struct of ``carry``), ``ids`` binary and ``decoded`` string.  Null counts as empty: no ids, empty
    text.  Added tokens' strings inside a text become their ids, as is the tokenizer's default.  Rows are independent:
    repeated rows and ids give repeated results, any column names are safe, and an empty table gives no rows.  A
    definition that isn't a plain byte-level BPE raises ValueError.
    """
    check(tokenizer_json)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = T.StructType.fromDDL(f"{PART} bigint, text string, spans binary, keys array<binary>").fields
    staged = stage(rows.mapInArrow(_chunked, T.StructType([kind[0], rows.schema["row"], *kind[1:]])), numbered=True)
    uses = staged.select(PART, F.explode("keys").alias("key")).groupBy(PART, "key").agg(F.lit(1).alias("one")).drop("one")
    shared = written(uses.groupBy("key").agg(F.count("*").alias("parts"), F.min(PART).alias("owner")).filter("parts > 1"))
    owned = shared.select(F.col("owner").alias(PART), "key")
    texts = staged.select(PART, "row", "text", "spans", "keys")
    encoded = written(texts.drop("row").groupBy(PART).cogroup(owned.groupBy(PART)).applyInArrow(_encode_owned(Lazy(tokenizer_json)), "key binary, ids binary"))
    sent = uses.join(encoded, "key").select(F.col(PART).alias("_to"), "key", "ids")
    schema = T.StructType([staged.schema["row"], *T.StructType.fromDDL("ids binary, decoded string").fields])
    return texts.groupBy(PART).cogroup(sent.groupBy("_to")).applyInArrow(_assemble(Lazy(tokenizer_json)), schema)
