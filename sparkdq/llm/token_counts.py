"""Token counts: pieces counted once per distinct pre-token, joined to documents' pre-token frequencies.

Every part of the staged frequencies has a dictionary of its distinct pre-tokens
and, per document, positions in that dictionary with their frequencies.  Only the
dictionaries are exchanged: distinct pre-tokens of the whole corpus are counted
once, the counts go back to the parts, and each document sums frequency times
count.  Token ids never exist outside the counting of one pre-token.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import PART, POS, stage, trimmed, written
from .subword import Vocabulary, in_pieces

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"  # fixed value: the tokenizer's own pre-token pattern
WHOLE = " "  # marks a chunk that is counted by the whole tokenizer; no pre-token holds white space


def check(tokenizer_json: str) -> None:
    """Raise for a tokenizer that isn't of the one kind whose rules ``PreTokens`` applies: lower-casing after NFC, ``_SPLIT``, BPE."""
    d = json.loads(tokenizer_json)
    steps = [s.get("type") for s in (d.get("normalizer") or {}).get("normalizers", [])]
    split = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = split[0].get("pattern", {}).get("Regex", "").replace(r"[\p{L}]+", r"\p{L}+").replace(r"[\p{N}]", r"\p{N}")
    known = steps == ["NFC", "Replace", "Lowercase"] and split[0].get("type") == "Split" and split[0].get("invert") and [s.get("type") for s in split[1:]] == ["ByteLevel"]
    if not known or pattern != _SPLIT or d["model"].get("type") != "BPE" or any(t.get("lstrip") or t.get("rstrip") for t in d.get("added_tokens") or []):
        raise ValueError("not a lower-casing BPE tokenizer with this pre-token pattern")


class PreTokens:
    """Pre-tokens of whole texts, looked up once per distinct white-space-separated chunk.

    For a tokenizer that lower-cases, splits by ``_SPLIT`` and drops white space, so that chunks between white space
    are independent.  Chunks of letters below U+0250, whose composition and case are plain, are split here; others by
    the library's normaliser and pre-tokenizer.  A chunk that holds an added token's string stays one, marked entry.
    """

    def __init__(self, tokenizer_json: str, max_chunks: int = 250_000, max_chars: int = 8_000_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.space = regex.compile(_SPLIT), regex.compile(r"\p{White_Space}+")
        self.max_chunks, self.max_chars = max_chunks, max_chars
        self.numbers: dict[str, int] = {}
        self.fresh: list[str] = []
        self.start()

    def start(self) -> None:
        """Forget the chunks; pre-tokens keep their numbers."""
        self.chunks, self.first, self.flat = Vocabulary(lower=False), np.zeros(1, np.int64), np.empty(0, np.int64)

    def number(self, pretoken: str) -> int:
        n = self.numbers.get(pretoken)
        if n is None:
            n = self.numbers[pretoken] = len(self.numbers)
            self.fresh.append(pretoken)
        return n

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
        elif max(chunk) >= "\u0250" or "\u0130" in chunk:
            plain = self.tokenizer.normalizer.normalize_str(chunk)
            return [WHOLE + chunk] if self.holds_added(chunk) else [plain[x:y] for _, (x, y) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return [WHOLE + chunk] if self.holds_added(chunk) else self.pattern.findall(chunk.lower())

    def holds_added(self, chunk: str) -> bool:
        return any(a in chunk for a in self.added)

    def words(self, text: str) -> list[str]:
        """Chunks between white space; U+001C to U+001F, white space to Python, are ordinary characters."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def frequencies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pre-token number, frequency), sorted, for all texts."""
        if len(self.chunks) > self.max_chunks or self.chunks.chars > self.max_chars:
            self.start()
        split = [self.words(t) for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        chunk = np.fromiter(map(self.chunks.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(lens.sum()))
        new = [[self.number(p) for p in self.split(c)] for c in self.chunks.fresh]
        self.chunks.fresh = []
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(new), np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])
        n = self.first[chunk + 1] - self.first[chunk]
        at = np.repeat(self.first[chunk] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        packed = (np.repeat(np.repeat(np.arange(len(texts)), lens), n) << 40) | self.flat[at]
        packed, counts = np.unique(packed, return_counts=True)
        return packed >> 40, packed & ((1 << 40) - 1), counts


def pieces(tokenizer, pretoken: str) -> int:
    """Tokens of one pre-token (of a whole chunk, if marked)."""
    if pretoken.startswith(WHOLE):
        return len(tokenizer.encode(pretoken[1:], add_special_tokens=False).ids)
    if pretoken.isascii() and pretoken.isprintable():  # bytes that stand for themselves
        return len(tokenizer.model.tokenize(pretoken))
    return sum(len(tokenizer.model.tokenize(p)) for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(pretoken))


FREQUENCIES = f"{PART} bigint, {POS} bigint, n_bytes bigint, at array<int>, times array<int>, pretoken string"


def _slices(b: pa.RecordBatch, chars: int = 400_000):
    """A batch in slices of bounded text, with their texts; null is empty."""
    at = 0
    for texts in in_pieces([t or "" for t in b.column("text").to_pylist()], chars):
        yield b.slice(at, len(texts)), texts
        at += len(texts)


def _count_pretokens(tokenizer_json: str):
    def run(batches):
        part, dictionary, pos = TaskContext.get().partitionId(), PreTokens(tokenizer_json), 0

        def rows(n: int, **given):
            given = {PART: pa.array([part] * n, pa.int64())} | given
            return [given.get(f, pa.nulls(n, t)) for f, t in (
                (PART, pa.int64()), (POS, pa.int64()), ("n_bytes", pa.int64()), ("at", pa.list_(pa.int32())),
                ("times", pa.list_(pa.int32())), ("pretoken", pa.string()), ("row", kind))]

        kind = None
        for b in batches:
            kind = b.schema.field("row").type
            for piece, texts in _slices(b):
                text, number, times = dictionary.frequencies(texts)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                gaps = np.diff(number, prepend=0)
                gaps[cut[:-1][cut[:-1] < len(number)]] = number[cut[:-1][cut[:-1] < len(number)]]
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (gaps, times)]
                yield pa.RecordBatch.from_arrays(
                    rows(len(texts), **{POS: pa.array(np.arange(pos, pos + len(texts)), pa.int64()), "row": piece.column("row"),
                                        "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                                        "at": lists[0], "times": lists[1]}), names=names)
                pos += len(texts)
            for lo in range(0, len(dictionary.fresh), 50_000):
                fresh = dictionary.fresh[lo : lo + 50_000]
                first = len(dictionary.numbers) - len(dictionary.fresh) + lo
                yield pa.RecordBatch.from_arrays(rows(len(fresh), **{POS: pa.array(np.arange(first, first + len(fresh)), pa.int64()),
                                                                     "pretoken": pa.array(fresh, pa.string())}), names=names)
            dictionary.fresh = []

    names = [PART, POS, "n_bytes", "at", "times", "pretoken", "row"]
    return trimmed(run)


def _count_pieces(tokenizer_json: str):
    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces(tokenizer, p) for p in b.column(0).to_pylist()], pa.int32())],
                                             names=["pretoken", "pieces"])

    return trimmed(run)


def _sum(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document the dot product of its frequencies (positions as gaps) with the part's piece counts."""
    at, n = counts.column(POS).to_numpy(), counts.column("pieces").to_numpy()
    by_number = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
    by_number[at] = n
    a, t = docs.column("at").combine_chunks(), docs.column("times").combine_chunks()
    lens = np.diff(a.offsets.to_numpy()).astype(np.int64) if len(a) else np.empty(0, np.int64)
    ends = np.cumsum(lens)
    summed = np.concatenate([[0], np.cumsum(a.flatten().to_numpy().astype(np.int64))])
    number = summed[1:] - np.repeat(summed[ends - lens], lens)  # positions from their gaps
    total = np.concatenate([[0], np.cumsum(by_number[number] * t.flatten().to_numpy().astype(np.int64))])
    return pa.table({"row": docs.column("row"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total[ends] - total[ends - lens], pa.int64())})


def token_counts(docs: DataFrame, tokenizer_json: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (struct of ``carry``), ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    Null counts as empty: 0 bytes, 0 tokens.  ``tokenizer_json`` is the tokenizer's definition (a bounded text); one of
    another kind than ``check`` allows raises ValueError.  Rows are independent: repeated rows and ids give repeated
    results, any column names are safe, and an empty table gives no rows.
    """
    check(tokenizer_json)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = T.StructField("row", rows.schema["row"].dataType)  # null in dictionary rows
    staged = stage(rows.mapInArrow(_count_pretokens(tokenizer_json), T.StructType([*T.StructType.fromDDL(FREQUENCIES).fields, kind])), numbered=True)
    entries = staged.filter("pretoken IS NOT NULL").select(PART, POS, "pretoken")
    counted = entries.select("pretoken").distinct().mapInArrow(_count_pieces(tokenizer_json), "pretoken string, pieces int")
    back = written(entries.join(counted, "pretoken").select(PART, POS, "pieces"))
    freq = staged.filter("pretoken IS NULL").select(PART, "row", "n_bytes", "at", "times")
    return freq.groupBy(PART).cogroup(back.groupBy(PART)).applyInArrow(_sum, T.StructType([kind, *T.StructType.fromDDL("n_bytes bigint, n_tokens bigint").fields]))
