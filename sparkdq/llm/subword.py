"""Words as bags of hashed character n-grams, and a linear softmax over their averaged embeddings.

A word ``w`` is the bag of n-grams of ``<w>`` plus the word itself, each hashed
to one of ``buckets`` rows of an embedding table.  A word vector is the mean of
its rows, a text vector the mean of its word vectors, so the logits of a text
are the mean of its words' logits: a trained model is applied as a table of
bucket logits, and each distinct word of a task is looked up once.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np

ORDERS = (3, 4, 5)


def bags(words: list[str], buckets: int, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of every word's n-grams, one word after the other, and where each word begins."""
    parts = [_bags(words[i : i + at_once], buckets) for i in range(0, len(words), at_once)]
    shift = np.cumsum([0] + [len(p[0]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=False)])


def _bags(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    word_at = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    end_at = ends[word_at]
    at = np.arange(len(chars), dtype=np.int64)
    ids = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)]
    owners = [np.arange(len(words), dtype=np.int32)]
    for n in ORDERS:
        p = at[at + n <= end_at]
        h = np.full(len(p), n, np.uint64)
        for j in range(n):
            h = (h ^ chars[p + j]) * np.uint64(0x100000001B3)
        ids.append(h * np.uint64(0x9E3779B97F4A7C15))
        owners.append(word_at[p])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashed = (np.concatenate(ids) >> np.uint64(33)) % np.uint64(buckets)
    return hashed[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words)))


class Vocabulary(dict):
    """Distinct words numbered as they come; ``fresh`` holds those that aren't scored yet."""

    def __init__(self, lower: bool = True):
        super().__init__()
        self.lower = lower
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return n

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and the number of words of each."""
        split = [(t.lower() if self.lower else t).split() for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(lens.sum())), lens


class WordScores:
    """Word logits of a trained model, kept per distinct word; memory is bounded by starting anew."""

    def __init__(self, logits: np.ndarray, max_words: int = 150_000, max_chars: int = 4_000_000):
        self.logits, self.max_words, self.max_chars = logits, max_words, max_chars
        self.vocabulary, self.scores = Vocabulary(), np.empty((0, logits.shape[1]), np.float32)
        self.used = 0

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every word of the texts in order, and the number of words of each text."""
        v = self.vocabulary
        if len(v) > self.max_words or v.chars > self.max_chars:
            v = self.vocabulary = Vocabulary()
            self.used = 0
        ids, lens = v.number(texts)
        if v.fresh:
            idx, starts = bags(v.fresh, len(self.logits))
            new = np.add.reduceat(self.logits[idx], starts) / np.diff(starts, append=len(idx))[:, None]
            if self.used + len(new) > len(self.scores):
                grown = np.empty((2 * (self.used + len(new)), new.shape[1]), np.float32)
                grown[: self.used] = self.scores[: self.used]
                self.scores = grown
            self.scores[self.used : self.used + len(new)] = new
            self.used += len(new)
            v.fresh = []
        return self.scores[ids], lens


def in_pieces(texts: list[str], chars: int = 400_000):
    """Slices of a list of texts with about ``chars`` characters each; every text stays whole."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def text_sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of length 0 gives 0."""
    total = np.zeros((len(values) + 1, values.shape[1]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


class Softmax:
    """Embedding table and linear softmax, trained jointly by minibatch SGD with per-row step sizes."""

    def __init__(self, classes: int, buckets: int = 1 << 17, dim: int = 16, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.E = (self.rng.random((buckets, dim), np.float32) - 0.5) / dim
        self.W = ((self.rng.random((dim, classes), np.float32) - 0.5) / dim).astype(np.float32)
        self.b = np.zeros(classes, np.float32)
        self.sE, self.sW, self.sb = np.full(buckets, 1e-8, np.float32), np.full_like(self.W, 1e-8), np.full_like(self.b, 1e-8)

    def logits(self) -> np.ndarray:
        return self.E @ self.W + self.b

    def fit(self, idx: np.ndarray, starts: np.ndarray, examples: list[np.ndarray], labels: np.ndarray,
            weights: np.ndarray | None = None, epochs: int = 1, rate: float = 0.2, batch: int = 256) -> None:
        """``examples``: arrays of word numbers; words' n-grams are ``idx[starts[w]:starts[w + 1]]``."""
        stops = np.append(starts[1:], len(idx))
        weights = np.ones(len(examples), np.float32) if weights is None else weights
        for _ in range(epochs):
            order = self.rng.permutation(len(examples))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                lens = np.array([len(examples[i]) for i in part])
                words, inverse = np.unique(np.concatenate([examples[i] for i in part]), return_inverse=True)
                counts = np.zeros((len(part), len(words)), np.float32)
                np.add.at(counts, (np.repeat(np.arange(len(part)), lens), inverse), np.repeat(1 / lens, lens).astype(np.float32))
                n = stops[words] - starts[words]
                first = np.cumsum(n) - n
                grams = idx[np.repeat(starts[words] - first, n) + np.arange(n.sum())]
                vectors = np.add.reduceat(self.E[grams], first) / n[:, None]
                x = counts @ vectors
                z = x @ self.W + self.b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), labels[part]] -= 1
                p *= weights[part][:, None] / len(part)
                gw, gb, gx = x.T @ p, p.sum(0), p @ self.W.T
                gword = (counts.T @ gx) / n[:, None]
                by = np.argsort(grams, kind="stable")
                rows, at = np.unique(grams[by], return_index=True)
                ge = np.add.reduceat(np.repeat(gword, n, axis=0)[by], at)
                self.sE[rows] += (ge * ge).mean(1)
                self.E[rows] -= rate * ge / np.sqrt(self.sE[rows])[:, None]
                self.sW += gw * gw
                self.W -= rate * gw / np.sqrt(self.sW)
                self.sb += gb * gb
                self.b -= rate * gb / np.sqrt(self.sb)


def platt(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (never negative) and offset of a logistic fit of labels on scores, by damped Newton steps."""
    centre, scale = float(scores.mean()), float(scores.std()) or 1.0
    x = np.stack([(scores - centre) / scale, np.ones_like(scores)], 1)
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (weights * (p - labels)) + 1e-2 * t * np.array([1, 0])
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        t -= np.clip(np.linalg.solve(h, g), -2, 2)
    slope = max(float(t[0]), 0.0) / scale
    return slope, float(t[1]) - slope * centre
