"""Quality score by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words).  Every passage is
encoded: a standardised vector of its words' shapes, character classes and
repetition goes through a tanh layer.  Gated attention weighs the passages of a
document, and a logistic layer scores the weighted passage representation.  All
weights are learned together, in numpy, from document labels alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import labelled_sample
from .stage import trimmed
from .subword import Vocabulary, in_pieces, platt

PASSAGE = 48
SHAPES = 64  # hash buckets of word shapes
FEATURES = SHAPES + 9


def char_classes(limit: int = 0x3000) -> np.ndarray:
    """Symbol of a character in a word's shape: 1 letter, 2 capital, 3 digit, else the character itself plus 4."""
    return np.array([2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else i + 4 for i, c in
                     ((i, chr(i)) for i in range(limit))], np.int64)


class PassageEncoder:
    """Passage vectors of texts; what is known of each distinct word is computed once per task."""

    def __init__(self, max_words: int = 150_000, max_chars: int = 4_000_000):
        self.classes, self.max_words, self.max_chars = char_classes(), max_words, max_chars
        self.start()

    def start(self) -> None:
        self.vocabulary, self.used, self.known = Vocabulary(lower=False), 0, np.empty((0, 6), np.float32)

    def words(self, fresh: list[str]) -> np.ndarray:
        """Length, letters, capitals, digits, others and shape bucket of every word."""
        code = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = np.where(code < len(self.classes), self.classes[np.minimum(code, len(self.classes) - 1)], 1)
        lens = np.fromiter(map(len, fresh), np.int64, len(fresh))
        at = np.cumsum(lens) - lens
        first = np.zeros(len(sym), bool)
        first[at] = True
        turn = first | (sym != np.roll(sym, 1))  # runs of one symbol count once in a shape
        nth = np.cumsum(turn)
        nth -= np.repeat(nth[at], lens)
        power = np.uint64(0x9E3779B97F4A7C15) * (2 * nth.astype(np.uint64) + np.uint64(1))
        mixed = np.where(turn, (sym.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ power, np.uint64(0)) * np.uint64(0x2545F4914F6CDD1D)
        shape = (np.add.reduceat(mixed, at) >> np.uint64(40)) % np.uint64(SHAPES)
        count = [np.add.reduceat(m.astype(np.float32), at) for m in (sym == 1, sym == 2, sym == 3, sym > 3)]
        return np.stack([lens, *count, shape], 1).astype(np.float32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of all passages in order, and how many passages each text has (at least one)."""
        if len(self.vocabulary) > self.max_words or self.vocabulary.chars > self.max_chars:
            self.start()
        ids, lens = self.vocabulary.number(texts)
        if self.vocabulary.fresh:
            new = self.words(self.vocabulary.fresh)
            if self.used + len(new) > len(self.known):
                grown = np.empty((2 * (self.used + len(new)), 6), np.float32)
                grown[: self.used] = self.known[: self.used]
                self.known = grown
            self.known[self.used : self.used + len(new)] = new
            self.used += len(new)
            self.vocabulary.fresh = []
        passages = np.maximum(1, -(-lens // PASSAGE))
        text = np.repeat(np.arange(len(texts)), lens)
        inside = np.arange(len(ids)) - (np.cumsum(lens) - lens)[text]
        p = (np.cumsum(passages) - passages)[text] + inside // PASSAGE
        total = int(passages.sum())
        n = np.bincount(p, minlength=total).astype(np.float32)
        some = np.maximum(n, 1)
        w = self.known[ids] if len(ids) else np.empty((0, 6), np.float32)
        x = np.zeros((total, FEATURES), np.float32)
        np.divide(np.bincount(p * SHAPES + w[:, 5].astype(np.int64), minlength=total * SHAPES).reshape(total, SHAPES), some[:, None], out=x[:, :SHAPES], casting="unsafe")
        sums = [np.bincount(p, w[:, k], minlength=total) for k in range(5)]
        chars = np.maximum(sums[0], 1)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (p[1:] == p[:-1])
        pairs = np.unique(p * (self.used + 1) + ids) if len(ids) else np.empty(0, np.int64)
        distinct = np.bincount(pairs // (self.used + 1), minlength=total)
        dense = [sums[0] / some / 10, *(s / chars for s in sums[1:5]), distinct / some, np.bincount(p, again, minlength=total) / some,
                 n / PASSAGE, np.repeat(np.log1p(lens), passages) / 10]
        x[:, SHAPES:] = np.stack(dense, 1)
        return x, passages


class QualityModel:
    """Weights of the network, the standardisation of its input and the calibration of its output."""

    def __init__(self, features: int = FEATURES, hidden: int = 24, gate: int = 12, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"E": init(features, hidden), "e": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate),
                  "a": init(gate, 1), "c": init(hidden, 1), "d": np.zeros(1, np.float32)}
        self.slope, self.offset = 1.0, 0.0

    def forward(self, x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.w, np.cumsum(passages) - passages
        text = np.repeat(np.arange(len(passages)), passages)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        u = ((t * g) @ w["a"])[:, 0]
        u = np.exp(u - np.maximum.reduceat(u, at)[text])
        weight = u / np.add.reduceat(u, at)[text]
        z = np.add.reduceat(weight[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "text": text, "at": at, "logit": (z @ w["c"])[:, 0] + w["d"][0]}

    def gradients(self, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        """``error``: derivative of the loss by each text's logit."""
        w, h, text = self.w, f["h"], f["text"]
        gz = error[:, None] @ w["c"].T
        ga = (gz[text] * h).sum(1)
        gu = f["weight"] * (ga - np.add.reduceat(f["weight"] * ga, f["at"])[text])
        gtg = gu[:, None] @ w["a"].T
        gt, gg = gtg * f["g"] * (1 - f["t"] ** 2), gtg * f["t"] * f["g"] * (1 - f["g"])
        gh = (f["weight"][:, None] * gz[text] + gt @ w["V"].T + gg @ w["U"].T) * (1 - h**2)
        return {"E": f["x"].T @ gh, "e": gh.sum(0), "V": h.T @ gt, "U": h.T @ gg, "a": (f["t"] * f["g"]).T @ gu[:, None],
                "c": f["z"].T @ error[:, None], "d": error.sum(keepdims=True)}

    def fit(self, x: np.ndarray, passages: np.ndarray, y: np.ndarray, epochs: int, rate: float, batch: int, seed: int) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        r, at = np.random.default_rng(seed), np.cumsum(passages) - passages
        m, v, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                n = passages[part]
                rows = np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                f = self.forward(x[rows], n)
                p = 1 / (1 + np.exp(-np.clip(f["logit"], -30, 30)))
                step += 1
                for k, g in self.gradients(f, ((p - y[part]) / len(part)).astype(np.float32)).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + 1e-4 * self.w[k])

    def scores(self, encoder: PassageEncoder, texts: list[str]) -> np.ndarray:
        z = self.slope * self.forward(*encoder.encode(texts))["logit"] + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: DataFrame, label: str = "quality", per_class: int = 1500, max_chars: int = 100_000, epochs: int = 30, seed: int = 11,
          labels: DataFrame | None = None) -> QualityModel:
    """Fit on at most ``per_class`` texts of each label (documented bounds: of a text over ``max_chars`` a passage of that length).

    A quarter of the sample calibrates the score to the labels' true shares.  Without rows of both labels every score
    is the share of label 1 (one half without any row).  ``labels`` holds (doc_id, ``label``) when ``rows`` have no label.
    """
    sample, counts = labelled_sample(rows, label, per_class, max_chars, labels=labels)
    y = np.array(sample.column(label).to_pylist(), np.float64)
    model = QualityModel(seed=seed)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        model.slope, model.offset = 0.0, float(np.log(share / (1 - share)))
        return model
    encoder = PassageEncoder()
    parts = [encoder.encode(list(p)) for p in in_pieces(sample.column("text").to_pylist())]
    x, passages = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    held = np.random.default_rng(seed).random(len(y)) < 0.25 if len(y) >= 40 else np.zeros(len(y), bool)
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    row_held = np.repeat(held, passages)
    model.fit(x[~row_held], passages[~held], y[~held], epochs, 0.01, 64, seed)
    check, row_check = (held, row_held) if held.any() else (~held, ~row_held)
    logit = model.forward(x[row_check], passages[check])["logit"].astype(np.float64)
    total = sum(counts.values())
    share = np.array([counts.get(v, 0) / total / max((y[check] == v).mean(), 1e-9) for v in (0, 1)])
    model.slope, model.offset = platt(logit, y[check], share[y[check].astype(int)])
    return model


def _rate(model: QualityModel):
    def run(batches):
        encoder = PassageEncoder()
        for b in batches:
            out = [np.empty(0)] + [model.scores(encoder, p) for p in in_pieces([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate(out).astype(np.float64))], names=["row", "score"])

    return trimmed(run)


def rate(docs: DataFrame, model: QualityModel, carry: list[str], text_col: str = "text") -> DataFrame:
    """Quality of every whole text: ``row`` (struct of ``carry``) and ``score`` from 0 to 1.

    Null and empty texts are one passage without words.  Empty tables give no rows.  Rows are scored one by one:
    repeated rows and ids give repeated results, and any column names are safe.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_rate(model), T.StructType([rows.schema["row"]]).add("score", "double"))
