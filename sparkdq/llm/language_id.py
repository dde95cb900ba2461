"""Language identification: averaged hashed subword embeddings with a linear softmax.

Trained in numpy by stochastic gradient descent on a bounded sample, applied to
every whole text.  A held-back third of the sample sets a temperature (so that
scores are probabilities) and the rejection threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import labelled_sample
from .stage import trimmed
from .subword import Softmax, Vocabulary, WordScores, bags, in_pieces, text_sums

UNDETERMINED = "und"


class LanguageModel:
    """Bucket logits (temperature applied), language names and the rejection threshold."""

    def __init__(self, logits: np.ndarray, names: list[str], threshold: float):
        self.logits, self.names, self.threshold = logits, names, threshold


def mean_logits(scorer: WordScores, texts: list[str]) -> np.ndarray:
    values, lens = scorer.of(texts)
    return text_sums(values, lens) / np.maximum(lens, 1)[:, None]


def probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(rows: DataFrame, label: str = "lang", per_class: int = 600, max_chars: int = 100_000, window: int = 24,
          windows_per_text: int = 6, epochs: int = 3, reject_rate: float = 0.002, most: float = 0.5, seed: int = 5) -> LanguageModel:
    """Fit on at most ``per_class`` texts of each label (documented bounds: of a text over ``max_chars`` a passage of that length).

    Examples are runs of ``window`` words of the sampled texts, so short texts are learned too.  ``reject_rate``: share
    of rightly classified held-back texts that the threshold may reject; ``most``: the threshold never exceeds it.  Without labelled rows: no languages, every
    text is undetermined.
    """
    sample, _ = labelled_sample(rows, label, per_class, max_chars)
    names = sorted(set(sample.column(label).to_pylist()))
    if not names:
        return LanguageModel(np.zeros((2, 1), np.float32), [], 1.0)
    texts = sample.column("text").to_pylist()
    y = np.array([names.index(v) for v in sample.column(label).to_pylist()])
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 1 / 3 if len(texts) >= 30 else np.zeros(len(texts), bool)
    vocabulary = Vocabulary()
    examples, labels = [], []
    for i in np.flatnonzero(~held):
        ids, _ = vocabulary.number([texts[i]])
        spots = range(0, len(ids), window)
        for s in rng.permutation(list(spots))[:windows_per_text]:
            examples.append(ids[s : s + window])
            labels.append(y[i])
    model = Softmax(len(names), seed=seed)
    if examples:
        idx, starts = bags(vocabulary.fresh, len(model.E))
        model.fit(idx, starts, examples, np.array(labels), epochs=epochs)
    logits = model.logits()
    check = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    z = np.concatenate([mean_logits(WordScores(logits), list(p)) for p in in_pieces([texts[i] for i in check])])
    truth = y[check]

    def loss(t: float) -> float:
        return float(-np.log(probabilities(z * t)[np.arange(len(z)), truth] + 1e-9).mean())

    heat = min(np.geomspace(0.25, 16, 25), key=loss)
    p = probabilities(z * heat)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    threshold = float(min(right[int(reject_rate * len(right))], most)) if len(right) else 1.0
    return LanguageModel((logits * heat).astype(np.float32), names, threshold)


def _identify(model: LanguageModel):
    def run(batches):
        scorer = WordScores(model.logits)
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores = [], []
            for piece in in_pieces([t or "" for t in texts]):
                p = probabilities(mean_logits(scorer, piece))
                for t, k, s in zip(piece, p.argmax(1), p.max(1), strict=True):
                    known = bool(model.names) and any(map(str.isalpha, t))
                    names.append(model.names[k] if known else UNDETERMINED)
                    scores.append(float(min(s, 1.0)) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([s < model.threshold for s in scores], pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    return trimmed(run)


def identify(docs: DataFrame, model: LanguageModel, carry: list[str], text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``row`` (struct of ``carry``), ``lang_pred``, ``score``, ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0 and are rejected.  Empty tables give no rows.  Rows are scored one by one:
    repeated rows and ids give repeated results, and any column names are safe.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(_identify(model), schema)
