"""Toxicity: subword-bag embeddings averaged over short runs of words into a linear softmax.

Embeddings and softmax are trained jointly in numpy.  A document is as toxic as
its worst run of ``window`` words, so a few words stand out in a long text too;
words share character n-grams, so misspellings never seen in training score like
the words they resemble.  Training starts from random runs that inherit their
document's label and then goes on with the runs the model itself finds most
toxic in every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import labelled_sample
from .stage import trimmed
from .subword import Softmax, Vocabulary, WordScores, bags, in_pieces, platt

WINDOW = 6


class ToxicityModel:
    """Bucket logits of class 1 against class 0, and the logistic calibration of a text's worst run.

    The worst of many runs is worse by chance: ``trend`` is by how much it rises with the logarithm of a clean text's
    number of runs, and is taken off, so that length alone makes no text toxic.
    """

    def __init__(self, logits: np.ndarray, window: int, slope: float, offset: float, trend: float = 0.0):
        self.logits, self.window, self.slope, self.offset, self.trend = logits, window, slope, offset, trend

    def levels(self, values: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Worst run of each text less what its length explains; 0 for a text without words."""
        runs = np.maximum(lens - np.minimum(lens, self.window) + 1, 1)
        return worst_runs(values, lens, self.window) - self.trend * np.log(runs)

    def score(self, levels: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * levels + self.offset, -30, 30)))


def run_scores(values: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of every run of ``min(window, n)`` words, text after text, and the number of runs of each text."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    width = np.minimum(lens, window)
    runs = np.where(lens > 0, lens - width + 1, 0)
    begin = np.cumsum(lens) - lens
    text = np.repeat(np.arange(len(lens)), runs)
    at = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    return (total[at + width[text]] - total[at]) / width[text], runs


def worst_runs(values: np.ndarray, lens: np.ndarray, window: int) -> np.ndarray:
    """Highest run score of each text; 0 for a text without words."""
    scores, runs = run_scores(values, lens, window)
    out = np.zeros(len(lens))
    full = runs > 0
    if full.any():
        out[full] = np.maximum.reduceat(scores, (np.cumsum(runs) - runs)[full])
    return out


def train(rows: DataFrame, label: str = "toxic", per_class: int = 1500, max_chars: int = 100_000, window: int = WINDOW,
          first_runs: int = 10, rounds: int = 4, seed: int = 3, labels: DataFrame | None = None) -> ToxicityModel:
    """Fit on at most ``per_class`` texts of each label (documented bounds: of a text over ``max_chars`` a passage of that length).

    A quarter of the sample is held back to calibrate the score to the labels' true shares.  Without rows of both
    labels the score is the share of label 1 (one half without any row).  ``labels`` holds (doc_id, ``label``) when ``rows`` have no label.
    """
    sample, counts = labelled_sample(rows, label, per_class, max_chars, labels=labels)
    y = np.array(sample.column(label).to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return ToxicityModel(np.zeros((2, 1), np.float32), window, 0.0, float(np.log(share / (1 - share))))
    texts = sample.column("text").to_pylist()
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.25 if len(texts) >= 40 else np.zeros(len(texts), bool)
    learn = np.flatnonzero(~held)
    vocabulary = Vocabulary()
    ids, lens = vocabulary.number([texts[i] for i in learn])
    begin = np.cumsum(lens) - lens
    words = [ids[b : b + n] for b, n in zip(begin, lens, strict=True)]
    idx, starts = bags(vocabulary.fresh, 1 << 17) if vocabulary.fresh else (np.zeros(1, np.int64), np.zeros(1, np.int64))
    sizes = np.diff(starts, append=len(idx))
    model = Softmax(2, seed=seed)
    examples, labels = [], []
    for w, t in zip(words, y[learn], strict=True):
        for s in rng.permutation(max(1, len(w) - window + 1))[:first_runs]:
            if len(w):
                examples.append(w[s : s + window])
                labels.append(t)
    for step in range(rounds):
        if examples:
            model.fit(idx, starts, examples, np.array(labels), epochs=1 if step == 0 else 2, batch=256)
        z = model.logits()
        z = z[:, 1] - z[:, 0]
        per_word = np.add.reduceat(z[idx], starts) / sizes
        scores, runs = run_scores(per_word[ids] if len(ids) else np.empty(0), lens, window)
        ends = np.cumsum(runs)
        examples, labels = [], []
        for w, t, e, n in zip(words, y[learn], ends, runs, strict=True):
            if n:
                mine = scores[e - n : e]
                take = 1 if t else 4  # the worst run of a toxic text, the hardest runs of the others
                for s in np.argpartition(-mine, min(take, n) - 1)[:take]:
                    examples.append(w[s : s + window])
                    labels.append(t)
    z = model.logits()
    logits = (z[:, 1:] - z[:, :1]).astype(np.float32)
    check = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else np.arange(len(texts))
    model = ToxicityModel(logits, window, 1.0, 0.0)
    scored = [_flat(WordScores(logits), list(p)) for p in in_pieces([texts[i] for i in check])]
    model.trend = length_trend(np.concatenate([model.levels(*s) for s in scored]), np.concatenate([n for _, n in scored]), y[check] == 0, window)
    levels = np.concatenate([model.levels(*s) for s in scored])
    total = sum(counts.values())
    share = np.array([counts.get(v, 0) / total / max((y[check] == v).mean(), 1e-9) for v in (0, 1)])
    model.slope, model.offset = platt(levels, y[check], share[y[check]])
    return model


def length_trend(worst: np.ndarray, lens: np.ndarray, clean: np.ndarray, window: int) -> float:
    """Least-squares slope (never negative) of clean texts' worst runs on the logarithm of their number of runs."""
    use = clean & (lens > window)
    x = np.log(lens[use] - window + 1.0)
    if len(x) < 20 or x.std() < 1e-9:
        return 0.0
    return max(float(np.cov(x, worst[use], bias=True)[0, 1] / x.var()), 0.0)


def _flat(scorer: WordScores, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    values, lens = scorer.of(texts)
    return values[:, 0], lens


def _rate(model: ToxicityModel):
    def run(batches):
        scorer = WordScores(model.logits)
        for b in batches:
            out = [np.empty(0)]
            for piece in in_pieces([t or "" for t in b.column("text").to_pylist()]):
                out.append(model.score(model.levels(*_flat(scorer, piece))))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate(out), pa.float64())], names=["row", "score"])

    return trimmed(run)


def rate(docs: DataFrame, model: ToxicityModel, carry: list[str], text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: ``row`` (struct of ``carry``) and ``score`` from 0 to 1.

    Null and empty texts have no words and take the calibrated score of 0.  Empty tables give no rows.  Rows are scored one by one:
    repeated rows and ids give repeated results, and any column names are safe.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_rate(model), T.StructType([rows.schema["row"]]).add("score", "double"))
