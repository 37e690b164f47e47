"""Operator 1: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct words (each with
its first and last few letters, so that inflected and compound forms of a word count too), a document's
score the noisy-or of its sentences: 1 - prod(1 - p). Only documents have labels; the likelihood of the
noisy-or is climbed by gradient, so blame settles on the sentences whose words explain the labels. The
same model then finds those sentences.

The fit sees at most ``PER_CLASS`` labelled rows of each class, in one task; ``FOLDS`` more tasks each fit on the rows
outside a fold and score those in it. On these scores the noisy-or's logit is calibrated, classes weighing as
the labels have them, so a score is a probability. Scores use the text alone. Null and empty texts have no
sentence; their score is that of a bag with one empty sentence. Repeated rows score alike. Without training rows of
both classes every score is 0; with fewer than ``MIN_CALIBRATED`` of one, scores stay as they are. A doc_id with both
labels takes no part in the fit. An empty table gives none. Labels,
language, source and doc_id are no input of a score; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.labelled import held_out, logistic, training_rows
from textquarry.llm.token_counts import runs
from textquarry.llm.workers import lean

#: The documented bound of the sample that the model is fitted on.
PER_CLASS = 2000
#: A word needs to stand in so many training documents, and its parts of the two classes to differ by
#: so many standard errors. Words beyond chance alone get a weight; the rest would only be learnt by heart.
MIN_DOCS = 8
MIN_Z = 4.0
STEPS = 600
#: Folds that calibrate, and the rows of each class that this needs.
FOLDS = 3
MIN_CALIBRATED = 12
#: Pull of weights towards nothing.
RIDGE = 1e-5
#: Weights nearer to nothing than this are dropped.
LEAST_WEIGHT = 0.05
BATCH_CHARS = 4_000_000

_ENDS = "\n.!?;…。！？"
#: Every character keeps its place: sentence ends become line feeds, other marks spaces.
_TABLE = {ord(c): "\n" for c in _ENDS} | {c: " " for c in range(0x80) if not chr(c).isalnum() and chr(c) not in "\n.!?;"}


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]
    #: Of the calibration of a document's logit.
    slope: float
    shift: float


def _plain(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.translate(_TABLE)


def sentences(text: str | None) -> list[list[str]]:
    """Words of the sentences of a text that have any."""
    return [w for s in _plain(text or "").split("\n") if (w := s.split())]


#: Lengths of the beginnings and ends of words that are features.
AFFIXES = (4, 5, 6, 7)
#: Words whose weights a worker holds.
MAX_WORDS = 500_000


def features(word: str) -> list[str]:
    n = len(word)
    return [word, *(f"{word[:k]}*" for k in AFFIXES if n > k), *(f"*{word[-k:]}" for k in AFFIXES if n > k)]


class WordWeights(dict):
    """Word -> sum of its features' weights, filled as words are met."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MAX_WORDS:
            self.clear()
        get = self.weights.get
        self[word] = z = sum(get(f, 0.0) for f in features(word))
        return z


def fit(texts: list[str], labels: list[int]) -> tuple[float, dict[str, float]]:
    """Bias and word weights that maximise the noisy-or likelihood."""
    if not texts or len(set(labels)) < 2:
        return -20.0, {}
    bags = [[[f for w in set(s) for f in features(w)] for s in sentences(t)] or [[]] for t in texts]
    counts = [Counter(w for bag, label in zip(bags, labels, strict=True) if label == y for w in set().union(*bag)) for y in (0, 1)]
    sizes = [max(labels.count(y), 1) for y in (0, 1)]

    def apart(w: str) -> bool:
        n = counts[0][w] + counts[1][w]
        rate = n / sum(sizes)
        error = math.sqrt(max(rate * (1 - rate), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
        return n >= MIN_DOCS and abs(counts[1][w] / sizes[1] - counts[0][w] / sizes[0]) >= MIN_Z * error

    vocabulary = {w: i for i, w in enumerate(sorted(w for w in counts[0].keys() | counts[1].keys() if apart(w)))}
    cells = [[vocabulary[w] for w in s if w in vocabulary] for bag in bags for s in bag]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    col = np.fromiter((w for c in cells for w in c), np.int64, len(row))
    y = np.array(labels, float)
    # Classes weigh alike, whatever their parts in the sample.
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w, b = np.zeros(len(vocabulary)), -math.log(4 * len(cells) / len(bags))
    gw, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.clip(b + np.bincount(row, w[col], len(cells)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        positive = np.maximum(-np.expm1(log_none), 1e-9)
        pull = share * (y * (1 - positive) / positive - (1 - y))  # d likelihood / d z of a sentence is pull * p
        slope = pull[owner] * p
        dw = np.bincount(col, slope[row], len(w)) / len(bags) - RIDGE * w
        db = slope.sum() / len(bags)
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w + 1.5 * dw / np.sqrt(gw), b + 0.5 * db / math.sqrt(gb)
    kept = {t: float(w[i]) for t, i in vocabulary.items() if abs(w[i]) >= LEAST_WEIGHT}
    return float(b), kept


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on a bounded sample, one task a fold and one for all; the weights, no more than the sample's words, come back."""
    sample = training_rows(docs, labels, "toxic", per_class)

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        fold = int(rows["fold"].iloc[0])
        rows = rows.sort_values("doc_id")
        out = np.arange(len(rows)) % FOLDS == fold  # none for the last
        bias, weights = fit(rows["text"][~out].tolist(), rows["y"][~out].astype(int).tolist())
        if fold == FOLDS:
            return pd.DataFrame({"word": ["", *weights], "value": [bias, *weights.values()], "y": -1, "n_y": 0})
        held = WordWeights(weights)
        z = [_logit(score_text(t, bias, held)[0]) for t in rows["text"][out]]
        return pd.DataFrame({"word": None, "value": z, "y": rows["y"][out], "n_y": rows["n_y"][out]})

    spread = sample.select("doc_id", "text", "y", "n_y", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("fold"))
    found = spread.groupBy("fold").applyInPandas(task, "word string, value double, y int, n_y long").collect()
    weights = {r.word: r.value for r in found if r.y < 0}
    model = Model(weights.pop("", -20.0), weights, 1.0, 0.0)
    scored = sorted((r.value, r.y, r.n_y) for r in found if r.y >= 0)
    z, y, n = (np.array(c, float) for c in zip(*scored, strict=True)) if scored else (np.empty(0),) * 3
    parts = [int((y == k).sum()) for k in (0, 1)]
    if min(parts) >= MIN_CALIBRATED:
        weight = n / np.where(y == 1, parts[1], parts[0])
        slope, shift = logistic(z[:, None], y, weight * len(y) / weight.sum())
        if slope > 0:
            model = Model(model.bias, model.weights, float(slope), float(shift))
    return model


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logit(p: float) -> float:
    p = max(1e-12, min(1 - 1e-12, p))
    return math.log(p / (1 - p))


def score_text(text: str | None, bias: float, weights: WordWeights) -> tuple[float, float, int, int]:
    """Score of the text, and of its worst sentence with that sentence's start and end (code points)."""
    plain = _plain(text or "")
    get, quiet = weights.__getitem__, math.log1p(-_sigmoid(bias))
    log_none, worst, at, span = 0.0, -1.0, 0, (0, 0)
    for s in plain.split("\n"):
        end = at + len(s)
        words = s.split()
        if words:
            z = sum(map(get, set(words)))
            if z:
                p = _sigmoid(bias + z)
                log_none += math.log1p(-min(p, 1 - 1e-12))
            else:
                p = -0.5
                log_none += quiet
            if p > worst:
                worst, span = p, (at, end)
        at = end + 1
    if log_none == 0.0:
        log_none = quiet
    return -math.expm1(log_none), _sigmoid(bias) if worst < 0 else worst, *span


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, worst_score, worst_start, worst_end of every row."""
    bias, weights, slope, shift = model

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordWeights(weights)
        for batch in stream:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], np.int64)
            for a, b in runs(sizes, BATCH_CHARS):
                found = [score_text(t, bias, held) for t in batch.column(1).slice(a, b - a).to_pylist()]
                cols = list(zip(*found, strict=True))
                cols[0] = [_sigmoid(slope * _logit(p) + shift) if weights else 0.0 for p in cols[0]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    ["doc_id", "score", "worst_score", "worst_start", "worst_end"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean("toxicity", task), "doc_id long, score double, worst_score double, worst_start long, worst_end long")


def locate(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score of every sentence that scores ``at_least`` so much."""
    bias, weights = model[:2]

    def task(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = WordWeights(weights)
        for rows in stream:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                for m in re.finditer(r"[^\n]+", _plain(text or "")):
                    p = _sigmoid(bias + sum(map(held.__getitem__, set(m[0].split()))))
                    if m[0].strip() and p >= at_least:
                        out.append((doc_id, m.start(), m.end(), text[m.start() : m.end()], p))
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "sentence", "score"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(lean("toxicity", task), "doc_id long, start long, end long, sentence string, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end"
    )
