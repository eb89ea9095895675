"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U) train a numpy classifier; which texts are labelled negative is not used, only
how many labels are toxic, which gives the class prior (held within PRIORS). With class prior pi, the risk is pi E_P[l(z,1)] + max(0, E_U[l(z,-1)] - pi E_P[l(z,-1)]) for the logistic loss l; when the
bracket falls below zero, the step goes the other way (it pushes the bracket up again).

Features: a word's evidence is pi times its rate in P over its rate in U, the share of its uses that lie in toxic
texts; a word takes the best of itself and its beginnings of four to seven letters. Words are counted by four levels of
evidence; the counts and their shares of the text are what the classifier sees: a text without evidence scores as an empty one. Evidence is taken from one half
of the sample for the texts of the other half, so that the classifier meets evidence as reliable as it will be later.

The model is fitted on a bounded sample: SAMPLE_POSITIVE and SAMPLE_UNLABELLED different rows, those of smallest hash among the
rows of up to SAMPLE_CHARS characters. The prior is taken from all labels outside the held-out fold. Every text is scored whole.

Edge cases: null and empty texts have no words and get the score of an empty text; without toxic examples or
unlabelled text every score is 0; a null id is never held out and never learnt from; repeated rows are scored each and learnt
from once; rows of one id with different texts are rows of their own; equal hashes are picked by id and text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import crc_mod, per_batch, picked, slim, table

SAMPLE_POSITIVE, SAMPLE_UNLABELLED, SAMPLE_CHARS = 1500, 3000, 200_000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Bounds of the class prior: at more than a half, unlabelled text says nothing of what is usual.
PRIORS = (0.001, 0.5)
STEMS = (4, 5, 6, 7)
LEVELS = np.array([0.3, 0.5, 0.7, 0.9])
#: A feature needs this many toxic examples.
LEAST = 4
STEPS, RATE, DECAY = 300, 0.05, 1e-4
MEMORY = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def evidence(positive: list[Counter[str]], unlabelled: list[Counter[str]], prior: float) -> dict[str, float]:
    """Features whose share of uses in toxic texts is LEVELS[0] or more, with that share."""
    used: Counter[str] = Counter()
    texts: Counter[str] = Counter()
    for c in positive:
        own: Counter[str] = Counter()
        for w, k in c.items():
            for f in features(w):
                own[f] += min(k, 3)
        used.update(own)
        texts.update(own.keys())
    usual = dict.fromkeys((f for f, n in texts.items() if n >= LEAST), 0)
    for c in unlabelled:
        for w, k in c.items():
            for f in features(w):
                if f in usual:
                    usual[f] += min(k, 3)
    p, u = sum(map(Counter.total, positive)), sum(map(Counter.total, unlabelled))
    shares = {f: prior * max(0.0, used[f] - 1.5 * used[f] ** 0.5) / p * u / (n + 1) for f, n in usual.items()}
    return {f: min(1.0, s) for f, s in shares.items() if s >= LEVELS[0]}


class Levels(dict):
    """Level of a space-separated word's evidence, 0 for none, kept for words met before (bounded: speed only)."""

    def __init__(self, shares: dict[str, float]):
        super().__init__()
        self.shares = shares

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        best = max((self.shares.get(f, 0.0) for w in _WORD.findall(token) for f in features(w)), default=0.0)
        level = self[token] = int(np.searchsorted(LEVELS, best, "right"))
        return level


def describe(tokens: list[str], levels: Levels) -> np.ndarray:
    n = len(tokens)
    c = np.bincount(np.fromiter(map(levels.__getitem__, tokens), np.int64, n), minlength=len(LEVELS) + 1)[1:]
    return np.concatenate([np.log1p(c), np.sqrt(c / max(1, n))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Weights, the last one constant, by Adam on the non-negative risk."""
    w = np.append(np.zeros(xp.shape[1]), np.log(prior / (1 - prior)))
    xp, xu = np.c_[xp, np.ones(len(xp))], np.c_[xu, np.ones(len(xu))]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        zp, zu = xp @ w, xu @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = xu.T @ _sigmoid(zu) / len(zu) - prior * (xp.T @ _sigmoid(zp)) / len(zp)
        g = (down - prior * (xp.T @ _sigmoid(-zp)) / len(zp) if negative >= 0 else -down) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Model:
    shares: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # None: nothing to learn from

    def scores(self, texts: list[str | None], levels: Levels) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = np.array([describe(words(t), levels) for t in texts])
        return _sigmoid(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights)


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    if not positive or not unlabelled:
        return Model({}, np.zeros(0), np.ones(0), None)
    prior = min(max(prior, PRIORS[0]), PRIORS[1])
    sides = []
    for texts in (positive, unlabelled):
        halves = [[], []]
        for t in texts:  # copies of a text fall in the same half
            halves[zlib.crc32(t.encode()) & 1].append(Counter(x for w in words(t) for x in _WORD.findall(w)))
        sides.append(halves)
    (p0, p1), (u0, u1) = sides
    known = [evidence(p0, u0, prior), evidence(p1, u1, prior)]
    levels = [Levels(k) for k in known]
    xp, xu = (np.array([describe(words(t), levels[1 - (zlib.crc32(t.encode()) & 1)]) for t in texts]) for texts in (positive, unlabelled))
    mean, scale = xu.mean(0), xu.std(0) + 1e-6
    return Model(evidence(p0 + p1, u0 + u1, prior), mean, scale, fit_nnpu((xp - mean) / scale, (xu - mean) / scale, prior))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on rows outside the held-out fold: labels (doc_id, toxic) name the confirmed examples."""
    seen = crc_mod(id_col, FOLDS).isin([x for x in range(FOLDS) if x != HELD_OUT])
    known = slim(labels, "doc_id", "toxic").withColumnRenamed("doc_id", id_col).where(seen & F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    texts = slim(docs, id_col, text_col).where(seen & (F.length(text_col) <= SAMPLE_CHARS)).withColumn("__hash", F.xxhash64(text_col))
    toxic = known.where("toxic = 1").select(id_col).distinct()
    positive = picked(texts.join(toxic, id_col, "left_semi"), id_col, SAMPLE_POSITIVE)
    pick = positive.withColumn("p", F.lit(1)).unionByName(picked(texts, id_col, SAMPLE_UNLABELLED).withColumn("p", F.lit(0)))
    # at most SAMPLE_POSITIVE + SAMPLE_UNLABELLED rows to the tasks, as many texts to the driver
    got = texts.join(F.broadcast(pick), [id_col, "__hash"]).groupBy("p", id_col, "__hash").agg(F.first(text_col)).collect()
    return fit(sorted(r[3] for r in got if r[0]), sorted(r[3] for r in got if not r[0]), prior)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row of docs."""
    model = learn(docs, labels, id_col, text_col)
    held: list[Levels] = []
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Levels(model.shares))
        s = model.scores(batch.column(2).to_pylist(), held[0])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`"), (crc_mod(id_col, FOLDS) == HELD_OUT).alias("__held"), F.col(f"`{text_col}`"))
    return per_batch(rows, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all columns of docs: decided where the rows are, no shuffle."""
    model = learn(docs, labels, id_col, text_col)
    held: list[Levels] = []
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Levels(model.shares))
        return batch.filter(pa.array(model.scores(batch.column(at).to_pylist(), held[0]) < THRESHOLD))

    return per_batch(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every text of `documents`."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
