"""Quality classifier by positive-unlabelled learning.

Only trusted positives (label 1) and unlabelled text are learnt from. With the class prior p, the risk of a scorer is
``p R+(1) + R_u(0) - p R+(0)``: what unlabelled text costs as negative, less the share that its positives cost. That
difference estimates a cost and so must not be negative; where a flexible scorer drives it below zero it is cut off
and its gradient reversed (the non-negative estimator), which keeps the model from calling unlabelled positives junk.
The loss is logistic, so the score is a probability of label 1.

The prior is estimated from the trusted positives and the unlabelled text alone; labels 0 are never read. A logistic
scorer of half the sample ranks positives before unlabelled text, both weighing the same. On the other half, the share
of unlabelled text over a threshold is at least the prior times the share of positives over it, and nearly equal where
only positives live; the least upper confidence bound of that quotient over all thresholds gives the estimate. Ids of
the fitting sample (``POSITIVES`` and ``UNLABELLED`` rows at most, the first by a hash of the id) are chosen without their texts; their
whole texts become feature vectors in the tasks that read them, and the driver fits on the bounded vectors. Every
row of the table is then scored in place; nothing is shuffled.

Features: byte frequencies, word and line statistics, and hashed words. Ids, languages, sources and labels are no
features.

Defined cases: a null text counts as empty; an empty text gets the score of the model's all-zero statistics; a text
of any length is read whole; repeated rows score alike; rows of the labels with a null label or id are ignored;
without any trusted positive, or without documents, every text scores ``UNTRAINED``; an empty table gives an empty
result; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import crc_mod, hidden, payload

#: Bounds of the fitting sample, and the hashed words' dimensions.
POSITIVES, UNLABELLED, HASHED = 8_000, 16_000, 256
FOLDS, THRESHOLD, UNTRAINED = 5, 0.3, 0.5
PRIOR_RANGE, CONFIDENCE = (0.02, 0.98), 0.1
STATISTICS = 14
WIDTH = 256 + STATISTICS + HASHED
_CAPITALS = re.compile(rb"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$")
_PLAIN = re.compile(rb"^[A-Za-z\x80-\xff'-]+[.,;:]?$")


class _WordCodes(dict):
    """A word's bucket, with flags for words in capitals and for plain words; kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        code = zlib.crc32(word) % HASHED
        code |= bool(_CAPITALS.match(word)) * CAPITALS | bool(_PLAIN.match(word)) * PLAIN
        if len(word) <= 64:
            self[word] = code
        return code


CAPITALS, PLAIN = 1 << 16, 1 << 17
_CODES = _WordCodes()


def features(text: bytes) -> np.ndarray:
    """The vector of one text, in UTF-8."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    out[:256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
    words = text.split()
    if not words:
        return out
    n, counts, lines = len(words), Counter(words), [x for x in text.split(b"\n") if x.strip()]
    codes = np.fromiter(map(_CODES.__getitem__, counts), np.int64, len(counts))
    often = np.fromiter(counts.values(), np.float64, len(counts))
    sizes = np.fromiter(map(len, counts), np.int64, len(counts))
    pairs = Counter(zip(words, words[1:], strict=False))
    mean = (sizes * often).sum() / n
    out[256:256 + STATISTICS] = (
        np.log1p(n), mean, np.sqrt(max((sizes ** 2 * often).sum() / n - mean ** 2, 0)), len(counts) / n,
        often.max() / n, sum(c for (a, b), c in pairs.items() if a == b) / n, len(pairs) / n,
        often[codes & CAPITALS > 0].sum() / n, often[codes & PLAIN > 0].sum() / n,
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        often[sizes <= 3].sum() / n, often[sizes == 1].sum() / n)
    out[256 + STATISTICS:] = np.sqrt(np.bincount(codes & 0xFFFF, often, HASHED) / n)
    return out


class Model(NamedTuple):
    """``sigmoid((features - mean) * scale . weights + bias)``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, vectors: np.ndarray) -> np.ndarray:
        return _sigmoid(((vectors - self.mean) * self.scale) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 150, rate: float = 0.05,
             decay: float = 1e-3, slack: float = 0.0) -> Model:
    """Minimise the non-negative unbiased risk of a linear scorer by Adam on the whole sample."""
    mean = unlabelled.mean(0)
    scale = 1 / np.maximum(unlabelled.std(0), 1e-2)
    xp, xu = (((x - mean) * scale).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(WIDTH + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    grad = lambda x, g: np.append(g.astype(np.float32) @ x, g.sum()) / len(g)
    for step in range(1, steps + 1):
        zp, zu = (x @ w[:-1].astype(np.float32) + w[-1] for x in (xp, xu))
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = grad(xu, su) - prior * grad(xp, sp)
        g = prior * grad(xp, sp - 1) + g_negative if negative >= -slack else -g_negative
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05,
                   decay: float = 1e-3) -> float:
    """The share of positives in unlabelled vectors."""
    fit_p, fit_u = positive[::2], unlabelled[::2]
    held = [x[1::2] if len(x) > 1 else x for x in (positive, unlabelled)]
    mean = fit_u.mean(0)
    scale = 1 / np.maximum(fit_u.std(0), 1e-2)
    xp, xu, hp, hu = (((x - mean) * scale).astype(np.float32) for x in (fit_p, fit_u, *held))
    w = np.zeros(positive.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    logit = lambda x: x @ w[:-1].astype(np.float32) + w[-1]
    grad = lambda x, g: np.append(g.astype(np.float32) @ x, g.sum()) / len(g)
    for step in range(1, steps + 1):
        g = 0.5 * grad(xu, _sigmoid(logit(xu))) + 0.5 * grad(xp, _sigmoid(logit(xp)) - 1)
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    zp, zu = np.sort(logit(hp)), np.sort(logit(hu))
    share_p = 1 - np.arange(len(zp)) / len(zp)
    share_u = 1 - np.searchsorted(zu, zp) / len(zu)
    doubt = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((share_u + doubt) / share_p))
    return float(np.clip(share_u[best] / share_p[best], *PRIOR_RANGE))


def _vectors(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())


def _sample(docs: DataFrame, ids: DataFrame, text: str) -> np.ndarray:
    """Feature vectors of the rows whose id is among ``ids`` (bounded, distinct), in a fixed order."""
    rows = docs.select(F.col("__id"), payload(text).alias("__text")).join(F.broadcast(ids), "__id", "left_semi")
    found = rows.select("__id", F.arrow_udf(_vectors, "binary")("__text").alias("v")).collect()
    vectors = sorted((r["__id"], bytes(r["v"])) for r in found)
    return np.frombuffer(b"".join(v for _, v in vectors), np.float32).reshape(-1, WIDTH)


def _first(ids: DataFrame, count: int) -> DataFrame:
    """``count`` distinct ids, the first by hash."""
    return ids.where("__id is not null").select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(count)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model | None:
    """Fit on the training rows (crc32 of the id modulo ``FOLDS`` is not 0); None without trusted positives."""
    keyed = docs.select(F.col(doc_id).alias("__id"), F.col(text))
    train = keyed.where(crc_mod("__id", FOLDS) != 0)
    trusted = labels.where(F.col(doc_id).isNotNull() & (F.col(label) == 1)).select(F.col(doc_id).alias("__id")).where(
        crc_mod("__id", FOLDS) != 0)
    xp = _sample(train, _first(trusted, positives), text)
    xu = _sample(train, _first(train, unlabelled), text)
    if not len(xp) or not len(xu):
        return None
    return fit_nnpu(xp, xu, estimate_prior(xp, xu) if prior is None else min(max(prior, PRIOR_RANGE[0]), PRIOR_RANGE[1]))


def score_column(model: Model | None, text: str = "text") -> Column:
    """The score of every whole text, as an Arrow function."""
    if model is None:
        return F.lit(UNTRAINED)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 512):
            part = texts[at:at + 512]
            out[at:at + 512] = model.score(np.stack([features(t.as_py()) for t in part]))
        return pa.array(out)

    return scored(payload(text))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, doc_id, text, label)
    scored = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, FOLDS) == 0).alias("held_out"),
                         score_column(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    name = hidden(docs, "score")
    model = fit(docs, labels, doc_id, text)
    return docs.withColumn(name, score_column(model, text)).where(F.col(name) >= THRESHOLD).drop(name)
