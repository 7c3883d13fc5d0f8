"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are all it learns from; no negative label is used. A document
becomes the shares of byte-class pairs in its UTF-8 text (which classes of characters follow each
other: letters after blanks, symbols after letters, ...) and a few shares of repetition, so every
document has the same small feature vector whatever its length or language.

A linear score ``g`` minimises the non-negative unbiased risk with logistic loss ``l``

    prior * mean_P l(g) + max(0, mean_U l(-g) - prior * mean_P l(-g))

by Newton steps. The means over P (positives) and U (all training rows, taken as unlabelled) are
sums over every training row, made by Spark; the driver sees one vector of fixed size per step.
Where the second term turns negative the step leaves the full risk and climbs back along it.

The class prior is estimated, not given: a first model tells positives from unlabelled rows, and
since U = prior * P + (1 - prior) * N, the prior is the smallest ratio of U to P mass over upper
tails of that score (where negatives are missing).
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.llm.common import tasks
from rivalgrid.session import cut_lineage

FIRST_STEPS, STEPS, RIDGE, BINS, LEAST_TAIL = 5, 7, 1e-4, 400, 0.2
THRESHOLD = 0.3

# Classes: 0 end of line, 1 blank, 2 small letter, 3 capital, 4 digit, 5 sentence mark,
# 6 other ASCII mark, 7 byte of a longer character, 8 control byte.
N_CLASSES = 9
_CLASS = np.full(256, 8, dtype=np.int64)
_CLASS[[10, 13]] = 0
_CLASS[[9, 32]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 6
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[128:] = 7
PAIRS = N_CLASSES * N_CLASSES
WIDTH = PAIRS + 6


def features(text: str | None) -> np.ndarray:
    """Square roots of: shares of class pairs, share of bytes equal to the one before, lines and
    blanks per byte, words equal to the one before, distinct words; then the constant one. A NULL or
    empty text has zeros and the one."""
    out = np.zeros(WIDTH)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data):
        kind = _CLASS[data]
        out[:PAIRS] = np.bincount(np.r_[0, kind[:-1]] * N_CLASSES + kind, minlength=PAIRS)
        out[PAIRS:PAIRS + 3] = np.count_nonzero(data[1:] == data[:-1]), np.count_nonzero(kind == 0), np.count_nonzero(kind == 1)
        out /= len(data)
        words = text.split()
        if words:
            out[PAIRS + 3] = sum(map(operator.eq, words[1:], words)) / len(words)
            out[PAIRS + 4] = len(set(words)) / len(words)
        out = np.sqrt(out)
    out[-1] = 1.0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _total(table: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of a vector function of (features, positive flags): each task adds up its
    rows, a square root of the tasks add up those, and the driver adds up what is left."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float32).reshape(batch.num_rows, WIDTH)
                total += sums(x.astype(np.float64), np.array(batch.column(1).to_pylist(), dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["part"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["part"])

    fewer = math.ceil(math.sqrt(tasks(table.sparkSession)))
    parts = table.select("x", "positive").mapInArrow(inside, "part binary").repartition(fewer).mapInArrow(across, "part binary").collect()
    return np.sum([np.frombuffer(p.part) for p in parts], axis=0) if parts else np.zeros(width)


def _risk_sums(w: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Counts, losses, gradients and curvature of P and U at ``w``, as one flat vector."""

    def sums(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = x @ w
        s = _sigmoid(z)
        xp, sp, zp = x[positive], s[positive], z[positive]
        curve, curve_p = (x * (s * (1 - s))[:, None]).T @ x, (xp * (sp * (1 - sp))[:, None]).T @ xp
        return np.r_[len(xp), len(x), _softplus(-zp).sum(), _softplus(zp).sum(), _softplus(z).sum(),
                     xp.sum(axis=0), sp @ xp, s @ x, curve_p.ravel(), curve.ravel()]

    return sums


@dataclass(frozen=True)
class Sums:
    n_p: float
    n_u: float
    loss_p: float
    anti_p: float
    anti_u: float
    x_p: np.ndarray
    g_p: np.ndarray
    g_u: np.ndarray
    h_p: np.ndarray
    h_u: np.ndarray


def _sums(table: DataFrame, w: np.ndarray) -> Sums:
    v = _total(table, _risk_sums(w), 5 + 3 * WIDTH + 2 * WIDTH * WIDTH)
    at = np.cumsum([5, WIDTH, WIDTH, WIDTH, WIDTH * WIDTH])
    x_p, g_p, g_u, h_p, h_u = np.split(v, at)[1:]
    n_p, n_u = max(v[0], 1.0), max(v[1], 1.0)
    return Sums(v[0], v[1], v[2] / n_p, v[3] / n_p, v[4] / n_u, x_p / n_p, g_p / n_p, g_u / n_u,
                h_p.reshape(WIDTH, WIDTH) / n_p, h_u.reshape(WIDTH, WIDTH) / n_u)


@dataclass(frozen=True)
class Model:
    """weights is None where there was no positive to learn from: every score is then one half."""

    weights: np.ndarray | None
    prior: float

    def score(self, text: str | None) -> float:
        return 0.5 if self.weights is None else float(_sigmoid(features(text) @ self.weights))


def _prior(table: DataFrame, w: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive mass over upper tails of the first score."""

    def histogram(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(x @ w) * BINS).astype(int), BINS - 1)
        return np.r_[np.bincount(at[positive], minlength=BINS), np.bincount(at, minlength=BINS)].astype(float)

    p, u = np.split(_total(table, histogram, 2 * BINS), 2)
    p_tail, u_tail = np.cumsum(p[::-1]) / max(p.sum(), 1), np.cumsum(u[::-1]) / max(u.sum(), 1)
    wide = p_tail >= LEAST_TAIL
    return float(np.clip((u_tail[wide] / p_tail[wide]).min(), 0.01, 0.99))


def learn(table: DataFrame) -> Model:
    """Fit on ``table``: x (features as float32 bytes), positive (flag); every row is used."""
    w = np.zeros(WIDTH)
    ridge = RIDGE * np.eye(WIDTH)
    for _ in range(FIRST_STEPS):
        s = _sums(table, w)
        if s.n_p == 0:
            return Model(None, 0.5)
        gradient = 0.5 * (s.g_u - (s.x_p - s.g_p)) + RIDGE * w
        w = w - np.linalg.solve(0.5 * (s.h_p + s.h_u) + ridge, gradient)
    prior = _prior(table, w)
    w = np.zeros(WIDTH)
    for _ in range(STEPS):
        s = _sums(table, w)
        unlabelled_part = s.anti_u - prior * s.anti_p
        if unlabelled_part >= 0:
            # the gradient of l(z) - l(-z) is -1, so P enters the full risk by its mean features alone
            gradient = s.g_u - prior * s.x_p + RIDGE * w
        else:
            gradient = -(s.g_u - prior * s.g_p)
        w = w - np.linalg.solve(s.h_u + ridge, gradient)
    return Model(w, prior)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from all documents outside the held-out fifth; ``labels`` (doc_id, quality) name the
    positives (quality 1). Rows without a doc_id are not learned from."""
    ids = F.col(doc_id).cast("string")
    rows = docs.where(F.crc32(ids) % 5 != 0).select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, type=pa.binary())], names=["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    described = cut_lineage(rows.mapInArrow(describe, f"id {kind}, x binary"))
    positives = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("known")).distinct()
    table = described.join(positives, "id", "left").select("x", F.coalesce("known", F.lit(False)).alias("positive"))
    return learn(cut_lineage(table))


def score(text: str | Column, model: Model) -> Column:
    """Score of a text column between 0 and 1; a NULL text scores as an empty one."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``.

    NULL or empty texts get the score of the empty text; equal texts get equal scores; rows without
    a doc_id count as not held out. An empty table gives an empty table. Other columns are not read.
    """
    model = fit(docs, labels, doc_id, text)
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col(doc_id), held_out.alias("held_out"), score(F.col(text), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they are."""
    model = fit(docs, labels, doc_id, text)
    return docs.where(score(F.col(text), model) >= THRESHOLD)
