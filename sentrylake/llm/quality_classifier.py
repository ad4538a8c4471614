"""Quality classifier: naive Bayes support vectors over hashed n-grams.

A text's indicators (does this n-gram of one to three UTF-8 bytes occur? do two, three, ... equal words follow each
other?) are scaled by the classes' log-count ratios
and brought to unit length; a linear model of hinge loss is fitted to them by dual coordinate descent, interpolated
with its mean weight, and its margins become probabilities by a logistic curve fitted on a part held out of the fit.

The fit uses a bounded sample: at most `max_rows` labelled documents, the first by a hash of their id. Scoring is one
narrow pass over whole texts and sees nothing but the text. Null texts count as empty and score as the intercept
does. A doc_id that has several labels gets their rounded mean; null labels and ids are left out; of several texts
with one id the smallest is learnt from. Without labels of both classes every score is the smoothed share of label 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import prepare, text_bytes

BITS, ORDERS = 18, 3
#: Places 0 to RUNS - 1 of the table also mark n-grams of one repeated word, of two to RUNS + 1 words.
RUNS = 6
#: Odd multipliers that spread an n-gram's bytes over the table.
SPREAD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
MAX_ROWS = 8_000


def indicators(text: str) -> np.ndarray:
    """Sorted table places of the n-grams that occur in the text."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32) + np.uint32(1)
    seen = np.zeros(1 << BITS, bool)
    h = np.zeros(len(b), np.uint32)
    for order in range(ORDERS):
        if len(b) <= order:
            break
        h = h[: len(b) - order] * np.uint32(0x01000193) + b[order:] * SPREAD[order]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        seen[mixed >> np.uint32(32 - BITS)] = True
    words = text.split()
    same = np.array([a == b for a, b in zip(words, words[1:])], bool)  # noqa: B905
    for order in range(RUNS):
        if not same.any():
            break
        seen[order] = True
        same = same[:-1] & same[1:]
    return np.flatnonzero(seen).astype(np.int32)


def packed(x: np.ndarray) -> np.ndarray:
    """Places in the shorter of two forms: numbers, or a bit for each place of the table. A text of any length is thus
    at most 2^BITS / 8 bytes of the sample."""
    if len(x) * 32 <= 1 << BITS:
        return x
    bits = np.zeros(1 << BITS, bool)
    bits[x] = True
    return np.packbits(bits)


def places(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int32 else np.flatnonzero(np.unpackbits(x)).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed indicator shares, positive over negative."""
    counts = {s: np.full(1 << BITS, alpha) for s in (1, -1)}
    for x, s in zip(rows, y, strict=True):
        counts[int(s)][places(x)] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |w|^2/2 + cost * hinge losses of the unit vectors r[x]/|r[x]|."""
    w, bias = np.zeros(len(r)), 0.0
    norm = np.array([max(math.sqrt(float(r[x] @ r[x])), 1e-9) for x in map(places, rows)])
    diagonal = np.array([1.0 if len(x) else 0.0 for x in rows]) + 1.0  # the intercept is a feature of value 1
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, s = places(rows[i]), y[i]
            v = r[x] / norm[i]
            gradient = s * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def margins(rows: list[np.ndarray], model: dict) -> np.ndarray:
    r, wr = model["r"], model["wr"]
    return np.array([float(wr[x].sum()) / max(math.sqrt(float((r[x] * r[x]).sum())), 1e-9) + model["bias"] if len(x) else model["bias"] for x in map(places, rows)])


def logistic(m: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin) by Newton's method, with the usual softened targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(a, 1e-3), b


def train(rows: list[np.ndarray], labels: np.ndarray, beta: float = 0.25) -> dict:
    """The model of labelled indicator rows, in the order given: each fifth row serves the logistic curve."""
    y = np.where(labels > 0, 1, -1)
    held = np.arange(len(rows)) % 5 == 4
    fit = [x for x, h in zip(rows, held, strict=True) if not h]
    if len(set(y[~held])) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        zero = np.zeros(1 << BITS, np.float32)
        return {"r": zero, "wr": zero, "bias": 0.0, "a": 1.0, "b": float(np.log(share / (1 - share)))}
    r = log_count_ratios(fit, y[~held])
    w, bias = dual_coordinate_descent(fit, y[~held], r)
    w = (1 - beta) * np.abs(w).mean() + beta * w
    model = {"r": r.astype(np.float32), "wr": (w * r).astype(np.float32), "bias": bias * beta}
    judge = [x for x, h in zip(rows, held, strict=True) if h] if len(set(y[held])) == 2 else rows
    model["a"], model["b"] = logistic(margins(judge, model), y[held] if len(set(y[held])) == 2 else y)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, training: Column | None, max_rows: int) -> DataFrame:
    """At most `max_rows` rows (doc_id, y, text)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if training is not None:
        known = known.where(training)
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", training: Column | None = None, max_rows: int = MAX_ROWS) -> dict:
    """Learn from the labelled documents for which `training` (a condition on doc_id) holds.

    The sample's indicators are made in parallel; the fit itself is one task over at most `max_rows` rows, and only
    the weight table of fixed size comes to the driver."""
    prepare(docs.sparkSession)

    @F.pandas_udf("bits boolean, x binary")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [packed(indicators(t)) for t in texts]
        return pd.DataFrame({"bits": [x.dtype != np.int32 for x in rows], "x": [x.tobytes() for x in rows]})

    def learn(batches):
        got = [(i, y, np.frombuffer(x, np.uint8 if bits else np.int32)) for b in batches for i, y, bits, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda g: g[0])
        model = train([g[2] for g in got], np.array([g[1] for g in got], int))
        yield pa.RecordBatch.from_pydict({"r": [model["r"].tobytes()], "wr": [model["wr"].tobytes()], "bias": [model["bias"]], "a": [model["a"]], "b": [model["b"]]})

    rows = sample(docs, labels, label, training, max_rows).select(F.xxhash64("doc_id").alias("h"), "y", found("text").alias("x")).select("h", "y", "x.bits", "x.x")
    got = rows.repartition(1).mapInArrow(learn, "r binary, wr binary, bias double, a double, b double").first()
    if got is None:
        return train([], np.zeros(0, int))
    return got.asDict() | {k: np.frombuffer(bytes(got[k]), np.float32) for k in ("r", "wr")}


def score_column(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """The probability of label 1, from the text alone."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = np.array([margins([indicators(t)], m)[0] for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(m["a"] * out + m["b"], -40, 40))))

    return score(text_bytes(text))
