"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Indicators of word and word-shape n-grams are scaled by the log ratio of their class counts, and a
linear hinge-loss model is fitted on them by dual coordinate descent (Hsieh et al., 2008). Margins
become probabilities by a logistic fit on a part of the sample that the weights have not seen.

The fit takes at most SAMPLE labelled rows outside the held-out fold; every text is scored whole.
Defined results: null and empty texts have no n-grams and get the score of their length class; with
no labels of both classes every score is the share of label 1 (0.5 without labels); repeated rows
and equal texts get equal scores; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_column, trim
from .features import labelled, scored, style_features

#: Labelled rows that the fit may take, hash bits of features, weight of hinge losses, passes, cut of predicted.
SAMPLE, BITS, COST, PASSES, CUT = 8000, 18, 1.0, 12, 0.3


def log_ratios(y: np.ndarray, ends: np.ndarray, features: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    counts = np.zeros((2, 1 << bits))
    for lo in range(0, len(y), 256):  # a few rows at a time: this runs on the driver
        hi = min(lo + 256, len(y))
        row = np.repeat(y[lo:hi], np.diff(ends[lo : hi + 1]))
        for c in (0, 1):
            counts[c] += np.bincount(features[ends[lo] : ends[hi]][row == c], minlength=1 << bits)
    q, p = counts + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_weights(y: np.ndarray, ends: np.ndarray, features: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 0) -> np.ndarray:
    """Weights w and bias (last) that minimise |w|^2/2 + cost * sum of class-balanced hinge losses on scaled, unit-length rows."""
    rows, values = [], np.empty(len(features))  # one array: thousands of small ones stay with the process when they are freed
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        x = scale[features[a:b]]
        rows.append((features[a:b], np.divide(x, max(np.sqrt(x @ x), 1e-12), out=values[a:b])))
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    w, bias, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(y)).tolist():
            at, x = rows[i]
            gradient = sign[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # |x|^2 = 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * x
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def margins(w: np.ndarray, scale: np.ndarray, doc: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
    x = scale[feature]
    total = np.bincount(doc, x * w[feature], minlength=texts)
    return total / np.sqrt(np.maximum(np.bincount(doc, x * x, minlength=texts), 1e-12)) + w[-1]


def logistic(m: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), fitted by Newton's method with a small ridge."""
    x, beta = np.stack([m, np.ones(len(m))], axis=1), np.zeros(2)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += np.clip(change, -5, 5)
        if abs(change).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, bits: int = BITS):
    """A function of (text numbers, features, texts) that gives scores. What the fit held is given back to the driver's system."""
    sample = labelled(docs, labels, label, style_features, bits, most)
    trim()
    score = _fitted(*sample, bits)
    del sample
    trim()
    return score


def _fitted(y: np.ndarray, ends: np.ndarray, features: np.ndarray, bits: int):
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return lambda doc, feature, texts: np.full(texts, share)
    part = np.random.default_rng(7).permutation(len(y)) % 5 == 0  # for the logistic fit
    if len(set(y[part].tolist())) < 2:
        part[:] = True
    row = np.repeat(part, np.diff(ends))
    held, rest = (part, ~part) if not part.all() else (part, part)
    keep = ~row if not part.all() else np.ones(len(row), bool)
    lengths = np.diff(ends)
    learned = features[keep]
    scale = log_ratios(y[rest], np.cumsum([0, *lengths[rest]]), learned, bits)
    w = hinge_weights(y[rest], np.cumsum([0, *lengths[rest]]), learned, scale)
    at = np.repeat(np.arange(held.sum()), lengths[held])
    a, b = logistic(margins(w, scale, at, features[row], int(held.sum())), y[held])
    w, scale = w.astype(np.float32), scale.astype(np.float32)

    def score(doc: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a * margins(w, scale, doc, feature, texts) + b, -30, 30)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (the probability of label 1) and predicted."""
    return scored(docs, style_features, BITS, fit(docs, labels, label, most), cut)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of docs that score the cut or more, with their columns."""
    score = fit(docs, labels, label, most)

    def run(batches):
        for batch in batches:
            keep = [score(*style_features(data, offsets, BITS), hi - lo) >= cut for lo, hi, data, offsets in slices(text_column(batch))]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
