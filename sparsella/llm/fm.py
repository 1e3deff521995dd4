"""Toxicity: a factorization machine (Rendle, 2010) over hashed terms.

A text's score is logistic in bias + sum of term weights + sum over pairs of terms of the inner
product of their factors, so a pair such as an insult with a group mention weighs more than its two
terms. Terms are lower-cased runs of letters and digits. A term that is too rare in the sample gets no
parameters, nor does one whose share in the two classes differs neither over all rows nor over those
that hold a term of the first kind: the latter is how a mention that is neutral alone gets its factors.

The fit takes at most SAMPLE labelled rows outside the held-out fold; every text is scored whole.
Defined results: null and empty texts have no terms and get the bias; with no labels of both classes
every score is the share of label 1 (0 without labels); repeated rows and equal texts get equal
scores; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .features import labelled, scored, term_features

#: Labelled rows that the fit may take, hash bits, factors, passes, cut of predicted; least rows with a term, and least deviation of its class shares.
SAMPLE, BITS, FACTORS, PASSES, CUT, LEAST, DEVIATION = 20000, 20, 8, 30, 0.5, 4, 3.0


def deviating(y: np.ndarray, row: np.ndarray, features: np.ndarray, bits: int) -> np.ndarray:
    """Whether each feature's rows are of class 1 more or less often than all rows (y); row: the row of each feature."""
    n = np.bincount(features, minlength=1 << bits).astype(float)
    hit = np.bincount(features, y[row], minlength=1 << bits)
    p = y.mean()
    return (n >= LEAST) & (np.abs(hit - n * p) >= DEVIATION * np.sqrt(n * p * (1 - p))) & (0 < p < 1)


def chosen(y: np.ndarray, ends: np.ndarray, features: np.ndarray, bits: int) -> np.ndarray:
    """Features that deviate over all rows, and those that do over the rows that hold one of these."""
    row = np.repeat(np.arange(len(y)), np.diff(ends))
    own = deviating(y, row, features, bits)
    holds = np.zeros(len(y), bool)
    holds[row[own[features]]] = True
    if not holds.any():
        return np.flatnonzero(own)
    within = holds[row]
    number = np.cumsum(holds) - 1
    return np.flatnonzero(own | deviating(y[holds], number[row[within]], features[within], bits))


def outputs(doc, term, texts: int, bias: float, w: np.ndarray, v: np.ndarray):
    """Scores before the logistic function, and for each text the sum of its terms' factors. Terms are 0 or more."""
    total = bias + np.bincount(doc, w[term], minlength=texts)
    sums = np.stack([np.bincount(doc, v[term, f], minlength=texts) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(doc, (v[term] ** 2).sum(axis=1), minlength=texts)
    return total + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def train(y: np.ndarray, doc: np.ndarray, term: np.ndarray, terms: int, factors: int = FACTORS, passes: int = PASSES, rate: float = 0.1, ridge: float = 1e-4, batch: int = 64, seed: int = 0):
    """Bias, weights and factors by minibatch gradient descent with per-parameter steps (AdaGrad) on the logistic loss."""
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(terms), rng.normal(0, 0.05, (terms, factors))
    gw, gv, gb = np.full(terms, 1e-2), np.full((terms, factors), 1e-2), 1e-2
    cuts = np.searchsorted(doc, np.arange(len(y) + 1))
    for _ in range(passes):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            n = cuts[rows + 1] - cuts[rows]
            d = np.repeat(np.arange(len(rows)), n)
            t = term[np.repeat(cuts[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            out, sums = outputs(d, t, len(rows), bias, w, v)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)
            used, at = np.unique(t, return_inverse=True)
            dw = np.bincount(at, error[d], minlength=len(used)) + ridge * w[used]
            dv = np.zeros((len(used), v.shape[1]))
            np.add.at(dv, at, error[d, None] * (sums[d] - v[t]))
            dv += ridge * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * error.sum() / np.sqrt(gb)
    return bias, w, v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, bits: int = BITS):
    """A function of (text numbers, features, texts) that gives scores."""
    y, ends, features = labelled(docs, labels, label, term_features, bits, most)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return lambda doc, feature, texts: np.full(texts, share)
    own = chosen(y, ends, features, bits)
    number = np.full(1 << bits, -1, np.int32)
    number[own] = np.arange(len(own))
    doc, term = np.repeat(np.arange(len(y)), np.diff(ends)), number[features]
    bias, w, v = train(y, doc[term >= 0], term[term >= 0], len(own))

    def score(doc: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
        term = number[feature]
        out, _ = outputs(doc[term >= 0], term[term >= 0], texts, bias, w, v)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (the probability of label 1) and predicted."""
    return scored(docs, term_features, BITS, fit(docs, labels, label, most), cut)
