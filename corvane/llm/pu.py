"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled 1; everything else that may be learnt from is unlabelled web text. A text becomes a few
binned style features (additive model on one-hot bins), never its id, source, language or labels. The class prior is
estimated from how densely positives and unlabelled texts meet at the top of a first model's scores; the final model
minimises  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with the logistic loss.

Null text is read as empty and gets a score like any other. Without positives or unlabelled rows every score is 0.5.
The fit sees at most TRAIN_POSITIVE and TRAIN_UNLABELLED rows, one for each id; scoring covers every whole text, however
long, and repeated rows each. A score of just THRESHOLD is predicted 1. An empty table gives no rows. Other columns, of any
name, pass unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import crc_of_id, keep_rows, labelled_sample, map_columns, one_text_each, texts

TRAIN_POSITIVE, TRAIN_UNLABELLED, THRESHOLD = 4000, 8000, 0.3
#: Bin edges of a feature are these quantiles of the positives: fine in both tails, where junk lies.
QUANTILES = (0, 0.002, 0.02, 0.1, 0.5, 0.9, 0.98, 0.998, 1)
PUNCT = b".,;:?'\"()-"
N_RAW = 16


def _runs(h: np.ndarray) -> tuple[int, int]:
    """How many values differ, and how often the commonest occurs."""
    if not len(h):
        return 0, 0
    s = np.sort(h)
    edges = np.concatenate([[-1], np.flatnonzero(s[1:] != s[:-1]), [len(s) - 1]])
    return len(edges) - 1, int(np.diff(edges).max())


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, k = max(1, len(data)), max(1, len(words))
    h = ts.word_hashes(words)
    distinct, most = _runs(h)
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    two = ts.windows(h, 2)
    return [
        np.log1p(len(words)), ts.less(data, ts.SYMBOLS) / n, ts.less(data, ts.UPPER) / n, ts.less(data, ts.DIGITS) / n, data.count(b"|") / n, data.count(b"!") / n, ts.less(data, PUNCT) / n,
        float(sizes.mean()), float(sizes.std()), float((sizes <= 3).mean()), most / k, distinct / k**0.8, _runs(two)[0] / max(1, len(two)), ts.repeat_words(h) / k,
        1 - len(set(lines)) / max(1, len(lines)), (len(data) - len(text)) / n,
    ]


class PuModel:
    def __init__(self, edges: np.ndarray, w: np.ndarray, prior: float):
        self.edges, self.w, self.prior = edges, w, prior  # w: [raw features, bins], the bias in its first row

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], 1) if len(x) else np.empty((0, N_RAW), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.w[np.arange(N_RAW), self.codes(x)].sum(1)
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _fit(cp: np.ndarray, cu: np.ndarray, prior: float, bins: int, steps: int = 500, l2: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk, by Adam; a negative part below 0 counts, and pulls, as 0."""
    w = np.zeros((N_RAW, bins))
    m, v, idx = np.zeros_like(w), np.zeros_like(w), np.arange(N_RAW)

    def grad(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(c[:, i], d, bins) for i in range(N_RAW)]) / len(c)

    for t in range(1, steps + 1):
        gp, gu = w[idx, cp].sum(1), w[idx, cu].sum(1)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        g = prior * grad(cp, sp - 1) + l2 * w
        if np.logaddexp(0, gu).mean() > prior * np.logaddexp(0, gp).mean():
            g += grad(cu, su) - prior * grad(cp, sp)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Ratio of the shares above a threshold, where its upper bound is least, less the margin of the unlabelled share."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    qp = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    qu = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    mp, mu = (np.sqrt(np.log(4 / delta) / (2 * n)) for n in (len(positive), len(unlabelled)))
    best = np.argmin(np.where(qp > 0.05, (qu + mp + mu) / np.maximum(qp, 1e-9), np.inf))
    return float(np.clip(qu[best] / qp[best] - mu, 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> PuModel:
    if not len(positive) or not len(unlabelled):
        return PuModel(np.zeros((N_RAW, 0)), np.zeros((N_RAW, 1)), 0.5)
    edges = np.stack([np.quantile(positive[:, i], QUANTILES) for i in range(N_RAW)])
    bins = edges.shape[1] + 1
    model = PuModel(edges, np.zeros((N_RAW, bins)), 0.5)
    cp, cu = model.codes(positive), model.codes(unlabelled)
    # A first model tells positives from unlabelled on every other row; the rest, which it hasn't seen, estimate the prior.
    model.w = _fit(cp[::2], cu[::2], 0.5, bins)
    model.prior = estimate_prior(model.score(positive[1::2] if len(positive) > 1 else positive), model.score(unlabelled[1::2] if len(unlabelled) > 1 else unlabelled))
    model.w = _fit(cp, cu, model.prior, bins)
    return model


def _extract(df: DataFrame) -> np.ndarray:
    def make():
        return lambda text: [[np.array(features(t)).tobytes() for t in text]]

    rows = sorted(bytes(r.x) for r in map_columns(df.select("text"), "x binary", make).collect())
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), N_RAW)


def learnable(column: str = "doc_id"):
    """Rows that may be learnt from: crc32 of the id isn't a multiple of 5."""
    return crc_of_id(column) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, positive: int = TRAIN_POSITIVE, unlabelled: int = TRAIN_UNLABELLED) -> PuModel:
    good = labelled_sample(docs, labels, learnable() & (F.col("quality") == 1), positive)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learnable() & F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(unlabelled)
    return fit(_extract(good), _extract(one_text_each(docs, ids)))


def score(docs: DataFrame, model: PuModel, threshold: float = THRESHOLD) -> DataFrame:
    def make():
        def f(ids, text, held):
            s = model.score(np.array([features(t) for t in text]))
            return [ids, held, s, (s >= threshold).astype(np.int32)]

        return f

    return map_columns(texts(docs).withColumn("held_out", ~learnable()), "doc_id long, held_out boolean, score double, predicted int", make)


def keep(docs: DataFrame, model: PuModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` or more, with their columns as they are."""
    return keep_rows(docs, "text", lambda: lambda text: model.score(np.array([features(t or "") for t in text])) >= threshold)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), threshold)
