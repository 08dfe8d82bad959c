"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of 3 to 6 characters (code points) of the A-Z lowered text with
white space as one blank. Each is scaled by the log ratio of its smoothed share among toxic and other labelled
texts, and a logistic regression with an L2 penalty is fitted on the scaled features. Features
whose shares of texts differ by less than ``LEAST_Z`` standard errors are noise that adds up in
long texts; they get weight 0.

At most ``TRAIN_DOCS`` labelled texts of each class are learnt from, those of the least hash of the
id, whole. Scoring runs where the texts are read and covers whole texts.

Null and empty texts have no features and get the score of the intercept. Labels that are null
teach nothing; without labels of both classes the score is the share of label 1 (0 without any).
Repeated rows get a row each. Further columns are ignored; an empty table gives no rows.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import held_out
from .quality import training_rows

TRAIN_DOCS = 2000
GRAMS = (3, 4, 5, 6)
BITS = 20
STEPS, RATE, PENALTY = 120, 0.05, 1e-2
LEAST_Z = 4.0

_P = np.uint32(0x01000193)
_SEEN = np.zeros(1 << BITS, np.bool_)


def features(text):
    """Sorted distinct features of a whole text."""
    b = np.frombuffer(f" {' '.join((text or '').split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + np.uint32(32), b)
    n_most = max(GRAMS)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, min(n_most, len(b)) + 1):
        h = h[:len(b) - n + 1] * _P + b[n - 1:]
        if n in GRAMS:
            k = (h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
            k ^= k >> np.uint32(13)
            _SEEN[(k * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(_SEEN).astype(np.uint32)
    _SEEN[found] = False
    return found


def _packed(found):
    """Features as compressed gaps, about a byte each on their way to the driver."""
    return zlib.compress(np.diff(found, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpacked(raw):
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<u4"), dtype=np.uint32)


def fit(rows, labels):
    """(weights on presence, intercept) from feature arrays and labels of both kinds."""
    y = np.asarray(labels, np.float64)
    size = 1 << BITS
    toxic, clean = np.zeros(size), np.zeros(size)
    for r, of in zip(rows, y):  # a text has a feature once
        (toxic if of else clean)[r] += 1
    ratio = np.log((toxic + 1) / (toxic.sum() + size)) - np.log((clean + 1) / (clean.sum() + size))
    n, n_toxic = len(y), y.sum()
    share = (toxic + clean) / n
    error = np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / (n - n_toxic))) + 1e-12
    ratio[np.abs(toxic / n_toxic - clean / (n - n_toxic)) < LEAST_Z * error] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    every, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, every = np.unique(every, return_inverse=True)
    r, size = ratio[used][every], len(used)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    b = mb = vb = 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for step in range(1, STEPS + 1):
        logit = np.bincount(doc, weights=w[every] * r, minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        g = np.bincount(every, weights=d[doc] * r, minlength=size) + PENALTY * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratio[used]
    return weights, float(b)


def learn(docs, labels, label="toxic", most=TRAIN_DOCS, text="text", key="doc_id"):
    """(weights or None, intercept or share) from labelled texts."""
    def encode(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [_packed(features(t)) for t in b["text"]]})

    rows = training_rows(docs, labels, label, most, text, key).mapInPandas(encode, "y int, x binary").collect()
    y = [r.y for r in rows]
    if len(set(y)) < 2:
        return None, (sum(y) / len(y) if y else 0.0)
    rows.sort(key=lambda r: (r.y, r.x))  # the order of tasks must not matter
    return fit([_unpacked(r.x) for r in rows], [r.y for r in rows])


def score_toxicity(docs, labels, label="toxic", threshold=0.7, most=TRAIN_DOCS, text="text", key="doc_id"):
    """Per document: key, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, most, text, key))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        w, b = shared.value
        for x in batches:
            texts = x.column(1).to_pylist()
            if w is None:
                scores = np.full(len(texts), float(b))
            else:
                logit = np.array([float(w[features(t)].sum()) + b for t in texts])
                scores = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(scores, pa.float64())], [key, "score"])

    out = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double")
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
