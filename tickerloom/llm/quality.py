"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages (runs of ``PASSAGE`` bytes of its UTF-8 form, all of them); only the
text has a label. Each passage is encoded by its bytes and hashed byte pairs through a learnt layer;
gated attention gives each passage a weight, a softmax over the bag; the weighted passage
representation is scored. All of it is trained together from document labels.

Training uses at most ``TRAIN_DOCS`` labelled texts of each class, those of the least hash of the
id, whole; its passages and the model are all that reach the driver. Scoring runs where the
texts are read and covers every passage.

Null and empty texts are a bag of one blank passage. Labels that are null, and labels of ids that
no text has, teach nothing; without labels of both classes the score is the share of label 1
learnt from (0.5 without any). Repeated rows get a row each. Further columns are ignored; an
empty table gives no rows.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import held_out, then_give_back

PASSAGE = 1024
#: Labelled texts of each class that are learnt from at most.
TRAIN_DOCS = 2000
PAIRS, HIDDEN, ATTENTION = 512, 48, 24
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.003, 1e-4
WIDTH = 256 + PAIRS
#: Bytes of a passage whose deviations from the mean count by half.
SHORT = 200


def passages(text):
    """Matrix of the passages' features: square roots of the shares of bytes and of hashed byte pairs,
    and last how far a passage of its size can be trusted."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    if not len(raw):
        return np.zeros((1, WIDTH + 1), np.float32)
    at = np.arange(len(raw)) // PASSAGE
    one = np.bincount(at * 256 + raw, minlength=n * 256).reshape(n, 256)
    wide = raw.astype(np.uint32)
    pair = (wide[:-1] * np.uint32(40503) + wide[1:] * np.uint32(30011)) % np.uint32(65521) % PAIRS
    two = np.bincount(at[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    size = np.bincount(at, minlength=n)[:, None]
    return np.hstack([np.sqrt(np.hstack([one, two]) / size), size / (size + SHORT)]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and scorer; bags are passages in a row with their starts."""

    def __init__(self, mean, scale, seed=0):
        rnd = np.random.default_rng(seed)
        init = lambda a, b: (rnd.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {"E": init(WIDTH, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION),
                  "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}

    def forward(self, x, starts):
        p = self.p
        x = (x[:, :-1] - self.mean) * self.scale * x[:, -1:]
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return _sigmoid(z @ p["c"] + p["b"]), (x, h, t, g, a, z, sizes)

    def gradients(self, x, starts, y, weight):
        p = self.p
        score, (x, h, t, g, a, z, sizes) = self.forward(x, starts)
        d = ((score - y) * weight).astype(np.float32)
        dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = ds[:, None] * p["w"] * g, ds[:, None] * p["w"] * t
        dv, du = dt * (1 - t * t), dg * g * (1 - g)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def score(self, x):
        return float(self.forward(x, np.array([0]))[0][0])


def train(bags, labels, seed=0):
    """A model from passage matrices and labels 0 or 1 of both kinds; both kinds weigh the same."""
    every = np.vstack(bags)
    model = Model(every[:, :-1].mean(0), 1 / (every[:, :-1].std(0) + 1e-3), seed)
    y = np.asarray(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    rnd, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(v) for k, v in model.p.items()}
    for _ in range(EPOCHS):
        order = rnd.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            some = order[low:low + BATCH]
            starts = np.cumsum([0] + [len(bags[i]) for i in some[:-1]])
            grad = model.gradients(np.vstack([bags[i] for i in some]), starts, y[some], weight[some] / len(some))
            step += 1
            for k, d in grad.items():
                d = d + DECAY * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                model.p[k] = (model.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def training_rows(docs, labels, label, most, text="text", key="doc_id"):
    """Texts and labels learnt from: outside the held-out fold, at most ``most`` of each class."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col(key)))
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(most)
        picked = some if picked is None else picked.union(some)
    # at most 2 * most rows
    return docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(picked), key).select("text", "y")


def learn(docs, labels, label="quality", most=TRAIN_DOCS, text="text", key="doc_id"):
    """(model or None, share of label 1) from labelled texts."""
    def encode(batches):
        for b in batches:
            made = [passages(t) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "x": [x.astype("<f2").tobytes() for x in made]})

    rows = training_rows(docs, labels, label, most, text, key).mapInPandas(encode, "y int, x binary").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # the order of tasks must not matter
    y = [r.y for r in rows]
    if len(set(y)) < 2:
        return None, (sum(y) / len(y) if y else 0.5)
    return train([np.frombuffer(r.x, "<f2").reshape(-1, WIDTH + 1).astype(np.float32) for r in rows], y), sum(y) / len(y)


def score_quality(docs, labels, label="quality", threshold=0.5, most=TRAIN_DOCS, text="text", key="doc_id"):
    """Per document: key, held_out, score, predicted, n_passages."""
    model, share = learn(docs, labels, label, most, text, key)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            scores, sizes = [], []
            for t in b.column(1).to_pylist():
                x = passages(t)
                scores.append(m.score(x) if m else share)
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], [key, "score", "n_passages"])

    out = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double, n_passages long")
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def keep_good(docs, labels, label="quality", threshold=0.5, most=TRAIN_DOCS, text="text", key="doc_id"):
    """Rows of ``docs`` that the classifier does not reject; texts are scored where they are read."""
    model, share = learn(docs, labels, label, most, text, key)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        m = shared.value
        for b in batches:
            # text by text, so that no second copy of the batch stands beside it
            good = ((m.score(passages(t.as_py())) if m else share) >= threshold for t in b.column(at))
            yield b.filter(pa.array(list(good), pa.bool_()))

    return docs.mapInArrow(lambda batches: then_give_back(run(batches)), docs.schema)
