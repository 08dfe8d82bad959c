"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans. The field runs over the tokens (runs without white space) that hold a
digit or an ``@``; all other tokens have the label "none" for certain, so what they send to their neighbours is
constant and they need no node. Neighbouring tokens share a chain potential. Skip potentials join a token with the next
one, however distant, that repeats it or is similar to it (same last seven digits, or same part before an ``@``); joining
each to the next keeps the edges linear in the tokens. Tokens in base spans are observed. Loopy message
passing (``TURNS`` damped rounds over all documents of a batch at once) carries their labels to the other places,
and tokens whose belief in one kind reaches ``BELIEF``, and that are linked to a token of the kind or have a shape
known for it, become added spans; base spans stay as they are.

The weights are learnt by pseudo-likelihood with the base spans as labels, on at most ``TRAIN_TEXTS`` distinct texts with such
tokens (those of least hash, and only texts of up to ``TRAIN_TOKENS`` of them), never by hand.

Null texts count as empty (no spans). Texts of any length are scanned whole in linear time. Offsets are code points, ends
exclusive. Spans are listed by start, then kind; those of one kind never overlap. Repeated rows get a row
each; further columns are ignored; an empty table gives an empty result.
"""

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import then_give_back

KINDS = ("email", "ip", "card", "phone")
TRAIN_TEXTS, TRAIN_TOKENS = 2000, 500
TURNS, DAMPING, BELIEF = 20, 0.3, 0.8
STEPS, RATE, PENALTY = 300, 0.1, 1e-3
#: Hashed features a token has, and their space.
SLOTS, SPACE = 12, 1 << 12
#: Place of the shape among a token's features.
SHAPE = 1

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a later start within the same digits fails as the first one does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*")
_WHITE = frozenset(" \t\n\x0b\x0c\r")
_RUNS = re.compile(r"[0-9]+|[^\W0-9_]+|(.)", re.S)


# ---- base spans -------------------------------------------------------------------

def _emails(text):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    """(start, kind number, end) of the four patterns, in order."""
    out = [(a, 0, z) for a, z in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 4 and int(p) < 256 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m.group().count, "0123456789")) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the graph --------------------------------------------------------------------

def tokens(text):
    """(start, end) of the runs without white space that hold a digit or an ``@``."""
    out, end = [], 0
    found = _MARK.search(text)
    while found:
        start = found.start()
        while start > end and text[start - 1] not in _WHITE:
            start -= 1
        end = _TOKEN.match(text, found.start()).end()
        out.append((start, end))
        found = _MARK.search(text, end)
    return out


def core(text, start, end):
    """A token's place without the punctuation around it."""
    while end > start and text[end - 1] in ".,;:!?\"')]}>":
        end -= 1
    while start < end and text[start] in "\"'([{<":
        start += 1
    if start and text[start - 1] == "(" and ")" in text[start:end] and "(" not in text[start:end]:
        start -= 1
    return start, end


def _slot(name):
    return xxhash.xxh32_intdigest(name) % SPACE


def features(word):
    """Numbers of a token's features: its shape, its makeup and its ends."""
    digits = sum(map(word.count, "0123456789"))
    shape = "".join(m.group(1) or ("9" if m.group()[0] in "0123456789" else "a") for m in _RUNS.finditer(word[:200]))
    letters = sum(c.isalpha() for c in word[:200])
    makeup = "d" * (digits > 0) + "a" * (letters > 0) + "@" * ("@" in word) + "." * ("." in word) + "-" * ("-" in word) + "(" * ("(" in word or ")" in word)
    size = min(digits, 24)
    names = ("bias", "shape " + shape[:24], "makeup " + makeup, f"digits {size}", f"digits {size} {makeup}", f"dots {min(word.count('.'), 5)} {makeup}",
             f"at {word.count('@') > 0}", f"first {word[:1] if not word[:1].isalnum() else 'x'}", f"last {word[-1:] if not word[-1:].isalnum() else 'x'}",
             f"plus {word[:1] == '+'} {min(size, 4)}", f"length {min(len(word), 40) // 3}", f"dashes {min(word.count('-'), 4)} {size}")
    return [_slot(n) for n in names]


def keys(word, whole):
    """What a token must share with another one to be linked; short ones count with their brackets."""
    same = word if len(word) >= 5 else whole.rstrip(".,;:!?")
    out = [("same", same.lower())] if len(same) >= 5 else []
    digits = "".join(c for c in word if c in "0123456789")
    if len(digits) >= 7:
        out.append(("digits", digits[-7:]))
    if "@" in word:
        out.append(("local", word.split("@")[0].lower()))
    return out


class Graph:
    """The tokens of many texts with their features, edges and observed labels."""

    def __init__(self):
        self.places, self.slots, self.label = [], [], []
        self.chain, self.skip = [], []
        self.edge = []  # for each token: whether a certain "none" stands at its left, at its right

    def add(self, doc, text, spans):
        """Tokens of a text; labels are 0 or a kind's number plus one."""
        first, before, last = len(self.places), 0, {}
        starts, most = [s for s, _, _ in spans], 0
        reach = []
        for _, _, z in spans:
            most = max(most, z)
            reach.append(most)
        for start, end in tokens(text):
            node = len(self.places)
            a, z = core(text, start, end)
            word = text[a:z]
            # the last base span that starts before the token ends decides if it reaches into it
            label, i = 0, bisect_right(starts, end - 1) - 1
            while i >= 0 and reach[i] > start:
                if spans[i][2] > start:
                    label = spans[i][1] + 1
                i -= 1
            self.places.append((doc, start, end, a, z))
            self.slots.append(features(word))
            self.label.append(label)
            gap = text[before:start]
            free = all(c in _WHITE for c in gap[:2]) and not gap.strip(" \t\n\x0b\x0c\r")
            if node > first:
                if free:
                    self.chain.append((node - 1, node))
                else:
                    self.edge[-1][1] = True
            self.edge.append([not free, False])
            for k in keys(word, text[start:end]):
                if k in last and (not free or last[k] != node - 1):
                    self.skip.append((last[k], node))
                last[k] = node
            before = end
        if len(self.places) > first:
            self.edge[-1][1] = bool(text[before:].strip(" \t\n\x0b\x0c\r"))

    def arrays(self):
        pairs = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
        return (np.array(self.slots, np.int64).reshape(-1, SLOTS), np.array(self.label, np.int64),
                np.array(self.edge, bool).reshape(-1, 2), pairs(self.chain), pairs(self.skip))


# ---- learning and inference ---------------------------------------------------------

LABELS = 1 + len(KINDS)


def untrained():
    """A field that believes in "none" everywhere."""
    w = np.zeros((SPACE, LABELS))
    w[_slot("bias"), 0] = 10.0
    return w, np.zeros((LABELS, LABELS)), np.zeros(LABELS)


def fit(slots, label, edge, chain, skip):
    """(feature weights, chain potentials, skip potential of each label) by pseudo-likelihood.

    Agreement of linked tokens has one weight for all labels. Every token is learnt from twice, the second time
    without its features, so that its neighbours alone must tell its label: with all features at hand, which tell
    the observed labels almost surely, nothing would be learnt about links.
    """
    n = len(label)
    if not n or not label.any():
        return untrained()
    # whether a token beside no base span but linked to one is personal data is what the field is to tell
    open_ = np.zeros(n, bool)
    for a, b in (skip.T, skip.T[::-1]):
        open_[a[(label[a] == 0) & (label[b] > 0)]] = True
    plain = np.full_like(slots, _slot("bias"))
    twice = lambda pairs: np.concatenate([pairs, pairs + n])
    slots, label, edge = np.concatenate([slots, plain]), np.tile(label, 2), np.tile(edge, (2, 1))
    chain, skip, n = twice(chain), twice(skip), 2 * n
    used, at = np.unique(slots, return_inverse=True)
    at = at.reshape(slots.shape)
    one = np.eye(LABELS)[label]
    left, right, near = np.zeros((n, LABELS)), np.zeros((n, LABELS)), np.zeros((n, LABELS))
    left[edge[:, 0], 0] = 1
    right[edge[:, 1], 0] = 1
    left[chain[:, 1]] = one[chain[:, 0]]
    right[chain[:, 0]] = one[chain[:, 1]]
    np.add.at(near, skip[:, 0], one[skip[:, 1]])
    np.add.at(near, skip[:, 1], one[skip[:, 0]])
    weights = [np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    share, taught = 1.0 / n, np.tile(~open_, 2)[:, None]
    for step in range(1, STEPS + 1):
        w, t, s = weights
        logit = w[at].sum(1) + left @ t + right @ t.T + near * s
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        d = (p / p.sum(1, keepdims=True) - one) * (share * taught)
        gw = np.zeros_like(w)
        np.add.at(gw, at.ravel(), np.repeat(d, SLOTS, 0))
        gradients = [gw + PENALTY * w * share, left.T @ d + d.T @ right + PENALTY * t * share, np.array([(near * d).sum()]) + PENALTY * s * share]
        for w, g, (m, v) in zip(weights, gradients, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights[2][:] = np.clip(weights[2], 0, None)  # alike tokens attract
    full = np.zeros((SPACE, LABELS))
    full[used] = weights[0]
    return full, weights[1], np.repeat(weights[2], LABELS)


def beliefs(field, slots, label, edge, chain, skip, observed=True, turns=TURNS):
    """Marginals by loopy message passing; labels other than 0 are observed."""
    w, t, s = field
    n = len(label)
    unary = w[slots].sum(1) + edge[:, :1] * t[0] + edge[:, 1:] * t[:, 0]
    if observed:
        known = np.flatnonzero(label)
        unary[known] = -50.0
        unary[known, label[known]] = 0.0
    alike = np.diag(s)
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    c, k = len(chain), len(skip)
    back = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(k, 2 * k), 2 * c + np.arange(k)])
    message = np.zeros((len(source), LABELS))
    into = np.zeros((n, LABELS))
    for _ in range(turns if len(source) else 0):
        out = unary[source] + into[source] - message[back]
        new = np.empty_like(message)
        for low, high, table in ((0, c, t), (c, 2 * c, t.T), (2 * c, 2 * c + 2 * k, alike)):
            x = out[low:high, :, None] + table
            top = x.max(1, keepdims=True)
            new[low:high] = np.log(np.exp(x - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
        into = np.zeros((n, LABELS))
        np.add.at(into, target, message)
    total = unary + into
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(1, keepdims=True)


def added_spans(graph, field):
    """(document, start, kind number, end) of the tokens outside base spans that the field labels."""
    if not graph.places:
        return []
    arrays = graph.arrays()
    p = beliefs(field, *arrays)
    best = p.argmax(1)
    chosen = (best > 0) & (arrays[1] == 0) & (p[np.arange(len(p)), best] >= BELIEF)
    # the labels know nothing of other things with digits: of a run of tokens, one must have a shape that is known as
    # one of the kind, or be linked to a token with the label
    known = field[0][arrays[0][:, SHAPE]]
    vouched = (known.argmax(1) == best) & (known.max(1) > 0)
    for a, b in (arrays[4].T, arrays[4].T[::-1]):
        vouched[a[best[a] == best[b]]] = True
    follows = np.zeros(len(p), bool)
    follows[arrays[3][:, 1]] = True
    runs, before = [], -2
    for i in np.flatnonzero(chosen):
        doc, _, _, a, z = graph.places[i]
        if a == z:
            continue
        if before == i - 1 and follows[i] and best[before] == best[i]:
            runs[-1][3], runs[-1][4] = z, runs[-1][4] or vouched[i]
        else:
            runs.append([doc, a, int(best[i]) - 1, z, vouched[i]])
        before = i
    return [tuple(r[:4]) for r in runs if r[4]]


def learn(docs, text="text", texts=TRAIN_TEXTS, most=TRAIN_TOKENS):
    """The field learnt from a bounded sample; see the module."""
    number = F.xxhash64(F.col(text))
    marked = docs.select(F.col(text).alias("t"), number.alias("h")).filter(F.col("t").rlike("[0-9@]"))
    least = [r.h for r in marked.select("h").distinct().orderBy("h").limit(texts).collect()]
    if not least:
        return untrained()

    def parse(batches):
        for b in batches:
            rows = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = Graph()
                g.add(0, t, base_spans(t))
                if len(g.places) <= most:
                    slots, label, edge, chain, skip = g.arrays()
                    rows.append((h, len(label), slots.tobytes(), label.tobytes(), edge.tobytes(), chain.tobytes(), skip.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 5)], ["h", "n", "slots", "label", "edge", "chain", "skip"])

    sample = marked.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("t").alias("t"))
    rows = sorted(sample.mapInArrow(parse, "h long, n long, slots binary, label binary, edge binary, chain binary, skip binary").collect(), key=lambda r: r.h)
    if not rows:
        return untrained()
    first = np.cumsum([0] + [r.n for r in rows])
    read = lambda name, kind, width: [np.frombuffer(getattr(r, name), kind).reshape(-1, width) for r in rows]
    moved = lambda name: np.concatenate([x + f for x, f in zip(read(name, np.int64, 2), first)])
    return fit(np.concatenate(read("slots", np.int64, SLOTS)), np.concatenate(read("label", np.int64, 1))[:, 0],
               np.concatenate(read("edge", bool, 2)), moved("chain"), moved("skip"))


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find_private(docs, text="text", key="doc_id"):
    """Per document: key, counts of base spans by kind, their hash, all spans; and how many were added."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        field = shared.value
        for b in batches:
            graph, base = Graph(), []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                found = base_spans(t) if t else []
                base.append(found)
                if t:
                    graph.add(i, t, found)
            more = [[] for _ in base]
            for i, a, k, z in added_spans(graph, field):
                more[i].append((a, k, z))
            number = [pa.array([sum(s[1] == k for s in found) for found in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *number, pa.array([listed(f) for f in base], pa.string()),
                 pa.array([listed(sorted(f + m)) for f, m in zip(base, more)], pa.string()), pa.array([len(m) for m in more], pa.int64())],
                [key, *counts, "base", "spans", "n_added"])

    out = docs.select(F.col(key), F.col(text)).mapInArrow(
        lambda batches: then_give_back(run(batches)), f"`{key}` {kind}, {', '.join(c + ' long' for c in counts)}, base string, spans string, n_added long")
    return out.select(key, *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_added")
