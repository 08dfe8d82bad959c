"""Collocations, whitening and personal data against plain restatements, and their defined odd cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import collocations as C
from tickerloom.llm import private as P
from tickerloom.llm import whitening as W

from . import helpers as H


# ---- collocations -------------------------------------------------------------------

def plain_collocations(rows, least, longest=5, top=2000):
    """The contract in plain Python over (text, lang)."""
    total, f = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang or "und", tuple(words[i:i + n])] += 1
    f = {k: a for k, a in f.items() if a >= least}
    kept = []
    for (lang, p), a in f.items():
        inside = any(la == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (la, q), b in f.items())
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    out = []
    for lang in sorted({r[0] for r in kept}):
        mine = sorted((r for r in kept if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return out


def phrase_rows(seed=4, n=60):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "été", "delta", "x", "New", "york", "city", "ÀB"]
    weights = [9, 7, 5, 4, 3, 2, 6, 6, 3, 1]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randint(0, 60)):
            text += rnd.choice(["new york city ", "", ""]) + rnd.choices(words, weights)[0] + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "])
        rows.append((text, rnd.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", "en"), (rows[0][0], rows[0][1]), ("... ;", "fr")]


@pytest.mark.parametrize("shard, least", [(500_000, 5), (100, 12)])
def test_collocations_match_the_plain_count(spark, monkeypatch, shard, least):
    monkeypatch.setattr(C, "SHARD_WORDS", shard)
    rows = phrase_rows()
    df = H.docs(spark, [(i, t, la, "s") for i, (t, la) in enumerate(rows)]).repartition(3)
    got = [tuple(r) for r in C.collocations(df, least=least, top=30).orderBy("lang", "rank").collect()]
    assert got == plain_collocations(rows, least, top=30) and len(got) > 20


def test_collocations_of_one_very_long_text_and_of_nothing(spark):
    long = " ".join(["one two three four"] * 60_000)
    got = C.collocations(H.docs(spark, [(1, long, "en", "s")])).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [
        tuple(x) for x in [(r["phrase"], r["a"], 240_000) for r in got]] and {r["a"] for r in got} == {60_000, 59_999}
    for rows in ([], [(1, None, None, "s"), (2, "", "en", "s")], [(1, "a b", "en", "s")]):
        out = C.collocations(H.docs(spark, rows))
        assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("n, bits", list(itertools.product((2, 3, 5), (1, 2, 13, 25, 32, 40))))
def test_filters_are_lossless(n, bits):
    rng = np.random.default_rng(n * bits)
    parts = [rng.integers(0, 1 << bits, 400, dtype=np.uint64) for _ in range(n)]
    mixed = C.permute(parts, bits)
    assert all((a == b).all() for a, b in zip(C.restore(mixed, bits), parts))
    limbs, widths = C.limbs_of(mixed, bits)
    assert all((a == b).all() for a, b in zip(C.parts_of(limbs, n, bits), mixed))
    limbs, counts = C._summed(limbs)
    counts = counts * np.where(np.arange(len(counts)) % 7 == 0, 1000, 1)
    for low in {widths[0], max(0, widths[0] - 3)}:
        for upper in range(1 << (widths[0] - low)):
            at = (limbs[0] >> np.uint64(low) if low < 64 else np.zeros(len(counts), np.uint64)) == upper
            if at.any():
                again, n_again = C.decode_filter(C.encode_filter([x[at] for x in limbs], widths, counts[at], low), widths, low, upper)
                assert all((a == x[at]).all() for a, x in zip(again, limbs)) and (n_again == counts[at]).all()


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    rows = phrase_rows(9)
    df = H.docs(spark, [(i, t, la, "s") for i, (t, la) in enumerate(rows)])
    monkeypatch.setattr(C, "_bitmap", lambda pairs: b"\xff" * (1 << (C.PAIR_BITS - 3)))
    got = [tuple(r) for r in C.collocations(df, least=8).orderBy("lang", "rank").collect()]
    assert got == plain_collocations(rows, 8)


def test_scores_beyond_64_bits_are_exact(spark):
    # the same decimal arithmetic as in collocations, on counts no fixture can hold
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(10**12 + 7, 10**13 + 9, 10**12 + 11, 10**12 + 13)], "a long, n long, l long, r long")
    wide = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    got = df.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * wide("a", 16) * wide("n", 16), "under": wide("l", 18) * wide("r", 18)}).select(
        F.expr("over div under").cast("long").alias("s")).first().s
    assert got == 1000 * (10**12 + 7) * (10**13 + 9) // ((10**12 + 11) * (10**12 + 13))


# ---- whitening ------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, x string, n string")


def plain_whitening(vecs, k=16):
    x = np.floor(np.asarray(vecs, np.float32).astype(float) * 64) + 1000000
    u = np.unique(x, axis=0)
    c = u - u.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    dev = [sum((len(u) * int(a) - int(s)) ** 2 for a, s in zip(row, u.sum(0))) for row in x]
    return len(u), dev, (x - u.mean(0)) @ v / np.sqrt(e), e / np.trace(c.T @ c / len(u))


def test_whitening_matches_a_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)
    monkeypatch.setattr(W, "BLOCK", 37)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 20)) * np.linspace(0.5, 6, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    odd = [(900, None), (901, []), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [None] + [0.0] * 19), (905, [1.0] * 3)]
    again = [(1000 + i, rows[i % 3][1]) for i in range(60)] + [(None, rows[0][1]), (5, rows[5][1])]
    got = W.whiten(vectors(spark, rows + odd + again).repartition(9)).collect()
    assert len(got) == (300 + len(again)) * 16
    n, dev, ref, share = plain_whitening([v for _, v in rows])
    table = {(r.vec_id, r.component): r for r in got}
    ours = np.array([[table[i, j + 1].whitened for j in range(16)] for i in range(300)])
    assert np.abs(ours * np.sign((ours * ref).sum(0)) - ref).max() < 1e-9
    assert all(table[i, 1].deviation == dev[i] and table[i, 1].n == n for i in range(300))
    assert np.allclose([table[0, j + 1].explained for j in range(16)], share, rtol=1e-12)
    assert max(r.identity_error for r in got) < 1e-9
    assert table[1000, 3].whitened == table[0, 3].whitened and {r.identity_error for r in got} == {got[0].identity_error}


def test_whitening_of_few_equal_or_no_vectors(spark):
    assert W.whiten(vectors(spark, [])).collect() == []
    assert W.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    two = W.whiten(vectors(spark, [(1, [1.0, 0.0, 5.0]), (2, [0.0, 1.0, 5.0]), (3, [0.0, 1.0, 5.0])])).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(two)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert {round(abs(r.whitened), 12) for r in two} == {1.0} and {r.explained for r in two} == {1.0}


def test_large_entries_keep_deviations_exact(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate((1e12, -1e12, 3e11))]
    got = {r.vec_id: r.deviation for r in W.whiten(vectors(spark, rows)).filter("component = 1").collect()}
    x = [math.floor(float(np.float32(v[0])) * 64) + 1000000 for _, v in rows]
    exact = [(3 * a - sum(x)) ** 2 for a in x]
    assert [got[i] for i in range(3)] == [e if e < 2**63 else None for e in exact]


@pytest.mark.parametrize("make", [
    lambda g: g.standard_normal((200, 30)), lambda g: np.linalg.qr(g.standard_normal((90, 25)))[0],
    lambda g: g.standard_normal((80, 24)) * np.exp(np.linspace(0, -12, 24)), lambda g: g.standard_normal((7, 24)),
    lambda g: np.repeat(g.standard_normal((60, 6)), 3, 1), lambda g: g.standard_normal((40, 1)), lambda g: np.zeros((5, 4)),
    lambda g: g.integers(-1, 2, (50, 18)).astype(float)])
def test_solver_on_hard_spectra(make):
    a = make(np.random.default_rng(2))
    values, vectors_ = W.principal(np.linalg.qr(a, mode="r"))
    ref = np.linalg.svd(a, compute_uv=False) ** 2
    ref = ref[ref > W.RANK * ref[0]][:16] if ref[0] else ref[:0]
    assert len(values) == len(ref) and np.allclose(values, ref, rtol=1e-10)
    if len(values):
        white = a @ vectors_ / np.sqrt(values)
        assert np.abs(white.T @ white - np.eye(len(values))).max() < 1e-7
        assert np.abs(a.T @ a @ vectors_ - vectors_ * values).max() < 1e-11 * ref[0]


# ---- personal data ------------------------------------------------------------------

def plain_spans(text):
    """The contract's patterns by the plain regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def messy(seed):
    rnd = random.Random(seed)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "000.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
            "+1 (131) 555-7634", "+49.30.1234567", "+1", "é", " ", "\n", "word", "a@b.c@d.e.f", "1", "-", ".", "(", ")", "5500005555555559", "+", "\x1f", "🙂"]
    return "".join(rnd.choice(bits) + rnd.choice(["", " ", ""]) for _ in range(rnd.randint(0, 25)))


@pytest.mark.parametrize("seed", range(300))
def test_base_spans_match_the_plain_patterns(seed):
    text = messy(seed)
    assert P.base_spans(text) == plain_spans(text)


def test_base_spans_of_very_long_runs_take_linear_time():
    for unit in ("a", "1", ".1", "a.", "+1(", "1 ", "@a", "1.2.3."):
        P.base_spans(unit * 200_000)


def exact_beliefs(field, slots, label, edge, chain, skip):
    """Marginals by summing over all labellings."""
    w, t, s = field
    n = len(label)
    unary = w[slots].sum(1) + edge[:, :1] * t[0] + edge[:, 1:] * t[:, 0]
    out = np.zeros((n, P.LABELS))
    for y in itertools.product(range(P.LABELS), repeat=n):
        if any(k and k != v for k, v in zip(label, y)):
            continue
        score = sum(unary[i, v] * (label[i] == 0) for i, v in enumerate(y)) + sum(t[y[a], y[b]] for a, b in chain) + sum(s[y[a]] * (y[a] == y[b]) for a, b in skip)
        for i, v in enumerate(y):
            out[i, v] += math.exp(score)
    return out / out.sum(1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_near_on_loops():
    rng = np.random.default_rng(8)
    field = (rng.normal(0, 0.4, (P.SPACE, P.LABELS)), rng.normal(0, 0.7, (P.LABELS, P.LABELS)), np.abs(rng.normal(0, 0.8, P.LABELS)))
    slots = rng.integers(0, P.SPACE, (5, P.SLOTS))
    label = np.array([0, 0, 3, 0, 0])
    edge = rng.integers(0, 2, (5, 2)).astype(bool)
    chain, skip = np.array([[0, 1], [1, 2], [3, 4]]), np.array([[1, 4]])
    args = (field, slots, label, edge, chain, skip)
    assert np.allclose(P.beliefs(*args, turns=60), exact_beliefs(*args), atol=1e-6)
    loop = (field, slots, label, edge, chain, np.array([[1, 4], [0, 3]]))
    assert np.abs(P.beliefs(*loop, turns=200) - exact_beliefs(*loop)).max() < 0.1


def private_rows():
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        number = f"{rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        ip = ".".join(str(rnd.randint(1, 255)) for _ in range(4))
        text = rnd.choice([f"call +1 ({number} now", f"host {ip} is up", f"write x.{i}@mail.example.com soon", f"in {rnd.randint(1, 99)} days", "plain words only",
                           f"order {rnd.randint(100, 99999)} and {rnd.randint(100, 999)} parts"])
        rows.append((i, f"{H.sentence(i, 6)} {text} {H.sentence(i + 1, 4)}".replace("alpha1", "alpha")))
    return rows


def test_private_data_matches_the_patterns_and_adds_only_linked_places(spark):
    rows = private_rows() + [(900, None), (901, ""), (902, "call +1 (613) 555-0123 or later (613) 555-0123 again"), (902, "again 77"), (None, "ip 10.0.0.1")]
    df = H.docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(4)
    got = P.find_private(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        found = plain_spans(t or "")
        base = ",".join(f"{P.KINDS[k]}:{a}:{z}" for a, k, z in found)
        want[(i, *[sum(s[1] == k for s in found) for k in range(4)], hashlib.sha256(base.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        texts = [t or "" for i, t in rows if i == r.doc_id]
        base = [f"{P.KINDS[k]}:{a}:{z}" for t in texts for a, k, z in plain_spans(t)]
        spans = r.spans.split(",") if r.spans else []
        assert len([s for s in spans if s in base]) == len(spans) - r.n_added
    extra = [r for r in got if r.n_added]
    assert [r.doc_id for r in extra] == [902], "clean texts are left alone"
    text = rows[302][1]
    added = [s for s in extra[0].spans.split(",") if s not in {f"{P.KINDS[k]}:{a}:{z}" for a, k, z in plain_spans(text)}]
    kind, a, z = added[0].split(":")
    assert kind == "phone" and "555-0123" in text[int(a):int(z)]


def test_private_data_of_nothing(spark):
    assert P.find_private(H.docs(spark, [])).collect() == []
    got = P.find_private(H.docs(spark, [(1, "no digits here", "en", "s"), (2, None, None, None)])).collect()
    assert {(r.n_phone, r.spans, r.base_sha256) for r in got} == {(0, "", hashlib.sha256(b"").hexdigest())}
