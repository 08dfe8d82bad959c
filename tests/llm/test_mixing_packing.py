"""Mixtures against a plain restatement; packing by exact round trip."""

import hashlib
import random
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import mixing, packing

from . import helpers as H


def fill(given, children):
    """Water filling by rounds: {name: (capacity, weight)} to {name: share}; whole shares, rounded down at the end."""
    open_, share, left = dict(children), {}, Fraction(given)
    while open_:
        total = sum(w for _, w in open_.values())
        full = {n: c for n, (c, w) in open_.items() if Fraction(c, w) <= left / total}
        if not full:
            return share | {n: min(c, int(left * w / total)) for n, (c, w) in open_.items()}
        for n, c in full.items():
            share[n] = c
            left -= c
            del open_[n]
    return share


def test_budgets_match_water_filling_by_rounds(spark):
    rnd = random.Random(4)
    tree = {}
    for d in "abc":
        for la in ("en", "de"):
            for s in range(rnd.randint(1, 4)):
                tree[d, la, f"s{s}"] = rnd.choice([0, 5, 40, 300, 2000])
    weights = {("a",): 5, ("b",): 2, ("a", "en"): 3, ("c", "de", "s0"): 7}
    sizes = spark.createDataFrame([(*k, n) for k, n in tree.items()], "x string, y string, z string, tokens long")
    for total in (0, 1, 333, 2500, 10**6):
        got = {(r.x, r.y, r.z): r.budget for r in mixing.budgets(sizes, ["x", "y", "z"], weights, total, 2).collect()}
        want = {}
        cap = lambda p: 2 * sum(n for k, n in tree.items() if k[:len(p)] == p)
        kids = lambda p: {k[:len(p) + 1] for k in tree if k[:len(p)] == p}
        level = {(): total}
        for _ in range(3):
            level = {c: b for p, g in level.items() for c, b in fill(g, {c: (cap(c), weights.get(c, 1)) for c in kids(p)}).items()}
        want = level
        assert got == want


def test_prefixes_of_seeded_epochs(spark):
    rows = [(i, H.sentence(i, i % 13), ["en", "de", None][i % 3], f"src{i % 4}") for i in range(150)] + [(150, None, "en", "src0"), (3, H.sentence(3, 3), "en", "src3")]
    df = H.docs(spark, rows)
    weights = {("d0",): 1, ("d0", "en"): 5}
    from pyspark.sql import functions as F
    out = mixing.mix(df, weights, total=1500, nodes=[F.lit("d0"), F.col("lang"), F.col("source")], seed=9, max_epochs=3)
    assert [c for c in out.columns if c in df.columns] == df.columns[:df.columns.index("epoch")] + [c for c in df.columns[df.columns.index("epoch") + 1:]] + ["epoch"]
    got = sorted((r.doc_id, r.epoch, r.lang or "", r.source) for r in out.collect())
    leaves, budget = {}, {}
    for i, t, la, s in rows:
        leaves.setdefault((la or mixing.NULL_NODE, s), []).append((i, len((t or "").split())))
    for r in out.collect():
        budget[r.lang or mixing.NULL_NODE, r.source] = r.leaf_budget
    want = []
    for leaf, members in leaves.items():
        size, b = sum(n for _, n in members), budget.get(leaf, 0)
        for e in range(3):
            rest = min(size, b - size * e)
            if rest <= 0:
                break
            order = sorted((hashlib.md5(f"9:{e}:{i}".encode()).hexdigest(), i, n) for i, n in members)
            for h in sorted({h for h, _, _ in order}):
                group = [(i, n) for g, i, n in order if g == h]
                if sum(n for g, _, n in order if g <= h) <= rest:
                    want += [(i, e, "" if leaf[0] == mixing.NULL_NODE else leaf[0], leaf[1]) for i, _ in group]
    assert got == sorted(want)
    again = mixing.mix(df.repartition(7), weights, total=1500, nodes=[F.lit("d0"), F.col("lang"), F.col("source")], seed=9, max_epochs=3)
    assert sorted((r.doc_id, r.epoch, r.lang or "", r.source) for r in again.collect()) == got
    assert mixing.mix(df.limit(0), weights, nodes=[F.lit("d"), F.col("lang"), F.col("source")]).count() == 0


@given(st.lists(st.integers(1, 40), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_the_least_room_that_fits(sizes):
    bins = packing.best_fit_decreasing(sizes, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 40 for b in bins)
    rooms = []  # plain best fit over a list
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(40 - s)
    assert sorted(rooms) == sorted(40 - sum(sizes[i] for i in b) for b in bins)


def test_packing_loses_no_token(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, H.sentence(1, 3000)), (5, "x\n\n  y\t z  "), (6, "it's 12's \U0001f600 終\x1c\xa0"), (2**62 + 1, H.sentence(2, 500))]
    rows += [(10 + i, H.sentence(i, 10 + i)) for i in range(60)]
    library = packing.encoder()
    for length, buffer in ((2048, packing.BUFFER), (64, 1000)):
        packs = packing.pack(H.docs(spark, [(i, t, "en", "s") for i, t in rows]), length=length, buffer=buffer).collect()
        back = packing.unpack(packs)
        assert {i: list(map(int, ids)) for i, ids in back.items()} == {i: library.encode_ordinary(t) for i, t in rows if t}
        assert len({p.pack_id for p in packs}) == len(packs)
        for p in packs:
            ids, positions = np.frombuffer(p.ids, packing.ID_TYPE), np.frombuffer(p.positions, packing.ID_TYPE)
            assert len(ids) == len(positions) == length and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens <= length
            for a, z in zip(p.cu_seqlens, p.cu_seqlens[1:]):
                assert list(positions[a:z]) == list(range(z - a))
            assert (ids[p.n_tokens:] == packing.PAD).all()
    assert packing.pack(H.docs(spark, [(1, "x", "en", "s")]).limit(0)).count() == 0


def test_repeated_and_null_ids_are_packed_each_time(spark):
    packs = packing.pack(H.docs(spark, [(None, "one two", "en", "s"), (7, "three", "en", "s"), (7, "three", "en", "s")])).collect()
    assert sorted((d for p in packs for d in p.doc_ids), key=str) == [7, 7, None]


def test_ids_of_random_texts():
    rnd, e, library = random.Random(2), packing.Encoder(), packing.encoder()
    for _ in range(3000):
        t = "".join(rnd.choice("ab'sd \n\t  12é#\x1c\x85\xa0　終") for _ in range(rnd.randint(0, 40)))
        assert list(np.frombuffer(e.encode(t), packing.ID_TYPE)) == library.encode_ordinary(t)


def test_a_text_is_one_call_to_the_library_and_nothing_is_kept():
    """Each pre-token that was not in a cache took a call of its own."""
    e, calls = packing.Encoder(), []

    class Library:
        def encode_ordinary(self, text):
            calls.append(text)
            return packing.encoder().encode_ordinary(text)

    e.library = Library()
    texts = [" ".join(f"w{i}x{j}" for i in range(500)) for j in range(3)] + ["", None]
    assert [list(np.frombuffer(e.encode(t), packing.ID_TYPE)) for t in texts[:3]] == [packing.encoder().encode_ordinary(t) for t in texts[:3]]
    assert calls == texts[:3] and e.encode("") == e.encode(None) == b"" and len(calls) == 3
