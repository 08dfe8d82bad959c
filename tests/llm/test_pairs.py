"""Jaccard join and decontamination against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import decontaminate, jaccard_join

from . import helpers as H


def near(text, seed, changes):
    rnd, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 10**6)}"
    return " ".join(w)


def corpus():
    base = H.sentence(1, 120)
    rows = [(i, near(base, i, i % 7)) for i in range(40)]  # near copies of one text, some not near each other
    rows += [(100 + i, base) for i in range(6)] + [(200 + i, H.sentence(50 + i, 60)) for i in range(20)]
    passage = H.sentence(2, 55)
    rows += [(300 + i, passage + " " + H.sentence(90 + i, 80)) for i in range(15)]  # a shared passage links nothing
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One two"), (404, "one TWO"), (405, "one"), (406, "Ünï çode"), (406, "Ünï çode")]
    chain = H.sentence(3, 100).split()
    rows += [(500 + i, " ".join(chain[4 * i:4 * i + 60])) for i in range(8)]  # neighbours link, ends do not
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    got = jaccard_join.jaccard_components(H.docs(spark, [(i, t, "en", "s") for i, t in rows]))
    assert sorted(map(tuple, got.collect())) == sorted(H.components(rows))


def test_stars_alone_and_none_give_the_same(spark):
    rows = corpus()
    kept = jaccard_join.links
    want = sorted(H.components(rows))
    for stars in (1, 2):
        try:
            jaccard_join.links = lambda live, similarity, s=stars: kept(live, similarity, s)
            got = jaccard_join.jaccard_components(H.docs(spark, [(i, t, "en", "s") for i, t in rows]))
            assert sorted(map(tuple, got.collect())) == want
        finally:
            jaccard_join.links = kept


def test_null_ids_large_ids_and_empty_table(spark):
    big = 2**62 + 1
    rows = [(None, "a b c d e f"), (big, "a b c d e f"), (big + 1, "z y x w v u")]
    got = jaccard_join.jaccard_components(H.docs(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, big), (big, big), (big + 1, big + 1)], key=str)
    empty = H.docs(spark, [(1, "x", "en", "s")]).limit(0)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.one_of_each(empty).columns == empty.columns


def test_one_of_each_keeps_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand in this text"), (3, "other words stand in this text"), (4, None), (5, "")]
    got = jaccard_join.one_of_each(H.docs(spark, [(i, t, "en", "s") for i, t in rows]))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]


def test_one_of_each_goes_by_row(spark):
    a, b, c, d = (H.sentence(60 + i, 30) for i in range(4))
    rows = [(1, a), (2, a), (2, b), (7, c), (7, d), (None, c), (None, H.sentence(70, 30)), (None, H.sentence(71, 30)), (None, H.sentence(71, 30)),
            (8, None), (8, None), (None, ""), (9, d + " tail"), (9, d + " tail")]
    docs = H.docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = jaccard_join.one_of_each(docs)
    want = [(1, a), (2, b), (7, c), (7, d), (None, H.sentence(70, 30)), (None, H.sentence(71, 30)), (8, None), (8, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str) and got.columns == docs.columns


@given(st.text(), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_set_sizes_are_those_of_the_words(text, n):
    assert len(jaccard_join.shingle_set(text, jaccard_join.WordHashes(), n)) == len(H.shingles(text, n))


ITEMS = [(1, H.sentence(7, 30)), (2, H.sentence(8, 14)), (3, "just three words"), (4, None), (5, "..."), (6, H.sentence(9, 40)), (6, H.sentence(10, 16))]


def test_passages_are_found_and_clean_texts_left_alone(spark):
    dressed = H.sentence(7, 30).upper().replace(" ", ", ", 3)
    rows = [
        (1, H.sentence(20, 200) + " " + dressed + ". " + H.sentence(21, 50)),
        (2, H.sentence(8, 14)), (3, "Just THREE words!"), (4, H.sentence(22, 300)), (5, None), (6, ""),
        (7, " ".join(H.sentence(9, 40).split()[:38])), (8, " ".join(H.sentence(9, 40).split()[:20])),
        (9, H.sentence(7, 30) + " x " + H.sentence(7, 30)), (10, H.sentence(10, 16)), (10, H.sentence(10, 16))]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS len", "'q' AS grams")
    docs = H.docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 3), (7, 6), (9, 1), (10, 6)]
    assert {r.doc_id: r.first_word for r in got}[1] == 200
    kept = decontaminate.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8] and kept.columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs, bench.filter("text IS NULL")).columns == ["doc_id", "item_id", "similarity", "first_word"]


def test_items_that_share_an_id_or_have_none_are_found(spark):
    texts = [H.sentence(40 + i, 24) for i in range(4)]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "item_id long, text string")
    docs = H.docs(spark, [(i, H.sentence(80 + i, 50) + " " + t, "en", "s") for i, t in enumerate(texts)] + [(9, H.sentence(90, 80), "en", "s")])
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.similarity, r.first_word) for r in got), key=str) == [
        (0, 1, 1.0, 50), (1, 1, 1.0, 50), (2, None, 1.0, 50), (3, None, 1.0, 50)]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [9]


def test_fingerprints_of_alike_windows_lie_within_the_radius(spark):
    """Windows of similarity 0.75 or more with random changes: all within the radius."""
    from pyspark.sql import functions as F

    rnd, rows = random.Random(5), []
    for i in range(120):
        w = H.sentence(1000 + i, rnd.randint(14, 59)).split()
        v = list(w)
        v[rnd.choice([0, -1, 1])] = "changed"
        rows += [(i, 0, w), (i, 1, v)]
    df = spark.createDataFrame(rows, "p int, side int, w array<string>").select("p", "side", F.explode(decontaminate._grams("w", 5)).alias("gram"))
    prints = {(r.p, r.side): (r.print, set(r.grams)) for r in decontaminate._fingerprints(df, ["p", "side"]).collect()}
    alike = 0
    for i in range(120):
        (a, x), (b, y) = prints[i, 0], prints[i, 1]
        if 100 * len(x & y) >= 75 * len(x | y):
            alike += 1
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= decontaminate.RADIUS
    assert alike > 60


def test_decontamination_goes_by_row_not_by_id(spark):
    item = H.sentence(77, 30)
    bad, clean = f"{H.sentence(1, 8)} {item} {H.sentence(2, 8)}", H.sentence(3, 60)
    bench = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    rows = [(None, bad, "en", "s"), (None, clean, "en", "s"), (5, bad, "en", "s"), (5, clean, "en", "s"), (5, clean, "en", "s"), (6, None, None, None), (7, "", "en", "s")]
    kept = decontaminate.decontaminated(H.docs(spark, rows), bench)
    assert kept.columns == H.docs(spark, rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(0, clean), (5, clean), (5, clean), (6, ""), (7, "")])
    assert decontaminate.decontaminated(H.docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminated(H.docs(spark, []), bench).count() == 0


def test_incidence_packs_by_cells(spark, monkeypatch):
    """Documents are packed together up to a number of cells as well, across batches, and copies and null keys keep their rows."""
    monkeypatch.setattr(jaccard_join, "BATCH_CELLS", 300)
    rows = [(i, H.sentence(i, 104)) for i in range(12)] + [(None, H.sentence(0, 104)), (50, None)]  # 100 shingles each
    docs = H.docs(spark, [(i, t, "en", "s") for i, t in rows]).coalesce(1)
    found = jaccard_join._incidence(docs, "doc_id", "bigint", "text", 3, 5).collect()
    cells = {}
    for r in found:
        if r.idx < 0:
            cells[r.uid] = cells.get(r.uid, 0) + len(r.cells) // 7
    assert sum(cells.values()) == 1300 and len(cells) == 5 and max(cells.values()) == 300
    heads = sorted((r.no_key, r.key, r.n) for r in found if r.idx >= 0)
    assert heads == sorted([(False, i, 100) for i in range(12)] + [(False, 50, 0), (True, 0, 100)])


def test_pipeline_texts_cross_in_small_batches(spark):
    import corpus_pipeline
    from tickerloom.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for known, then in (("10000", common.TEXTS_A_BATCH), ("0", common.TEXTS_A_BATCH), ("7", 7)):
            spark.conf.set(name, known)
            corpus_pipeline.packing_stage(spark, H.docs(spark, [(1, "a b", "en", "s")]), None)
            assert int(spark.conf.get(name)) == then
    finally:
        spark.conf.set(name, before)
