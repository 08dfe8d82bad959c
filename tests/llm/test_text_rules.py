"""Rule ledger, license scan and token counts."""

import random
import re

import pytest

from tickerloom.llm import licenses, rules, token_counts

from . import helpers as H

TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c a b c x"), (6, "a a a a"), (7, "l1\nl2\nl1\n\n l1\nl1"), (8, "# $ %\n* & | < >"),
    (9, "x y z " * 3), (10, "Ünï çödé \U0001f600 word"), (11, H.sentence(1, 300)), (12, "ALL CAPS WORDS " * 30), (13, "a\x0bb\x0cc\rd e"), (13, "a\x0bb\x0cc\rd e"),
    (14, "p q r s p q r t q r s"), (15, H.sentence(2, 20_000)),
]


def plain(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count, hit = {}, set()
    for i in range(len(w) - 2):
        count.setdefault(tuple(w[i:i + 3]), []).append(i)
    for places in count.values():
        if len(places) > 1:
            hit.update(p + o for p in places for o in range(3))
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_measures_match_a_plain_count(spark):
    got = rules.quality_rules(H.docs(spark, [(i, t, "en", "s") for i, t in TEXTS])).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in got) == sorted((i, *plain(t)) for i, t in TEXTS)
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and not (base and r.kept)
    assert {r.doc_id: r.kept for r in got}[11]


def test_policies_and_ablations_read_the_bits_alone(spark):
    led = rules.ledger(H.docs(spark, [(i, t, "en", "s") for i, t in TEXTS])).cache()
    policy = rules.POLICIES["v1"]
    bits = [r.failed for r in led.collect()]
    assert [r.kept for r in rules.apply_policy(led, policy).collect()] == [b & policy.mask == 0 for b in bits]
    for r in rules.ablations(led, policy).collect():
        rest = policy.mask & ~rules.BIT[r.rule]
        assert (r.n_fail, r.n_kept, r.n_kept_without) == (
            sum(b & rules.BIT[r.rule] != 0 for b in bits), sum(b & policy.mask == 0 for b in bits), sum(b & rest == 0 for b in bits))
    assert rules.ledger(led.limit(0).selectExpr("doc_id", "'x' AS text")).count() == 0
    led.unpersist()


def test_no_python_in_the_ledger(spark):
    plan = rules.quality_rules(H.docs(spark, [(1, "x", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def license_rows():
    rnd = random.Random(3)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC-BY-NC 4.0", "cc by nc cc by nc", "gnu general public license version 3",
             "under the the MIT license", "apache license, revised version 2", "mit", "license", "Ünder", "word " * 5, "by nc cc"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "!!!"), (103, "cc by"), (104, "CC BY NC"), (104, "CC BY NC"), (104, "other text")]


def test_license_places_match_a_plain_search(spark):
    rows = license_rows()
    got = licenses.license_scan(H.docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    want = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(p, b.label) for b in licenses.BASE for p in places(w, b.phrase)]
        at = [p for p, _ in found]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    assert licenses.license_scan(H.docs(spark, [(1, "x", "en", "s")]).limit(0)).count() == 0


def test_a_license_with_a_word_added_is_still_voted_for(spark):
    long = next(t for t in licenses.FURTHER if t.label == "bsd")
    w = long.words
    rows = [(1, " ".join(w[:7] + ["any"] + w[7:])), (2, " ".join(w[:4])), (3, long.phrase)]
    got = {r.doc_id: r for r in licenses.license_scan(H.docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got[1].labels == "bsd" and got[2].labels == "" and got[3].labels == "bsd"
    assert got[3].score == 1 and got[1].score > got[2].score


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.template_grams(spark, [licenses.Template("x", "two words")])


def test_token_counts_are_the_library_s(spark):
    rnd = random.Random(1)
    letters = "ab'sSdDtrevm ll12٣²½ªµßİﬁ\n\t\x1c\x85\xa0　#*<|endoftext|>終 "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    texts += [None, "", "x<|endoftext|>y", "<|startoftext|>", "<|ENDOFTEXT|>", H.sentence(4, 30_000), "é Å"]
    library = token_counts.tokenizer()
    rows = list(enumerate(texts))
    got = token_counts.count_tokens(H.docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert sorted(map(tuple, got)) == want
    assert token_counts.count_tokens(H.docs(spark, [(1, "x", "en", "s")]).limit(0)).count() == 0


def test_the_cache_may_overflow():
    kept, token_counts.CACHE = token_counts.CACHE, 3
    try:
        count, library = token_counts.Counter(None, {"alpha1": 2}), token_counts.tokenizer()
        for i in range(20):
            t = H.sentence(i, 30)
            assert count(t) == len(library.encode(t, add_special_tokens=False).ids)
    finally:
        token_counts.CACHE = kept


@pytest.mark.parametrize("text, labels", [
    ("licensed under the GNU General Public License, version 3 or later", "gpl-3"),
    ("the GNU General Public License, Version 2.", "gpl-2"),
    ("the GNU General Public License version 1 of 1989", ""),
    ("GNU General Public License version 2 and GNU General Public License version 3", "gpl-2,gpl-3"),
    ("the GNU Lesser General Public License, version 3", "lgpl"),
    ("the GNU Affero General Public License, version 3", ""),
    ("Mozilla Public License Version 2.0", "mpl-2"), ("Mozilla Public License Version 1.1", ""),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in full compliance", "apache-2"),
    ("Licensed under the Apache License, Version 1.1 (the License); you may not use this file except in compliance", ""),
    ("under the MIT license", "mit"), ("Creative Commons Attribution License", "cc-by"), ("Creative Commons Attribution ShareAlike License", ""),
])
def test_telling_words_of_a_license_must_match(spark, text, labels):
    df = H.docs(spark, [(1, f"{H.sentence(1, 20)} {text} {H.sentence(2, 20)}", "en", "s"), (None, text, None, None)])
    assert {r.labels for r in licenses.license_scan(df).collect()} == {labels}


def test_the_frequent_table_is_bounded_and_unshuffled(spark, monkeypatch):
    rows = [(i, f"common {H.sentence(i, 40)} common", "en", "s") for i in range(60)] + [(None, None, None, None)]
    df = H.docs(spark, rows)
    found = token_counts.frequent_lengths(df, entries=50, sample_docs=1000)
    library = token_counts.tokenizer()
    assert len(found) == 50 and "common" in found
    assert all(n == len(library.encode(w, add_special_tokens=False).ids) for w, n in found.items())
    # what the table holds changes no count
    want = sorted(map(tuple, token_counts.count_tokens(df.filter("doc_id IS NOT NULL")).collect()))
    monkeypatch.setattr(token_counts, "frequent_lengths", lambda *a, **k: {})
    assert sorted(map(tuple, token_counts.count_tokens(df.filter("doc_id IS NOT NULL")).collect())) == want
