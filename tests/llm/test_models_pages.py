"""Classifiers by held-out accuracy, gradients by differences, HTML by hand and by template."""

import os
import zlib

import numpy as np
import pytest

from tickerloom.llm import html_text, quality, toxicity
from tickerloom.llm.common import table

from . import helpers as H

SF = "/root/testdata/sf0.01"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@given_tables
@pytest.mark.parametrize("score, label, least", [(quality.score_quality, "quality", 0.9), (toxicity.score_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 80 and np.mean([r.predicted == r[label] for r in got]) >= least
    for r in got:
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(spark, score):
    rows = [(i, (H.sentence(i, 80) if i % 2 else "zz ** " * 60), "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (102, H.sentence(9, 20_000), "en", "s"), (None, "x", "en", "s"), (5, H.sentence(5, 80), "en", "s")]
    docs = H.docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(100, None, None), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    first = {r.doc_id: r.score for r in got}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(first[i] >= 0.5) == (i % 2 == 1) for i in held]) > 0.9
    # labels of the held-out fold and everything but the text have no say
    flipped = spark.createDataFrame([(i, (i % 2) ^ (i in held), (i % 2) ^ (i in held)) for i in range(60)], "doc_id long, quality int, toxic int")
    other = docs.withColumns({"lang": docs["source"], "source": docs["lang"]})
    second = {r.doc_id: r.score for r in score(other, flipped).collect()}
    assert all(abs(first[i] - second[i]) < 1e-6 for i in first)
    assert score(docs, labels.limit(0)).count() == len(rows) and score(docs.limit(0), labels).count() == 0


def test_rejected_rows_go_and_columns_stay(spark):
    rows = [(i, (H.sentence(i, 80) if i % 2 else "zz ** " * 60), "en", "s") for i in range(60)] + [(None, H.sentence(70, 80), None, None)]
    docs = H.docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, labels).collect()}
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, p in scores.items() if p)


def test_gradients_match_differences():
    rnd = np.random.default_rng(1)
    model = quality.Model(np.zeros(quality.WIDTH, np.float32), np.ones(quality.WIDTH, np.float32), 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rnd.random((7, quality.WIDTH + 1))
    starts, y, w = np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.forward(x, starts)[0]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    grad = model.gradients(x, starts, y, w)
    for k in model.p:
        at = tuple(rnd.integers(0, n) for n in model.p[k].shape)
        kept = model.p[k][at]
        model.p[k][at] = kept + 1e-5
        up = loss()
        model.p[k][at] = kept - 1e-5
        down = loss()
        model.p[k][at] = kept
        assert abs(grad[k][at] - (up - down) / 2e-5) < 1e-4


def test_passages_cover_the_whole_text():
    assert len(quality.passages("é" * 5000)) == -(-10_000 // quality.PASSAGE) and len(quality.passages(None)) == 1
    marked = "a" * 100_000 + "\x01"
    assert quality.passages(marked)[-1][1] > 0
    tail = toxicity.features("a " * 50_000 + "zzqq")
    assert set(toxicity.features(" zzqq")) - set(tail) == set()


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p>First <b>bold
 text<br>next<p>Second &lt;x&gt; &#8212; &eacute; a&nbsp;b<div class="advert">Buy</div><ul><li>one<li>two</ul>
<table><tr><td>c1<td>c2</table><form><input value=x>Name</form><aside>beside</aside><section id="comments"><article class="comment">nice</article></section></article>
<footer>&copy; us</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(ARTICLE).split("\n") == [
        "Title & more", "First bold text next", "Second <x> — é a b", "one", "two", "c1", "c2"]
    for odd in (None, "", "   ", "<", "<p", "<!--", "<script>x", "&", "<p>a<b", "</p></b>", "<a href='x>y"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("x < y and <p>z") == "x < y and\nz"
    assert html_text.main_text("<article><p>cut of") == "cut of"


def shop(i):
    body = "".join(f"<p>{H.sentence(1000 * i + k, 12)}</p>" for k in range(i % 4 + 1))
    return f"<body><div>Best shop since 1999</div><div class=x><b>Menu</b> one two</div><div class=y>{body}</div><div>Call us</div></body>"


def test_template_of_pages_without_a_mark(spark):
    rows = [(i, f"http://a.example/{i}", shop(i)) for i in range(12)] + [(50, "http://b.example/", shop(3)), (51, None, shop(2)), (52, "http://a.example/n", None)]
    rows += [(53, "http://a.example/e", ""), (53, "http://a.example/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'q' AS tokens", "2 AS k")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i in range(12):
        assert got[i].text.split("\n") == [H.sentence(1000 * i + k, 12) for k in range(i % 4 + 1)]
        assert got[i].n_chars == len(got[i].text)
    assert "Best shop since 1999" in got[50].text  # one page of its host: no template
    assert got[52].text == got[53].text == ""
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.limit(0)).count() == 0


def test_marked_articles_keep_what_they_share(spark):
    line = H.sentence(5, 60)
    rows = [(i, "http://a.example/", f"<nav>m</nav><article><p>{line}</p><p>{H.sentence(i, 9)}</p></article>") for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract(pages).collect():
        assert r.text == f"{line}\n{H.sentence(r.page_id, 9)}"


def test_text_outside_a_mark_and_under_state_names_stays(spark):
    body = H.sentence(1, 40)
    assert html_text.main_text(f'<h1 class="post-title">T</h1><div class="body"><p>{body}</p></div>') == f"T\n{body}"
    assert html_text.main_text(f"<main><h1>T</h1><p>lead</p><article><p>{body}</p></article></main>") == f"T\nlead\n{body}"
    assert html_text.main_text(f"<main><p>{body}</p></main><article><p>teaser</p></article>") == f"{body}\nteaser"
    for wrap in ('class="has-sidebar"', 'id="layout-no-ads"', 'class=withComments', 'title="the hidden gem"', "title='hidden'", "title= hidden"):
        assert html_text.main_text(f"<div {wrap}><p>{body}</p></div>") == body
    for wrap in ("hidden", "class=x hidden", 'hidden="until-found"', 'class="x"hidden', "HIDDEN", 'class="has-sidebar sidebar"', 'class="cookie-notice"'):
        assert html_text.main_text(f"<div {wrap}>gone</div><p>{body}</p>") == body
    rows = [(i, "http://a.example/", f"<div>Shop</div><article><p>{H.sentence(i, 9)}</p></article><p>x{i}</p>") for i in range(10)]
    rows += [(50 + i, "http://b.example/", f"<div>Shop</div><article><p>{body}</p></article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract(pages).collect():
        assert r.text == (body if r.page_id >= 50 else f"{H.sentence(r.page_id, 9)}\nx{r.page_id}")


def test_equivalence_classes_and_their_validity(spark):
    rows = [(i, "http://a.example/", f"<div class=a><p>x</p></div>{'<i>s</i>' if i % 2 else ''}<div class=b>{i}</div>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    classes = html_text.equivalence_classes(pages)
    found = {}
    for t in classes.first().template:
        found.setdefault(t["class"], set()).add(t["token"])
    assert len(found[0]) == 4 and all(len(found[c]) >= 1 for c in found)  # div.a, p, its text, div.b come once on each page
    assert {r["class"] for r in html_text.valid_classes(pages, classes).collect()} == set(found)
    swapped = pages.unionByName(spark.createDataFrame([(9, "http://a.example/", "<div class=b>9</div><div class=a><p>x</p></div>")], pages.schema))
    again = html_text.equivalence_classes(swapped)
    assert 0 not in {r["class"] for r in html_text.valid_classes(swapped, again).collect()}


@pytest.mark.parametrize("text", ["", None, "A bc", "ÄÖ 終わり  x\ty", "aXa" * 40, "\U0001f600 é" * 9])
def test_toxicity_features_are_n_grams_of_characters(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in f" {' '.join((text or '').split())} ")
    want = set()
    for n in toxicity.GRAMS:
        for i in range(len(low) - n + 1):
            h = 0
            for c in low[i:i + n]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            k = ((h ^ n) * 0x85EBCA6B) & 0xFFFFFFFF
            k ^= k >> 13
            want.add(((k * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    assert toxicity.features(text).tolist() == sorted(want)


def test_toxicity_weights_beside_plain_gradients():
    rnd = np.random.default_rng(3)
    rows = [np.flatnonzero(np.r_[rnd.random(40) < 0.3, y, not y]).astype(np.uint32) for y in [0, 1] * 60]
    y = np.array([0, 1] * 60)
    weights, bias = toxicity.fit(rows, y)
    x = np.zeros((len(y), 42))
    for i, r in enumerate(rows):
        x[i, r] = 1
    size = 1 << toxicity.BITS
    ratio = (np.log((x[y == 1].sum(0) + 1) / (x[y == 1].sum() + size)) - np.log((x[y == 0].sum(0) + 1) / (x[y == 0].sum() + size)))
    share, gap = x.mean(0), np.abs(x[y == 1].mean(0) - x[y == 0].mean(0))
    ratio[gap < toxicity.LEAST_Z * (np.sqrt(share * (1 - share) * (1 / 60 + 1 / 60)) + 1e-12)] = 0
    w, b, m, v = np.zeros(42), 0.0, np.zeros(43), np.zeros(43)
    for step in range(1, toxicity.STEPS + 1):
        d = (1 / (1 + np.exp(-(x * ratio @ w + b))) - y) / len(y)
        g = np.append((x * ratio).T @ d + toxicity.PENALTY * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    assert np.allclose(weights[:42], w * ratio, atol=1e-6) and abs(bias - b) < 1e-9 and np.count_nonzero(weights) == 2
