"""The template decides: deduction beside brute force, main slots without marks, article blocks with telling names."""

import random
from collections import defaultdict

from tickerloom.llm import html_text
from tickerloom.llm.common import landed

from . import helpers as H


def page(seed, host):
    rnd = random.Random(seed)
    body = "".join(f"<p>{H.sentence(seed * 50 + k, rnd.randint(8, 30))}</p>" for k in range(rnd.randint(1, 5)))
    menu = "".join(f"<li><a href=/{k}>{H.sentence(seed + k, 1)}</a></li>" for k in range(rnd.randint(2, 5)))
    extra = f"<div class=q><span>{H.sentence(seed, 2)}</span></div>" if rnd.random() < 0.4 else ""
    first, second = f"<ul class=m{host}>{menu}</ul>", f"<div class=z{host}>{H.sentence(seed + 7, 4)}</div>"
    if host == "turned" and seed % 2:
        first, second = second, first
    return (f"<body>{first}{second}{extra}<div class=b{host} id=t-{seed}><h1>{H.sentence(seed, 3)}</h1>{body}<div>Read more of {host}</div></div>"
            f"<div class=f>Call {H.sentence(seed + 9, 1)}</div></body>"), body


def brute(pages):
    """Per host (main, shared texts) from whole occurrence vectors."""
    by, out = defaultdict(list), {}
    for u, p in pages:
        by[html_text.host_of(u)].append((p or "", html_text.tokens(p or "")))
    for host, read in by.items():
        if len(read) < html_text.LEAST_PAGES:
            continue
        lists = [t for _, t in read]
        every = {t.key: t for found in lists for t in found}
        vectors = {k: tuple(sum(t.key == k for t in found) for found in lists) for k in every}
        classes = defaultdict(set)
        for k, v in vectors.items():
            if sum(n > 0 for n in v) >= html_text.SUPPORT * len(lists):
                classes[v].add(k)
        if not classes:
            continue
        on = lambda v: sum(n > 0 for n in v)
        top = max(classes, key=lambda v: (on(v), len(classes[v])))
        assert sum((on(v), len(classes[v])) == (on(top), len(classes[top])) for v in classes) == 1  # the fixture has no two largest classes

        def sign(v, found):
            order = [t.key for t in found if t.key in classes[v]]
            if not order:
                return None
            size = len(set(order))
            gaps = [sum(t.key in classes[top] for t in found[:i]) for i, t in enumerate(found) if t.key in classes[v]]
            return tuple(order[:size]), order == order[:size] * (len(order) // size), (0 if v == top else gaps[0], 0 if v == top else gaps[-1])

        valid = set()
        for v in classes:
            signs = {s for s in (sign(v, found) for found in lists) if s}
            if len(signs) == 1 and next(iter(signs))[1]:
                valid |= classes[v]
        below, total = defaultdict(int), 0
        for found in lists:
            w, whole = html_text.weights(found)
            total += whole
            for t, x in zip(found, w):
                below[t.key] += x

        def depth(found, i):
            return 0 if found[i].up < 0 else 1 + depth(found, found[i].up)

        differ = len({p for p, _ in read}) > 1
        best = [(max(depth(f, i) for f in lists for i, t in enumerate(f) if t.key == k), below[k], k) for k in valid
                if every[k].text is None and max(vectors[k]) == 1 and total and below[k] >= html_text.SHARE * total and (differ or every[k].level >= html_text.MAIN)]
        shared = {k for k in valid if every[k].text is not None and differ and on(vectors[k]) >= html_text.TEXT_PAGES}
        out[host] = (max(best)[2] if best else None, shared)
    return out


def test_template_beside_brute_force(spark):
    rows = [(i, f"http://{host}.example/{i}", page(i, host)[0]) for host, n in (("a", 9), ("b", 5), ("turned", 8), ("one", 1), ("two", 2)) for i in range(n)]
    rows += [(90, None, None), (91, None, ""), (92, "http://a.example/x", None), (93, "http://b.example/0", page(0, "b")[0])]
    rows += [(100 + i, "http://same.example/", page(3, "same")[0]) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = landed(html_text._read(pages, "url", "html", "page_id"), "test-pages")
    got = {r.host: (r.main, set(r.shared)) for r in html_text.templates(read).collect()}
    want = brute([(u, p) for _, u, p in rows])
    assert {h: v for h, v in want.items() if v != (None, set())} == {h: v for h, v in got.items() if v != (None, set())}
    assert want["a.example"][0] and want["b.example"][0] and not want["same.example"][0]


def test_main_slot_without_any_mark(spark):
    rows = [(i, f"http://a.example/{i}", page(i, "a")[0]) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract(pages).collect():
        body = page(r.page_id, "a")[1].removeprefix("<p>").removesuffix("</p>").replace("</p><p>", "\n")
        # menus, adverts and the foot go though their texts differ; so does the line all pages share
        assert r.text == f"{H.sentence(r.page_id, 3)}\n{body}"


def test_article_blocks_with_telling_names_stay():
    text = H.sentence(1, 40)
    assert html_text.main_text(f"<article><div class='related-work'><p>{text}</p></div><p>y</p></article>") == f"{text}\ny"
    assert html_text.main_text(f"<article><p class='search-results'>{text}</p><p>y</p></article>") == f"{text}\ny"
    for name in ("related", "related-posts", "share-buttons", "comment-list", "commentList", "ad-slot-3", "newsletter signup", "cookie-notice"):
        assert html_text.main_text(f"<article><p>{text}</p><div class='{name}'><p>gone</p></div></article>") == text


def test_long_deep_and_repeated_pages(spark):
    deep = "<div>" * 3000 + H.sentence(2, 30) + "</div>" * 3000
    long = "<article>" + "".join(f"<p>{H.sentence(k, 40)}</p>" for k in range(3000)) + "</article>"
    pages = spark.createDataFrame([(1, "http://a.example/", deep), (2, "http://b.example/", long), (2, "http://b.example/", long), (None, None, "<p>x</p>")],
                                  "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect())
    whole = "\n".join(H.sentence(k, 40) for k in range(3000))
    assert got == [(0, "x"), (1, H.sentence(2, 30)), (2, whole), (2, whole)]
