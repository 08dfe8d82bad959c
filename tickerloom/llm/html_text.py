"""Main text of web pages by equivalence classes of template tokens.

Pages are read once, as tokens: opening tags with their path, class and id (digits in them count alike),
and text blocks with their path. On each host, tokens with the same occurrence vector - as often on each page -
form an equivalence class; vectors are compared by 62-bit sums over pages, so they are added up before the
shuffle and no host is ever in one task. A class that enough of the host's pages share is valid
if its tokens come in one order on all of them and sit in one gap of the host's largest
class (its root); valid classes nested in the root are the template. What is left of a page
are its slots.

The main slot of a host is the deepest element of the template, once a page, that holds ``SHARE`` of the text outside
links. Marks are evidence in this sum: text in an article counts 16 times, in a main part 4 times, under a telling class or
id twice, and text marked as a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment (by tag,
role, class or id) counts nothing. Where all pages of a host are alike, and on a page without its host's main slot, the
page's own elements are asked, and only an article or a main part can be the main slot.

Kept are the blocks of the main slot, and outside it those of an article, a main part or a telling class and plain
paragraphs and headings without links; never blocks marked as something else. Template text that ``TEXT_PAGES`` pages and
more share goes, but for paragraphs, headings, list items and cells in marked parts, as a passage that many
articles share is. A page without a main slot keeps all its slots. If nothing stays, the page is a copy of its
template and its strongest marked blocks are its text. Within a block white space becomes one space; line breaks are
white space. Blocks are joined in page order by one newline.

Null and empty pages have an empty text. Repeated pages get a row each and count as pages of their
host. Pages without a host share the empty host. Cut-off pages are read up to where they end. Very long pages are read
whole. Of several elements at equal depth the one with more text is the main slot. Further
columns are ignored; an empty table gives no rows.
"""

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import broadcast_checked, landed

#: Share of a host's pages a template token is on, and pages from which a host has classes (one page shows none).
SUPPORT, LEAST_PAGES = 0.5, 2
#: Share of the text outside links that a main slot holds; pages that share a text before it counts as template.
SHARE, TEXT_PAGES = 0.8, 4

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset((
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul").split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements and roles that hold no main text.
ASIDE_TAGS = frozenset(
    "nav footer aside form script style noscript template button select iframe object svg canvas audio video dialog menu head textarea".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert status".split())
#: Words in a class or id that mark something beside the article.
ASIDE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent "
    "gdpr notice notices notification notifications sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar "
    "toolbar comment comments commentlist disqus reply replies respond related recommended recommendations widget widgets share sharing "
    "social newsletter subscribe subscription signup login popup modal overlay paywall pagination pager search").split())
NOT_ARTICLE = frozenset("comment comments reply replies ad ads advert sponsored promo related widget".split())
#: Words that make no other thing of an element named by ASIDE_WORDS: "comment-list" is comments, "related-work" is not "related".
FORM_WORDS = frozenset((
    "area articles bar block body bottom box button buttons container content footer form global group header inner item items left "
    "line link links list main news outer page panel post posts primary reader right row secondary section site slot stories text title top "
    "unit user users wrap wrapper").split())
#: A class or id that holds one of these tells what a page has or lacks, not what the element is.
STATE_WORDS = frozenset("has have no not non with without".split())
CONTENT_WORDS = frozenset("article articlebody content maincontent entry post story".split())

NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)(" + NAME + r")((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)(" + NAME + r")([^>]*)>|<[!?/][^>]*(?:>|\Z)|<" + NAME + r"[^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VALUE = re.compile(r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HIDDEN = re.compile(r"(?:^|[\s\"'/])hidden(?:[\s=/]|$)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
DIGITS = re.compile(r"[0-9]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _attributes(raw):
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _label_words(attrs):
    """(all words of class and id, words of those names that say nothing else)."""
    found, plain = set(), set()
    for named in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        split = {w.lower() for w in WORDS.findall(named)}
        parts = split | set(re.split(r"[^a-z0-9]+", named.lower()))
        if not parts & STATE_WORDS:
            found |= parts
            if all(w in ASIDE_WORDS or w in FORM_WORDS or w.isdigit() for w in split) or named.lower() in ASIDE_WORDS:
                plain |= parts
    return found, plain


def _beside(name, raw, attrs, words, plain, inside):
    if name in ("html", "body"):
        return False
    if name in ("article", "main"):
        return bool(words & NOT_ARTICLE)
    if name in ASIDE_TAGS or attrs.get("role", "").lower() in ASIDE_ROLES or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "hidden" in raw.lower() and HIDDEN.search(VALUE.sub("= ", raw)) or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    # inside an article a name must say nothing else
    return bool((plain if inside else words) & ASIDE_WORDS) or not inside and (name == "header" or "header" in words)


#: How strongly a page marks a part as its article: an article, a main part, a class or id; what its text counts.
ARTICLE, MAIN, HINT = 3, 2, 1
EVIDENCE = (1, 2, 4, 16)
#: Elements of running text; elements of lists and tables.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CELLS = frozenset("li dt dd td th caption figcaption".split())
PARAGRAPH, CELL = 2, 1


class Token(NamedTuple):
    """An opening tag (``text`` is None) or a text block; ``up`` is the index of the element around it."""
    key: int
    text: str
    up: int
    level: int
    beside: bool
    flow: int
    linked: bool


class _Element(NamedTuple):
    name: str
    level: int
    beside: bool
    path: int
    at: int
    flow: int
    linked: bool


_OUTSIDE = _Element("", 0, False, 0, -1, 0, False)


def tokens(page):
    """The tokens of a page, in order."""
    out, stack, held = [], [], []
    here = _OUTSIDE

    def block():
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                first = held[0][1]
                linked = all(e.linked for t, e in held if t.strip())
                out.append(Token(_key(f"{first.path}|{text}"), text, first.at, first.level, first.beside, first.flow, linked))
            held.clear()

    def add(raw):
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            if held and (held[0][1].level, held[0][1].beside) != (here.level, here.beside):
                # inline text of another kind: a block of its own, unless it is only white space
                if text.strip():
                    block()
                else:
                    return
            held.append((text, here))

    def leave(i):
        nonlocal here
        del stack[i:]
        here = stack[-1] if stack else _OUTSIDE

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, raw, name = m[1] or m[4], m[3] or m[6] or "", name.lower()
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if name in BLOCKS:
                block()
            if i is not None and (name in BLOCKS or not any(s.name in BLOCKS for s in stack[i:])):
                leave(i)
            continue
        if name == "br":
            add(" ")
        if name in BLOCKS:
            block()
            if name in CLOSES:
                ends, bounds = CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in ends:
                        leave(i)
                        break
                    if stack[i].name in bounds:
                        break
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        leave(i)
                        break
                    if stack[i].name in BLOCKS:
                        break
        attrs = _attributes(raw) if raw else {}
        words, plain = _label_words(attrs) if attrs else (frozenset(), frozenset())
        side = here.beside or _beside(name, raw, attrs, words, plain, here.level >= MAIN)
        told = (ARTICLE if name == "article" else MAIN if name == "main" or attrs.get("role") == "main"
                else HINT if words & CONTENT_WORDS and name not in ("html", "body") else 0)
        level = max(here.level, told)
        label = DIGITS.sub("0", f"{name}.{attrs.get('class', '')}#{attrs.get('id', '')}") if attrs else name
        flow = here.flow if name not in BLOCKS else PARAGRAPH if name in PARAGRAPHS else CELL if name in CELLS else 0
        out.append(Token(_key(f"{here.path}>{label}"), None, here.at, level, side, flow, False))
        if name in VOID or raw.endswith("/"):
            continue
        if name in RAW:
            found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        here = _Element(name, level, side, _key(f"{here.path}>{name}"), len(out) - 1, flow, here.linked or name == "a")
        stack.append(here)
    block()
    return out


def _key(signature):
    return xxhash.xxh64_intdigest(signature.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url):
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def weights(found):
    """Per token the text outside links below it, as marks count it; and the sum over the page."""
    below, total = [0] * len(found), 0
    for i in range(len(found) - 1, -1, -1):
        t = found[i]
        if t.text is not None:
            below[i] = 0 if t.beside or t.linked else len(t.text) * EVIDENCE[t.level]
            total += below[i]
        if t.up >= 0:
            below[t.up] += below[i]
    return below, total


def own_main(found, share=SHARE):
    """Key of the main slot by one page alone: the deepest element, once on it, marked as article or main part."""
    below, total = weights(found)
    times, depth, best = {}, [], None
    for t in found:
        times[t.key] = times.get(t.key, 0) + 1
        depth.append(depth[t.up] + 1 if t.up >= 0 else 0)
    for i, t in enumerate(found):
        if t.text is None and t.level >= MAIN and not t.beside and times[t.key] == 1 and total and below[i] >= share * total:
            best = max(best or (-1, 0, 0), (depth[i], below[i], t.key))
    return best and best[2]


def choose(found, main=None, template=frozenset(), share=SHARE):
    """Main text from a page's tokens, the key of its host's main slot and the keys of template texts."""
    if main is None or all(t.key != main for t in found):
        main = own_main(found, share)
    inside, kept, blocks = [], [], []
    for t in found:
        inside.append(t.text is None and t.key == main or t.up >= 0 and inside[t.up])
        if t.text is None or t.beside:
            continue
        blocks.append(t)
        shared = t.key in template
        if t.level >= HINT:
            stays = not shared or t.flow > 0
        elif main is None or inside[-1]:
            stays = not shared
        else:
            stays = not shared and t.flow == PARAGRAPH and not t.linked
        if stays:
            kept.append(t.text)
    if not kept:
        most = max((t.level for t in blocks), default=0)
        kept = [t.text for t in blocks if most and t.level == most]
    return "\n".join(kept)


def main_text(page, main=None, template=frozenset()):
    """Main text of a page; ``main`` and ``template`` are its host's main slot and template texts."""
    return choose(tokens(page), main, template) if page else ""


#: A page read once: its number, its tokens in order, texts of the blocks, and each distinct token's count,
#: weight, depth (-1: a text) and level.
_READ = ("row long, host string, same long, total long, keys array<long>, ups array<int>, marks array<int>, texts array<string>, "
         "found array<struct<token:long,n:int,w:long,depth:int,level:int>>")
PAGES_A_BATCH = 100


def _read(pages, url, page, key=None):
    """Parse each page once; with ``key`` also (k, u) as given."""
    kind = pages.schema[key].dataType.simpleString() if key else "long"
    kept = [(F.col(key) if key else F.lit(None).cast("long")).alias("k"), F.col(url).alias("u"), F.col(page).alias("p")]
    layout = pa.schema([
        ("row", pa.int64()), ("host", pa.string()), ("same", pa.int64()), ("total", pa.int64()), ("keys", pa.list_(pa.int64())),
        ("ups", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())),
        ("found", pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("w", pa.int64()), ("depth", pa.int32()), ("level", pa.int32())])))])

    def one(row, u, p):
        found = tokens(p or "")
        below, total = weights(found)
        depth, seen = [], {}
        for i, t in enumerate(found):
            depth.append(depth[t.up] + 1 if t.up >= 0 else 0)
            n, w, d, level = seen.get(t.key, (0, 0, 0, ARTICLE))
            seen[t.key] = n + 1, w + below[i], max(d, depth[i]) if t.text is None else -1, min(level, 0 if t.beside else t.level)
        return {
            "row": row, "host": host_of(u), "same": _key(p or ""), "total": total, "keys": [t.key for t in found], "ups": [t.up for t in found],
            "marks": [t.level | t.beside << 2 | t.flow << 3 | t.linked << 5 | (t.text is not None) << 6 for t in found],
            "texts": [t.text for t in found if t.text is not None],
            "found": [{"token": k, "n": n, "w": w, "depth": d, "level": level} for k, (n, w, d, level) in seen.items()]}

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, PAGES_A_BATCH):
                part = b.slice(at, PAGES_A_BATCH)
                rows = []
                for u, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    row += 1
                    rows.append(one(row, u, p))
                done = pa.RecordBatch.from_pylist(rows, layout)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *done.columns], ["k", "u", *layout.names])

    return pages.select(*kept).mapInArrow(run, f"k {kind}, u string, {_READ}")


def _tokens_of(row):
    """The tokens of a page as it was landed."""
    texts = iter(row["texts"])
    return [Token(k, next(texts) if m >> 6 else None, up, m & 3, bool(m >> 2 & 1), m >> 3 & 3, bool(m >> 5 & 1))
            for k, up, m in zip(row["keys"], row["ups"], row["marks"])]


def _hosts(read):
    """Per host: pages, whether they differ, text of all."""
    return read.groupBy("host").agg(
        F.count("*").alias("pages"), (F.min("same") < F.max("same")).alias("differ"), F.sum("total").alias("total"))


def _classed(read, hosts, support, least):
    """(host, token, class, on, w, depth, level, once) of tokens enough of a host's pages share. Class 0 is the root, the largest."""
    from pyspark.sql import Window

    x = F.xxhash64("row", "f.n")
    found = read.select("host", "row", F.explode("found").alias("f")).select(
        "host", "f.*", F.shiftrightunsigned(x, 33).alias("v1"), x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("v2")).groupBy("host", "token").agg(
        F.count("*").alias("on"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"), F.sum("w").alias("w"), F.max("depth").alias("depth"),
        F.min("level").alias("level"), (F.max("n") == 1).alias("once"))
    often = found.join(broadcast_checked(hosts), "host").filter((F.col("pages") >= least) & (F.col("on") >= support * F.col("pages")))
    sized = often.withColumn("size", F.count("*").over(Window.partitionBy("host", "on", "v1", "v2")))
    number = F.dense_rank().over(Window.partitionBy("host").orderBy(F.desc("on"), F.desc("size"), "v1", "v2")) - 1
    return sized.withColumn("class", number)


def equivalence_classes(pages, url="url", page="html", support=SUPPORT, least=LEAST_PAGES):
    """Per host: array of (token, class) for the classes enough of its pages share. Class 0 is the root, the largest.

    A host's array is at most ``1 / support`` times as long as its pages have tokens on average.
    """
    read = landed(_read(pages, url, page), "html-pages")
    return _as_arrays(_classed(read, landed(_hosts(read), "html-hosts"), support, least))


def _as_arrays(classed):
    return classed.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("template"))


def valid_classes(pages, classes, url="url", page="html"):
    """(host, class) of the classes with one order of tokens and one gap of the root on all pages that have them."""
    return _valid(_read(pages, url, page), classes)


def _valid(read, classes):
    def run(batches):
        for b in batches:
            out = []
            for host, keys, template in zip(b["host"], b["keys"], b["template"]):
                of = {int(t["token"]): int(t["class"]) for t in template}
                seen, gap = {}, 0
                for k in keys:
                    c = of.get(k)
                    if c is None:
                        continue
                    gap += c == 0
                    order, low, _ = seen.get(c, ([], gap, gap))
                    order.append(k)
                    seen[c] = (order, low, gap)
                for c, (order, low, high) in seen.items():
                    # a class repeated on a page comes in whole rounds of one order
                    size = len(set(order))
                    rounds = len(order) // size
                    ordered = order == order[:size] * rounds
                    where = (0, 0) if c == 0 else (low, high)
                    out.append((host, c, _key(f"{[int(k) for k in order[:size]]}{where}") if ordered else None))
            yield pd.DataFrame(out, columns=["host", "class", "sign"]).astype({"sign": "Int64"})

    hosted = read.select("host", "keys").join(broadcast_checked(classes, cells="template"), "host")
    return hosted.mapInPandas(run, "host string, class int, sign long").groupBy("host", "class").agg(
        F.min("sign").alias("a"), F.max("sign").alias("b"), F.max(F.col("sign").isNull()).alias("bad")).filter("a = b AND NOT bad").select("host", "class")


def templates(read, support=SUPPORT, least=LEAST_PAGES, share=SHARE, text_pages=TEXT_PAGES):
    """Per host of landed pages: ``main``, the key of its main slot, and ``shared``, the keys of its template texts."""
    hosts = landed(_hosts(read), "html-hosts")
    classed = landed(_classed(read, hosts, support, least), "html-classed")
    valid = landed(_valid(read, landed(_as_arrays(classed), "html-classes")), "html-valid")
    is_main = ((F.col("depth") >= 0) & F.col("once") & (F.col("total") > 0) & (F.col("w") >= share * F.col("total"))
               & (F.col("differ") | (F.col("level") >= MAIN)))
    is_shared = (F.col("depth") < 0) & F.col("differ") & (F.col("on") >= text_pages)
    return classed.join(broadcast_checked(valid), ["host", "class"]).groupBy("host").agg(
        F.max(F.when(is_main, F.struct("depth", "w", "token")))["token"].alias("main"),
        F.collect_list(F.when(is_shared, F.col("token"))).alias("shared"))


def extract(pages, url="url", page="html", key="page_id", support=SUPPORT, least=LEAST_PAGES):
    """Per page: key, url, text, n_chars."""
    read = landed(_read(pages, url, page, key), "html-pages")
    found = landed(templates(read, support, least), "html-templates")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_A_BATCH):
                b = batch.slice(at, PAGES_A_BATCH)
                rows = b.select(["keys", "ups", "marks", "texts", "main", "shared"]).to_pylist()
                texts = [choose(_tokens_of(r), r["main"], frozenset(r["shared"] or ())) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    hosted = read.join(broadcast_checked(found, cells="shared"), "host", "left").select("k", "u", "keys", "ups", "marks", "texts", "main", "shared")
    return hosted.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars long")
