"""Text expressions: keyword matching, path parts, HTML to text, filing sections."""

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ARCHIVE_URL
from .scalars import col

#: Reference names that are decoded without a semicolon as well.
BARE_NAMES = sorted(n for n in html5 if not n.endswith(";"))

#: Stands in for a run of markup between two pieces of text.
_MARK = "\u0001"


def mentions(text, keyword) -> Column:
    """True when the keyword occurs anywhere in the text, ignoring case; NULL text is no match."""
    return F.coalesce(F.contains(F.lower(col(text)), F.lit(keyword.lower())), F.lit(False))


def occurrences(text, keyword) -> Column:
    """Case-sensitive, non-overlapping occurrences of a literal keyword."""
    text = col(text)
    removed = F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))
    return F.floor(removed / F.lit(len(keyword))).cast("bigint")


# ---- many keywords at once ---------------------------------------------------

def _trie(keywords):
    root = {}
    for k in keywords:
        node = root
        for c in k:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _trie_pattern(node):
    """Regular expression of a trie's words, the longest first."""
    branches = [re.sub(r"([^\w\s])", r"\\\1", c) + _trie_pattern(after) for c, after in sorted(node.items()) if c]
    if not branches:
        return ""
    if "" in node:
        return "(?:" + "|".join(branches) + ")?"
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def keyword_pattern(keywords):
    """Pattern with a hit at every place a keyword starts; its group is the longest one there.

    Keywords share their beginnings as in an automaton, so a place is left after the first letter
    that no keyword goes on with. All shorter keywords that start at the place begin the longest one.
    """
    return "(?=(" + _trie_pattern(_trie(keywords)) + "))"


def keyword_hits(text, keywords) -> Column:
    """Longest keyword at each place of the text that starts one, in one pass; NULL for a NULL text."""
    return F.regexp_extract_all(col(text), F.lit(keyword_pattern(keywords)), F.lit(1))


def keyword_flags(texts, keywords):
    """(columns to add, flags): whether each keyword occurs in any of the texts, from one pass over each.

    The hits of a row become a short text of marked keywords, at most one of each; a
    keyword is there if a mark is followed by it. NULL texts hold no keyword; an empty
    keyword is in every text that is not NULL.
    """
    named = sorted({k for k in keywords if k})
    mark = next(c for c in map(chr, range(1, 0x3000)) if not any(c in k for k in named))
    found = [F.array_distinct(keyword_hits(t, named)) if named else F.array().cast("array<string>") for t in texts]
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(f, none) for f in found])
    columns = {"_hits": F.concat(F.lit(mark), F.array_join(every, mark))}
    anywhere = F.lit(False)
    for t in texts:
        anywhere = anywhere | col(t).isNotNull()
    return columns, [F.contains(F.col("_hits"), F.lit(mark + k)) if k else anywhere for k in keywords]


def overlaps_itself(keyword):
    """Whether two occurrences of the keyword can share letters."""
    return any(keyword.startswith(keyword[i:]) for i in range(1, len(keyword)))


# ---- paths and addresses ---------------------------------------------------

def cik_of(path) -> Column:
    """Company number in a submission path, without its leading zeros."""
    return F.ltrim(F.regexp_extract(col(path), r"/(0{3}\d{5,12})/", 1), F.lit("0"))


def filing_type_of(path) -> Column:
    """Form folder of a submission path: the one above the accession number."""
    return F.regexp_extract(col(path), r"/(\w+-\w+)/\d+-\d+-\d+/", 1)


def accession_of(path) -> Column:
    return F.regexp_extract(col(path), r"/(\d+-\d+-\d+)/", 1)


def filing_index_url(accession) -> Column:
    accession = col(accession)
    return F.concat_ws(
        "/", F.lit(ARCHIVE_URL), F.replace(accession, F.lit("-"), F.lit("")),
        F.concat(accession, F.lit("-index.html")),
    )


def info_text(html) -> Column:
    """First text inside the page's info block; NULL when there is none."""
    found = F.regexp_extract(col(html), r'<div class="info">([^<]*)<', 1)
    return F.when(found != "", found)


# ---- HTML ------------------------------------------------------------------

def html_to_text(html) -> Column:
    """Text nodes joined by blank lines; comments, scripts, styles and a cut-off last tag dropped."""
    # one alternation: the markup that starts first wins, with all it encloses
    text = F.regexp_replace(
        col(html), r"(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<[a-z/!?][^>]*>", _MARK)
    text = F.regexp_replace(text, r"<[A-Za-z/!?][^>]*$", "")
    text = F.regexp_replace(F.btrim(text, F.lit(_MARK)), f"{_MARK}+", "\n\n")
    return decode_references(text)


def _let(value, use):
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named(name):
    """Text of a named reference (with its semicolon, if it has one), by way of its first two letters; else NULL."""
    table = {}
    for n, text in html5.items():
        table.setdefault(n[:2], {})[n] = text
    names = F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(names, F.left(name, F.lit(2))), name)


def _numbered(number):
    """Text of a code point: Windows' characters for 128 to 159, none for controls and non-characters."""
    western = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    code = F.unhex(F.lpad(F.hex(number), 8, "0"))
    low = F.pmod(number, F.lit(0x10000))
    odd = (
        ((number < 0x20) & ~number.isin(9, 10, 12, 13)) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE))
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(number.between(0x80, 0x9F), F.try_element_at(
            F.from_json(F.lit(json.dumps({str(b): c or chr(b) for b, c in western.items()})), "map<string,string>"), number.cast("string")))
        .when(odd, F.lit(""))
        .otherwise(F.decode(code, "UTF-32")))


def decode_references(text) -> Column:
    """All decimal, hexadecimal and named character references, each decoded once."""
    text = col(text)
    pieces = F.split(text, "(?=&(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z]))")

    def rest(piece, reference):
        return F.substring(piece, F.length(reference) + 2, F.length(piece))

    def numeric(piece, reference):
        digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        base = F.lower(F.substring(reference, 2, 1)) == "x"

        # more than seven digits are beyond all code points
        def number(d):
            return F.when(d == "", 0).when(F.length(d) > 7, 0x110000).otherwise(F.when(base, F.conv(d, 16, 10)).otherwise(d).cast("bigint")).cast("bigint")

        return F.concat(_let(_let(digits, number), _numbered), rest(piece, reference))

    def bare(piece):
        found = F.regexp_extract(piece, "^&(" + _trie_pattern(_trie(BARE_NAMES)) + ")", 1)
        return _let(found, lambda name: F.when(name != "", F.concat(_named(name), rest(piece, name))).otherwise(piece))

    def decoded(piece):
        reference = F.regexp_extract(piece, "^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)", 1)
        return _let(reference, lambda r: (
            F.when(F.startswith(r, F.lit("#")), numeric(piece, r))
            .otherwise(_let(F.when(r != "", _named(r)), lambda known: F.when(known.isNotNull(), F.concat(known, rest(piece, r))).otherwise(bare(piece))))))

    # texts without one are left alone
    whole = F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&")), decoded(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


# ---- submissions -----------------------------------------------------------

def main_document(content, filing_type) -> Column:
    """Body of the last <DOCUMENT> whose <TYPE> line is exactly the filing type."""
    kind = F.lit(filing_type) if filing_type in ("10-K", "10-Q") else col(filing_type)
    documents = F.filter(
        F.split(col(content), "</DOCUMENT>"),
        lambda d: F.contains(d, F.lit("<DOCUMENT>"))
        & (F.regexp_extract(d, r"<TYPE>([^\n]+)", 1) == kind),
    )
    chosen = F.get(documents, F.size(documents) - 1)
    return F.substring_index(chosen, "<DOCUMENT>", -1)


#: Item headings in their four spellings, up to the items that begin or end a section.
_HEADING = r"(?:>Item(?: |&#160;|&nbsp;)|ITEM )"
_ITEMS = "1A|1B|2|7A|7"


def heading_pieces(document) -> Column:
    """The document cut before every heading of an item, in one pass; joined again, the pieces are the document."""
    return F.split(col(document), f"(?={_HEADING}(?:{_ITEMS}))")


def piece_items(pieces) -> Column:
    """The item whose heading begins each piece, '' for none; 7A is no 7, while 2 is any heading that goes on from there."""
    return F.transform(col(pieces), lambda p: F.regexp_extract(p, f"^{_HEADING}({_ITEMS})", 1))


def between_items(pieces, items, first, until) -> Column:
    """Text from the last heading of one item up to the last one of another; empty when they are out of order, NULL when one is missing."""
    pieces, items = col(pieces), col(items)

    def last(item):
        return F.size(items) - F.array_position(F.reverse(items), item) + 1

    def cut(at):
        start, end = at["start"], at["end"]
        return F.when(
            (start <= F.size(items)) & (end <= F.size(items)),
            F.array_join(F.slice(pieces, start, F.greatest(end - start, F.lit(0))), ""))

    return _let(F.struct(last(first).cast("int").alias("start"), last(until).cast("int").alias("end")), cut)
