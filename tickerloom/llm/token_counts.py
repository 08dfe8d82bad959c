"""Exact token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens, at most
``FREQUENT`` entries. It is filled from a bounded sample of documents, of which each task sends its own most
frequent pre-tokens to the driver, by the number of its documents; it serves speed only and can change no count, ties included. Tier two is a cache in each worker; a pre-token in neither is
encoded by the tokenizer library. Pre-tokens here are the runs between white space, which
this tokenizer never joins. Texts with a special token's string, or with characters outside
the range in which white space and normal forms are beyond doubt, are encoded whole.

Null texts count as empty (0 tokens, 0 bytes), null ids stay null; very long texts are counted whole. Repeated documents get a row each; further
columns are ignored; an empty table gives an empty result.
"""

import os
import re
from collections import Counter as Tally

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

#: Entries of the broadcast table, and documents its sample is expected to hold.
FREQUENT, SAMPLE_DOCS = 50_000, 5_000
#: Entries a task with sampled documents may send, besides 4 * FREQUENT / SAMPLE_DOCS for each of them.
LEAST_A_TASK = 64
#: Entries after which a worker's cache starts anew.
CACHE = 500_000
#: Characters outside this range are left to the library: controls, rare spaces, all beyond Latin.
PLAIN = re.compile(r"[\t\n\x0b\f\r\x20-\x7e\xa1-ɏ]*")

_TOKENIZERS = {}


def default_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path=None):
    """The library's tokenizer, one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = path or default_path()
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class Counter:
    """Counts tokens of texts: frequent table, then cache, then library."""

    def __init__(self, path, frequent):
        self.library, self.frequent, self.cache = tokenizer(path), frequent, dict(frequent)

    def _whole(self, text):
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text):
        if not text:
            return 0
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._whole(text)
        parts = text.split()
        found = list(map(self.cache.get, parts))
        if None in found:
            if len(self.cache) > CACHE:
                self.cache = dict(self.frequent)
            missing = list({p for p, n in zip(parts, found) if n is None})
            for p, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False)):
                self.cache[p] = len(e.ids)
            found = [self.cache[p] if n is None else n for p, n in zip(parts, found)]
        return sum(found)


_COUNTERS = {}


def _counter(path, shared):
    at = (path, shared.id if hasattr(shared, "id") else id(shared))
    if at not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[at] = Counter(path, shared.value)
    return _COUNTERS[at]


def frequent_lengths(docs, path=None, text="text", entries=FREQUENT, sample_docs=SAMPLE_DOCS):
    """Dict of at most ``entries`` pre-tokens frequent in a sample of about ``sample_docs`` documents."""
    rows = docs.count()
    if not rows:
        return {}
    some = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_docs / rows), seed=8)
    each = max(1, 4 * entries // sample_docs)

    def parts(batches):
        tally, seen = Tally(), 0
        for b in batches:
            seen += len(b)
            for t in b["text"]:
                if t and PLAIN.fullmatch(t):
                    tally.update(t.split())
        if tally:
            found = tally.most_common(LEAST_A_TASK + each * seen)
            yield pd.DataFrame({"parts": [[p for p, _ in found]], "n": [[n for _, n in found]]})

    tally = Tally()
    for r in some.mapInPandas(parts, "parts array<string>, n array<long>").collect():
        for part, n in zip(r.parts, r.n):
            tally[part] += n
    words = sorted(tally, key=lambda w: (-tally[w], w))[:entries]
    return {w: len(e.ids) for w, e in zip(words, tokenizer(path).encode_batch_fast(words, add_special_tokens=False))}


def count_tokens(docs, path=None, limit=2048, text="text", key="doc_id"):
    """Per document: key, n_bytes (UTF-8), n_tokens, over_limit."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text))
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        tokens = _counter(path, shared)
        for b in batches:
            found = pa.array([tokens(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), found], [key, "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(key), t.alias("_text"), F.octet_length(t).cast("bigint").alias("n_bytes")).mapInArrow(
        count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
