"""Token ids packed into rows of fixed length by best-fit decreasing, as binary columns.

Each task encodes its documents, cuts those longer than a row into full rows and a rest - no
token is dropped - and packs the rests: longest first, each into the open row with the least
room that still takes it, which a segment tree over capacities finds in log(length) steps. A task
packs whenever it holds ``BUFFER`` tokens, so memory is bounded and no text or token is shuffled;
a bin never spans two tasks. The rows are the same when a task runs again on the same split.

A row of the result is a row of the matrix: ``ids`` (little-endian, ``ID_TYPE``, padded to the
length), ``positions`` (the place within the segment's document part, restarting at 0 with every
segment), ``cu_seqlens`` (cumulative segment lengths, from 0 to ``n_tokens``), and for each segment its
document and the place in the document's tokens it starts at.

Null and empty texts have no tokens and no segment. Repeated rows are packed as often as they
occur. Ties keep the order of the input. Further columns are ignored; an empty table gives no rows.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import then_give_back

LENGTH = 2048
#: Tokens a task holds before it packs them (2 MB of ids); rows come out more than 99 % full.
BUFFER = 1_000_000
#: Packed rows of an output batch (1 MB of ids and positions).
OUTPUT_ROWS = 128
ID_TYPE = np.dtype("<u2")
PAD = 50256

_ENCODERS = {}


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path=None):
    """The rank file's encoder, one per worker process."""
    path = path or default_path()
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Encoder:
    """Whole texts to packed ids."""

    def __init__(self, path=None):
        self.library = encoder(path)

    def encode(self, text):
        if not text:
            return b""
        # one call a text: most distinct pre-tokens occur once, so a cache of them costs more than it saves
        ids = self.library.encode_ordinary(text)
        return np.fromiter(ids, ID_TYPE, len(ids)).tobytes()


class CapacityTree:
    """Open bins by room left; ``take(size)`` gives one with the least room of at least ``size``."""

    def __init__(self, most):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins = [[] for _ in range(most + 1)]

    def add(self, room, bin_):
        self.bins[room].append(bin_)
        self._change(room, 1)

    def _change(self, room, by):
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, size):
        """(room, bin), or None if no bin has the room."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            # up to the first ancestor with an open bin to the right, then down its left side
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes, length):
    """Bins (lists of places in ``sizes``) of at most ``length`` in all; sizes are 1 to ``length``."""
    tree, bins = CapacityTree(length), []
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        found = tree.take(size) if size < length else None
        if found is None:
            room, b = length, len(bins)
            bins.append([])
        else:
            room, b = found
        bins[b].append(at)
        if room > size:
            tree.add(room - size, b)
    return bins


def _rows(pieces, length, first_id):
    """A row per bin of pieces (document, start, packed ids)."""
    width = ID_TYPE.itemsize
    pad = np.array([PAD], ID_TYPE).tobytes()
    for b, places in enumerate(best_fit_decreasing([len(p[2]) // width for p in pieces], length)):
        inside = [pieces[i] for i in places]
        sizes = [len(p[2]) // width for p in inside]
        total = sum(sizes)
        positions = np.concatenate([np.arange(n, dtype=ID_TYPE) for n in sizes] + [np.zeros(length - total, ID_TYPE)])
        yield (first_id + b, total, b"".join(p[2] for p in inside) + pad * (length - total), positions.tobytes(),
               np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), [p[0] for p in inside], [p[1] for p in inside])


COLUMNS = ["pack_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts"]


def pack(docs, length=LENGTH, path=None, buffer=BUFFER, text="text", key="doc_id"):
    """Rows of the packed matrix; see the module. ``pack_id`` is unique."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"pack_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<long>"
    width = ID_TYPE.itemsize

    def run(batches):
        from pyspark import TaskContext

        encode, next_id = Encoder(path).encode, TaskContext.get().partitionId() << 40
        pieces, held = [], 0
        kinds = None

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], COLUMNS)

        def flush():
            nonlocal pieces, held, next_id
            rows = []
            for row in _rows(pieces, length, next_id):
                rows.append(row)
                if len(rows) == OUTPUT_ROWS:
                    yield batch(rows)
                    rows = []
                next_id = row[0] + 1
            if rows:
                yield batch(rows)
            pieces, held = [], 0

        for b in batches:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(b.schema.field(0).type), pa.list_(pa.int64())]
            # text by text, so that no second copy of the batch stands beside it
            for doc, t in zip(b.column(0), b.column(1)):
                doc, ids = doc.as_py(), encode(t.as_py())
                for low in range(0, len(ids), length * width):
                    piece = ids[low:low + length * width]
                    pieces.append((doc, low // width, piece))
                held += len(ids) // width
                if held >= buffer:
                    yield from flush()
            del b
        yield from flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(lambda batches: then_give_back(run(batches)), schema)


def unpack(rows):
    """Documents' ids back from packed rows (an iterable of Rows): dict of document to array."""
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, ID_TYPE)
        for doc, start, a, z in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(doc, []).append((start, ids[a:z]))
    return {doc: np.concatenate([p for _, p in sorted(found, key=lambda x: x[0])]) for doc, found in parts.items()}
