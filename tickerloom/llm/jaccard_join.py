"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The incidence matrix is dealt out in blocks of columns (ranges of the shingle hash), each block as
packed binary cells, a few bytes a shingle. A block knows how many documents each of its columns
has. Columns with one document can add to no overlap, so they stop there; the others go back to
their documents. A document whose shared columns are fewer than the least overlap its size
allows - ``ceil(t * n)`` - is linked to nothing and is done. The rest multiply only the columns
before the size-derived prefix, rarest columns first: two sets that link share one of the first
``n - ceil(t * n) + 1`` columns of either. Exact overlaps decide.

Columns shared by large groups are not multiplied out. Documents with equal sets are one class,
with one row from then on. Classes of a column first meet one pivot each (a star); verified
links give components, and only pairs of classes still in different components are formed
afterwards. A pair inside a component can change no component, so nothing is lost.

Shingles are kept as hashes: at least 48 bits between two documents that are compared and 64 bits
plus the size for equal sets.

Null, empty and blank texts have no set and link with nothing, not with each other. Texts of fewer
words than a shingle are one shingle. Repeated rows are copies like any other. Further columns
are ignored; an empty table gives an empty result. ``component_id`` of a row with a null id is the
least id in its component, if any.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import broadcast_checked, give_back, landed, then_give_back

SHINGLE, SIMILARITY = 5, 75
#: Documents whose shingles a column block is meant for on average, and least blocks.
DOCS_A_BLOCK, LEAST_BLOCKS = 1000, 128
#: Rounds of stars with other pivots before cross pairs are formed.
STARS = 3
#: Documents whose cells are packed together; at most 65,536. Fewer once they have so many cells (16 MB of hashes).
BATCH, BATCH_CELLS = 2_000, 2_000_000
#: Word hashes a worker keeps.
CACHE = 200_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x):
    """Bijective scrambling of 64-bit integers (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word (bytes), kept for the next time."""

    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def shingle_set(text, words, size=SHINGLE):
    """Sorted distinct shingle hashes of a whole text.

    ``bytes.lower`` lowers A-Z only and ``bytes.split`` parts at space and tab to carriage return.
    """
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = h * _M + w[i:i + len(h)]
    return np.unique(_mix(h + np.uint64(n)))


def _incidence(docs, key, kind, text, bits, size):
    """Packed cells by column block, and a header row for each document."""
    schema = f"part int, uid long, idx int, key {kind}, no_key boolean, n long, cls long, cells binary"

    def run(batches):
        from pyspark import TaskContext

        task, words = TaskContext.get().partitionId(), WordHashes()
        step, cells = 0, 0
        keys, marks, sets, heads, seen = [], [], [], [], set()

        def rows(part, idx, key, no_key, n, cls, packed):
            uid = task << 32 | step
            columns = [pa.array(part, pa.int32()), _same(uid, len(part), pa.int64()), pa.array(idx, pa.int32()), key, no_key,
                       pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "uid", "idx", "key", "no_key", "n", "cls", "cells"])

        def flush():
            """Header rows of the documents held, and their cells by block; then nothing is held."""
            nonlocal step, cells
            key, n = pa.concat_arrays(keys), len(heads)
            yield rows(-1 - (np.arange(n) % (1 << bits)), np.arange(n), key, pa.concat_arrays(marks), [x[0] for x in heads], [x[1] for x in heads], [None] * n)
            h = np.concatenate(sets)
            idx = np.repeat(np.arange(n, dtype=np.uint16), [len(s) for s in sets])
            one = key.slice(0, 1)
            for held in (keys, marks, sets, heads, seen):
                held.clear()
            cells = 0
            if len(h):
                at = np.argsort(h)
                h, idx = h[at], idx[at]
                del at
                edges = np.r_[0, np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h)]
                full = np.flatnonzero(edges[1:] > edges[:-1])
                packed = []
                for a, z in zip(edges[full], edges[full + 1]):
                    rest = (h[a:z] << np.uint64(bits)) >> np.uint64(24)  # the next 40 bits
                    packed.append((rest >> np.uint64(8)).astype("<u4").tobytes() + rest.astype("u1").tobytes() + idx[a:z].astype("<u2").tobytes())
                del h, idx
                none = np.zeros(len(full), np.int64)
                yield rows(full, none - 1, _same(one, len(full)), _same(True, len(full), pa.bool_()), none, none, packed)
            step += 1

        for b in batches:
            low = 0
            for i, t in enumerate(b.column(2)):  # text by text, so that no second copy of the batch stands beside it
                s = shingle_set(t.as_py(), words, size)
                cls = int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                heads.append((len(s), cls))
                fresh = len(s) and (len(s), cls) not in seen
                seen.add((len(s), cls))
                sets.append(s if fresh else s[:0].copy())  # copies within what is held send no cells
                cells += len(sets[-1])
                if len(words) > CACHE:
                    words.clear()
                if len(heads) == BATCH or cells >= BATCH_CELLS or i + 1 == b.num_rows:
                    own = pa.array(np.arange(low, i + 1))  # taken, as a slice would hold the batch's texts
                    keys.append(b.column(0).take(own))
                    marks.append(b.column(1).take(own))
                    low = i + 1
                if len(heads) == BATCH or cells >= BATCH_CELLS:
                    yield from flush()
            del b
        if heads:
            yield from flush()

    # null keys travel as another value with a mark, so whole numbers stay whole
    some = F.coalesce(F.col(key), F.lit("0").cast(kind))
    texts = docs.select(some.alias("key"), F.col(key).isNull().alias("no_key"), F.col(text).alias("text"))
    return texts.mapInArrow(lambda batches: then_give_back(run(batches)), schema)


def _same(value, n, kind=None):
    """Array of one value n times; the value may be an array of length one."""
    one = value if kind is None else pa.array([value], kind)
    return one.take(pa.array(np.zeros(n, np.int64)))


def _unpack(cells):
    n = len(cells) // 7
    h = np.frombuffer(cells, "<u4", n).astype(np.uint64) << np.uint64(8) | np.frombuffer(cells, "u1", n, 4 * n)
    return h, np.frombuffer(cells, "<u2", n, 5 * n)


def _shared_columns(incidence):
    """Headers as they are; of each block's cells those whose column has two documents or more, with that number."""
    def run(rows):
        give_back()  # of the group before
        part = int(rows["part"].iloc[0])
        if part < 0:
            return rows.assign(cells=None)
        h, idx = (np.concatenate(x) for x in zip(*map(_unpack, rows["cells"])))
        sizes = [len(c) // 7 for c in rows["cells"]]
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        df = np.minimum(count[inverse], 0xFFFFFFFF)
        h = h | np.uint64(part) << np.uint64(40)
        out, low = [], 0
        for uid, n in zip(rows["uid"], sizes):
            at = slice(low, low + n)
            low += n
            keep = df[at] > 1
            if keep.any():
                out.append((uid, h[at][keep].astype("<u8").tobytes() + df[at][keep].astype("<u4").tobytes() + idx[at][keep].astype("<u2").tobytes()))
        return pd.DataFrame({
            "part": part, "uid": [x[0] for x in out], "idx": -1, "key": rows["key"].iloc[0], "no_key": True, "n": 0, "cls": 0,
            "cells": [x[1] for x in out]})[list(rows.columns)]

    return incidence.groupBy("part").applyInPandas(run, incidence.schema)


def _live_sets(shared, similarity):
    """Of each batch of documents, those with enough shared columns: their shared columns, rarest first."""
    def run(rows):
        give_back()  # of the group before
        cells = [c for c in rows["cells"] if c is not None]
        heads = rows[rows["idx"] >= 0]
        if not cells:
            return pd.DataFrame({"n": [], "cls": [], "central": [], "shared": pd.Series([], dtype=object)})
        n = [len(c) // 14 for c in cells]
        h = np.concatenate([np.frombuffer(c, "<u8", k) for c, k in zip(cells, n)])
        df = np.concatenate([np.frombuffer(c, "<u4", k, 8 * k) for c, k in zip(cells, n)])
        idx = np.concatenate([np.frombuffer(c, "<u2", k, 12 * k) for c, k in zip(cells, n)])
        at = np.lexsort((h, df, idx))
        h, df, idx = h[at].astype(np.int64), df[at], idx[at]
        places = heads["idx"].values
        low, high = np.searchsorted(idx, places), np.searchsorted(idx, places, side="right")
        live = (high > low) & ((high - low) * 100 >= similarity * heads["n"].values)
        return pd.DataFrame({
            "n": heads["n"].values[live], "cls": heads["cls"].values[live],
            "central": [df[a:z].sum(dtype=np.float64) / n for a, z, n in zip(low[live], high[live], heads["n"].values[live])],
            "shared": pd.Series([h[a:z] for a, z in zip(low[live], high[live])], dtype=object)})

    return shared.groupBy("uid").applyInPandas(run, "n long, cls long, central double, shared array<long>")


def components(edges):
    """Least reachable node of every node of ``edges`` (u, v): least-label rounds with pointer jumping."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = landed(both, "join-edges")
    labels = landed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "join-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v", "c": "d"}), "v").groupBy("u").agg(F.min("d").alias("d"))
        hop = labels.select(F.col("u").alias("c"), F.col("c").alias("e"))
        new = labels.join(near, "u").join(hop, "c", "left").select(
            "u", F.least("c", "d", F.coalesce("e", "c")).alias("c"), F.col("c").alias("old"))
        new = landed(new, "join-labels")
        if new.filter("c <> old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")


def _verified(pairs, live, similarity):
    """Pairs (u, v) of classes whose exact overlap links them."""
    sets = live.select("node", "n", "shared")
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "n": "nu", "shared": "su"}), "u").join(
        sets.withColumnsRenamed({"node": "v", "n": "nv", "shared": "sv"}), "v")
    overlap = F.size(F.array_intersect("su", "sv"))
    return both.withColumn("o", overlap).filter((100 + similarity) * F.col("o") >= similarity * (F.col("nu") + F.col("nv"))).select("u", "v")


def _bounds(a, b, similarity):
    """Sizes near enough, and overlap enough left where this is the pair's first common column."""
    small, large = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
    return (100 * small >= similarity * large) & (
        (100 + similarity) * F.least(a("rest"), b("rest")) >= similarity * (small + large))


def links(live, similarity=SIMILARITY, stars=STARS):
    """Links (u, v) that join the same components as all links; ``live`` has node, n, central, shared (rarest first)."""
    spark = live.sparkSession
    # ceil(t n) in whole numbers; columns of one document stand before the shared ones
    least = F.expr(f"({similarity} * n + 99) DIV 100")
    take = (F.size("shared") - least + 1).cast("int")
    # `rest`: shared columns from this one on, all that a pair whose first common column this is can have in common
    cells = landed(live.select("node", "n", "central", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), take)).alias("at", "h")).select(
        "node", "n", "central", "h", (F.col("m") - F.col("at")).alias("rest")), "join-cells")
    node_kind = live.schema["node"].dataType.simpleString()
    found = spark.createDataFrame([], f"u {node_kind}, v {node_kind}")
    tested = found
    labels = None
    for r in range(stars):
        own = cells if labels is None else cells.join(labels.withColumnsRenamed({"u": "node"}), "node", "left").withColumn(
            "c", F.coalesce("c", "node"))
        # the first pivot is the set whose columns are shared most, as those of a group's original are; later ones are drawn
        # anew for each of four sets of columns
        first = -F.col("central") if r == 0 else F.xxhash64("node", F.pmod("h", F.lit(4)), F.lit(r)).cast("double")
        pick = F.struct(first.alias("k"), "node", "n", "rest", *([] if labels is None else ["c"]))
        heads = own.groupBy("h").agg(F.min(pick).alias("p"), F.min("node" if labels is None else "c").alias("lo"), F.max("node" if labels is None else "c").alias("hi"))
        heads = landed(heads.filter("lo <> hi").select("h", "p"), "join-pivots")
        if heads.isEmpty():
            return found
        apart = F.col("node") != F.col("p.node") if labels is None else F.col("c") != F.col("p.c")
        pairs = own.join(heads, "h").filter(apart & _bounds(F.col, lambda c: F.col(f"p.{c}"), similarity)).select(
            F.least("node", "p.node").alias("u"), F.greatest("node", "p.node").alias("v")).distinct()
        pairs = landed(pairs.join(tested, ["u", "v"], "left_anti"), "join-pairs")
        tested = tested.union(pairs)
        found = landed(found.union(_verified(pairs, live, similarity)), "join-links")
        if found.isEmpty() and r == 0:
            labels = live.select(F.col("node").alias("u"), F.col("node").alias("c"))
        else:
            labels = components(found)
    # what is still apart: pairs of classes of different components that share a column of both prefixes
    own = landed(cells.join(labels.withColumnsRenamed({"u": "node"}), "node", "left").withColumn("c", F.coalesce("c", "node")), "join-labelled")
    mixed = landed(own.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h"), "join-mixed")
    own = landed(own.join(mixed, "h"), "join-open")
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c"))
                   & _bounds(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), similarity))
    pairs = pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
    return landed(found.union(_verified(pairs, live, similarity)), "join-links")


def jaccard_components(docs, similarity=SIMILARITY, size=SHINGLE, text="text", key="doc_id"):
    """Per row of ``docs``: key, n_shingles, component_id (least key reachable by links of the similarity in percent)."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = max(LEAST_BLOCKS, docs.count() // DOCS_A_BLOCK)
    bits = min(20, (blocks - 1).bit_length())
    incidence = _incidence(docs, key, kind, text, bits, size)
    shared = landed(_shared_columns(incidence), "join-shared")
    rows = shared.filter("idx >= 0").select(
        F.when(~F.col("no_key"), F.col("key")).alias("key"), F.col("n").alias("n_shingles"), "cls")
    sets = landed(_live_sets(shared, similarity), "join-sets")
    classes = landed(rows.filter("n_shingles > 0").groupBy("cls", "n_shingles").agg(F.min("key").alias("least")), "join-classes")
    # a class is named by its set's hash; the size tells apart what the hash might not
    live = sets.withColumn("node", F.struct("cls", "n")).dropDuplicates(["node"]).select("node", "n", "central", "shared")
    live = landed(live, "join-live")
    joined = links(live, similarity)
    found = components(joined)
    named = found.select(F.col("u.cls").alias("cls"), F.col("u.n").alias("n_shingles"), "c")
    with_least = landed(classes.join(named, ["cls", "n_shingles"]), "join-named")
    least = with_least.groupBy("c").agg(F.min("least").alias("component_id"))
    moved = landed(with_least.join(least, "c").select("cls", "n_shingles", "component_id"), "join-moved")
    of_class = landed(classes.join(moved, ["cls", "n_shingles"], "left").select(
        "cls", "n_shingles", F.coalesce("component_id", "least").alias("component_id")), "join-of-class")
    placed = rows.join(of_class, ["cls", "n_shingles"], "left")
    return placed.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def one_of_each(docs, similarity=SIMILARITY, size=SHINGLE, text="text", key="doc_id"):
    """Rows of ``docs`` without all but one row of each component (of the least id, a null one last).

    Rows are told apart by id and text, so one id may stand with several texts. Rows that link with nothing stay, as do all
    rows without a word.
    """
    columns = docs.columns
    texts = docs.select(F.xxhash64(F.col(text)).alias("row_text"), F.col(text).alias("row_words"))
    found = landed(jaccard_components(texts, similarity, size, "row_words", "row_text"), "join-result").filter("n_shingles > 0")
    several = landed(found.groupBy("component_id").count().filter("count > 1").select("component_id"), "join-several")
    members = landed(found.join(broadcast_checked(several), "component_id").select("row_text", "component_id").distinct(), "join-members")
    ids = docs.select(F.col(key).alias("row_id"), F.xxhash64(F.col(text)).alias("row_text"))
    rows = ids.join(broadcast_checked(members), "row_text").groupBy("component_id", "row_id", "row_text").agg(F.count("*").alias("copies"))
    rows = landed(rows, "join-rows")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("row_id").isNull(), "row_id", "row_text")).alias("first"))
    first = landed(first.select("component_id", F.col("first.row_id").alias("first_id"), F.col("first.row_text").alias("first_text")), "join-first")
    stays = F.col("row_id").eqNullSafe(F.col("first_id")) & (F.col("row_text") == F.col("first_text"))
    judged = rows.join(broadcast_checked(first), "component_id").withColumn("stays", stays)
    gone = landed(judged.filter("NOT stays").select("row_id", "row_text"), "join-gone")
    again = landed(judged.filter("stays AND copies > 1").select("row_id", "row_text"), "join-again")
    same = F.col(f"d.{key}").eqNullSafe(F.col("r.row_id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("r.row_text"))
    kept = docs.alias("d").join(broadcast_checked(gone).alias("r"), same, "left_anti")
    if again.isEmpty():
        return kept
    twice = broadcast_checked(again).alias("r")
    one = kept.alias("d").join(twice, same, "left_semi").withColumn("_text", F.xxhash64(F.col(text))).dropDuplicates([key, "_text"])
    return kept.alias("d").join(twice, same, "left_anti").unionByName(one.select(*columns))
