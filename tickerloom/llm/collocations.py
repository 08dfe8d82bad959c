"""Collocations by exact phrase counts in counting quotient filters.

Words are numbered, a phrase of n words is the packed number of its n word ids, and an invertible
permutation (a Feistel network whose parts are the ids) spreads these numbers evenly. The upper bits of
a permuted number are its quotient, all further bits its remainder; a filter keeps, in the order
of the quotients, how many entries each quotient has (in unary), the full remainders and the counters, so
nothing is lost and the phrase can be read back. Every shard of about ``SHARD_WORDS`` words makes its
own filters, cut into ranges of quotients. Filters of one range are merged by sorted order, and since the
permutation is even, a range is a bounded share whatever the phrases' frequencies are: a phrase that holds a
third of all places is one entry a shard.

Only words with ``least`` places can stand in a phrase that has as many, so all others end a run. Ids reach
the shards by a join of the shard's distinct words with the dictionary; nothing is broadcast that grows. Phrases
of three words or more are counted only where each pair of neighbours hits the occupied bits of
the frequent pairs' filter, a bitmap of fixed size: a false hit costs a counter and changes no result.

Null texts count as empty, a null lang as ``und``; empty texts have no words. Repeated rows count as often as they occur. A
text of any length stays in one shard, so a shard exceeds its size by one text at most. Ties are settled by score, then
places, then the phrase's bytes. Further columns are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, give_back, landed, then_give_back

#: Words a shard gathers before it is closed, and phrase places a range of quotients is made for.
SHARD_WORDS, RANGE_PLACES = 500_000, 1_000_000
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of the bitmap of frequent pairs (4 MB), whatever the input.
PAIR_BITS = 25
#: Ranges of quotients at least, as a power of two.
LEAST_RANGES = 5

_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
_U = np.uint64


# ---- shards ---------------------------------------------------------------------

class _Words(dict):
    """Word to local id: 0 is no word, 1 ends a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word):
        at = self[word] = len(self)
        return at


def _shard_rows(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held, words_held = {}, 0

    def close():
        nonlocal number, held, words_held
        columns = [[], [], [], [], [], []]
        for lang, (words, parts) in sorted(held.items()):
            ids = np.concatenate(parts)
            ids = ids[ids != 0]
            counts = np.bincount(ids, minlength=len(words))[2:]
            row = (number, lang, int(counts.sum()), pa.array(list(words)[2:], pa.binary()).cast(pa.string()), counts, ids.astype("<i4").tobytes())
            number += 1
            for c, v in zip(columns, row):
                c.append(v)
        held, words_held = {}, 0
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["shard", "lang", "n_words", "words", "counts", "ids"])

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            text = text.as_py()
            if not text:
                continue
            tokens = text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
            words, parts = held.setdefault(lang.as_py(), (_Words(), []))
            parts.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
            parts.append(np.ones(1, np.int32))
            words_held += len(tokens)
            if words_held >= SHARD_WORDS:
                yield close()
    if held:
        yield close()


def _numbered(words, folder_name):
    """The words with dense ids from 1, landed; ids are places within a task behind the tasks before."""
    table = landed(words.withColumn("at", F.monotonically_increasing_id()), folder_name)
    task = F.shiftright("at", 33)
    # one row a task
    first = table.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows")).select(
        "task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows") + 1).alias("first"))
    return table.join(F.broadcast(first), task == F.col("task")).select(
        *[c for c in table.columns if c != "at"], (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


def _renumbered(shard, found):
    """A shard's words as ids of the dictionary; 0 parts the runs of frequent words."""
    kinds = [pa.int64(), pa.binary()]
    if not shard.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], ["shard", "ids"])
    local = np.frombuffer(shard.column("ids")[0].as_py(), "<i4")
    ids = np.zeros(int(local.max(initial=1)) + 1, np.uint64)
    ids[found.column("pos").to_numpy() + 2] = found.column("id").to_numpy()
    run = ids[local]
    # words between rare ones stand in no phrase; of several marks one is enough
    inside = np.zeros(len(run) + 2, bool)
    inside[1:-1] = run != 0
    keep = inside[1:-1] & (inside[:-2] | inside[2:])
    run = np.where(keep, run, _U(0))
    run = run[keep | np.concatenate([[False], keep[:-1]])]
    out = pa.Table.from_arrays([pa.array([shard.column("shard")[0].as_py()], kinds[0]), pa.array([run.astype("<u8").tobytes()], kinds[1])], ["shard", "ids"])
    give_back()
    return out


# ---- the filter -----------------------------------------------------------------

def _mixed(x):
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _round(parts, i, turn, mask):
    seen = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * (turn + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j, p in enumerate(parts):
        if j != i:
            seen = _mixed(seen + p * _U(2 * j + 3))
    parts[i] = parts[i] ^ (seen & mask)


def permute(parts, bits):
    """Permuted parts of ``bits`` bits each; one to one."""
    parts, mask = list(parts), _U((1 << bits) - 1)
    for turn in range(2 * len(parts)):
        _round(parts, turn % len(parts), turn, mask)
    return parts


def restore(parts, bits):
    """The inverse of ``permute``."""
    parts, mask = list(parts), _U((1 << bits) - 1)
    for turn in reversed(range(2 * len(parts))):
        _round(parts, turn % len(parts), turn, mask)
    return parts


def limbs_of(parts, bits):
    """Parts as one number in limbs of up to 64 bits, upper bits first; and the width of each limb."""
    total = bits * len(parts)
    widths = [min(64, total - low) for low in range(0, total, 64)]
    limbs = [np.zeros(len(parts[0]), np.uint64) for _ in widths]
    for i, p in enumerate(parts):
        at, left = divmod(i * bits, 64)
        room = widths[at] - left
        if bits <= room:
            limbs[at] |= p << _U(room - bits)
        else:
            limbs[at] |= p >> _U(bits - room)
            limbs[at + 1] |= (p & _U((1 << (bits - room)) - 1)) << _U(widths[at + 1] - (bits - room))
    return limbs, widths


def parts_of(limbs, n, bits):
    """The inverse of ``limbs_of``."""
    total, out = bits * n, []
    widths = [min(64, total - low) for low in range(0, total, 64)]
    for i in range(n):
        at, left = divmod(i * bits, 64)
        room = widths[at] - left
        if bits <= room:
            p = (limbs[at] >> _U(room - bits)) & _U((1 << bits) - 1)
        else:
            p = (limbs[at] & _U((1 << room) - 1)) << _U(bits - room)
            p = p | (limbs[at + 1] >> _U(widths[at + 1] - (bits - room)))
        out.append(p)
    return out


def _summed(limbs, counts=None):
    """Sorted distinct numbers and how often each occurs."""
    if len(limbs) == 1 and counts is None:
        limbs = [np.sort(limbs[0])]
    else:
        order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        counts = None if counts is None else counts[order]
    new = np.ones(len(limbs[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
    starts = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(starts, len(new)))
    else:
        total = np.add.reduceat(counts, starts) if len(starts) else counts
    return [x[starts] for x in limbs], total.astype(np.int64)


def encode_filter(limbs, widths, counts, low_bits):
    """Bytes of sorted entries that agree in all but the lower ``low_bits`` bits of the first limb."""
    m = len(counts)
    q = min(low_bits, max(0, int(m).bit_length() - 1))
    inside = limbs[0] & _U((1 << low_bits) - 1) if low_bits < 64 else limbs[0]
    rest = low_bits - q
    quotient = (inside >> _U(rest)).astype(np.int64) if rest < 64 else np.zeros(m, np.int64)
    # unary: a one for each entry, a zero after each quotient
    unary = np.zeros(m + (1 << q), np.uint8)
    unary[quotient + np.arange(m)] = 1
    first = inside & _U((1 << rest) - 1) if rest < 64 else inside
    remainders = [first, *limbs[1:]]
    sizes = [(rest + 7) // 8, *[(w + 7) // 8 for w in widths[1:]]]
    packed = [np.ascontiguousarray(r.astype("<u8").view(np.uint8).reshape(m, 8)[:, :s]).tobytes() for r, s in zip(remainders, sizes)]
    large = np.flatnonzero(counts > 255)
    return b"".join([
        np.array([m, q, len(large)], "<u4").tobytes(), np.packbits(unary).tobytes(), *packed, np.minimum(counts - 1, 255).astype(np.uint8).tobytes(),
        large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes()])


def decode_filter(raw, widths, low_bits, upper):
    """(limbs, counts) of ``encode_filter``; ``upper`` is what the entries agree in."""
    m, q, n_large = map(int, np.frombuffer(raw, "<u4", 3))
    at = 12
    size = (m + (1 << q) + 7) // 8
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, size, at))[:m + (1 << q)]
    at += size
    quotient = (np.flatnonzero(unary) - np.arange(m)).astype(np.uint64)
    rest, limbs = low_bits - q, []
    for s in [(rest + 7) // 8, *[(w + 7) // 8 for w in widths[1:]]]:
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :s] = np.frombuffer(raw, np.uint8, m * s, at).reshape(m, s)
        at += m * s
        limbs.append(wide.view("<u8").reshape(m))
    if rest < 64:
        limbs[0] = limbs[0] | quotient << _U(rest)
    if low_bits < 64:
        limbs[0] = limbs[0] | _U(upper << low_bits)
    counts = np.frombuffer(raw, np.uint8, m, at).astype(np.int64) + 1
    at += m
    large = np.frombuffer(raw, "<u4", n_large, at)
    counts[large] = np.frombuffer(raw, "<i8", n_large, at + 4 * n_large)
    return limbs, counts


def _slots(limbs, widths):
    """Places in the bitmap of pairs: the upper bits of the quotient."""
    return (limbs[0] >> _U(max(0, widths[0] - PAIR_BITS))).astype(np.int64)


def _range_bits(places, bits, n):
    return min(max(LEAST_RANGES, (places // RANGE_PLACES).bit_length()), min(64, n * bits))


def _filters(lengths, bits, places, pairs):
    """Function from shards to their filters, one row per length and range."""
    def run(batches):
        occupied = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        for b in batches:
            out = [[], [], []]
            for raw in b.column(0):
                run_ids = np.frombuffer(raw.as_buffer(), "<u8")
                if len(run_ids) < 2:
                    continue
                ok = (run_ids[:-1] != 0) & (run_ids[1:] != 0)
                if occupied is not None:
                    at = np.flatnonzero(ok)
                    slots = _slots(*limbs_of(permute([run_ids[at], run_ids[at + 1]], bits), bits))
                    ok[at] = (occupied[slots >> 3] >> (slots & 7)) & 1
                for n in lengths:
                    good = ok[:max(0, len(run_ids) - n + 1)].copy()
                    for i in range(1, n - 1):
                        good &= ok[i:i + len(good)]
                    at = np.flatnonzero(good)
                    if not len(at):
                        continue
                    limbs, widths = limbs_of(permute([run_ids[at + i] for i in range(n)], bits), bits)
                    limbs, counts = _summed(limbs)
                    low = widths[0] - _range_bits(places, bits, n)
                    ranges = (limbs[0] >> _U(low)).astype(np.int64) if low < 64 else np.zeros(len(counts), np.int64)
                    cuts = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(ranges))
                    for a, z in zip(cuts, cuts[1:]):
                        out[0].append(n)
                        out[1].append(int(ranges[a]))
                        out[2].append(encode_filter([x[a:z] for x in limbs], widths, counts[a:z], low))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["n", "range", "filter"])

    return lambda batches: then_give_back(run(batches))


def _merged(bits, places, least):
    """Function from the filters of one length and range to its frequent phrases."""
    def run(key, table):
        n, upper = key[0].as_py(), key[1].as_py()
        total = n * bits
        widths = [min(64, total - low) for low in range(0, total, 64)]
        low = widths[0] - _range_bits(places, bits, n)
        limbs, counts = [np.zeros(0, np.uint64) for _ in widths], np.zeros(0, np.int64)
        held, size = [], 0

        def merge():
            every = [(limbs, counts), *held]
            return _summed([np.concatenate([e[0][i] for e in every]) for i in range(len(widths))], np.concatenate([e[1] for e in every]))

        for raw in table.column("filter"):
            held.append(decode_filter(raw.as_py(), widths, low, upper))
            size += len(held[-1][1])
            if size > max(RANGE_PLACES, len(counts)):  # doubling, so every entry is merged a few times at most
                limbs, counts = merge()
                held, size = [], 0
        limbs, counts = merge()
        keep = counts >= least
        limbs, counts = [x[keep] for x in limbs], counts[keep]
        ids = np.stack(restore(parts_of(limbs, n, bits), bits), 1).astype(np.int64) if len(counts) else np.zeros((0, n), np.int64)
        slots = _slots(limbs, widths)
        give_back()
        return pa.Table.from_arrays(
            [pa.array([list(map(int, r)) for r in ids], pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(slots, pa.int64())], ["ids", "a", "slot"])

    return run


def _frequent(streams, lengths, bits, places, least, pairs, name):
    """Phrases of the lengths with ``least`` places: ids, a, slot."""
    filters = streams.select("ids").mapInArrow(_filters(lengths, bits, places, pairs), "n int, range long, filter binary")
    return landed(filters.groupBy("n", "range").applyInArrow(_merged(bits, places, least), "ids array<long>, a long, slot long"), name)


def _bitmap(frequent_pairs):
    """The occupied bits of the pairs' filter: fixed size, put together by Spark."""
    at = F.col("slot") + 1  # the functions number bits from 1
    rows = frequent_pairs.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(1 << (PAIR_BITS - 3))
    for r in rows:
        low = (r.bucket - 1) * 4096
        out[low:low + 4096] = r.bits
    return bytes(out[:1 << (PAIR_BITS - 3)])


# ---- phrases --------------------------------------------------------------------

SCHEMA = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def phrase_counts(docs, least=LEAST, longest=LONGEST, text="text", lang="lang"):
    """(dictionary, phrases, words per lang), or None without a frequent word.

    dictionary: lang, word, f, id; phrases of 2 to ``longest`` words: ids, a; both with ``least`` places or more.
    """
    spark = docs.sparkSession
    shards = landed(docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(
        lambda batches: then_give_back(_shard_rows(batches)),
        "shard long, lang string, n_words long, words array<string>, counts array<long>, ids binary"), "phrase-shards")
    totals = landed(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    counted = shards.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    dictionary = _numbered(counted.filter(F.col("f") >= least), "phrase-words")
    size, places = dictionary.agg(F.count(F.lit(1)), F.sum("f")).first()
    if not size:
        return None
    bits = int(size).bit_length()
    found = shards.select("shard", "lang", F.posexplode("words").alias("pos", "word")).join(
        dictionary.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "pos", "id")
    streams = landed(shards.select("shard", "ids").groupBy("shard").cogroup(found.groupBy("of")).applyInArrow(
        _renumbered, "shard long, ids binary"), "phrase-streams")
    pairs = _frequent(streams, [2], bits, places, least, None, "phrase-pairs")
    phrases = pairs
    if longest > 2:
        shared = spark.sparkContext.broadcast(_bitmap(pairs))
        phrases = pairs.unionAll(_frequent(streams, list(range(3, longest + 1)), bits, places, least, shared, "phrase-longer"))
    return dictionary, phrases.select("ids", "a"), totals


def collocations(docs, least=LEAST, longest=LONGEST, top=TOP, text="text", lang="lang"):
    """Each lang's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, least, longest, text, lang)
    if counts is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    dictionary, phrases, totals = counts
    name = lambda ids: F.concat_ws(" ", ids)  # noqa: E731 - a phrase's ids as one key
    phrases = phrases.withColumn("key", name(F.col("ids")))
    size = F.size("ids")
    places = phrases.select("key", F.col("a").alias("f")).unionAll(dictionary.select(F.col("id").cast("string").alias("key"), "f"))
    # a phrase that only ever stands in a longer one stands in one that is a word longer
    longer = phrases.filter(size > 2).select(F.explode(F.array(
        name(F.slice("ids", F.lit(1), size - 1)), name(F.slice("ids", F.lit(2), size - 1)))).alias("key"), "a")
    around = longer.groupBy("key").agg(F.max("a").alias("around"))
    kept = phrases.join(around, "key", "left").filter(F.col("around").isNull() | (F.col("around") < F.col("a"))).drop("around")
    words = kept.select("key", F.posexplode("ids").alias("at", "id")).join(dictionary.select("id", "lang", "word"), "id").groupBy("key").agg(
        F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    cuts = kept.select("key", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "key", "a", "k", name(F.slice("ids", F.lit(1), F.col("k"))).alias("left_key"), name(F.slice("ids", F.col("k") + 1, size - F.col("k"))).alias("right_key"))
    cuts = (cuts.join(places.select(F.col("key").alias("left_key"), F.col("f").alias("l")), "left_key")
            .join(places.select(F.col("key").alias("right_key"), F.col("f").alias("r")), "right_key")
            .join(words, "key").join(totals, "lang"))
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    over = F.lit(1000).cast("decimal(4,0)") * wide("a", 16) * wide("n", 16)
    score = F.expr("over div under").cast("long")
    cuts = cuts.withColumns({"over": over, "under": wide("l", 18) * wide("r", 18)}).withColumn("score", score)
    best = cuts.groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))
