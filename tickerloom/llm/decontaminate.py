"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Windows have the length of a benchmark item in words and may begin at any word of a text. A
window that holds no shingle of the item has similarity 0, so only windows on a diagonal with
at least one shingle in common (an exact join of all shingles of all texts with those of the
items) are fingerprinted. Their 64-bit SimHashes meet the items of the same length in a
multi-index: fingerprints are cut into ``BLOCKS`` blocks, the index holds every block value within
``RADIUS // BLOCKS`` bits of an item's, and by the pigeonhole principle every pair within ``RADIUS``
bits meets in a block. Candidates are then compared exactly: shared weight over joined weight
of their shingles, a shingle weighing as often as it occurs.

Everything is DataFrame functions. Texts are never shuffled unless the windows exceed what may be
broadcast. Words are letters, digits and non-ASCII, A-Z lowered, so punctuation does not hide a
passage. A shingle has five words, or all words of an item that has fewer.

Null, empty and blank texts and items match nothing. Rows that repeat an id and text give their
matches once. Items that repeat an id are told apart by their text and reported once, by the
better match; an item with a null id is reported under null. Further columns are ignored; with an empty table on either side nothing matches.
"""

from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_checked, landed

SHINGLE, SIMILARITY = 5, 75
#: Bits of a fingerprint, blocks of the index, and radius. Two windows of similarity 0.75 differ by
#: 11 bits on average with a standard deviation of 3.
BITS, BLOCKS, RADIUS = 64, 8, 23
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _grams(words, g):
    """All runs of ``g`` words, as text, in order."""
    w = F.col(words)
    return F.coalesce(F.when(F.size(w) >= g, F.transform(
        F.sequence(F.lit(0), F.size(w) - g), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(g)]))),
        F.array().cast("array<string>"))


def _placed_grams(words, g):
    return F.transform(_grams(words, g), lambda x, i: F.struct(F.lit(g).alias("g"), i.alias("pos"), x.alias("gram")))


def _fingerprints(windows, by):
    """SimHash and multiset of shingles of each window; ``windows`` has a row per window and shingle place."""
    counted = windows.groupBy(*by, "gram").agg(F.count("*").alias("weight")).withColumn("h", F.xxhash64("gram"))
    sums = [F.sum(F.col("weight") * (F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) * 2 - 1)).alias(f"b{b}") for b in range(BITS)]
    # a shingle found k times stands in the set k times, numbered: overlaps of sets are overlaps of weights
    each = F.flatten(F.collect_list(F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("weight")), lambda k: F.concat_ws("#", F.col("gram"), k.cast("string"))))).alias("grams")
    grouped = counted.groupBy(*by).agg(*sums, each)
    print_ = F.lit(0).cast("bigint")
    for b in range(BITS):
        print_ = print_.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return grouped.select(*by, "grams", print_.alias("print"))


def _blocks(print_):
    width = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, i * width).bitwiseAND(
        F.lit((1 << width) - 1)).alias("value")) for i in range(BLOCKS)])


def index_of(items, radius=RADIUS):
    """A row for each item, block, and block value within ``radius // BLOCKS`` bits of the item's."""
    width = BITS // BLOCKS
    near = [m for m in range(1 << width) if m.bit_count() <= radius // BLOCKS]
    spread = items.select("*", F.inline(_blocks(F.col("print"))))
    masks = F.explode(F.array(*[F.lit(m).cast("bigint") for m in near]))
    return spread.select("*", masks.alias("mask")).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def _matches(docs, benchmark, similarity, shingle, radius, text, key, item_key, item_text):
    """Matching windows (key, text_key, item, start, shared, joined), or None without an item; a text is named by its id and hash."""
    items = benchmark.select(F.col(item_key).alias("item"), words_of(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    items = landed(items.select("item", "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(shingle)).alias("g")).distinct().withColumn(
        "name", F.xxhash64("item", "w")), "decon-items")
    sizes = sorted(r.g for r in items.select("g").distinct().collect())  # at most `shingle` values
    if not sizes:
        return None

    def item_grams(g):
        own = items.filter(F.col("g") == g)
        return own.select("item", "name", "len", "g", F.posexplode(_grams("w", g)).alias("at", "gram"))

    grams = item_grams(sizes[0])
    for g in sizes[1:]:
        grams = grams.union(item_grams(g))
    grams = landed(grams.withColumn("h", F.xxhash64("gram")), "decon-grams")

    # 1. diagonals that share a shingle with an item; one pass over the texts
    words = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_key"), words_of(F.col(text)).alias("w"))
    all_grams = F.concat(*[_placed_grams("w", g) for g in sizes])
    placed = words.select("key", "text_key", F.inline(all_grams)).withColumn("h", F.xxhash64("gram"))
    starts = placed.join(broadcast_checked(grams), ["g", "h", "gram"]).select(
        "key", "text_key", "len", "g", (F.col("pos") - F.col("at")).alias("start")).distinct()
    windows = landed(starts.groupBy("key", "text_key").agg(F.collect_list(F.struct("start", "len", "g")).alias("windows")), "decon-windows")

    # 2. their words, from the texts that have any
    of_text = [F.col("d.key").eqNullSafe(F.col("v.key")), F.col("d.text_key") == F.col("v.text_key")]
    cut = words.alias("d").join(broadcast_checked(windows).alias("v"), of_text).select(
        "d.key", "d.text_key", "d.w", F.inline("windows")).select(
        "key", "text_key", "start", "len", "g", F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.greatest(
            F.least(F.col("start") + F.col("len"), F.size("w")) - F.greatest(F.col("start"), F.lit(0)), F.lit(0))).alias("w"))
    cut = cut.dropDuplicates(["key", "text_key", "start", "len", "g"])
    by_size = F.when(F.col("g") == sizes[0], _grams("w", sizes[0]))
    for g in sizes[1:]:
        by_size = by_size.when(F.col("g") == g, _grams("w", g))
    prints = _fingerprints(cut.select("key", "text_key", "start", "len", "g", F.explode(by_size).alias("gram")), ["key", "text_key", "start", "len", "g"])
    item_prints = landed(_fingerprints(grams, ["item", "name", "len", "g"]).withColumnsRenamed({"grams": "item_grams", "print": "item_print"}), "decon-prints")

    # 3. multi-index search and exact check
    index = landed(index_of(item_prints.withColumnRenamed("item_print", "print")).withColumnRenamed("print", "item_print").drop("item_grams"), "decon-index")
    probes = prints.select("*", F.inline(_blocks(F.col("print"))))
    met = probes.join(broadcast_checked(index), ["len", "g", "block", "value"]).filter(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    # by the item's name, not its id: ids may be null or repeat with another text
    pairs = met.select("key", "text_key", "start", "len", "g", "grams", "name").dropDuplicates(
        ["key", "text_key", "start", "len", "g", "name"]).join(broadcast_checked(item_prints), ["name", "len", "g"])
    shared = F.size(F.array_intersect("grams", "item_grams"))
    joined = F.size("grams") + F.size("item_grams") - F.col("shared")
    return pairs.withColumn("shared", shared).withColumn("joined", joined).filter(100 * F.col("shared") >= similarity * F.col("joined"))


def contaminated(docs, benchmark, similarity=SIMILARITY, shingle=SHINGLE, radius=RADIUS, text="text", key="doc_id",
                 item_key="item_id", item_text="text"):
    """Pairs (key, item_key) with the similarity and first word of the best window, of ``similarity`` percent or more."""
    found = _matches(docs, benchmark, similarity, shingle, radius, text, key, item_key, item_text)
    if found is None:
        kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {benchmark.schema[item_key].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, similarity double, first_word bigint")
    best = F.max(F.struct((F.col("shared") / F.col("joined")).alias("s"), (-F.greatest(F.col("start"), F.lit(0))).alias("b"))).alias("best")
    return found.groupBy("key", "item").agg(best).select(
        F.col("key").alias(key), F.col("item").alias(item_key), F.round("best.s", 6).alias("similarity"),
        (-F.col("best.b")).cast("bigint").alias("first_word"))


def decontaminated(docs, benchmark, similarity=SIMILARITY, shingle=SHINGLE, radius=RADIUS, text="text", key="doc_id",
                   item_key="item_id", item_text="text"):
    """Rows of ``docs`` whose own text matches no item.

    Rows are told apart by id and text: one with a null id goes if its text matches, and a clean text stays though
    another row with its id goes. Repeated rows go or stay together; rows without a word stay.
    """
    found = _matches(docs, benchmark, similarity, shingle, radius, text, key, item_key, item_text)
    if found is None:
        return docs
    gone = landed(found.select("key", "text_key").distinct(), "decon-found")
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("g.key")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("g.text_key"))
    return docs.alias("d").join(broadcast_checked(gone).alias("g"), same, "left_anti")
