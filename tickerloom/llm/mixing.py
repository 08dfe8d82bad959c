"""Mixing sources to target weights by hierarchical budgets.

``tree`` is a list of columns from the root down (domain, language, source); a weight belongs
to a node and is relative to its siblings. The tokens wanted in all go down from the root: at
each node children get shares by weight, a child that cannot fill its share (its documents times
``max_epochs``) gives what it cannot use to its siblings by weight, and only what all siblings
cannot use goes back up, because a parent's share never exceeds what its subtree can give.
Every leaf then reads its documents in seeded epochs - each epoch an order of its own, by
md5(seed, epoch, id) - whole as long as the budget lasts, and of the last epoch the longest prefix
that fits.

Running totals of a leaf, which may hold a third of all rows, never go through one task: an
epoch's order is cut into 4,096 ranges of the hash, ranges are added up before the shuffle, and
only the one range in which the budget ends is ordered row by row.

Nulls in tree columns are a value of their own. Documents without a word have 0 tokens and stay in
every epoch read up to their place. Nodes without a weight get ``default_weight``. Repeated rows
are separate documents of one place in the order; they are taken or left together. An empty table
gives no rows. Further columns of the input stay.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import broadcast_checked, landed, spaced_words

#: Hex digits of the order's hash that name a range: 16^3 ranges a leaf and epoch.
RANGE_DIGITS = 3
NULL_NODE = "\0"


def word_tokens(text="text"):
    """Words of the text: the default measure of a document's size."""
    return F.size(spaced_words(F.col(text))).cast("bigint")


def _tree_columns(tree, nodes):
    names = [f"_mix_node{i}" for i in range(len(tree))]
    made = [F.col(c) for c in tree] if nodes is None else nodes
    return names, [F.coalesce(c.cast("string"), F.lit(NULL_NODE)) for c in made]


def _order(seed, doc_id, epoch="epoch"):
    """A document's place in an epoch of its leaf: 32 hex digits; a null id has a place too."""
    named = F.coalesce(doc_id.cast("string"), F.lit(NULL_NODE))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), named).cast("binary"))


def _weights(spark, tree, weights):
    """Small table (path, weight) from a dict of tuples of node values, or a DataFrame of that form."""
    if not isinstance(weights, dict):
        return weights
    rows = [("\x1f".join(NULL_NODE if v is None else str(v) for v in path), int(w)) for path, w in weights.items()]
    return spark.createDataFrame(rows, "path string, weight long")


def _fill(children, parent):
    """Split each parent's ``given`` among its children by weight, up to their capacity, whole tokens.

    Children are ordered by capacity per weight. The first child that does not reach its capacity
    when all before it are full sets the level; it and all after it get level times weight.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spread = (
        children.withColumn("_c", F.coalesce(F.sum("capacity").over(before), F.lit(0).cast("bigint")))
        .withColumn("_w", F.sum("weight").over(after))
        .withColumn("_free", F.col("capacity") * F.col("_w") > (F.col("given") - F.col("_c")) * F.col("weight")))
    first = F.min(F.when(F.col("_free"), F.struct(F.col("capacity") / F.col("weight"), "node", "_c", "_w"))).over(by)
    # children before the level are full; integer division keeps shares whole
    share = F.expr("CASE WHEN _at IS NULL OR NOT _free THEN capacity ELSE (given - _at._c) * weight DIV _at._w END")
    return spread.withColumn("_at", first).withColumn("budget", F.least(F.col("capacity"), share)).drop("_c", "_w", "_free", "_at")


def budgets(sizes, tree, weights, total, max_epochs, default_weight=1):
    """Tokens granted to each leaf. ``sizes`` has the tree's columns as strings and ``tokens``.

    ``sizes`` has one row a leaf, so every table here is as small as the list of sources.
    """
    spark = sizes.sparkSession
    w = _weights(spark, tree, weights)
    level, given = None, None
    for depth in range(1, len(tree) + 1):
        path = tree[:depth]
        nodes = sizes.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("bigint").alias("capacity"))
        nodes = nodes.withColumn("node", F.concat_ws("\x1f", *path)).join(
            F.broadcast(w) if isinstance(weights, dict) else w, F.col("node") == F.col("path"), "left").drop("path")
        nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(default_weight)).cast("bigint")).filter("weight > 0")
        if level is None:
            given = nodes.withColumn("given", F.lit(total).cast("bigint"))
        else:
            given = nodes.join(level.select(*path[:-1], F.col("budget").alias("given")), path[:-1])
        level = _fill(given, path[:-1]).drop("given")
    return level.select(*tree, (F.col("capacity") / max_epochs).cast("bigint").alias("tokens"), "weight", "budget")


def thresholds(docs, weights, total=None, tree=("domain", "lang", "source"), nodes=None, tokens=None, seed=0, max_epochs=2,
               key="doc_id", default_weight=1, text="text"):
    """Per leaf and epoch that is read: the leaf's tokens and budget, and ``cut``, the last place of the
    epoch's order that is taken (null: all). A short list: leaves times epochs."""
    names, made = _tree_columns(tree, nodes)
    size = word_tokens(text) if tokens is None else tokens
    ids = landed(docs.select(F.col(key).alias("_id"), *[c.alias(n) for c, n in zip(made, names)], size.alias("_n")), "mix-sizes")
    sizes = landed(ids.groupBy(*names).agg(F.sum("_n").alias("tokens")), "mix-leaves")
    if total is None:
        total = sizes.agg(F.sum("tokens")).first()[0] or 0
    granted = budgets(sizes, names, weights, total, max_epochs, default_weight)
    reads = f"sequence(0, least({max_epochs} - 1, CASE WHEN tokens = 0 THEN 0 ELSE (budget - 1) DIV tokens END))"
    epochs = landed(granted.filter("budget > 0 OR tokens = 0").select(
        *names, "tokens", "budget", F.explode(F.expr(reads)).alias("epoch")).withColumn("epoch", F.col("epoch").cast("bigint")).withColumn(
        "rest", F.least("tokens", F.col("budget") - F.col("tokens") * F.col("epoch"))), "mix-epochs")
    partial = epochs.filter("rest < tokens")
    dealt = ids.join(broadcast_checked(partial), names).withColumn("_order", _order(seed, F.col("_id"))).withColumn(
        "_range", F.substring("_order", 1, RANGE_DIGITS))
    ranges = dealt.groupBy(*names, "epoch", "rest", "_range").agg(F.sum("_n").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy(*names, "epoch").orderBy("_range"))
    ends = landed(
        ranges.withColumn("_upto", upto).filter("_upto > rest").groupBy(*names, "epoch")
        .agg(F.min(F.struct("_range", F.expr("_upto - _in").alias("_before"))).alias("_end"))
        .select(*names, "epoch", F.col("_end._range").alias("_end"), F.col("_end._before").alias("_before")), "mix-ends")
    edge = Window.partitionBy(*names, "epoch").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (
        dealt.join(broadcast_checked(ends), [*names, "epoch"]).filter("_range = _end")
        .withColumn("_sum", F.sum("_n").over(edge) + F.col("_before"))
        .groupBy(*names, "epoch", "_end").agg(F.max(F.when(F.expr("_sum <= rest"), F.col("_order"))).alias("_last"))
        # the bare range stands before all its places: none of them fits
        .select(*names, "epoch", F.coalesce("_last", "_end").alias("cut")))
    return landed(epochs.drop("rest").join(fits, [*names, "epoch"], "left"), "mix-thresholds")


def mix(docs, weights, total=None, tree=("domain", "lang", "source"), nodes=None, tokens=None, seed=0, max_epochs=2,
        key="doc_id", default_weight=1, text="text"):
    """Rows of ``docs``, each as often as it was chosen, with ``epoch``, ``leaf_tokens`` and ``leaf_budget``.

    ``nodes`` are the columns of the tree (default: columns named as ``tree``); ``tokens`` the size
    of a document (default: its words); ``total`` the tokens wanted (default: all there are).
    Texts are not moved: each row meets the short list of thresholds where it is read.
    """
    cuts = thresholds(docs, weights, total, tree, nodes, tokens, seed, max_epochs, key, default_weight, text)
    names, made = _tree_columns(tree, nodes)
    added = ("epoch", "leaf_tokens", "leaf_budget")
    keyed = docs.withColumns(dict(zip(names, made)))
    chosen = keyed.join(broadcast_checked(cuts.select(
        *names, F.col("epoch").alias("_mix_epoch"), F.col("cut").alias("_mix_cut"), F.col("tokens").alias("_mix_tokens"),
        F.col("budget").alias("_mix_budget"))), names)
    chosen = chosen.filter(F.col("_mix_cut").isNull() | (_order(seed, F.col(key), "_mix_epoch") <= F.col("_mix_cut")))
    return chosen.select(
        *[docs[c] for c in docs.columns if c not in added], F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("leaf_tokens"),
        F.col("_mix_budget").alias("leaf_budget"))
