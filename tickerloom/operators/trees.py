"""Regression trees for every group at once, grown level by level as Spark windows.

A node is a value of a column, so one pass over a level splits the nodes of all trees of all groups. Running
sums over the sorted values of a feature give the gain of every cut; the best cut of a node is a maximum over
its rows. Rows to be predicted travel with the training rows at weight zero, and only nodes that hold one are grown
further, so a level holds about two thirds of the rows of the one before where a group asks for one prediction. All
windows of a level share one exchange by node; a checkpoint ends the level.
"""

from collections import namedtuple
from functools import lru_cache, reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import checkpointed

#: Gains are compared as shares of the largest possible one at this precision, so equal cuts tie.
GAIN_DIGITS = 10
#: What the last bits of sums of targets that are large beside their spread may do to a gain, by this ratio.
_SUM_BITS = 4e-15
#: Depth is the upper part of a node's number, the row it was cut at the lower one.
_DEPTH_BITS = 40
#: Rows of samples that are grown at once: small enough for a core's cache, large enough to make the calls cheap.
STEP_CELLS = 1 << 18
#: Rows of a group's samples that are kept for the next group of this size.
SAMPLE_CELLS = 1 << 16
#: Terms of a sum that are added one by one.
IN_ORDER = 16
#: Rows under cuts that are summed at once.
GAIN_CELLS = 1 << 20
#: A block of this size, freed at once, lets malloc keep what is freed later instead of having the system map it anew.
_KEPT_BYTES = 31 << 20

#: Samples of trees: of the rows they hold, tree by tree, how often and which; rows a tree; a line of all rows for each tree, and the rows' numbers.
Sample = namedtuple("Sample", "weights rows sizes present ranks")


def draw(tree, place, rows, seed):
    """Number of the row (from 0) that a tree's bootstrap sample holds at a place: the same for all groups of equal size."""
    digest = F.md5(F.concat_ws("|", tree.cast("string"), place.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % rows


def bootstrap(train, group, row, trees, seed):
    """Training rows of each tree with ``_w``, how often the tree's sample of the group's size holds them."""
    sized = train.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    places = sized.select(group, F.col(row).alias("_place"), "_n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))
    drawn = places.select(group, "_tree", draw(F.col("_tree"), F.col("_place"), F.col("_n"), seed).alias(row))
    return drawn.groupBy(group, "_tree", row).agg(F.count(F.lit(1)).cast("double").alias("_w")).join(train, [group, row])


def _grown(state, features, last):
    """State one level deeper; nodes that cannot be cut, or lie at the last level, give their mean.

    Expressions are text and hold no number that changes with the level, so every level is planned quickly and runs the
    code compiled for the first one.
    """
    node = "PARTITION BY _group, _tree, _node"
    if last:
        return state.selectExpr(*[c for c in state.columns if c != "predicted"], f"""
            coalesce(predicted, try_divide(sum(_w * _y) OVER ({node}), sum(_w) OVER ({node}))) AS predicted""").filter("_w = 0")
    known = [
        f"sum(_w) OVER ({node}) AS _all_n", f"sum(_w * _y) OVER ({node}) AS _all_y",
        f"min(if(_w > 0, _y, NULL)) OVER ({node}) AS _low", f"max(if(_w > 0, _y, NULL)) OVER ({node}) AS _high"]
    cuts = []
    for j, f in enumerate(features):
        # rows to be predicted sort behind the training rows and are no values to cut at
        value, order = f"if(_w > 0, {f}, NULL)", f"{node} ORDER BY if(_w > 0, {f}, NULL) NULLS LAST, _row"
        known += [f"sum(_w) OVER ({order} ROWS UNBOUNDED PRECEDING) AS _n{j}", f"sum(_w * _y) OVER ({order} ROWS UNBOUNDED PRECEDING) AS _s{j}",
                  f"lead({value}) OVER ({order}) AS _next{j}"]
        # neighbouring doubles have no middle; the lower value still separates them
        middle = f"if(({f} + _next{j}) / 2 < _next{j}, ({f} + _next{j}) / 2, {f})"
        gain = (f"round(_n{j} * (_all_n - _n{j}) * pow(_s{j} / _n{j} - (_all_y - _s{j}) / (_all_n - _n{j}), 2) "
                f"/ (_all_n * _all_n * (_high - _low) * (_high - _low)), {GAIN_DIGITS})")
        cuts.append(f"CASE WHEN _w > 0 AND _next{j} > {f} AND _high > _low THEN named_struct('gain', {gain}, 'feature', {-j}, 'cut', -{middle}, 'row', _row) END")
    own = f"greatest({', '.join(cuts)})" if len(cuts) > 1 else cuts[0]
    best = state.selectExpr("*", *known).selectExpr("*", f"{own} AS _own").selectExpr(*state.columns, "_all_n", "_all_y", f"max(_own) OVER ({node}) AS _best")
    value = "CASE _best.feature " + " ".join(f"WHEN {-j} THEN {f}" for j, f in enumerate(features)) + " END"
    kept = [c for c in state.columns if c not in ("_node", "_level", "predicted")]
    sided = best.selectExpr(
        *kept, "_node", "_level", "_best.row AS _cut_row", f"{value} <= -_best.cut AS _under",
        "coalesce(predicted, if(_best IS NULL, try_divide(_all_y, _all_n), NULL)) AS predicted")
    asked = sided.selectExpr("*", f"max(_w = 0 AND _under) OVER ({node}) AS _asked_under", f"max(_w = 0 AND NOT _under) OVER ({node}) AS _asked_over")
    return asked.filter("_w = 0 OR if(_under, _asked_under, _asked_over)").selectExpr(
        *kept, f"if(_under IS NULL OR _under, _node, (_level + 1) * {1 << _DEPTH_BITS} + _cut_row) AS _node", "_level + 1 AS _level", "predicted")


def grow_and_predict(rows, features, depth=None):
    """Mean of the leaf that each row of weight zero falls in, as ``predicted``.

    ``rows`` holds ``_group``, ``_tree``, ``_row`` (a number, once a tree), ``_w`` (0 for rows to be predicted), the features and
    ``_y``; ``depth`` bounds the levels below the root. A tree without training rows predicts NULL.
    """
    state = rows.select("_group", "_tree", "_row", "_w", *features, "_y").selectExpr(
        "*", "0L AS _node", "0L AS _level", "CAST(NULL AS DOUBLE) AS predicted")
    level, finished = 0, []
    while True:
        last = depth is not None and level >= depth
        state = checkpointed(_grown(state, features, last))
        level += 1
        finished.append(state.filter("predicted IS NOT NULL"))
        # rows to be predicted without a training row beside them never get one
        state = state.filter("predicted IS NULL")
        if last or state.filter("_w > 0").isEmpty():
            finished.append(state.filter("_w = 0"))
            break
    every = reduce(lambda a, b: a.unionAll(b), finished)
    return every.filter("_w = 0").select("_group", "_tree", "_row", "predicted")


def predict_with_trees(rows, groups, features, target, model_type, keep, seed=12, trees=200, forest_depth=20):
    """Fit per group on rows with ``part = 'train'`` and predict the rest.

    ``decision_tree`` grows one unbounded tree; ``random_forest`` averages trees over bootstrap samples, of which
    :func:`draw` says the rows. Training rows with a missing value are left out; rows to be predicted with a missing
    feature, and those of groups without training rows, get NULL. Returns the non-training rows' ``keep`` columns
    with ``predicted_price``. A group must fit in a task, as a pair's weeks do; the groups of an Arrow batch are grown together there, and
    only the nodes on the way of a row to be predicted are cut. :func:`grow_and_predict` needs no such bound.
    """
    columns = list(dict.fromkeys([*groups, "part", *features, target, *keep]))
    clash = [c for c in columns if c.startswith("_")]
    if clash:
        raise ValueError(f"columns must not begin with an underscore: {clash}")
    dtypes = {f.name: f.dataType for f in rows.schema.fields}
    out = list(dict.fromkeys([*groups, "part", *keep]))
    schema = T.StructType([T.StructField(c, dtypes[c]) for c in out] + [T.StructField("predicted_price", T.DoubleType())])
    single, order = model_type == "decision_tree", list(dict.fromkeys(["_group", *features, target]))

    def predicted(table):
        table = table.append_column("_group", pa.array(np.cumsum(table["_place"].to_numpy() == 1)))
        asked = table.filter(pc.not_equal(table["part"], "train"))
        train = table.filter(pc.equal(table["part"], "train"))
        for c in [*features, target]:
            train = train.filter(pc.fill_null(pc.invert(pc.is_nan(train[c].cast("double"))), False))
        train = train.sort_by([(c, "ascending") for c in order])
        x, y, wanted = _numbers(train, features), train[target].cast("double").to_numpy(), _numbers(asked, features)
        low, high = (np.searchsorted(train["_group"].to_numpy(), asked["_group"].to_numpy(), side) for side in ("left", "right"))
        known = (high > low) & ~np.isnan(wanted).any(axis=1)
        guesses, steps = np.full(len(wanted), np.nan), _steps(np.flatnonzero(known), high - low, 1 if single else trees, None if single else seed)
        means = {}
        for step in steps:
            found = _path_means(x, y, [(low[i], wanted[i], sample) for i, sample in step], None if single else forest_depth)
            for (i, _), of_trees in zip(step, found):
                means.setdefault(i, []).append(of_trees)
        for i, of_trees in means.items():
            guesses[i] = np.concatenate(of_trees).mean()
        return asked.select(out).append_column("predicted_price", pa.array(guesses, pa.float64(), mask=~known))

    def tasks(batches):
        np.empty(_KEPT_BYTES, np.uint8)
        for table in _whole_groups(batches):
            yield from predicted(table).to_batches()

    # a given number of shares: rows of pairs compress so well that the optimizer would join too many
    dealt = rows.select(*columns).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *groups)
    # numbered rows tell where a group begins, whatever the types of its columns
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.lit(0))))
    return placed.mapInArrow(tasks, schema)


def _whole_groups(batches):
    """The rows of the batches as tables of whole groups; ``_place`` is 1 where a group begins."""
    held = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("_place").to_numpy() == 1)
        if len(begins):
            whole = pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
            if whole.num_rows:
                yield whole
            held, batch = [], batch.slice(begins[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _steps(asked, rows, trees, seed):
    """Rows to be predicted with samples of their groups' sizes, in lists of at most :data:`STEP_CELLS`, or of one tree."""
    step, cells = [], 0
    for i in asked:
        n = int(rows[i])
        at_once = max(1, min(trees, STEP_CELLS // n))
        for first in range(0, trees, at_once):
            until = min(first + at_once, trees)
            if step and cells + (until - first) * n > STEP_CELLS:
                yield step
                step, cells = [], 0
            small = seed is not None and trees * n <= SAMPLE_CELLS
            step.append((i, _kept_sample(trees, n, seed) if small else _sample(trees, n, seed, first, until)))
            cells += (until - first) * n
    if step:
        yield step


def _numbers(table, columns):
    """Rows as doubles; a null becomes NaN."""
    return np.column_stack([table[c].cast("double").to_numpy() for c in columns])


@lru_cache(maxsize=4)
def _draws(trees, places, seed):
    """The numbers behind :func:`draw`, for trees and places from 0."""
    return np.array([[int(md5(f"{t}|{p}|{seed}".encode()).hexdigest()[:7], 16) for p in range(places)] for t in range(trees)], dtype=np.int64)


def _sample(trees, n, seed, first=0, until=None):
    """How often the samples of some trees hold each of n rows, as :func:`bootstrap` says; without a seed, each row once."""
    until = trees if until is None else until
    if seed is None:
        weights = np.ones((until - first, n))
    else:
        drawn = _draws(trees, -(-n // 256) * 256, seed)[first:until, :n] % n
        lines = np.arange(until - first)[:, None] * n
        weights = np.bincount((drawn + lines).ravel(), minlength=lines.size * n).reshape(-1, n).astype(float)
    present = weights > 0
    ranks = np.cumsum(present.ravel(), dtype=np.int32).reshape(present.shape) - 1
    return Sample(weights[present], np.nonzero(present)[1], np.count_nonzero(present, axis=1), present, ranks)


@lru_cache(maxsize=32)
def _kept_sample(trees, n, seed):
    return _sample(trees, n, seed)


def _spans(begin, size):
    """The numbers of all spans, one span behind the other."""
    until = np.cumsum(size)
    return np.repeat(begin - (until - size), size) + np.arange(until[-1])


def _entries(orders, feature, place):
    """Entries at places of the features' orders; that of the first feature is the order of the entries."""
    out = place.copy()
    for j, order in enumerate(orders, 1):
        own = np.flatnonzero(feature == j)
        out[own] = order.take(place.take(own))
    return out


def _in_order(values, entries, size):
    """Sums of spans of entries; the terms of short ones are added one by one, as an engine adds rows, since equal gains hang on the last bits."""
    begin = np.cumsum(size) - size
    sums = np.add.reduceat(values.take(entries), begin)
    short = np.flatnonzero((size > 2) & (size <= IN_ORDER))
    if len(short):
        place = np.arange(IN_ORDER)
        terms = values.take(entries.take(begin[short, None] + np.minimum(place, size[short, None] - 1)))
        terms[place >= size[short, None]] = 0.0
        sums[short] = np.cumsum(terms, axis=1)[:, -1]
    return sums


def _gain(w, w_y, orders, feature, place, start, n, total, spread):
    """Gains of some cuts behind places of the features' orders, from the sums that :func:`_grown` takes."""
    size = place + 1 - start
    if len(size) > 1 and size.sum() > GAIN_CELLS:
        half = len(size) // 2
        return np.concatenate([_gain(w, w_y, orders, *[c[part] for c in (feature, place, start, n, total, spread)])
                               for part in (slice(half), slice(half, None))])
    under = _entries(orders, np.repeat(feature, size), _spans(start, size))
    low, under = np.add.reduceat(w.take(under), np.cumsum(size) - size), _in_order(w_y, under, size)
    return np.round(low * (n - low) * (under / low - (total - under) / (n - low)) ** 2 / (n * n * spread * spread), GAIN_DIGITS)


def _path_means(x, y, lines, depth):
    """For each line, the mean of the leaf that its row to be predicted falls in, of each tree; only the nodes on its way are cut.

    ``x`` and ``y`` hold rows of groups, each sorted by its first feature; a line is (first row of the group, features to be predicted,
    :class:`Sample`). The cuts are those of :func:`_grown`. All nodes of a level stand one behind the other: an entry is a row of a node, and
    for each further feature there is an order of the entries by node and value. Targets are taken from the node's least one in shares of its
    spread and centred, so the running sums, which are restated at each node, lose nothing to other nodes; cuts whose gains are hardly
    apart are compared by :func:`_gain`.
    """
    samples = [sample for *_, sample in lines]
    sizes = np.concatenate([s.sizes for s in samples])
    w = np.concatenate([s.weights for s in samples])
    row = np.concatenate([s.rows + first for first, _, s in lines])
    v = y.take(row)
    asked = np.array([a for _, a, _ in lines])
    line = np.repeat(np.arange(len(lines)), [len(s.sizes) for s in samples])
    orders, tied = [[] for _ in range(x.shape[1])], [[] for _ in range(x.shape[1])]
    done = 0
    for first, _, s in lines:
        for j in range(x.shape[1]):
            own = x[first:first + s.present.shape[1], j]
            place = np.argsort(own, kind="stable")
            value = own[place]
            again = np.full(len(own), value[-1] == np.inf)  # any value may stand before an infinite one
            again[place[:-1]] |= value[1:] == value[:-1]
            tied[j].append(again.take(s.rows))
            orders[j].append(s.ranks.take(place, axis=1).ravel().take(np.flatnonzero(s.present.take(place, axis=1))) + done if j else s.rows[:0])
        done += len(s.rows)
    orders, tied = [np.concatenate(o).astype(np.intp) for o in orders[1:]], [np.concatenate(t) for t in tied]
    tied = [t if t.any() else None for t in tied]  # entries whose value may be the next one's too
    nodes, means, level = np.arange(len(line)), np.empty(len(line)), 0
    while True:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = np.add.reduceat(w, starts)
        with np.errstate(all="ignore"):
            w_y = w * v
            sums = np.add.reduceat(w_y, starts)
            means[nodes] = sums / n
            least = np.minimum.reduceat(v, starts)
            spread = np.maximum.reduceat(v, starts) - least
            cut = (spread > 0) & (spread < np.inf)
            if depth is not None and level >= depth or not cut.any():
                break
            d = (v - np.repeat(least, sizes)) / np.repeat(np.where(cut, spread, 1.0), sizes)
        if not np.isfinite(spread).all():
            d[np.repeat(~np.isfinite(spread), sizes)] = 0.0
        d -= np.repeat(np.add.reduceat(w * d, starts) / n, sizes)
        d *= w
        own = np.empty(len(w), complex)  # both sums are run at once
        own.real, own.imag = d, w
        carried, every = np.add.reduceat(own, starts)[:-1], np.repeat(n, sizes)
        gains = []
        for j, t in enumerate(tied):
            run = own.take(orders[j - 1], mode="clip") if j else own.copy()
            run[starts[1:]] -= carried
            np.cumsum(run, out=run)
            low, gain = run.imag, run.real * run.real
            shared = every - low
            shared *= low
            gain[ends - 1], shared[ends - 1] = -1.0, 1.0
            if t is not None:
                no = np.flatnonzero(t.take(orders[j - 1]) if j else t)
                no = no[no < len(w) - 1]
                here, ahead = (x[row.take(orders[j - 1].take(no + k) if j else no + k), j] for k in (0, 1))
                no = no[~((ahead > here) & (ahead < np.inf))]
                gain[no], shared[no] = -1.0, 1.0
            gain /= shared
            gains.append(gain)
        best = np.maximum.reduce([np.maximum.reduceat(g, starts) for g in gains])
        cut &= best >= 0
        if not cut.any():
            break
        doubt = 2 * 10.0 ** -GAIN_DIGITS + _SUM_BITS * np.maximum(abs(least), abs(least + spread)) / np.where(cut, spread, 1.0)
        bound = np.repeat(np.where(cut, np.maximum(best - doubt, 0.0), np.inf), sizes)
        found = [np.flatnonzero(g >= bound) for g in gains]
        feature, place = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
        node = np.searchsorted(ends, place, "right")
        order = np.argsort(node, kind="stable")
        feature, place, node = feature[order], place[order], node[order]
        chosen = np.r_[True, node[1:] > node[:-1]]
        if not chosen.all():
            several = ~chosen
            several[:-1] |= several[1:]
            several = np.flatnonzero(several)
            open_nodes = np.unique(node[several])
            sums[open_nodes] = _in_order(w_y, _spans(starts[open_nodes], sizes[open_nodes]), sizes[open_nodes])
            gain = _gain(w, w_y, orders, feature[several], place[several], starts[node[several]], n[node[several]], sums[node[several]], spread[node[several]])
            several = several[np.lexsort((-gain, node[several]))]  # of equal gains the first feature's lowest cut
            chosen[several] = np.r_[True, node[several[1:]] > node[several[:-1]]]
        feature, place, node = feature[chosen], place[chosen], node[chosen]
        value, after = (x[row.take(_entries(orders, feature, place + k)), feature] for k in (0, 1))
        middle = (value + after) / 2
        middle = np.where(middle < after, middle, value)
        under = asked[line[nodes[node]], feature] <= middle
        begin = np.where(under, starts[node], place + 1)
        nodes, sizes, level = nodes[node], np.where(under, place + 1, ends[node]) - begin, level + 1
        kept = np.zeros(len(w), bool)
        kept[_entries(orders, np.repeat(feature, sizes), _spans(begin, sizes))] = True
        entries = np.flatnonzero(kept)
        numbers = np.empty(len(w), np.intp)
        numbers[entries] = np.arange(len(entries))
        orders = [numbers.take(np.compress(kept.take(o), o)) for o in orders]
        w, v, row = w.take(entries), v.take(entries), row.take(entries)
        tied = [t if t is None else t.take(entries) for t in tied]
    return np.split(means, np.cumsum([len(s.sizes) for s in samples])[:-1])
