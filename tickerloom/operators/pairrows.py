"""Rows of pairs (a symbol under a keyword, type, lag and range of weeks), made in the tasks that hold a symbol's closes.

A pair's rows are bounded by the calendar. Made where the closes are, they are never shuffled or sorted by the engine, so a task's
memory goes with its closes, not with pairs x weeks.
"""

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ROLLING_PRECEDING
from .correlate import _chunks, _dealt, _met, _rate_groups, _rolling

PARTS = ("train", "test", "score")


def pair_series(closes, rates, pairs, keys, begin):
    """Weeks of each pair from ``begin`` on with close, same-week trailing mean of the rates and the close ``time_delay`` weeks later.

    ``closes`` and ``rates`` as in :func:`correlate.correlated`; ``begin`` is a date column over ``pairs``. Of a pair that comes several
    times, a week stands once, with the greatest mean over its copies. Adds week_opening_date, mean, close and later_close.
    """
    return _made(closes, rates, pairs, keys, begin, None, _series, [("mean", "double"), ("close", "double"), ("later_close", "double")])


def model_series(closes, rates, pairs, keys, begin, cutoff, prefix, warmup, seed):
    """Rows of :func:`pair_series` that have a later close, as a model takes them: with ``part`` train, test or score.

    Rows before the cutoff (a date column, or None: the pair's last row) train, without the pair's first ``warmup``; one in ten of these, rounded
    up, is the test, by the order of md5 of ``prefix|week|seed``. The row at the cutoff is the score row. Gaps are filled linearly by
    row number among the rows that train.
    """
    at_last = cutoff is None

    def modelled(days, mean, close, later, pair):
        use = ~np.isnan(later)
        days, mean, close, later = days[use], mean[use], close[use], later[use]
        stop = days[-1] if at_last and len(days) else pair["_last"]
        if not len(days) or stop is None:
            return None
        fit = np.flatnonzero((days < stop) & (np.arange(len(days)) >= warmup))
        marks = [hashlib.md5(f"{pair['_prefix']}|{d}|{seed}".encode()).digest() for d in days[fit].astype("datetime64[D]").astype(str)]
        part = np.zeros(len(fit), int)
        part[sorted(range(len(fit)), key=marks.__getitem__)[:math.ceil(len(fit) * 0.1)]] = 1
        score = np.flatnonzero(days == stop)
        every = np.r_[fit, score]
        return (days[every], np.r_[_filled(mean[fit]), mean[score]], np.r_[_filled(close[fit]), close[score]], later[every],
                np.r_[part, np.full(len(score), 2)])

    columns = [("mean", "double"), ("close", "double"), ("later_close", "double"), ("_part", "int")]
    made = _made(closes, rates, pairs, keys, begin, cutoff, modelled, columns, prefix)
    return made.withColumn("part", F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.col("_part") + 1)).drop("_part")


def latest_series(closes, rates, pairs, keys, begin, end):
    """The last week of each pair from ``begin`` to ``end`` with a rate filed ``time_delay`` weeks earlier, and the trailing mean of these rates."""
    def latest(days, mean, close, later, pair):
        return days[-1:], mean[-1:]

    return _made(closes, rates, pairs, keys, begin, end, latest, [("mean", "double")], filed_earlier=True)


def _series(days, mean, close, later, pair):
    return days, mean, close, later


def _filled(values):
    """Inner gaps filled linearly by row number; leading gaps stay, the last value is carried to the end."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return values
    out = np.interp(np.arange(len(values)), known, values[known])
    out[:known[0]] = np.nan
    return out


def _mean(rate, copies):
    """Trailing mean of the rows, each of which comes so many times; the greatest of a row's copies."""
    repeated = np.repeat(rate, copies) if copies > 1 else rate
    return np.fmax.reduce(_rolling(repeated[None])[0][0].reshape(len(rate), copies), axis=1)


def _made(closes, rates, pairs, keys, begin, last, shape, columns, prefix=None, filed_earlier=False):
    none = F.lit(None)
    dated = F.unix_date(none.cast("date") if last is None else last)
    pair = F.struct(*keys, F.unix_date(begin).alias("_begin"), dated.alias("_last"), (none.cast("string") if prefix is None else prefix).alias("_prefix"))
    asked = pairs.filter("stock_symbol IS NOT NULL").select("stock_symbol", pair.alias("_pair"))
    dealt = _dealt(closes, rates, extra=asked)
    kinds = {f.name: f.dataType for f in pairs.select(*keys).schema.fields}
    names = [*keys, "_week", *[c for c, _ in columns]]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, symbols, series, week, price, rows in _chunks(batches):
            known = {(kind, word): (weeks, found) for kind, words, weeks, values in _rate_groups(table) for word, found in zip(words, values)}
            own = rows["_week"].is_valid().to_numpy()
            at = np.flatnonzero(~own)
            if not len(at):
                continue
            structs = rows["_pair"].combine_chunks().take(pa.array(at))
            listed = structs.to_pylist()
            places = {}
            for i, p in enumerate(listed):
                places.setdefault(tuple(p[k] for k in keys), i)
            copies = Counter(tuple(p[k] for k in keys) for p in listed)
            line, week, price = series[own], week[own], price[own]
            first, made = [], []
            for key, i in places.items():
                p = listed[i]
                if (p["filing_type"], p["keyword"]) not in known or filed_earlier and None in (p["_begin"], p["_last"], p["time_delay"]):
                    continue
                weeks, rate = known[p["filing_type"], p["keyword"]]
                low, high = np.searchsorted(line, [series[at[i]], series[at[i]] + 1])
                if p["_begin"] is not None:
                    low += np.searchsorted(week[low:high], p["_begin"])
                if filed_earlier:
                    high = low + np.searchsorted(week[low:high], p["_last"], "right")
                days, close = week[low:high], price[low:high]
                present, there = _met(weeks, days, p["time_delay"] if filed_earlier else 0)
                if not len(present):
                    continue
                days, close = days[present], close[present]
                later = np.full(len(days), np.nan)
                if p["time_delay"] is not None:
                    ahead, which = _met(days, days, -p["time_delay"])
                    later[ahead] = close[which]
                out = shape(days, _mean(rate[there], copies[key]), close, later, p)
                if out is not None and len(out[0]):
                    first.append(i)
                    made.append(out)
            if not made:
                continue
            whose = structs.take(pa.array(np.repeat(first, [len(m[0]) for m in made])))
            fields = [whose.field(k) for k in keys]
            days = pa.array(np.concatenate([m[0] for m in made]).astype(np.int32))
            rest = [np.concatenate(part) for part in list(zip(*made))[1:]]
            rest = [pa.array(v, mask=np.isnan(v)) if kind == "double" else pa.array(v.astype(np.int32)) for v, (_, kind) in zip(rest, columns)]
            yield pa.RecordBatch.from_arrays([*fields, days, *rest], names)

    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("_week", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType() if kind == "double" else T.IntegerType()) for c, kind in columns]])
    found = dealt.groupBy("_shard").applyInArrow(tasks, schema)  # a shard is one group, sorted already
    return found.select(*keys, F.date_from_unix_date("_week").alias("week_opening_date"), *[c for c, _ in columns])
