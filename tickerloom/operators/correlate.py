"""Correlations of a symbol's prices with many lagged rates, over many ranges of weeks.

Spark deals the closes by symbol, sorts them, and puts the short table of rates in front of every share; inside a
task the rows of some hundred symbols are arrays, and what a range needs are differences of running moments. A close
is shuffled once, whatever the number of keywords, types, lags and ranges; no series is ever a row of its own.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import ROLLING_PRECEDING
from ..functions.scalars import FLAT

#: Closes worked on at once in a task.
CHUNK_ROWS = 100_000
#: Correlations this close to the k-th best are kept for the ranking by rounded values.
MARGIN = 1e-9
#: Rows after a start whose rolling rate the start restates.
HEAD = ROLLING_PRECEDING
_LATE = 1 << 40


def correlated(closes, rates, lags, ranges, missing, best=None):
    """Correlation of each symbol, keyword, type and lag over ``ranges``, pairs of (start, end) days since 1970.

    A range goes from the first row at or after its start to the last one at or before its end (None: the last row); its rolling
    rate begins with it. ``closes`` has stock_symbol, week_opening_date and week_close_price, ``rates`` filing_week,
    keyword, filing_type and mention_rate, one row a key. Of rows without a price, ``missing`` says if they are left out
    ("row") or count with their rate alone ("price"). ``best``, a number and a direction (desc, asc or both), allows to leave out whatever is not
    among so many of its range and combination within a task's symbols; then the optimizer may also join small shares, as
    a task leaves out more the more symbols it has.
    """
    dealt = _dealt(closes, rates, bool(best))
    lags, ranges = [int(n) for n in lags], list(ranges)

    def tasks(batches):
        bars = {}
        for table, symbols, series, week, price, _ in _chunks(batches):
            for kind, words, weeks, values in _rate_groups(table):
                for lag in lags:
                    yield from _correlated_chunk(symbols, series, week, price, kind, words, weeks, values, lag, ranges, missing, best, bars)

    found = dealt.mapInArrow(tasks, "stock_symbol string, keyword string, filing_type string, time_delay int, _start int, _end int, correlation double")
    return found.select(
        "stock_symbol", "keyword", "filing_type", "time_delay", F.date_from_unix_date("_start").alias("start_date"),
        F.date_from_unix_date("_end").alias("end_date"), "correlation")


def _dealt(closes, rates, joinable=False, extra=None):
    """Closes by shards of symbols, sorted by symbol and week, behind a copy of the rates in each shard.

    ``joinable`` lets the optimizer put several shards in a task, by their measured size. ``extra`` (stock_symbol and
    further columns) adds rows without a week in front of their symbol's closes.
    """
    shards = int(closes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    symbol = F.col("stock_symbol")
    line = closes.select(
        F.pmod(F.xxhash64(symbol), F.lit(shards)).cast("int").alias("_shard"), F.lit(1).alias("_kind"), symbol.alias("_symbol"),
        F.unix_date("week_opening_date").alias("_week"), F.col("week_close_price").cast("double").alias("_value"),
        none.cast("string").alias("_keyword"), none.cast("string").alias("_type"),
    ).filter("_week IS NOT NULL").unionAll(rates.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), F.lit(0), none.cast("string"), F.unix_date("filing_week"),
        F.col("mention_rate").cast("double"), "keyword", "filing_type"))
    if extra is not None:
        more = [f for f in extra.schema.fields if f.name != "stock_symbol"]
        whose = extra.select(
            F.pmod(F.xxhash64(symbol), F.lit(shards)).cast("int"), F.lit(1), symbol, none.cast("int"), none.cast("double"), none.cast("string"),
            none.cast("string"), *[f.name for f in more])
        line = line.select("*", *[none.cast(f.dataType).alias(f.name) for f in more]).unionAll(whose)
    spread = line.repartition("_shard") if joinable else line.repartition(shards, "_shard")
    return spread.sortWithinPartitions("_shard", "_kind", "_symbol", "_week")


def rolled(closes, rates, lags):
    """Each close with the rates filed n weeks earlier, for every keyword, type and lag, and the trailing mean of that series.

    Columns as in :func:`correlated`; the mean takes the row and up to ``ROLLING_PRECEDING`` earlier rows of the series.
    """
    lags = [int(n) for n in lags]

    def tasks(batches):
        for table, symbols, series, week, price, _ in _chunks(batches):
            for kind, words, weeks, values in _rate_groups(table):
                for lag in lags:
                    present, at = _met(weeks, week, lag)
                    if not len(present):
                        continue
                    _, number = np.unique(series[present], return_inverse=True)
                    size, spot = _spots(number)
                    names, days = symbols.take(pa.array(series[present])), pa.array(week[present].astype(np.int32))
                    close = price[present]
                    for word, known in zip(words, values):
                        rate = known[at]
                        out = np.full(len(size) * int(size.max()), np.nan)
                        out[spot] = rate
                        mean = _rolling(out.reshape(len(size), -1))[0].ravel()[spot]
                        yield pa.RecordBatch.from_arrays(
                            [names, _same(word, len(rate)), _same(kind, len(rate)), pa.array(np.full(len(rate), lag, np.int32)), days,
                             *[pa.array(v, mask=np.isnan(v)) for v in (close, rate, mean)]],
                            ["stock_symbol", "keyword", "filing_type", "time_delay", "_week", "week_close_price", "mention_rate", "rolling"])

    found = _dealt(closes, rates).mapInArrow(
        tasks, "stock_symbol string, keyword string, filing_type string, time_delay int, _week int, week_close_price double, mention_rate double, rolling double")
    return found.select("stock_symbol", "keyword", "filing_type", "time_delay", F.date_from_unix_date("_week").alias("week_opening_date"),
                        "week_close_price", "mention_rate", "rolling")


def rolled_across(closes, rates, lags):
    """As :func:`rolled`, but the mean of a keyword, type and lag runs on from symbol to symbol, in their order."""
    lags = [int(n) for n in lags]

    def tasks(batches):
        for symbols, series, week, close, kind, word, lag, rate, mean in _across(batches, lags):
            yield pa.RecordBatch.from_arrays(
                [symbols.take(pa.array(series)), _same(word, len(rate)), _same(kind, len(rate)), pa.array(np.full(len(rate), lag, np.int32)),
                 pa.array(week.astype(np.int32)), *[pa.array(v, mask=np.isnan(v)) for v in (close, rate, mean)]],
                ["stock_symbol", "keyword", "filing_type", "time_delay", "_week", "week_close_price", "mention_rate", "rolling"])

    found = _dealt(closes, rates, extra=_carried(closes, rates, lags)).mapInArrow(
        tasks, "stock_symbol string, keyword string, filing_type string, time_delay int, _week int, week_close_price double, mention_rate double, rolling double")
    return found.select("stock_symbol", "keyword", "filing_type", "time_delay", F.date_from_unix_date("_week").alias("week_opening_date"),
                        "week_close_price", "mention_rate", "rolling")


def correlated_across(closes, rates, lags):
    """Correlation of the closes with the mean of :func:`rolled_across` per symbol, keyword, type and lag, where both vary."""
    lags = [int(n) for n in lags]

    def tasks(batches):
        for symbols, series, _, close, kind, word, lag, _, mean in _across(batches, lags):
            begins = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
            number = np.cumsum(np.r_[0, series[1:] != series[:-1]])

            def moments(values, use):
                n = np.add.reduceat(use.astype(float), begins)
                middle = np.add.reduceat(np.where(use, values, 0), begins) / n
                return n, middle, np.where(use, values - middle[number], 0)

            priced, rated = ~np.isnan(close), ~np.isnan(mean)
            both = priced & rated
            with np.errstate(all="ignore"):
                spreads, varies = 1.0, True
                for values, use in ((close, priced), (mean, rated)):
                    n, middle, apart = moments(values, use)
                    spread = np.sqrt(np.add.reduceat(apart * apart, begins) / n)
                    spreads, varies = spreads * spread, varies & (spread > FLAT * np.abs(middle))
                n, _, x = moments(close, both)
                y = moments(mean, both)[2]
                corr = np.add.reduceat(x * y, begins) / n / spreads
            take = np.flatnonzero(varies & ~np.isnan(corr))
            if len(take):
                yield pa.RecordBatch.from_arrays(
                    [symbols.take(pa.array(series[begins[take]])), _same(word, len(take)), _same(kind, len(take)),
                     pa.array(np.full(len(take), lag, np.int32)), pa.array(corr[take])],
                    ["stock_symbol", "keyword", "filing_type", "time_delay", "correlation"])

    return _dealt(closes, rates, extra=_carried(closes, rates, lags)).mapInArrow(
        tasks, "stock_symbol string, keyword string, filing_type string, time_delay int, correlation double")


def _carried(closes, rates, lags):
    """Filing weeks of the ``HEAD`` rows before a symbol's first one, for each class of keywords with rows in the same weeks and lag.

    A symbol hands on its own last weeks, so the window has one short row per symbol and class, whatever the keywords.
    """
    def tasks(batches):
        for table, symbols, series, week, _, _ in _chunks(batches):
            for g, (_, _, weeks, _) in enumerate(_rate_groups(table)):
                for i, lag in enumerate(lags):
                    present, at = _met(weeks, week, lag)
                    if not len(present):
                        continue
                    kept, size = np.unique(series[present], return_counts=True)
                    ends = np.cumsum(size)
                    last = np.arange(len(present)) >= np.repeat(ends - HEAD, size)
                    offsets = np.r_[0, np.cumsum(np.minimum(size, HEAD))].astype(np.int32)
                    days = pa.ListArray.from_arrays(pa.array(offsets), pa.array(weeks[at[last]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [symbols.take(pa.array(kept)), pa.array(np.full(len(kept), g * len(lags) + i, np.int32)), days], ["stock_symbol", "_class", "_own"])

    tails = _dealt(closes, rates).mapInArrow(tasks, "stock_symbol string, _class int, _own array<int>")
    before = Window.partitionBy("_class").orderBy(F.col("stock_symbol").asc_nulls_first()).rowsBetween(-HEAD, -1)
    earlier = F.flatten(F.collect_list("_own").over(before))
    return tails.select("stock_symbol", "_class", F.slice(earlier, F.greatest(F.size(earlier) - HEAD + 1, F.lit(1)), HEAD).alias("_days"))


def _across(batches, lags):
    """Symbols, symbol number, week, close, type, keyword, lag, rate and mean of the rows of each chunk, keyword, type and lag."""
    for table, symbols, series, week, price, rows in _chunks(batches):
        classes = rows["_class"].fill_null(-1).to_numpy()
        own = np.flatnonzero(classes < 0)
        series_own, week_own, price_own = series[own], week[own], price[own]
        handed = rows["_days"].combine_chunks()
        for g, (kind, words, weeks, values) in enumerate(_rate_groups(table)):
            for i, lag in enumerate(lags):
                present, at = _met(weeks, week_own, lag)
                if not len(present):
                    continue
                kept, number = np.unique(series_own[present], return_inverse=True)
                size, spot = _spots(number)
                length = int(size.max()) + HEAD
                spot = spot + (number + 1) * HEAD  # each line begins with the carried rows
                of = np.flatnonzero(classes == g * len(lags) + i)
                lists = handed.take(pa.array(of))
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
                line = np.repeat(np.searchsorted(kept, series[of]), n)
                column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - HEAD, n)
                front = line * length + column
                before = np.searchsorted(weeks, lists.flatten().to_numpy())
                found = series_own[present], week_own[present], price_own[present]
                for word, known in zip(words, values):
                    rate = known[at]
                    out = np.full(len(kept) * length, np.nan)
                    out[front], out[spot] = known[before], rate
                    yield symbols, *found, kind, word, lag, rate, _rolling(out.reshape(len(kept), -1))[0].ravel()[spot]


def _met(weeks, week, lag):
    """Rows with a rate ``lag`` weeks earlier, and where that rate is."""
    at = np.searchsorted(weeks, week - 7 * lag)
    present = np.flatnonzero(weeks[np.minimum(at, len(weeks) - 1)] == week - 7 * lag)
    return present, at[present]


def _spots(number):
    """Rows of each series, and the place of each row where every series is a line of equal length."""
    size = np.bincount(number)
    before = np.cumsum(size) - size
    return size, number * int(size.max()) + np.arange(len(number)) - before[number]


def _rolling(rate):
    """Trailing mean of each line, and how many rates it is of; NaN is no rate."""
    rated = ~np.isnan(rate)
    r, length = np.where(rated, rate, 0), rate.shape[1]
    total, count = np.zeros(r.shape), np.zeros(r.shape)
    for j in range(min(ROLLING_PRECEDING, length - 1), -1, -1):  # oldest first
        total[:, j:] += r[:, :length - j]
        count[:, j:] += rated[:, :length - j]
    with np.errstate(all="ignore"):
        return total / count, count


def _same(value, n):
    return pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), pa.array([value])).dictionary_decode()


def _chunks(batches):
    """The rates with arrays of whole symbols: their names, symbol number, week and close of each row, and these rows as a table.

    All shards of a task have the same rates, so those of the first one serve.
    """
    first, rates, held, size = None, [], [], 0

    def whole(last):
        """Rows to work on, and those kept back because their symbol may go on."""
        every = pa.concat_tables(held).combine_chunks()
        codes = every["_symbol"].combine_chunks().dictionary_encode(null_encoding="encode")
        number = codes.indices.to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        cut = len(number) if last else begins[-1]
        if not cut:
            return None, [every]
        begins = begins[begins < cut]
        names = codes.dictionary.take(pa.array(number[begins]))
        series = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, cut]))
        kept = every.slice(0, cut)
        price = kept["_value"].to_numpy().astype(float)  # null becomes NaN
        return (pa.concat_tables(rates), names, series, kept["_week"].fill_null(0).to_numpy(), price, kept), [every.slice(cut)] if cut < len(number) else []

    for batch in batches:
        mark = batch["_shard"].to_numpy() * 2 + batch["_kind"].to_numpy()
        edges = np.r_[0, np.flatnonzero(mark[1:] != mark[:-1]) + 1, len(mark)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            piece, of, kind = pa.Table.from_batches([batch.slice(low, high - low)]), mark[low] // 2, mark[low] % 2
            if not kind:
                first = of if first is None else first
                if of == first:
                    rates.append(piece)
                continue
            held.append(piece)
            size += high - low
            if size >= CHUNK_ROWS and rates:
                ready, held = whole(False)
                if ready:
                    yield ready
                size = sum(t.num_rows for t in held)
    if held and rates:
        yield whole(True)[0]


def _rate_groups(table):
    """(type, keywords, weeks, rates of each keyword) of keywords that have rows in the same weeks; a null rate is NaN."""
    rows = defaultdict(list)
    cells = zip(*[table[c].to_pylist() for c in ("_type", "_keyword", "_week", "_value")])
    for kind, word, week, value in cells:
        if None not in (kind, word, week):
            rows[kind, word].append((week, np.nan if value is None else value))
    groups = defaultdict(list)
    for (kind, word), found in sorted(rows.items()):
        found.sort()
        groups[kind, tuple(w for w, _ in found)].append((word, [v for _, v in found]))
    return [(kind, [w for w, _ in words], np.array(weeks), np.array([v for _, v in words])) for (kind, weeks), words in groups.items()]


def _back(values):
    """Sums from each place to the end, and one more place for what lies behind it."""
    out = np.zeros((values.shape[0], values.shape[1] + 1))
    np.cumsum(values[:, ::-1], axis=1, out=out[:, 1:])
    return out[:, ::-1]


def _differs(values, known):
    """Whether each value differs from the one before, where both are known."""
    a, b = values[:, 1:], values[:, :-1]
    moved = (np.abs(a - b) > FLAT * np.maximum(np.abs(a), np.abs(b))) & known[:, 1:] & known[:, :-1]
    return np.pad(moved, ((0, 0), (1, 0))).astype(float)


def _correlated_chunk(symbols, series, week, price, kind, words, weeks, values, lag, ranges, missing, best, bars):
    present, at = _met(weeks, week, lag)
    if not len(present):
        return
    kept, number = np.unique(series[present], return_inverse=True)
    week, price = week[present], price[present]
    size, spot = _spots(number)
    before = np.cumsum(size) - size
    n, length = len(kept), int(size.max())

    def laid(flat, empty):
        out = np.full(n * length, empty, dtype=np.asarray(flat).dtype)
        out[spot] = flat
        return out.reshape(n, length)

    valid = np.arange(length) < size[:, None]
    close = laid(price, np.nan)
    priced = ~np.isnan(close)
    # rows of a range: from the first at or after its start to the last at or before its end
    line = number * _LATE + week
    offset = np.arange(n)[:, None] * _LATE

    def place(days, side):
        return np.searchsorted(line, offset + np.array(days)[None], side) - before[:, None]

    start_days = sorted({s for s, _ in ranges})
    end_days = sorted({e for _, e in ranges if e is not None})
    of_start = np.array([start_days.index(s) for s, _ in ranges])
    first = place(start_days, "left")
    behind = place(end_days, "right") if end_days else size[:, None]
    of_end = np.array([end_days.index(e) for _, e in ranges]) if end_days else np.zeros(len(ranges), int)
    begins = np.minimum(first, length - 1)
    open_rows = first[:, of_start] < behind[:, of_end]
    rows = behind[:, of_end] - first[:, of_start]
    inside = np.clip(rows, 1, HEAD) - 1
    tail, end = np.minimum(first[:, of_start] + HEAD, length), np.maximum(behind[:, of_end], 0)
    end = np.maximum(end, tail)  # an empty tail has no sums
    with np.errstate(all="ignore"):
        centre = np.where(priced, close, 0).sum(1) / priced.sum(1)
        x = np.where(priced, close - centre[:, None], 0)
        spots = begins[:, :, None] + np.arange(HEAD)
        within = spots < size[:, None, None]
        flat = np.arange(n)[:, None, None] * length + np.minimum(spots, length - 1)
        head_x, head_priced = x.ravel()[flat], priced.ravel()[flat] & within
        which = of_start[None], inside
        lane = np.arange(n)[:, None]

        def head(terms):
            return np.cumsum(terms, axis=2)[lane, which[0], which[1]]

        def beyond(terms):
            back = _back(terms)
            return back[lane, tail] - back[lane, end]

        if missing == "row":
            price_moves = _back(_differs(close, priced))
        else:  # from one price to the next one, over rows without
            latest = np.maximum.accumulate(np.where(priced, np.arange(length), -1), axis=1)
            price_moves = _back(_differs(close[lane, np.maximum(latest, 0)], valid & (latest >= 0)))
        low = np.minimum(first[:, of_start] + 1, length)
        x_moves = price_moves[lane, low] - price_moves[lane, np.maximum(behind[:, of_end], low)]
        for word, rates in zip(words, values):
            rate = laid(rates[at], np.nan)
            rated = ~np.isnan(rate)
            r = np.where(rated, rate, 0)
            rolling, count = _rolling(rate)
            known = valid & (count > 0)
            middle = r.sum(1) / rated.sum(1)
            head_r, head_rated = r.ravel()[flat], rated.ravel()[flat] & within
            restated = np.cumsum(head_r * within, axis=2) / np.cumsum(head_rated, axis=2)
            head_known = within & ~np.isnan(restated)
            y = np.where(known, rolling - middle[:, None], 0)
            head_y = np.where(head_known, restated - middle[:, None, None], 0)
            if missing == "row":
                use, head_use = known & priced, head_known & head_priced
                ones, head_ones = use, head_use
                ux, uy, hx, hy = x * use, y * use, head_x * head_use, head_y * head_use
            else:
                ones, head_ones = valid, within
                ux, uy, hx, hy = x, y, head_x * head_priced, head_y
            m = {}
            for name, body, top in (("n", ones.astype(float), head_ones.astype(float)), ("x", ux, hx), ("y", uy, hy),
                                    ("xx", ux * ux, hx * hx), ("yy", uy * uy, hy * hy), ("xy", ux * uy, hx * hy)):
                m[name] = head(top) + beyond(body)
            # moves of the rolling rate: within the head, from it to the tail, within the tail
            head_moves = np.cumsum(np.pad(
                (np.abs(np.diff(restated, axis=2)) > FLAT * np.maximum(np.abs(restated[:, :, 1:]), np.abs(restated[:, :, :-1])))
                & head_known[:, :, 1:] & head_known[:, :, :-1], ((0, 0), (0, 0), (1, 0))), axis=2)
            rate_moves = _back(_differs(rolling, known))
            after = np.minimum(tail, length - 1)
            last = np.where(head_known[:, :, -1], restated[:, :, -1], np.nan)[:, of_start]
            there = rolling[lane, after]
            crossed = (np.abs(there - last) > FLAT * np.maximum(np.abs(there), np.abs(last))) & (rows > HEAD)
            low = np.minimum(tail + 1, length)
            y_moves = head_moves[lane, which[0], which[1]] + crossed + rate_moves[lane, low] - rate_moves[lane, np.maximum(end, low)]
            cov = m["xy"] - m["x"] * m["y"] / m["n"]
            var_x, var_y = m["xx"] - m["x"] ** 2 / m["n"], m["yy"] - m["y"] ** 2 / m["n"]
            corr = cov / (np.sqrt(var_x) * np.sqrt(var_y))
            corr[~(open_rows & (x_moves > 0) & (y_moves > 0) & (var_x > 0) & (var_y > 0))] = np.nan
            yield from _results(corr, symbols, kept, ranges, kind, word, lag, best, bars)


def _results(corr, symbols, kept, ranges, kind, word, lag, best, bars):
    """Rows of the correlations; with ``best`` of those that may be among the k best so far, which ``bars`` keeps from chunk to chunk."""
    take = ~np.isnan(corr)
    if best:
        k, direction = best
        near = np.zeros(corr.shape, bool)
        for sign in {"desc": (1,), "asc": (-1,), "both": (1, -1)}[direction]:
            turned = np.where(take, sign * corr, -np.inf)
            known = bars.get((kind, word, lag, sign), np.full((k, len(ranges)), -np.inf))
            every = np.concatenate([known, turned])
            bars[kind, word, lag, sign] = np.partition(every, len(turned), axis=0)[len(turned):]
            near |= turned >= bars[kind, word, lag, sign][0] - MARGIN
        take &= near
    row, column = np.nonzero(take)
    if len(row):
        days = np.array([(s, -1 if e is None else e) for s, e in ranges], dtype=np.int32)
        ends = pa.array(days[column, 1], mask=days[column, 1] < 0)
        yield pa.RecordBatch.from_arrays(
            [symbols.take(pa.array(kept[row])), _same(word, len(row)), _same(kind, len(row)), pa.array(np.full(len(row), lag, np.int32)),
             pa.array(days[column, 0]), ends, pa.array(corr[row, column])],
            ["stock_symbol", "keyword", "filing_type", "time_delay", "_start", "_end", "correlation"])
