"""Price / mention-rate correlation over a whole parameter grid as one distributed job.

The grids shuffle the weekly closes by symbol, once, and correlate them in tasks (``operators/correlate``). Elsewhere weekly
rows meet the mention rates on the (lag-shifted) week, then one exchange brings each series together. A series is at
most one row per calendar week.
"""

from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import CORRELATION_WARMUP, FILING_TYPES, GRID_MAX_DAYS, GRID_MIN_DAYS, TOP_K
from ..functions.scalars import FLAT, change, half_even, match_rate, movement, safe_corr
from ..operators.correlate import correlated, correlated_across, rolled, rolled_across
from ..operators.filters import all_of, dates_within, equals
from ..operators.joins import lag_join
from ..operators.ranking import skip_first, top_k, top_k_per_group
from ..operators.windows import trailing_mean, trailing_mean_across_series
from .keywords import mention_rates

SERIES = ["stock_symbol", "keyword", "filing_type", "time_delay"]
COMBINATION = ["start_date", "end_date", "time_delay", "keyword", "filing_type"]


def _weeks_between(start, end):
    return (date.fromisoformat(str(end)) - date.fromisoformat(str(start))).days // 7 + 1


def lagged_mentions(weekly, counts, lags, keywords=None, filing_types=None, start=None, end=None):
    """Weekly closes with the mention rate filed n weeks earlier, for every lag, keyword and type.

    Both inputs hold one row per key, so the result is already distinct. When the date
    range, keywords and types are given they bound the rate rows by the calendar, which
    is what permits sending that side to every executor.
    """
    lags = [lags] if isinstance(lags, int) else list(lags)
    rates = mention_rates(counts, keywords, filing_types)
    bound = None
    if start and end:
        earliest = F.date_sub(F.to_date(F.lit(str(start))), 7 * max(lags))
        rates = rates.filter(F.col("filing_week").between(earliest, F.to_date(F.lit(str(end)))))
        if keywords:
            bound = (_weeks_between(start, end) + max(lags)) * len(keywords) * len(filing_types or FILING_TYPES)
    closes = all_of(
        weekly.select("stock_symbol", "week_opening_date", "week_close_price"),
        dates_within("week_opening_date", start, end),
    )
    joined = lag_join(closes, rates, "week_opening_date", "filing_week", lags, max_right_rows=bound)
    return joined.select(*SERIES, "week_opening_date", "week_close_price", "mention_rate")


def rolling_mentions(weekly, counts, lags, keywords=None, filing_types=None, start=None, end=None, across_symbols=False):
    """:func:`lagged_mentions` with the 13-row rolling rate of each series.

    ``across_symbols`` lets the rolling mean of a combination run on from symbol to symbol.
    """
    closes, rates, lags = _side_by_side(weekly, counts, lags, keywords, filing_types, start, end)
    return (rolled_across if across_symbols else rolled)(closes, rates, lags).withColumnRenamed("rolling", "mention_rolling_avg")


# ---- the grid over start months ---------------------------------------------

def _month_number(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c) - 1


def correlations_by_start(series, since):
    """Correlation of each series from every month start (from ``since``) to its last week.

    A start month only changes the rolling rate of the 12 rows after it. So each row is
    emitted for the months its own frame spans, plus once, for all earlier months, under
    the month its frame begins in; sums over later months then complete each start. Rows
    grow with weeks, not with weeks x start months.
    """
    opening = _month_number(F.to_date(F.lit(str(since))))
    everything = Window.partitionBy(*SERIES)
    ordered = everything.orderBy("week_opening_date")
    first_week = F.min("week_opening_date").over(everything)
    rows = series.withColumns({
        "rolling": F.avg("mention_rate").over(ordered.rowsBetween(-12, 0)),
        "frame_month": _month_number(F.coalesce(F.lag("week_opening_date", 12).over(ordered), first_week)),
        "week_month": _month_number("week_opening_date"),
        "x": F.col("week_close_price") - F.avg("week_close_price").over(everything),
        "centre": F.avg("mention_rate").over(everything),
        "first": F.col("week_opening_date") == first_week,
    })
    # months up to the row's own: the one its frame begins in stands for all earlier starts (kind
    # 2), later ones restate the rolling rate (1); starts before the series have no row of
    # their own, so its first row leaves an empty entry for each (0)
    months = F.sequence(F.when(F.col("first"), opening).otherwise(F.col("frame_month")), F.col("week_month"))
    entries = rows.select(
        *SERIES, "week_opening_date", "x", "centre", "rolling", "mention_rate", "frame_month",
        F.col("week_close_price").alias("p"), F.explode(months).alias("month"),
    ).withColumn("kind", F.when(F.col("month") == F.col("frame_month"), 2)
                 .when(F.col("month") > F.col("frame_month"), 1).otherwise(0))
    since_start = Window.partitionBy(*SERIES, "month").orderBy("week_opening_date").rowsBetween(
        Window.unboundedPreceding, 0)
    restated = F.avg(F.when(F.col("kind") == 1, F.col("mention_rate"))).over(since_start)
    entries = entries.withColumn("y", F.when(F.col("kind") == 2, F.col("rolling")).otherwise(restated))
    entries = entries.withColumn("dy", F.col("y") - F.col("centre"))

    def sums(kind, tag):
        use = F.col("kind") == kind
        terms = {
            "n": F.lit(1.0), "x": F.col("x"), "y": F.col("dy"), "xx": F.col("x") * F.col("x"),
            "yy": F.col("dy") * F.col("dy"), "xy": F.col("x") * F.col("dy"),
        }
        out = [F.sum(F.when(use, t).otherwise(F.lit(0.0))).alias(f"{tag}_{n}") for n, t in terms.items()]
        for n, t in {"p": "p", "q": "y"}.items():
            out += [F.min(F.when(use, F.col(t))).alias(f"{tag}_lo{n}"), F.max(F.when(use, F.col(t))).alias(f"{tag}_hi{n}")]
        return out

    monthly = entries.groupBy(*SERIES, "month").agg(*sums(1, "own"), *sums(2, "all"))
    later = Window.partitionBy(*SERIES).orderBy(F.col("month").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = {n: F.col(f"own_{n}") + F.sum(f"all_{n}").over(later) for n in ("n", "x", "y", "xx", "yy", "xy")}
    for n in ("p", "q"):
        totals[f"lo{n}"] = F.least(F.col(f"own_lo{n}"), F.min(f"all_lo{n}").over(later))
        totals[f"hi{n}"] = F.greatest(F.col(f"own_hi{n}"), F.max(f"all_hi{n}").over(later))
    t = monthly.select(*SERIES, "month", *[e.alias(n) for n, e in totals.items()])

    def moves(n):
        return F.col(f"hi{n}") - F.col(f"lo{n}") > FLAT * F.greatest(F.abs(f"hi{n}"), F.abs(f"lo{n}"))

    n = F.col("n")
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    var_x = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n)
    var_y = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)
    corr = F.when(moves("p") & moves("q") & (var_x > 0) & (var_y > 0), F.try_divide(cov, F.sqrt(var_x) * F.sqrt(var_y)))
    start = F.make_date(F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1))
    return t.select(*SERIES, start.alias("start_date"), corr.alias("correlation"))


def _side_by_side(weekly, counts, lags, keywords, filing_types, start, end):
    """Closes and rates of the rows that :func:`lagged_mentions` joins."""
    lags = [lags] if isinstance(lags, int) else list(lags)
    rates = mention_rates(counts, keywords, filing_types)
    if start and end:
        earliest = F.date_sub(F.to_date(F.lit(str(start))), 7 * max(lags))
        rates = rates.filter(F.col("filing_week").between(earliest, F.to_date(F.lit(str(end)))))
    closes = all_of(weekly.select("stock_symbol", "week_opening_date", "week_close_price"), dates_within("week_opening_date", start, end))
    return closes, rates, lags


def _day(d):
    return (date.fromisoformat(str(d)) - date(1970, 1, 1)).days


def _month_starts(first, last):
    """Days of the month starts from one day to another."""
    first, last = date.fromisoformat(str(first)), date.fromisoformat(str(last))
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [_day(d) for d in (date(m // 12, m % 12 + 1, 1) for m in months) if first <= d <= last]


def correlation_grid(weekly, counts, starts, since, as_of, lags, keywords, filing_types=FILING_TYPES,
                     min_days=GRID_MIN_DAYS, best=None):
    """Correlation per symbol, keyword, type, lag and start month, up to ``as_of``.

    ``best``, a number and a direction, may leave out what cannot be among so many of its combination (see :func:`correlated`).
    :func:`correlations_by_start` states the same over the joined rows.
    """
    closes, rates, lags = _side_by_side(weekly, counts, lags, keywords, filing_types, since, as_of)
    last = date.fromisoformat(str(as_of)) - timedelta(days=min_days)
    ranges = [(s, None) for s in _month_starts(since, last)]
    found = correlated(closes, rates, lags, ranges, "price", best)
    return found.join(starts, "start_date", "left_semi").withColumn("end_date", F.to_date(F.lit(str(as_of))))


def range_correlations(weekly, counts, lags, keywords, start, end, filing_types=FILING_TYPES, across_symbols=False):
    """Correlation per symbol, keyword, type and lag over one range of weeks, in the form of the grid.

    ``across_symbols`` lets the rolling mean of a combination run on from symbol to symbol.
    """
    if across_symbols:
        found = correlated_across(*_side_by_side(weekly, counts, lags, keywords, filing_types, start, end))
    else:
        rows = lagged_mentions(weekly, counts, lags, keywords, filing_types, start, end)
        means = trailing_mean(rows, SERIES, ["week_opening_date"], "mention_rate", "rolling")
        found = means.groupBy(*SERIES).agg(safe_corr("week_close_price", "rolling").alias("correlation"))
    return found.filter(F.col("correlation").isNotNull()).select(
        *SERIES, F.to_date(F.lit(str(start))).alias("start_date"), F.to_date(F.lit(str(end))).alias("end_date"), "correlation")


#: Terms of a correlation that add up over rows.
MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def _terms(x, y):
    """Moments of one row; none of a row that lacks a value."""
    one = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    return {k: F.when(x.isNotNull() & y.isNotNull(), v).otherwise(F.lit(0.0)) for k, v in one.items()}


def _differs(value, before):
    return F.abs(value - before) > FLAT * F.greatest(F.abs(value), F.abs(before))


def _restated(head):
    """Running moments and changes of the first rows after a start, from their prices and rates.

    The rolling rate of the k-th row is the mean of the first k rates there.
    """
    start = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0).alias("rates"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("moves"),
        *[F.lit(0.0).alias(m) for m in MOMENTS],
        F.array().cast("array<struct<moves:int,last:double,n:double,x:double,y:double,xx:double,yy:double,xy:double>>").alias("out"))

    def add(state, row):
        total = state["sum"] + F.coalesce(row["rate"], F.lit(0.0))
        rates = state["rates"] + row["rate"].isNotNull().cast("int")
        y = F.try_divide(total, rates.cast("double"))
        moves = state["moves"] + F.coalesce(_differs(y, state["last"]), F.lit(False)).cast("int")
        last = F.coalesce(y, state["last"])
        sums = {m: state[m] + t for m, t in _terms(row["x"], y - row["centre"]).items()}
        entry = F.struct(moves.alias("moves"), last.alias("last"), *[v.alias(m) for m, v in sums.items()])
        return F.struct(
            total.alias("sum"), rates.alias("rates"), last.alias("last"), moves.alias("moves"), *[v.alias(m) for m, v in sums.items()],
            F.concat(state["out"], F.array(entry)).alias("out"))

    return F.aggregate(head, start, add, lambda state: state["out"])


def correlations_by_range(series, since, as_of, ends_since, min_days=GRID_MIN_DAYS, max_days=GRID_MAX_DAYS):
    """Correlation of each series from every month start to every week 180 to 365 days later.

    Running moments of a series make every range a difference of two rows; a start changes the rolling rate
    of its first 12 rows only, whose moments are restated once a start. So work grows with weeks plus results,
    not with the weeks inside the results, and all of it runs on one partitioning by series. An end week without
    a row of the series takes the value of its last row before.
    """
    head_rows = 12
    whole = Window.partitionBy(*SERIES)
    ordered = whole.orderBy("week_opening_date")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumns({
        "rolling": F.avg("mention_rate").over(ordered.rowsBetween(-12, 0)),
        "x": F.col("week_close_price") - F.avg("week_close_price").over(whole),
        "centre": F.avg("mention_rate").over(whole), "at": F.row_number().over(ordered),
        "before": F.lag("week_opening_date").over(ordered), "after": F.lead("week_opening_date").over(ordered),
    })
    terms = _terms(F.col("x"), F.col("rolling") - F.col("centre"))
    rows = rows.withColumns({
        **terms, "x_move": F.coalesce(_differs(F.col("week_close_price"), F.lag("week_close_price").over(ordered)), F.lit(False)).cast("int"),
        "y_move": F.coalesce(_differs(F.col("rolling"), F.lag("rolling").over(ordered)), F.lit(False)).cast("int"),
        "head": F.collect_list(F.struct("x", F.col("mention_rate").alias("rate"), "centre")).over(ordered.rowsBetween(0, head_rows - 1)),
    })
    running = F.struct("at", *[F.sum(m).over(so_far).alias(m) for m in MOMENTS],
                       F.sum("x_move").over(so_far).alias("x_moves"), F.sum("y_move").over(so_far).alias("y_moves"))
    rows = rows.withColumn("sums", running).withColumns({
        "head_sums": F.lead("sums", head_rows - 1).over(ordered), "next_sums": F.lead("sums", head_rows).over(ordered),
        "next_rolling": F.lead("rolling", head_rows).over(ordered),
    })
    since, as_of, ends_since = (F.to_date(F.lit(str(d))) for d in (since, as_of, ends_since))
    step = F.expr("interval 1 month")
    day = F.col("week_opening_date")

    def months(first, last):
        opening = F.add_months(F.trunc(F.date_sub(first, 1), "month"), 1)  # the first month start on or after it
        return F.when(opening <= last, F.sequence(opening, last, step)).otherwise(F.array().cast("array<date>"))

    # starts whose first row this is, and results that end in the weeks up to the next row
    starts = months(F.greatest(since, F.coalesce(F.date_add("before", 1), F.date_sub(day, max_days))), day)
    last = F.least(as_of, F.coalesce(F.date_sub("after", 1), F.date_add(day, max_days)))
    first = F.date_add(day, F.greatest(F.lit(0), F.ceil(F.datediff(ends_since, day) / 7)).cast("int") * 7)
    ends = F.when(first <= last, F.sequence(first, last, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))
    opened = F.struct(
        F.col("at"), F.col("restated").alias("head"), F.col("sums.x_moves").alias("x_moves"), F.col("head_sums"), F.col("next_sums"),
        F.coalesce(_differs(F.col("next_rolling"), F.get("restated", F.lit(head_rows - 1))["last"]), F.lit(False)).cast("int").alias("next_move"))
    rows = rows.withColumn("starts", starts).withColumn("restated", F.when(F.size("starts") > 0, _restated(F.col("head"))))
    entries = F.concat(
        F.transform("starts", lambda s: F.struct(s.alias("start_date"), F.lit(None).cast("date").alias("end_date"))),
        F.flatten(F.transform(ends, lambda e: F.transform(
            months(F.greatest(since, F.date_sub(e, max_days)), F.date_sub(e, min_days)), lambda s: F.struct(s.alias("start_date"), e.alias("end_date"))))))
    met = rows.withColumn("opened", opened).select(*SERIES, "sums", "opened", F.inline(entries)).withColumn(
        "opened", F.when(F.col("end_date").isNull(), F.col("opened")))
    # the entry that opens a start stands before its results
    found = met.withColumn(
        "first", F.first("opened", True).over(Window.partitionBy(*SERIES, "start_date").orderBy(F.col("end_date").asc_nulls_first())
                                              .rowsBetween(Window.unboundedPreceding, 0))).filter("end_date IS NOT NULL")
    rows_in = F.col("sums.at") - F.col("first.at") + 1
    inside = F.get("first.head", F.least(rows_in, F.lit(head_rows)) - 1)
    beyond = rows_in > head_rows
    totals = {m: inside[m] + F.when(beyond, F.col(f"sums.{m}") - F.col(f"first.head_sums.{m}")).otherwise(F.lit(0.0)) for m in MOMENTS}
    y_moves = inside["moves"] + F.when(beyond, F.col("first.next_move") + F.col("sums.y_moves") - F.col("first.next_sums.y_moves")).otherwise(0)
    t = found.filter(rows_in > 0).select(
        *SERIES, "start_date", "end_date", *[v.alias(m) for m, v in totals.items()],
        (F.col("sums.x_moves") - F.col("first.x_moves")).alias("x_moves"), y_moves.alias("y_moves"))
    n = F.col("n")
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    var_x = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n)
    var_y = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)
    corr = F.when((F.col("x_moves") > 0) & (F.col("y_moves") > 0) & (var_x > 0) & (var_y > 0),
                  F.try_divide(cov, F.sqrt(var_x) * F.sqrt(var_y)))
    return t.select(*SERIES, "start_date", "end_date", corr.alias("correlation"))


def backfill_grid(weekly, counts, starts, since, as_of, ends_since, lags, keywords, filing_types=("10-K",),
                  min_days=GRID_MIN_DAYS, max_days=GRID_MAX_DAYS, best=None):
    """As :func:`correlation_grid` for every week as end date, starts 180-365 days before it.

    :func:`correlations_by_range` states the same over the joined rows.
    """
    closes, rates, lags = _side_by_side(weekly, counts, lags, keywords, filing_types, since, as_of)
    calendar = weekly.select(F.col("week_opening_date").alias("end_date")).distinct().filter(
        F.col("end_date").between(F.to_date(F.lit(str(ends_since))), F.to_date(F.lit(str(as_of)))))
    mondays = [d for d in range(_day(ends_since), _day(as_of) + 1) if (d + 3) % 7 == 0]  # 1970-01-01 was a Thursday
    months = _month_starts(since, as_of)
    ranges = [(s, e) for e in mondays for s in months if e - max_days <= s <= e - min_days]
    return (
        correlated(closes, rates, lags, ranges, "row", best)
        .join(calendar, "end_date", "left_semi")
        .join(starts, "start_date", "left_semi")
    )


#: Scores are ranked at this precision, so noise in the last bits cannot reorder equal ones.
RANK_DIGITS = 12


def top_scores(grid, direction="desc", k=TOP_K):
    """k best (desc), worst (asc) or both, per parameter combination; ranked before rounding.

    For both, a row stands once under each direction with the sign turned, so one ranking serves
    them and only k rows a combination and task are shuffled.
    """
    grid = grid.withColumn("correlation", F.round("correlation", RANK_DIGITS))
    names = {"desc": ["direct"], "asc": ["inverse"], "both": ["direct", "inverse"]}[direction]
    sides = F.array(*[F.struct(F.lit(n).alias("direction"), (F.col("correlation") if n == "direct" else -F.col("correlation")).alias("_strength")) for n in names])
    turned = grid.select("*", F.inline(sides))
    kept = top_k_per_group(turned, [*COMBINATION, "direction"], "_strength", k, True, ["stock_symbol"])
    return kept.drop("_strength").withColumn("correlation", half_even("correlation", 4))


# ---- one symbol or one keyword -----------------------------------------------

def _mixed_series(weekly, counts, keyword, lag, filing_types, start, end, stock_symbol=None):
    """One series per symbol over all kept filing types; the type settles equal weeks."""
    kept = all_of(weekly, equals("stock_symbol", stock_symbol))
    return lagged_mentions(kept, counts, lag, [keyword], filing_types or None, start, end)


def keyword_correlations(weekly, counts, keyword, lag, filing_types=None, start=None, end=None,
                         stock_symbol=None, warmup=CORRELATION_WARMUP, across_symbols=False):
    """Correlation per symbol for one keyword after skipping the warm-up rows.

    ``across_symbols`` reproduces a rolling window that does not restart at a new symbol.
    """
    rows = _mixed_series(weekly, counts, keyword, lag, filing_types, start, end, stock_symbol)
    order = ["week_opening_date", "filing_type"]
    if across_symbols:
        rolled = trailing_mean_across_series(rows, [], ["stock_symbol"], order, "mention_rate", "rolling")
    else:
        rolled = trailing_mean(rows, ["stock_symbol"], order, "mention_rate", "rolling")
    rolled = skip_first(rolled, ["stock_symbol"], order, warmup)
    return rolled.groupBy("stock_symbol", "keyword").agg(safe_corr("week_close_price", "rolling").alias("correlation"))


def pair_correlation(weekly, counts, stock_symbol, start, end, keyword, lag, filing_types=None):
    found = keyword_correlations(weekly, counts, keyword, lag, filing_types, start, end, stock_symbol)
    return found.withColumn("correlation", half_even("correlation", 4))


def topk_keyword_correlations(weekly, counts, keyword, start, end, lag, filing_types=None,
                              direction="desc", k=TOP_K, across_symbols=False):
    found = keyword_correlations(weekly, counts, keyword, lag, filing_types, start, end, across_symbols=across_symbols)
    found = found.filter(F.col("correlation").isNotNull()).withColumn("correlation", F.round("correlation", RANK_DIGITS))
    best = top_k(found, "correlation", k, direction == "desc", ["stock_symbol"])
    return best.withColumn("correlation", half_even("correlation", 4))


def mention_chart(weekly, counts, stock_symbol, start, end, keyword, filing_types=None, limit=None):
    """Weekly close and rolling mention rate of one symbol, same week, for charting."""
    rows = _mixed_series(weekly, counts, keyword, 0, filing_types, start, end, stock_symbol)
    order = ["week_opening_date", "filing_type"]
    rolled = trailing_mean(rows, ["stock_symbol"], order, "mention_rate", "rolling")
    shown = skip_first(rolled, ["stock_symbol"], order, CORRELATION_WARMUP).select(
        "week_opening_date", "stock_symbol", "filing_type", "keyword",
        half_even("week_close_price", 2).alias("week_close_price"),
        half_even("rolling", 4).alias("mention_rolling_avg"),
    )
    return shown.orderBy(*order).limit(limit) if limit else shown


def chart_return(chart):
    """Return from the first to the last close of a chart."""
    order = F.struct("week_opening_date", "filing_type")
    ends = chart.groupBy("stock_symbol").agg(
        F.min_by("week_close_price", order).alias("first_close"),
        F.max_by("week_close_price", order).alias("last_close"),
    )
    return ends.withColumn("stock_return", change("last_close", "first_close"))


def comovement(weekly, counts, start, end, keyword, lag, filing_types=None, stock_symbol=None):
    """Per week: did the price and the rolling rate move the same way since n rows earlier?"""
    rows = _mixed_series(weekly, counts, keyword, lag, filing_types, start, end, stock_symbol)
    order = ["week_opening_date", "filing_type"]
    kept = skip_first(rows, ["stock_symbol"], order, CORRELATION_WARMUP)
    rolled = trailing_mean(kept, ["stock_symbol"], order, "mention_rate", "rolling")
    window = Window.partitionBy("stock_symbol").orderBy(*order)
    earlier = F.lag(F.struct("week_opening_date", "week_close_price", "rolling"), lag).over(window)
    return rolled.withColumn("_p", earlier).filter(F.col("_p").isNotNull()).select(
        "stock_symbol", "week_opening_date", "week_close_price",
        F.col("_p.rolling").alias("earlier_rolling_avg"),
        movement("week_close_price", "_p.week_close_price").alias("stock_moves"),
        movement("rolling", "_p.rolling").alias("keyword_moves"),
    )


def comovement_rate(weekly, counts, start, end, keyword, lag, filing_types=None, stock_symbol=None):
    moves = comovement(weekly, counts, start, end, keyword, lag, filing_types, stock_symbol)
    return moves.groupBy("stock_symbol").agg(match_rate("stock_moves", "keyword_moves").alias("comovement_rate"))
