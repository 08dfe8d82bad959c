"""

All inputs are the given tables or what Spark derives from them (see
``tickerloom.sources.derived``). ``oracle_sql`` holds the DuckDB twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.oracles import (
    AS_OF, BACKFILL_ENDS, BACKFILL_KEYWORDS, BACKFILL_LAGS, CHART, KEYWORDS, LAGS, LONG_KEYWORDS, PAIR_SETS, REFERENCES, REFERENCE_SYMBOL,
    SINCE, TYPES, VALIDATE_FROM, ORACLES,
)
from tickerloom import schemas
from tickerloom.constants import TOP_K
from tickerloom.functions import scalars as S
from tickerloom.functions.text import html_to_text
from tickerloom.operators import joins, ranking, setops, windows
from tickerloom.operators.lineage import checkpointed
from tickerloom.plans import (
    backtest, correlation, filings as filing_plans, fundamentals, keywords, pairs as pair_plans, recommend,
    reference_data, refresh, training, weekly,
)
from tickerloom.sources import derived as D
from tickerloom.sources import landing, tables
from tickerloom.streaming import ingest

try:  # the subpackage and its pipeline are optional; anything else that is missing is an error
    from tickerloom.llm import registry as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("tickerloom.llm", "tickerloom.llm.registry", "corpus_pipeline"):
        raise
    llm = None
except ImportError as missing:
    if missing.name != "tickerloom.llm":
        raise
    llm = None


def portable(df: DataFrame) -> DataFrame:
    """Result types both engines print alike: ISO text for dates, bigint, double."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- inputs -------------------------------------------------------------------

def _weekly(spark, sf):
    # the derived prices are grouped by symbol and day
    return weekly.weekly_prices(D.prices(spark, sf), unique_times=True)


def _counts(spark, sf):
    return keywords.keyword_weekly_counts(D.filings(spark, sf), KEYWORDS)


def _starts(spark, sf):
    return weekly.month_starts(D.prices(spark, sf), REFERENCE_SYMBOL, SINCE, AS_OF)


def _scores(spark, sf, direction):
    grid = correlation.correlation_grid(
        _weekly(spark, sf), _counts(spark, sf), _starts(spark, sf), SINCE, AS_OF, LAGS, KEYWORDS, TYPES, best=(TOP_K, direction))
    return correlation.top_scores(grid, direction)


def _backfill_scores(spark, sf, direction):
    grid = correlation.backfill_grid(
        _weekly(spark, sf), _counts(spark, sf), _starts(spark, sf), SINCE, AS_OF, BACKFILL_ENDS,
        BACKFILL_LAGS, BACKFILL_KEYWORDS, best=(TOP_K, direction))
    return correlation.top_scores(grid, direction)


def _pairs(spark, sf):
    """Every symbol under each fixed keyword, type and lag."""
    sets = F.array(*[
        F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("filing_type"), F.lit(n).alias("time_delay"),
                 F.lit(s).cast("date").alias("start_date"), F.lit(e).cast("date").alias("end_date"))
        for k, t, n, s, e in PAIR_SETS
    ])
    return D.symbol_names(spark, sf).select("stock_symbol", F.inline(sets))


def _model_rows(spark, sf):
    return training.model_rows(_weekly(spark, sf), _counts(spark, sf), _pairs(spark, sf))


def _keys():
    return [*training.PAIR, "end_date"]


def _trades(spark, sf):
    w = _weekly(spark, sf)
    return backtest.backtest_trades(D.backtest_predictions(w), w)


def _curve(spark, sf):
    return backtest.backtest_curve(_trades(spark, sf))


def _income(spark, sf):
    return fundamentals.income_asof(D.prices(spark, sf), D.reports(spark, sf))


def _screen(spark, sf):
    prices, reports = D.prices(spark, sf), D.reports(spark, sf)
    return fundamentals.discount_screen(
        prices, D.symbol_names(spark, sf), D.sectors(spark, sf), fundamentals.balance_asof(prices, reports),
        fundamentals.income_asof(prices, reports), start="1996-01-01", end="2001-06-30")


def _landed(spark, sf):
    """Vendor-shaped daily rows with every row landed twice."""
    p = D.prices(spark, sf).select(
        F.col("created_at").alias("Date"), F.col("open_price").alias("Open"), F.col("close_price").alias("Close"),
        F.col("volume").alias("Volume"), F.col("stock_symbol").alias("Symbol"))
    return p.unionAll(p)


def _membership_pages(spark, sf):
    """Index membership as landed HTML tables, one per nation, built from the suppliers."""
    s = D.table(spark, sf, "supplier")
    added = F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (F.col("s_suppkey") * 13 % 1500).cast("int")), "yyyy-MM-dd")
    ended = F.when(F.col("s_suppkey") % 4 == 0, F.date_format(
        F.date_add(F.lit("2019-06-01").cast("date"), (F.col("s_suppkey") * 7 % 900).cast("int")), "yyyy-MM-dd")).otherwise("-")
    cells = [D.symbol("s_suppkey"), F.col("s_name"), F.lit("x"), F.lit("y"), F.lit("z"), added, F.lit("cik"), ended]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>\n")) for c in cells], F.lit("</tr>"))
    return s.groupBy("s_nationkey").agg(F.concat(
        F.lit("<table><tr><th>Symbol</th></tr>"), F.concat_ws("", F.sort_array(F.collect_list(row))), F.lit("</table>")
    ).alias("html"))


def _overviews(spark, sf):
    return D.sectors(spark, sf).select("stock_symbol", "sector", "peratio", "evtoebitda")


# ---- composed queries ----------------------------------------------------------

def q_weekly_prices(spark, sf):
    return _weekly(spark, sf)


def q_keyword_weekly_counts(spark, sf):
    return _counts(spark, sf)


def q_keyword_weekly_counts_long(spark, sf):
    return keywords.keyword_weekly_counts(D.filings(spark, sf), LONG_KEYWORDS)


def q_keyword_occurrences(spark, sf):
    return keywords.keyword_occurrences(D.filings(spark, sf), KEYWORDS, "1996-01-01", "2000-12-31")


def q_lagged_mentions(spark, sf):
    df = correlation.lagged_mentions(_weekly(spark, sf), _counts(spark, sf), LAGS, KEYWORDS, TYPES, SINCE, AS_OF)
    return rounded(df, 6, "mention_rate")


def q_rolling_mentions(spark, sf):
    df = correlation.rolling_mentions(_weekly(spark, sf), _counts(spark, sf), LAGS, KEYWORDS, TYPES, SINCE, AS_OF)
    return rounded(df, 6, "mention_rate", "mention_rolling_avg")


def q_topk_correlations(spark, sf):
    return _scores(spark, sf, "desc")


def q_topk_correlations_inverse(spark, sf):
    return _scores(spark, sf, "asc")


def q_topk_correlations_across(spark, sf):
    found = correlation.range_correlations(
        _weekly(spark, sf), _counts(spark, sf), LAGS, KEYWORDS, SINCE, AS_OF, TYPES, across_symbols=True)
    return correlation.top_scores(found, "both")


def q_topk_correlations_backfill(spark, sf):
    return _backfill_scores(spark, sf, "desc")


def q_month_starts(spark, sf):
    return _starts(spark, sf)


def q_week_calendar(spark, sf):
    return weekly.week_calendar(_weekly(spark, sf), "1998-01-01", AS_OF)


def _chart_args():
    symbol, start, end, keyword, lag = CHART
    return symbol, start, end, keyword, lag


def q_pair_correlation(spark, sf):
    symbol, start, end, keyword, lag = _chart_args()
    return correlation.pair_correlation(_weekly(spark, sf), _counts(spark, sf), symbol, start, end, keyword, lag)


def q_topk_keyword_correlations(spark, sf):
    _, start, end, keyword, lag = _chart_args()
    return correlation.topk_keyword_correlations(
        _weekly(spark, sf), _counts(spark, sf), keyword, start, end, lag, ["10-Q"], "desc")


def q_topk_keyword_correlations_across(spark, sf):
    _, start, end, keyword, lag = _chart_args()
    return correlation.topk_keyword_correlations(
        _weekly(spark, sf), _counts(spark, sf), keyword, start, end, lag, ["10-Q"], "asc", across_symbols=True)


def q_mention_chart(spark, sf):
    symbol, start, end, keyword, _ = _chart_args()
    return correlation.mention_chart(_weekly(spark, sf), _counts(spark, sf), symbol, start, end, keyword)


def q_mention_chart_return(spark, sf):
    return rounded(correlation.chart_return(q_mention_chart(spark, sf)), 6, "stock_return")


def q_comovement_rate(spark, sf):
    _, start, end, keyword, lag = _chart_args()
    df = correlation.comovement_rate(_weekly(spark, sf), _counts(spark, sf), start, end, keyword, lag, ["10-Q"])
    return rounded(df, 6, "comovement_rate")


def q_top_pairs(spark, sf):
    return pair_plans.top_pairs(_scores(spark, sf, "both"), AS_OF)


def q_top_pairs_by_end_date(spark, sf):
    return pair_plans.top_pairs_by_end_date(_backfill_scores(spark, sf, "both"), AS_OF)


def q_top_pairs_today(spark, sf):
    return pair_plans.top_pairs_today(q_top_pairs(spark, sf))


def q_filing_weeks(spark, sf):
    return training.filing_weeks(_weekly(spark, sf), _counts(spark, sf), _pairs(spark, sf))


def q_training_set(spark, sf):
    return rounded(training.training_set(_weekly(spark, sf), _counts(spark, sf), _pairs(spark, sf)), 6, "mention_rolling_avg")


def q_training_set_lag_26(spark, sf):
    pairs = D.symbol_names(spark, sf).select(
        "stock_symbol", F.lit("ion").alias("keyword"), F.lit("10-Q").alias("filing_type"), F.lit(26).alias("time_delay"),
        F.lit("1998-01-05").cast("date").alias("start_date"), F.lit("2001-10-29").cast("date").alias("end_date"))
    return rounded(training.training_set(_weekly(spark, sf), _counts(spark, sf), pairs), 6, "mention_rolling_avg")


def q_scoring_set(spark, sf):
    return rounded(training.scoring_set(_weekly(spark, sf), _counts(spark, sf), _pairs(spark, sf)), 6, "mention_rolling_avg")


def q_latest_features(spark, sf):
    df = training.latest_features(_weekly(spark, sf), _counts(spark, sf), D.prices(spark, sf), _pairs(spark, sf))
    return rounded(df, 6, "mention_rolling_avg")


def _late_pairs(spark, sf):
    """The pairs with end dates on any weekday, on most of which a symbol did not trade."""
    late = F.date_add("end_date", (F.substring("stock_symbol", 2, 6).cast("int") % 7))
    return _pairs(spark, sf).withColumn("end_date", late)


def q_latest_features_asof(spark, sf):
    df = training.latest_features(_weekly(spark, sf), _counts(spark, sf), D.prices(spark, sf), _late_pairs(spark, sf), asof_close=True)
    return rounded(df, 6, "mention_rolling_avg")


def _fit(spark, sf, model, digits=2):
    df = training.fit_predict(_model_rows(spark, sf), _keys(), model)
    return rounded(df, digits, "predicted_price").drop("mention_rolling_avg")


def q_fit_predict_linear(spark, sf):
    return _fit(spark, sf, "linear")


def q_fit_predict_decision_tree(spark, sf):
    return _fit(spark, sf, "decision_tree", 6)


def q_fit_predict_random_forest(spark, sf):
    return _fit(spark, sf, "random_forest", 6)


def q_holdout_error(spark, sf):
    return rounded(training.holdout_error(_model_rows(spark, sf), _keys()), 2, "mae")


def q_buy_recommendations(spark, sf):
    chosen = checkpointed(q_top_pairs(spark, sf))  # 25 rows that several branches read
    df = recommend.buy_recommendations(_weekly(spark, sf), _counts(spark, sf), D.prices(spark, sf), chosen)
    return rounded(df, 2, "predicted_weekly_close_price")


def q_buy_recommendations_all_symbols(spark, sf):
    df = recommend.buy_recommendations(
        _weekly(spark, sf), _counts(spark, sf), D.prices(spark, sf), _pairs(spark, sf))
    return rounded(df, 2, "predicted_weekly_close_price")


def q_walk_forward_validation(spark, sf):
    df = training.walk_forward(_weekly(spark, sf), _counts(spark, sf), _pairs(spark, sf), VALIDATE_FROM)
    return rounded(df, 2, "predicted_price").drop("mention_rolling_avg")


def q_prediction_accuracy(spark, sf):
    return recommend.prediction_accuracy(D.prediction_results(_weekly(spark, sf)))


def _allocation(spark, sf, this_week):
    return recommend.buy_allocation(D.recommendations(_weekly(spark, sf)), 1000, AS_OF, this_week)


def q_buy_allocation(spark, sf):
    return rounded(_allocation(spark, sf, True), 6, "predicted_growth", "predicted_weekly_close_price")


def q_last_week_returns(spark, sf):
    df = recommend.last_week_returns(_allocation(spark, sf, False), _weekly(spark, sf), 1000)
    return rounded(df, 4, "gain", "performance")


def q_buy_date(spark, sf):
    return recommend.buy_date(D.recommendations(_weekly(spark, sf)))


def q_backtest_trades(spark, sf):
    return rounded(_trades(spark, sf), 6, "predicted_price", "predicted_change")


def _log_value(curve):
    """The made-up prices compound to huge values, so the registry shows their logarithm."""
    return curve.withColumn("portfolio_log10", F.round(F.log10("portfolio_value"), 6)).drop("portfolio_value")


def q_backtest_curve(spark, sf):
    return rounded(_log_value(_curve(spark, sf)), 6, "weekly_return")


def _dated_pairs(spark, sf):
    """The pairs chosen at each end date, 25 at most; several branches read them."""
    return checkpointed(q_top_pairs_by_end_date(spark, sf))


def q_backtest_predictions(spark, sf):
    chosen = _dated_pairs(spark, sf)
    df = backtest.backtest_predictions(_weekly(spark, sf), _counts(spark, sf), chosen)
    return rounded(df, 2, "predicted_price").drop("mention_rolling_avg")


def _chain_trades(spark, sf):
    """Trades of the models' own predictions for the pairs chosen at each end date."""
    weeks = _weekly(spark, sf)
    chosen = _dated_pairs(spark, sf)
    return backtest.backtest_trades(backtest.backtest_predictions(weeks, _counts(spark, sf), chosen), weeks)


def q_backtest_chain_trades(spark, sf):
    return rounded(rounded(_chain_trades(spark, sf), 2, "predicted_price"), 4, "predicted_change")


def q_backtest_chain_curve(spark, sf):
    return rounded(rounded(backtest.backtest_curve(_chain_trades(spark, sf)), 4, "weekly_return"), 2, "portfolio_value")


def q_allocation_chain(spark, sf):
    """The models' own recommendations for all symbols, turned into a buy list."""
    df = recommend.buy_allocation(q_buy_recommendations_all_symbols(spark, sf), 1000, AS_OF)
    return rounded(df, 6, "predicted_growth", "predicted_weekly_close_price")


def _dated_predictions(spark, sf, model):
    chosen = _dated_pairs(spark, sf)
    df = backtest.backtest_predictions(_weekly(spark, sf), _counts(spark, sf), chosen, model)
    return rounded(df, 6, "predicted_price").drop("mention_rolling_avg")


def q_backtest_predictions_decision_tree(spark, sf):
    return _dated_predictions(spark, sf, "decision_tree")


def q_backtest_predictions_random_forest(spark, sf):
    return _dated_predictions(spark, sf, "random_forest")


def q_returns_vs_index(spark, sf):
    df = backtest.returns_vs_index(_curve(spark, sf), D.index_prices(spark, sf))
    return rounded(
        df.withColumn("backtest_log10", F.log10(F.col("backtest_return") + 1)).drop("backtest_return"),
        6, "index_return", "backtest_log10")


def q_curve_with_index(spark, sf):
    df = backtest.curve_with_index(_curve(spark, sf), D.index_prices(spark, sf))
    return rounded(_log_value(df), 4, "weekly_return")


def q_backtest_chain_returns_vs_index(spark, sf):
    """The models' own back-test to its end: its return beside the index."""
    df = backtest.returns_vs_index(backtest.backtest_curve(_chain_trades(spark, sf)), D.index_prices(spark, sf))
    return rounded(df, 4, "index_return", "backtest_return").withColumn("sharpe_ratio", F.round("sharpe_ratio", 2))


def q_allocation_chain_returns(spark, sf):
    """What the buy list of the models' own recommendations gained in its week."""
    recommended = recommend.buy_recommendations(_weekly(spark, sf), _counts(spark, sf), D.prices(spark, sf), _pairs(spark, sf))
    held = recommend.buy_allocation(recommended, 1000, AS_OF, False)
    return rounded(recommend.last_week_returns(held, _weekly(spark, sf), 1000), 2, "gain", "performance")


def q_buy_allocation_display(spark, sf):
    return recommend.allocation_display(_allocation(spark, sf, True))


def q_backtest_trades_display(spark, sf):
    return backtest.trades_display(_trades(spark, sf))


def q_discount_screen_display(spark, sf):
    """The screen as shown, with the unit of the column it is ordered by."""
    shown = fundamentals.screen_display(_screen(spark, sf))
    return shown.withColumn("unit", F.lit(fundamentals.unit_text("pe_change")))


def q_index_returns(spark, sf):
    df = weekly.index_returns(D.index_prices(spark, sf), "1998-01-01", "2000-12-31")
    return rounded(df, 4, "first_close", "last_close", "index_return")


def q_discount_screen(spark, sf):
    screen = _screen(spark, sf)
    return rounded(screen, 4, *[f.name for f in screen.schema.fields if isinstance(f.dataType, T.DoubleType)])


def q_discount_screen_page(spark, sf):
    rows, _ = fundamentals.screen_page(
        _screen(spark, sf), "price_change", low=-0.9, high=-0.05, groups=["Stock Data", "EPS Data"])
    return rounded(rows, 4, "price_change", "eps_change", "peak_eps", "recent_eps")


def q_quarterly_series(spark, sf):
    return fundamentals.quarterly_series(_income(spark, sf))


def q_filing_sections(spark, sf):
    return filing_plans.filing_sections(D.submissions(spark, sf))


def q_filing_records(spark, sf):
    return filing_plans.filing_records(
        D.submissions(spark, sf), D.cik_symbols(spark, sf), tables.filing_dates(D.filing_pages(spark, sf)),
        all_or_nothing=True)


def q_peak_earnings_asof(spark, sf):
    return fundamentals.earnings_asof(D.prices(spark, sf), D.reports(spark, sf))


def q_income_asof(spark, sf):
    return _income(spark, sf)


def q_balance_asof(spark, sf):
    return fundamentals.balance_asof(D.prices(spark, sf), D.reports(spark, sf))


def q_sector_records(spark, sf):
    listed = D.sectors(spark, sf).filter(F.col("universe") == "sp").select("stock_symbol")
    return reference_data.sector_records(_overviews(spark, sf), listed)


def q_index_membership_since(spark, sf):
    rows = tables.html_table_rows(_membership_pages(spark, sf), "html", min_cells=7)
    return reference_data.index_membership_since(rows)


def q_daily_prices_ingest(spark, sf):
    return weekly.daily_prices_ingest(_landed(spark, sf))


def q_latest_volume(spark, sf):
    return weekly.latest_volume(_landed(spark, sf))


def q_sector_list(spark, sf):
    return reference_data.sector_list(D.sectors(spark, sf))


def q_symbol_names(spark, sf):
    return reference_data.symbol_names(D.prices(spark, sf), D.symbol_names(spark, sf))


def q_recent_closes(spark, sf):
    return weekly.recent_closes(D.prices(spark, sf), REFERENCE_SYMBOL, "1998-01-01", AS_OF)


# ---- landed files: written from the given tables, read, and split into rows and rejects ----

def _landed_prices(spark, sf):
    return tables.read_csv_checked(spark, landing.prices_csv(spark, sf), schemas.LANDED_PRICES)


def q_landed_prices(spark, sf):
    return weekly.daily_prices_ingest(_landed_prices(spark, sf)[0])


def q_landed_prices_rejects(spark, sf):
    rejects = _landed_prices(spark, sf)[1]
    return rejects.select("Symbol", "Date", "reason")


def _landed_income(spark, sf):
    return tables.read_reports_checked(spark, landing.income_json(spark, sf), schemas.INCOME_FILE, "quarterlyReports")


def q_landed_income_reports(spark, sf):
    return _landed_income(spark, sf)[0]


def q_landed_income_rejects(spark, sf):
    rejects = _landed_income(spark, sf)[1]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("file").isNotNull() & F.col("record").isNotNull()).alias("kept_texts"))


def _landed_ciks(spark, sf):
    return tables.read_symbol_ciks_checked(spark, landing.cik_json(spark, sf))


def q_landed_symbol_ciks(spark, sf):
    return _landed_ciks(spark, sf)[0]


def q_landed_symbol_ciks_rejects(spark, sf):
    return _landed_ciks(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def q_append_twice(spark, sf):
    """Weekly prices appended by week, twice: the second run replaces its own weeks; an empty one writes nothing."""
    path, weeks = landing.place(spark, "weekly"), _weekly(spark, sf)
    for rows in (weeks, weeks, weeks.limit(0)):
        tables.append_if_any(rows, path, "week_opening_date")
    return spark.read.schema(weeks.schema).parquet(path)


def q_replace_table(spark, sf):
    """Sectors, then names, written to one place: the second table stands alone."""
    path, names = landing.place(spark, "names"), D.symbol_names(spark, sf)
    tables.replace(D.sectors(spark, sf), path)
    tables.replace(names, path)
    return spark.read.parquet(path)


def _nights(df, day):
    """The rows as they land: history, then two batches with rows that are late by a month, then the second batch again."""
    at = F.col(day)
    late = (at >= "2000-12-01") & (at < "2001-01-01") & (F.dayofmonth(at) % 5 == 0)
    second = late | ((at >= "2001-01-01") & (at < "2001-07-01"))
    return [df.filter((at < "2001-01-01") & ~late), df.filter(second), df.filter(at >= "2001-07-01"), df.filter(second)]


def q_refresh_weekly_prices(spark, sf):
    prices = D.prices(spark, sf)
    store, weeks = landing.place(spark, "prices"), landing.place(spark, "weekly-prices")
    for night in _nights(prices, "created_at"):
        refresh.refresh_weekly_prices(night, store, weeks)
    return spark.read.schema(weekly.weekly_prices(prices).schema).parquet(weeks)


def q_refresh_keyword_counts(spark, sf):
    filed = D.filings(spark, sf)
    store, counts = landing.place(spark, "filings"), landing.place(spark, "keyword-counts")
    for night in _nights(filed, "filing_date"):
        refresh.refresh_keyword_counts(night, store, counts, KEYWORDS)
    return spark.read.schema(_counts(spark, sf).schema).parquet(counts)


# ---- primitives with semantics of their own --------------------------------------

def q_lag_join(spark, sf):
    w = _weekly(spark, sf).select("week_opening_date", "stock_symbol", "week_close_price")
    c = _counts(spark, sf).select("filing_week", "keyword", "filing_type", "keyword_mentions")
    return joins.lag_join(w, c, "week_opening_date", "filing_week", LAGS)


def q_shifted_self_join(spark, sf):
    w = _weekly(spark, sf).select("stock_symbol", "week_opening_date", "week_close_price")
    return joins.shifted_self_join(w, ["stock_symbol"], "week_opening_date", 4, {"week_close_price": "later_close"})


def q_interpolate(spark, sf):
    gaps = (F.weekofyear("week_opening_date") % 3) != 0
    w = _weekly(spark, sf).select(
        "stock_symbol", "week_opening_date", F.when(gaps, F.col("week_close_price")).alias("value"))
    return rounded(windows.interpolate_linear(w, ["stock_symbol"], ["week_opening_date"], ["value"]), 4, "value")


def q_rolling_across_symbols(spark, sf):
    df = correlation.rolling_mentions(_weekly(spark, sf), _counts(spark, sf), LAGS, KEYWORDS, TYPES, SINCE, AS_OF, across_symbols=True)
    out = df.select("keyword", "filing_type", "time_delay", "stock_symbol", "week_opening_date", "week_close_price", "mention_rate",
                    F.col("mention_rolling_avg").alias("rolling"))
    return rounded(out, 6, "mention_rate", "rolling")


def q_lag_rows(spark, sf):
    return windows.lag_rows(
        _weekly(spark, sf).select("stock_symbol", "week_opening_date"), ["stock_symbol"],
        ["week_opening_date"], "week_opening_date", 2, "earlier_week")


def q_week_lead(spark, sf):
    return windows.calendar_next(weekly.week_calendar(_weekly(spark, sf)), "week_opening_date", "next_week")


def q_asof_forward(spark, sf):
    peaks = fundamentals.price_peaks(D.prices(spark, sf)).select("universe", "stock_symbol", "peak_date")
    return joins.asof_forward(
        peaks, D.reports(spark, sf), ["universe", "stock_symbol"], "peak_date", "fiscal_date", ["total_assets"])


def q_asof_next_report(spark, sf):
    """Every daily close with the first report after its day."""
    return joins.asof_merge(
        _daily_closes(spark, sf), D.reports(spark, sf), ["universe", "stock_symbol"], "created_at", "fiscal_date", ["total_assets", "ebitda"])


def q_asof_last_report(spark, sf):
    """Every daily close with the last report up to its day."""
    return joins.asof_merge(
        _daily_closes(spark, sf), D.reports(spark, sf), ["universe", "stock_symbol"], "created_at", "fiscal_date", ["total_assets"],
        direction="backward", strict=False)


def _daily_closes(spark, sf):
    return D.prices(spark, sf).select("universe", "stock_symbol", "created_at", "close_price")


def q_price_peaks(spark, sf):
    return fundamentals.price_peaks(D.prices(spark, sf))


def q_distinct_on(spark, sf):
    return ranking.best_per_key(
        D.prices(spark, sf).select("stock_symbol", "created_at", "volume"), ["stock_symbol"], "volume", True, ["created_at"])


def q_json_each(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def q_union_universes(spark, sf):
    p = D.prices(spark, sf).select("universe", "stock_symbol", "created_at", "close_price")
    return setops.union_universes(
        sp=p.filter(F.col("universe") == "sp").drop("universe"),
        russell=p.filter(F.col("universe") == "russell").drop("universe"))


def q_anti_universe(spark, sf):
    listed = D.sectors(spark, sf).filter(F.col("universe") == "sp")
    return joins.not_in(D.symbol_names(spark, sf), listed, "stock_symbol")


def q_format_money(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", S.dollar_text("o_totalprice").alias("dollars"),
        S.dollar_text(F.col("o_totalprice"), 0).alias("whole_dollars"),
        S.plain_dollar_text("o_totalprice").alias("plain"),
        S.percent_text(S.ratio(F.col("o_totalprice"), F.lit(500000)), 1).alias("share"))


def q_date_alignment(spark, sf):
    day = F.to_date("o_orderdate")
    return D.table(spark, sf, "orders").select(
        "o_orderkey", S.week_of(day).alias("week"), S.month_of(day).alias("month"),
        S.same_or_next_monday(day).alias("next_monday"), S.same_or_previous_friday(day).alias("previous_friday"),
        S.packed_date(day).alias("packed"), S.iso_date(day).alias("iso"))


def q_html_to_text(spark, sf):
    pages = D.table(spark, sf, "pages").withColumn("html", F.concat("html", F.lit(REFERENCES)))
    return pages.select("page_id", html_to_text("html").alias("text"))


def q_filing_dates(spark, sf):
    return tables.filing_dates(D.filing_pages(spark, sf))


def q_snapshot_on_tuesday(spark, sf):
    df = tables.snapshot_on(q_sector_list(spark, sf), "2001-10-30")
    return df.unionByName(tables.snapshot_on(q_sector_list(spark, sf), "2001-10-31"))


def q_series_range(spark, sf):
    low, high = S.padded_range("week_close_price")
    return rounded(_weekly(spark, sf).groupBy("stock_symbol").agg(
        low.alias("low"), high.alias("high")), 4, "low", "high")


def q_symbol_ciks(spark, sf):
    """Leading zeros stripped, symbols looked up, 'unknown' where none is listed."""
    paths = D.submissions(spark, sf).select("path")
    return filing_plans.filing_paths(paths, D.cik_symbols(spark, sf))


def q_event_weeks(spark, sf):
    """Weekly first and last value per user, as the streaming form computes it."""
    return rounded(ingest.weekly_first_last(D.table(spark, sf, "events"), "user_id", "ts", "value"), 6, "first_value", "last_value")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: strongest correlations per keyword, lag, type and start month."""
    return portable(q_topk_correlations(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}

    def wrap(fn):
        return lambda spark, sf: portable(fn(spark, sf))

    return {name: wrap(fn) for name, fn in found.items()} | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    own = {name: sql for name, sql in ORACLES.items() if f"q_{name}" in globals()}
    return own | (llm.oracle_sql() if llm else {})
