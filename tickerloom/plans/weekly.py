"""Weekly price series, calendars, daily ingest."""

from pyspark.sql import functions as F

from ..functions.scalars import change, month_of, week_of
from ..operators.filters import all_of, dates_within, equals
from ..operators.ranking import top_k


def weekly_prices(prices, unique_times=False):
    """First open and last close per symbol and Monday week; equal times are settled by price.

    Partial aggregation runs before the shuffle, so a symbol holding a large share of
    the rows still arrives as one row per week and task. ``unique_times`` declares at
    most one row per symbol and time, which allows hash instead of sort aggregation.
    """
    grouped = prices.groupBy("stock_symbol", week_of("created_at").alias("week_opening_date"))
    if unique_times:
        return grouped.agg(
            F.min_by("open_price", "created_at").alias("week_open_price"),
            F.max_by("close_price", "created_at").alias("week_close_price"),
        )
    return grouped.agg(
        F.min(F.struct("created_at", "open_price")).getField("open_price").alias("week_open_price"),
        F.max(F.struct("created_at", "close_price")).getField("close_price").alias("week_close_price"),
    )


def week_calendar(weekly, start=None, end=None):
    return all_of(weekly, dates_within("week_opening_date", start, end)).select("week_opening_date").distinct()


def month_starts(prices, reference_symbol, start=None, end=None):
    """Months in which the reference symbol traded, as their first days."""
    months = prices.filter(F.col("stock_symbol") == reference_symbol).select(
        month_of("created_at").alias("start_date")
    )
    return all_of(months, dates_within("start_date", start, end)).distinct()


def daily_prices_ingest(landed):
    """Landed vendor rows to the price table's columns, without repeated rows."""
    return landed.select(
        F.col("Date").alias("created_at"), F.col("Open").alias("open_price"),
        F.col("Close").alias("close_price"), F.col("Symbol").alias("stock_symbol"),
    ).dropDuplicates()


def latest_volume(landed):
    return landed.select(
        F.col("Symbol").alias("stock_symbol"), F.col("Volume").cast("bigint").alias("yesterday_trading_volume")
    ).dropDuplicates()


def recent_closes(prices, stock_symbol, start=None, end=None, limit=30):
    rows = all_of(prices, equals("stock_symbol", stock_symbol), dates_within("created_at", start, end))
    picked = rows.select("stock_symbol", "close_price", F.col("created_at").alias("close_date"))
    return top_k(picked, "close_date", limit)


def index_returns(index, start=None, end=None):
    """Return from the first to the last close in a date range."""
    rows = all_of(index, dates_within("created_at", start, end))
    return rows.agg(
        F.min_by("close_price", "created_at").alias("first_close"),
        F.max_by("close_price", "created_at").alias("last_close"),
    ).withColumn("index_return", change("last_close", "first_close"))
