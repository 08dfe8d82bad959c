"""Back-test of the predictions: trades, compounded curve, comparison with an index."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import BACKTEST_TOP, RISK_FREE_RATE, SLIPPAGE, START_CASH, WEEKS_PER_YEAR
from ..functions.scalars import (
    change, half_even, percent_text, plain_dollar_text, same_or_next_monday, same_or_previous_friday,
)
from ..operators.ranking import top_k_per_group
from ..operators.windows import calendar_next
from .training import PAIR, TARGET, fit_predict, model_rows
from .weekly import week_calendar


def backtest_predictions(weekly, counts, pairs, model_type="linear"):
    """Prediction of the week n ahead for every pair, trained on weeks before its end date.

    Start dates move to a Monday; the end date is a Monday already and its Friday is added. A pair
    that cannot be fitted keeps its row, with a NULL prediction and its ``status``.
    """
    keys = [*PAIR, "end_date"]
    aligned = pairs.select(*keys).withColumn("start_date", same_or_next_monday("start_date")).dropDuplicates(keys)
    scored = fit_predict(model_rows(weekly, counts, aligned, cutoff="end_date"), keys, model_type)
    return scored.select(
        F.lit(model_type).alias("model_type"), "current_week", "prediction_date", "week_opening_date",
        "mention_rolling_avg", "current_close_price", F.col(TARGET).alias("next_week_close_price"),
        "predicted_price", "stock_symbol", "keyword", "start_date",
        same_or_previous_friday("end_date").alias("friday_end_date"),
        F.col("end_date").alias("monday_end_date"), "time_delay", "filing_type", "status",
    )


def backtest_trades(predictions, weekly):
    """Each prediction with the open and close of the following calendar week."""
    following = calendar_next(week_calendar(weekly), "week_opening_date", "week_to_buy").filter(
        F.col("week_to_buy").isNotNull())
    prices = weekly.select(
        "stock_symbol", F.col("week_opening_date").alias("week_to_buy"),
        F.col("week_open_price").alias("buy_open_price"), F.col("week_close_price").alias("buy_close_price"),
    )
    return (
        predictions.filter(F.col("predicted_price").isNotNull()).join(following.withColumnRenamed("week_opening_date", "monday_end_date"), "monday_end_date")
        .join(prices, ["stock_symbol", "week_to_buy"])
        .select(
            "model_type", "week_to_buy", "stock_symbol", "keyword", "time_delay", "filing_type",
            "current_close_price", "predicted_price",
            change("predicted_price", "current_close_price").alias("predicted_change"),
            F.when(F.col("current_close_price") < F.col("predicted_price"), "buy recommended")
            .otherwise("dont buy").alias("recommendation"),
            "buy_open_price", "buy_close_price",
        )
    )


def trades_display(trades):
    return trades.select(
        "week_to_buy", "stock_symbol", "keyword", plain_dollar_text("current_close_price").alias("close_price"),
        plain_dollar_text("predicted_price").alias("predicted_price"),
        percent_text("predicted_change").alias("predicted_change"), "recommendation",
        plain_dollar_text("buy_open_price").alias("purchase_price"),
        plain_dollar_text("buy_close_price").alias("sale_price"),
    )


def weekly_returns(trades, top=BACKTEST_TOP):
    """Return of each week's five best recommendations, weighted by predicted change.

    A week whose trades recommend nothing returns 0.
    """
    bought = top_k_per_group(
        trades.filter(F.col("recommendation") == "buy recommended"),
        ["model_type", "week_to_buy"], "predicted_change", top, True,
        ["stock_symbol", "keyword", "filing_type", "time_delay"],
    )
    gain = F.col("predicted_change") * F.try_divide(
        (F.col("buy_close_price") - SLIPPAGE) - (F.col("buy_open_price") + SLIPPAGE), F.col("buy_open_price") + SLIPPAGE)
    earned = bought.groupBy("model_type", "week_to_buy").agg(
        F.try_divide(F.sum(gain), F.sum("predicted_change")).alias("_r"))
    weeks = trades.select("model_type", "week_to_buy").distinct()
    return weeks.join(earned, ["model_type", "week_to_buy"], "left").select(
        "model_type", F.col("week_to_buy").alias("week_of_purchases"),
        F.coalesce("_r", F.lit(0.0)).alias("weekly_return"))


def backtest_curve(trades, start_cash=START_CASH, top=BACKTEST_TOP):
    """Compounded portfolio value after each week; one row per week and model by now."""
    so_far = Window.partitionBy("model_type").orderBy("week_of_purchases")
    history = F.collect_list("weekly_return").over(so_far)
    value = F.aggregate(history, F.lit(float(start_cash)), lambda cash, r: cash * (1 + r))
    return weekly_returns(trades, top).withColumn("portfolio_value", value)


def curve_with_index(curve, index):
    """Curve rows whose week has an index close."""
    closes = index.select(F.col("created_at").alias("week_of_purchases"), F.col("close_price").alias("index_price"))
    return curve.join(closes, "week_of_purchases")


def returns_vs_index(curve, index, risk_free=RISK_FREE_RATE):
    """Index and portfolio return over the curve's dates, and the annualised Sharpe ratio.

    The portfolio's return starts from its value after the first week.
    """
    order = Window.partitionBy("model_type").orderBy("week_of_purchases")
    log_return = F.ln(F.try_divide(F.col("portfolio_value"), F.lag("portfolio_value").over(order)))
    weeks = curve.withColumn("_log", log_return)
    # one row per model and calendar day keeps this an equi-join
    days = curve.groupBy("model_type").agg(
        F.min("week_of_purchases").alias("first_week"), F.max("week_of_purchases").alias("last_week")).select("model_type", F.explode(F.sequence("first_week", "last_week")).alias("created_at"))
    dated = index.join(days, "created_at")
    none = F.lit(None)
    # both series meet in one aggregation by model
    both = weeks.select("model_type", "week_of_purchases", "portfolio_value", "_log", none.cast("date").alias("created_at"),
                        none.cast("double").alias("close_price")).union(
        dated.select("model_type", none.cast("date"), none.cast("double"), none.cast("double"), "created_at", "close_price"))
    own = both.groupBy("model_type").agg(
        F.min("week_of_purchases").alias("first_week"), F.max("week_of_purchases").alias("last_week"),
        F.min_by("portfolio_value", "week_of_purchases").alias("_first"),
        F.max_by("portfolio_value", "week_of_purchases").alias("_last"),
        F.avg("_log").alias("_mean"), F.stddev_samp("_log").alias("_std"),
        F.min_by("close_price", "created_at").alias("_index_first"),
        F.max_by("close_price", "created_at").alias("_index_last"), F.max("created_at").alias("_dated"),
    ).filter(F.col("_dated").isNotNull())
    sharpe = F.try_divide(
        F.col("_mean") * WEEKS_PER_YEAR - risk_free, F.col("_std") * F.sqrt(F.lit(float(WEEKS_PER_YEAR))))
    return own.select(
        "model_type", "first_week", "last_week",
        change("_index_last", "_index_first").alias("index_return"),
        change("_last", "_first").alias("backtest_return"),
        half_even(sharpe, 3).alias("sharpe_ratio"),
    )
