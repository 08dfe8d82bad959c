"""Weekly buy lists: predictions for the strongest pairs, allocation, and last week's outcome."""

from pyspark.sql import functions as F

from ..constants import BUY_BLACKLIST, BUY_EXCLUDED_KEYWORD, MIN_GROWTH, RECENT_DAYS
from ..functions.scalars import change, dollar_text, half_even, percent_text, ratio, weeks_after
from ..operators.filters import all_of, none_of, within_last_days
from .training import PAIR, TARGET, fit_predict, latest_features, model_rows


def buy_recommendations(weekly, counts, prices, pairs, model_type="linear", opposite_type=False,
                        asof_close=False):
    """For each pair: train up to its last usable filing week, predict from the latest features.

    A pair without a model or without latest features keeps its row with a NULL prediction and a
    ``status``: too_few_rows, no_filing_week, or no_latest_close.
    """
    keys = [*PAIR, "end_date"]
    pairs = pairs.select(*keys)
    rows = model_rows(weekly, counts, pairs)
    latest = latest_features(weekly, counts, prices, pairs, opposite_type, asof_close)
    asked = latest.withColumn(TARGET, F.lit(None).cast("double")).withColumn("part", F.lit("latest"))
    both = rows.unionByName(asked)
    scored = fit_predict(both, keys, model_type, ask="latest")
    last = rows.filter(F.col("part") == "score").select(
        *keys, weeks_after("week_opening_date", "time_delay").alias("previous_weekly_open_date"),
        F.col(TARGET).alias("previous_weekly_close_price"))
    # one aggregation brings a pair's parts together: the pair itself, its last week, its prediction
    none = F.lit(None)
    parts = [
        pairs.select(*keys, none.cast("date").alias("_open"), none.cast("double").alias("_close"), none.cast("double").alias("_guess"), none.cast("string").alias("_status")),
        last.select(*keys, "previous_weekly_open_date", "previous_weekly_close_price", none.cast("double"), none.cast("string")),
        scored.select(*keys, none.cast("date"), none.cast("double"), "predicted_price", "status"),
    ]
    met = parts[0].union(parts[1]).union(parts[2]).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_open", "_close", "_guess", "_status")])
    status = F.when(F.col("_open").isNull(), "no_filing_week").when(F.col("_status").isNull(), "no_latest_close").otherwise(F.col("_status"))
    return met.select(
        F.col("_open").alias("previous_weekly_open_date"), F.col("_close").alias("previous_weekly_close_price"),
        F.when(status == "ok", F.col("_guess")).alias("predicted_weekly_close_price"),
        "stock_symbol", "keyword", "start_date", "time_delay", "filing_type", status.alias("status"),
    )


def buy_allocation(recommendations, principal, as_of, this_week=True):
    """Shares to buy: the principal split in proportion to predicted growth above 5 %."""
    growth = change("predicted_weekly_close_price", "previous_weekly_close_price")
    kept = all_of(
        recommendations.withColumn("predicted_growth", growth),
        F.col("predicted_weekly_close_price") > F.col("previous_weekly_close_price"),
        within_last_days("previous_weekly_open_date", as_of, RECENT_DAYS),
        F.col("keyword") != BUY_EXCLUDED_KEYWORD,
        none_of("stock_symbol", BUY_BLACKLIST),
        F.col("predicted_growth") > MIN_GROWTH,
    )
    totals = kept.groupBy("previous_weekly_open_date").agg(F.sum("predicted_growth").alias("_total"))
    share = ratio("predicted_growth", "_total")
    opened = F.col("previous_weekly_open_date")
    return kept.join(totals, "previous_weekly_open_date").select(
        (weeks_after(opened, 1) if this_week else opened).alias("buy_date"),
        "stock_symbol", "keyword", "previous_weekly_close_price", "predicted_weekly_close_price",
        "predicted_growth",
        half_even(F.try_divide(F.lit(float(principal)) * share, F.col("previous_weekly_close_price")), 2)
        .alias("number_of_shares_to_purchase"),
        F.lit(float(principal)).alias("principal_amount"),
    )


def allocation_display(allocation):
    """The buy list as shown: dollar and percent text."""
    return allocation.select(
        "buy_date", "stock_symbol", "keyword",
        dollar_text("previous_weekly_close_price").alias("previous_weekly_close_price"),
        dollar_text("predicted_weekly_close_price").alias("predicted_weekly_close_price"),
        percent_text("predicted_growth").alias("predicted_growth"),
        "number_of_shares_to_purchase",
        dollar_text("principal_amount").alias("principal_amount"),
    )


def last_week_returns(allocation, weekly, principal):
    """Gain of the allocation over its own week, in money and as a share of the principal."""
    held = allocation.select("stock_symbol", F.col("buy_date").alias("week_opening_date"), "number_of_shares_to_purchase")
    gain = F.col("number_of_shares_to_purchase") * (F.col("week_close_price") - F.col("week_open_price"))
    return weekly.join(held, ["stock_symbol", "week_opening_date"]).agg(
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("gain")
    ).withColumn("performance", ratio(F.col("gain"), F.lit(float(principal))))


def buy_date(recommendations):
    return recommendations.agg(weeks_after(F.max("previous_weekly_open_date"), 1).alias("buy_date"))


def prediction_accuracy(results):
    """Actual against predicted movement of each prediction."""
    up, down, same, none = "price increased", "price decreased", "price the same", "no price comparison"
    now, later, guess = F.col("current_close_price"), F.col("next_week_close_price"), F.col("predicted_price")
    actual = F.when(later > now, up).when(later < now, down).when(later.isNull(), none).otherwise(same)
    expected = F.when(now < guess, up).when(now > guess, down).when(guess.isNull(), none).otherwise(same)
    moved, expected_move = later - now, guess - now
    validation = (
        F.when(actual == none, none).when(actual == expected, "correct prediction").otherwise("incorrect prediction")
    )
    carried = [c for c in ("stock_symbol",) if c in results.columns]
    return results.select(
        *carried, F.col("week_opening_date").alias("prediction_date"),
        half_even(moved, 2).alias("actual_price_change"),
        half_even(expected_move, 2).alias("predicted_price_change"),
        validation.alias("prediction_validation"),
        half_even(F.when(moved != 0, F.try_divide(moved - expected_move, now)), 4)
        .alias("actual_prediction_percentage_delta"),
    )

