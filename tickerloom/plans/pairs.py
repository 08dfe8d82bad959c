"""Selection of the strongest symbol / keyword pairs from the score tables."""

from pyspark.sql import functions as F

from ..constants import (
    BACKTEST_BLACKLIST, BACKTEST_END_MARGIN_DAYS, EXCLUDED_KEYWORD, EXCLUDED_LAG,
    MIN_HISTORY_DAYS, PAIR_BLACKLIST, PAIR_COUNT, POOL_SIZE,
)
from ..functions.scalars import percent_text
from ..operators.filters import all_of, at_least_days_before, none_of
from ..operators.ranking import best_per_key, top_k, top_k_per_group

#: Settles equal correlations, which four-digit rounding makes common.
TIES = ["stock_symbol", "keyword", "filing_type", "time_delay", "start_date"]


def _eligible(scores, as_of, blacklist, perfect):
    return all_of(
        scores,
        F.col("correlation").isNotNull(),
        at_least_days_before("start_date", as_of, MIN_HISTORY_DAYS),
        none_of("stock_symbol", blacklist),
        perfect,
        F.col("keyword") != EXCLUDED_KEYWORD,
        F.col("time_delay") != EXCLUDED_LAG,
    ).withColumn("abs_corr", F.abs("correlation"))


def _pools(rows, groups, pool):
    """The most direct and the most inverse scores of each group; one ranking of signed scores, so the scores are computed once."""
    known = rows.filter(F.col("direction").isin("direct", "inverse"))
    signed = known.withColumn("_strength", F.when(F.col("direction") == "direct", F.col("correlation")).otherwise(-F.col("correlation")))
    return top_k_per_group(signed, [*groups, "direction"], "_strength", pool, True, TIES).drop("_strength")


def top_pairs(scores, as_of, pool=POOL_SIZE, count=PAIR_COUNT):
    """Best pair per symbol out of the 250 most direct and 250 most inverse scores; strongest 25."""
    rows = _eligible(scores, as_of, PAIR_BLACKLIST, F.abs("correlation") != 1)
    best = best_per_key(_pools(rows, [], pool), ["stock_symbol"], "abs_corr", True, [*TIES, "direction"])
    return top_k(best, "abs_corr", count, True, TIES).drop("abs_corr")


def top_pairs_by_end_date(scores, as_of, pool=POOL_SIZE, count=PAIR_COUNT):
    """:func:`top_pairs` within every end date at least two weeks old."""
    rows = _eligible(scores, as_of, BACKTEST_BLACKLIST, F.col("correlation") != 1).filter(
        F.col("end_date") <= F.date_sub(F.to_date(F.lit(str(as_of))), BACKTEST_END_MARGIN_DAYS))
    best = best_per_key(_pools(rows, ["end_date"], pool), ["end_date", "stock_symbol"], "abs_corr", True, [*TIES, "direction"])
    return top_k_per_group(best, ["end_date"], "abs_corr", count, True, TIES).drop("abs_corr")


def top_pairs_today(pairs):
    """Presentation snapshot: the correlation as percent text."""
    return pairs.withColumn("correlation", percent_text("correlation", 2))
