"""Training, scoring and latest-feature rows for any set of pairs, and the models on them.

A pair is (stock_symbol, keyword, filing_type, time_delay, start_date[, end_date]); all
pairs are handled in one plan. A pair's rows are bounded by the calendar.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import SPLIT_SEED, TRAINING_WARMUP
from ..functions.scalars import mean_absolute_error, packed_date, weeks_after
from ..operators.joins import asof_merge
from ..operators.pairrows import latest_series, model_series, pair_series
from ..operators.regression import fitted, fitted_so_far, predicted
from ..operators.trees import predict_with_trees
from ..operators.windows import trailing_mean
from .keywords import mention_rates

PAIR = ["stock_symbol", "keyword", "filing_type", "time_delay", "start_date"]
FEATURES = ["current_week", "mention_rolling_avg", "current_close_price"]
TARGET = "target_close_price"
MODELS = ("linear", "decision_tree", "random_forest")


def _pair_keys(pairs):
    return [*PAIR, "end_date"] if "end_date" in pairs.columns else list(PAIR)


def pair_weeks(weekly, counts, pairs, since="start_date"):
    """Weeks of each pair with close, same-week rolling rate and the close n weeks later.

    Weeks without filings of the pair's type do not count as rows; the later close must
    itself be such a row. ``since`` is the column (or date) where the rolling starts; None is no bound.
    """
    keys = _pair_keys(pairs)
    begin = F.lit(None).cast("date") if since is None else F.col(since) if since in pairs.columns else F.to_date(F.lit(str(since)))
    made = pair_series(_closes(weekly), mention_rates(counts), pairs, keys, begin)
    return made.select(*keys, "week_opening_date", *_features(made))


def _closes(weekly):
    return weekly.select("stock_symbol", "week_opening_date", "week_close_price")


def _features(made):
    return [packed_date("week_opening_date").alias("current_week"), made["mean"].alias("mention_rolling_avg"),
            made["close"].alias("current_close_price"), made["later_close"].alias(TARGET)]


def filing_weeks(weekly, counts, pairs, history_start=None):
    """Weeks from the pair's start that have both a feature row and a row n weeks later.

    The rolling rate begins with all history, or at ``history_start``.
    """
    weeks = pair_weeks(weekly, counts, pairs, history_start)
    return (
        weeks.filter(F.col(TARGET).isNotNull() & (F.col("week_opening_date") >= F.col("start_date")))
        .select(*_pair_keys(pairs), F.col("week_opening_date").alias("filing_week"))
    )


def split_hash(keys, week="week_opening_date", seed=SPLIT_SEED):
    """Order of rows for the hold-out split: stable, the same on any partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col(week).cast("string"), F.lit(str(seed))))


def model_rows(weekly, counts, pairs, cutoff=None):
    """All rows a pair's model needs, with ``part`` = train, test (10 %, rounded up) or score.

    Training rows lie before the cutoff, without the pair's first three; the score row is
    the cutoff week itself. The cutoff is a date column of ``pairs``, or by default the
    pair's last week that has a close n weeks later. A pair's rows are made in the task that
    holds its symbol's closes.
    """
    keys = _pair_keys(pairs)
    prefix = F.concat_ws("|", *[F.col(k).cast("string") for k in PAIR])
    made = model_series(_closes(weekly), mention_rates(counts), pairs, keys, F.col("start_date"), cutoff and F.col(cutoff), prefix,
                        TRAINING_WARMUP, SPLIT_SEED)
    return made.select(*keys, "week_opening_date", *_features(made), "part")


def training_set(weekly, counts, pairs, cutoff=None):
    return model_rows(weekly, counts, pairs, cutoff).filter(F.col("part") != "score")


def scoring_set(weekly, counts, pairs, cutoff=None):
    """The row at the cutoff, with the later week and close it can be checked against."""
    rows = model_rows(weekly, counts, pairs, cutoff).filter(F.col("part") == "score")
    return rows.withColumn("prediction_date", weeks_after("week_opening_date", "time_delay")).drop("part")


def latest_features(weekly, counts, prices, pairs, opposite_type=False, asof_close=False):
    """Last lagged rolling rate up to the pair's end date, with the close of that very day.

    ``opposite_type`` uses the other filing type's counts for the rate. With ``asof_close`` the close is the
    last one up to the end date, so that a pair whose symbol did not trade on that day keeps its row.
    """
    keys = [*PAIR, "end_date"]
    if opposite_type:
        last = _last_of_other_types(weekly, counts, pairs, keys)
    else:
        last = latest_series(_closes(weekly), mention_rates(counts), pairs, keys, F.col("start_date"), F.col("end_date")).select(
            *keys, F.struct("week_opening_date", F.col("mean").alias("mention_rolling_avg")).alias("_last"))
    if asof_close:
        dated = asof_merge(last, prices.select("stock_symbol", "created_at", "close_price"), "stock_symbol", "end_date", "created_at",
                           ["close_price"], direction="backward", strict=False)
        dated = dated.withColumnRenamed("last_close_price", "close_price").filter(F.col("close_price").isNotNull())
    else:
        dated = last.join(prices.select("stock_symbol", F.col("created_at").alias("end_date"), "close_price"), ["stock_symbol", "end_date"])
    return dated.select(
        *keys, F.col("_last.week_opening_date").alias("week_opening_date"),
        packed_date("_last.week_opening_date").alias("current_week"),
        F.col("_last.mention_rolling_avg").alias("mention_rolling_avg"),
        F.col("close_price").alias("current_close_price"),
    )


def _last_of_other_types(weekly, counts, pairs, keys):
    """Last week and rolling rate of each pair by the filings of the other types."""
    rates = mention_rates(counts).withColumnsRenamed({"filing_type": "_type"})
    rows = (
        pairs.select(*keys)
        .join(weekly.select("stock_symbol", "week_opening_date"), "stock_symbol")
        .filter(F.col("week_opening_date").between(F.col("start_date"), F.col("end_date")))
        .withColumn("filing_week", weeks_after("week_opening_date", -F.col("time_delay")))
        .join(rates, ["filing_week", "keyword"]).filter(F.col("_type") != F.col("filing_type"))
    )
    rolled = trailing_mean(rows, keys, ["week_opening_date"], "mention_rate", "mention_rolling_avg")
    return rolled.groupBy(*keys).agg(F.max(F.struct("week_opening_date", "mention_rolling_avg")).alias("_last"))


# ---- models ------------------------------------------------------------------

def fit_predict(rows, keys, model_type="linear", ask="score"):
    """Fit every pair on its training rows and predict its rows in part ``ask``.

    ``rows`` come from :func:`model_rows`. Pairs that cannot be fitted keep their row
    with a NULL prediction and a ``status``.
    """
    if model_type not in MODELS:
        raise ValueError(f"model_type must be one of {MODELS}")
    kept = ["week_opening_date", *FEATURES, TARGET]
    if model_type == "linear":
        scored = (
            fitted(rows, keys, FEATURES, TARGET, F.col("part") == "train", F.col("part") == ask)
            .withColumn("predicted_price", predicted(FEATURES))
        )
    else:
        scored = predict_with_trees(
            rows.filter(F.col("part").isin("train", ask)), keys, FEATURES, TARGET, model_type, kept
        ).withColumn("status", F.when(F.col("predicted_price").isNull(), "too_few_rows").otherwise("ok"))
    return scored.select(
        *keys, *kept, weeks_after("week_opening_date", "time_delay").alias("prediction_date"),
        "predicted_price", "status",
    )


def holdout_error(rows, keys, model_type="linear"):
    """Mean absolute error on the held-out rows, per pair."""
    scored = fit_predict(rows, keys, model_type, ask="test")
    return scored.filter(F.col("predicted_price").isNotNull()).groupBy(*keys).agg(
        mean_absolute_error(TARGET, "predicted_price").alias("mae"), F.count(F.lit(1)).alias("n_test"))


def walk_forward(weekly, counts, pairs, validate_from, model_type="linear"):
    """Expanding-window validation: each week from ``validate_from`` is predicted by a model
    of all usable earlier weeks.

    One growing window per pair supplies the running moments, so the work grows with the
    weeks. Hold-out here goes by each row's own hash (one in ten), which is what lets a
    row keep its role in every window.
    """
    if model_type != "linear":
        raise ValueError("walk_forward supports the linear model")
    keys = _pair_keys(pairs)
    weeks = pair_weeks(weekly, counts, pairs).filter(F.col(TARGET).isNotNull())
    order = Window.partitionBy(*keys).orderBy("week_opening_date")
    held = F.conv(F.substring(split_hash(PAIR), 1, 4), 16, 10).cast("int") % 10 == 0
    # a given number of shares: rows of pairs compress so well that the optimizer would join too many
    weeks = weeks.repartition(int(weeks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = weeks.withColumn("_use", (F.row_number().over(order) > TRAINING_WARMUP) & ~held)
    solved = fitted_so_far(rows, keys, "week_opening_date", FEATURES, TARGET, F.col("_use"))
    return solved.filter(F.col("week_opening_date") >= F.to_date(F.lit(str(validate_from)))).select(
        *keys, F.col("week_opening_date").alias("filing_week"),
        weeks_after("week_opening_date", "time_delay").alias("week_opening_date"),
        *FEATURES, F.col(TARGET).alias("next_week_close_price"),
        predicted(FEATURES).alias("predicted_price"), "n_train", "status",
    )
