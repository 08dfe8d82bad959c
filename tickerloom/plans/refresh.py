"""Nightly refresh of stored tables by week: only weeks that new rows touch are read, recomputed and replaced.

Stores are Parquet folders partitioned by week. A batch is merged by key into its weeks, so a batch that is
run again, or a row that lands twice, changes nothing, and a retried run replaces whole weeks only.
"""

from pyspark.sql import functions as F

from ..functions.scalars import week_of
from ..operators.lineage import checkpointed
from ..sources.tables import append_days
from .keywords import keyword_weekly_counts
from .weekly import weekly_prices


def merge_weeks(batch, store, keys, week):
    """All rows of the weeks that the batch touches, after it has been merged into the store.

    One row a key: the batch's own replaces a stored one; of several in a batch the greatest counts. The rows are checkpointed before
    their partitions are replaced, since they are read from them.
    """
    spark = batch.sparkSession
    batch.limit(0).write.mode("append").partitionBy(week).parquet(store)  # a store that is not there yet
    touched = batch.select(week).distinct()
    stored = spark.read.schema(batch.schema).parquet(store).join(touched, week, "left_semi")
    others = [c for c in batch.columns if c not in keys]
    row = F.struct("_new", *others)
    merged = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1))).groupBy(*keys).agg(F.max(row).alias("_row"))
    merged = checkpointed(merged.select(*keys, *[F.col("_row").getField(c).alias(c) for c in others]).select(*batch.columns))
    append_days(merged, store, week)
    return merged


def refresh_weekly_prices(batch, store, weekly_store):
    """Merge daily prices into ``store`` and replace the weeks they touch in ``weekly_store``.

    A weekly price depends on the days of its own week alone, so no other week can change.
    """
    keys = [c for c in ("universe", "stock_symbol", "created_at") if c in batch.columns]
    rows = merge_weeks(batch.withColumn("week_opening_date", week_of("created_at")), store, keys, "week_opening_date")
    weeks = weekly_prices(rows.drop("week_opening_date"))
    append_days(weeks, weekly_store, "week_opening_date")


def refresh_keyword_counts(batch, store, counts_store, keywords):
    """Merge filings into ``store`` and recount the weeks they touch into ``counts_store``; other texts are not read."""
    rows = merge_weeks(batch.withColumn("filing_week", week_of("filing_date")), store, ["filing_number"], "filing_week")
    counts = keyword_weekly_counts(rows.drop("filing_week"), keywords)
    append_days(counts, counts_store, "filing_week")
