"""Streaming forms of the nightly jobs (extensions: the batch operators are the feature)."""

from pyspark.sql import functions as F

from ..functions.scalars import week_of
from ..plans.refresh import merge_weeks
from ..plans.weekly import daily_prices_ingest


def ingest_daily_prices(spark, landed_path, schema, out_path, checkpoint_path):
    """Take in the landed files not seen before, then stop.

    A batch is merged into the weeks it touches, so a retried batch, or a row that lands in two files, stands once.
    """
    landed = spark.readStream.schema(schema).option("header", True).csv(landed_path)

    def write(batch, batch_id):
        rows = daily_prices_ingest(batch).withColumn("week_opening_date", week_of("created_at"))
        merge_weeks(rows, out_path, ["stock_symbol", "created_at"], "week_opening_date")

    return (
        landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True).start()
    )


def _week(ts):
    # weeks begin on Monday; the epoch was a Thursday, four days before one
    return F.window(ts, "7 days", startTime="4 days")


def weekly_first_last(rows, key, ts, value):
    """First and last value per key and Monday week; works on a batch or a watermarked stream."""
    return (
        rows.groupBy(key, _week(ts).alias("_w"))
        .agg(F.min(F.struct(ts, value)).getField(value).alias("first_value"),
             F.max(F.struct(ts, value)).getField(value).alias("last_value"))
        .select(key, F.to_date("_w.start").alias("week_opening_date"), "first_value", "last_value")
    )


def weekly_stream(stream, key, ts, value, late="7 days"):
    """:func:`weekly_first_last` over a stream; rows later than ``late`` are dropped."""
    return weekly_first_last(stream.withWatermark(ts, late), key, ts, value)
