"""Landed files made by Spark from the given tables, with the defects that readers must cope with.

They stand in the folder that all executors share, one subfolder a call.
"""

import uuid

from pyspark.sql import functions as F

from . import derived as D
from ..operators.lineage import shared_folder


def place(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _number():
    return F.substring("stock_symbol", 2, 6).cast("bigint")


def prices_csv(spark, sf_dir):
    """Vendor price lines; of 50 days of a symbol one has no number as close and one no date."""
    turn = (_number() * 31 + F.datediff("created_at", F.to_date(F.lit(D.FIRST_DAY)))) % 50
    path = place(spark, "prices-csv")
    D.prices(spark, sf_dir).select(
        F.when(turn == 11, "unknown").otherwise(F.date_format("created_at", "yyyy-MM-dd")).alias("Date"),
        F.col("open_price").cast("string").alias("Open"), F.col("close_price").cast("string").alias("High"),
        F.col("open_price").cast("string").alias("Low"),
        F.when(turn == 7, "n/a").otherwise(F.col("close_price").cast("string")).alias("Close"),
        F.col("volume").cast("string").alias("Volume"), F.col("stock_symbol").alias("Symbol"),
    ).write.option("header", True).csv(path)
    return path


def income_json(spark, sf_dir):
    """One file of quarterly reports a symbol; one in ten is cut off, and some reports have no date."""
    path = place(spark, "income-json")
    undated = (_number() % 7 == 2) & (F.month("fiscal_date") == 3)
    report = F.struct(F.when(undated, "n/a").otherwise(F.date_format("fiscal_date", "yyyy-MM-dd")).alias("fiscalDateEnding"), "ebitda")
    files = D.reports(spark, sf_dir).groupBy("stock_symbol").agg(F.sort_array(F.collect_list(report)).alias("quarterlyReports"))
    text = F.to_json(F.struct(F.col("stock_symbol").alias("symbol"), "quarterlyReports"))
    cut = F.when(_number() % 10 == 3, F.left(text, F.length(text) - 20)).otherwise(text)
    files.select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def cik_json(spark, sf_dir):
    """One file of symbols and company numbers a nation; one in five is cut off, some symbols have no number."""
    path = place(spark, "cik-json")
    key = F.col("s_suppkey")
    entry = F.create_map(D.symbol("s_suppkey"), F.when(key % 9 != 4, (key + 10000).cast("string")))
    files = D.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.to_json(entry, {"ignoreNullFields": "false"}))).alias("entries"))
    text = F.concat(F.lit("["), F.concat_ws(",", "entries"), F.lit("]"))
    files.select(F.when(F.col("s_nationkey") % 5 == 3, F.left(text, F.length(text) - 1)).otherwise(text).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return path
