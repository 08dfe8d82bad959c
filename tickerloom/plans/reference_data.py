"""Symbol, sector and index-membership dimensions."""

from pyspark.sql import functions as F

from ..constants import INDEX_SYMBOLS, MEMBERSHIP_SINCE
from ..functions.scalars import number, parse_date
from ..operators.filters import none_of
from ..operators.joins import not_in
from ..operators.ranking import resume_after


def sector_list(sectors):
    return sectors.select("sector").distinct()


def symbol_names(prices, names):
    """Traded symbols of each universe with their company name, index symbols removed.

    Distinct symbols are found before the join, which then only touches dimension rows.
    """
    traded = prices.select("universe", "stock_symbol").distinct().filter(none_of("stock_symbol", INDEX_SYMBOLS))
    named = names.groupBy("stock_symbol").agg(F.min("company_name").alias("company_name"))
    return traded.join(named, "stock_symbol").select("universe", "stock_symbol", "company_name")


def sector_records(overviews, listed, start_symbol=None):
    """Vendor overviews of symbols outside the listed index; ratios also as numbers."""
    rows = not_in(overviews, listed, "stock_symbol")
    if start_symbol:
        rows = resume_after(rows.withColumn("position", F.col("stock_symbol")), start_symbol).drop("position")
    return rows.select(
        "stock_symbol", "sector", "peratio", "evtoebitda",
        number("peratio").alias("pe_ratio"), number("evtoebitda").alias("ev_to_ebitda"),
    )


def index_membership_since(table_rows, since=MEMBERSHIP_SINCE):
    """Landed membership rows (cells 0, 5, 7: symbol, added, ended) added or ended since a date."""
    rows = table_rows.filter(F.size("cells") >= 7).select(
        F.get("cells", F.lit(0)).alias("stock_symbol"),
        parse_date(F.get("cells", F.lit(5))).alias("date_added"),
        parse_date(F.get("cells", F.lit(7))).alias("date_ended"),
    )
    day = F.to_date(F.lit(str(since)))
    return rows.filter((F.col("date_added") >= day) | (F.col("date_ended") >= day))
