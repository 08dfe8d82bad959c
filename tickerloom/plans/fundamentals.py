"""Fundamentals as of each symbol's price peak, and the discount screen built on them."""

from pyspark.sql import functions as F

from ..constants import REPORTS_KEPT, UNFILTERED_SCREEN_LIMIT
from ..functions.scalars import (
    change, dollar_text, half_even, number, number_none_as_zero, parse_date, percent_text, ratio,
)
from ..operators.filters import all_of, checked_range, dates_within, equals, within
from ..operators.joins import asof_forward
from ..operators.ranking import sorted_by, top_k, top_k_per_group

KEY = ["universe", "stock_symbol"]

# The screen's column groups, as (output column, display label).
SCREEN_GROUPS = {
    "Stock Data": (
        ("company_name", "Company Name"), ("stock_symbol", "Stock Symbol"), ("price_change", "Price Change"),
        ("highest_price", "Highest Price"), ("current_price", "Current Price"),
        ("days_since_peak", "Days Since Peak Price"), ("peak_date", "Peak Price Date"),
    ),
    "Financial Data": (
        ("cash_growth", "Cash Growth Since Peak"), ("asset_growth", "Asset Growth Since Peak"),
        ("company_value_change", "Company Value Change"), ("peak_company_value", "Peak Company Value"),
        ("recent_company_value", "Most Recent Company Value"),
    ),
    "EPS Data": (("eps_change", "EPS Change"), ("peak_eps", "EPS at Peak Price"), ("recent_eps", "Most Recent EPS")),
    "P/S Data": (
        ("ps_change", "Price to Sales Ratio Change"), ("peak_ps", "Peak Price to Sales Ratio"),
        ("recent_ps", "Most Recent Price to Sales Ratio"),
    ),
    "P/E Data": (
        ("pe_change", "P/E Ratio Change"), ("peak_pe", "Peak P/E Ratio"), ("recent_pe", "Most Recent P/E Ratio"),
    ),
    "EBITDA Data": (
        ("ebitda_change", "EBITDA Change"), ("peak_ebitda", "Peak Price EBITDA"), ("recent_ebitda", "Most Recent EBITDA"),
    ),
}
SCREEN_COLUMNS = [name for group in SCREEN_GROUPS.values() for name, _ in group]
_PERCENT = [c for c in SCREEN_COLUMNS if c.endswith(("_change", "_growth"))]
_DOLLAR = ["highest_price", "current_price", "peak_eps", "recent_eps"]
_WHOLE_DOLLAR = ["peak_company_value", "recent_company_value", "peak_ebitda", "recent_ebitda"]
_WHOLE = ["peak_ps", "recent_ps", "peak_pe", "recent_pe"]


def unit_text(order_by):
    """Hint shown beside the range inputs for the chosen sort column."""
    if order_by in _PERCENT:
        return "% (e.g. .1 = 10%)"
    if order_by in _DOLLAR + _WHOLE_DOLLAR:
        return "Dollar ($)"
    if order_by in [*_WHOLE, "days_since_peak"]:
        return "Number"
    return "Not Applicable"


def price_peaks(prices):
    """Highest close (first day of equals) and latest close per universe and symbol, in one pass."""
    return prices.groupBy(*KEY).agg(
        F.max(F.struct("close_price", (-F.datediff("created_at", F.lit("1970-01-01"))).alias("d"))).alias("_top"),
        F.max(F.struct("created_at", "close_price")).alias("_now"),
    ).select(
        *KEY, F.col("_top.close_price").alias("highest_price"),
        F.date_add(F.lit("1970-01-01").cast("date"), -F.col("_top.d")).alias("peak_date"),
        F.col("_now.close_price").alias("current_price"), F.col("_now.created_at").alias("current_date"),
    )


# ---- reports as of the peak ---------------------------------------------------

def _peak_dates(prices):
    return price_peaks(prices).select(*KEY, "peak_date")


def earnings_asof(prices, reports):
    """Reported EPS of the first report after the peak (NULL when none follows) and of the latest."""
    picked = asof_forward(_peak_dates(prices), reports, KEY, "peak_date", "fiscal_date", ["reported_eps"])
    return picked.select(
        *KEY, half_even(number("peak_reported_eps"), 2).alias("peak_price_reported_eps"),
        F.col("peak_fiscal_date").alias("peak_price_eps_date"),
        number("latest_reported_eps").alias("most_recent_reported_eps"),
        F.col("latest_fiscal_date").alias("most_recent_eps_date"),
    )


def income_asof(prices, reports, kept=REPORTS_KEPT):
    """EBITDA text after the peak (the latest report if none follows), the latest, and the last
    20 reports as a JSON object of date to text."""
    picked = asof_forward(_peak_dates(prices), reports, KEY, "peak_date", "fiscal_date", ["ebitda"], True)
    recent = top_k_per_group(reports.select(*KEY, "fiscal_date", "ebitda"), KEY, "fiscal_date", kept)
    entry = F.struct(F.date_format("fiscal_date", "yyyy-MM-dd").alias("key"), F.col("ebitda").alias("value"))
    history = recent.groupBy(*KEY).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry), False))).alias("ebitda_last_5_years"))
    return picked.join(history, KEY).select(
        *KEY, F.col("peak_ebitda").alias("peak_price_ebitda"), F.col("peak_fiscal_date").alias("peak_price_ebitda_date"),
        "ebitda_last_5_years", F.col("latest_ebitda").alias("most_recent_ebitda"),
        F.col("latest_fiscal_date").alias("most_recent_ebitda_date"),
    )


def balance_asof(prices, reports):
    """Shares, assets and cash after the peak (the latest report if none follows) and latest."""
    names = ["shares_outstanding", "total_assets", "total_cash"]
    picked = asof_forward(_peak_dates(prices), reports, KEY, "peak_date", "fiscal_date", names, True)
    return picked.select(
        *KEY, *[F.col(f"peak_{n}").alias(f"peak_price_{n}") for n in names],
        F.col("peak_fiscal_date").alias("peak_price_report_date"),
        *[F.col(f"latest_{n}").alias(f"most_recent_{n}") for n in names],
        F.col("latest_fiscal_date").alias("most_recent_report_date"),
    )


def quarterly_series(income, stock_symbol=None):
    """The JSON object of an income row as (date, decimal) rows."""
    rows = all_of(income, equals("stock_symbol", stock_symbol))
    entries = rows.select(*KEY, F.explode(F.from_json("ebitda_last_5_years", "map<string,string>")).alias("k", "v"))
    return entries.select(*KEY, parse_date("k").alias("reporting_date"), number("v").alias("quarterly_revenue"))


# ---- screen -------------------------------------------------------------------

def discount_screen(prices, names, sectors, balance, income, stock_symbol=None, company=None, sector=None,
                    start=None, end=None):
    """Peak against latest price and fundamentals, per universe and symbol. Zero divisors give NULL."""
    dims = all_of(
        sectors.select(*KEY, "sector").join(names, "stock_symbol"),
        equals("stock_symbol", stock_symbol), equals("company_name", company), equals("sector", sector),
    )
    days = all_of(prices, dates_within("created_at", start, end), equals("stock_symbol", stock_symbol))
    peaks = price_peaks(days)
    shares = balance.select(
        *KEY,
        change(number("most_recent_total_assets"), number("peak_price_total_assets")).alias("asset_growth"),
        change(number("most_recent_total_cash"), number("peak_price_total_cash")).alias("cash_growth"),
        number("peak_price_shares_outstanding").alias("peak_shares"),
        number("most_recent_shares_outstanding").alias("recent_shares"),
    )
    earned = income.select(
        *KEY, number_none_as_zero("peak_price_ebitda").alias("peak_ebitda"),
        number_none_as_zero("most_recent_ebitda").alias("recent_ebitda"),
    )
    rows = peaks.join(dims, KEY).join(shares, KEY).join(earned, KEY)

    def eps(ebitda, count):
        return F.when(F.col(ebitda) <= 0, 0.0).when(F.col(ebitda) > 0, ratio(ebitda, count))

    steps = [
        {"price_change": change("current_price", "highest_price"),
         "days_since_peak": F.datediff("current_date", "peak_date"),
         "peak_company_value": F.col("highest_price") * F.col("peak_shares"),
         "recent_company_value": F.col("current_price") * F.col("recent_shares"),
         "ebitda_change": change("recent_ebitda", "peak_ebitda"),
         "peak_eps": eps("peak_ebitda", "peak_shares"), "recent_eps": eps("recent_ebitda", "recent_shares")},
        {"company_value_change": change("recent_company_value", "peak_company_value"),
         "peak_ps": ratio("peak_company_value", F.col("peak_ebitda") * 4),
         "recent_ps": ratio("recent_company_value", F.col("recent_ebitda") * 4),
         "eps_change": change("recent_eps", "peak_eps"),
         "peak_pe": ratio("highest_price", "peak_eps"), "recent_pe": ratio("current_price", "recent_eps")},
        {"ps_change": change("recent_ps", "peak_ps"), "pe_change": change("recent_pe", "peak_pe")},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows.select("universe", "sector", *SCREEN_COLUMNS)


def screen_page(screen, order_by="price_change", descending=False, low=None, high=None, sector=None, groups=(),
                limit=UNFILTERED_SCREEN_LIMIT):
    """Range filter, chosen order and column groups; without a sector only the first ``limit`` rows.

    Returns (rows, message); the message is set when the range was unusable.
    """
    order_by = order_by or "price_change"
    low, high, message = checked_range(low, high)
    kept = all_of(screen, F.col(order_by).isNotNull(), within(order_by, low, high))
    shown = (
        top_k(kept, order_by, limit, descending, ["stock_symbol", "universe"])
        if not sector else sorted_by(kept, order_by, descending, ["stock_symbol", "universe"])
    )
    columns = [name for g in groups for name, _ in SCREEN_GROUPS[g]]
    return (shown.select(*columns) if columns else shown), message


def screen_display(rows):
    """Screen values as shown: percent and dollar text, whole ratios."""
    shown = {c: percent_text(c, 1) for c in _PERCENT}
    shown.update({c: dollar_text(c) for c in _DOLLAR})
    shown.update({c: dollar_text(c, 0) for c in _WHOLE_DOLLAR})
    shown.update({c: half_even(c, 0) for c in _WHOLE})
    labels = {name: label for group in SCREEN_GROUPS.values() for name, label in group}
    return rows.select(*[shown.get(c, F.col(c)).alias(labels.get(c, c)) for c in rows.columns if c in labels])
