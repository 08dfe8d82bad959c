"""Typed, optional predicates. Blank or missing parameters simply add no condition."""

from functools import reduce

from pyspark.sql import functions as F


def all_of(df, *predicates):
    """AND of the predicates that are not None."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def equals(column, value):
    return None if value in (None, "") else F.col(column) == value


def one_of(column, values):
    return None if not values else F.col(column).isin(list(values))


def none_of(column, values):
    return None if not values else ~F.col(column).isin(list(values))


def within(column, low=None, high=None):
    """Closed range with either end open."""
    if low is None and high is None:
        return None
    if low is None:
        return F.col(column) <= high
    if high is None:
        return F.col(column) >= low
    return F.col(column).between(low, high)


def dates_within(column, start=None, end=None):
    def day(d):
        return None if d in (None, "") else F.to_date(F.lit(str(d)))
    return within(column, day(start), day(end))


def at_least_days_before(column, as_of, days):
    return F.col(column) <= F.date_sub(F.to_date(F.lit(str(as_of))), days)


def within_last_days(column, as_of, days):
    return F.col(column) >= F.date_sub(F.to_date(F.lit(str(as_of))), days)


def checked_range(low, high):
    """(low, high, message): a range whose low end is not below its high end is dropped whole."""
    if low is not None and high is not None and low >= high:
        return None, None, "Minimum value must be less than Maximum value"
    return low, high, ""


def kept_filing_types(label):
    """Dashboard label to the filing types it keeps; anything else keeps both."""
    return {"10-K": ["10-K"], "10-Q": ["10-Q"]}.get(label, [])
