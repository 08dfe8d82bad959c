"""Scalar column expressions: calendar alignment, safe arithmetic, display formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A spread below this share of the mean is rounding noise, not variation.
FLAT = 1e-12


def col(c):
    return F.col(c) if isinstance(c, str) else c


# ---- calendar -------------------------------------------------------------

def week_of(c) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", col(c)))


def month_of(c) -> Column:
    return F.trunc(col(c), "month")


def weeks_after(c, n) -> Column:
    """Shift a date by ``n`` weeks; ``n`` may be a column."""
    n = F.lit(n) if isinstance(n, int) else col(n)
    return F.date_add(col(c), (n * 7).cast("int"))


def same_or_next_monday(c) -> Column:
    c = col(c)
    return F.date_add(c, F.pmod(-F.weekday(c), F.lit(7)))


def same_or_previous_friday(c) -> Column:
    """Friday of the week, or a week earlier unless the date already is that Friday."""
    c = col(c)
    friday = F.date_add(c, F.lit(4) - F.weekday(c))
    return F.when(friday == c, friday).otherwise(F.date_sub(friday, 7))


def packed_date(c) -> Column:
    """yyyymmdd as an integer."""
    c = col(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def iso_date(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def parse_date(c) -> Column:
    """NULL instead of an error for text that is no date."""
    return F.try_to_date(col(c)) if hasattr(F, "try_to_date") else F.try_to_timestamp(col(c)).cast("date")


# ---- arithmetic -----------------------------------------------------------

def ratio(a, b) -> Column:
    """a / b in double, NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(new, old) -> Column:
    return ratio(new, old) - 1


def number(c) -> Column:
    """Vendor text to double; NULL when it is no number."""
    return col(c).try_cast("decimal(38,6)").cast("double")


def number_none_as_zero(c) -> Column:
    """As :func:`number`, with the vendor's 'None' text read as 0."""
    return F.when(col(c) == "None", F.lit(0.0)).otherwise(number(c))


def half_even(c, digits) -> Column:
    """Round half to even on the scaled double, as numerical array libraries do."""
    scale = float(10 ** digits)
    return F.rint(col(c).cast("double") * scale) / scale


# ---- statistics -----------------------------------------------------------

def _flat(mean, deviation):
    return deviation <= FLAT * F.abs(mean)


def safe_corr(x, y) -> Column:
    """Aggregate: Pearson correlation, NULL when either side does not vary."""
    x, y = col(x), col(y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when(
        ~(_flat(F.avg(x), sx) | _flat(F.avg(y), sy)),
        F.try_divide(F.covar_pop(x, y), sx * sy),
    )


def safe_corr_over(x, y, window) -> Column:
    """:func:`safe_corr` over a window frame."""
    x, y = col(x), col(y)
    sx, sy = F.stddev_pop(x).over(window), F.stddev_pop(y).over(window)
    return F.when(
        ~(_flat(F.avg(x).over(window), sx) | _flat(F.avg(y).over(window), sy)),
        F.try_divide(F.covar_pop(x, y).over(window), sx * sy),
    )


def mean_absolute_error(actual, predicted) -> Column:
    return F.avg(F.abs(col(actual) - col(predicted)))


def match_rate(a, b) -> Column:
    """Share of rows whose labels are equal; a NULL label never matches but counts as a row."""
    hit = F.coalesce((col(a) == col(b)).cast("int"), F.lit(0))
    return F.try_divide(F.sum(hit).cast("double"), F.count(F.lit(1)).cast("double"))


# ---- display --------------------------------------------------------------

def percent_text(c, digits=0) -> Column:
    """Share as percent; NULL for NULL."""
    return F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f%%", half_even(col(c) * 100, digits)))


def dollar_text(c, digits=2) -> Column:
    """$1,234.50 / $1,235"""
    return F.concat(F.lit("$"), F.format_number(col(c), digits))


def plain_dollar_text(c) -> Column:
    """$1234.50, no thousands separator."""
    return F.format_string("$%.2f", half_even(c, 2))


def movement(new, old, up="moved_up", down="moved_down", same="no_move") -> Column:
    new, old = col(new), col(old)
    return F.when(new > old, up).when(new < old, down).when(new == old, same)


def padded_range(c, share=0.1):
    """Axis range of a series: (min, max) widened by a share of the spread. Aggregates."""
    low, high = F.min(c), F.max(c)
    return low - (high - low) * share, high + (high - low) * share
