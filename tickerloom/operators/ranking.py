"""Ordered selections. Every order is total, and NULL placement is always stated."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def ordering(column, descending=True, tiebreak=()):
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return [first, *[F.col(c).asc_nulls_last() for c in tiebreak]]


def top_k_per_group(df, groups, column, k, descending=True, tiebreak=()):
    """k best rows per group. The rank filter lets Spark cut each task's rows before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*ordering(column, descending, tiebreak))
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def top_k(df, column, k, descending=True, tiebreak=()):
    """k best rows overall (a take-ordered plan, no full sort)."""
    return df.orderBy(*ordering(column, descending, tiebreak)).limit(k)


def best_per_key(df, keys, column, descending=True, tiebreak=()):
    """One row per key: the best by ``column``."""
    return top_k_per_group(df, keys, column, 1, descending, tiebreak)


def skip_first(df, series, order, n):
    """Drop the first n rows of each series."""
    window = Window.partitionBy(*series).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_pos", F.row_number().over(window)).filter(F.col("_pos") > n).drop("_pos")


def sorted_by(df, column, descending=False, tiebreak=()):
    """User-chosen sort column, missing values last in either direction."""
    return df.orderBy(*ordering(column, descending, tiebreak))


def resume_after(symbols, start_symbol, position="position"):
    """Symbols that follow ``start_symbol`` in the list's own order; all of them when it is blank.

    A symbol that is not in the list is an error when the result is read.
    """
    if not start_symbol:
        return symbols
    start = symbols.filter(F.col("stock_symbol") == start_symbol).agg(F.min(position))
    unknown = F.raise_error(F.lit(f"no symbol {start_symbol!r} to resume after"))
    return symbols.filter(F.when(start.scalar().isNull(), unknown.cast("boolean")).otherwise(F.col(position) > start.scalar()))
