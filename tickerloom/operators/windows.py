"""Series windows. A series is one symbol under one parameter combination, one row per week,
so its length is bounded by the calendar whatever the input size."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import ROLLING_PRECEDING


def trailing_mean(df, series, order, value, out, preceding=ROLLING_PRECEDING):
    """Mean of the current row and up to ``preceding`` earlier rows of the same series."""
    window = Window.partitionBy(*series).orderBy(*order).rowsBetween(-preceding, 0)
    return df.withColumn(out, F.avg(value).over(window))


def trailing_mean_across_series(df, groups, series, order, value, out, preceding=ROLLING_PRECEDING):
    """Trailing mean over rows ordered by (series, order) *without* restarting at a new series.

    Equal to one global ordered window per group, but no row-level data meets in one
    task: each series passes on only its last ``preceding`` values, and a series'
    predecessors among those short summaries supply the missing rows. ``preceding``
    earlier series always hold enough rows, since none is empty.
    """
    groups, series, order = list(groups), list(series), list(order)
    whole = [*groups, *series]
    position = Window.partitionBy(*whole).orderBy(*order)
    from_end = Window.partitionBy(*whole).orderBy(*[F.col(c).desc() for c in order])
    numbered = df.withColumn("_pos", F.row_number().over(position))
    tails = (
        df.withColumn("_back", F.row_number().over(from_end))
        .filter(F.col("_back") <= preceding)
        .groupBy(*whole)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("k"), F.col(value).alias("v")))).alias("_tail"))
        .withColumn("_tail", F.transform("_tail", lambda s: s["v"]))
    )
    before = Window.partitionBy(*groups).orderBy(*series).rowsBetween(-preceding, -1)
    carried = tails.select(
        *whole, F.slice(F.concat(F.array_repeat(F.lit(None).cast("double"), preceding),
                                 F.flatten(F.collect_list("_tail").over(before))),
                        -preceding, preceding).alias("_carried")
    )
    inside = position.rowsBetween(-preceding, 0)
    missing = F.greatest(F.lit(preceding + 1) - F.col("_pos"), F.lit(0))
    borrowed = F.slice(F.col("_carried"), preceding + 1 - missing, missing)
    present = F.filter(borrowed, lambda v: v.isNotNull())
    return (
        numbered.withColumn("_sum", F.sum(value).over(inside))
        .withColumn("_n", F.count(value).over(inside))
        .join(carried, whole)
        .withColumn("_extra", F.when(missing > 0, present).otherwise(F.array().cast("array<double>")))
        .withColumn(
            out,
            F.try_divide(
                F.coalesce("_sum", F.lit(0.0)) + F.aggregate("_extra", F.lit(0.0), lambda a, v: a + v),
                F.col("_n") + F.size("_extra"),
            ),
        )
        .drop("_pos", "_sum", "_n", "_carried", "_extra")
    )


def interpolate_linear(df, series, order, columns):
    """Fill inner gaps linearly by row number, keep leading NULLs, carry the last value to the end."""
    row = Window.partitionBy(*series).orderBy(*order)
    past = row.rowsBetween(Window.unboundedPreceding, 0)
    future = row.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(row))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        left, right = F.last(known, True).over(past), F.first(known, True).over(future)
        slope = F.try_divide(right["v"] - left["v"], (right["i"] - left["i"]).cast("double"))
        df = df.withColumn(
            c,
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(right.isNull(), left["v"])
            .otherwise(left["v"] + slope * (F.col("_i") - left["i"])),
        )
    return df.drop("_i")


def lag_rows(df, series, order, column, n, out):
    return df.withColumn(out, F.lag(column, n).over(Window.partitionBy(*series).orderBy(*order)))


def value_weeks_ahead(df, series, week, weeks, columns):
    """Values of the same series exactly ``weeks`` later (a column or a number), without a self-join.

    Every row appears at its own week and, with the values to be taken, ``weeks`` earlier; both
    meet in one aggregation, for any number of weeks. A partitioning by the series serves it. ``columns``
    maps source to output; NULL when the week is missing. A series has at most one row per week.
    """
    series = list(series)
    own = [c for c in df.columns if c not in (*series, week)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    back = F.date_sub(F.col(week), (F.col(weeks) if isinstance(weeks, str) else F.lit(weeks)) * 7).cast(kinds[week])

    def role(at, mine):
        none = {c: F.lit(None).cast(kinds[c]) for c in own}
        return F.struct(
            at.alias("_at"), F.lit(mine).alias("_mine"), *[(F.col(c) if mine else none[c]).alias(c) for c in own],
            *[(F.lit(None).cast(kinds[c]) if mine else F.col(c)).alias(out) for c, out in columns.items()])

    roles = df.select(*series, F.inline(F.array(role(F.col(week), True), role(back, False))))
    met = roles.groupBy(*series, "_at").agg(
        F.max("_mine").alias("_mine"), *[F.max(c).alias(c) for c in [*own, *columns.values()]])
    return met.filter("_mine").withColumnRenamed("_at", week).select(*df.columns, *columns.values())


def calendar_next(calendar, week, out):
    """Next week of a distinct week calendar (one row per week, so a single ordered pass)."""
    return calendar.withColumn(out, F.lead(week).over(Window.orderBy(week)))
