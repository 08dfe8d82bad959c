"""Join shapes: size-checked broadcast, week-shifted equi-join, as-of, anti-membership."""

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import weeks_after

#: Rows a side may have, by a bound known before the job runs, to be sent to every executor.
BROADCAST_ROWS = 500_000


def broadcast_if_bounded(df: DataFrame, max_rows) -> DataFrame:
    """Broadcast only when ``max_rows`` is a proven bound within the limit.

    With no bound, or one too large, the join is left to the optimizer, which
    shuffles it and still switches to a broadcast if the measured size is small.
    """
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def lag_join(left, right, left_week, right_week, lags, on=(), max_right_rows=None, how="inner"):
    """Join rows of ``left_week`` to ``right_week`` = ``left_week`` minus n weeks, for each lag n.

    The shift is applied to the key, so it stays an equi-join (hash or broadcast).
    Adds ``time_delay``.
    """
    lags = [lags] if isinstance(lags, int) else list(lags)
    shifted = left.withColumn(
        "time_delay", F.explode(F.array(*[F.lit(int(n)) for n in lags]))
    ).withColumn(right_week, F.date_sub(F.col(left_week), F.col("time_delay") * 7))
    return shifted.join(
        broadcast_if_bounded(right, max_right_rows), [right_week, *on], how
    )


def shifted_self_join(df, keys, week, weeks, columns):
    """Rows joined to the same series ``weeks`` later; a missing later week drops the row.

    ``columns`` maps a column of the later row to its output name.
    """
    later = df.select(
        *keys, weeks_after(week, -weeks).alias(week),
        *[F.col(c).alias(out) for c, out in columns.items()],
    )
    return df.join(later, [*keys, week])


def asof_forward(facts, reports, key, after, report_date, columns, fallback_latest=False):
    """First report dated strictly after ``after``, per key, from one grouped pass.

    ``facts`` has one row per key. With ``fallback_latest`` a key without such a
    report gets its latest one, otherwise NULLs. Also returns the latest report.
    Output columns: ``peak_<c>`` and ``latest_<c>`` for each report column.
    """
    keys = [key] if isinstance(key, str) else list(key)
    carried = [c for c in facts.columns if c not in keys]
    report = F.struct(F.col(report_date), *[F.col(c) for c in columns])
    joined = reports.join(facts, keys)
    picked = joined.groupBy(*keys, *carried).agg(
        F.min(F.when(F.col(report_date) > F.col(after), report)).alias("_first"),
        F.max(report).alias("_latest"),
    )
    first = F.coalesce("_first", "_latest") if fallback_latest else F.col("_first")
    names = [report_date, *columns]
    return picked.select(
        *keys, *carried,
        *[first.getField(n).alias(f"peak_{n}") for n in names],
        *[F.col("_latest").getField(n).alias(f"latest_{n}") for n in names],
    )


def asof_merge(facts, reports, keys, at, report_date, columns, direction="forward", strict=True, bucket="month"):
    """Each fact with the nearest report of its key after it (forward) or before it (backward), for any number of facts a key.

    Both sides are laid on one line of dates, which is sorted in pieces of a key and ``bucket`` (a unit of
    ``date_trunc``): within a piece the last report met is carried on, and a summary of one row a piece carries it
    from piece to piece. So the work is one sort, no fact is multiplied by reports, and a key with most of the
    rows is spread over its pieces. With ``strict`` a report of the same date does not count. Of several
    reports of a date the greatest by ``columns`` counts. Facts without such a report, with a NULL date or with a NULL key keep
    their row with NULLs. Output: the facts with ``report_date`` and ``columns`` prefixed by ``next_`` or ``last_``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    forward = direction == "forward"
    names, own = [report_date, *columns], facts.columns
    usable = reports.dropna(subset=[*keys, report_date])
    report, fact = F.struct(*[F.col(c).alias(c) for c in names]), F.struct(*[F.col(c).alias(c) for c in own])
    report_kind = usable.select(report.alias("r")).schema["r"].dataType
    fact_kind = facts.select(fact.alias("f")).schema["f"].dataType
    line = facts.select(
        *keys, F.col(at).cast("date").alias("_date"), F.lit(0 if strict else 1).alias("_side"), fact.alias("_fact"),
        F.lit(None).cast(report_kind).alias("_report"),
    ).unionAll(usable.select(
        *keys, F.col(report_date).cast("date").alias("_date"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(fact_kind).alias("_fact"),
        report.alias("_report"))).withColumn("_piece", F.date_trunc(bucket, "_date").cast("date"))

    def ordered(c):
        return F.col(c).desc_nulls_first() if forward else F.col(c).asc_nulls_first()

    piece = Window.partitionBy(*keys, "_piece")
    met = line.withColumn("_met", F.last("_report", True).over(
        piece.orderBy(ordered("_date"), "_side", F.col("_report").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    # the report a piece hands on: its last one in the order of the line, the greatest of its date
    summary = usable.withColumn("_piece", F.date_trunc(bucket, report_date).cast("date")).withColumn("_report", report)
    day = F.col(report_date)
    summary = summary.groupBy(*keys, "_piece").agg(F.max_by("_report", F.struct(
        (F.unix_date(day.cast("date")) * (-1 if forward else 1)).alias("d"), F.col("_report").alias("r"))).alias("_hand"))
    pieces = line.select(*keys, "_piece").dropna().distinct().join(summary, [*keys, "_piece"], "left")
    before = Window.partitionBy(*keys).orderBy(ordered("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.withColumn("_carried", F.last("_hand", True).over(before)).drop("_hand")
    found = F.coalesce("_met", "_carried")
    tag = "next_" if forward else "last_"
    return met.filter(F.col("_fact").isNotNull()).join(carried, [*keys, "_piece"], "left").select(
        *[F.col("_fact").getField(c).alias(c) for c in own], *[found.getField(c).alias(tag + c) for c in names])


def lookup_with_default(df, lookup, on, value, default):
    """Left join that fills a missing value with ``default``."""
    return df.join(lookup, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def not_in(df, other, on):
    """Rows whose key the other relation lacks."""
    return df.join(other.select(on).distinct(), on, "left_anti")
