"""Unions over universes and key-based gluing of result parts."""

from functools import reduce

from pyspark.sql import functions as F


def union_universes(**frames):
    """UNION ALL of same-shaped tables, tagged with the universe each came from."""
    tagged = [df.withColumn("universe", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def concat_rows(*frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def glue(left, right, keys):
    """Side-by-side columns by key, never by position."""
    return left.join(right, list(keys))


def exactly_distinct(df):
    return df.dropDuplicates()
