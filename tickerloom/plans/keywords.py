"""Keyword mentions per filing week, from one scan of the filings."""

from pyspark.sql import functions as F

from ..constants import KEYWORDS
from ..functions.scalars import week_of
from ..functions.text import keyword_flags, keyword_hits, mentions, occurrences, overlaps_itself
from ..operators.filters import all_of, dates_within, one_of


def keyword_weekly_counts(filings, keywords=KEYWORDS):
    """Filings mentioning each keyword, and all filings, per week and type.

    All keywords are found in one pass over each text, however many there are; only
    counters are shuffled. Weeks without a mention keep their zero row. A filing counts once
    when either section matches; a missing section is no match.
    """
    keywords = list(dict.fromkeys(keywords))
    lowered = [k.lower() for k in keywords]
    slim = filings.select(
        week_of("filing_date").alias("filing_week"), "filing_type", "filing_url",
        F.lower("risk_factors").alias("_a"), F.lower("risk_disclosures").alias("_b"),
    )
    columns, flags = keyword_flags(["_a", "_b"], lowered)
    found = slim.withColumns(columns)
    wide = found.groupBy("filing_week", "filing_type").agg(
        F.count("filing_url").alias("total_filings"), *[F.count_if(f).alias(f"k{i}") for i, f in enumerate(flags)]
    )
    counters = F.array(*[
        F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("keyword_mentions"))
        for i, k in enumerate(keywords)
    ])
    return wide.select("filing_week", "filing_type", "total_filings", F.inline(counters))


def keyword_occurrences(filings, keywords, start=None, end=None):
    """Case-sensitive, non-overlapping occurrences in the risk factors over a date range, of keywords with any.

    One pass over the texts counts the hits of all keywords that cannot overlap themselves, the others
    by replacing them; counters alone are shuffled.
    """
    keywords = [k for k in dict.fromkeys(keywords) if k]
    plain = [k for k in keywords if not overlaps_itself(k)]
    odd = [k for k in keywords if overlaps_itself(k)]
    rows = all_of(filings, dates_within("filing_date", start, end))
    found = []
    if plain:
        hits = rows.select(F.explode(keyword_hits("risk_factors", plain)).alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))
        # a hit stands for all keywords that begin it
        begun = F.filter(F.array(*[F.lit(k) for k in plain]), lambda k: F.startswith(F.col("hit"), k))
        found.append(hits.select(F.explode(begun).alias("keyword"), "n"))
    if odd:
        sums = rows.agg(*[F.sum(occurrences("risk_factors", k)).alias(f"k{i}") for i, k in enumerate(odd)])
        entries = [F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(odd)]
        found.append(sums.select(F.inline(F.array(*entries))))
    if not found:
        return rows.select(F.lit("").alias("keyword"), F.lit(0).cast("bigint").alias("keyword_count")).limit(0)
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return every.groupBy("keyword").agg(F.sum("n").alias("keyword_count")).filter(F.col("keyword_count") > 0)


def mention_rates(counts, keywords=None, filing_types=None):
    """Share of a week's filings that mention the keyword."""
    kept = all_of(counts, one_of("keyword", keywords), one_of("filing_type", filing_types))
    return kept.select(
        "filing_week", "keyword", "filing_type",
        F.try_divide(F.col("keyword_mentions").cast("double"), F.col("total_filings").cast("double")).alias("mention_rate"),
    )


__all__ = ["keyword_weekly_counts", "keyword_occurrences", "mention_rates", "mentions"]
