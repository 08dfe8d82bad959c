"""Risk sections out of whole filing submissions, and the filing table built from them.

Everything is a per-row expression on the scan, so text is never shuffled before it has
been cut to its sections, and a submission is always read whole.
"""

from pyspark.sql import functions as F

from ..constants import UNKNOWN_COMPANY
from ..functions.text import (
    accession_of, between_items, cik_of, filing_index_url, filing_type_of, heading_pieces, html_to_text, main_document,
    piece_items,
)
from ..operators.joins import lookup_with_default


def filing_sections(submissions, all_or_nothing=False):
    """Risk factors (1A up to 1B, for 10-Qs up to 2) and, for 10-Ks, discussion (7 up to 7A).

    The last heading of each item counts. A section with a missing heading is NULL; under
    ``all_or_nothing`` it takes the other section with it.
    """
    rows = submissions.withColumn("filing_type", filing_type_of("path")).filter(
        F.col("filing_type").isin("10-K", "10-Q"))
    rows = rows.withColumn("_doc", main_document("content", "filing_type")).drop("content")
    rows = rows.withColumn("_pieces", heading_pieces("_doc")).drop("_doc").withColumn("_items", piece_items("_pieces"))
    annual = F.col("filing_type") == "10-K"
    factors = F.when(annual, between_items("_pieces", "_items", "1A", "1B")).otherwise(between_items("_pieces", "_items", "1A", "2"))
    disclosures = F.when(annual, between_items("_pieces", "_items", "7", "7A"))
    if all_or_nothing:
        both = ~annual | (factors.isNotNull() & disclosures.isNotNull())
        factors, disclosures = F.when(both, factors), F.when(both, disclosures)
    return rows.select(
        "path", "filing_type",
        html_to_text(factors).alias("risk_factors"), html_to_text(disclosures).alias("risk_disclosures"),
    )


def filing_records(submissions, ciks, dates, all_or_nothing=False):
    """One row per filing: company, type, number, sections, address and filing date.

    Filings without a landed date page drop out. Only rows that are the same in every column are removed.
    """
    sections = filing_sections(submissions, all_or_nothing).withColumns({
        "cik": cik_of("path"), "filing_number": accession_of("path"),
    })
    named = lookup_with_default(sections, ciks, "cik", "company_name", UNKNOWN_COMPANY)
    dated = dates.groupBy("filing_number").agg(F.max("filing_date").alias("filing_date"))
    return (
        named.join(dated, "filing_number")
        .select(
            "company_name", "filing_type", "filing_number", "risk_factors", "risk_disclosures",
            filing_index_url("filing_number").alias("filing_url"), "filing_date",
        )
        .dropDuplicates()
    )


def filings_by_year(filings):
    """Filing table laid out for pruning: partition column first derived from the date."""
    return filings.withColumn("filing_year", F.year("filing_date"))


def filing_paths(submissions, ciks):
    """Company, type and accession read off the submission paths alone."""
    parts = submissions.select(
        "path", cik_of("path").alias("cik"), filing_type_of("path").alias("filing_type"),
        accession_of("path").alias("filing_number"))
    return lookup_with_default(parts, ciks, "cik", "company_name", UNKNOWN_COMPANY)
