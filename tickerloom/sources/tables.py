"""Readers of landed files and table sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import accession_of, cik_of, filing_type_of, info_text
from ..functions.scalars import parse_date


# ---- readers ---------------------------------------------------------------

def read_csv(spark, path, schema):
    return spark.read.schema(schema).option("header", True).csv(path)


def read_submissions(spark, root):
    """Whole submission files below a company / type / accession tree: path and content."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "full-submission.txt")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def read_symbol_ciks(spark, path):
    """[{symbol: cik}, ...] files to (cik, company_name), one symbol per number."""
    entries = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "array<map<string,string>>")).alias("entry")
    )
    return (
        entries.select(F.explode("entry").alias("company_name", "cik"))
        .groupBy("cik").agg(F.min("company_name").alias("company_name"))
    )


def read_reports(spark, path, schema, array):
    """Landed quarterly reports, one row per symbol and report."""
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.col("symbol").alias("stock_symbol"), F.explode(array).alias("report"))
        .select("stock_symbol", parse_date("report.fiscalDateEnding").alias("fiscal_date"), "report.*")
        .drop("fiscalDateEnding")
    )


def read_income_reports(spark, path):
    return read_reports(spark, path, schemas.INCOME_FILE, "quarterlyReports")


def read_balance_reports(spark, path):
    return read_reports(spark, path, schemas.BALANCE_FILE, "quarterlyReports").withColumnsRenamed({
        "commonStockSharesOutstanding": "shares_outstanding", "totalAssets": "total_assets",
        "cashAndCashEquivalentsAtCarryingValue": "total_cash",
    })


def read_earnings_reports(spark, path):
    return read_reports(spark, path, schemas.EARNINGS_FILE, "quarterlyEarnings").withColumnRenamed(
        "reportedEPS", "reported_eps")


def read_overviews(spark, path):
    """Company overview objects: symbol, sector and two ratios as vendor text."""
    return spark.read.schema(schemas.OVERVIEW_FILE).option("multiLine", True).json(path).select(
        F.col("Symbol").alias("stock_symbol"), F.col("Sector").alias("sector"),
        F.col("PERatio").alias("peratio"), F.col("EVToEBITDA").alias("evtoebitda"),
    )


# ---- readers that keep what they cannot use ------------------------------------

#: Column in which Spark's readers leave the text of a record they could not read in full.
UNREAD = "_unread"


def _file():
    return F.col("_metadata.file_name").alias("file")


def _without(columns):
    """Names of the columns that are NULL, as text."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def split_rejects(df, columns, required, record=UNREAD, also=()):
    """(usable rows, rejects) of a frame with ``file`` and the text of unread records.

    A row is rejected if it could not be read in full or lacks a required value. Rejects keep the file, the record, the
    ``also`` columns and a reason, so that none is lost silently.
    """
    missing = _without(required)
    marked = df.withColumn("_missing", missing)
    bad = F.col(record).isNotNull() | (F.col("_missing") != "")
    reason = F.when(F.col("_missing") != "", F.concat(F.lit("no usable value: "), F.col("_missing"))).otherwise("unreadable")
    return marked.filter(~bad).select(*columns), marked.filter(bad).select(
        "file", F.col(record).alias("record"), *also, reason.alias("reason"))


def read_csv_checked(spark, path, schema, required=None):
    """CSV rows of a schema, and rejects: lines with a value of another kind, a missing required value, or too few or many values."""
    names = [f.name for f in schema.fields]
    wide = T.StructType([*schema.fields, T.StructField(UNREAD, T.StringType())])
    df = spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", UNREAD).csv(path)
    return split_rejects(df.select(*names, UNREAD, _file()), names, names if required is None else required, also=names)


def read_reports_checked(spark, path, schema, array):
    """Landed quarterly reports, and rejects: unreadable files, files without a symbol, reports without a usable date."""
    wide = T.StructType([*schema.fields, T.StructField(UNREAD, T.StringType())])
    files = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", UNREAD).json(path)
    read, broken = split_rejects(files.select(F.col("symbol").alias("stock_symbol"), array, UNREAD, _file()), ["stock_symbol", array, "file"],
                                 ["stock_symbol"], also=["stock_symbol"])
    reports = read.select("file", "stock_symbol", F.explode(array).alias("report")).select(
        "file", "stock_symbol", parse_date("report.fiscalDateEnding").alias("fiscal_date"), F.to_json("report").alias("_text"), "report.*").drop("fiscalDateEnding")
    columns = [c for c in reports.columns if c not in ("file", "_text")]
    usable, undated = split_rejects(
        reports.withColumn(UNREAD, F.when(F.col("fiscal_date").isNull(), F.col("_text"))), columns, ["fiscal_date"], also=["stock_symbol"])
    # a file is rejected as a whole: what could be read of it may be half of it
    whole = broken.withColumn("reason", F.when(F.col("record").isNotNull(), "unreadable").otherwise(F.col("reason")))
    return usable, whole.unionByName(undated)


def read_symbol_ciks_checked(spark, path):
    """(cik, company_name) of [{symbol: cik}, ...] files, one symbol per number, and rejects: unreadable files, entries without a number."""
    files = spark.read.text(path, wholetext=True).select("value", _file()).withColumn(
        "entries", F.from_json("value", "array<map<string,string>>"))
    read, broken = split_rejects(files.withColumn(UNREAD, F.when(F.col("entries").isNull(), F.col("value"))), ["file", "entries"], [])
    entries = read.select("file", F.explode("entries").alias("entry")).select("file", F.explode("entry").alias("company_name", "cik"))
    usable, open_ = split_rejects(
        entries.withColumn(UNREAD, F.when(F.col("cik").isNull(), F.col("company_name"))), ["company_name", "cik"], ["cik"])
    return usable.groupBy("cik").agg(F.min("company_name").alias("company_name")), broken.unionByName(open_)


def read_submissions_checked(spark, root, name="full-submission.txt"):
    """Whole submissions of a tree, and rejects: files without a document, or whose path names no company and filing."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), _file()))
    numbered = (cik_of("path") != "") & (accession_of("path") != "") & (filing_type_of("path") != "")
    held = F.contains("content", F.lit("<DOCUMENT>"))
    checked = files.withColumns({"document": F.when(held, 1), "number": F.when(numbered, 1), UNREAD: F.when(~(held & numbered), F.col("path"))})
    return split_rejects(checked, ["path", "content"], ["document", "number"])


def html_table_rows(pages, html, keys=(), min_cells=1):
    """Rows of a landed HTML table as an array of trimmed cell texts; the header row has no <td>."""
    row = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    cells = F.transform(
        F.regexp_extract_all(F.col("_row"), F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)),
        lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " ")),
    )
    return (
        pages.select(*keys, row.alias("_row")).select(*keys, cells.alias("cells"))
        .filter(F.size("cells") >= min_cells)
    )


def filing_dates(pages):
    """Filing number and parsed date of landed index pages."""
    return pages.select("filing_number", parse_date(info_text("html")).alias("filing_date"))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# ---- sinks -----------------------------------------------------------------

def append_days(df, path, day="created_at"):
    """Idempotent append of whole days: a day's partition is replaced, so a rerun adds nothing twice."""
    (df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(day).parquet(path))


def replace(df, path):
    df.write.mode("overwrite").parquet(path)


def append_if_any(df, path, day="created_at"):
    """Append unless there is nothing to add; tells whether it wrote."""
    if df.isEmpty():
        return False
    append_days(df, path, day)
    return True


def snapshot_on(df, run_date, weekday=1):
    """Rows to append to a snapshot table: all of them on the given weekday (0 = Monday), else none."""
    day = F.to_date(F.lit(str(run_date)))
    return df.withColumn("snapshot_date", day).filter(F.weekday(day) == weekday)


def records(df, order, limit):
    """The first ``limit`` rows in ``order`` (columns that make it total) as dictionaries, for presentation."""
    return [row.asDict() for row in df.orderBy(*order).limit(limit).collect()]
