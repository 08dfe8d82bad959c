"""What several operators share: words, landed tables, the held-out fold."""

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

#: Java and RE2 form of the word separators space, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Words of letters, digits and whatever is not ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def spaced_words(text):
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def held_out(doc_id):
    """True for the fold no label is learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_folder(spark):
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tickerloom-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def landed(df, name):
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tickerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a side is broadcast; beyond, Spark shuffles or decides by size itself.
BROADCAST_ROWS = 500_000


def broadcast_checked(df, most=BROADCAST_ROWS, cells=None):
    """Mark a landed table for broadcast after counting it; one with more rows is left to the optimizer.

    ``cells`` names an array column whose entries count as rows as well.
    """
    size = F.lit(1) if cells is None else 1 + F.greatest(F.size(cells), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def give_back():
    """Give memory freed in this Python worker back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def then_give_back(batches):
    """The same batches, with freed memory given back before the first and after the last."""
    give_back()
    yield from batches
    give_back()


#: Texts that cross between Spark and Python at once; 10,000, the default, are tens of MB, several times in either process.
TEXTS_A_BATCH = 1000


def small_batches(spark):
    """Lower the session's rows of an Arrow batch to ``TEXTS_A_BATCH`` from here on; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_A_BATCH:
        spark.conf.set(name, str(TEXTS_A_BATCH))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
