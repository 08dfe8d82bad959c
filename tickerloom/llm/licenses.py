"""License scan by diagonal voting.

All rolling word k-grams of every text meet the k-grams of the templates in one Spark join
(hash and gram, so a hit is exact). A hit votes for the diagonal ``place in text - place in
template``. Votes are added by diagonal, diagonals not more than ``band`` apart are merged
into spans (words added or left out move a license to the next diagonals), and a span counts
when its exact hits cover enough of its template and all of its telling words: a version, or the word
that sets a license apart from one of nearly the same name. Text never leaves the scan: only hits and
one header row per document are shuffled.

The templates are a parameter, never learnt, so the broadcast side is as large as the list.
Null and blank texts have no words and no labels. Repeated rows get a row each; rows that
share an id but differ in text too. Further columns are ignored.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from .common import ascii_lower, landed

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    base: bool = False
    #: Words of the phrase that tell it from its kin: a span without one of them is none.
    telling: tuple = ()

    @property
    def words(self):
        return self.phrase.split()

    @property
    def told_by(self):
        """Places of the telling words."""
        return [i for i, w in enumerate(self.words) if w in self.telling]


# Fixed phrases and labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
FURTHER = (
    Template("gpl-3", "gnu general public license version 3", telling=("gnu", "3")),
    Template("gpl-2", "gnu general public license version 2", telling=("gnu", "2")),
    Template("lgpl", "gnu lesser general public license", telling=("lesser",)),
    Template("mpl-2", "mozilla public license version 2 0", telling=("mozilla", "2")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance",
             telling=("apache", "2")),
    Template("cc-by", "creative commons attribution license", telling=("commons", "license")),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = BASE + FURTHER
#: Words per gram, diagonals merged, share of a template's words that exact hits must cover.
K, BAND, COVERAGE = 3, 2, 0.8


def template_grams(spark, templates, k=K):
    """A row per template and place: id, place, gram, and what the template is."""
    rows = []
    for i, t in enumerate(templates):
        w = t.words
        if len(w) < k:
            raise ValueError(f"template {t.phrase!r} has fewer than {k} words")
        rows += [(i, p, " ".join(w[p:p + k]), t.label, t.base, len(w), t.told_by) for p in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "tid int, tpos int, tgram string, label string, base boolean, t_words int, told_by array<int>")
    return df.withColumn("tkey", F.xxhash64("tgram"))


def hits(docs, templates=TEMPLATES, k=K, text="text", key="doc_id"):
    """Exact k-gram hits, and for each row of ``docs`` a header with ``tid`` null and its words in ``n_words``."""
    t = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    words = docs.select(
        F.col(key), F.xxhash64(F.col(text)).alias("text_key"), F.array_remove(F.split(t, NOT_WORD), "").alias("w"))
    # the header stands first, so places in the exploded array are one more than in the text
    grams = F.when(F.size("w") >= k, F.transform(
        F.sequence(F.lit(0), F.size("w") - k), lambda i: F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(k)])))
    rows = words.select(key, "text_key", F.size("w").cast("bigint").alias("n_words"), F.posexplode(
        F.concat(F.array(F.lit("")), F.coalesce(grams, F.array().cast("array<string>")))).alias("at", "gram"))
    found = rows.withColumn("gkey", F.xxhash64("gram")).join(
        F.broadcast(template_grams(docs.sparkSession, templates, k)),
        (F.col("gkey") == F.col("tkey")) & (F.col("gram") == F.col("tgram")), "left")
    return found.filter((F.col("at") == 0) | F.col("tid").isNotNull()).select(
        key, "text_key", "n_words", (F.col("at") - 1).cast("bigint").alias("pos"), "tid", "tpos", "label", "base", "t_words", "told_by")


def diagonals(found, k=K, key="doc_id"):
    """Votes by document, template and diagonal; ``exact`` where every gram of the template votes."""
    return (
        found.filter("tid IS NOT NULL").withColumn("diag", F.col("pos") - F.col("tpos"))
        .groupBy(key, "text_key", "tid", "diag")
        .agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"),
             F.first("label").alias("label"), F.first("base").alias("base"), F.first("t_words").alias("t_words"),
             F.first("told_by").alias("told_by"))
        .withColumn("exact", F.size("places") == F.col("t_words") - k + 1))


def spans(diags, k=K, band=BAND, coverage=COVERAGE, key="doc_id"):
    """Neighbouring diagonals merged; ``covered`` words of the template, ``verified`` where they are enough."""
    from pyspark.sql import Window

    by = Window.partitionBy(key, "text_key", "tid").orderBy("diag")
    new = F.coalesce(F.col("diag") - F.lag("diag").over(by) > band, F.lit(True)).cast("int")
    merged = diags.withColumn("new", new).withColumn("span", F.sum("new").over(by)).groupBy(key, "text_key", "tid", "span").agg(
        F.min("first").alias("first_word"), (F.max("last") + k).alias("end_word"),
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("t_words").alias("t_words"), F.first("told_by").alias("told_by"),
        F.max("exact").alias("exact"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1)))))
    out = merged.withColumns({
        "covered": F.size(words).cast("bigint"), "told": F.size(F.array_except("told_by", words)) == 0}).drop("places", "span", "told_by")
    share = F.col("covered") / F.greatest(F.col("t_words").cast("bigint"), F.when(F.col("exact"), F.col("covered")).otherwise(
        F.col("end_word") - F.col("first_word")))
    return out.withColumn("share", F.least(F.lit(1.0), share)).withColumn(
        "verified", F.col("exact") | (F.col("told") & (F.col("covered") >= coverage * F.col("t_words"))))


def _joined(labels):
    return F.array_join(F.array_sort(labels), ",")


def license_scan(docs, templates=TEMPLATES, k=K, band=BAND, coverage=COVERAGE, text="text", key="doc_id"):
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = landed(hits(docs, templates, k, text, key), "license-hits")
    ids = [key, "text_key"]
    d = diagonals(found, k, key)
    base = d.filter("base AND exact").groupBy(*ids).agg(
        F.count("*").alias("n_base"), F.min("diag").alias("first_word"), F.max("diag").alias("last_word"),
        _joined(F.collect_set("label")).alias("base_labels"))
    other = spans(d, k, band, coverage, key).groupBy(*ids).agg(
        _joined(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("labels"), F.max("share").alias("score"))
    heads = found.filter("tid IS NULL").groupBy(*ids, "n_words").agg(F.count("*").cast("int").alias("copies"))

    def on(right):
        return [F.col(f"h.{key}").eqNullSafe(F.col(f"{right}.{key}")), F.col("h.text_key") == F.col(f"{right}.text_key")]

    joined = heads.alias("h").join(base.alias("b"), on("b"), "left").join(other.alias("o"), on("o"), "left")
    return joined.select(
        F.col(f"h.{key}").alias(key), "h.n_words", F.coalesce("b.n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "b.first_word", "b.last_word", F.coalesce("b.base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("o.labels", F.lit("")).alias("labels"), F.coalesce("o.score", F.lit(0.0)).alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("h.copies"))).alias("_copy")).drop("_copy")
