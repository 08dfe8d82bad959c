"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one
failure bit per rule. Policies are versioned masks over these bits: applying one, or
asking what dropping one of its rules would change, never reads the text again.

Null texts count as empty: no words, all measurements 0, ``too_short`` fails. Repeated
documents get a row each; further columns of the input are ignored. An empty table gives
an empty ledger.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from .common import SPACE_CHARS, spaced_words

SYMBOLS = "#*$%&|<>"

#: Name and failure condition of each rule; the place in the list is its bit. Append only.
RULES = [
    ("too_short", lambda: F.col("n_words") < 50),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ("many_symbols", lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words")),
    ("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    ("upper_case", lambda: 100 * F.col("n_upper") > 60 * F.col("word_chars")),
    ("odd_word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 40 * F.col("n_words"))),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject; more than ``tolerated`` failures among them reject."""

    version: str
    rules: tuple
    tolerated: int = 0

    @property
    def mask(self):
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", ("too_short", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", (*BASE.rules, "many_symbols", "upper_case")),
    Policy("v2", tuple(BIT)),
)}


def _repeat_words(words):
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are sorted with their places, so equal ones are neighbours: n log n a document, no
    shuffle. The places kept are sorted again and each adds the words the next does not cover.
    """
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("at"))))
    return F.sort_array(F.coalesce(windows, F.array().cast("array<struct<w:string,at:int>>")))


def _repeated_places(ranked):
    same = F.filter(ranked, lambda x, i: x["w"].eqNullSafe(F.get(ranked, i - 1)["w"]) | x["w"].eqNullSafe(F.get(ranked, i + 1)["w"]))
    return F.sort_array(F.transform(same, lambda x: x["at"]))


def _covered(places):
    steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))).cast("bigint"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)


def measures(docs, text="text", key="doc_id"):
    """One row per document: ``key`` and the measurements, all of whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SPACE_CHARS, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    first = docs.select(
        F.col(key), spaced_words(F.col(text)).alias("words"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(bare) - F.length(F.regexp_replace(bare, r"\p{Lu}", ""))).cast("bigint").alias("n_upper"),
        lines.alias("lines"))
    second = first.select(
        key, F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("ranked"))
    third = second.withColumn("places", _repeated_places(F.col("ranked"))).drop("ranked")
    return third.withColumn("n_repeat_words", _covered(F.col("places"))).drop("places")


def ledger(docs, text="text", key="doc_id"):
    """Measurements and ``failed``, the bits of all rules a document fails."""
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measures(docs, text, key).withColumn("failed", failed)


def apply_policy(led, policy):
    """Add ``kept`` under a policy, from the bits alone."""
    return led.withColumn("kept", F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask))) <= policy.tolerated)


def ablations(led, policy):
    """For each rule of a policy: documents that fail it, that fail nothing else, and that stay without it.

    One aggregate over the bits; the result has a row per rule.
    """
    def stays(mask):
        return F.count_if(F.bit_count(F.col("failed").bitwiseAND(F.lit(mask))) <= policy.tolerated)

    names = [n for n in BIT if n in policy.rules]
    cells = [F.struct(
        F.lit(n).alias("rule"), F.count_if(F.col("failed").bitwiseAND(F.lit(BIT[n])) != 0).alias("n_fail"),
        F.count_if(F.col("failed").bitwiseAND(F.lit(policy.mask)) == BIT[n]).alias("n_only"),
        stays(policy.mask).alias("n_kept"), stays(policy.mask & ~BIT[n]).alias("n_kept_without")) for n in names]
    return led.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def quality_rules(docs, policy=POLICIES["v2"]):
    """The ledger with ``base_failed`` and ``kept`` (never true where the base rules fail)."""
    led = apply_policy(ledger(docs), policy)
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return led.withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~base)
