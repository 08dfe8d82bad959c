"""The operators' queries and their SQL, for the entry module."""

from pyspark.sql import functions as F

from . import collocations, decontaminate, html_text, jaccard_join, licenses, mixing, packing, private, quality, rules, token_counts, toxicity, whitening
from .common import table
from .oracles import ORACLES


#: Weights among siblings; the tree is domain (sources in four groups), language, source.
MIX_TREE = ("domain", "lang", "source")
MIX_WEIGHTS = {
    ("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1,
    **{(f"d{i}", lang): w for i in range(4) for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))},
}


def mix_nodes():
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)", 1)
    domain = F.concat(F.lit("d"), F.when(number == "", 0).otherwise(F.right(number, F.lit(9)).cast("bigint") % 4).cast("string"))
    return [domain, F.col("lang"), F.col("source")]


def op1_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n_tokens", mixing.word_tokens())
    out = mixing.mix(docs, MIX_WEIGHTS, tree=MIX_TREE, nodes=mix_nodes(), tokens=F.col("n_tokens"), seed=1, max_epochs=2)
    return out.select("doc_id", "epoch", "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget")


def op2_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_packed_ids(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_rule_ledger(spark, sf_dir):
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("failed").alias("failed_bits"))


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_private_data(spark, sf_dir):
    return private.find_private(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: fn for name, fn in globals().items() if name.startswith("op")} | {"pipeline": pipeline}


def oracle_sql():
    return dict(ORACLES)
