"""Documents to packed training rows: five stages, each one operator over all that the one before kept."""

from tickerloom.llm import decontaminate, jaccard_join, mixing, packing, quality
from tickerloom.llm.common import landed, small_batches, table
from tickerloom.llm.registry import MIX_TREE, MIX_WEIGHTS, mix_nodes


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier scores 0.5 or more."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each component of texts whose 5-word shingles are 0.75 alike or more."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the weights ask for, at most twice, as many words in all as there were."""
    return mixing.mix(docs, MIX_WEIGHTS, tree=MIX_TREE, nodes=mix_nodes(), seed=1, max_epochs=2).select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    """Rows of 2,048 token ids."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no word for the classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
