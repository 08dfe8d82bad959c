"""Registered queries against their SQL, and the pipeline against its stages restated."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, duck
from tickerloom.llm import decontaminate, mixing, packing, quality, registry
from tickerloom.llm.common import landed, table

from . import helpers as H

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    ok, ours, theirs, note = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, f"{ours} rows against {theirs}: {note}"


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_html_query_covers_every_page(spark):
    got = entry.queries()["op3_html_text"](spark, SF)
    assert got.count() == table(spark, SF, "pages").count() and got.columns == ["page_id", "url", "text", "n_chars"]


def test_pipeline_stages(spark):
    docs = landed(table(spark, SF, "documents"), "test")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, landed(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == before.columns
        kept[name] = (before, docs)
    before, after = kept["quality"]
    scores = quality.score_quality(before, table(spark, SF, "labels"))
    assert sorted(r.doc_id for r in scores.filter("predicted = 1").collect()) == sorted(r.doc_id for r in after.collect())
    before, after = kept["near_duplicates"]
    alike = H.components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in alike})
    before, after = kept["decontamination"]
    found = {r.doc_id for r in decontaminate.contaminated(before, table(spark, SF, "benchmark")).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in found)
    before, after = kept["mixing"]
    words = lambda df: df.select(mixing.word_tokens().alias("n")).groupBy().sum("n").first()[0]
    assert words(after) <= words(before) and {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    texts = {r.doc_id: r.text for r in after.collect()}
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = packing.encoder()
    total = sum(len(library.encode_ordinary(r.text)) for r in after.collect())
    assert sum(p.n_tokens for p in packs) == total and {d for p in packs for d in p.doc_ids} == set(texts)
