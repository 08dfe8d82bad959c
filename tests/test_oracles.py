"""Every registered query against its DuckDB twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
OWN = {n[2:] for n in vars(entry) if n.startswith("q_")}  # the optional subpackage has tests of its own
QUERIES, TWINS = {n: q for n, q in entry.queries().items() if n in OWN}, entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in TWINS:
        ok, ours, theirs, note = compare(spark, con, QUERIES[name], TWINS[name], SF)
        assert ok, f"{ours} rows against {theirs}: {note}"
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_every_query_has_a_twin():
    assert not set(QUERIES) - set(TWINS)


def test_entry_has_a_stable_schema(spark):
    assert "correlation" in entry.entry(spark).columns
