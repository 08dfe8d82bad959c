"""Plans: no row-level data in one task, no Python in relational queries, pruned scans."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# one row per week or per model, or a bounded list, by the time these meet in one task
BOUNDED = {"week_lead", "backtest_trades", "backtest_curve", "curve_with_index", "returns_vs_index", "top_pairs",
           "top_pairs_today", "buy_recommendations", "keyword_occurrences", "last_week_returns", "buy_date",
           "index_returns", "recent_closes", "topk_keyword_correlations", "discount_screen_page",
           "topk_keyword_correlations_across", "mention_chart", "mention_chart_return", "backtest_predictions",
           "pair_correlation", "backtest_chain_trades", "backtest_chain_curve",
           "backtest_chain_returns_vs_index", "allocation_chain_returns", "backtest_trades_display"}

# these run jobs while they are built and end in a scan of what those wrote; their steps have tests below and of their own
STEPWISE = ("decision_tree", "random_forest", "landed_", "refresh_", "append_twice", "replace_table")
# the optional subpackage has tests of its own
OWN = {n[2:] for n in vars(entry) if n.startswith("q_") and not any(part in n for part in STEPWISE)}


@pytest.mark.parametrize("name", sorted(OWN))
def test_plan_shape(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert name in BOUNDED or "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["weekly_prices"](spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate" in text and "l_tax" not in text
    text = plan(entry.queries()["keyword_weekly_counts"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_broadcast_needs_a_bound(spark):
    from tickerloom.operators.joins import BROADCAST_ROWS, broadcast_if_bounded
    a = spark.range(10)
    assert "ResolvedHint" in str(broadcast_if_bounded(a, 10)._jdf.queryExecution().analyzed()) 
    for bound in (None, BROADCAST_ROWS + 1):
        assert "ResolvedHint" not in str(broadcast_if_bounded(a, bound)._jdf.queryExecution().analyzed())


def test_any_number_of_keywords_takes_one_pass_and_one_exchange(spark):
    from checks.oracles import LONG_KEYWORDS
    from tickerloom.plans.keywords import keyword_weekly_counts
    from tickerloom.sources import derived as D
    for keywords in (LONG_KEYWORDS[:3], LONG_KEYWORDS):
        text = plan(keyword_weekly_counts(D.filings(spark, SF), keywords))
        assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "Python" not in text
        # a text is lower-cased and searched once, whatever the number of keywords
        assert text.count("regexp_extract_all") == 2


def test_all_windows_of_a_tree_level_share_one_exchange(spark):
    from tickerloom.operators import lineage, trees
    rows = spark.range(4000).selectExpr(
        "id % 7 AS _group", "0 AS _tree", "id AS _row", "if(id < 7, 0D, 1D) AS _w", "rand(1) AS f0", "rand(2) AS f1", "rand(3) AS _y")
    state = lineage.checkpointed(rows.selectExpr("*", "0L AS _node", "0L AS _level", "CAST(NULL AS DOUBLE) AS predicted"))
    text = plan(trees._grown(state, ["f0", "f1"], False))
    assert text.count("Exchange") == 1 and "Python" not in text and "Join" not in text
