"""Hand tables for the semantic traps; expected values worked out by hand."""

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions import scalars as S
from tickerloom.functions.text import between_items, heading_pieces, html_to_text, main_document, piece_items
from tickerloom.operators import filters, joins, ranking, setops, windows
from tickerloom.plans import backtest, correlation, fundamentals, keywords, pairs, recommend, weekly

MONDAY = date(2001, 1, 1)


def weeks(n):
    return [MONDAY + timedelta(weeks=i) for i in range(n)]


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def filings(spark, rows):
    full = [("c", t, str(i), a, b, f"u{i}", d) for i, (t, a, b, d) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FILINGS)


def test_weekly_open_and_close_with_equal_days(spark):
    rows = [("A", "sp", MONDAY, 5.0, 6.0, 1.0), ("A", "sp", MONDAY, 4.0, 7.0, 1.0),
            ("A", "sp", MONDAY + timedelta(1), 9.0, 8.0, 1.0)]
    for parts in (1, 3):
        df = weekly.weekly_prices(spark.createDataFrame(rows, schemas.PRICES).repartition(parts))
        assert values(df, "week_open_price", "week_close_price") == [(4.0, 8.0)]
    one = spark.createDataFrame([rows[0], rows[2]], schemas.PRICES)
    assert weekly.weekly_prices(one, unique_times=True).collect() == weekly.weekly_prices(one).collect()


def test_keyword_flags_are_case_insensitive_substrings_and_null_safe(spark):
    f = filings(spark, [("10-K", "software", None, MONDAY), ("10-K", "WAR", None, MONDAY),
                        ("10-K", "Cloud", "cloud", MONDAY), ("10-K", None, None, MONDAY)])
    for words in (["war", "cloud", "none"], ["war", "cloud", "none"] + [f"zz{i}" for i in range(120)]):
        got = {r["keyword"]: (r["keyword_mentions"], r["total_filings"])
               for r in keywords.keyword_weekly_counts(f, words).collect()}
        assert len(got) == len(words)
        assert (got["war"], got["cloud"], got["none"]) == ((2, 4), (1, 4), (0, 4))


def test_occurrences_are_case_sensitive(spark):
    f = filings(spark, [("10-K", "war warwar War", None, MONDAY), ("10-K", None, None, MONDAY)])
    assert values(keywords.keyword_occurrences(f, ["war", "peace"]), "keyword", "keyword_count") == [("war", 3)]


def test_rolling_restarts_per_symbol_but_not_across(spark):
    rows = [(s, w, float(i + (100 if s == "B" else 0))) for s in "AB" for i, w in enumerate(weeks(15))]
    df = spark.createDataFrame(rows, "stock_symbol string, week date, rate double").withColumn("g", F.lit(1))
    own = windows.trailing_mean(df, ["stock_symbol"], ["week"], "rate", "own")
    both = windows.trailing_mean_across_series(own, ["g"], ["stock_symbol"], ["week"], "rate", "across")
    differ = both.filter(F.abs(F.col("own") - F.col("across")) > 1e-9)
    assert sorted(values(differ, "stock_symbol", "week")) == [("B", w) for w in weeks(12)]


@pytest.mark.parametrize("lengths", [(3, 1, 2, 20), (1,) * 15, (14, 2, 30)])
def test_across_series_equals_one_global_window(spark, lengths):
    from pyspark.sql import Window
    rows = [(f"S{k:02d}", i, float((k * 7 + i * 3) % 11)) for k, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i int, v double").withColumn("g", F.lit(1)).repartition(5)
    got = windows.trailing_mean_across_series(df, ["g"], ["s"], ["i"], "v", "m")
    want = df.withColumn("w", F.avg("v").over(Window.partitionBy("g").orderBy("s", "i").rowsBetween(-12, 0)))
    joined = got.join(want, ["s", "i"])
    assert joined.count() == len(rows)
    assert joined.filter(F.abs(F.col("m") - F.col("w")) > 1e-12).count() == 0


def test_flat_and_single_row_series_have_no_correlation(spark):
    rows = [("flat", 5.0, float(i)) for i in range(14)] + [("one", 1.0, 1.0)] + [("up", float(i), 2.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = dict(values(df.groupBy("s").agg(S.safe_corr("x", "y").alias("c")), "s", "c"))
    assert got["flat"] is None and got["one"] is None and got["up"] == pytest.approx(1.0)


def brute_grid(week_rows, rates, starts, as_of, lag):
    """Plain restatement of the grid for one symbol, keyword and type."""
    import numpy as np
    out = {}
    for start in starts:
        kept = [(w, p, rates[w - timedelta(weeks=lag)]) for w, p in week_rows
                if start <= w <= as_of and w - timedelta(weeks=lag) in rates]
        y = [np.mean([r for _, _, r in kept[max(0, i - 12): i + 1]]) for i in range(len(kept))]
        x = [p for _, p, _ in kept]
        if len(x) > 1 and np.std(x) > 0 and np.std(y) > 1e-12:
            out[start] = np.corrcoef(x, y)[0, 1]
    return out


def test_grid_equals_brute_force_with_gaps(spark):
    import random
    rng = random.Random(7)
    all_weeks = weeks(70)
    closes = [(w, rng.uniform(5, 50)) for w in all_weeks if rng.random() > 0.3 and not 20 < (w - MONDAY).days // 7 < 29]
    totals = {w: (rng.randint(0, 9), 10) for w in all_weeks if rng.random() > 0.2}
    wk = spark.createDataFrame([("A", w, p, p) for w, p in closes], schemas.WEEKLY_PRICES)
    cn = spark.createDataFrame([(w, "10-K", "ion", m, t) for w, (m, t) in totals.items()], schemas.KEYWORD_WEEKLY_COUNTS)
    starts = [date(2001, m, 1) for m in range(1, 13)]
    as_of = date(2002, 4, 1)
    st = spark.createDataFrame([(s,) for s in starts], "start_date date")
    grid = correlation.correlation_grid(wk, cn, st, "2001-01-01", as_of, [2], ["ion"], ["10-K"], min_days=0)
    got = dict(values(grid, "start_date", "correlation"))
    want = brute_grid(closes, {w: m / t for w, (m, t) in totals.items()}, starts, as_of, 2)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-9)
    # the back-fill form gives the same number when its end is the last week
    ends = correlation.backfill_grid(wk, cn, st, "2001-01-01", as_of, "2001-06-01", [2], ["ion"], ["10-K"])
    for r in ends.collect():
        again = brute_grid(closes, {w: m / t for w, (m, t) in totals.items()}, [r["start_date"]], r["end_date"], 2)
        assert r["correlation"] == pytest.approx(again[r["start_date"]], abs=1e-9)


def test_top_scores_rank_before_rounding_and_settle_ties(spark):
    rows = [("B", 0.50001), ("A", 0.50002), ("C", 0.1), ("D", 0.1)]
    df = spark.createDataFrame(rows, "stock_symbol string, correlation double").withColumns({
        "start_date": F.lit(MONDAY), "end_date": F.lit(MONDAY), "time_delay": F.lit(1),
        "keyword": F.lit("k"), "filing_type": F.lit("10-K")})
    got = values(correlation.top_scores(df, "desc", 3), "stock_symbol", "correlation")
    assert sorted(got) == [("A", 0.5), ("B", 0.5), ("C", 0.1)]


def test_interpolation_keeps_leading_and_carries_trailing(spark):
    rows = [(i, v) for i, v in enumerate([None, 10.0, None, 20.0, None])]
    df = spark.createDataFrame(rows, "i int, v double").withColumn("s", F.lit("a"))
    got = windows.interpolate_linear(df, ["s"], ["i"], ["v"]).orderBy("i")
    assert [r["v"] for r in got.collect()] == [None, 10.0, 15.0, 20.0, 20.0]


def test_value_weeks_ahead_needs_the_exact_week(spark):
    w = weeks(5)
    df = spark.createDataFrame([("a", w[0], 1.0), ("a", w[1], 2.0), ("a", w[4], 5.0)], "s string, w date, v double")
    got = windows.value_weeks_ahead(df, ["s"], "w", 1, {"v": "n"}).orderBy("w")
    assert [r["n"] for r in got.collect()] == [2.0, None, None]


def test_asof_forward_with_and_without_fallback(spark):
    peak = spark.createDataFrame([("sp", "A", MONDAY), ("sp", "B", MONDAY)], "universe string, stock_symbol string, d date")
    r = spark.createDataFrame(
        [("sp", "A", MONDAY, "1"), ("sp", "A", MONDAY + timedelta(90), "2"), ("sp", "A", MONDAY + timedelta(180), "3"),
         ("sp", "B", MONDAY - timedelta(90), "4")], "universe string, stock_symbol string, f date, v string")
    key = ["universe", "stock_symbol"]
    plain = dict(values(joins.asof_forward(peak, r, key, "d", "f", ["v"]), "stock_symbol", "peak_v"))
    back = dict(values(joins.asof_forward(peak, r, key, "d", "f", ["v"], True), "stock_symbol", "peak_v"))
    assert plain == {"A": "2", "B": None} and back == {"A": "2", "B": "4"}


def test_screen_does_not_fan_out_and_zero_ebitda_gives_null(spark):
    p = [(s, u, MONDAY + timedelta(i), c, c, 1.0) for s, u in (("A", "sp"), ("A", "russell")) for i, c in enumerate((10.0, 8.0))]
    prices = spark.createDataFrame([r for r in p], schemas.PRICES)
    names = spark.createDataFrame([("A", "Alpha")], schemas.SYMBOL_NAMES)
    sectors = spark.createDataFrame([("A", u, "tech", "1", "2") for u in ("sp", "russell")], schemas.SECTORS)
    rep = spark.createDataFrame(
        [("A", u, MONDAY - timedelta(5), e, "100", "50", "10", "1") for u, e in (("sp", "0"), ("russell", "None"))],
        "stock_symbol string, universe string, fiscal_date date, ebitda string, total_assets string, total_cash string, "
        "shares_outstanding string, reported_eps string")
    out = fundamentals.discount_screen(
        prices, names, sectors, fundamentals.balance_asof(prices, rep), fundamentals.income_asof(prices, rep))
    rows = out.collect()
    assert len(rows) == 2
    for r in rows:
        assert r["peak_ps"] is None and r["peak_eps"] == 0.0 and r["peak_pe"] is None
        assert r["price_change"] == pytest.approx(-0.2) and r["days_since_peak"] == 1
    page, message = fundamentals.screen_page(out, low=1, high=0, groups=["EPS Data"])
    assert message and page.columns == ["eps_change", "peak_eps", "recent_eps"]
    assert fundamentals.screen_display(fundamentals.screen_page(out)[0]).columns[0] == "Company Name"
    assert fundamentals.unit_text("pe_change").startswith("%") and fundamentals.unit_text("peak_pe") == "Number"


def test_portfolio_compounds_in_week_order(spark):
    trades = spark.createDataFrame(
        [("m", w, f"S{i}", "k", 1, "10-K", 10.0, 11.0, 0.1, "buy recommended", 10.0 - 0.03, sell + 0.03)
         for i, (w, sell) in enumerate(zip(weeks(3), (11.0, 5.0, 12.0)))],
        "model_type string, week_to_buy date, stock_symbol string, keyword string, time_delay int, filing_type string, "
        "current_close_price double, predicted_price double, predicted_change double, recommendation string, "
        "buy_open_price double, buy_close_price double").repartition(3)
    got = backtest.backtest_curve(trades).orderBy("week_of_purchases").collect()
    assert [round(r["portfolio_value"], 6) for r in got] == [1100.0, 550.0, 660.0]


def test_allocation_spends_the_principal(spark):
    recs = spark.createDataFrame(
        [(MONDAY, 10.0, 11.0, "A", "k"), (MONDAY, 10.0, 13.0, "B", "k"), (MONDAY, 10.0, 10.1, "C", "k"), (MONDAY, 10.0, 20.0, "SBNY", "k")],
        "previous_weekly_open_date date, previous_weekly_close_price double, predicted_weekly_close_price double, stock_symbol string, keyword string")
    got = recommend.buy_allocation(recs, 1000, MONDAY)
    spent = got.agg(F.sum(F.col("number_of_shares_to_purchase") * F.col("previous_weekly_close_price"))).first()[0]
    assert sorted(r["stock_symbol"] for r in got.collect()) == ["A", "B"] and spent == pytest.approx(1000, abs=0.2)
    shown = recommend.allocation_display(got).filter("stock_symbol = 'A'").first()
    assert (shown["predicted_growth"], shown["principal_amount"]) == ("10%", "$1,000.00")


def test_comovement_null_label_counts_in_the_denominator(spark):
    df = spark.createDataFrame([("u", "u"), ("u", "d"), (None, None), ("d", "d")], "a string, b string")
    assert df.agg(S.match_rate("a", "b")).first()[0] == 0.5


def test_top_pairs_exclusions(spark):
    old = date(2000, 1, 1)
    rows = [("A", "k", "10-K", 1, old, MONDAY, 0.9, "direct"), ("A", "k", "10-K", 2, old, MONDAY, -0.95, "inverse"),
            ("B", "k", "10-K", 8, old, MONDAY, 0.99, "direct"), ("C", "k", "10-K", 1, old, MONDAY, 1.0, "direct"),
            ("DDOG", "k", "10-K", 1, old, MONDAY, 0.8, "direct"), ("D", "k", "10-K", 1, MONDAY, MONDAY, 0.8, "direct"),
            ("E", "cryptocurrency", "10-K", 1, old, MONDAY, 0.8, "direct"), ("F", "k", "10-K", 1, old, MONDAY, None, "direct")]
    scores = spark.createDataFrame(rows, schemas.CORRELATION_SCORES)
    got = pairs.top_pairs(scores, MONDAY)
    assert values(got, "stock_symbol", "correlation") == [("A", -0.95)]
    assert pairs.top_pairs_today(got).first()["correlation"] == "-95.00%"


def test_dates_and_rounding(spark):
    df = spark.createDataFrame([(date(2023, 3, 3),), (date(2023, 3, 6),), (date(2023, 3, 5),)], "d date")
    got = df.select(S.same_or_next_monday("d"), S.same_or_previous_friday("d"), S.packed_date("d")).collect()
    assert [tuple(r) for r in got] == [
        (date(2023, 3, 6), date(2023, 3, 3), 20230303), (date(2023, 3, 6), date(2023, 3, 3), 20230306),
        (date(2023, 3, 6), date(2023, 2, 24), 20230305)]
    n = spark.createDataFrame([(2.5,), (3.5,), (-0.5,)], "x double").select(S.half_even("x", 0)).collect()
    assert [r[0] for r in n] == [2.0, 4.0, 0.0]
    t = spark.createDataFrame([("2020-01-02",), ("bad",)], "x string").select(S.parse_date("x")).collect()
    assert [r[0] for r in t] == [date(2020, 1, 2), None]


def test_optional_predicates_and_lists(spark):
    df = spark.createDataFrame([(i, f"S{i}", i) for i in range(5)], "n int, stock_symbol string, position int")
    assert filters.all_of(df, filters.equals("n", ""), filters.within("n", None, 3), filters.none_of("n", [1])).count() == 3
    assert filters.checked_range(2, 1)[:2] == (None, None)
    assert ranking.resume_after(df, "S2").count() == 2 and ranking.resume_after(df, "").count() == 5
    assert setops.concat_rows(df, df.select("n")).count() == 10
    assert joins.not_in(df, df.filter("n > 1"), "n").count() == 2


def test_sections_take_the_last_heading_and_document(spark):
    text = ("<DOCUMENT>\n<TYPE>10-K\nold\n</DOCUMENT><DOCUMENT>\n<TYPE>10-K\n<p>Item 7. toc</p><p>Item 7A. toc</p>"
            "<p>Item 7. real</p>body<p>Item 7A. end</p>\n</DOCUMENT><DOCUMENT>\n<TYPE>EX\n</DOCUMENT>")
    df = spark.createDataFrame([(text,)], "t string").select(main_document("t", "10-K").alias("d"))
    d = df.first()["d"]
    assert "old" not in d
    cut = df.select("d", heading_pieces("d").alias("p")).withColumn("i", piece_items("p"))
    got = cut.select(F.array_join("p", ""), between_items("p", "i", "7", "7A"), between_items("p", "i", "1A", "7"), between_items("p", "i", "7A", "7")).first()
    assert tuple(got) == (d, d[d.rindex(">Item 7. real"):d.rindex(">Item 7A")], None, "")


def plain_section(document, first, until):
    """Text between the last headings of two items by searching for each spelling; 7 must not go on with A."""
    def last(item):
        places = [m.start() for h in (">Item {}", ">Item&#160;{}", ">Item&nbsp;{}", "ITEM {}")
                  for m in re.finditer(re.escape(h.format(item)) + ("(?!A)" if item == "7" else ""), document)]
        return max(places, default=None)

    a, z = last(first), last(until)
    return None if a is None or z is None else document[a:max(a, z)]


def test_segmentation_matches_a_search_for_each_heading(spark):
    import random
    rnd = random.Random(11)
    bits = [">Item 1A", ">Item&#160;1B.", ">Item&nbsp;2", "ITEM 7", "ITEM 7A", ">Item 7B", ">Item 20", ">Item 1", "Item 7", "ITEM 1A", " text ", "é", ">", "ITEM ", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    cut = spark.createDataFrame([(t,) for t in texts], "d string").select("d", heading_pieces("d").alias("p")).withColumn("i", piece_items("p"))
    pairs = [("1A", "1B"), ("1A", "2"), ("7", "7A")]
    for r in cut.select("d", *[between_items("p", "i", *x) for x in pairs]).collect():
        assert list(r[1:]) == [plain_section(r["d"], *x) for x in pairs], r["d"]


def test_html_text(spark):
    html = "<p>a &amp; b</p>\n<!-- x > y --><script>if (a<b) {}</script><div><b>c</b></div><i"
    got = spark.createDataFrame([(html,)], "h string").select(html_to_text("h")).first()[0]
    assert got == "a & b\n\n\n\n\nc"


def test_many_keywords_in_one_pass_match_one_search_each(spark):
    import random

    from tickerloom.plans.keywords import keyword_occurrences, keyword_weekly_counts
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["war", "Warn", "ing", "a.b", " ", "supply chain", "aa", "a", "été", "|", "(x)", "\\", "\U0001F642", "W"]) for _ in range(30)) for _ in range(60)]
    rows = [("2001-01-01", "10-K", f"u{i}", t, texts[-i] if i % 3 else None) for i, t in enumerate(texts)] + [("2001-01-02", "10-Q", "u", None, None)]
    df = spark.createDataFrame(rows, "d string, filing_type string, filing_url string, risk_factors string, risk_disclosures string").withColumn("filing_date", F.to_date("d"))
    words = ["war", "warn", "warning", "arn", "a.b", "supply chain", "chain", "aa", "aaa", "a", "É", "|", "(x)", "\\", "\U0001F642", "nowhere", "war", "", "W"]
    got = {(r["filing_type"], r["keyword"]): (r["keyword_mentions"], r["total_filings"]) for r in keyword_weekly_counts(df, words).collect()}
    for kind in ("10-K", "10-Q"):
        mine = [r for r in rows if r[1] == kind]
        for w in words:
            hit = sum(any(t is not None and w.lower() in t.lower() for t in r[3:5]) for r in mine)
            assert got[kind, w] == (hit, len(mine)), w
    counts = {r["keyword"]: r["keyword_count"] for r in keyword_occurrences(df, words).collect()}
    assert counts == {w: n for w in set(words) if w and (n := sum((r[3] or "").count(w) for r in rows))}


@pytest.mark.parametrize("direction, strict", [("forward", True), ("forward", False), ("backward", True), ("backward", False)])
@pytest.mark.parametrize("bucket", ["week", "year"])
def test_asof_merge_matches_a_search_a_fact(spark, direction, strict, bucket):
    import random
    rnd = random.Random(hash((direction, strict)) % 1000)
    start = date(2001, 1, 1)
    days = [start + timedelta(days=i) for i in range(0, 500)]
    # one key holds most facts; dates tie, repeat and are missing
    facts = [(rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([*days, None]), i) for i in range(300)]
    reports = [(rnd.choice(["a", "b", None]), rnd.choice([*days, None]), rnd.choice([None, 1, 2, 3])) for _ in range(60)] + [("d", days[0], 1)]
    got = joins.asof_merge(
        spark.createDataFrame(facts, "k string, day date, i int").repartition(5), spark.createDataFrame(reports, "k string, rd date, v int"),
        "k", "day", "rd", ["v"], direction, strict, bucket)
    tag = "next_" if direction == "forward" else "last_"
    found = {r["i"]: (r["k"], r["day"], r[tag + "rd"], r[tag + "v"]) for r in got.collect()}
    assert len(found) == len(facts)
    for k, day, i in facts:
        mine = [(rd, v) for rk, rd, v in reports if k is not None and rk == k and rd is not None and day is not None
                and (rd == day and not strict or (rd > day if direction == "forward" else rd < day))]
        near = (min if direction == "forward" else max)((rd for rd, _ in mine), default=None)
        values = [v for rd, v in mine if rd == near]
        assert found[i] == (k, day, near, max((v for v in values if v is not None), default=None)), (k, day)


def test_range_correlations_match_one_series_a_range(spark):
    import random

    import numpy as np
    rnd = random.Random(4)
    rows = []
    for symbol in "AB":
        for w in range(90):
            if rnd.random() < 0.8:  # weeks are missing
                rows.append((symbol, "k", "10-K", 1, date(2000, 1, 3) + timedelta(weeks=w), 5.0 if symbol == "B" and w < 60 else rnd.uniform(1, 9), rnd.choice([0.0, 0.25, 0.5])))
    df = spark.createDataFrame(rows, "stock_symbol string, keyword string, filing_type string, time_delay int, week_opening_date date, week_close_price double, mention_rate double")
    got = {(r["stock_symbol"], r["start_date"], r["end_date"]): r["correlation"] for r in correlation.correlations_by_range(
        df, "2000-01-01", "2001-09-30", "2000-07-01", 180, 365).collect()}
    seen = 0
    for symbol in "AB":
        mine = [r for r in rows if r[0] == symbol]
        for month in range(21):
            s = date(2000 + month // 12, month % 12 + 1, 1)
            for w in range(93):
                e = date(2000, 1, 3) + timedelta(weeks=w)
                part = [r for r in mine if s <= r[4] <= e]
                if not (180 <= (e - s).days <= 365 and e >= date(2000, 7, 1) and part and e >= mine[0][4]):
                    continue
                x = np.array([r[5] for r in part])
                y = np.array([np.mean([q[6] for q in part[max(0, i - 12):i + 1]]) for i in range(len(part))])
                if e <= date(2001, 9, 30) and (symbol, s, e) in got:
                    want = None if x.std() <= 1e-12 * abs(x.mean()) or y.std() <= 1e-12 else np.corrcoef(x, y)[0, 1]
                    assert (got[symbol, s, e] is None) == (want is None)
                    assert want is None or got[symbol, s, e] == pytest.approx(want, abs=1e-9)
                    seen += 1
    assert seen == len(got) and seen > 300 and any(v is None for v in got.values())


def test_grids_in_tasks_match_the_joined_rows(spark, monkeypatch):
    import random

    from tickerloom.operators import correlate
    rnd, words, kinds, lags = random.Random(5), ["ion", "war"], ["10-K", "10-Q"], [1, 4]
    closes = [(s, w, 1.0, None if s == "B" and rnd.random() < 0.1 else 5.0 if s == "C" else rnd.uniform(1, 9))
              for s in ["A", "B", "C", "D", None] for w in weeks(80) if rnd.random() < 0.8]
    # one keyword has rows in weeks where the other has none
    counted = [(w, t, k, rnd.randint(0, 3), 4) for w in weeks(80) for t in kinds for k in words if rnd.random() < (0.9 if k == "ion" else 0.7)]
    wk, cn = spark.createDataFrame(closes, schemas.WEEKLY_PRICES), spark.createDataFrame(counted, schemas.KEYWORD_WEEKLY_COUNTS)
    starts = spark.createDataFrame([(date(2001, m, 1),) for m in range(1, 13)], "start_date date")
    since, as_of, key = "2001-01-01", "2002-06-30", [*correlation.SERIES, "start_date", "end_date"]
    series = correlation.lagged_mentions(wk, cn, lags, words, kinds, since, as_of)

    def same(grid, plain):
        got, want = ({tuple(r[c] for c in key): r["correlation"] for r in df.collect()} for df in (grid, plain))
        assert got.keys() == want.keys() and len(want) > 50
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        return want

    for chunk in (1, 100_000):  # symbols of a task one by one, or together
        monkeypatch.setattr(correlate, "CHUNK_ROWS", chunk)
        plain = correlation.correlations_by_start(series, since).filter("correlation IS NOT NULL").join(starts, "start_date", "left_semi")
        plain = plain.filter("start_date <= date'2002-01-01'").withColumn("end_date", F.to_date(F.lit(as_of)))
        same(correlation.correlation_grid(wk, cn, starts, since, as_of, lags, words, kinds), plain)
        plain = correlation.correlations_by_range(series, since, as_of, "2001-06-01").filter("correlation IS NOT NULL")
        plain = plain.join(wk.select(F.col("week_opening_date").alias("end_date")).distinct(), "end_date", "left_semi").join(starts, "start_date", "left_semi")
        same(correlation.backfill_grid(wk, cn, starts, since, as_of, "2001-06-01", lags, words, kinds), plain)


def test_rows_left_out_by_tasks_change_no_ranking(spark):
    rows = [(f"S{i:02d}", w, 1.0, float((i * i * 7 + k * (i % 5 + 3)) % 13)) for i in range(40) for k, w in enumerate(weeks(60))]
    rows += [(f"T{r[0]}", *r[1:]) for r in rows]  # equal scores under other symbols
    wk = spark.createDataFrame(rows, schemas.WEEKLY_PRICES)
    cn = spark.createDataFrame([(w, "10-K", "ion", k * 5 % 7, 7) for k, w in enumerate(weeks(60))], schemas.KEYWORD_WEEKLY_COUNTS)
    starts = spark.createDataFrame([(date(2001, m, 1),) for m in range(1, 7)], "start_date date")

    def grid(best):
        return correlation.correlation_grid(wk, cn, starts, "2001-01-01", "2002-03-01", [1, 2], ["ion"], ["10-K"], best=best)

    for direction in ("desc", "asc", "both"):
        every, kept = grid(None), grid((2, direction))
        order = [*correlation.COMBINATION, "stock_symbol", "correlation"]
        best = [sorted(values(correlation.top_scores(df, direction, 2), *order)) for df in (every, kept)]
        assert best[0] == best[1] and len(best[0]) == 24 * (2 if direction == "both" else 1)
        assert kept.count() < every.count()


def test_closes_are_shuffled_before_they_meet_keywords_and_lags(spark):
    wk = spark.createDataFrame([("A", MONDAY, 1.0, 2.0)], schemas.WEEKLY_PRICES)
    cn = spark.createDataFrame([(MONDAY, "10-K", "ion", 1, 2)], schemas.KEYWORD_WEEKLY_COUNTS)
    starts = spark.createDataFrame([(MONDAY,)], "start_date date")
    text = correlation.correlation_grid(wk, cn, starts, "2001-01-01", "2002-03-01", [1, 2], ["ion"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 1 and "Window" not in text
    scores = spark.range(3).selectExpr("'A' stock_symbol", "'k' keyword", "'10-K' filing_type", "1 time_delay", "date'2001-01-01' start_date",
                                       "date'2001-10-01' end_date", "0.5D correlation", "if(id = 0, 'direct', 'inverse') direction")
    for best in (pairs.top_pairs(scores, "2002-03-01"), pairs.top_pairs_by_end_date(scores, "2002-03-01")):
        assert best._jdf.queryExecution().executedPlan().toString().count("Range") == 1


def test_rolling_mentions_in_tasks_match_the_joined_rows(spark, monkeypatch):
    import random

    from tickerloom.operators import correlate
    rnd = random.Random(6)
    closes = [(s, w, 1.0, None if rnd.random() < 0.1 else rnd.uniform(1, 9)) for s in ["A", "B", None] for w in weeks(40) if rnd.random() < 0.8]
    counted = [(w, t, k, rnd.randint(0, 3), rnd.choice([0, 4])) for w in weeks(40) for t in ("10-K", "10-Q") for k in ("ion", "war") if rnd.random() < 0.8]
    wk, cn = spark.createDataFrame(closes, schemas.WEEKLY_PRICES), spark.createDataFrame(counted, schemas.KEYWORD_WEEKLY_COUNTS)
    rows = correlation.lagged_mentions(wk, cn, [1, 3])
    want = windows.trailing_mean(rows, correlation.SERIES, ["week_opening_date"], "mention_rate", "mention_rolling_avg")
    for chunk in (1, 100_000):  # symbols of a task one by one, or together
        monkeypatch.setattr(correlate, "CHUNK_ROWS", chunk)
        got = correlation.rolling_mentions(wk, cn, [1, 3])
        assert got.columns == want.columns and got.count() == want.count() > 100
        assert got.exceptAll(want).count() == 0 and got.exceptAll(want).count() == 0
        assert got._jdf.queryExecution().executedPlan().toString().count("Window") == 0


def test_chosen_pairs_are_computed_once(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    for name in ("buy_recommendations", "backtest_chain_returns_vs_index"):
        text = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Scan ExistingRDD" in text and "MapInArrow" not in text


def test_shares_of_a_small_table_are_joined_and_leave_out_more(spark, monkeypatch):
    from tickerloom.operators import correlate
    rows = [(f"S{i:02d}", w, 1.0, float((i * i * 7 + k * (i % 5 + 3)) % 13 + i / 100)) for i in range(40) for k, w in enumerate(weeks(60))]
    wk = spark.createDataFrame(rows, schemas.WEEKLY_PRICES)
    cn = spark.createDataFrame([(w, "10-K", "ion", k * 5 % 7, 7) for k, w in enumerate(weeks(60))], schemas.KEYWORD_WEEKLY_COUNTS)
    starts = spark.createDataFrame([(date(2001, 1, 1),)], "start_date date")

    def grid(best):
        return correlation.correlation_grid(wk, cn, starts, "2001-01-01", "2002-03-01", [1], ["ion"], ["10-K"], best=best)

    order = [*correlation.COMBINATION, "stock_symbol", "correlation"]
    want = values(correlation.top_scores(grid(None), "both", 3), *order)
    assert sorted(values(correlation.top_scores(grid((3, "both")), "both", 3), *order)) == sorted(want)
    assert grid((3, "both")).count() == 6  # four shares apart left out none but their own, 24 rows
    monkeypatch.setattr(correlate, "CHUNK_ROWS", 300)  # what earlier chunks found leaves out rows of later ones
    assert grid((3, "both")).count() < 30
    assert sorted(values(correlation.top_scores(grid((3, "both")), "both", 3), *order)) == sorted(want)


def test_means_across_symbols_in_tasks_match_the_joined_rows(spark, monkeypatch):
    import random

    from tickerloom.operators import correlate
    rnd = random.Random(8)
    # symbols of one or two weeks between long ones, a flat one, weeks without prices, rates or filings
    lengths = {"A": 40, "B": 1, "C": 2, "D": 1, "E": 30, "F": 1, "G": 40, "H": 3}
    closes = [(s, w, 1.0, None if rnd.random() < 0.1 else 5.0 if s == "E" else rnd.uniform(1, 9)) for s, n in lengths.items() for w in weeks(n) if n < 4 or rnd.random() < 0.8]
    counted = [(w - timedelta(weeks=2), t, k, rnd.randint(0, 3), rnd.choice([0, 4])) for w in weeks(42) for t in ("10-K", "10-Q") for k in ("ion", "war")
               if rnd.random() < (0.9 if k == "ion" else 0.5)]
    wk, cn = spark.createDataFrame(closes, schemas.WEEKLY_PRICES), spark.createDataFrame(counted, schemas.KEYWORD_WEEKLY_COUNTS)
    since, as_of, words, kinds = "2001-01-01", "2001-12-31", ["ion", "war"], ["10-K", "10-Q"]
    rows = correlation.lagged_mentions(wk, cn, [1, 3], words, kinds, since, as_of)
    means = windows.trailing_mean_across_series(
        rows, ["keyword", "filing_type", "time_delay"], ["stock_symbol"], ["week_opening_date"], "mention_rate", "mention_rolling_avg")
    key = [*correlation.SERIES, "week_opening_date"]
    want = {tuple(r[c] for c in key): r for r in means.collect()}
    scores = {tuple(r[c] for c in correlation.SERIES): r["c"] for r in means.groupBy(*correlation.SERIES).agg(
        S.safe_corr("week_close_price", "mention_rolling_avg").alias("c")).filter("c IS NOT NULL").collect()}
    for chunk in (1, 100_000):  # symbols of a task one by one, or together
        monkeypatch.setattr(correlate, "CHUNK_ROWS", chunk)
        df = correlation.rolling_mentions(wk, cn, [1, 3], words, kinds, since, as_of, across_symbols=True)
        got = {tuple(r[c] for c in key): r for r in df.collect()}
        assert set(df.columns) == set(means.columns) and got.keys() == want.keys() and len(want) > 300
        for k, r in want.items():
            assert got[k]["mention_rate"] == r["mention_rate"] and got[k]["week_close_price"] == r["week_close_price"]
            assert got[k]["mention_rolling_avg"] == pytest.approx(r["mention_rolling_avg"], abs=1e-12)
        found = correlation.range_correlations(wk, cn, [1, 3], words, since, as_of, kinds, across_symbols=True)
        across = {tuple(r[c] for c in correlation.SERIES): r["correlation"] for r in found.collect()}
        assert across.keys() == scores.keys() and len(scores) >= 12
        assert all(across[k] == pytest.approx(c, abs=1e-9) for k, c in scores.items())
        # no joined row is shuffled or sorted by a window: the one window has a row per symbol and class
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "mention_rate" not in "".join(line for line in text.splitlines() if "Window" in line) and "SortMergeJoin" not in text
