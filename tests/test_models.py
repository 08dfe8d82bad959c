"""Regression against a numerical solver, trees on exact data, invariance to partitioning."""

import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators.regression import fitted, predicted
from tickerloom.operators.trees import predict_with_trees
from tickerloom.plans import training

FEATURES = ["f1", "f2", "f3"]


def rows(spark, n=40, groups=5, noise=True):
    rng = np.random.default_rng(3)
    out = []
    for g in range(groups):
        for i in range(n):
            x = [20000000.0 + i * 7, float(rng.uniform()), float(rng.uniform(10, 90))]
            y = 3 + 0.001 * (x[0] - 20000000) - 5 * x[1] + 0.9 * x[2] + (float(rng.normal()) if noise else 0.0)
            out.append((f"g{g}", "train" if i < n - 1 else "score", *x, y))
    return out, spark.createDataFrame(out, "g string, part string, f1 double, f2 double, f3 double, y double")


@pytest.mark.parametrize("parts", [1, 13])
def test_least_squares_matches_numpy(spark, parts):
    data, df = rows(spark)
    got = fitted(df.repartition(parts), ["g"], FEATURES, "y", F.col("part") == "train").filter(
        "part = 'score'").withColumn("p", predicted(FEATURES))
    for r in got.collect():
        train = [d for d in data if d[0] == r["g"] and d[1] == "train"]
        a = np.array([[1.0, d[2] - 20000000, d[3], d[4]] for d in train])
        beta = np.linalg.lstsq(a, np.array([d[5] for d in train]), rcond=None)[0]
        assert r["p"] == pytest.approx(float(beta @ [1.0, r["f1"] - 20000000, r["f2"], r["f3"]]), rel=1e-9)


def test_constant_feature_and_short_groups(spark):
    _, df = rows(spark, noise=False)
    flat = fitted(df.withColumn("f2", F.lit(0.0)), ["g"], FEATURES, "y", F.col("part") == "train")
    assert flat.filter("status <> 'ok' or b_f2 <> 0").count() == 0
    short = df.filter("f1 < 20000015").unionByName(df.filter("part = 'score'"))
    assert {r["status"] for r in fitted(short, ["g"], FEATURES, "y", F.col("part") == "train").collect()} == {"too_few_rows"}


@pytest.mark.parametrize("f2, f3", [("2 * f1 - 7", "f3"), ("f1", "-0.5 * f1 + 3"), ("f3 * 1000", "f3"), ("f2", "f1 + f2"), ("f1", "4.0"), ("1.0", "2.0")])
def test_collinear_features_get_the_shortest_solution(spark, f2, f3):
    _, df = rows(spark, groups=3)
    # two expressions of the old columns; f1 near 2e7 moves by 7
    flat = df.selectExpr("g", "part", "f1 - 20000000 AS f1", f"{f2.replace('f1', '(f1 - 20000000)')} AS f2", f"{f3.replace('f1', '(f1 - 20000000)')} AS f3", "y")
    got = fitted(flat, ["g"], FEATURES, "y", F.col("part") == "train").filter("part = 'score'").collect()
    for r in got:
        data = [x for x in flat.filter("part = 'train'").collect() if x["g"] == r["g"]]
        a = np.array([[x["f1"], x["f2"], x["f3"]] for x in data], float)
        y = np.array([x["y"] for x in data])
        beta = np.linalg.lstsq(a - a.mean(0), y - y.mean(), rcond=1e-10)[0]
        assert r["status"] == "ok" and [r["b_f1"], r["b_f2"], r["b_f3"]] == pytest.approx(list(beta), rel=1e-6, abs=1e-9)
        assert r["intercept"] == pytest.approx(y.mean() - a.mean(0) @ beta, rel=1e-6)


def plain_tree(rows, query, depth=None):
    """Leaf mean for one query, grown by trying every cut; rows are (features, y, weight)."""
    ys = [y for _, y, _ in rows]
    n, s = sum(w for *_, w in rows), sum(w * y for _, y, w in rows)
    if min(ys) == max(ys) or depth == 0:
        return s / n
    best = None
    for j in range(len(query)):
        values = sorted({x[j] for x, _, _ in rows})
        for a, b in zip(values, values[1:]):
            low = [r for r in rows if r[0][j] <= a]
            ln, ls = sum(r[2] for r in low), sum(r[2] * r[1] for r in low)
            gain = round(ln * (n - ln) * (ls / ln - (s - ls) / (n - ln)) ** 2 / (n * n * (max(ys) - min(ys)) ** 2), 10)
            if best is None or gain > best[0]:
                best = (gain, j, (a + b) / 2)
    if best is None:
        return s / n
    _, j, cut = best
    side = [r for r in rows if (r[0][j] <= cut) == (query[j] <= cut)]
    return plain_tree(side, query, None if depth is None else depth - 1)


def tree_rows(seed, groups=4, n=35, asked=3):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        for i in range(n + asked):
            # few distinct values, so cuts tie and rows repeat
            x = [float(rng.integers(0, 12)), float(rng.integers(0, 4)), float(rng.integers(0, 3))]
            out.append((f"g{g}" if g else None, "train" if i < n else "ask", *x, float(rng.integers(0, 9)), i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_match_a_plain_grower(spark, seed):
    data = tree_rows(seed)
    df = spark.createDataFrame(data, "g string, part string, f1 double, f2 double, f3 double, y double, id int")
    got = {(r["g"], r["id"]): r["predicted_price"] for r in predict_with_trees(df, ["g"], FEATURES, "y", "decision_tree", ["id"]).collect()}
    want = {}
    for g in {d[0] for d in data}:
        train = [(d[2:5], d[5], 1) for d in data if d[0] == g and d[1] == "train"]
        want |= {(g, d[6]): plain_tree(train, d[2:5]) for d in data if d[0] == g and d[1] == "ask"}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_forest_matches_plain_trees_on_the_same_samples(spark):
    import hashlib
    data = tree_rows(7, groups=2, n=25)
    df = spark.createDataFrame(data, "g string, part string, f1 double, f2 double, f3 double, y double, id int")
    got = {(r["g"], r["id"]): r["predicted_price"] for r in predict_with_trees(
        df, ["g"], FEATURES, "y", "random_forest", ["id"], seed=5, trees=6, forest_depth=3).collect()}
    for g in {d[0] for d in data}:
        train = sorted((d for d in data if d[0] == g and d[1] == "train"), key=lambda d: (*d[2:5], d[5], d[6]))
        for d in (d for d in data if d[0] == g and d[1] == "ask"):
            means = []
            for t in range(6):
                places = [int(hashlib.md5(f"{t}|{i}|5".encode()).hexdigest()[:7], 16) % len(train) for i in range(len(train))]
                means.append(plain_tree([(train[p][2:5], train[p][5], places.count(p)) for p in set(places)], d[2:5], 3))
            assert got[g, d[6]] == pytest.approx(sum(means) / 6)


def grown(groups, depth, trees, seed=5):
    """Means over the trees for one row a group, of groups of (features, target, row to be predicted)."""
    from tickerloom.operators import trees as t
    groups = [(x[o], y[o], a) for x, y, a in groups for o in [np.lexsort([y, *x.T[::-1]])]]
    x, y = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
    n = np.array([len(g[1]) for g in groups])
    low, found = np.cumsum(n) - n, {}
    for step in t._steps(range(len(groups)), n, trees, seed):
        for (i, _), means in zip(step, t._path_means(x, y, [(low[i], groups[i][2], s) for i, s in step], depth)):
            found.setdefault(i, []).append(means)
    return [np.concatenate(found[i]).mean() for i in range(len(groups))], groups


@pytest.mark.parametrize("cells", [1, 60, 1 << 18])
def test_groups_of_any_scale_and_size_are_grown_together(monkeypatch, cells):
    from tickerloom.operators import trees as t
    monkeypatch.setattr(t, "STEP_CELLS", cells)
    monkeypatch.setattr(t, "GAIN_CELLS", cells)
    rng = np.random.default_rng(4)
    groups = []
    for n, scale, far in ((1, 1.0, 0.0), (40, 1e-6, 0.0), (3, 1e9, 0.0), (33, 1.0, 1e4), (2, 0.02, 29367.76), (27, 1e9, 0.0), (9, 0.0, 0.1), (38, 1.0, 0.0)):
        x = rng.integers(0, [12, 4, 3], size=(n + 1, 3)).astype(float)
        groups.append((x[:-1], far + scale * rng.integers(0, 9, n), x[-1]))
    got, groups = grown(groups, 4, 6)
    for mean, (x, y, a) in zip(got, groups):
        means = []
        for tree in range(6):
            places = [int(hashlib.md5(f"{tree}|{i}|5".encode()).hexdigest()[:7], 16) % len(y) for i in range(len(y))]
            means.append(plain_tree([(tuple(x[p]), y[p], places.count(p)) for p in sorted(set(places))], tuple(a), 4))
        assert mean == pytest.approx(sum(means) / 6, rel=1e-9)


def test_forest_work_goes_with_the_rows_on_the_way(monkeypatch):
    from tickerloom.operators import trees as t
    rng = np.random.default_rng(2)
    groups = [(rng.uniform(size=(110, 3)), rng.uniform(size=110), rng.uniform(size=3)) for _ in range(4)]
    entries = 3 * sum(len(t._sample(50, 110, 5).rows) for _ in groups)
    t._kept_sample(50, 110, 5)
    summed, sums = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda a, *rest, **more: summed.append(np.size(a)) or sums(a, *rest, **more))
    grown(groups, 20, 50)
    # every level of all groups in a few calls, over ever fewer rows; all rows at each of a dozen levels were 40 times as many
    assert sum(summed) < 4 * entries and len(summed) < 200


def test_no_cut_lies_before_an_infinite_value():
    x = np.array([[1.0, 0, 0], [2.0, 0, 0], [np.inf, 0, 0], [np.inf, 0, 0]])
    assert grown([(x, np.array([1.0, 1.0, 5.0, 6.0]), np.array([2.0, 0, 0]))], None, 1, None)[0] == [4.0]


def test_groups_are_dealt_to_all_shares_and_may_span_arrow_batches(spark):
    data = tree_rows(3, groups=6, n=30)
    df = spark.createDataFrame(data, "g string, part string, f1 double, f2 double, f3 double, y double, id int")
    key = lambda r: (str(r["g"]), r["id"])
    whole = predict_with_trees(df, ["g"], FEATURES, "y", "random_forest", ["id"], trees=5)
    assert whole.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted(whole.collect(), key=key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(predict_with_trees(df.repartition(3), ["g"], FEATURES, "y", "random_forest", ["id"], trees=5).collect(), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 18


def test_trees_with_missing_values_and_groups_without_training_rows(spark):
    rows = [("a", "train", 1.0, 0.0, 0.0, 5.0, 1), ("a", "train", None, 0.0, 0.0, 9.0, 2), ("a", "train", 2.0, 0.0, 0.0, None, 3),
            ("a", "ask", 7.0, 0.0, 0.0, None, 4), ("a", "ask", None, 0.0, 0.0, None, 5), ("b", "ask", 1.0, 0.0, 0.0, 1.0, 6), ("c", "train", 1.0, 0.0, 0.0, 1.0, 7)]
    df = spark.createDataFrame(rows, "g string, part string, f1 double, f2 double, f3 double, y double, id int")
    for model in ("decision_tree", "random_forest"):
        got = {r["id"]: r["predicted_price"] for r in predict_with_trees(df, ["g"], FEATURES, "y", model, ["id"], trees=3).collect()}
        assert got == {4: 5.0, 5: None, 6: None}
        assert predict_with_trees(df.limit(0), ["g"], FEATURES, "y", model, ["id"], trees=3).collect() == []


def test_neighbouring_doubles_do_not_trap_the_tree(spark):
    a = 0.1
    b = float(np.nextafter(a, 1))
    df = spark.createDataFrame([("g", p, x, 0.0, 0.0, y) for p in ("train", "ask") for x, y in ((a, 1.0), (b, 2.0))],
                               "g string, part string, f1 double, f2 double, f3 double, y double")
    got = predict_with_trees(df, ["g"], FEATURES, "y", "decision_tree", ["y"])
    assert got.filter("y <> predicted_price").count() == 0


def test_walk_forward_uses_earlier_weeks_only(spark):
    weeks = [date(2001, 1, 1) + timedelta(weeks=i) for i in range(60)]
    rng = np.random.default_rng(1)
    wk = spark.createDataFrame([("A", w, 1.0, float(rng.uniform(1, 9))) for w in weeks],
                               "stock_symbol string, week_opening_date date, week_open_price double, week_close_price double")
    cn = spark.createDataFrame([(w, "10-K", "k", int(rng.integers(0, 9)), 10) for w in weeks],
                               "filing_week date, filing_type string, keyword string, keyword_mentions bigint, total_filings bigint")
    pair = spark.createDataFrame([("A", "k", "10-K", 1, weeks[0])],
                                 "stock_symbol string, keyword string, filing_type string, time_delay int, start_date date")
    got = {r["filing_week"]: r for r in training.walk_forward(wk, cn, pair, weeks[30]).collect()}
    cut = spark.createDataFrame([(w, p) for w, p in zip(weeks, range(60)) if p <= 40], "w date, i int").select("w")
    early = wk.join(cut, F.col("w") == F.col("week_opening_date")).drop("w")
    again = {r["filing_week"]: r for r in training.walk_forward(early, cn, pair, weeks[30]).collect()}
    assert len(again) == 10
    for w, r in again.items():
        assert r["predicted_price"] == pytest.approx(got[w]["predicted_price"])
    with pytest.raises(ValueError):
        training.walk_forward(wk, cn, pair, weeks[30], "random_forest")


def test_one_range_equals_the_grid_at_its_first_start(spark):
    from tickerloom.plans import correlation
    start, end = "2020-01-01", "2020-12-28"
    mondays = [date(2020, 1, 6) + timedelta(weeks=k) for k in range(51)]
    wk = spark.createDataFrame([(s, w, float((k * 7 + ord(s)) % 13 + k)) for s in "ABC" for k, w in enumerate(mondays)],
                               "stock_symbol string, week_opening_date date, week_close_price double")
    cn = spark.createDataFrame([(w, t, kw, (k * 5 + len(kw)) % 9 + 1, 10) for k, w in enumerate(mondays) for t in ("10-K", "10-Q") for kw in ("war", "peace")],
                               "filing_week date, filing_type string, keyword string, keyword_mentions long, total_filings long")
    starts = spark.createDataFrame([(date(2020, 1, 1),)], "start_date date")
    grid = correlation.correlation_grid(wk, cn, starts, start, end, [1, 2], ["war", "peace"], ["10-K", "10-Q"])
    own = correlation.range_correlations(wk, cn, [1, 2], ["war", "peace"], start, end, ["10-K", "10-Q"])
    across = correlation.range_correlations(wk, cn, [1, 2], ["war", "peace"], start, end, ["10-K", "10-Q"], across_symbols=True)
    value = lambda df: {tuple(r[c] for c in correlation.SERIES): r.correlation for r in df.collect()}
    a, b, c = value(grid), value(own), value(across)
    assert len(a) == 24 and a.keys() == b.keys() == c.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    # only the first symbol of a combination has nothing carried into it
    assert all((abs(b[k] - c[k]) < 1e-9) == (k[0] == "A") for k in a)
    assert correlation.range_correlations(wk.limit(0), cn, [1], ["war"], start, end, across_symbols=True).count() == 0


def test_rows_of_pairs_are_made_where_the_closes_are(spark):
    """Pairs that come twice, gaps, symbols without closes and lags, against the plain windows over the joined rows."""
    import random
    from pyspark.sql import Window
    from tickerloom import schemas
    from tickerloom.operators import windows
    from tickerloom.plans import keywords

    rnd = random.Random(9)
    monday = [date(2001, 1, 1) + timedelta(weeks=i) for i in range(50)]
    closes = [(s, w, 1.0, None if rnd.random() < 0.1 else rnd.uniform(1, 9)) for s in "ABC" for w in monday if rnd.random() < 0.85]
    counted = [(w, t, k, rnd.randint(0, 3), rnd.choice([0, 4, 4])) for w in monday for t in ("10-K", "10-Q") for k in ("ion", "war") if rnd.random() < 0.85]
    asked = [(s, k, t, n, date(2001, 1, 20), e) for s in "ABD" for k in ("ion", "none") for t in ("10-K", "10-Q") for n in (1, 3) for e in (monday[40], monday[45])]
    wk, cn = spark.createDataFrame(closes, schemas.WEEKLY_PRICES), spark.createDataFrame(counted, schemas.KEYWORD_WEEKLY_COUNTS)
    pairs = spark.createDataFrame(asked + asked[:3], "stock_symbol string, keyword string, filing_type string, time_delay int, start_date date, end_date date")
    keys, week = [*training.PAIR, "end_date"], "week_opening_date"

    rates = keywords.mention_rates(cn).withColumnRenamed("filing_week", week)
    joined = pairs.join(wk.drop("week_open_price"), "stock_symbol").filter("week_opening_date >= start_date").join(rates, [week, "keyword", "filing_type"])
    means = windows.trailing_mean(joined, keys, [week], "mention_rate", "mention_rolling_avg")
    ahead = windows.value_weeks_ahead(means, keys, week, "time_delay", {"week_close_price": training.TARGET})

    def same(got, want, *columns):
        columns = [*keys, week, *columns]
        a, b = ({tuple(r[c] for c in columns if not isinstance(r[c], float)): [r[c] for c in columns if isinstance(r[c], float)] for r in df.collect()}
                for df in (got, want))
        assert a.keys() == b.keys() and len(a) == got.count() >= 8
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)

    plain = ahead.withColumnRenamed("week_close_price", "current_close_price")
    got = training.pair_weeks(wk, cn, pairs)
    same(got, plain, "mention_rolling_avg", "current_close_price", training.TARGET)
    text = training.pair_weeks(wk, cn, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SortAggregate" not in text and text.count("Sort ") == 1

    whole = Window.partitionBy(*keys)
    for cutoff in (None, "end_date"):
        rows = plain.filter(f"{training.TARGET} IS NOT NULL").withColumns({
            "cut": F.col(cutoff) if cutoff else F.max(week).over(whole), "pos": F.row_number().over(whole.orderBy(week))})
        rows = rows.withColumn("fit", F.expr(f"{week} < cut AND pos > 3")).filter(f"fit OR {week} = cut")
        filled = windows.interpolate_linear(rows, [*keys, "fit"], [week], [*training.FEATURES[1:]])
        group = Window.partitionBy(*keys, "fit")
        held = F.row_number().over(group.orderBy(training.split_hash(training.PAIR))) <= F.ceil(F.count(F.lit(1)).over(group) * 0.1)
        want = filled.withColumn("part", F.when(~F.col("fit"), "score").when(held, "test").otherwise("train"))
        same(training.model_rows(wk, cn, pairs, cutoff), want, "part", "mention_rolling_avg", "current_close_price", training.TARGET)

    day = wk.select("stock_symbol", F.col(week).alias("created_at"), F.lit(1.0).alias("close_price"))
    lagged = pairs.join(wk.select("stock_symbol", week), "stock_symbol").filter("week_opening_date BETWEEN start_date AND end_date").withColumn(
        "filing_week", F.expr("date_sub(week_opening_date, 7 * time_delay)")).join(rates.withColumnRenamed(week, "filing_week"), ["filing_week", "keyword", "filing_type"])
    last = windows.trailing_mean(lagged, keys, [week], "mention_rate", "mention_rolling_avg").groupBy(*keys).agg(
        F.max(F.struct(week, "mention_rolling_avg")).alias("m")).select(*keys, "m.*")
    same(training.latest_features(wk, cn, day, pairs, asof_close=True), last, "mention_rolling_avg")
