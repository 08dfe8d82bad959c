"""Landed files, sinks and the streaming forms."""

import json
from datetime import date, timedelta

from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.plans import filings, reference_data, refresh, weekly
from tickerloom.sources import derived, tables
from tickerloom.streaming import ingest


def submission(kind):
    return (f"<DOCUMENT>\n<TYPE>{kind}\n<p>Item 1A. Risk</p><p>danger</p><p>Item 1B. x</p><p>Item 2. y</p>"
            "<p>Item 7. Talk</p><p>Item 7A. z</p>\n</DOCUMENT>")


def test_submission_tree_to_records(spark, tmp_path):
    for cik, kind, number in (("0000012345", "10-K", "0000012345-01-000001"), ("0000099999", "10-Q", "0000099999-01-000002")):
        folder = tmp_path / "tree" / cik / kind / number
        folder.mkdir(parents=True)
        (folder / "full-submission.txt").write_text(submission(kind))
    ciks = tmp_path / "ciks.json"
    ciks.write_text(json.dumps([{"AAA": "12345"}, {"BBB": "1"}]))
    pages = spark.createDataFrame(
        [("0000012345-01-000001", '<div class="info">2001-02-03</div>'), ("0000099999-01-000002", "<div></div>")],
        "filing_number string, html string")
    got = filings.filing_records(
        tables.read_submissions(spark, str(tmp_path / "tree")), tables.read_symbol_ciks(spark, str(ciks)),
        tables.filing_dates(pages)).orderBy("filing_number").collect()
    assert [(r["company_name"], r["filing_type"], r["filing_date"]) for r in got] == [
        ("AAA", "10-K", date(2001, 2, 3)), ("unknown", "10-Q", None)]
    assert got[0]["risk_factors"] == ">Item 1A. Risk\n\ndanger" and got[0]["risk_disclosures"].startswith(">Item 7. Talk")
    assert got[1]["risk_disclosures"] is None and got[0]["filing_url"].endswith("0000012345-01-000001-index.html")


def test_report_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"symbol": "A", "quarterlyReports": [
        {"fiscalDateEnding": "2001-03-31", "ebitda": "5"}, {"fiscalDateEnding": "bad", "ebitda": "None"}]}, indent=1))
    got = tables.read_income_reports(spark, str(tmp_path)).orderBy("ebitda").collect()
    assert [(r["fiscal_date"], r["ebitda"]) for r in got] == [(date(2001, 3, 31), "5"), (None, "None")]


def test_csv_and_membership_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("stock_symbol,company_name\nA,Alpha\n")
    assert tables.read_csv(spark, str(tmp_path / "n.csv"), schemas.SYMBOL_NAMES).first()["company_name"] == "Alpha"
    cells = lambda *c: "<tr>" + "".join(f"<td> <a>{x}</a></td>" for x in c) + "</tr>"
    html = ("<table><tr><th>h</th></tr>" + cells("A", "", "", "", "", "2021-01-01", "", "") +
            cells("B", "", "", "", "", "2001-01-01", "", "2020-05-05") + cells("C", "", "", "", "", "2001-01-01", "", "x") +
            cells("D", "short") + "</table>")
    rows = tables.html_table_rows(spark.createDataFrame([(html,)], "html string"), "html", min_cells=7)
    assert sorted(r["stock_symbol"] for r in reference_data.index_membership_since(rows).collect()) == ["A", "B"]


def test_daily_append_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "prices")
    landed = spark.createDataFrame(
        [(date(2001, 1, d), 1.0, 2.0, 0.5, 1.5, 10.0, "A") for d in (1, 2, 2)], schemas.LANDED_PRICES)
    for _ in range(2):
        tables.append_days(weekly.daily_prices_ingest(landed), out)
    assert spark.read.parquet(out).count() == 2
    assert not tables.append_if_any(landed.limit(0), out, "Date")
    assert tables.snapshot_on(landed, "2001-01-02").count() == 3 and tables.snapshot_on(landed, "2001-01-03").count() == 0
    assert len(tables.records(landed, ["Date", "Symbol"], 2)) == 2 and tables.empty(spark, schemas.PAIRS).count() == 0


def test_streaming_ingest_takes_each_file_once(spark, tmp_path):
    landed, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    head = "Date,Open,High,Low,Close,Volume,Symbol\n"
    for day in (1, 2):
        (tmp_path / "in" / f"{day}.csv").write_text(head + f"2001-01-0{day},1,2,0.5,1.5,10,A\n")
        ingest.ingest_daily_prices(spark, landed, schemas.LANDED_PRICES, out, mark).awaitTermination(60)
    # a file that repeats a day, and corrects another one
    (tmp_path / "in" / "3.csv").write_text(head + "2001-01-02,1,2,0.5,1.5,10,A\n2001-01-01,1,2,0.5,7.5,10,A\n")
    ingest.ingest_daily_prices(spark, landed, schemas.LANDED_PRICES, out, mark).awaitTermination(60)
    assert sorted((r["created_at"].day, r["close_price"]) for r in spark.read.parquet(out).collect()) == [(1, 7.5), (2, 1.5)]


def test_refresh_replaces_only_the_weeks_it_touches(spark, tmp_path):
    store, weeks = str(tmp_path / "store"), str(tmp_path / "weeks")

    def night(*rows):
        df = spark.createDataFrame([("A", date(2001, 1, d), float(o), float(c)) for d, o, c in rows],
                                   "stock_symbol string, created_at date, open_price double, close_price double")
        refresh.refresh_weekly_prices(df, store, weeks)
        return {r["week_opening_date"]: (r["week_open_price"], r["week_close_price"]) for r in spark.read.parquet(weeks).collect()}

    first = night((2, 10, 11), (3, 12, 13), (9, 20, 21))
    assert first == {date(2001, 1, 1): (10.0, 13.0), date(2001, 1, 8): (20.0, 21.0)}
    untouched = sorted((tmp_path / "weeks" / "week_opening_date=2001-01-01").iterdir())
    assert night((8, 18, 19), (16, 30, 31)) == first | {date(2001, 1, 8): (18.0, 21.0), date(2001, 1, 15): (30.0, 31.0)}
    assert sorted((tmp_path / "weeks" / "week_opening_date=2001-01-01").iterdir()) == untouched
    again = night((8, 18, 19), (16, 30, 31))
    assert again == night((8, 18, 19), (16, 30, 31), (8, 18, 19)) and spark.read.parquet(store).count() == 5
    # a late row and a corrected one
    assert night((1, 5, 6), (3, 12, 14))[date(2001, 1, 1)] == (5.0, 14.0)


def test_checked_readers_split_rows_and_rejects(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume,Symbol\n2001-01-01,1,2,0.5,1.5,10,A\n2001-01-02,1,2,0.5,x,10,A\n2001-01-03,1\n")
    rows, rejects = tables.read_csv_checked(spark, str(tmp_path / "p.csv"), schemas.LANDED_PRICES)
    assert [r["Close"] for r in rows.collect()] == [1.5]
    got = sorted((r["file"], r["record"], r["reason"]) for r in rejects.collect())
    assert got == [("p.csv", "2001-01-02,1,2,0.5,x,10,A", "no usable value: Close"), ("p.csv", "2001-01-03,1", "no usable value: High,Low,Close,Volume,Symbol")]
    tree = tmp_path / "tree"
    for cik, text in (("0000012345", submission("10-K")), ("0000012346", "nothing"), ("x", submission("10-K"))):
        (tree / cik / "10-K" / "0000012345-01-000001").mkdir(parents=True)
        (tree / cik / "10-K" / "0000012345-01-000001" / "full-submission.txt").write_text(text)
    whole, odd = tables.read_submissions_checked(spark, str(tree))
    assert [r["content"] for r in whole.collect()] == [submission("10-K")]
    assert sorted(r["reason"] for r in odd.collect()) == ["no usable value: document", "no usable value: number"]


def test_weekly_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.range(200).select(
        (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 20000).alias("ts"),
        F.col("id").cast("double").alias("value")).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = ingest.weekly_stream(spark.readStream.schema(batch.schema).parquet(src), "user_id", "ts", "value")
    q = stream.writeStream.format("memory").queryName("weekly_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = ingest.weekly_first_last(batch, "user_id", "ts", "value")
    assert sorted(map(tuple, spark.table("weekly_out").collect())) == sorted(map(tuple, want.collect()))


def test_days_are_grouped_in_a_given_number_of_shares(spark, tmp_path):
    """Neither a map of a split's groups before the shuffle nor shares that the optimizer joins."""
    day = date(2020, 1, 6)
    rows = [(1, day, 5.0, 2.0), (1, day, 7.0, 3.0), (1, day, None, 1.0), (2, day, None, 4.0), (2, None, 9.0, 1.0), (None, day, 8.0, 1.0)]
    rows += [(3, day + timedelta(i), float(i), 1.0) for i in range(50)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = derived.prices(spark, str(tmp_path))
    got = {(r.stock_symbol, r.created_at): (r.open_price, r.close_price, r.volume) for r in df.collect()}
    assert len(got) == 54 and got["S000001", day] == (5.0, 7.0, 6.0) and got["S000002", day] == (None, None, 4.0)
    assert got["S000002", None] == (9.0, 9.0, 1.0) and got["S000003", day] == (0.0, 0.0, 1.0)
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above, below = text.split("REPARTITION_BY_NUM")
    assert "Aggregate" in above and "Aggregate" not in below
    shares = min(int(spark.conf.get("spark.sql.shuffle.partitions")), derived.SHARES_A_SPLIT * spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions())
    assert f", {shares})" in above.rsplit("Exchange", 1)[-1]
    assert derived.prices(spark, str(tmp_path)).filter("stock_symbol = 'S000009'").count() == 0
