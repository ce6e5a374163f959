"""Parsers, sources, studies and read functions one by one."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.backtest import study
from tideline.operators import bars, ingest, jobs, scan
from tideline.plans import api
from tideline.sources import files, store
from tideline.sources.market import market

DAY = dt.date


def test_status_of_a_fetched_file(spark):
    rows = spark.createDataFrame([(DAY(2024, 1, 5),), (DAY(2024, 1, 5),)], "date date")
    assert [files.file_status(r, "2024-01-05").first().status for r in (rows, rows.where("false"))] == ["ok", "unavailable"]
    assert files.file_status(rows, "2024-01-06").first().status == "holiday"


def test_vendor_columns_become_rows(spark):
    wide = spark.createDataFrame([("2024-01-02", 1.0, 2.0, float("nan"), 5.0), ("2024-01-03", None, None, 4.0, 6.0)], "date string, `open|A` double, `close|A` double, `close|B` double, `volume|B` double")
    got = {(r.symbol, r.date.day): (r.open, r.close, r.volume) for r in files.melt_vendor(wide).collect()}
    assert got == {("A", 2): (1.0, 2.0, None), ("B", 3): (None, 4.0, 6.0)}


def test_constituent_lists(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Company Name,Industry,Symbol,Series,ISIN Code\n Alpha , Metals ,AAA ,EQ, INE1 \nBeta,Oil,,EQ,INE2\nGamma,Oil,GGG,EQ,INE3\nGamma,Oil,GGH,EQ,INE3\n")
    got = sorted((r.name, r.industry, r.symbol, r.isin) for r in files.read_constituents(spark, str(tmp_path / "c.csv")).collect())
    assert got == [("Alpha", "Metals", "AAA", "INE1"), ("Gamma", "Oil", "GGG", "INE3")]
    (tmp_path / "bad.csv").write_text("Symbol\nA\n")
    with pytest.raises(ValueError):
        files.read_constituents(spark, str(tmp_path / "bad.csv"))


def test_action_feed(spark):
    rows = [(" A ", "I1", "05-Jan-2024", "Bonus 1:1"), ("A", "I1", "05-Jan-2024", "Bonus 1:1"), ("B", "I2", "08-Jan-2024", "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share"), ("C", "I3", "05-Jan-2024", "Dividend Rs 4 to holders"), ("D", "I4", "05-Jan-2023", "Bonus 1:1"), ("E", "I5", "nonsense", "Bonus 1:1")]
    got = files.corporate_actions(spark.createDataFrame(rows, "symbol string, isin string, exDate string, subject string"), "2024-01-01", "2024-12-31").collect()
    assert sorted((r.symbol, r.ex_date, r.factor) for r in got) == [("A", DAY(2024, 1, 5), 0.5), ("B", DAY(2024, 1, 8), 0.1)]


def test_csv_export_round_trip(spark, tmp_path):
    s = market(spark, "/root/testdata/sf0.001")
    from tideline.plans.catalog import scan_config

    week = scan.scan(s, scan_config()).stocks.where("week_end_date = date '1999-06-04'")
    files.write_csv(week, str(tmp_path / "out"), extended=True)
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == [*files.EXPORT, *files.EXPORT_MORE] and back.count() == week.count() > 0
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1


def test_archive_ties_are_ordered(spark):
    rows = spark.createDataFrame([("A", "EQ", 2.0), ("A", "EQ", 1.0), ("A", "BE", 0.5)], "symbol string, series string, close double")
    assert [files.preferred(r, ["EQ", "BE"], ["symbol"]).first().close for r in (rows, rows.orderBy("close"))] == [1.0, 1.0]


def test_studies_of_many_runs(spark):
    m = spark.createDataFrame([(i, json.dumps({"cagr_pct": c}), c) for i, c in ((1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0))], "run_id int, metrics string, cagr_pct double")
    assert [r.run_id for r in study.best_runs(m, 2).collect()] == [2, 3]
    params = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", "b"), (4, "x", "a")], "run_id int, name string, value string")
    assert {r.value: (r.runs, r.median_cagr_pct, r.above_median) for r in study.parameter_effect(m.select("run_id", "cagr_pct"), params).collect()} == {"a": (2, 3.0, 0), "b": (2, 9.0, 2)}
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0), (4, 9.0)], "seed int, cagr double")
    assert study.nearest(seeds, 50).first().seed == 2
    first = spark.createDataFrame([("X", DAY(2010, 1, 1)), ("X", DAY(2012, 1, 1)), ("Y", None)], "index_name string, snapshot_date date")
    assert {r.index_name: r.biased for r in study.survivorship(first, DAY(2011, 1, 1)).collect()} == {"X": False, "Y": True}
    runs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "run_id int, sweep_id string")
    kinds = spark.createDataFrame([(1, "{}"), (2, '{"kind":"mc"}'), (3, "{}")], "run_id int, params string")
    assert [r.run_id for r in study.runs_of_sweep(runs, kinds, "s").collect()] == [1]


def test_merged_trades(spark):
    columns = ", ".join(f"{c} {'date' if 'date' in c else 'string' if c in ('symbol', 'industry', 'exit_reason') else 'int' if c in ('symbol_id', 'weeks_held') else 'double'}" for c in study.TRADE_KEY)
    key = (1, "A", "X", DAY(2024, 1, 1), DAY(2024, 1, 2), 10.0, DAY(2024, 2, 1), 11.0, 4, "end")
    rows = spark.createDataFrame([(*key, 1.4, 5.0, 10.0, 80.0), (*key, 1.2, 7.0, 10.0, 90.0)], columns + ", qty double, pnl double, pnl_pct double, entry_score double")
    r = study.merge_trades(rows).first()
    assert (r.qty, r.pnl, r.pnl_pct, r.entry_score) == (3, 12.0, 10.0, 85.0)


def test_run_lists_and_details(spark):
    runs = spark.createDataFrame([(DAY(2024, 1, 5), "complete"), (DAY(2024, 1, 12), "failed"), (DAY(2024, 1, 19), "complete")], "week_end_date date, status string")
    assert [r.week_end_date.day for r in api.list_runs(runs).collect()] == [19, 12, 5]
    assert [r.week_end_date.day for r in api.list_runs(runs, True).collect()] == [19, 5]
    assert [api.resolve_week(runs, w).collect()[0].week_end_date.day for w in (None, "2024-01-18")] == [19, 5]
    bt = spark.createDataFrame([(1, "a")], "run_id int, name string")
    equity = spark.createDataFrame([(1, DAY(2024, 1, d), float(d), 1.0, 0.0) for d in (2, 1)] + [(2, DAY(2024, 1, 1), 0.0, 0.0, 0.0)], "run_id int, date date, equity double, benchmark double, drawdown double")
    trades = spark.createDataFrame([(1, DAY(2024, 1, 1), "A", DAY(2024, 1, 2), 1, 2.0, "end")], "run_id int, entry_date date, symbol string, exit_date date, qty int, pnl double, exit_reason string")
    r = api.backtest(bt, equity, trades, 1).first()
    assert [x.equity for x in r.equity] == [1.0, 2.0] and [x.symbol for x in r.trades] == ["A"]


def test_downloads_ids_and_patterns(spark):
    state = spark.createDataFrame([("A", DAY(2020, 1, 6), None), ("B", DAY(2020, 1, 6), None), ("C", DAY(2020, 1, 6), DAY(2019, 1, 1)), ("D", None, None), ("E", DAY(2010, 1, 1), None)], "symbol string, first_date date, listed_date date")
    assert [(r.start, r.end, r.symbols) for r in ingest.plan_extend(state, "2015-01-01").collect()] == [(DAY(2015, 1, 1), DAY(2020, 1, 5), "A,B")]
    symbols = spark.createDataFrame([(1, "A", "I1"), (2, "B", None), (3, "C", "I3")], "id int, symbol string, isin string")
    rows = spark.createDataFrame([("X", "I1"), ("B", "I9"), ("C", None), ("Z", "I8")], "symbol string, isin string")
    assert {r.symbol: r.symbol_id for r in ingest.map_ids(rows, symbols).collect()} == {"X": 1, "B": 2, "C": 3, "Z": None}
    listing = spark.createDataFrame([("DUMMY1",), ("REAL",)], "symbol string")
    assert [r.symbol for r in ingest.without_pattern(listing, "^DUMMY").collect()] == ["REAL"]


def test_session_calendar_and_exclusions(spark):
    bench = spark.createDataFrame([("X", DAY(2024, 1, 1)), ("X", DAY(2024, 1, 2)), ("Y", DAY(2024, 1, 3))], "index_name string, date date")
    assert [r.date.day for r in jobs.session_calendar(bench, "X", "2024-01-02").collect()] == [2]
    asm = json.dumps({"longterm": {"data": [{"symbol": "A", "isin": "I1", "stage": "1"}, {"symbol": "Q", "isin": "?", "stage": "1"}]}, "shortterm": {"data": []}})
    lists = spark.createDataFrame([(asm, "[]")], "asm string, gsm string")
    symbols = spark.createDataFrame([(1, "A", "I1")], "id int, symbol string, isin string")
    old = spark.createDataFrame([("GSM", 5, "0", DAY(2024, 1, 1)), ("GSM", 6, "0", DAY(2024, 1, 2))], "list_type string, symbol_id int, stage string, as_of_date date")
    got = sorted((r.list_type, r.symbol_id, r.as_of_date.day) for r in jobs.refresh_exclusions(lists, symbols, old, "2024-01-02").collect())
    assert got == [("ASM_LT", 1, 2), ("GSM", 5, 1)]


def test_replace_and_coverage_of_weeks(spark):
    daily = spark.createDataFrame([(1, DAY(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 10.0) for d in (1, 2, 8)], "symbol_id int, date date, open double, high double, low double, close double, volume double")
    whole = jobs.rebuild_weeks(daily, bars.weekly_bars(daily).where("false"), full=True).weekly
    assert whole.count() == 2
    assert store.replace_where(daily, daily.limit(1), F.col("close") > 0).count() == 1
    assert pd.Timestamp(whole.agg(F.max("week_end_date")).first()[0]) == pd.Timestamp(2024, 1, 8)
