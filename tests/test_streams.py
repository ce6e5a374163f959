"""Streams that lose nothing and do nothing twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import bars, intervals
from tideline.sources.store import write_slices
from tideline.streaming import live

DAY = dt.date
TICKS = "symbol_id int, ts timestamp, open double, high double, low double, close double, volume long"


def tick(symbol, day, x=1.0):
    return (symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), x, x, x, x, 10)


def test_the_gate_deals_what_a_watermark_would_drop(spark, tmp_path):
    root, rows = f"file://{tmp_path}", lambda *r: spark.createDataFrame(list(r), TICKS)
    write = live.late_gate(root)
    write(rows(tick(1, 0), tick(1, 60), tick(2, 1)), 0)  # nothing is late yet: the newest of the batches before counts
    write(rows(tick(1, 30), tick(1, 32), tick(1, 35, 5.0), tick(2, 61)), 3)  # weeks that ended at day 35 are behind day 60 - 21
    days = lambda kind: sorted((r.symbol_id, (r.ts - dt.datetime(2024, 1, 1)).days) for r in live.dealt(spark, root, kind, TICKS).collect())
    assert days("late") == [(1, 30), (1, 32)] and days("ontime") == [(1, 0), (1, 35), (1, 60), (2, 1), (2, 61)]
    write(rows(tick(9, 9)), 3)  # a batch made again: what is there stays
    assert len(days("late")) + len(days("ontime")) == 7
    stored = bars.weekly_bars(live.dealt(spark, root, "ontime", TICKS).withColumn("date", F.to_date("ts")))
    everything = live.dealt(spark, root, "ontime", TICKS).unionByName(live.dealt(spark, root, "late", TICKS)).withColumn("date", F.to_date("ts"))
    want = bars.weekly_bars(everything)
    got = live.repair_weeks(stored.select(want.columns), live.dealt(spark, root, "ontime", TICKS), live.dealt(spark, root, "late", TICKS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_that_broke_off_while_it_was_dealt(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    batch = spark.createDataFrame([tick(1, 0), tick(1, 9)], TICKS)
    rename, calls = live._rename, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        rename(*args)

    monkeypatch.setattr(live, "_rename", breaks)
    write = live.late_gate(root)
    with pytest.raises(RuntimeError):
        write(batch, 0)
    write(batch, 0)
    assert live.dealt(spark, root, "ontime", TICKS).count() == 2 and live.dealt(spark, root, "late", TICKS).count() == 0


FILE = "SYMBOL,SERIES,DATE1,PREV_CLOSE,OPEN_PRICE,HIGH_PRICE,LOW_PRICE,LAST_PRICE,CLOSE_PRICE,AVG_PRICE,TTL_TRD_QNTY,TURNOVER_LACS,NO_OF_TRADES,DELIV_QTY,DELIV_PER\n"


def put(folder, wanted, close, previous, of=None):
    line = f"A, EQ, {(of or wanted):%d-%b-%Y}, {previous}, {close}, {close}, {close}, 0, {close}, 0, 100, 0, 1, -, -\n"
    (folder / f"{wanted:%Y%m%d}.csv").write_text(FILE + line + line.replace("A, EQ", "A, BE").replace(f", {close}", ", 99"))


@pytest.fixture
def store(spark, tmp_path):
    columns = "symbol_id int, date date, open double, high double, low double, close double, volume double, delivery_qty double, delivery_pct double, source string, month date"
    old = spark.createDataFrame([(1, DAY(2024, 1, 5), 10.0, 10.0, 10.0, 10.0, 1.0, None, None, "first", DAY(2024, 1, 1))], columns)
    write_slices(old, f"{tmp_path}/bars", ["month"])
    (tmp_path / "landed").mkdir()
    return tmp_path


def sink(spark, store):
    symbols = spark.createDataFrame([("A", 1)], "symbol string, id int")
    return live.catch_up(f"file://{store}", "day", symbols, spark.createDataFrame([], "old_symbol string, symbol_id int"), ["EQ", "BE"])


def run(spark, store, write):
    live.day_files(spark, str(store / "landed")).writeStream.foreachBatch(write).option("checkpointLocation", str(store / "state")).trigger(availableNow=True).start().awaitTermination()


def results(spark, store):
    now = sorted((r.date.day, r.close, r.source) for r in spark.read.parquet(f"{store}/bars").collect())
    log = sorted((r.trade_date.day, r.status, r.rows) for r in live.ledger(spark, f"file://{store}").collect())
    actions = sorted((r.ex_date.day, r.ratio) for r in spark.read.parquet(f"{store}/actions").collect())
    return now, log, actions


WANT = (
    [(5, 10.0, "first"), (8, 11.0, "file"), (9, 6.0, "file"), (11, 7.0, "file"), (13, 7.5, "file")],
    [(6, "holiday", 0), (8, "ok", 1), (9, "ok", 1), (10, "holiday", 0), (11, "ok", 1), (12, "missing", 0), (13, "ok", 1)],
    [(9, 2.0)],
)


def land(store):
    put(store / "landed", DAY(2024, 1, 8), 11.0, 10.0)
    put(store / "landed", DAY(2024, 1, 9), 6.0, 5.5)  # a split: the close before is half of what is stored
    put(store / "landed", DAY(2024, 1, 10), 6.0, 5.5, of=DAY(2024, 1, 9))  # the file of the day before: a holiday
    put(store / "landed", DAY(2024, 1, 11), 7.0, 6.0)
    put(store / "landed", DAY(2024, 1, 13), 7.5, 7.0)  # a Saturday with a session; the day before is missing


def test_missed_days_are_caught_up_in_order(spark, store):
    land(store)
    run(spark, store, sink(spark, store))
    assert results(spark, store) == WANT


@pytest.mark.parametrize("at", [0, 1, 3, 6, 13])
def test_killed_anywhere_and_begun_again_each_day_counts_once(spark, store, monkeypatch, at):
    """The sink dies before its n-th write; the stream goes on from its checkpoint."""
    land(store)
    real, calls = live.write_slices, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == at + 1:
            raise RuntimeError("killed")
        real(*args)

    monkeypatch.setattr(live, "write_slices", breaks)
    with pytest.raises(Exception, match="killed"):
        run(spark, store, sink(spark, store))
    run(spark, store, sink(spark, store))
    assert results(spark, store) == WANT


def test_days_of_a_later_batch_and_days_too_long_ago(spark, store):
    put(store / "landed", DAY(2024, 1, 8), 11.0, 10.0)
    write = sink(spark, store)
    run(spark, store, write)
    put(store / "landed", DAY(2024, 1, 9), 12.0, 11.0)
    put(store / "landed", DAY(2024, 1, 26), 20.0, 12.0)  # more than ten days after the last one
    run(spark, store, write)
    now, log, _ = results(spark, store)
    assert [d for d, _, _ in now] == [5, 8, 26] and [d for d, s, _ in log if s == "ok"] == [8, 26] and min(d for d, s, _ in log if s == "missing") == 16


def test_interval_joins_have_equal_keys(spark):
    spans = spark.createDataFrame([(1, DAY(2023, 11, 20), DAY(2024, 2, 3)), (2, DAY(2024, 1, 5), DAY(2024, 1, 5)), (3, DAY(2024, 1, 9), DAY(2024, 1, 2)), (4, None, DAY(2024, 1, 2))], "k int, a date, b date")
    points = spark.createDataFrame([(DAY(2023, 11, 19) + dt.timedelta(days=i),) for i in range(90)], "date date")
    got = intervals.within(spans, points, "a", "b")
    assert {r.k: r.n for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 76, 2: 1}
    marks = spark.createDataFrame([(DAY(2023, 12, 1),), (DAY(2024, 1, 1),)], "m date")
    held = intervals.latest_at(points, marks, "date", "m")
    assert {r.m: r.n for r in held.groupBy("m").agg(F.count("*").alias("n")).collect()} == {DAY(2023, 12, 1): 31, DAY(2024, 1, 1): 47}
    for df in (got, held):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
