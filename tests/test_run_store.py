"""Runs at rest: written, replaced, read back and joined."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.backtest import store

DAY = dt.date


def result(spark, ids, worth, sweep="s"):
    runs = spark.createDataFrame([(i, sweep, f"run {i}", "{}", "{}", None) for i in ids], store.RUNS)
    equity = spark.createDataFrame([(i, DAY(2024, 1, d), worth * d, None, -1.0 * d, None, None, 0.0) for i in ids for d in (1, 2)], store.EQUITY)
    trades = spark.createDataFrame([(i, 1, "A", None, None, DAY(2024, 1, 1), 1.0, None, None, 1.0, worth, None, None, "end", None) for i in ids[1:]], store.TRADES)
    return store.Result(runs, equity, trades)


def test_round_trip_and_replacement(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = store.RunStore(spark, root, 4)
    made = result(spark, [1, 2, 3], 10.0)
    first.save("a", made)
    first.save("b", result(spark, [4, 5], 1.0, "t"))
    again = store.RunStore(spark, root, 4)  # another session's view of the same folder
    for got, want in zip(vars(again.load("a")).values(), vars(made).values(), strict=True):
        assert got.drop("experiment").exceptAll(want).count() == 0 == want.exceptAll(got.drop("experiment")).count()
    again.save("a", result(spark, [2, 9], 7.0))  # fewer runs: the old ones are gone with their curves and trades
    assert sorted((r.run_id, r.experiment, r.final_equity, r.trades, r.pnl) for r in store.RunStore(spark, root, 4).overview().collect()) == [(2, "a", 14.0, 0, 0.0), (4, "b", 2.0, 0, 0.0), (5, "b", 2.0, 1, 1.0), (9, "a", 14.0, 1, 7.0)]
    sweep = again.sweep("t")
    assert (sweep.runs.count(), sweep.equity.count(), sweep.trades.count()) == (2, 4, 1)
    with pytest.raises(ValueError):
        again.save("../x", made)


def test_joins_by_run_shuffle_nothing(spark, tmp_path):
    runs = store.RunStore(spark, f"file://{tmp_path}", 4)
    runs.save("a", result(spark, [1, 2], 1.0))
    for df in (runs.overview(), runs.sweep("s").equity, runs.load().equity.groupBy("run_id").agg(F.count("*"))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
