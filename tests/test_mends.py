"""Cases with literal results: corporate actions, backfills, announcements, rounding, numbering."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.functions.columns import one_decimal
from tideline.operators import jobs
from tideline.plans import api, catalog
from tideline.plans.catalog_more import SUBJECTS
from tideline.sources import files

DAY = dt.date
BARS = "symbol_id int, date date, open double, high double, low double, close double, volume double, delivery_qty double, delivery_pct double, source string"
ACTIONS = "symbol_id int, ex_date date, ratio double, action_type string, resolved boolean"


def bar(symbol, day, price, quantity=7.0):
    return (symbol, DAY(2024, 1, day), price, price, price, price, 10.0, quantity, 50.0, "file")


def resolved(spark, old, fresh, actions):
    got, marked = jobs.resolve_actions(spark.createDataFrame(old, BARS), spark.createDataFrame(fresh, BARS), spark.createDataFrame([(s, DAY(2024, 1, d), r, "open", False) for s, d, r in actions], ACTIONS))
    rows = sorted((r.symbol_id, r.date.day, r.close, r.delivery_qty, r.source) for r in got.collect())
    return rows, {(r.symbol_id, r.ex_date.day): r.action_type for r in marked.collect()}


def test_two_actions_of_a_symbol_are_taken_in_order(spark):
    old = [bar(1, d, 30.0 if d < 4 else 20.0 if d < 7 else 10.0) for d in range(2, 10)]
    rows, kinds = resolved(spark, old, [bar(1, d, 10.0, None) for d in range(2, 9)], [(1, 7, 2.0), (1, 4, 3.0)])
    assert rows == [(1, d, 10.0, 42.0 if d < 4 else 14.0, "fresh") if d < 7 else (1, d, 10.0, 7.0, "file") for d in range(2, 10)]
    assert kinds == {(1, 4): "split", (1, 7): "split"}


def test_an_action_that_does_not_join_on_stays_open_and_the_other_holds(spark):
    old = [bar(1, d, 60.0 if d < 4 else 20.0) for d in range(2, 7)]
    rows, kinds = resolved(spark, old, [bar(1, d, 20.0, None) for d in (2, 3)], [(1, 4, 3.0), (1, 6, 2.0)])  # no fresh bars before the second
    assert [r[2:] for r in rows] == [(20.0, 21.0, "fresh")] * 2 + [(20.0, 7.0, "file")] * 3
    assert kinds == {(1, 4): "split", (1, 6): "open"}


def test_a_second_action_without_sessions_between_is_held_against_what_the_first_left(spark):
    """Between the ex-dates no bar is stored, so the last one before the second is a fresh one."""
    old = [bar(1, 2, 60.0), bar(1, 3, 60.0), bar(1, 8, 5.0)]
    fresh = [bar(1, d, 20.0, None) for d in (2, 3)] + [bar(1, 5, 10.0, None)]
    rows, kinds = resolved(spark, old, fresh, [(1, 4, 3.0), (1, 7, 2.0)])
    assert rows == [(1, 2, 20.0, 42.0, "fresh"), (1, 3, 20.0, 42.0, "fresh"), (1, 5, 10.0, None, "fresh"), (1, 8, 5.0, 7.0, "file")]
    assert kinds == {(1, 4): "split", (1, 7): "split"}


FRESH = "symbol string, date date, open double, high double, low double, close double, volume double, seq int"


def backfilled(spark, fresh, **more):
    stored = spark.createDataFrame([bar(s, d, 9.0) for s in (1, 2) for d in (2, 3)], BARS).drop("delivery_qty", "delivery_pct")
    symbols = spark.createDataFrame([("A", 1, None), ("B", 2, None), ("C", 3, None)], "symbol string, id int, listed_date date")
    return jobs.backfill(stored, symbols, spark.createDataFrame(fresh, FRESH), "2023-12-30", **more)


def test_a_full_backfill_that_brought_nothing_loses_nothing(spark):
    got = backfilled(spark, [], full=True, end="2024-01-05")
    assert got.daily.count() == 4 and [(r.symbol, r.issue) for r in got.issues.collect()] == [("C", "no_data")]


def test_a_full_backfill_replaces_only_symbols_it_has_rows_for(spark):
    fresh = [("A", DAY(2024, 1, d), 1.0, 1.0, 1.0, 1.0, 5.0, 0) for d in (3, 4)]
    got = backfilled(spark, fresh, full=True, end="2024-01-20")
    assert sorted((r.symbol_id, r.date.day, r.close) for r in got.daily.collect()) == [(1, 3, 1.0), (1, 4, 1.0), (2, 2, 9.0), (2, 3, 9.0)]
    assert sorted((r.symbol, r.issue) for r in got.issues.collect()) == [("B", "no_data"), ("C", "no_data")]  # B's last bar is 17 days old


def test_a_benchmark_gives_the_sessions_where_there_is_one(spark):
    fresh = [(s, DAY(2024, 1, d), 1.0, 2.0, 1.0, 2.0, 5.0, 0) for s in "AB" for d in (2, 5)]
    bench = spark.createDataFrame([(DAY(2024, 1, d),) for d in (1, 2, 3, 5)], "date date")
    gaps = lambda got: sorted((r.symbol, r.date.day) for r in got.issues.where("issue = 'gap'").collect())
    assert gaps(backfilled(spark, fresh, benchmark=bench)) == [("A", 3), ("B", 3)]
    assert gaps(backfilled(spark, fresh, benchmark=bench.where("false"))) == [] == gaps(backfilled(spark, fresh))


def test_factors_of_announcements(spark):
    rows = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(SUBJECTS)] + [(99, None, None)], "id int, t string, f double")
    wrong = rows.withColumn("got", files.price_factor(F.col("t"))).where("not (round(got, 9) <=> round(f, 9))").collect()
    assert wrong == [] and len(SUBJECTS) > 30


def test_one_decimal_is_of_the_binary_value(spark):
    values = [0.25, 2.25, 0.35, 1.15, 2.675, 0.05, 0.15, -0.25, -0.04, 12.5, 99.95, 1e6 + 0.05, 3.0, *(i / 20 for i in range(-60, 60))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in got] == [(v, f"{v:.1f}") for v in values]


def test_numbers_go_over_ranges(spark):
    rows = spark.range(5_000).select((F.col("id") * 7 % 5_000).alias("k")).repartition(6)
    got = jobs.numbered(rows, "k", "n")
    assert got.where("n <> k + 1").count() == 0 and got.count() == 5_000


def test_model_portfolio_of_the_latest_run_by_the_rule(spark):
    rule = '"entry_max_weeks_in_trend": 1, "min_score": 70, "top_n_sectors": 0, "sector_exit": false, "entry_filters": "tradeable"'
    runs = [
        (1, None, "{%s, \"max_positions\": 3, \"exit_score_below\": 40}" % rule, "2020-01-03"), (2, 7, "{%s}" % rule, "2020-01-10"), (3, None, "{%s, \"experiment\": \"e\"}" % rule, "2020-01-10"),
        (4, None, "{%s, \"max_positions\": 3, \"exit_score_below\": 40, \"sizing\": \"fixed\", \"position_size\": 0, \"position_pct\": 5}" % rule, "2020-01-10"), (5, None, "{broken", "2020-01-10"), (6, None, "{%s}" % rule.replace("70", "60"), "2020-01-10"), (7, None, None, None),
    ]
    frame = spark.createDataFrame(runs, "id long, sweep_id int, params string, end_date string").selectExpr("id", "sweep_id", "params", "cast(end_date as date) as end_date")
    run = api.model_run(frame, "2020-01-10")
    got = run.first()
    assert (got.id, got.stale, got.k, got.position_size, got.position_pct, got.add_capital, got.exit_score) == (4, False, 3, None, 5.0, False, 40.0)
    trades = spark.createDataFrame(
        [(4, s, "S", "I", None, 50.0, 1.0, r) for s, r in ((1, "end"), (2, "end"), (3, "end"), (4, "end"), (5, "stop"))] + [(1, 9, "S", "I", None, 1.0, 1.0, "end")],
        "run_id long, symbol_id int, symbol string, industry string, entry_date date, entry_price double, qty double, exit_reason string",
    )
    week = spark.createDataFrame([(1, "Bullish", 60.0, 48.0, 80.0), (2, "Bearish", 60.0, None, 80.0), (3, "Bullish", 60.0, 0.0, 39.0)], "symbol_id int, direction string, price double, st_value double, stock_score double")
    held = api.model_holdings(run, trades, week)
    rows = {r.symbol_id: r for r in held.collect()}
    assert {k: r.sell for k, r in rows.items()} == {1: False, 2: True, 3: True, 4: True}  # 4 is not in the week
    assert rows[1].change_pct == pytest.approx(20.0) and rows[1].stop_dist_pct == pytest.approx(25.0) and rows[3].stop_dist_pct is None and rows[4].change_pct is None
    signals = spark.createDataFrame([(1, "A", 90.0, "buy"), (2, "B", 95.0, "buy"), (3, "C", 70.0, "buy"), (4, "D", 99.0, "open")], "symbol_id int, symbol string, score double, state string")
    assert [(r.symbol, r.free_slots) for r in api.model_buys(run, held, signals).orderBy("place").collect()] == [("B", 2), ("A", 2)]
    unlimited = run.withColumn("k", F.lit(None).cast("int"))
    assert api.model_buys(unlimited, held, signals).count() == 3
    stale = api.model_run(frame, "2020-01-17")
    assert stale.first().stale and api.model_holdings(stale, trades, week).count() == 0 and api.model_buys(stale, held, signals).count() == 0
    assert api.model_run(frame.where("id > 4"), "2020-01-10").count() == 0


def test_model_run_is_found_behind_any_number_of_newer_runs(spark):
    rule = '{"entry_max_weeks_in_trend": 1, "min_score": 70, "top_n_sectors": 0, "sector_exit": false, "entry_filters": "tradeable", "exit_score_below": 40}'
    runs = spark.range(1, 402).selectExpr("id", "cast(null as int) as sweep_id", f"case when id <= 2 then '{rule}' when id % 2 = 0 then '{{}}' end as params", "date'2020-01-10' as end_date")
    run = api.model_run(runs, "2020-01-10")
    assert [(r.id, r.stale, r.exit_score) for r in run.collect()] == [(2, False, 40.0)]
    trades = spark.createDataFrame([(2, 1, "S", "I", None, 50.0, 1.0, "end")], "run_id long, symbol_id int, symbol string, industry string, entry_date date, entry_price double, qty double, exit_reason string")
    week = spark.createDataFrame([(1, "Bullish", 60.0, 48.0, 39.0)], "symbol_id int, direction string, price double, st_value double, stock_score double")
    held = api.model_holdings(run, trades, week)
    assert [(r.run_id, r.symbol_id, r.sell) for r in held.collect()] == [(2, 1, True)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # once a run, and not for trades


def test_model_holdings_are_their_sql_where_the_run_is_older_than_150_others(spark, tmp_path):
    given = "/root/testdata/sf0.001"
    for t in ("lineitem", "orders", "part"):
        os.symlink(f"{given}/{t}.parquet", tmp_path / f"{t}.parquet")
    keys = spark.range(1_000).where("id <= 100 or id % 7 <> 3")  # the newest of the rule is 87
    keys.selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.queries()["api_model_holdings"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for t, files_of in (("lineitem", ""), ("orders", ""), ("part", ""), ("customer", "/*.parquet")):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{files_of}'")
    want = con.execute(catalog.oracle_sql()["api_model_holdings"]).df()
    rows = lambda df: sorted((r.run_id, r.symbol_id, str(r.entry_date)[:10], r.qty, bool(r.sell)) for r in df.itertuples())
    assert rows(got) == rows(want) and len(got) > 0 and set(got.run_id) == {87}
