import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline import config
from tideline.backtest import metrics, study
from tideline.operators import bars, checks, history, indicators, ingest, regime, scan, scoring, sectors, trend
from tideline.plans import api
from tideline.sources import files, store
from tideline.sources.market import Market, market

DAY = dt.date


# -------------------------------------------------------------------- config


def test_config_layers_and_unknown_keys():
    assert config.Config().penalties.points["overextended"] == 10
    assert config.live().penalties.points["overextended"] == 0
    assert config.live({"filters": {"min_price": 5}}).filters.min_price == 5
    with pytest.raises(KeyError):
        config.live({"filters": {"no_such": 1}})


# --------------------------------------------------------------- bars, trend


def daily(spark, rows):
    return spark.createDataFrame(rows, "symbol_id int, date date, open double, high double, low double, close double, volume long, delivery_pct double")


def test_weekly_bars_weekend_holiday_and_cutoff(spark):
    days = [DAY(2024, 1, 1), DAY(2024, 1, 4), DAY(2024, 1, 6), DAY(2024, 1, 8)]
    d = daily(spark, [(1, x, 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, None if i else 5, None) for i, x in enumerate(days)])
    got = {r.monday: r for r in bars.weekly_bars(d).collect()}
    first = got[DAY(2024, 1, 1)]
    assert (first.open, first.high, first.low, first.close, first.volume, first.trading_days, first.week_end_date) == (10, 14, 9, 13, 5, 3, DAY(2024, 1, 6))
    assert got[DAY(2024, 1, 8)].volume == 0
    assert bars.weekly_bars(d, DAY(2024, 1, 11)).count() == 1


def random_bars(n, seed=0, symbol=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.002, 0.04, n)))
    span = np.abs(rng.normal(0, 0.03, n)) * close
    days = [DAY(2010, 1, 1) + dt.timedelta(days=7 * i) for i in range(n)]
    return [(symbol, d, float(c + s), float(c - s), float(c)) for d, c, s in zip(days, close, span, strict=True)]


WEEKLY = "symbol_id int, week_end_date date, high double, low double, close double"


def test_trend_from_state_is_trend_of_all(spark):
    rows = random_bars(150, 1, 1) + random_bars(120, 2, 2) + random_bars(5, 3, 3)
    w = spark.createDataFrame(rows, WEEKLY)
    full = trend.trend(w, 7, 3.0)
    cut = DAY(2011, 6, 1)
    state = trend.last_state(trend.trend(w.where(F.col("week_end_date") <= cut), 7, 3.0), 7, 3.0)
    rest = trend.trend_from_state(w.where(F.col("week_end_date") > cut), state, 7, 3.0)
    a = {(r.symbol_id, r.week_end_date): r for r in full.where(F.col("week_end_date") > cut).collect()}
    b = {(r.symbol_id, r.week_end_date): r for r in rest.collect()}
    assert a.keys() == b.keys() and a == b and len(a) > 100
    assert full.where("symbol_id = 3").count() == 0
    final = trend.last_state(rest, 7, 3.0, state).orderBy("symbol_id").collect()
    whole = trend.last_state(full, 7, 3.0).orderBy("symbol_id").collect()
    assert [(r.flip_date, r.flip_price, r.weeks_in_trend) for r in final] == [(r.flip_date, r.flip_price, r.weeks_in_trend) for r in whole]


def test_trend_plan_routes(spark):
    latest = spark.createDataFrame([(i, DAY(2024, 2, 9)) for i in range(1, 7)], "symbol_id int, latest_week date")
    s = [(1, DAY(2024, 2, 2), 7, 3.0, 1.0), (2, DAY(2024, 2, 9), 7, 3.0, 1.0), (3, DAY(2024, 2, 2), 10, 3.0, 1.0), (4, DAY(2024, 2, 2), 7, 3.0, None), (6, DAY(2024, 2, 2), 7, 3.0, 1.0)]
    state = spark.createDataFrame(s, "symbol_id int, week_end_date date, atr_period int, multiplier double, atr double")
    changed = spark.createDataFrame([(6, DAY(2024, 1, 5)), (1, DAY(2024, 2, 9))], "symbol_id int, first_changed date")
    got = {r.symbol_id: r.plan for r in trend.plan_trend(latest, state, changed, 7, 3.0).collect()}
    assert got == {1: "incremental", 2: "none", 3: "full", 4: "full", 5: "full", 6: "full"}
    assert {r.plan for r in trend.plan_trend(latest, state, changed, 7, 3.0, True).collect()} == {"full"}


def test_ewm_is_that_of_pandas_with_gaps(spark):
    x = [None, 1.0, None, None, 4.0, 2.0, None, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, v double")
    got = [r.m for r in indicators.ewm(df, "k", "i", "v", "m", 0.3, 2).orderBy("i").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=False, min_periods=2).mean()
    assert all((g is None or math.isnan(g)) if math.isnan(w) else abs(g - w) < 1e-12 for g, w in zip(got, want, strict=True))


def test_scan_never_looks_ahead(spark):
    m = market(spark, "/root/testdata/sf0.01")
    cut = DAY(1999, 6, 4)
    cfg = config.live({"filters": {"min_turnover_cr": 0.001}})
    short = Market(m.symbols, m.daily.where(F.col("date") <= cut), m.benchmark.where(F.col("date") <= cut))
    columns = ["symbol_id", "direction", "weeks_in_trend", "price", "rs_rating", "sector_rank", "stock_score", "regime", "reasons"]
    rows = lambda x: sorted(map(tuple, scan.scan(x, cfg).stocks.where(F.col("week_end_date") == cut).select(*columns).collect()))
    a, b = rows(m), rows(short)
    assert a == b and len(a) == 25


def test_exclusions_and_members(spark):
    weeks = spark.createDataFrame([(DAY(2024, 1, 5),), (DAY(2024, 1, 12),)], "week_end_date date")
    rows = spark.createDataFrame([(DAY(2024, 1, 3), 1), (DAY(2024, 1, 15), 2)], "as_of_date date, symbol_id int")
    got = {(r.week_end_date, r.symbol_id) for r in scan.as_of_snapshot(rows, weeks, "as_of_date", 7).collect()}
    assert got == {(DAY(2024, 1, 5), 1), (DAY(2024, 1, 12), 2)}
    assert {r.symbol_id for r in scan.as_of_snapshot(rows, weeks, "as_of_date").collect()} == {1}


# ------------------------------------------------------------------ scoring

GOOD = {
    "monday": "w", "symbol": "A", "direction": "Bullish", "is_new_flip": False, "price": 200.0, "st_value": 190.0, "weeks_in_trend": 2, "sma50": 180.0, "sma150": 170.0, "sma200": 160.0, "sma200_prev": 150.0,
    "pct_above_low": 50.0, "pct_from_high": 3.0, "rs_rating": 90.0, "avg_turnover_20d_cr": 20.0, "in_asm_gsm": False, "sector_tradeable": True, "pct_from_st": 5.0, "confirm_vol_ratio": 2.0,
    "tightness_ratio": 0.6, "atr_pct": 2.0, "atr_pct_prev": 3.0, "delivery_pct_latest": 60.0, "delivery_pct_20d": 50.0, "rs_vs_sector": 1.0, "pct_since_flip": 10.0, "n_sectors": 5, "sector_rank": 1, "regime": "bull",
}


def score(spark, *changes):
    rows = [GOOD | {"symbol": chr(65 + i)} | c for i, c in enumerate(changes)]
    kinds = {str: "string", bool: "boolean", float: "double", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in GOOD.items())
    df = spark.createDataFrame([tuple(r[k] for k in GOOD) for r in rows], schema)
    return {r.symbol: r for r in scoring.score_stocks(df, config.Config(), ["monday"]).collect()}


CASES = {
    "f_trend": {"direction": "Bearish"}, "f_sector": {"sector_tradeable": None}, "f_trend_template": {"sma200_prev": None}, "f_52w_range": {"pct_from_high": 30.0}, "f_rs": {"rs_rating": None},
    "f_liquidity": {"avg_turnover_20d_cr": 1.0}, "f_price": {"price": 49.0}, "f_not_asm": {"in_asm_gsm": True},
}


def test_each_filter_fails_alone(spark):
    got = score(spark, {}, *CASES.values())
    assert got["A"].qualified and got["A"].grade in ("A+", "A") and all(got["A"][s] for s in scoring.SIGNALS)
    for letter, name in zip("BCDEFGHI", CASES, strict=True):
        assert not got[letter][name] and not got[letter].qualified, name
    assert got["A"].reasons.startswith("Fresh flip 2w, Near high 3.0%, Vol 2.0x, Stop 5.0%, VCP, Accumulation, Sector leader")
    assert got["F"].reasons.endswith("✗ RS n/a")
    assert got["B"].reasons.startswith("Bearish") and got["B"].grade is None and got["B"].stop_price is None


def test_trade_plan(spark):
    got = score(spark, {}, {"st_value": 210.0}, {"regime": "bear"}, {"price": 195.0, "st_value": 194.9})
    assert got["A"].position_qty == 1000 and got["A"].stop_price == 190.0 and abs(got["A"].risk_pct - 5) < 1e-9
    assert got["B"].position_qty is None
    assert got["C"].position_qty == 500 and got["C"].reasons.endswith("Bear regime: reduce size")
    assert got["D"].position_qty == math.floor(250_000 / 195)


def test_rs_rating_renormalises(spark):
    df = spark.createDataFrame([("w", 10.0, 10.0, 10.0, 10.0), ("w", 20.0, None, None, None), ("w", None, 50.0, 1.0, 1.0), ("w", 10.0, 10.0, 10.0, 10.0)], "monday string, ret_3m double, ret_6m double, ret_9m double, ret_12m double")
    got = sorted((r.rs_raw is None, r.rs_raw, r.rs_rating) for r in scoring.rs_rating(df, config.Config().relative_strength.weights, ["monday"]).collect())
    assert [g[2] for g in got] == [50.0, 50.0, 99.0, None]


def test_regime_truth_table(spark):
    weeks = spark.createDataFrame([("a", DAY(2024, 1, 10), 60.0), ("b", DAY(2024, 1, 10), 40.0)], "k string, week_end_date date, market_breadth_pct double")

    def of(close, sma, before):
        t = spark.createDataFrame([(DAY(2024, 1, 9), close, sma, before)], "date date, close double, sma double, sma_before double")
        return {r.k: r.regime for r in regime.market_regime(weeks, t).collect()}

    assert of(110.0, 100.0, 99.0) == {"a": "bull", "b": "neutral"}
    assert of(90.0, 100.0, 99.0) == {"a": "neutral", "b": "bear"}
    assert of(90.0, 100.0, 101.0) == {"a": "bear", "b": "bear"}
    assert of(90.0, None, None) == {"a": "neutral", "b": "neutral"}


def test_quadrants(spark):
    df = spark.createDataFrame([(101.0, 101.0), (101.0, 99.0), (99.0, 99.0), (99.0, 101.0), (None, 1.0)], "a double, b double")
    assert [r.q for r in df.select(sectors.quadrant(F.col("a"), F.col("b")).alias("q")).collect()] == ["Leading", "Weakening", "Lagging", "Improving", None]


# ---------------------------------------------------------------- simulation


def test_time_weighted_curve_and_xirr(spark):
    rows = [(1, DAY(2024, 1, 5), 100.0, 0.0), (1, DAY(2024, 1, 12), 160.0, 50.0), (1, DAY(2024, 1, 19), 80.0, 0.0)]
    got = metrics.time_weighted(spark.createDataFrame(rows, "run_id int, date date, equity double, flow double"), 1000.0).orderBy("date").collect()
    assert [r.nav for r in got] == pytest.approx([1000.0, 1000 * 160 / 150, 1000 * 160 / 150 / 2])
    dates = [pd.Timestamp(2024, 1, 1), pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=365.25)]
    assert metrics.xirr(dates, np.array([-100.0, 110.0])) == pytest.approx(10, abs=0.1)
    assert metrics.xirr(dates, np.array([1.0, 1.0])) is None


def test_walk_forward_picks_by_training_only(spark):
    days = [DAY(2020, 1, 3) + dt.timedelta(days=7 * i) for i in range(157)]
    rows, trades = [], []
    for r in range(2):
        nav = 1e6
        for i, d in enumerate(days):
            good = (d.year < 2021) == (r == 0)
            nav *= 1.01 if good and i else 0.999
            rows.append((r, d, nav, nav, 100.0, 1, 1000.0 + i))
            if i % 8 == 0:
                trades.append((r, 1, f"S{r}", "A", d, d, 10.0, d, 11.0, 100, 100.0, 10.0, 1, "end", 80.0))
    equity = spark.createDataFrame(rows, "run_id int, date date, equity double, nav double, invested_pct double, positions int, benchmark double")
    bought = spark.createDataFrame(trades, "run_id int, symbol_id int, symbol string, industry string, signal_date date, entry_date date, entry_price double, exit_date date, exit_price double, qty long, pnl double, pnl_pct double, weeks_held int, exit_reason string, entry_score double")
    line, sold, spans = study.walk_forward(equity, bought, 1e6, 1, 1, top_k=1)
    assert len(spans) == 2 and spans[-1].test_end == pd.Timestamp(days[-1])
    first = line.where(F.col("fold") == 0).orderBy("date").collect()
    assert first[-1].equity < 1e6  # the run that was best in training does badly after
    assert {r.symbol for r in sold.where(F.col("entry_date") < "2022-01-01").collect()} == {"S0"}


def test_sweep_sets():
    sets = study.sweep_sets({"min_rs": [70, 80]}, {"exit": {"plain": {}, "sector": {"sector_exit": True}}})
    assert len(sets) == 4 and sets[1][1] == {"min_rs": 70, "sector_exit": True}


# ------------------------------------------------------- parsers, read API


def test_delivery_file(spark, tmp_path):
    text = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER\n"
    text += "AAA, BE, 02-Jan-2024, 1, 2, 3, 1, 2, 2, 2, 100, 1, 1, 50, 50\nAAA, EQ, 02-Jan-2024, 1, 2, 3, 1, 2, 9, 2, 100, 1, 1, -, -\nFUND, GB, 02-Jan-2024, 1, 2, 3, 1, 2, 2, 2, 100, 1, 1, 50, 50\n"
    (tmp_path / "d.csv").write_text(text)
    rows = files.read_delivery(spark, str(tmp_path / "d.csv"), ["EQ", "BE"]).collect()
    assert [(r.symbol, r.series, r.close, r.delivery_qty, r.date) for r in rows] == [("AAA", "EQ", 9.0, None, DAY(2024, 1, 2))]
    (tmp_path / "bad.csv").write_text("SYMBOL,SERIES\nA,EQ\n")
    with pytest.raises(ValueError):
        files.read_delivery(spark, str(tmp_path / "bad.csv"), ["EQ"])


def test_archive_of_both_layouts(spark, tmp_path):
    import zipfile

    from tideline.sources import archive

    old = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,ISIN\nAAA,EQ,1,2,1,2,1,10,20,INE1\n"
    new = "FinInstrmTp,TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal\nSTK,AAA,EQ,INE1,1,2,1,3,1,10,20\nIDX,MARKET,EQ,INE2,1,2,1,3,1,10,20\n"
    for name, text in (("cm20200102.zip", old), ("cm20240102.zip", new)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.csv", text)
    rows = archive.archive(spark, str(tmp_path / "*.zip"), ["EQ"]).orderBy("date").collect()
    assert [(r.date, r.symbol, r.close) for r in rows] == [(DAY(2020, 1, 2), "AAA", 2.0), (DAY(2024, 1, 2), "AAA", 3.0)]


def test_surveillance_lists(spark):
    asm = json.dumps({"longterm": {"data": [{"symbol": "A ", "isin": "I1", "stage": "1"}]}, "shortterm": {"data": [{"symbol": "A", "isin": "I1", "stage": "2"}]}})
    df = spark.createDataFrame([(asm, json.dumps([{"symbol": "B", "isin": "I2", "stage": "0"}] * 2))], "asm string, gsm string")
    assert sorted((r.list_type, r.symbol, r.stage) for r in files.parse_surveillance(df).collect()) == [("ASM_LT", "A", "1"), ("ASM_ST", "A", "2"), ("GSM", "B", "0")]


def test_upsert_coerces_unknown_numbers(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, s string")
    new = spark.createDataFrame([(2, float("inf"), "x"), (3, float("nan"), "y")], "k int, v double, s string")
    got = {r.k: (r.v, r.s) for r in store.upsert(old, store.coerce(new, old.schema), ["k"]).collect()}
    assert got == {1: (1.0, "a"), 2: (None, "x"), 3: (None, "y")}
    with pytest.raises(ValueError):
        store.coerce(new.withColumn("z", F.lit(1)), old.schema)


def test_upsert_keeps_the_last_of_a_key_and_append_checks(spark):
    old = spark.createDataFrame([(1, 1.0, "a")], "k int, v double, s string")
    new = spark.createDataFrame([(2, 2.0, "first"), (2, 3.0, "last"), (1, 5.0, "x"), (1, 4.0, "y")], "k int, v double, s string").coalesce(1)
    assert {r.k: (r.v, r.s) for r in store.upsert(old, new, ["k"]).collect()} == {1: (4.0, "y"), 2: (3.0, "last")}
    assert {r.k: r.s for r in store.upsert(old, new, ["k"], order="v").collect()} == {1: "x", 2: "last"}
    assert store.upsert(old, new, ["k"], []).count() == 2
    assert store.append(old, new.drop("s")).count() == 5
    with pytest.raises(ValueError):
        store.append(old, new.withColumn("z", F.lit(1)))


def test_publish_writes_the_run_row_last(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "symbol_id int, v double")
    for week in ("2024-01-05", "2024-01-12", "2024-01-12"):
        store.publish(spark, str(tmp_path), week, {"stocks": df}, spark.createDataFrame([("complete",)], "status string"))
    assert spark.read.parquet(str(tmp_path / "stocks")).count() == 2
    assert api.resolve_week(spark.read.parquet(str(tmp_path / "scan_runs"))).first().week_end_date == DAY(2024, 1, 12)


def test_export_has_the_published_columns():
    assert len(files.EXPORT) == 19 and len(files.EXPORT | files.EXPORT_MORE) == 34


def test_filter_spec_presets_and_overrides():
    spec = api.FilterSpec.from_params({"preset": "best", "grade": "B", "wmin": "x"})
    assert spec.qualified and spec.grades == ("B",) and spec.weeks_least is None


def test_signal_states(spark):
    days = [DAY(2024, 1, 5) + dt.timedelta(days=7 * i) for i in range(6)]
    base = [("Bullish", 1, 80.0), ("Bullish", 2, 80.0), ("Bullish", 3, 20.0), ("Bearish", 1, 10.0), ("Bullish", 1, 75.0), ("Bullish", 2, 75.0)]
    rows = [(1, "A", "X", d, x, w, s, True, True, True, 100.0 + i, "A", 90.0) for i, (d, (x, w, s)) in enumerate(zip(days, base, strict=True))]
    df = spark.createDataFrame(rows, "symbol_id int, symbol string, industry string, week_end_date date, direction string, weeks_in_trend int, stock_score double, f_liquidity boolean, f_price boolean, f_not_asm boolean, price double, grade string, st_value double")
    assert [r.label for r in api.states(df).orderBy("week_end_date").collect()] == ["buy", "hold", "sell", None, "buy", "hold"]
    r = api.signals(df).first()
    assert (r.state, r.signal_week, r.weeks) == ("open", days[4], 1)
    assert api.signals(df.where(F.col("week_end_date") <= days[2])).first().state == "exit"


def test_history_links_long_chains(spark):
    rows = [(f"T{i + k:04}", f"INE{i:09}") for i in range(400) for k in (0, 1)] + [("A", None), ("B", "short"), (None, "INE000000001")]
    got = {r.symbol: r.root for r in history.linked_symbols(spark.createDataFrame(rows, "symbol string, isin string")).collect()}
    assert got == {f"T{i:04}": "T0000" for i in range(401)} | {"A": "A", "B": "B", None: None}


def test_history_events_and_gaps(spark):
    rows = [(DAY(2024, 1, d), "A", "INE000000001", 1) for d in (1, 2, 3)] + [(DAY(2026, 1, 1), "A", None, 1)]
    df = spark.createDataFrame(rows, "date date, symbol string, isin string, v int")
    assert history.entities(df).select("entity").distinct().count() == 2
    e = history.entities(df)
    events = spark.createDataFrame([("A", "INE000000001", DAY(2024, 1, 2), 0.5), ("A", "INE000000001", DAY(2024, 1, 2), 0.5), ("A", "INE000000001", DAY(2025, 6, 1), 0.5)], "symbol string, isin string, ex_date date, factor double")
    got = history.place_events(events, e).collect()
    assert [(r.date, r.factor) for r in got] == [(DAY(2024, 1, 2), 0.25)]


def test_previous_session_and_pending(spark):
    b = spark.createDataFrame([(DAY(2024, 1, 4),)], "date date")
    log = spark.createDataFrame([("bhavcopy", DAY(2024, 1, 5), "ok"), ("bhavcopy", DAY(2024, 1, 8), "failed")], "source string, trade_date date, status string")
    assert ingest.previous_session(b, log, "2024-01-09").first().previous == DAY(2024, 1, 5)
    assert {r.date for r in ingest.pending_dates(log, "2024-01-03", "2024-01-09", 4).collect()} == {DAY(2024, 1, 4), DAY(2024, 1, 8), DAY(2024, 1, 9)}


def test_coverage_and_listed_issues(spark):
    log = spark.createDataFrame([('["a","b"]',), ('["a"]',)], "details string")
    assert {r.issue: r.n for r in checks.count_listed(log).collect()} == {"a": 2, "b": 1}


# ------------------------------------------------------------------ streams


def test_stream_trend_is_batch_trend(spark, tmp_path):
    from tideline.streaming import live

    rows = sorted(random_bars(60, 5, 1) + random_bars(60, 6, 2), key=lambda r: r[1])
    w = spark.createDataFrame(rows, WEEKLY)
    want = sorted(map(tuple, trend.trend(w, 7, 3.0).collect()))
    for i in range(3):
        spark.createDataFrame(rows[i * 40 : (i + 1) * 40], WEEKLY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (
            live.trend(spark.readStream.schema(w.schema).parquet(str(tmp_path / "in")))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == want


def test_stream_upsert_keeps_the_last_and_drops_nothing(spark, tmp_path):
    from tideline.streaming import live

    path = str(tmp_path / "t")
    write = live.upsert_each_batch(path, ["k", "day"], ["day"], "at")
    batches = [[(1, 1, "a", 1), (1, 2, "other day", 1)], [(1, 1, "c", 3), (1, 1, "b", 2), (2, 1, "x", 3)], [(1, 1, "c", 3), (2, 1, "x", 3)], [(2, 1, "late", 1), (3, 1, "y", 4)]]
    for n, rows in zip((0, 1, 1, 7), batches, strict=True):  # a batch again, and a number left out
        write(spark.createDataFrame(rows, "k int, day int, s string, at int"), n)
    assert {(r.k, r.day): r.s for r in spark.read.parquet(path).collect()} == {(1, 1): "c", (1, 2): "other day", (2, 1): "x", (3, 1): "y"}
    with pytest.raises(ValueError):
        live.upsert_each_batch(path, ["k"], ["day"], "at")


# --------------------------------------------------------------------- jobs


def test_run_rows(spark):
    from tideline.operators import jobs

    runs = spark.createDataFrame([("2024-01-05", "complete")], "w string, status string").select(F.col("w").cast("date").alias("week_end_date"), "status", *(F.lit(None).cast(t).alias(c) for c, t in (("started_at", "timestamp"), ("finished_at", "timestamp"), ("error", "string"))))
    for week in ("2024-01-05", "2024-01-12"):
        runs = jobs.start_run(runs, week, "2024-01-13 10:00:00")
    runs = jobs.end_run(jobs.end_run(runs, "2024-01-12", "2024-01-13 10:01:00", "broken"), "2024-01-05", "2024-01-13 10:01:00", "late")
    assert {str(r.week_end_date): (r.status, r.error) for r in runs.collect()} == {"2024-01-05": ("complete", None), "2024-01-12": ("failed", "broken")}


def test_ingest_of_a_day_writes_by_route(spark):
    from tideline.operators import jobs

    columns = "symbol_id int, date date, open double, high double, low double, close double, volume double, delivery_qty double, delivery_pct double, source string"
    old = [(1, DAY(2024, 1, 4), 1.0, 2.0, 1.0, 2.0, 5.0, None, None, "v"), (2, DAY(2024, 1, 5), 1.0, 2.0, 1.0, 2.0, 5.0, None, None, "v"), (3, DAY(2024, 1, 4), 10.0, 10.0, 10.0, 10.0, 5.0, None, None, "v"), (3, DAY(2024, 1, 8), 10.0, 10.0, 10.0, 10.0, 5.0, None, None, "v")]
    feed = [(s, 10.0, 12.0, 9.0, 11.0, 100.0, p, 50.0, 40.0) for s, p in (("A", 1.0), ("B", 2.0), ("OLDC", 5.0), ("BAD", 1.0))]
    feed[3] = ("BAD", -1.0, 12.0, 9.0, 11.0, 100.0, 1.0, 50.0, 40.0)
    got = jobs.ingest_day(
        spark.createDataFrame(feed, "symbol string, open double, high double, low double, close double, volume double, prev_close double, delivery_qty double, delivery_pct double"),
        spark.createDataFrame(old, columns), spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "symbol string, id int"), spark.createDataFrame([("OLDC", 3), ("A", 9)], "old_symbol string, symbol_id int"), "2024-01-05", "2024-01-04",
    )
    rows = {(r.symbol_id, r.date): (r.close, r.volume, r.delivery_qty) for r in got.daily.collect()}
    day = DAY(2024, 1, 5)
    assert rows[1, day] == (11.0, 100.0, 50.0) and rows[2, day] == (2.0, 5.0, 50.0) and rows[3, day] == (22.0, 50.0, 25.0) and len(rows) == 6
    assert [(r.symbol_id, r.ratio) for r in got.actions.collect()] == [(1, 2.0)]
    assert [r.issue for r in got.issues.collect()] == ["bad_price"]


def test_backtest_tables_and_lists(spark, tmp_path):
    runs = spark.createDataFrame(
        [(1, "a", None, '{"sizing":"fixed","min_score":70}', '{"cagr_pct":5.0}'), (2, "b", "s", '{"experiment":"x","variant":"v"}', '{"cagr_pct":7.0}'), (3, "c", "s", '{"experiment":"x","variant":"w"}', '{"cagr_pct":9.0}')],
        "id int, name string, sweep_id string, params string, metrics string",
    )
    assert [(r.id, r.sizing, r.min_score) for r in api.backtests(runs).collect()] == [(1, "fixed", 70.0)]
    assert [(r.variant, r.place) for r in api.experiment_log(runs).orderBy("place").collect()] == [("w", 1), ("v", 2)]
    flows = spark.createDataFrame([(1, DAY(2023, 1, 1), -100.0), (1, DAY(2024, 1, 1), 110.0), (2, DAY(2023, 1, 1), 1.0)], "run_id int, date date, amount double")
    got = {r.run_id: r.xirr_pct for r in metrics.xirr_by_run(flows).collect()}
    assert abs(got[1] - 10) < 0.1 and (got[2] is None or math.isnan(got[2]))
    e = spark.createDataFrame([(1, DAY(2024, 1, 5), 10.0, None, 10.0), (1, DAY(2024, 1, 12), 12.0, 11.0, 15.0)], "run_id int, date date, equity double, nav double, contributed double")
    assert [(r.nav, r.flow) for r in study.reload(e).orderBy("date").collect()] == [(10.0, 0.0), (11.0, 5.0)]



def test_clock_of_the_last_complete_session():
    from tideline.operators import jobs

    assert jobs.last_complete_session(dt.datetime(2024, 1, 5, 16, 0)) == DAY(2024, 1, 5)
    assert jobs.last_complete_session(dt.datetime(2024, 1, 1, 15, 59)) == DAY(2023, 12, 31)


def test_resolved_actions_are_marked(spark):
    from tideline.operators import jobs

    columns = "symbol_id int, date date, open double, high double, low double, close double, volume double, delivery_qty double, delivery_pct double, source string"
    bar = lambda s, d, x, q: (s, DAY(2024, 1, d), x, x, x, x, 10.0, q, 50.0, "file")
    old = spark.createDataFrame([bar(s, d, 100.0 if d < 4 else 50.0, 7.0) for s in (1, 2) for d in (2, 3, 4)], columns)
    fresh = spark.createDataFrame([bar(1, d, 50.0, None) for d in (2, 3)] + [bar(2, d, 100.0, None) for d in (2, 3)], columns)
    actions = spark.createDataFrame([(s, DAY(2024, 1, 4), 2.0, "open", False) for s in (1, 2)], "symbol_id int, ex_date date, ratio double, action_type string, resolved boolean")
    bars_out, marked = jobs.resolve_actions(old, fresh, actions)
    got = {(r.symbol_id, r.date.day): (r.close, r.delivery_qty, r.source) for r in bars_out.collect()}
    assert got[1, 3] == (50.0, 14.0, "fresh") and got[1, 4] == (50.0, 7.0, "file") and got[2, 3] == (100.0, 7.0, "file") and len(got) == 6
    assert {r.symbol_id: (r.action_type, r.resolved) for r in marked.collect()} == {1: ("split", True), 2: ("open", False)}


def test_backfill_adds_what_is_missing(spark):
    from tideline.operators import jobs

    daily_ = spark.createDataFrame([(1, DAY(2024, 1, 2), 9.0, 9.0, 9.0, 9.0, 1.0, "file")], "symbol_id int, date date, open double, high double, low double, close double, volume double, source string")
    symbols = spark.createDataFrame([("A", 1, None), ("B", 2, None), ("C", 3, None)], "symbol string, id int, listed_date date")
    fresh = [(s, DAY(2024, 1, d), 1.0, 2.0, 1.0, 2.0, 5.0, 0) for s in ("A", "B") for d in (2, 3, 4, 5) if (s, d) != ("B", 3)] + [("B", DAY(2024, 1, 8), -1.0, 2.0, 1.0, 2.0, 5.0, 0)]
    got = jobs.backfill(daily_, symbols, spark.createDataFrame(fresh, "symbol string, date date, open double, high double, low double, close double, volume double, seq int"), "2023-12-01")
    rows = {(r.symbol_id, r.date.day): (r.close, r.source) for r in got.daily.collect()}
    assert rows[1, 2] == (9.0, "file") and rows[1, 3] == (2.0, "backfill") and len(rows) == 7
    assert {r.symbol: r.listed_date for r in got.symbols.collect()} == {"A": DAY(2024, 1, 2), "B": DAY(2024, 1, 2), "C": None}
    assert sorted((r.symbol, r.issue) for r in got.issues.collect()) == [("B", "bad_price"), ("B", "gap"), ("C", "no_data")]


def test_index_refresh_keeps_days_and_adds_one_snapshot(spark):
    from tideline.operators import jobs

    members = spark.createDataFrame([(1, 1, DAY(2020, 1, 1)), (1, 2, None), (3, 9, None)], "index_id int, symbol_id int, added_on date")
    snapshots = spark.createDataFrame([(1, 1, DAY(2024, 1, 1))], "index_id int, symbol_id int, snapshot_date date")
    fresh = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 5), (2, 5)], "index_id int, symbol_id int")
    now, dated = jobs.refresh_index(members, snapshots, fresh, "2024-01-08")
    assert {(r.index_id, r.symbol_id): r.added_on for r in now.collect()} == {(1, 1): DAY(2020, 1, 1), (1, 2): None, (1, 3): DAY(2024, 1, 8), (2, 5): None, (3, 9): None}
    assert dated.count() == 5 and jobs.refresh_index(now, dated, fresh, "2024-01-08")[1].count() == 5
