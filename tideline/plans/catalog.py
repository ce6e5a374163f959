"""Registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline import config
from tideline.functions.columns import monday
from tideline.operators import bars, indicators, scan, sectors, trend
from tideline.plans.oracle import query
from tideline.sources.market import Market, market

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Options of the registered scans: live, with a turnover that the test market can reach.
TURNOVER = 0.001


def scan_config() -> config.Config:
    return config.live({"filters": {"min_turnover_cr": TURNOVER}})


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            # DuckDB rounds to a negative zero, Spark to zero
            _SQL[f.__name__] = re.sub(r", ([2-6])\) as (?!double)", r", \1) + 0.0 as ", sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) as {c}" for c in columns.split())


def _trend(m: Market) -> DataFrame:
    return trend.trend(bars.weekly_bars(m.daily))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in an up-trend in the latest week, newest trends first."""
    return latest_bullish(spark, sf_dir).orderBy("weeks_in_trend", "symbol_id")


@registered(query(f"select symbol_id, date, {_r('open high low close')}, volume, {_r('delivery_pct')} from daily", ["daily"]))
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market(spark, sf_dir).daily)


@registered(query(f"select symbol_id, monday, week_end_date, week_start_date, {_r('open high low close')}, volume, trading_days from weekly", ["weekly"]))
def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.weekly_bars(market(spark, sf_dir).daily))


@registered(query(f"select symbol_id, week_end_date, {_r('atr upper_band lower_band st_value')}, direction, weeks_in_trend, is_flip, {_r('close')} from series", ["series"]))
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trend(market(spark, sf_dir)))


@registered(query(f"select symbol_id, week_end_date, {_r('st_value')}, direction, is_new_flip, weeks_in_trend, flip_date, {_r('flip_price')} from runs", ["runs"]))
def trend_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.trend_runs(_trend(market(spark, sf_dir))))


@registered(
    query(
        f"""select symbol_id, week_end_date, weeks_in_trend, {_r('st_value close')} from (select * from series qualify row_number() over (partition by symbol_id order by week_end_date desc) = 1)
        where direction = 1 and week_end_date >= (select max(week_end_date) from series) - 14""",
        ["series"],
    )
)
def latest_bullish(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = trend.last_state(_trend(market(spark, sf_dir)), 7, 3.0)
    newest = last.agg(F.max("week_end_date").alias("newest"))
    return rounded(last.join(F.broadcast(newest)).where((F.col("direction") == 1) & (F.col("week_end_date") >= F.date_sub("newest", 14))).select("symbol_id", "week_end_date", "weeks_in_trend", "st_value", "close"))


_DAILY = "price sma50 sma100 sma150 sma200 high_52w low_52w ret_1m ret_3m ret_6m ret_9m ret_12m avg_vol_20d avg_turnover_20d_cr atr_pct delivery_pct_20d delivery_pct_latest sma200_prev atr_pct_prev"


@registered(query(f"select symbol_id, date, cast(ix as integer) as ix, {_r(_DAILY)}, history_days from daily_ind", ["daily_ind"]))
def daily_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir)
    return rounded(indicators.daily_indicators(m.daily, m.benchmark.select("date").distinct())).select("symbol_id", "date", "ix", *_DAILY.split(), "history_days")


_WEEKLY = "week_close ret_1w ret_13w week_volume vol_ratio tightness_ratio rs_vs_benchmark"


@registered(query(f"select symbol_id, monday, cast(ix as integer) as ix, {_r(_WEEKLY)} from weekly_ind", ["weekly_ind"]))
def weekly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir)
    return rounded(indicators.weekly_indicators(bars.weekly_bars(m.daily), bars.benchmark_weekly(m.benchmark, "ALL")))


_PANEL = "index_value bench_value rs_ratio_raw rs_trend rs_ratio rs_momentum vol_26w ret_1w ret_4w ret_13w ret_26w ret_52w st_breadth breadth_change_4w"


@registered(query(f"select industry, monday, week_end_date, {_r(_PANEL, 5)} from sector_panel", ["sector_panel"]))
def sector_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir)
    grid = indicators.sessions(m.daily)
    dense = indicators.densify(m.daily.select("symbol_id", "date", "close"), grid, "date")
    price = F.last("close", True).over(Window.partitionBy("symbol_id").orderBy("ix").rowsBetween(-5, 0))
    directions = _trend(m).select("symbol_id", monday(F.col("week_end_date")).alias("monday"), "direction")
    return rounded(sectors.sector_weeks(dense.select("symbol_id", "date", "ix", price.alias("price")), m.symbols, m.benchmark.where("index_name = 'ALL'").select("date", "close"), directions), 5)


@registered(
    query(
        f"select industry, week_end_date, stock_count, bullish_count, {_r('pct_above_sma50 pct_above_sma200 pct_near_high rank_ret_13w rank_rs_trend rank_st_breadth rank_risk_adj sector_score', 5)}, rrg_quadrant, cast(sector_rank as integer) as sector_rank, tradeable from sectors",
        ["sectors"],
    )
)
def scan_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.scan(market(spark, sf_dir), scan_config()).sectors
    return rounded(
        out.select("industry", "week_end_date", "stock_count", "bullish_count", "pct_above_sma50", "pct_above_sma200", "pct_near_high", "rank_ret_13w", "rank_rs_trend", "rank_st_breadth", "rank_risk_adj", "sector_score", "rrg_quadrant", "sector_rank", "tradeable"), 5
    )


@registered(query(f"select week_end_date, {_r('market_breadth_pct pct_above_sma200 bench_close bench_sma200')}, above_200dma, sma200_rising, regime from regimes", ["regimes"]))
def scan_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.scan(market(spark, sf_dir), scan_config()).regime
    return rounded(out.select("week_end_date", "market_breadth_pct", "pct_above_sma200", "bench_close", "bench_sma200", "above_200dma", "sma200_rising", "regime"))


_STOCK_R = "price st_value pct_from_high pct_above_low pct_since_flip pct_from_st confirm_vol_ratio rs_raw rs_rating rs_vs_sector score_rs score_sector score_near_high score_volume score_tightness"
_STOCK = "symbol_id week_end_date direction weeks_in_trend qualified f_trend f_sector f_trend_template f_52w_range f_rs f_liquidity f_price f_not_asm sig_fresh_flip sig_tight_stop sig_vol_confirm sig_vcp sig_accumulation sig_near_high sig_sector_leader pen_overextended pen_high_atr pen_late_stage regime"


@registered(query(f"select {', '.join(_STOCK.split())}, {_r(_STOCK_R, 5)}, round_even(stock_score * 100, 0) / 100 as stock_score from scored", ["scored"], turnover=TURNOVER))
def scan_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.scan(market(spark, sf_dir), scan_config()).stocks
    return rounded(out.select(*_STOCK.split(), *_STOCK_R.split(), "stock_score"), 5)

