"""The weekly scan of the whole market, all weeks in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Config
from tideline.functions.columns import monday, ratio, truth
from tideline.operators.intervals import latest_at
from tideline.operators import bars, indicators, regime, scoring, sectors, trend
from tideline.sources.lineage import cut
from tideline.sources.market import Market

Part = Callable[[], DataFrame]


class Scan:
    """Results for every scan week, each made when it is first asked for."""

    def __init__(self, stocks: Part, sectors: Part, regime: Part, history: Part):
        self._parts = {"stocks": stocks, "sectors": sectors, "regime": regime, "history": history}

    @cached_property
    def stocks(self) -> DataFrame:
        return self._parts["stocks"]()

    @cached_property
    def sectors(self) -> DataFrame:
        return self._parts["sectors"]()

    @cached_property
    def regime(self) -> DataFrame:
        return self._parts["regime"]()

    @cached_property
    def history(self) -> DataFrame:
        return self._parts["history"]()


def as_of_snapshot(rows: DataFrame, weeks: DataFrame, date: str, lag_days: int = 0) -> DataFrame:
    """``rows`` of the latest snapshot at or before each week end (plus ``lag_days``), with ``week_end_date``.

    Distinct snapshot dates are few; each becomes the interval up to the next,
    so a week meets one snapshot by a range join and no week sees all of them.
    """
    chosen = latest_at(weeks.withColumn("_at", F.date_add("week_end_date", lag_days)), rows.select(F.col(date).alias("_from")), "_at", "_from")
    return chosen.select("week_end_date", "_from").join(rows, F.col("_from") == F.col(date)).drop("_from")


def derived(cfg: Config) -> dict[str, Column]:
    c = F.col
    fresh = c("weeks_in_trend") <= cfg.signals.fresh_flip_max_weeks
    return {
        "direction": F.when(c("direction") == 1, "Bullish").otherwise("Bearish"),
        "pct_from_high": ratio(c("high_52w") - c("price"), c("high_52w")) * 100,
        "pct_above_low": (ratio(c("price"), c("low_52w")) - 1) * 100,
        "pct_since_flip": (ratio(c("price"), c("flip_price")) - 1) * 100,
        "pct_from_st": ratio(c("price") - c("st_value"), c("price")) * 100,
        "sma200_slope_pct": (ratio(c("sma200"), c("sma200_prev")) - 1) * 100,
        "sma200_rising": c("sma200") > c("sma200_prev"),
        "market_cap_cr": c("price") * c("shares_outstanding") / 1e7,
        "confirm_vol_ratio": F.greatest(c("vol_ratio"), F.when(fresh, c("flip_vol_ratio"))),
    }


def scan_weeks(runs: DataFrame) -> DataFrame:
    """``monday, week_end_date``: the last session of each week with a trend."""
    return runs.groupBy(monday(F.col("week_end_date")).alias("monday")).agg(F.max("week_end_date").alias("week_end_date"))


def runs_as_of(runs: DataFrame, weeks: DataFrame, stale_weeks: int) -> DataFrame:
    """Each symbol's latest trend row at or before each week end, if it is not stale.

    A row holds from its week until the symbol's next one, at most ``stale_weeks`` weeks,
    so it is expanded over that many Mondays instead of joined by range.
    """
    w = Window.partitionBy("symbol_id").orderBy("week_end_date")
    held = runs.withColumns({"st_week": F.col("week_end_date"), "_next": monday(F.lead("week_end_date").over(w))})
    first = monday(F.col("st_week"))
    ahead = held.withColumn("monday", F.explode(F.sequence(first, F.date_add(first, 7 * (stale_weeks + 1)), F.expr("interval 7 days"))))
    ahead = ahead.where(F.col("_next").isNull() | (F.col("monday") < F.col("_next"))).drop("_next", "week_end_date")
    return ahead.join(F.broadcast(weeks), "monday").where(F.col("st_week") >= F.date_sub("week_end_date", 7 * stale_weeks))


def active_only(inputs: Market, symbols: DataFrame) -> Market:
    """Inputs of the symbols that are active by ``symbols`` (symbol_id, is_active); benchmarks stay."""
    active = symbols.where("is_active").select("symbol_id")
    return Market(inputs.symbols.join(active, "symbol_id", "left_semi"), inputs.daily.join(active, "symbol_id", "left_semi"), inputs.benchmark)


def scan(inputs: Market, cfg: Config, *, members: DataFrame | None = None, exclusions: DataFrame | None = None, index_lists: DataFrame | None = None, benchmark: str = "ALL") -> Scan:
    """Stocks, sectors and regime of every week.

    ``members`` (snapshot_date, symbol_id) limits each week to the latest
    snapshot; ``exclusions`` (as_of_date, symbol_id) flags the symbols of the
    latest list up to seven days past the week's end.
    """
    # read by several parts of the plan, so made once and kept where no executor's loss takes them along
    inputs = Market(inputs.symbols, cut(inputs.daily), cut(inputs.benchmark))
    weekly = cut(bars.weekly_bars(inputs.daily))
    bench = inputs.benchmark.where(F.col("index_name") == benchmark).select("date", "close")
    calendar = bench.select("date").distinct()
    daily = cut(indicators.daily_indicators(inputs.daily, calendar, cfg.indicators))
    by_week = indicators.weekly_indicators(weekly, bars.benchmark_weekly(inputs.benchmark, benchmark), cfg.relative_strength.sma_weeks)
    series = cut(trend.trend(weekly, cfg.trend.period, cfg.trend.multiplier))
    runs = trend.trend_runs(series)
    weeks = scan_weeks(runs)

    @cache
    def base() -> DataFrame:
        return cut(_stock_weeks(inputs, cfg, daily, by_week, runs, weeks, members, exclusions, index_lists))

    @cache
    def panels() -> DataFrame:
        directions = series.select("symbol_id", monday(F.col("week_end_date")).alias("monday"), "direction")
        return sectors.sector_weeks(daily.select("symbol_id", "date", "ix", "price"), inputs.symbols, bench, directions, cfg.sectors)

    @cache
    def metrics() -> DataFrame:
        return cut(sectors.sector_metrics(panels().drop("week_end_date"), base(), cfg.sectors, cfg.indicators.near_high_breadth_pct).join(F.broadcast(weeks), "monday"))

    @cache
    def state() -> DataFrame:
        breadth = base().groupBy("monday", "week_end_date").agg(
            (F.avg((F.col("direction") == "Bullish").cast("double")) * 100).alias("market_breadth_pct"),
            (F.avg(F.when(F.col("sma200").isNotNull(), (F.col("price") > F.col("sma200")).cast("double"))) * 100).alias("pct_above_sma200"),
        )
        return regime.market_regime(breadth, regime.benchmark_trend(bench, cfg.regime), cfg.regime)

    def scored() -> DataFrame:
        per_sector = metrics().select("monday", "industry", "sector_score", "sector_rank", F.col("tradeable").alias("sector_tradeable"), F.col("ret_13w").alias("_sector_13w"))
        count = metrics().groupBy("monday").agg(F.count("*").alias("n_sectors"))
        full = base().join(per_sector, ["monday", "industry"], "left").join(count, "monday").join(state().select("monday", "regime"), "monday")
        return scoring.score_stocks(full.withColumn("rs_vs_sector", F.col("ret_13w") - F.col("_sector_13w")).drop("_sector_13w"), cfg, ["monday"])

    return Scan(scored, metrics, state, lambda: panels().where("index_value is not null"))


def _stock_weeks(
    inputs: Market, cfg: Config, daily: DataFrame, by_week: DataFrame, runs: DataFrame, weeks: DataFrame, members: DataFrame | None, exclusions: DataFrame | None, index_lists: DataFrame | None
) -> DataFrame:
    """A row for each stock and scan week, with all that is known before sectors are ranked."""
    held = indicators.flip_volume(runs_as_of(runs, weeks, cfg.indicators.stale_weeks), by_week)
    stocks = (
        inputs.symbols.join(held, "symbol_id")
        .join(daily.withColumnRenamed("date", "week_end_date").drop("ix"), ["symbol_id", "week_end_date"], "left")
        .join(by_week.drop("ix", "week_close"), ["symbol_id", "monday"], "left")
        .where("price is not null")
    )
    if members is not None:
        now = as_of_snapshot(members, weeks, "snapshot_date").select("week_end_date", "symbol_id").distinct()
        stocks = stocks.join(now, ["week_end_date", "symbol_id"], "left_semi")
    stocks = scoring.rs_rating(stocks.withColumns(derived(cfg)), cfg.relative_strength.weights, ["monday"])
    if exclusions is not None:
        listed = as_of_snapshot(exclusions, weeks, "as_of_date", 7).select("week_end_date", "symbol_id", F.lit(True).alias("in_asm_gsm")).distinct()
        stocks = stocks.join(listed, ["week_end_date", "symbol_id"], "left").withColumn("in_asm_gsm", truth(F.col("in_asm_gsm")))
    else:
        stocks = stocks.withColumn("in_asm_gsm", F.lit(False))
    if index_lists is not None:
        stocks = stocks.join(index_lists, "symbol_id", "left")
    else:
        stocks = stocks.withColumn("index_list", F.lit(None).cast("string"))
    return stocks
