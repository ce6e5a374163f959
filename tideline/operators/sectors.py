"""Sector indices, rotation, breadth, score and rank, for all weeks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Sectors
from tideline.functions.columns import change, mean, monday, percent_rank, ratio, rolling, truth
from tideline.operators.indicators import ewm

RETURN_WEEKS = {"ret_1w": 1, "ret_4w": 4, "ret_13w": 13, "ret_26w": 26, "ret_52w": 52}


def quadrant(strength: Column, momentum: Column) -> Column:
    return (
        F.when((strength >= 100) & (momentum >= 100), "Leading")
        .when((strength >= 100) & (momentum < 100), "Weakening")
        .when((strength < 100) & (momentum < 100), "Lagging")
        .when((strength < 100) & (momentum >= 100), "Improving")
    )


def daily_index(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """``industry, date, ix, level``: running product of the mean clipped return of an industry's symbols, from 100.

    ``prices`` is the filled grid (symbol_id, date, ix, price).  A session without any return stays level.
    """
    w = Window.partitionBy("symbol_id").orderBy("ix")
    step = ratio(F.col("price"), F.lag("price").over(w)) - 1
    clip = F.when(step.isNotNull(), F.least(F.greatest(step, F.lit(-0.5)), F.lit(1.0)))
    each = prices.withColumn("r", clip).join(symbols.where("industry is not null").select("symbol_id", "industry"), "symbol_id")
    by_day = each.groupBy("industry", "date", "ix").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("r"))
    so_far = Window.partitionBy("industry").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select("industry", "date", "ix", (F.product(1 + F.col("r")).over(so_far) * 100).alias("level"))


def sector_weeks(prices: DataFrame, symbols: DataFrame, benchmark: DataFrame, directions: DataFrame, cfg: Sectors | None = None) -> DataFrame:
    """Weekly sector panels, one row for each industry and Monday.

    ``benchmark`` is ``date, close``; ``directions`` is ``symbol_id, monday, direction``.
    """
    cfg = cfg or Sectors()
    index = daily_index(prices, symbols)
    days = index.select("date", "ix").distinct().join(benchmark, "date", "left")
    known = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    bench = days.withColumn("close", F.last("close", True).over(known)).groupBy(monday(F.col("date")).alias("monday")).agg(F.max_by("close", "ix").alias("bench"), F.max("date").alias("week_end_date"))
    weekly = index.groupBy("industry", monday(F.col("date")).alias("monday")).agg(F.max_by("level", "ix").alias("index_value")).join(F.broadcast(bench), "monday")
    breadth = (
        directions.join(symbols.where("industry is not null").select("symbol_id", "industry"), "symbol_id")
        .groupBy("industry", "monday")
        .agg((F.avg((F.col("direction") == 1).cast("double")) * 100).alias("st_breadth"))
    )
    w = Window.partitionBy("industry").orderBy("monday")
    n = cfg.rrg_window
    score = lambda x: 100 + ratio(x - mean(x, w, n), rolling(F.stddev_samp(x), x, w, n))
    alpha = 2 / (cfg.rrg_smooth + 1)
    raw = weekly.withColumn("rs_ratio_raw", ratio(F.col("index_value"), F.col("bench"))).withColumn("_x", 100 * F.col("rs_ratio_raw"))
    smooth = ewm(raw, "industry", "monday", "_x", "_rs", alpha).withColumn("rs_ratio", score(F.col("_rs")))
    roc = ewm(smooth.withColumn("_y", 100 * ratio(F.col("rs_ratio"), F.lag("rs_ratio").over(w))), "industry", "monday", "_y", "_roc", alpha)
    step = ratio(F.col("index_value"), F.lag("index_value").over(w)) - 1
    done = roc.withColumn("_step", step).join(breadth, ["industry", "monday"], "left")
    return done.select(
        "industry",
        "monday",
        "week_end_date",
        "index_value",
        F.col("bench").alias("bench_value"),
        "rs_ratio_raw",
        ratio(F.col("rs_ratio_raw"), mean(F.col("rs_ratio_raw"), w, cfg.rs_sma_weeks)).alias("rs_trend"),
        "rs_ratio",
        score(F.col("_roc")).alias("rs_momentum"),
        (rolling(F.stddev_samp("_step"), F.col("_step"), w, 26) * (52**0.5) * 100).alias("vol_26w"),
        *(change(F.col("index_value"), w, k).alias(name) for name, k in RETURN_WEEKS.items()),
        "st_breadth",
        (F.col("st_breadth") - F.lag("st_breadth", cfg.breadth_change_weeks).over(w)).alias("breadth_change_4w"),
    )


def tradeable(cfg: Sectors) -> Column:
    t = cfg.tradeable
    return truth(
        (F.col("sector_rank") <= t.max_rank)
        & (F.col("st_breadth") >= t.min_st_breadth)
        & (F.col("rs_trend") > t.min_rs_trend)
        & F.col("rrg_quadrant").isin(*t.quadrants)
        & (F.col("stock_count") >= t.min_stocks)
    )


def sector_metrics(panels: DataFrame, stocks: DataFrame, cfg: Sectors | None = None, near_high_pct: float = 10.0) -> DataFrame:
    """One row for each industry and scan week; ``stocks`` are the weeks' stock rows (``monday``, ``industry``, prices, averages)."""
    cfg = cfg or Sectors()
    above = lambda sma: (F.avg(F.when(F.col(sma).isNotNull(), (F.col("price") > F.col(sma)).cast("double"))) * 100)
    counted = stocks.where("industry is not null").groupBy("monday", "industry").agg(
        F.count("*").alias("stock_count"),
        F.count_if(F.col("direction") == "Bullish").alias("bullish_count"),
        above("sma50").alias("pct_above_sma50"),
        above("sma200").alias("pct_above_sma200"),
        (F.avg(truth(F.col("pct_from_high") <= near_high_pct).cast("double")) * 100).alias("pct_near_high"),
    )
    joined = counted.join(panels, ["monday", "industry"], "left").withColumns({"risk_adj_return": ratio(F.col("ret_26w"), F.col("vol_26w")), "rrg_quadrant": quadrant(F.col("rs_ratio"), F.col("rs_momentum"))})
    ranked = joined.withColumns({f"rank_{k}": percent_rank(F.col(c), ["monday"]) for k, c in (("ret_13w", "ret_13w"), ("rs_trend", "rs_trend"), ("st_breadth", "st_breadth"), ("risk_adj", "risk_adj_return"))})
    total = sum((F.lit(float(cfg.weights[k])) * F.coalesce(f"rank_{k}", F.lit(0.0)) for k in ("ret_13w", "rs_trend", "st_breadth", "risk_adj")), F.lit(0.0))
    scored = ranked.withColumn("sector_score", total)
    order = Window.partitionBy("monday").orderBy(F.desc(F.round("sector_score", 9)), "industry")
    return scored.withColumn("sector_rank", F.row_number().over(order)).withColumn("tradeable", tradeable(cfg))
