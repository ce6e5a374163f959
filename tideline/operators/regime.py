"""Market regime of every scan week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Regime
from tideline.functions.columns import mean, truth


def benchmark_trend(benchmark: DataFrame, cfg: Regime | None = None) -> DataFrame:
    """Close, long average and that of ``slope_days`` rows before, over the benchmark's own rows (one a session)."""
    cfg = cfg or Regime()
    w = Window.orderBy("date")
    own = benchmark.where("close is not null").select("date", "close")
    return own.withColumn("sma", mean(F.col("close"), w, cfg.sma_days)).withColumn("sma_before", F.lag("sma", cfg.slope_days).over(w))


def market_regime(weeks: DataFrame, trend: DataFrame, cfg: Regime | None = None) -> DataFrame:
    """``weeks`` (week_end_date, market_breadth_pct, pct_above_sma200) with the benchmark as of its end and the regime.

    Unknown comparisons are neither true nor false: bull needs all of price, slope and
    breadth, bear a known price below and a known falling slope or weak breadth.
    """
    cfg = cfg or Regime()
    # as of: benchmark rows (one a session) and weeks in one line, the last row carried forward to each week
    rows = trend.select(F.struct("close", "sma", "sma_before").alias("b"), "date").unionByName(weeks.withColumn("date", F.col("week_end_date")), allowMissingColumns=True)
    latest = rows.withColumn("b", F.last("b", True).over(Window.orderBy("date", F.col("week_end_date").isNotNull()))).where("week_end_date is not null")
    known = latest.select(
        *weeks.columns,
        F.col("b.close").alias("bench_close"),
        F.col("b.sma").alias("bench_sma200"),
        (F.col("b.close") > F.col("b.sma")).alias("above_200dma"),
        (F.col("b.sma") > F.col("b.sma_before")).alias("sma200_rising"),
    )
    broad = F.col("market_breadth_pct") >= cfg.min_breadth
    bull = truth(F.col("above_200dma")) & truth(F.col("sma200_rising")) & truth(broad)
    bear = truth(~F.col("above_200dma")) & (truth(~F.col("sma200_rising")) | ~truth(broad))
    return known.withColumn("regime", F.when(bull, "bull").when(bear, "bear").otherwise("neutral"))
