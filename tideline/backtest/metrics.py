"""Figures of equity curves and trade lists, for many runs at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKS = 52
YEAR_DAYS = 365.25
#: Range of the yearly money-weighted return, and halvings of it: as many as a double has digits for.
XIRR_LOW, XIRR_HIGH, HALVINGS = -0.99, 10.0, 64


def xirr(dates: Sequence, amounts: np.ndarray) -> float | None:
    """Yearly money-weighted return in per cent by bisection on (-99 %, 1000 %); None without a change of sign."""
    days = np.array([(pd.Timestamp(d) - pd.Timestamp(dates[0])).days for d in dates]) / YEAR_DAYS
    value = lambda rate: float(np.sum(amounts / (1 + rate) ** days))
    low, high = XIRR_LOW, XIRR_HIGH
    at_low = value(low)
    if at_low * value(high) > 0:
        return None
    for _ in range(200):
        middle = (low + high) / 2
        if at_low * value(middle) <= 0:
            high = middle
        else:
            low = middle
            at_low = value(low)
    return (low + high) / 2 * 100


def time_weighted(equity: DataFrame, start: float, key: str = "run_id") -> DataFrame:
    """``nav``: the curve (key, date, equity, flow) without its flows; each step is taken on the value before plus the new money."""
    w = Window.partitionBy(key).orderBy("date")
    step = F.coalesce(F.try_divide("equity", F.lag("equity").over(w) + F.col("flow")), F.lit(1.0))
    return equity.withColumn("_step", step).withColumn("nav", start * F.product("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def curves(equity: DataFrame, key: str = "run_id", value: str = "nav") -> DataFrame:
    """Return, yearly return, worst fall, Sharpe ratio and volatility of every run of ``equity`` (key, date, value); weekly steps."""
    w = Window.partitionBy(key).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = equity.withColumns({"_step": F.col(value) / F.lag(value).over(w) - 1, "_fall": F.col(value) / F.max(value).over(so_far) - 1})
    g = steps.groupBy(key).agg(
        F.min_by(value, "date").alias("_first"),
        F.max_by(value, "date").alias("_last"),
        (F.datediff(F.max("date"), F.min("date")) / YEAR_DAYS).alias("years"),
        F.avg("_step").alias("_mean"),
        F.stddev_pop("_step").alias("_std"),
        (F.min("_fall") * 100).alias("max_drawdown_pct"),
    )
    total = F.col("_last") / F.col("_first")
    return g.select(
        key,
        ((total - 1) * 100).alias("total_return_pct"),
        ((F.pow(total, 1 / F.greatest("years", F.lit(1e-9))) - 1) * 100).alias("cagr_pct"),
        "max_drawdown_pct",
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * math.sqrt(WEEKS)).alias("sharpe"),
        (F.col("_std") * math.sqrt(WEEKS) * 100).alias("volatility_pct"),
        F.greatest("years", F.lit(1e-9)).alias("years"),
    ).withColumn("mar", F.when(F.col("max_drawdown_pct") < 0, F.col("cagr_pct") / -F.col("max_drawdown_pct")))


def yearly(equity: DataFrame, key: str = "run_id", value: str = "nav") -> DataFrame:
    """``key, year, return_pct``."""
    by_year = equity.groupBy(key, F.year("date").alias("year")).agg(F.max_by(value, "date").alias("_last"), F.min_by(value, "date").alias("_first"))
    w = Window.partitionBy(key).orderBy("year")
    return by_year.select(key, "year", ((F.col("_last") / F.coalesce(F.lag("_last").over(w), F.col("_first")) - 1) * 100).alias("return_pct"))


def trade_stats(trades: DataFrame, key: str = "run_id") -> DataFrame:
    """Win rate, averages, profit factor and expectancy of every run's trades."""
    won = F.col("pnl") > 0
    loss = F.sum(F.when(~won, F.col("pnl")))
    return trades.groupBy(key).agg(
        F.count("*").alias("trades"),
        (F.avg(won.cast("double")) * 100).alias("win_rate_pct"),
        F.coalesce(F.avg(F.when(won, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~won, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_loss_pct"),
        F.when(loss < 0, F.sum(F.when(won, F.col("pnl")).otherwise(0.0)) / -loss).alias("profit_factor"),
        F.avg("pnl_pct").alias("expectancy_pct"),
        F.avg("pnl").alias("expectancy_inr"),
        F.avg("weeks_held").alias("avg_weeks_held"),
    )


def exit_reasons(trades: DataFrame, key: str = "run_id") -> DataFrame:
    """Trades, mean profit and mean return of each exit reason."""
    return trades.groupBy(key, "exit_reason").agg(F.count("*").alias("trades"), F.avg("pnl").alias("avg_pnl"), F.avg("pnl_pct").alias("avg_pnl_pct"))


def xirr_by_run(flows: DataFrame, key: str = "run_id") -> DataFrame:
    """``key, xirr_pct`` of dated amounts (key, date, amount; negative is paid in), NULL where no return in the range fits.

    A run's flows are summed by day, and the bisection is a fold over a fixed
    number of halvings, each a sum over the run's days; the value at the lower
    end is carried along, so a halving is worked out once.
    """
    days = flows.groupBy(key, "date").agg(F.sum(F.col("amount").cast("double")).alias("amount"))
    lists = days.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("date", "amount"))).alias("f"))
    timed = lists.select(key, F.transform("f", lambda x: F.struct((F.datediff(x["date"], F.col("f")[0]["date"]) / YEAR_DAYS).alias("t"), x["amount"].alias("a"))).alias("f"))
    value = lambda rate: F.aggregate("f", F.lit(0.0), lambda total, x: total + x["a"] / F.pow(1 + rate, x["t"]))
    low, high = F.lit(XIRR_LOW), F.lit(XIRR_HIGH)

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        one = F.transform(F.array(F.struct(middle.alias("r"), value(middle).alias("v"))), lambda m: F.when(
            s["v"] * m["v"] <= 0, F.struct(s["low"].alias("low"), m["r"].alias("high"), s["v"].alias("v"))
        ).otherwise(F.struct(m["r"].alias("low"), s["high"].alias("high"), m["v"].alias("v"))))
        return one[0]

    ends = timed.select(key, "f", value(low).alias("_low"), value(high).alias("_high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(low.alias("low"), high.alias("high"), F.col("_low").alias("v")), halve)
    return ends.withColumn("_s", F.when(F.col("_low") * F.col("_high") <= 0, found)).select(key, ((F.col("_s.low") + F.col("_s.high")) / 2 * 100).alias("xirr_pct"))
