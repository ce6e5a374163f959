"""Indicators of each symbol on the dense grid of sessions or weeks.

All windows count rows of the grid, so it is made dense first; every window of
a symbol shares one partitioning and order.  All look backwards, which makes a
row exactly what was known on its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Indicators
from tideline.functions.columns import change, folded, mean, monday, ratio, rolling

#: Sessions in each horizon of return.
HORIZONS = {"1m": 21, "3m": 63, "6m": 126, "9m": 189, "12m": 252}


def sessions(daily: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """``date, ix`` of every session: those of the calendar and all observed. One row a day, so its window is bounded."""
    dates = daily.select("date").distinct()
    if calendar is not None:
        dates = dates.unionByName(calendar.select("date")).distinct()
    return dates.withColumn("ix", F.row_number().over(Window.orderBy("date")))


def densify(rows: DataFrame, grid: DataFrame, on: str) -> DataFrame:
    """A row for every symbol and every entry of the grid, NULL where nothing was observed.

    The grid is a calendar (some 250 rows a year), which is sent to every task.
    """
    every = rows.select("symbol_id").distinct().join(F.broadcast(grid), how="cross")
    return every.join(rows, ["symbol_id", on], "left")


def ewm(rows: DataFrame, key: str, order: str, value: str, out: str, alpha: float, least: int = 1) -> DataFrame:
    """``rows`` with the recursive mean ``out`` of ``value``: weight ``alpha`` for the newest, over gaps decayed further.

    A step is y -> (w y + alpha x) / (w + alpha), where w is 1 - alpha to the
    number of rows since the last value.  A key's rows, as many as it has
    sessions or weeks, are folded in order inside the JVM and come back as
    rows.  ``order`` must tell a key's rows apart.
    """
    x = F.col(value).cast("double")
    item = F.struct(F.col(order).alias("__order"), F.when(~F.isnan(x), x).alias("__value"), *(F.col(c) for c in rows.columns if c not in (key, order, out)))
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_rows"))

    def step(s: Column, v: Column) -> Column:
        w = s["w"] * (1 - alpha)
        mean = F.when(v.isNull(), s["y"]).when(s["y"].isNull(), v).otherwise((w * s["y"] + alpha * v) / (w + alpha))
        return F.struct(mean.alias("y"), F.when(v.isNull(), w).otherwise(1.0).alias("w"), (s["n"] + v.isNotNull().cast("int")).alias("n"))

    begin = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0).alias("n"))
    states = folded("_values", begin, step)
    made = lists.withColumn("_values", F.transform("_rows", lambda r: r["__value"])).withColumn("_means", F.transform(states, lambda s: F.when(s["n"] >= max(least, 1), s["y"])))
    back = made.select(key, F.explode(F.arrays_zip("_rows", "_means")).alias("_r"))
    columns = {key: F.col(key), order: F.col("_r._rows.__order")} | {c: F.col(f"_r._rows.{c}") for c in rows.columns if c not in (key, order, out)}
    return back.select(*(columns[c].alias(c) for c in rows.columns if c != out), F.col("_r._means").alias(out))


def true_range(high, low, before):  # noqa: ANN001, ANN201
    """Largest of the bar and its gaps to the close before; NULL where high or low is."""
    spread = high - low
    return F.when(high.isNull() | low.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(spread, F.abs(high - before), F.abs(low - before)))


def wilder_atr(grid: DataFrame, days: int = 14) -> DataFrame:
    """``grid`` (symbol_id, ix, high, low, close) with ``atr``."""
    w = Window.partitionBy("symbol_id").orderBy("ix")
    return ewm(grid.withColumn("tr", true_range(F.col("high"), F.col("low"), F.lag("close").over(w))), "symbol_id", "ix", "tr", "atr", 1 / days, days).drop("tr")


def daily_indicators(daily: DataFrame, calendar: DataFrame | None = None, cfg: Indicators | None = None) -> DataFrame:
    """All daily indicators, one row for each symbol and session."""
    cfg = cfg or Indicators()
    grid = sessions(daily, calendar)
    dense = densify(daily.select("symbol_id", "date", "high", "low", F.col("close").alias("raw"), "volume", "delivery_pct"), grid, "date")
    w = Window.partitionBy("symbol_id").orderBy("ix")
    filled = dense.withColumn("close", F.last("raw", True).over(w.rowsBetween(-cfg.fill_limit, 0))).withColumns({"high": F.coalesce("high", "raw"), "low": F.coalesce("low", "raw")})
    with_atr = wilder_atr(filled, cfg.atr_days)
    c = F.col("close")
    first = {
        "price": c,
        **{f"sma{n}": mean(c, w, n) for n in (50, 100, 150, 200)},
        "high_52w": rolling(F.max("high"), F.col("high"), w, 252, 20),
        "low_52w": rolling(F.min("low"), F.col("low"), w, 252, 20),
        **{f"ret_{k}": change(c, w, n) for k, n in HORIZONS.items()},
        "avg_vol_20d": mean(F.col("volume").cast("double"), w, 20, 10),
        "avg_turnover_20d_cr": mean(F.col("raw") * F.col("volume"), w, 20, 10) / 1e7,
        "atr_pct": ratio(F.col("atr"), c) * 100,
        "delivery_pct_20d": mean(F.col("delivery_pct"), w, 20, 5),
        "delivery_pct_latest": mean(F.col("delivery_pct"), w, cfg.delivery_short_days, 3),
        "history_days": F.count("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }
    made = with_atr.select("symbol_id", "date", "ix", *(v.alias(k) for k, v in first.items()))
    back = cfg.rising_days
    return made.withColumns({"sma200_prev": F.lag("sma200", back).over(w), "atr_pct_prev": F.lag("atr_pct", back).over(w)})


def weekly_indicators(weekly: DataFrame, bench_weekly: DataFrame, rs_weeks: int = 10) -> DataFrame:
    """All weekly indicators, one row for each symbol and Monday."""
    weeks = weekly.select("monday").unionByName(bench_weekly.select("monday")).distinct()
    grid = weeks.withColumn("ix", F.row_number().over(Window.orderBy("monday")))
    known = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.join(bench_weekly, "monday", "left").withColumn("bench", F.last("bench", True).over(known))
    dense = densify(weekly.select("symbol_id", "monday", "high", "low", "close", F.col("volume").cast("double").alias("volume")), grid, "monday")
    w = Window.partitionBy("symbol_id").orderBy("ix")
    ranged = dense.withColumns({"range": ratio(F.col("high") - F.col("low"), F.col("close")), "strength": ratio(F.col("close"), F.col("bench"))})
    c = F.col("close")
    return ranged.select(
        "symbol_id",
        "monday",
        "ix",
        c.alias("week_close"),
        change(c, w, 1).alias("ret_1w"),
        change(c, w, 13).alias("ret_13w"),
        F.col("volume").alias("week_volume"),
        ratio(F.col("volume"), mean(F.col("volume"), w, 20, 10, -1)).alias("vol_ratio"),
        ratio(mean(F.col("range"), w, 3), mean(F.col("range"), w, 3, end=-3)).alias("tightness_ratio"),
        ratio(F.col("strength"), mean(F.col("strength"), w, rs_weeks)).alias("rs_vs_benchmark"),
    )


def flip_volume(runs: DataFrame, weekly: DataFrame) -> DataFrame:
    """``runs`` with ``flip_vol_ratio``: the volume ratio of the week the trend last turned."""
    at = weekly.select("symbol_id", F.col("monday").alias("_flip"), F.col("vol_ratio").alias("flip_vol_ratio"))
    return runs.withColumn("_flip", monday(F.col("flip_date"))).join(at, ["symbol_id", "_flip"], "left").drop("_flip")


def plain_averages(daily: DataFrame, sizes: tuple[int, ...] = (50, 100, 150, 200)) -> DataFrame:
    """Moving averages over stored closes as they are, without a grid of sessions."""
    w = Window.partitionBy("symbol_id").orderBy("date")
    return daily.select("symbol_id", "date", "close", *(mean(F.col("close"), w, n).alias(f"sma{n}") for n in sizes))
