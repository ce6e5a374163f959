"""Weekly bars and what changed between two sets of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import monday


def weekly_bars(daily: DataFrame, cutoff: dt.date | None = None) -> DataFrame:
    """Open, high, low, close and volume of each symbol and week; weeks whose Friday is after ``cutoff`` are unfinished and go."""
    bars = (
        daily.withColumn("monday", monday(F.col("date")))
        .groupBy("symbol_id", "monday")
        .agg(
            F.max("date").alias("week_end_date"),
            F.min("date").alias("week_start_date"),
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("volume"),
            F.count("*").alias("trading_days"),
        )
    )
    return bars if cutoff is None else bars.where(F.date_add("monday", 4) <= F.lit(cutoff))


def benchmark_weekly(benchmark: DataFrame, name: str) -> DataFrame:
    """Last close of each week: ``monday, bench``."""
    return benchmark.where((F.col("index_name") == name) & F.col("close").isNotNull()).groupBy(monday(F.col("date")).alias("monday")).agg(F.max_by("close", "date").alias("bench"))


def same(a: Column, b: Column) -> Column:
    """Equal but for rounding, or both NULL."""
    near = F.abs(a - b) <= 1e-8 + 1e-9 * F.abs(b)
    return F.when(a.isNull() | b.isNull(), a.eqNullSafe(b)).otherwise(near)


def first_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """``symbol_id, first_changed``: the first week that is new, gone or different."""
    columns = ["week_end_date", "open", "high", "low", "close", "volume"]
    a = new.select("symbol_id", "monday", *(F.col(c).alias(f"n_{c}") for c in columns))
    b = old.withColumn("monday", monday(F.col("week_end_date"))).select("symbol_id", "monday", *(F.col(c).alias(f"o_{c}") for c in columns))
    both = a.join(b, ["symbol_id", "monday"], "full_outer")
    equal = F.col("n_week_end_date").eqNullSafe(F.col("o_week_end_date")) & F.coalesce("n_volume", F.lit(-1)).eqNullSafe(F.coalesce("o_volume", F.lit(-1)))
    for c in ("open", "high", "low", "close"):
        equal &= same(F.col(f"n_{c}"), F.col(f"o_{c}"))
    changed = F.col("n_week_end_date").isNull() | F.col("o_week_end_date").isNull() | ~equal
    return both.where(changed).groupBy("symbol_id").agg(F.min(F.coalesce("n_week_end_date", "o_week_end_date")).alias("first_changed"))
