"""A market derived from the star schema, and frames of price data.

Symbol = brand, industry = brand number modulo 5, session = weekday of
shipment.  A symbol's daily return is the mean discount less 5 %; closes are
its running exponential, opens the close before, highs and lows are widened by
the largest tax.  Discounts are summed as whole hundredths, so sums do not
depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.sources.lineage import written

BENCHMARKS = ("ALL", "ALL50")


@dataclass(frozen=True)
class Market:
    """Inputs of the scan."""

    symbols: DataFrame  # symbol_id, symbol, name, industry, shares_outstanding
    daily: DataFrame  # symbol_id, date, open, high, low, close, volume, delivery_pct
    benchmark: DataFrame  # index_name, date, close


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday rows of ``lineitem`` with their symbol."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), F.round(F.col("l_discount") * 100).cast("long").alias("hundredths"), "l_tax", "l_quantity", "l_returnflag"
    )
    brands = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("symbol_id"))
    return lines.where(F.weekday("date") < 5).join(brands, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def supplier_ticks(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """The same rows with the supplier as their symbol, all suppliers or those up to a number: a market that grows with the tables."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("symbol_id"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_discount") * 100).cast("long").alias("hundredths"), "l_tax", "l_quantity", "l_returnflag"
    )
    return lines.where((F.weekday("date") < 5) & (F.lit(True) if most is None else F.col("symbol_id") <= most))


def daily_returns(trades: DataFrame) -> DataFrame:
    """``symbol_id, date, ret, spread, volume, delivery_pct`` of each symbol and session."""
    n = F.count("*")
    kept = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0))
    return trades.groupBy("symbol_id", "date").agg(
        ((F.sum("hundredths") - 5 * n) / 100.0 / n).alias("ret"),
        (F.max("l_tax") / 4).alias("spread"),
        F.sum("l_quantity").alias("volume"),
        (F.try_divide(kept, F.sum("l_quantity")) * 100).alias("delivery_pct"),
    )


def walk(returns: DataFrame) -> DataFrame:
    """Daily bars from returns."""
    w = Window.partitionBy("symbol_id").orderBy("date")
    priced = returns.withColumn("close", 100 * F.exp(F.sum("ret").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    opened = priced.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return opened.select(
        "symbol_id",
        "date",
        "open",
        (F.greatest("open", "close") * (1 + F.col("spread"))).alias("high"),
        (F.least("open", "close") * (1 - F.col("spread"))).alias("low"),
        "close",
        F.col("volume").cast("long").alias("volume"),
        "delivery_pct",
    )


def benchmark(returns: DataFrame) -> DataFrame:
    """Closes of the equal-weight index; one row for each session, so its window is bounded by the calendar."""
    each = returns.groupBy("date").agg(F.avg("ret").alias("ret")).withColumn("index_name", F.explode(F.array(*map(F.lit, BENCHMARKS))))
    w = Window.partitionBy("index_name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("index_name", "date", (100 * F.exp(F.sum("ret").over(w))).alias("close"))


def market(spark: SparkSession, sf_dir: str) -> Market:
    # bars, benchmark and symbols are each read by several parts of a plan; lines and parts are gone through once for them
    returns = written(daily_returns(ticks(spark, sf_dir)))
    symbols = written(
        table(spark, sf_dir, "part")
        .select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("symbol_id"), F.col("p_brand").alias("symbol"))
        .distinct()
        .select(
            "symbol_id",
            "symbol",
            F.concat(F.lit("Company "), F.col("symbol_id").cast("string")).alias("name"),
            F.concat(F.lit("Sector "), (F.col("symbol_id") % 5).cast("string")).alias("industry"),
            (F.col("symbol_id") * 100_000).cast("long").alias("shares_outstanding"),
        )
    )
    return Market(symbols, walk(returns), benchmark(returns))
