"""Data quality of daily bars: cleaning, calendar, gaps, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.intervals import within

PRICES = ["open", "high", "low", "close"]
ISSUES = "symbol string, date date, issue string, details string"


def validate(daily: DataFrame, order: str, tolerance: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Clean rows and issues of ``symbol, date, open, high, low, close, volume``; the last row by ``order`` of a key counts.

    Rows without positive prices go, as do phantoms (no volume, all prices
    equal), which are reported once a date.  Highs and lows are widened to
    cover open and close, reported beyond ``tolerance``.  A negative volume
    becomes NULL.
    """
    w = Window.partitionBy("symbol", "date").orderBy(F.desc(order))
    rows = daily.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    bad = F.lit(False)
    for c in PRICES:
        bad |= F.coalesce(F.col(c) <= 0, F.lit(True))
    flat = F.coalesce((F.col("volume") == 0) & (F.col("open") == F.col("close")) & (F.col("high") == F.col("close")) & (F.col("low") == F.col("close")), F.lit(False))
    high, low = F.greatest(*PRICES), F.least(*PRICES)
    state = F.when(bad, "bad_price").when(flat, "phantom_candle").otherwise("ok")
    marked = rows.withColumns({"_state": state, "_high": high, "_low": low})
    kept = marked.where("_state = 'ok'")
    prices = F.to_json(F.struct(*PRICES))
    issues = (
        marked.where("_state = 'bad_price'").select("symbol", "date", F.lit("bad_price").alias("issue"), prices.alias("details"))
        .unionByName(
            marked.where("_state = 'phantom_candle'").groupBy("date").agg(F.to_json(F.struct(F.count("*").alias("count"), F.min("symbol").alias("example"))).alias("details"))
            .select(F.lit(None).cast("string").alias("symbol"), "date", F.lit("phantom_candle").alias("issue"), "details")
        )
        .unionByName(
            kept.where((F.col("_high") > F.col("high") * (1 + tolerance)) | (F.col("_low") < F.col("low") * (1 - tolerance)))
            .select("symbol", "date", F.lit("ohlc_inconsistent").alias("issue"), prices.alias("details"))
        )
        .unionByName(kept.where("volume < 0").select("symbol", "date", F.lit("negative_volume").alias("issue"), F.to_json(F.struct("volume")).alias("details")))
    )
    clean = kept.withColumns({"high": F.col("_high"), "low": F.col("_low"), "volume": F.when(F.col("volume") >= 0, F.col("volume"))})
    return clean.select(*daily.columns), issues


def trading_calendar(daily: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """Dates on which at least the fraction of all symbols traded."""
    every = daily.agg(F.countDistinct("symbol").alias("_all"))
    by_day = daily.groupBy("date").agg(F.countDistinct("symbol").alias("_n"))
    return by_day.join(F.broadcast(every)).where(F.col("_n") >= F.col("_all") * min_fraction).select("date")


def missing_sessions(daily: DataFrame, calendar: DataFrame, key: str = "symbol") -> DataFrame:
    """``key, date`` of calendar sessions between a symbol's first and last bar that it has no bar for.

    A symbol's span meets the calendar month by month.
    """
    spans = daily.groupBy(key).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    due = within(spans, calendar.select("date"), "_a", "_b").select(key, "date")
    return due.join(daily.select(key, "date"), [key, "date"], "left_anti")


def gap_issues(daily: DataFrame, calendar: DataFrame, most_listed: int = 20) -> DataFrame:
    """One row for each symbol with missing sessions: count, first and the first dates."""
    missing = missing_sessions(daily, calendar)
    w = Window.partitionBy("symbol").orderBy("date")
    listed = missing.withColumn("_n", F.row_number().over(w))
    return listed.groupBy("symbol").agg(
        F.min("date").alias("date"), F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= most_listed, F.col("date").cast("string")))), ",").alias("dates")
    )


def week_coverage(daily: DataFrame, symbols: DataFrame, sessions: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Sessions with rows, and whether they reach the share of all symbols: ``date, rows, complete``."""
    every = symbols.agg(F.count("*").alias("_all"))
    counted = sessions.select("date").join(daily.groupBy("date").agg(F.count("*").alias("rows")), "date", "left")
    return counted.join(F.broadcast(every)).select("date", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), (F.coalesce("rows", F.lit(0)) >= F.col("_all") * min_coverage).alias("complete"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue").agg(F.count("*").alias("n"))


def count_listed(log: DataFrame) -> DataFrame:
    """How often each entry occurs in the JSON arrays of ``details``."""
    return log.select(F.explode(F.from_json("details", "array<string>")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
