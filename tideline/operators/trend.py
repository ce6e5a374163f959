"""The recursive volatility-band trend of weekly bars, whole and from saved state.

In batch the recurrence is a fold in the JVM; :class:`Bands` is the same step
for streams, whose state is kept by the stateful operator.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import folded

@dataclass
class Bands:
    """State of one symbol after a bar; ``atr`` is NaN while it warms up."""

    close: float = math.nan
    atr: float = math.nan
    upper: float = 0.0
    lower: float = 0.0
    direction: int = 0
    weeks: int = 0
    warm_sum: float = 0.0
    warm_bars: int = 0

    def step(self, high: float, low: float, close: float, period: int, multiplier: float) -> bool | None:
        """Take one bar in. None while warming up, else whether the trend turned with it."""
        spread = high - low
        if not math.isnan(self.close):
            spread = max(spread, abs(high - self.close), abs(low - self.close))
        before, was_warm = self.close, not math.isnan(self.atr)
        self.close = close
        if was_warm:
            self.atr = (self.atr * (period - 1) + spread) / period
        else:
            self.warm_sum += spread
            self.warm_bars += 1
            if self.warm_bars < period:
                return None
            self.atr = self.warm_sum / period
        middle, reach = (high + low) / 2, multiplier * self.atr
        # a band only ever tightens, unless the close before had broken through it
        if middle - reach > self.lower or before < self.lower:
            self.lower = middle - reach
        if middle + reach < self.upper or before > self.upper:
            self.upper = middle + reach
        if not was_warm:
            direction = -1
        elif self.direction == -1:
            direction = 1 if close > self.upper else -1
        else:
            direction = -1 if close < self.lower else 1
        turned = self.direction not in (0, direction)
        self.weeks = 1 if turned or self.direction == 0 else self.weeks + 1
        self.direction = direction
        return turned

    @property
    def value(self) -> float:
        return self.lower if self.direction == 1 else self.upper


def run_bands(bars: Iterator[tuple], state: Bands, period: int, multiplier: float) -> list[tuple]:
    """Rows (date, atr, upper, lower, value, direction, weeks, turned, close) of ``(date, high, low, close)`` bars in order."""
    out = []
    for date, high, low, close in bars:
        turned = state.step(high, low, close, period, multiplier)
        if turned is not None:
            out.append((date, state.atr, state.upper, state.lower, state.value, state.direction, state.weeks, turned, close))
    return out


_STATE = "close double, atr double, upper double, lower double, direction int, weeks int, warm_sum double, warm_bars int"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def _step(s: Column, x: Column, period: int, multiplier: float) -> Column:
    """State after a bar (tr, mid, close, ...) that follows state ``s``: :meth:`Bands.step`, number by number."""
    warm = s["atr"].isNotNull()
    total, count = s["warm_sum"] + x["tr"], s["warm_bars"] + 1
    atr = F.when(warm, (s["atr"] * (period - 1) + x["tr"]) / period).when(count >= period, total / period)
    known = F.struct(
        atr.alias("atr"), F.when(warm, s["warm_sum"]).otherwise(total).alias("warm_sum"), F.when(warm, s["warm_bars"]).otherwise(count).alias("warm_bars"), (x["mid"] - multiplier * atr).alias("low"), (x["mid"] + multiplier * atr).alias("high")
    )

    def bands(k: Column) -> Column:
        lower = F.when(k["atr"].isNotNull() & ((k["low"] > s["lower"]) | (s["close"] < s["lower"])), k["low"]).otherwise(s["lower"])
        upper = F.when(k["atr"].isNotNull() & ((k["high"] < s["upper"]) | (s["close"] > s["upper"])), k["high"]).otherwise(s["upper"])
        return _let(F.struct(lower.alias("lower"), upper.alias("upper")), lambda b: turn(k, b))

    def turn(k: Column, b: Column) -> Column:
        d = F.when(k["atr"].isNull(), s["direction"]).when(~warm, -1).when(s["direction"] == -1, F.when(x["close"] > b["upper"], 1).otherwise(-1)).otherwise(F.when(x["close"] < b["lower"], -1).otherwise(1))
        return _let(F.struct(d.cast("int").alias("d"), k.alias("k"), b.alias("b")), done)

    def done(t: Column) -> Column:
        turned = (s["direction"] != 0) & (s["direction"] != t["d"])
        weeks = F.when(t["k"]["atr"].isNull(), s["weeks"]).when((s["direction"] == 0) | turned, 1).otherwise(s["weeks"] + 1)
        return F.struct(
            x["close"].alias("close"), t["k"]["atr"].alias("atr"), t["b"]["upper"].alias("upper"), t["b"]["lower"].alias("lower"), t["d"].alias("direction"), weeks.alias("weeks"), t["k"]["warm_sum"].alias("warm_sum"), t["k"]["warm_bars"].alias("warm_bars"), turned.alias("turned"),
        )

    return _let(known, bands)


def fold(weekly: DataFrame, start: DataFrame | None = None, period: int = 7, multiplier: float = 3.0) -> DataFrame:
    """``symbol_id, rows, state``: trend rows of each symbol in order, and the state after its last bar.

    The recurrence is a fold over a symbol's bars inside the JVM, in blocks:
    the state goes from block to block, and a block's rows are appended
    together.  ``start`` (symbol_id, s) has states to begin with.  A bar's
    true range needs only the close before, so it is a window function.
    """
    w = Window.partitionBy("symbol_id").orderBy("week_end_date")
    high, low, close = (F.col(c).cast("double") for c in ("high", "low", "close"))
    bars = weekly.select("symbol_id", "week_end_date", high.alias("high"), low.alias("low"), close.alias("close"))
    before = F.lag("close").over(w)
    if start is not None:
        bars = bars.join(start.select("symbol_id", "s"), "symbol_id", "left")
        before = F.coalesce(before, F.col("s.close"))
    spread = F.col("high") - F.col("low")
    first = F.lit(None).cast(f"struct<{_colons(_STATE)}>") if start is None else F.col("s")
    timed = bars.withColumn("_before", before).select(
        "symbol_id", first.alias("s"),
        F.struct("week_end_date", F.when(F.col("_before").isNull(), spread).otherwise(F.greatest(spread, F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))).alias("tr"), ((F.col("high") + F.col("low")) / 2).alias("mid"), "close").alias("x"),
    )
    one = timed.groupBy("symbol_id").agg(F.sort_array(F.collect_list("x")).alias("bars"), F.first("s").alias("s"))
    none = {"close": F.lit(None).cast("double"), "atr": F.lit(None).cast("double"), "upper": F.lit(0.0), "lower": F.lit(0.0), "direction": F.lit(0), "weeks": F.lit(0), "warm_sum": F.lit(0.0), "warm_bars": F.lit(0)}
    begin = F.struct(*(F.coalesce(F.col(f"s.{c}"), v).alias(c) for c, v in none.items()), F.lit(False).alias("turned"))
    # the fold's value is the list of states alone: whatever passes through a lambda of transform is copied
    states = folded("bars", begin, lambda s, x: _step(s, x, period, multiplier))
    done = one.select("symbol_id", "bars", begin.alias("begin"), states.alias("states"))

    def row(x: Column, n: Column) -> Column:
        value = F.when(n["direction"] == 1, n["lower"]).otherwise(n["upper"])
        return F.struct(
            x["week_end_date"].alias("week_end_date"), n["atr"].alias("atr"), n["upper"].alias("upper_band"), n["lower"].alias("lower_band"), value.alias("st_value"), n["direction"].alias("direction"), n["weeks"].alias("weeks_in_trend"), n["turned"].alias("is_flip"), x["close"].alias("close"),
        )

    rows = F.filter(F.zip_with("bars", "states", row), lambda r: r["atr"].isNotNull())
    last = F.coalesce(F.try_element_at("states", F.lit(-1)), F.col("begin"))
    return done.select("symbol_id", rows.alias("rows"), F.struct(*(last[c].alias(c) for c in none)).alias("state"))


def _colons(ddl: str) -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in ddl.split(", "))


def trend(weekly: DataFrame, period: int = 7, multiplier: float = 3.0) -> DataFrame:
    """Trend rows of every symbol from scratch; warm-up weeks have none."""
    return fold(weekly, None, period, multiplier).select("symbol_id", F.inline("rows"))


def usable_state(state: DataFrame) -> DataFrame:
    """``symbol_id, s``: what :func:`fold` starts from, of saved states (close, atr, upper_band, lower_band, direction, weeks_in_trend); those without ATR are none."""
    held = F.struct("close", "atr", F.col("upper_band").alias("upper"), F.col("lower_band").alias("lower"), "direction", F.col("weeks_in_trend").alias("weeks"), F.lit(0.0).alias("warm_sum"), F.lit(0).alias("warm_bars"))
    return state.where("atr is not null").select("symbol_id", held.cast(f"struct<{_colons(_STATE)}>").alias("s"))


def trend_from_state(weekly: DataFrame, state: DataFrame, period: int = 7, multiplier: float = 3.0) -> DataFrame:
    """Trend rows after each symbol's saved state; symbols without a usable state start from scratch.

    ``weekly`` holds the weeks after the state for the former, all weeks for the latter.
    """
    return fold(weekly, usable_state(state), period, multiplier).select("symbol_id", F.inline("rows"))


def last_state(series: DataFrame, period: int, multiplier: float, prior: DataFrame | None = None) -> DataFrame:
    """One row of state for each symbol: its last trend row, and the last flip, carried from ``prior`` where there is no new one."""
    columns = ["week_end_date", "close", "atr", "upper_band", "lower_band", "st_value", "direction", "weeks_in_trend"]
    last = series.groupBy("symbol_id").agg(
        F.max_by(F.struct(*columns), "week_end_date").alias("s"),
        F.max(F.when(F.col("is_flip"), F.struct(F.col("week_end_date").alias("d"), F.col("close").alias("p")))).alias("f"),
    )
    out = last.select("symbol_id", "s.*", F.col("f.d").alias("flip_date"), F.col("f.p").alias("flip_price"))
    if prior is not None:
        old = prior.select("symbol_id", F.col("flip_date").alias("_d"), F.col("flip_price").alias("_p"))
        out = out.join(old, "symbol_id", "left").select(
            *[c for c in out.columns if not c.startswith("flip")],
            F.coalesce("flip_date", "_d").alias("flip_date"),
            F.when(F.col("flip_date").isNotNull(), F.col("flip_price")).otherwise(F.col("_p")).alias("flip_price"),
        )
    return out.withColumns({"atr_period": F.lit(period), "multiplier": F.lit(float(multiplier))})


def plan_trend(latest: DataFrame, state: DataFrame, changed: DataFrame, period: int, multiplier: float, full: bool = False) -> DataFrame:
    """``symbol_id, plan``: ``full`` where there is no fitting state or a week at or before it changed, ``incremental`` where weeks follow it, else ``none``."""
    joined = latest.join(state.select("symbol_id", F.col("week_end_date").alias("_at"), "atr_period", "multiplier", "atr"), "symbol_id", "left").join(changed, "symbol_id", "left")
    fits = F.col("atr").isNotNull() & (F.col("atr_period") == period) & (F.abs(F.col("multiplier") - multiplier) < 1e-6)
    rewritten = F.coalesce(F.col("first_changed") <= F.col("_at"), F.lit(False))
    plan = F.when(F.lit(full) | ~F.coalesce(fits, F.lit(False)) | rewritten, "full").when(F.col("latest_week") > F.col("_at"), "incremental").otherwise("none")
    return joined.select("symbol_id", plan.alias("plan"))


def trend_runs(series: DataFrame) -> DataFrame:
    """For every stored week: whether the trend turned, its position in the run, and the last flip's date and price.

    Counts start at the first stored row, so they are the state's own only where the series is stored in full.
    """
    w = Window.partitionBy("symbol_id").orderBy("week_end_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("direction").over(w)
    flagged = series.select("symbol_id", "week_end_date", "st_value", "direction", "close", F.coalesce(F.col("direction") != before, F.lit(False)).alias("is_new_flip"))
    numbered = flagged.withColumns(
        {
            "run": F.sum(F.col("is_new_flip").cast("int")).over(so_far),
            "flip": F.last(F.when(F.col("is_new_flip"), F.struct(F.col("week_end_date").alias("d"), F.col("close").alias("p"))), True).over(so_far),
        }
    )
    position = F.row_number().over(Window.partitionBy("symbol_id", "run").orderBy("week_end_date"))
    return numbered.select("symbol_id", "week_end_date", "st_value", "direction", "is_new_flip", position.alias("weeks_in_trend"), F.col("flip.d").alias("flip_date"), F.col("flip.p").alias("flip_price"))


def summary(state: DataFrame, stale_before) -> DataFrame:  # noqa: ANN001
    """Counts by direction, of new flips and of stale symbols."""
    new = F.col("weeks_in_trend") == 1
    return state.agg(
        F.count_if(F.col("direction") == 1).alias("bullish"),
        F.count_if(F.col("direction") == -1).alias("bearish"),
        F.count_if((F.col("direction") == 1) & new).alias("new_bullish"),
        F.count_if((F.col("direction") == -1) & new).alias("new_bearish"),
        F.count_if(F.col("week_end_date") < F.lit(stale_before)).alias("stale"),
    )


def as_tuple(state: Bands) -> tuple:
    return astuple(state)
