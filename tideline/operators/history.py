"""Point-in-time universes: entities, adjustment of prices, membership snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.intervals import latest_at, within
from tideline.sources.components import connected_components
from tideline.sources.lineage import cut


def linked_symbols(rows: DataFrame) -> DataFrame:
    """``symbol, root``: symbols that share an ISIN, directly or over others, have one root (the least symbol).

    The graph is of distinct pairs, not of rows; its edges go from a symbol
    to the least one of its ISIN, so no pair of symbols is made, and are
    contracted until none changes, however long a chain is.
    """
    good = F.when(F.length("isin") == 12, F.col("isin"))
    pairs = cut(rows.select("symbol", good.alias("isin")).distinct())
    known = pairs.where("isin is not null and symbol is not null")
    least = known.groupBy("isin").agg(F.min("symbol").alias("b"))
    roots = connected_components(known.join(least, "isin").select(F.col("symbol").alias("a"), "b")).select(F.col("node").alias("symbol"), "component")
    return pairs.select("symbol").distinct().join(roots, "symbol", "left").select("symbol", F.coalesce("component", "symbol").alias("root"))


def entities(rows: DataFrame, max_gap_days: int = 365) -> DataFrame:
    """``rows`` (date, symbol, isin) with ``entity``: linked symbols, cut where they were silent for long."""
    rooted = rows.join(linked_symbols(rows), "symbol")
    w = Window.partitionBy("root").orderBy("date")
    days = rooted.select("root", "date").distinct().withColumn("_new", (F.datediff("date", F.lag("date").over(w)) > max_gap_days).cast("int"))
    cut = days.withColumn("_segment", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_new")
    return rooted.join(cut, ["root", "date"]).withColumn("entity", F.concat_ws("#", "root", F.col("_segment").cast("string"))).drop("root", "_segment")


def one_a_day(rows: DataFrame) -> DataFrame:
    """Of an entity's rows of one day the most traded; a change of symbol can overlap a day."""
    w = Window.partitionBy("entity", "date").orderBy(F.desc_nulls_last("value"), "symbol")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def place_events(events: DataFrame, rows: DataFrame, within_days: int = 30) -> DataFrame:
    """``entity, date, factor``: events (symbol, isin, ex_date, factor) on the entity's first session from the ex-date on.

    By ISIN, else by the latest bar of the ticker up to ten days after; events
    of one ex-date multiply; without a session in time there is none.
    """
    keyed = events.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in events.columns else events
    by_isin = rows.where("isin is not null").groupBy("isin").agg(F.min_by("entity", "date").alias("_e1"))
    spans = rows.groupBy("symbol", "entity").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    seen = keyed.select("_id", "symbol", "ex_date").join(spans, "symbol").where(F.col("_a") <= F.date_add("ex_date", 10))
    by_text = seen.groupBy("_id").agg(F.max_by("entity", F.least("_b", F.date_add("ex_date", 10))).alias("_e2"))
    owned = keyed.join(by_isin, "isin", "left").join(by_text, "_id", "left").withColumn("entity", F.coalesce("_e1", "_e2")).where("entity is not null")
    merged = owned.groupBy("entity", "ex_date").agg(F.product("factor").alias("factor"))
    # events and sessions of an entity in one line, the next session carried back to each event
    line = rows.select("entity", "date").distinct().withColumn("session", F.col("date")).unionByName(merged.withColumnRenamed("ex_date", "date"), allowMissingColumns=True)
    ahead = Window.partitionBy("entity").orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    met = line.withColumn("next", F.first("session", True).over(ahead)).where("factor is not null")
    return met.where(F.col("next") <= F.date_add("date", within_days)).select("entity", F.col("next").alias("date"), "factor")


def adjust(bars: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with prices before each confirmed event multiplied by it and volumes divided; and the events applied.

    An event counts only where the gap to the close before is nearer to it than to none.
    """
    w = Window.partitionBy("entity").orderBy("date")
    gapped = bars.withColumn("gap", F.try_divide("open", F.lag("close").over(w)))
    met = events.join(gapped.select("entity", "date", "gap"), ["entity", "date"])
    applied = met.where(F.abs(F.ln(F.col("gap") / F.col("factor"))) < F.abs(F.ln("gap")))
    total = applied.groupBy("entity", "date").agg(F.product("factor").alias("factor"))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    scaled = gapped.drop("gap").join(total, ["entity", "date"], "left").withColumn("_m", F.coalesce(F.product(F.coalesce("factor", F.lit(1.0))).over(later), F.lit(1.0)))
    changed = scaled.withColumns({c: F.col(c) * F.col("_m") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") / F.col("_m")})
    return changed.drop("_m", "factor"), applied


def rebalances(sessions: DataFrame) -> DataFrame:
    """``snapshot_date, window_start, window_end, sessions``: effective at the ends of March and September, ranked on the half years to January and July."""
    span = sessions.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    years = span.select("first", "last", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("y"))
    both = years.select("first", "last", "y", F.explode(F.array(F.struct(F.lit(3).alias("at"), F.lit(1).alias("to")), F.struct(F.lit(9).alias("at"), F.lit(7).alias("to")))).alias("m"))
    end = lambda month: F.last_day(F.make_date("y", month, F.lit(1)))
    planned = both.select("first", "last", end(F.col("m.at")).alias("effective"), end(F.col("m.to")).alias("window_end")).withColumn("window_start", F.date_add(F.add_months("window_end", -6), 1))
    days = sessions.select("date").distinct()
    held = latest_at(planned, days.select(F.col("date").alias("snapshot_date")), "effective", "snapshot_date")
    counts = within(held.select("window_start", "window_end"), days, "window_start", "window_end").groupBy("window_start", "window_end").agg(F.count("*").alias("sessions"))
    met = held.join(counts, ["window_start", "window_end"], "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    return met.where("snapshot_date is not null and window_start >= first and snapshot_date <= last and snapshot_date > window_end").select("snapshot_date", "window_start", "window_end", "sessions")


def snapshots(rows: DataFrame, top_n: int, min_traded_pct: float = 80.0) -> DataFrame:
    """``snapshot_date, entity``: the entities of the highest traded value, of shares that traded often enough.

    ``rows`` is ``entity, date, value, isin``; ties go to the smaller entity.
    """
    # two rows a year: no bar is dealt by its month
    plan = rebalances(rows.select("date").distinct())
    shares = rows.where(F.col("isin").startswith("INE"))
    inside = within(F.broadcast(plan), shares, "window_start", "window_end")
    g = inside.groupBy("snapshot_date", "sessions", "entity").agg(F.countDistinct("date").alias("days"), F.sum("value").alias("value"))
    eligible = g.where(F.col("days") >= F.col("sessions") * min_traded_pct / 100).withColumn("average", F.col("value") / F.col("sessions"))
    w = Window.partitionBy("snapshot_date").orderBy(F.desc("average"), "entity")
    return eligible.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_n).select("snapshot_date", "entity")


def member_of(rows: DataFrame, members: DataFrame, date: str = "date") -> DataFrame:
    """``rows`` whose symbol is in the latest snapshot at or before their date; before the first snapshot there is none."""
    placed = latest_at(rows, members, date, "snapshot_date")
    return placed.join(members.select("snapshot_date", "symbol_id").distinct(), ["snapshot_date", "symbol_id"], "left_semi")
