"""Jobs composed of the operators: incremental rebuilds, ingest, repairs, backfills, universes, point-in-time builds, runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import monday
from tideline.operators import bars, checks, history, ingest, trend, universe_store
from tideline.sources import files, store
from tideline.sources.lineage import cut, written


@dataclass(frozen=True)
class Rebuild:
    """Weekly bars after an update, and the first week that changed of each symbol."""

    weekly: DataFrame
    changed: DataFrame


def rebuild_weeks(daily: DataFrame, stored: DataFrame, weeks: int = 3, cutoff: dt.date | None = None, full: bool = False) -> Rebuild:
    """Bars of the last ``weeks`` weeks made anew (all when ``full``); only changed symbols' weeks are replaced.

    Later rows of older weeks are not seen here: they need a full rebuild.
    """
    if full:
        fresh, old = bars.weekly_bars(daily, cutoff), stored
    else:
        newest = daily.agg(monday(F.max("date")).alias("_m"))
        since = F.date_sub("_m", 7 * (weeks - 1))
        fresh = bars.weekly_bars(daily.join(F.broadcast(newest)).where(F.col("date") >= since).drop("_m"), cutoff)
        old = stored.join(F.broadcast(newest)).where(monday(F.col("week_end_date")) >= since).drop("_m")
    changed = bars.first_changes(fresh, old)
    touched = fresh.join(changed.select("symbol_id"), "symbol_id", "left_semi")
    kept = stored.join(old.select("symbol_id", "monday").join(changed.select("symbol_id"), "symbol_id", "left_semi"), ["symbol_id", "monday"], "left_anti")
    return Rebuild(kept.unionByName(touched.select(*stored.columns)), changed)


def update_trend(weekly: DataFrame, series: DataFrame, state: DataFrame, changed: DataFrame, period: int = 7, multiplier: float = 3.0, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored series and state brought up to date: from scratch where the plan says so, from state where weeks follow, else left."""
    latest = weekly.groupBy("symbol_id").agg(F.max("week_end_date").alias("latest_week"))
    plan = trend.plan_trend(latest, state, changed, period, multiplier, full)
    whole = weekly.join(plan.where("plan = 'full'"), "symbol_id", "left_semi")
    ends = state.select("symbol_id", F.col("week_end_date").alias("_at"))
    later = weekly.join(plan.where("plan = 'incremental'"), "symbol_id", "left_semi").join(ends, "symbol_id").where(F.col("week_end_date") > F.col("_at")).drop("_at")
    anew = trend.trend(whole, period, multiplier)
    onward = trend.trend_from_state(later, state, period, multiplier)
    stale = plan.where("plan = 'full'").select("symbol_id")
    out = series.join(stale, "symbol_id", "left_anti").unionByName(anew).unionByName(onward)
    fresh = trend.last_state(anew, period, multiplier).unionByName(trend.last_state(onward, period, multiplier, state))
    gone = fresh.select("symbol_id").unionByName(stale).distinct()
    return out, state.join(gone, "symbol_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


@dataclass(frozen=True)
class Ingested:
    """Daily bars after a day's file, corporate actions it shows, and issues."""

    daily: DataFrame
    actions: DataFrame
    issues: DataFrame
    skipped: DataFrame


def ingest_day(feed: DataFrame, daily: DataFrame, symbols: DataFrame, aliases: DataFrame, day: str, previous: str | None, threshold: float = 0.03, base: DataFrame | None = None) -> Ingested:
    """Put one day's rows (symbol, open .. delivery_pct) into the bars: names mapped, rows checked, routed, written by route.

    ``base`` are the bars that come back changed, all by default; a part of
    them that holds the day is enough where only that is written.
    """
    base = daily if base is None else base
    clean, issues = checks.validate(feed.select("symbol", F.lit(day).cast("date").alias("date"), "open", "high", "low", "close", "volume", F.lit(0).alias("_seq")), "_seq")
    rows = clean.drop("_seq").join(feed.select("symbol", "prev_close", "delivery_qty", "delivery_pct"), "symbol").join(ingest.symbol_map(symbols, aliases), "symbol")
    ids = rows.select("symbol_id").distinct()
    planned = cut(ingest.plan_day(rows, ingest.symbol_state(daily, ids, day), previous, threshold))  # a day's rows, used by each route
    columns = daily.columns
    bars_in = planned.where("route in ('append', 'repair')").withColumn("source", F.lit("file")).select(*(F.col(c) for c in columns))
    with_delivery = store.update_from(base, planned.where("route = 'delivery'").select("symbol_id", "date", "delivery_qty", "delivery_pct"), ["symbol_id", "date"])
    return Ingested(
        store.upsert(with_delivery, bars_in, ["symbol_id", "date"]),
        planned.where("is_action").select("symbol_id", F.col("date").alias("ex_date"), "ratio"),
        issues,
        planned.where("route = 'repair_skipped'").select("symbol_id", "date"),
    )


def last_complete_session(now: dt.datetime, ready: str = "16:00") -> dt.date:
    """The latest date whose bars are final at ``now`` (in the market's time): today from ``ready`` on, else yesterday."""
    return now.date() if now.time() >= dt.time.fromisoformat(ready) else now.date() - dt.timedelta(days=1)


def resolve_actions(daily: DataFrame, fresh: DataFrame, actions: DataFrame, threshold: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """Bars and actions after history before open actions' ex-dates was replaced by fresh one that joins on without a step.

    ``actions`` is ``symbol_id, ex_date, ratio, action_type, resolved``; a
    symbol's open actions are taken in the order of their ex-dates, at most
    one an ex-date.  One that does not hold stays open and is left out.
    """
    new, done = ingest.resolve_action(daily, fresh, actions.where("not resolved"), threshold)
    until = done.groupBy("symbol_id").agg(F.max("ex_date").alias("_until"))
    kept = daily.join(until, "symbol_id", "left").where("_until is null or date >= _until").select(*daily.columns)
    bars_in = new.withColumn("source", F.lit("fresh"))
    marked = actions.join(done.select("symbol_id", "ex_date", F.lit(True).alias("_done")), ["symbol_id", "ex_date"], "left")
    settled = {"resolved": F.col("resolved") | F.col("_done").isNotNull(), "action_type": F.when(F.col("_done"), F.when(F.col("ratio") > 1, "split").otherwise("unknown")).otherwise(F.col("action_type"))}
    return kept.unionByName(bars_in.select(*(F.col(c) for c in daily.columns))), marked.withColumns(settled).select(*actions.columns)


def repair_gaps(daily: DataFrame, calendar: DataFrame, archive: DataFrame) -> DataFrame:
    """Bars for sessions that a symbol misses between its first and last one, from archived rows scaled onto its history.

    ``archive`` is ``symbol_id, date, open .. volume, prev_close``.  A row is
    scaled by the close of the session before over its own ``prev_close``.  In
    a run of missing sessions each goes on from the one repaired before, so
    the scale of a run is a running product; a missing archive row or a scale
    out of 0.01 to 100 ends it.
    """
    sessions = calendar.select("date", F.row_number().over(Window.orderBy("date")).alias("ix"))  # a row a session
    missing = checks.missing_sessions(daily, calendar, "symbol_id").join(archive, ["symbol_id", "date"]).join(F.broadcast(sessions), "date")
    before = daily.join(F.broadcast(sessions), "date").select("symbol_id", (F.col("ix") + 1).alias("ix"), F.col("close").alias("_stored"))
    w = Window.partitionBy("symbol_id").orderBy("ix")
    rows = missing.join(before, ["symbol_id", "ix"], "left").withColumn("_run", F.col("ix") - F.row_number().over(w))
    run = Window.partitionBy("symbol_id", "_run").orderBy("ix")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    step = F.try_divide(F.coalesce("_stored", F.lag("close").over(run)), "prev_close")
    scaled = rows.withColumn("_step", step).withColumn("_scale", F.product("_step").over(so_far))
    fits = F.coalesce(F.first("_stored").over(so_far).isNotNull() & F.col("_scale").between(0.01, 100.0), F.lit(False))
    good = scaled.withColumn("_ok", F.min(fits).over(so_far)).where("_ok")
    return good.select("symbol_id", "date", *((F.col(c) * F.col("_scale")).alias(c) for c in ("open", "high", "low", "close")), (F.col("volume") / F.col("_scale")).alias("volume"))


@dataclass(frozen=True)
class Backfill:
    """Daily bars, symbols with listing dates, and issues after a backfill."""

    daily: DataFrame
    symbols: DataFrame
    issues: DataFrame


#: Days after which a symbol whose last bar is that old counts as one without data; a fixed value.
STALE_DAYS = 7


def backfill(daily: DataFrame, symbols: DataFrame, fresh: DataFrame, start: str, full: bool = False, benchmark: DataFrame | None = None, end: str | None = None) -> Backfill:
    """Fresh history (symbol, date, open .. volume, seq) checked and put where there is no bar yet, or where ``full`` in place of all bars of the symbols that have any.

    A symbol without clean fresh rows keeps what it has, so a download that
    failed loses nothing.  A symbol whose first bar is more than ten days
    after ``start`` is a new listing.  Sessions that a symbol lacks are issues:
    sessions are the dates of ``benchmark`` from the first fresh one on, or
    where it has none the days on which most symbols traded.  A symbol that
    nothing came for is an issue if it never had a bar or its last one is
    stale at ``end`` (without one: if it has none at all).
    """
    clean, found = checks.validate(fresh, "seq")
    clean = clean.drop("seq")
    calendar = checks.trading_calendar(clean)
    if benchmark is not None:
        since = clean.agg(F.min("date").alias("_since"))
        held = benchmark.select("date").distinct().join(F.broadcast(since)).where(F.col("date") >= F.col("_since")).select("date")
        calendar = held.unionByName(calendar.join(F.broadcast(held.limit(1).select(F.lit(1).alias("_any"))), how="left").where("_any is null").select("date"))
    gaps = checks.gap_issues(clean, calendar).select("symbol", "date", F.lit("gap").alias("issue"), F.to_json(F.struct("missing", "dates")).alias("details"))
    ids = symbols.select("symbol", F.col("id").alias("symbol_id"))
    rows = clean.join(ids, "symbol").withColumn("source", F.lit("backfill"))
    base = daily.join(rows.select("symbol_id").distinct(), "symbol_id", "left_anti") if full else daily
    after = store.upsert(base, rows.select(*(c for c in daily.columns if c in rows.columns)), ["symbol_id", "date"], [])
    spans = after.groupBy("symbol_id").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    known = symbols.join(spans, symbols.id == spans.symbol_id, "left").drop("symbol_id").join(clean.select("symbol", F.lit(True).alias("_came")).distinct(), "symbol", "left")
    missed = F.col("_came").isNull() & (F.col("_first").isNull() | (F.lit(False) if end is None else F.datediff(F.lit(end).cast("date"), "_last") > STALE_DAYS))
    none = known.where(missed).select("symbol", F.lit(end).cast("date").alias("date"), F.lit("no_data").alias("issue"), F.to_json(F.struct(F.lit(start).alias("requested_from"))).alias("details"))
    new = F.col("listed_date").isNull() & (F.col("_first") > F.date_add(F.lit(start).cast("date"), 10))
    listed = known.withColumn("listed_date", F.when(new, F.col("_first")).otherwise(F.col("listed_date"))).select(*symbols.columns)
    return Backfill(after, listed, found.unionByName(gaps).unionByName(none))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 1 in the order of a column, range by range: places within a range, and the sizes of the ranges before it."""
    ranged = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a range
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn(name, place).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def refresh_symbols(symbols: DataFrame, aliases: DataFrame, listing: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and aliases after a new listing: renamed by ISIN with the old text kept as alias, owners of a taken text parked, the unlisted inactive.

    ``symbols`` is ``id, symbol, isin, name, is_active``, ``listing`` is
    ``symbol, isin, name``; new ISINs get ids after the largest one, by ISIN.
    """
    changes = ingest.symbol_changes(listing, symbols)
    parked = changes.where("kind = 'collision'").select(F.col("symbol_id").alias("id"), F.col("new_symbol").alias("_parked"))
    renamed = changes.where("kind = 'rename'").select(F.col("old_symbol"), "symbol_id", F.lit(today).cast("date").alias("changed_on"))
    more = store.upsert(aliases, renamed, ["old_symbol", "changed_on"])
    offered = listing.select("isin", F.col("symbol").alias("_symbol"), F.col("name").alias("_name"))
    known = symbols.join(parked, "id", "left").join(offered, "isin", "left")
    is_listed = F.col("_symbol").isNotNull()
    now = known.select(
        "id", F.coalesce("_symbol", "_parked", "symbol").alias("symbol"), "isin", F.when(is_listed, F.col("_name")).otherwise(F.col("name")).alias("name"), is_listed.alias("is_active")
    )
    top = symbols.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = numbered(listing.join(symbols.select("isin"), "isin", "left_anti"), "isin", "_n").join(F.broadcast(top))  # one row
    added = new.select((F.col("_top") + F.col("_n")).cast(dict(symbols.dtypes)["id"]).alias("id"), "symbol", "isin", "name", F.lit(True).alias("is_active"))
    return now.unionByName(added), more


def refresh_index(members: DataFrame, snapshots: DataFrame, fresh: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Members of the indices in ``fresh`` (index_id, symbol_id) replaced, and today's snapshot of them added once.

    The day a member was added stays; a new one gets today, but on an index's
    first load it is not known.  Indices without fresh rows stay as they are.
    """
    listed = fresh.select("index_id", "symbol_id").distinct()
    touched = listed.select("index_id").distinct()
    before = members.select("index_id").distinct().withColumn("_known", F.lit(True))
    dated = listed.join(members.select("index_id", "symbol_id", "added_on", F.lit(True).alias("_member")), ["index_id", "symbol_id"], "left").join(before, "index_id", "left")
    added = F.when(F.col("_member"), F.col("added_on")).when(F.col("_known"), F.lit(today).cast("date"))
    now = members.join(touched, "index_id", "left_anti").unionByName(dated.select("index_id", "symbol_id", added.alias("added_on")))
    return now, store.upsert(snapshots, listed.withColumn("snapshot_date", F.lit(today).cast("date")), ["index_id", "snapshot_date", "symbol_id"], [])


def refresh_exclusions(lists: DataFrame, symbols: DataFrame, old: DataFrame, today: str) -> DataFrame:
    """Today's slice of the exclusion lists replaced; rows of unknown symbols go, one row a list and symbol."""
    found = ingest.map_ids(files.parse_surveillance(lists), symbols).where("symbol_id is not null")
    new = found.groupBy("list_type", "symbol_id").agg(F.min("stage").alias("stage")).withColumn("as_of_date", F.lit(today).cast("date"))
    return store.replace_where(old, new, F.col("as_of_date") == F.lit(today).cast("date"))


@dataclass(frozen=True)
class PointInTime:
    """Entities with their last names, adjusted bars, applied events and membership."""

    entities: DataFrame
    daily: DataFrame
    events: DataFrame
    members: DataFrame


def build_point_in_time(rows: DataFrame, events: DataFrame, top_n: int, min_traded_pct: float = 80.0, max_gap_days: int = 365) -> PointInTime:
    """From an archive (date, symbol, isin, open .. volume, value) to a universe without survivors' bias, at once.

    ``universe_store`` publishes the same tables and brings them forward.
    """
    traded = rows.where("open > 0 and high > 0 and low > 0 and close > 0")
    linked = written(history.one_a_day(history.entities(traded, max_gap_days)))  # each table below is made of it
    members = history.snapshots(linked.select("entity", "date", "value", "isin"), top_n, min_traded_pct)
    kept = linked.join(members.select("entity").distinct(), "entity", "left_semi")
    adjusted, applied = history.adjust(kept.select("entity", "date", "open", "high", "low", "close", "volume"), history.place_events(events, kept))
    ordered = adjusted.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})
    return PointInTime(universe_store.entity_rows(kept), ordered, applied, members)


def start_run(runs: DataFrame, week: str, started: str) -> DataFrame:
    """The week's run as running, unless it is complete."""
    spark = runs.sparkSession
    row = spark.createDataFrame([(week, started)], "w string, s string").select(F.col("w").cast("date").alias("week_end_date"), F.lit("running").alias("status"), F.col("s").cast("timestamp").alias("started_at"))
    done = runs.where("status = 'complete'").select("week_end_date")
    return store.upsert(runs, row.join(done, "week_end_date", "left_anti"), ["week_end_date"])


def end_run(runs: DataFrame, week: str, finished: str, error: str | None = None) -> DataFrame:
    """The week's run as complete, or as failed with its error; a complete run never becomes a failed one."""
    own = (F.col("week_end_date") == F.lit(week).cast("date")) & (F.lit(error is None) | (F.col("status") != "complete"))
    change = {"status": F.lit("complete" if error is None else "failed"), "finished_at": F.lit(finished).cast("timestamp"), "error": F.lit(error).cast("string")}
    return runs.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in change.items()})


def session_calendar(benchmark: DataFrame, name: str, since: str) -> DataFrame:
    """Dates of a benchmark from a day on."""
    return benchmark.where((F.col("index_name") == name) & (F.col("date") >= F.lit(since).cast("date"))).select("date").distinct()


