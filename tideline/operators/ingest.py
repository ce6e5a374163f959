"""Planning of daily ingest, downloads, corporate actions and universe changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symbol_state(daily: DataFrame, ids: DataFrame, day: str) -> DataFrame:
    """For each symbol the last bar before ``day`` and whether it has one on it, after it, or any."""
    d = F.lit(day).cast("date")
    before = F.when(F.col("date") < d, F.struct("date", "close"))
    found = daily.join(ids.select("symbol_id"), "symbol_id", "left_semi").groupBy("symbol_id").agg(F.max(before).alias("p"), F.max(F.col("date") == d).alias("exists_d"), F.max(F.col("date") > d).alias("has_after"))
    no = F.lit(False)
    return ids.select("symbol_id").join(found, "symbol_id", "left").select(
        "symbol_id", F.col("p.close").alias("prev_close_db"), F.col("p.date").alias("prev_date_db"), F.coalesce("exists_d", no).alias("exists_d"), F.coalesce("has_after", no).alias("has_after"), F.col("exists_d").isNotNull().alias("has_any")
    )


def plan_day(feed: DataFrame, state: DataFrame, previous: str | None, threshold: float = 0.03) -> DataFrame:
    """Every feed row with ``route`` and ``is_action``.

    Routes: ``delivery`` (the bar is there), ``append``, ``repair`` (bars follow; prices and
    volumes scaled by the ratio of closes), ``repair_skipped``.  An appended row whose ratio is
    off by more than ``threshold`` from the session before marks a corporate action.
    """
    rows = feed.join(state.where("has_any"), "symbol_id")
    ratio = F.try_divide("prev_close_db", "prev_close")
    follows = F.coalesce(F.col("prev_date_db") == F.lit(previous).cast("date"), F.lit(False))
    fits = follows & F.coalesce(F.col("ratio").between(0.01, 100.0), F.lit(False))
    route = F.when(F.col("exists_d"), "delivery").when(~F.col("has_after"), "append").when(fits, "repair").otherwise("repair_skipped")
    marked = rows.withColumn("ratio", ratio).withColumn("route", route)
    action = (F.col("route") == "append") & follows & F.coalesce(F.abs(F.col("ratio") - 1) > threshold, F.lit(False))
    scale = F.when(F.col("route") == "repair", F.col("ratio")).otherwise(1.0)
    return marked.withColumn("is_action", action).withColumns(
        {c: F.col(c) * scale for c in ("open", "high", "low", "close")} | {c: F.col(c) / scale for c in ("volume", "delivery_qty")}
    )


def symbol_map(symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """``symbol, symbol_id``: a current symbol wins over an old alias of the same text."""
    every = symbols.select("symbol", F.col("id").alias("symbol_id"), F.lit(0).alias("p")).unionByName(aliases.select(F.col("old_symbol").alias("symbol"), "symbol_id", F.lit(1).alias("p")))
    w = Window.partitionBy("symbol").orderBy("p", "symbol_id")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "symbol_id")


def previous_session(benchmark: DataFrame, log: DataFrame, day: str) -> DataFrame:
    """The latest date before ``day`` that the benchmark or a successful file has: one row."""
    d = F.lit(day).cast("date")
    dates = benchmark.select("date").unionByName(log.where("source = 'bhavcopy' and status = 'ok'").select(F.col("trade_date").alias("date"))).where(F.col("date") < d).distinct()
    return dates.agg(F.max("date").alias("previous"))


def pending_dates(log: DataFrame, start: str, end: str, most: int = 10) -> DataFrame:
    """Weekdays of the last ``most`` in the range that have neither a file nor a holiday on record."""
    spark = log.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    last = days.orderBy(F.desc("date")).limit(most)
    return last.join(log.where("status in ('ok', 'holiday')").select(F.col("trade_date").alias("date")), "date", "left_anti")


def settle_actions(old: DataFrame, fresh: DataFrame, actions: DataFrame, threshold: float = 0.03) -> DataFrame:
    """``actions`` (symbol_id, ex_date, ratio) whose fresh history joins on without a step, taken in the order of their ex-dates.

    An action holds where the last fresh close before its ex-date is the last
    stored one over its ratio.  What is stored then are the bars that earlier
    actions of the symbol have left: from the latest settled ex-date on the
    old ones, before it the fresh ones.  So a symbol's few actions are folded
    in order, the settled date carried along.
    """
    a = actions.select("symbol_id", "ex_date", "ratio")
    last = lambda df, name: df.join(a.select("symbol_id", "ex_date"), "symbol_id").where("date < ex_date").groupBy("symbol_id", "ex_date").agg(F.max(F.struct("date", "close")).alias(name))
    ends = a.join(last(old, "_old"), ["symbol_id", "ex_date"]).join(last(fresh, "_new"), ["symbol_id", "ex_date"])
    step = F.struct("ex_date", "ratio", F.col("_old.date").alias("at"), F.col("_old.close").alias("stored"), F.col("_new.close").alias("fresh"))
    none = F.struct(F.lit(None).cast("date").alias("since"), F.lit(None).cast("double").alias("left"), F.array().cast("array<struct<ex_date:date,ratio:double>>").alias("done"))

    def take(state: Column, x: Column) -> Column:
        before = F.when(state["since"].isNull() | (x["at"] >= state["since"]), x["stored"]).otherwise(state["left"])
        holds = F.coalesce(F.abs(F.try_divide(x["fresh"], before / x["ratio"]) - 1) <= threshold, F.lit(False))
        settled = F.struct(x["ex_date"].alias("since"), x["fresh"].cast("double").alias("left"), F.concat(state["done"], F.array(F.struct(x["ex_date"].alias("ex_date"), x["ratio"].cast("double").alias("ratio")))).alias("done"))
        return F.when(holds, settled).otherwise(state)

    folded = ends.groupBy("symbol_id").agg(F.array_sort(F.collect_list(step)).alias("_all")).select("symbol_id", F.aggregate("_all", none, take)["done"].alias("done"))
    return folded.select("symbol_id", F.explode("done").alias("d")).select("symbol_id", "d.ex_date", "d.ratio")


def resolve_action(old: DataFrame, fresh: DataFrame, actions: DataFrame, threshold: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """Fresh bars before the last settled ex-date of each symbol, and the settled actions.

    Delivery figures of the old bars stay; the quantity of a day is multiplied
    by the ratio of every settled action after it.
    """
    done = settle_actions(old, fresh, actions, threshold)
    each = done.groupBy("symbol_id").agg(F.max("ex_date").alias("_until"), F.collect_list(F.struct("ex_date", "ratio")).alias("_done"))
    after = F.aggregate("_done", F.lit(1.0), lambda total, x: total * F.when(x["ex_date"] > F.col("date"), x["ratio"]).otherwise(1.0))
    kept = old.select("symbol_id", "date", "delivery_qty", "delivery_pct")
    new = fresh.select("symbol_id", "date", "open", "high", "low", "close", "volume").join(each, "symbol_id").where("date < _until").join(kept, ["symbol_id", "date"], "left")
    return new.withColumn("delivery_qty", F.col("delivery_qty") * after).drop("_done", "_until"), done


def plan_downloads(state: DataFrame, default_start: str, end: str) -> DataFrame:
    """``start, end, symbols``: symbols by the day after their last bar."""
    start = F.coalesce(F.date_add("last_date", 1), F.lit(default_start).cast("date"))
    todo = state.withColumn("start", start).where(F.col("start") <= F.lit(end).cast("date"))
    return todo.groupBy("start").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols")).select("start", F.lit(end).cast("date").alias("end"), "symbols")


def plan_extend(state: DataFrame, default_start: str) -> DataFrame:
    """``start, end, symbols``: symbols without a listing date by the day before their first bar."""
    todo = state.where("first_date is not null and listed_date is null").withColumn("end", F.date_sub("first_date", 1)).where(F.col("end") > F.lit(default_start).cast("date"))
    return todo.groupBy("end").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols")).select(F.lit(default_start).cast("date").alias("start"), "end", "symbols")


def symbol_changes(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """``kind, symbol_id, old_symbol, new_symbol``: renames (same ISIN, new text) and collisions (same text, other ISIN)."""
    new = listing.select("isin", F.col("symbol").alias("new_symbol"))
    renames = existing.join(new, "isin").where("symbol <> new_symbol").select(F.lit("rename").alias("kind"), F.col("id").alias("symbol_id"), F.col("symbol").alias("old_symbol"), "new_symbol")
    owner = listing.select("symbol", F.col("isin").alias("owner"))
    clash = existing.join(owner, "symbol").where(~F.col("isin").eqNullSafe(F.col("owner")))
    parked = F.concat("symbol", F.lit("#"), F.col("id").cast("string"))
    return renames.unionByName(clash.select(F.lit("collision").alias("kind"), F.col("id").alias("symbol_id"), F.col("symbol").alias("old_symbol"), parked.alias("new_symbol")))


def map_ids(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` with ``symbol_id`` by ISIN, else by ticker."""
    by_isin = symbols.where("isin is not null").groupBy("isin").agg(F.min("id").alias("_i"))
    by_text = symbols.groupBy("symbol").agg(F.min("id").alias("_s"))
    return rows.join(by_isin, "isin", "left").join(by_text, "symbol", "left").withColumn("symbol_id", F.coalesce("_i", "_s")).drop("_i", "_s")


def refresh_members(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Membership replaced, the day a member was added kept."""
    return new.join(old.select("index_id", "symbol_id", "added_on"), ["index_id", "symbol_id"], "left").withColumn("added_on", F.coalesce("added_on", F.lit(today).cast("date")))


def index_lists(members: DataFrame, indices: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``symbol_id, index_list``: names by category, then id, joined by ``|``; without the indices named in ``exclude``."""
    shown = indices.where(~F.col("name").isin(*exclude)) if exclude else indices
    named = members.join(shown, members.index_id == shown.id).select("symbol_id", "category", "id", "name")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("category", "id", "name"))), lambda s: s["name"])
    return named.groupBy("symbol_id").agg(F.array_join(ordered, "|").alias("index_list"))


def without_pattern(listing: DataFrame, pattern: str) -> DataFrame:
    return listing.where(~F.col("symbol").rlike(pattern))
