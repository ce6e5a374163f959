"""Read queries over weekly snapshots: filters, presets, signals, differences, details."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import truth
from tideline.operators.indicators import plain_averages

#: The entry rule: most weeks in trend, least score, score at which it is left.
RULE = {"max_weeks": 1, "min_score": 70.0, "exit_score": 30.0}
PRESETS: dict[str, dict[str, str]] = {
    "rule1": {"dir": "Bullish", "wmax": "1", "minScore": "70", "tradeable": "1"},
    "best": {"qualified": "1", "grade": "A+,A"},
    "fresh": {"dir": "Bullish", "fresh": "6"},
    "nearhigh": {"dir": "Bullish", "maxFromHigh": "5"},
    "bearflips": {"dir": "Bearish", "wmax": "1"},
}
PAGE_LEAST, PAGE_MOST, PAGE = 1, 500, 100


def _items(v: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (v or "").split(",") if x.strip())


def _number(v: str | None) -> float | None:
    try:
        return float(v) if v not in (None, "") else None
    except ValueError:
        return None


@dataclass(frozen=True)
class FilterSpec:
    """What a reader asks for; empty and None mean anything."""

    q: str = ""
    direction: str = ""
    sectors: tuple[str, ...] = ()
    indices: tuple[str, ...] = ()
    qualified: bool = False
    grades: tuple[str, ...] = ()
    weeks_least: float | None = None
    weeks_most: float | None = None
    from_high_most: float | None = None
    market_cap_least: float | None = None
    turnover_least: float | None = None
    fresh: float | None = None
    above: tuple[str, ...] = ()
    score_least: float | None = None
    tradeable: bool = False

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> FilterSpec:
        """Parameters as a URL has them; a ``preset`` fills in what is not given."""
        p = {**PRESETS.get(params.get("preset", ""), {}), **params}
        return cls(
            p.get("q", "").strip().upper(), p.get("dir", ""), _items(p.get("sector")), _items(p.get("index")), p.get("qualified") == "1", _items(p.get("grade")),
            _number(p.get("wmin")), _number(p.get("wmax")), _number(p.get("maxFromHigh")), _number(p.get("minMcap")), _number(p.get("minTurnover")), _number(p.get("fresh")),
            _items(p.get("above")), _number(p.get("minScore")), p.get("tradeable") == "1",
        )

    def condition(self) -> Column:
        """One predicate for Catalyst to push down; an unknown value fails a range."""
        c = F.col
        bullish = c("direction") == "Bullish"
        parts = [F.lit(True)]
        if self.q:
            parts.append(c("symbol").contains(self.q) | truth(F.upper("name").contains(self.q)))
        if self.direction:
            parts.append(c("direction") == self.direction)
        if self.sectors:
            parts.append(c("industry").isin(*self.sectors))
        if self.indices:
            parts.append(F.arrays_overlap(F.split(c("index_list"), r"\|"), F.array(*map(F.lit, self.indices))))
        if self.qualified:
            parts.append(c("qualified"))
        if self.grades:
            parts.append(c("grade").isin(*self.grades))
        for value, name, up in (
            (self.weeks_least, "weeks_in_trend", True), (self.weeks_most, "weeks_in_trend", False), (self.from_high_most, "pct_from_high", False),
            (self.market_cap_least, "market_cap_cr", True), (self.turnover_least, "avg_turnover_20d_cr", True), (self.score_least, "stock_score", True),
        ):
            if value is not None:
                parts.append(c(name) >= value if up else c(name) <= value)
        if self.fresh is not None:
            parts.append(bullish & (c("weeks_in_trend") <= self.fresh))
        if self.tradeable:
            parts.append(is_tradeable())
        parts += [c("price") > c(f"sma{n}") for n in self.above]
        out = parts[0]
        for p in parts[1:]:
            out &= truth(p)
        return out


def is_tradeable() -> Column:
    return F.col("f_liquidity") & F.col("f_price") & F.col("f_not_asm")


def is_entry() -> Column:
    return truth((F.col("direction") == "Bullish") & (F.col("weeks_in_trend") <= RULE["max_weeks"]) & (F.col("stock_score") >= RULE["min_score"])) & is_tradeable()


def ordered(rows: DataFrame, sort: str | None = None, desc: bool = False) -> DataFrame:
    """By a column with NULLs last either way, else bullish and best first; ties by symbol."""
    if sort is None:
        return rows.orderBy(F.desc("direction"), F.desc_nulls_last("stock_score"), "symbol")
    return rows.orderBy(F.desc_nulls_last(sort) if desc else F.asc_nulls_last(sort), "symbol")


def page(rows: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    size = min(max(size, PAGE_LEAST), PAGE_MOST)
    return rows.offset((max(number, 1) - 1) * size).limit(size)


def resolve_week(weeks: DataFrame, week: str | None = None) -> DataFrame:
    """The latest complete week, or the latest at or before a date: one row."""
    inside = F.lit(True) if week is None else F.col("week_end_date") <= F.lit(week).cast("date")
    return weeks.where(inside & (F.col("status") == "complete")).orderBy(F.desc("week_end_date")).limit(1)


def scanner(stocks: DataFrame, week: str, params: Mapping[str, str]) -> DataFrame:
    """Filtered, ordered and paged rows of one week."""
    spec = FilterSpec.from_params(params)
    rows = stocks.where(F.col("week_end_date") == F.lit(week).cast("date")).where(spec.condition())
    return page(ordered(rows, params.get("sort"), params.get("desc") == "1"), int(params.get("page", "1")), int(params.get("size", str(PAGE))))


def top_sectors(sectors: DataFrame, n: int = 5) -> DataFrame:
    return sectors.where(F.col("sector_rank") <= n)


def top_stocks(stocks: DataFrame, n: int = 10) -> DataFrame:
    """Each week's best graded bullish stocks, qualified ones first."""
    w = Window.partitionBy("week_end_date").orderBy(F.desc("qualified"), F.desc("stock_score"), "symbol")
    return stocks.where((F.col("direction") == "Bullish") & F.col("grade").isin("A+", "A")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def trend_counts(stocks: DataFrame) -> DataFrame:
    bull, new = F.col("direction") == "Bullish", F.col("is_new_flip")
    return stocks.groupBy("week_end_date").agg(
        F.count_if(bull).alias("bullish"), F.count_if(~bull).alias("bearish"), F.count_if(bull & new).alias("new_bullish"), F.count_if(~bull & new).alias("new_bearish")
    )


def sector_tails(panels: DataFrame, week: str, points: int = 5) -> DataFrame:
    """Each sector's newest known points within ``points`` calendar weeks, oldest first by ``place``."""
    end = F.lit(week).cast("date")
    inside = panels.where((F.col("week_end_date") <= end) & (F.col("week_end_date") > F.date_sub(end, 7 * points)) & F.col("rs_ratio").isNotNull() & F.col("rs_momentum").isNotNull())
    back = F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("week_end_date")))
    kept = inside.withColumn("_back", back).where(F.col("_back") <= points)
    return kept.select("industry", "week_end_date", "rs_ratio", "rs_momentum", F.row_number().over(Window.partitionBy("industry").orderBy("week_end_date")).alias("place"))


def signals(stocks: DataFrame) -> DataFrame:
    """State of the entry rule as of the latest week: ``symbol, state`` (buy, open, exit, closed) with signal and exit.

    Of a symbol's newest run of trend the first week that met the rule is the
    signal; the first week after it that is missing, bearish or below the exit
    score ends it.
    """
    weeks = stocks.select("week_end_date").distinct().withColumn("ix", F.row_number().over(Window.orderBy("week_end_date")))  # one row a week
    rows = stocks.join(F.broadcast(weeks), "week_end_date")
    last = weeks.agg(F.max("ix").alias("now"))
    entries = rows.where(is_entry()).withColumn("start", F.col("ix") - F.col("weeks_in_trend") + 1)
    w = Window.partitionBy("symbol_id").orderBy(F.desc("start"), "ix")
    first = entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol_id", "symbol", "industry", F.col("ix").alias("signal_ix"), F.col("week_end_date").alias("signal_week"), F.col("price").alias("signal_price"), F.col("stock_score").alias("entry_score"))
    after = first.select("symbol_id", "signal_ix").join(rows.select("symbol_id", "ix", "direction", "stock_score"), "symbol_id").where(F.col("ix") > F.col("signal_ix"))
    order = Window.partitionBy("symbol_id").orderBy("ix")
    stepped = after.withColumn("_gap", F.col("ix") - F.coalesce(F.lag("ix").over(order), F.col("signal_ix")))
    why = F.when(F.col("_gap") > 1, "stale").when(F.col("direction") != "Bullish", "trend").when(F.col("stock_score") < RULE["exit_score"], "score")
    at = F.when(F.col("_gap") > 1, F.col("ix") - F.col("_gap") + 1).otherwise(F.col("ix"))
    ended = stepped.withColumns({"_why": why, "_at": at}).where("_why is not null").groupBy("symbol_id").agg(F.min_by(F.struct(F.col("_at").alias("ix"), F.col("_why").alias("why")), "ix").alias("x"))
    current = rows.join(F.broadcast(last), F.col("ix") == F.col("now")).select("symbol_id", "now", F.col("price").alias("price"), F.col("stock_score").alias("score"), "grade", F.col("st_value").alias("stop"))
    out = first.join(current, "symbol_id").join(ended, "symbol_id", "left")
    state = F.when(F.col("signal_ix") == F.col("now"), "buy").when(F.col("x").isNull(), "open").when(F.col("x.ix") == F.col("now"), "exit").otherwise("closed")
    return out.select(
        "symbol_id", "symbol", "industry", "signal_week", "signal_price", "entry_score", "price", "score", "grade", "stop", (F.col("now") - F.col("signal_ix")).alias("weeks"), state.alias("state"),
        F.when(F.col("x.ix") <= F.col("now"), F.col("x.why")).alias("exit_reason"), ((F.try_divide("price", "signal_price") - 1) * 100).alias("change_pct"), ((F.try_divide("price", "stop") - 1) * 100).alias("stop_dist_pct"),
    )


def states(stocks: DataFrame) -> DataFrame:
    """For every symbol and week ``label``: buy where the rule is met while out, hold after, sell where it ends.

    A week that only meets the rule leaves a holding, one that only ends it
    leaves none, whatever was before; one that does both turns the state, and
    one that does neither keeps it.  So the state is that of the last decisive
    week, turned as often as weeks turned it since.
    """
    leave = truth((F.col("direction") != "Bullish") | (F.col("stock_score") < RULE["exit_score"]))
    w = Window.partitionBy("symbol_id").orderBy("week_end_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = stocks.select("symbol_id", "week_end_date", is_entry().alias("entry"), leave.alias("leave"))
    sure = F.when(F.col("entry") != F.col("leave"), F.col("entry"))
    counted = rows.withColumns({"sure": sure, "turns": F.sum((F.col("entry") & F.col("leave")).cast("int")).over(so_far)})
    since = F.col("turns") - F.coalesce(F.last(F.when(F.col("sure").isNotNull(), F.col("turns")), True).over(so_far), F.lit(0))
    held = F.coalesce(F.last("sure", True).over(so_far), F.lit(False)) != (since % 2 == 1)
    before = counted.withColumn("held", held).withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(False)))
    label = F.when(F.col("before") & F.col("leave"), "sell").when(F.col("before"), "hold").when(F.col("entry"), "buy")
    return before.select("symbol_id", "week_end_date", label.alias("label"))


#: Words for the filters a stock can fail; fixed values.
FILTER_WORDS = {"f_trend_template": "trend template", "f_52w_range": "52W range", "f_rs": "RS rating", "f_liquidity": "liquidity", "f_price": "price", "f_not_asm": "ASM/GSM"}


def run_diff(stocks: DataFrame) -> DataFrame:
    """Against the week before, for every week: ``change`` is entry, exit (with ``why``), bull_flip or bear_flip; a stock may have two.

    Entries qualify now and did not, or were not there; exits did and do not.
    A stock that is gone is no exit.
    """
    weeks = stocks.select("week_end_date").distinct().withColumn("before", F.lag("week_end_date").over(Window.orderBy("week_end_date")))  # one row a week
    old = stocks.select(F.col("week_end_date").alias("before"), "symbol_id", F.col("qualified").alias("_old"))
    both = stocks.join(F.broadcast(weeks), "week_end_date").join(old, ["before", "symbol_id"], "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    failed = F.concat_ws(", ", *(F.when(~F.col(c), w) for c, w in FILTER_WORDS.items()))
    why = F.when(F.col("direction") == "Bearish", "Turned bearish").when(~truth(F.col("sector_tradeable")), "Sector dropped out").otherwise(F.concat(F.lit("Failed: "), F.when(failed != "", failed).otherwise("filters")))
    membership = F.when(F.col("qualified") & ~F.col("_old"), "entry").when(F.col("_old") & ~F.col("qualified"), "exit")
    flip = F.when(F.col("is_new_flip"), F.when(F.col("direction") == "Bullish", "bull_flip").otherwise("bear_flip"))
    rows = both.withColumn("_why", why).withColumn("change", F.explode(F.filter(F.array(membership, flip), lambda x: x.isNotNull())))
    return rows.select("week_end_date", "symbol_id", "symbol", "industry", "change", F.when(F.col("change") == "exit", F.col("_why")).alias("why"), "direction", "stock_score", "grade")


def sector_detail(panels: DataFrame, industry: str, week: str, weeks: int = 156) -> DataFrame:
    return panels.where((F.col("industry") == industry) & (F.col("week_end_date") <= F.lit(week).cast("date"))).orderBy(F.desc("week_end_date")).limit(weeks).select("week_end_date", "index_value", "bench_value", "st_breadth")


def _until(rows: DataFrame, column: str, until: str | None) -> DataFrame:
    return rows if until is None else rows.where(F.col(column) <= F.lit(until).cast("date"))


def stock_detail(daily: DataFrame, symbol_id: int, days: int = 520, until: str | None = None) -> DataFrame:
    """Newest bars of one symbol, up to a date, with averages over its stored closes."""
    return plain_averages(_until(daily.where(F.col("symbol_id") == symbol_id), "date", until)).orderBy(F.desc("date")).limit(days)


def stock_weeks(weekly: DataFrame, series: DataFrame, symbol_id: int, until: str | None = None) -> DataFrame:
    """Weekly bars of one symbol, up to a date, with the trend where it has one."""
    own = lambda df, *c: _until(df.where(F.col("symbol_id") == symbol_id), "week_end_date", until).select("week_end_date", *c)
    return own(weekly, "open", "high", "low", "close", "volume").join(own(series, "st_value", "direction"), "week_end_date", "left")


#: Weeks of a symbol's history that are shown, and that are walked so that the first of them have a state; fixed values.
HISTORY_WEEKS, WALKED_WEEKS = 52, 156


def stock_history(stocks: DataFrame, symbol_id: int, until: str | None = None) -> DataFrame:
    """Newest scan weeks of one symbol with the state of the entry rule in each; the rule is out before the weeks that are walked."""
    walked = _until(stocks.where(F.col("symbol_id") == symbol_id), "week_end_date", until).orderBy(F.desc("week_end_date")).limit(WALKED_WEEKS)
    shown = walked.select("symbol_id", "week_end_date", "direction", "grade", "stock_score", "qualified", "sector_rank", "price")
    return shown.join(states(walked), ["symbol_id", "week_end_date"]).orderBy(F.desc("week_end_date")).limit(HISTORY_WEEKS)


def rebased(rows: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """``value`` as per cent of its first known one."""
    first = F.first(value, True).over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(f"{value}_rebased", F.try_divide(value, first) * 100)


def filter_options(stocks: DataFrame) -> DataFrame:
    """Distinct sectors and index names to choose from: ``kind, value``."""
    sectors = stocks.where("industry is not null").select(F.lit("sector").alias("kind"), F.col("industry").alias("value"))
    names = stocks.where("index_list is not null").select(F.lit("index").alias("kind"), F.explode(F.split("index_list", r"\|")).alias("value"))
    return sectors.unionByName(names).distinct()


def portfolio(trades: DataFrame, stocks: DataFrame, exit_score: float) -> DataFrame:
    """Holdings still open at a run's end against a week's rows, and whether each is to be sold."""
    held = trades.where("exit_reason = 'end'")
    now = stocks.select("symbol_id", "direction", "price", F.col("st_value").alias("stop"), "stock_score")
    joined = held.join(now, "symbol_id", "left")
    sell = ~truth(F.col("direction") == "Bullish") | (F.lit(exit_score > 0) & truth(F.col("stock_score") < exit_score))
    return joined.select("symbol_id", "symbol", "industry", "entry_date", "entry_price", "qty", "stock_score", "price", "stop", sell.alias("sell"), ((F.try_divide("price", "entry_price") - 1) * 100).alias("change_pct"))


def model_run(runs: DataFrame, week: str) -> DataFrame:
    """The newest run of the entry rule: ``id, end_week, stale, k, position_size, position_pct, add_capital, exit_score``, one row or none.

    ``runs`` is ``id, sweep_id, params`` (JSON) and ``end_date``; it is looked
    for among all of them, however old, and experiments are passed over.  A run
    that ends in another week is stale.  ``k`` is the most positions, NULL
    without a limit.
    """
    parsed = runs.where("sweep_id is null").withColumn("_p", F.try_parse_json("params"))
    p = lambda name, kind: F.try_variant_get("_p", f"$.{name}", kind)
    named = F.coalesce(p("experiment", "string"), F.lit("")) != ""
    rule = (
        (p("entry_max_weeks_in_trend", "double") == RULE["max_weeks"]) & (p("min_score", "double") == RULE["min_score"]) & (p("top_n_sectors", "double") == 0) & ~p("sector_exit", "boolean") & (p("entry_filters", "string") == "tradeable")
    )
    fixed = lambda name: F.when((p("sizing", "string") == "fixed") & (p(name, "double") > 0), p(name, "double"))
    # an aggregate, as a filter would be inferred for whatever is joined by the id, and parse a run once for each of its parameters
    found = parsed.agg(F.max_by(F.struct("id", "end_date", "_p"), F.when(truth(rule) & ~named, F.col("id"))).alias("run")).where("run is not null").select("run.*")
    return found.select(
        "id", F.col("end_date").alias("end_week"), (~F.col("end_date").eqNullSafe(F.lit(week).cast("date"))).alias("stale"), F.when(p("max_positions", "int") > 0, p("max_positions", "int")).alias("k"),
        fixed("position_size").alias("position_size"), fixed("position_pct").alias("position_pct"), truth(p("add_capital", "boolean")).alias("add_capital"), F.coalesce(p("exit_score_below", "double"), F.lit(0.0)).alias("exit_score"),
    )


def model_holdings(run: DataFrame, trades: DataFrame, stocks: DataFrame) -> DataFrame:
    """Positions the model's run (one row of ``model_run``) still held at its end, against the week's rows; a stale run has none."""
    held = trades.where("exit_reason = 'end'").join(F.broadcast(run.where("not stale").select(F.col("id").alias("run_id"), "exit_score")), "run_id")
    now = stocks.select("symbol_id", "direction", "price", F.col("st_value").alias("stop"), F.col("stock_score").alias("score"))
    sell = ~truth(F.col("direction") == "Bullish") | truth((F.col("exit_score") > 0) & (F.col("score") < F.col("exit_score")))
    per_cent = lambda a, b: (F.try_divide(a, b) - 1) * 100
    return held.join(now, "symbol_id", "left").select(
        "run_id", "symbol_id", "symbol", "industry", "entry_date", "entry_price", "qty", "score", "price", "stop", sell.alias("sell"), per_cent("price", "entry_price").alias("change_pct"), per_cent("price", "stop").alias("stop_dist_pct")
    )


def model_buys(run: DataFrame, holdings: DataFrame, signals: DataFrame) -> DataFrame:
    """``symbol_id, symbol, score, place, free_slots``: the week's buys, best score first, as many as the model has slots for; all without a limit (NULL slots)."""
    kept = holdings.agg(F.count_if(~F.col("sell")).alias("_kept"))  # one row
    slots = run.where("not stale").join(kept).select((F.col("k") - F.col("_kept")).alias("free_slots"))
    buys = signals.where("state = 'buy'").select("symbol_id", "symbol", "score", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")).alias("place"))  # some rows of one week
    return buys.join(F.broadcast(slots)).where("free_slots is null or place <= free_slots")


def list_runs(runs: DataFrame, complete_only: bool = False) -> DataFrame:
    """Runs, newest week first."""
    return (runs.where("status = 'complete'") if complete_only else runs).orderBy(F.desc("week_end_date"))


def backtests(runs: DataFrame, limit: int = 200) -> DataFrame:
    """Runs outside experiments with their main figures and parameters flattened, newest first."""
    number = lambda column, path: F.get_json_object(column, path).cast("double")
    rows = runs.where(F.get_json_object("params", "$.experiment").isNull())
    return rows.orderBy(F.desc("id")).limit(limit).select(
        "id", "name", number("metrics", "$.cagr_pct").alias("cagr_pct"), number("metrics", "$.max_drawdown_pct").alias("max_drawdown_pct"), number("metrics", "$.sharpe").alias("sharpe"),
        number("params", "$.max_positions").alias("max_positions"), number("params", "$.min_score").alias("min_score"), F.get_json_object("params", "$.sizing").alias("sizing"),
    )


def _plain(numbers: Column) -> Column:
    """Numbers as text, whole ones without a point, joined by commas."""
    text = F.transform(numbers, lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))
    return F.array_join(text, ", ")


def backtest_rows(runs: DataFrame) -> DataFrame:
    """Every run with its parameters and metrics flattened, from JSON whose fields come and go.

    ``runs`` is ``id, sweep_id, name, cagr, max_drawdown, sharpe,
    profit_factor, win_rate, trades`` and JSON texts ``params, metrics,
    benchmark_metrics``, each parsed once, to a variant.  A field that is absent
    or of another kind is NULL or its default; a text that is no JSON has no
    fields.
    """
    p, m, b = (F.try_parse_json(c) for c in ("params", "metrics", "benchmark_metrics"))
    parsed = runs.withColumns({"_p": p, "_m": m, "_b": b})
    param = lambda path, kind: F.try_variant_get("_p", f"$.{path}", kind)
    metric = lambda path: F.try_variant_get("_m", f"$.{path}", "double")
    bench = lambda path: F.try_variant_get("_b", f"$.{path}", "double")
    leaves = F.when(param("sector_exit", "boolean") == F.lit(False), "st").otherwise("st+sector")
    return parsed.select(
        "id", "sweep_id", "name", F.coalesce(param("kind", "string"), F.lit("run")).alias("kind"), "cagr", "max_drawdown", "sharpe", "profit_factor", "win_rate", "trades",
        F.coalesce(_plain(param("supertrend", "array<double>")), F.lit("")).alias("st"), param("sector_weights", "string").alias("weights"), param("top_n_sectors", "int").alias("top_n"), param("min_rs", "double").alias("min_rs"),
        F.coalesce(param("min_score", "double"), F.lit(0.0)).alias("min_score"), param("max_positions", "int").alias("k"), param("sizing", "string").alias("sizing"), F.coalesce(param("entry_max_weeks_in_trend", "int"), F.lit(0)).alias("entry_weeks"),
        F.coalesce(param("entry_filters", "string"), F.lit("all")).alias("filters"), F.coalesce(param("variants.exit", "string"), leaves).alias("exit_rule"), F.coalesce(param("variants.rank", "string"), F.lit("scanner")).alias("rank"),
        F.coalesce(param("variants.regime", "string"), param("bear_mode", "string")).alias("regime"), metric("mar").alias("mar"), metric("exposure_pct").alias("exposure"), bench("cagr_pct").alias("bench_cagr"), bench("universe_ew.cagr_pct").alias("ew_cagr"),
        (F.col("cagr") - bench("cagr_pct")).alias("alpha"), metric("oos.cagr_pct").alias("oos_cagr"), metric("oos.max_drawdown_pct").alias("oos_dd"), metric("oos.benchmark_cagr_pct").alias("oos_bench"), param("experiment", "string").alias("experiment"),
    )


def run_parameters(runs: DataFrame) -> DataFrame:
    """``id, name, value``: every parameter of every run, also those nobody has asked for yet; the value as JSON."""
    each = runs.select(F.col("id").alias("run"), F.try_parse_json("params").alias("_p")).where("_p is not null")
    fields = each.lateralJoin(runs.sparkSession.tvf.variant_explode(F.col("_p").outer()))
    return fields.select(F.col("run").alias("id"), F.col("key").alias("name"), F.to_json("value").alias("value"))


def experiment_log(runs: DataFrame) -> DataFrame:
    """Variants of each experiment, the best return first."""
    rows = runs.withColumns({"experiment": F.get_json_object("params", "$.experiment"), "variant": F.get_json_object("params", "$.variant"), "cagr_pct": F.get_json_object("metrics", "$.cagr_pct").cast("double")})
    return rows.where("experiment is not null").select("experiment", "variant", "id", "cagr_pct", F.row_number().over(Window.partitionBy("experiment").orderBy(F.desc_nulls_last("cagr_pct"), "id")).alias("place"))


def sweeps(runs: DataFrame) -> DataFrame:
    """Runs and best return of each sweep."""
    return runs.where("sweep_id is not null").groupBy("sweep_id").agg(F.count("*").alias("runs"), F.max(F.get_json_object("metrics", "$.cagr_pct").cast("double")).alias("best_cagr_pct"))


def backtest(runs: DataFrame, equity: DataFrame, trades: DataFrame, run_id: int) -> DataFrame:
    """One run with its curve and trades as arrays in order."""
    own = lambda df: df.where(F.col("run_id") == run_id)
    curve = own(equity).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("date", "equity", "benchmark", "drawdown"))).alias("equity"))
    sold = own(trades).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("entry_date", "symbol", "exit_date", "qty", "pnl", "exit_reason"))).alias("trades"))
    return own(runs).join(curve, "run_id", "left").join(sold, "run_id", "left")
