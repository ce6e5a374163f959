"""Registered queries of the archive, of backfills from it, and of streams that catch up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.backtest import metrics as figures
from tideline.backtest.store import Result, RunStore
from tideline.operators import bars, jobs, trend
from tideline.operators.universe_store import UniverseStore
from tideline.plans import api
from tideline.plans.catalog import _r, registered, rounded
from tideline.plans.catalog_more import _HIST, _history
from tideline.plans.oracle import query
from tideline.sources import archive, files
from tideline.sources.lineage import cut, shared_folder, version, written
from tideline.sources.market import daily_returns, market, supplier_ticks, table, walk
from tideline.streaming import live


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ archive


def _zipped(spark: SparkSession, sf_dir: str) -> str:
    """All bars as an archive, the new layout from the middle of 1998; some symbols in two series, some in the second only."""
    d = market(spark, sf_dir).daily.select("symbol_id", "date", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    names = d.withColumns({"symbol": F.concat(F.lit("S"), F.col("symbol_id").cast("string")), "isin": F.concat(F.lit("INE"), F.lpad(F.col("symbol_id").cast("string"), 9, "0")), "prev_close": F.col("open"), "value": F.col("close") * F.col("volume")})
    main = names.where("symbol_id % 7 <> 0").withColumn("series", F.lit("EQ"))
    other = names.where("symbol_id % 7 = 0 or symbol_id % 2 = 0").withColumns({"series": F.lit("BE"), "close": F.col("close") * 2})
    path = _folder(spark, "archive")
    archive.write_archive(main.unionByName(other), path, new_from="1998-06-15")
    return path


@registered(
    query(
        f"""select 'S' || symbol_id as symbol, date, case when symbol_id % 7 = 0 then 'BE' else 'EQ' end as series, 'INE' || lpad(cast(symbol_id as varchar), 9, '0') as isin, {_r('open high low')},
        round(close * case when symbol_id % 7 = 0 then 2 else 1 end, 6) as close, cast(volume as double) as volume from daily where date between date '1998-01-01' and date '1998-12-31'""",
        ["daily"],
    )
)
def archive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year of the archive, read through the data source; files of other years are not opened."""
    rows = archive.archive(spark, _zipped(spark, sf_dir), ["EQ", "BE"])
    return rounded(rows.where("date between '1998-01-01' and '1998-12-31'").select("symbol", "date", "series", "isin", "open", "high", "low", "close", "volume"))


@registered(
    query(
        """select symbol_id, date, round(case when date < date '1998-02-01' and symbol_id % 2 = 0 then close * 3 else close end, 6) as close, case when date < date '1998-02-01' and symbol_id % 2 = 0 then 'file' else 'backfill' end as source
        from daily where symbol_id % 7 <> 0 and date <= date '1998-12-31' and (date >= date '1998-01-01' or symbol_id % 2 = 0)
        union all select symbol_id, date, round(close * 3, 6), 'file' from daily where symbol_id % 7 = 0 and symbol_id % 2 = 0 and date < date '1998-02-01'""",
        ["daily"],
    )
)
def job_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of half the symbols to January 1998, and a backfill of that year from the archive; stored bars are not overwritten."""
    m = market(spark, sf_dir)
    kept = m.daily.where("symbol_id % 2 = 0 and date < '1998-02-01'").select("symbol_id", "date", *((F.col(c) * 3).alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("double").alias("volume"), F.lit("file").alias("source"))
    symbols = m.symbols.select(F.concat(F.lit("S"), F.col("symbol_id").cast("string")).alias("symbol"), F.col("symbol_id").alias("id"), F.lit(None).cast("date").alias("listed_date"))
    fresh = archive.archive(spark, _zipped(spark, sf_dir), ["EQ"], start="1998-01-01", end="1998-12-31").select("symbol", "date", "open", "high", "low", "close", "volume", F.lit(0).alias("seq"))
    done = jobs.backfill(kept, symbols, fresh, "1998-01-01", benchmark=m.benchmark.where("index_name = 'ALL'"), end="1998-12-31")
    return rounded(done.daily.select("symbol_id", "date", "close", "source"))


@registered(
    query(
        f"select symbol_id, monday, week_end_date, week_start_date, {_r('open high low close')}, volume, trading_days from weekly", ["weekly"]
    ).replace("cast(regexp_extract(p_brand, '([0-9]+)$', 1) as integer) as symbol_id", "cast(l_suppkey as integer) as symbol_id", 1).replace("from lineitem join part on l_partkey = p_partkey where", "from lineitem where", 1)
)
def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a market whose symbols are the suppliers, so that it grows with the tables."""
    return rounded(bars.weekly_bars(walk(daily_returns(supplier_ticks(spark, sf_dir)))))


# ------------------------------------------------------ point-in-time tables


_PIT: dict[tuple, UniverseStore] = {}


def _universe(spark: SparkSession, sf_dir: str) -> UniverseStore:
    """The universe of an archive with a split of every share in June 1998, published to 1997, then for 1998, then for what follows; once for a session and its file."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _PIT:
        h = written(_history(spark, sf_dir).groupBy("date", "symbol", "isin").agg(F.sum("value").alias("value")))
        price = (F.col("value") + 100) * F.when((F.col("date") < "1998-06-01") & F.col("isin").isNotNull(), 2.0).otherwise(1.0)
        rows = h.select("date", "symbol", "isin", "value", price.alias("open"), (price - 1).alias("high"), (price + 1).alias("low"), price.alias("close"), (F.col("value") * 10).alias("volume"))
        events = h.where("isin is not null").groupBy("isin").agg(F.min("symbol").alias("symbol")).select("symbol", "isin", F.lit("1998-06-01").cast("date").alias("ex_date"), F.lit(0.5).alias("factor"))
        made = UniverseStore(spark, _folder(spark, "universe"), 20, 10.0)
        for years in ("date < '1998-01-01'", "year(date) = 1998", "date >= '1999-01-01'"):
            made.publish(rows.where(years), events)
        _PIT[key] = made
    return _PIT[key]


_PIT_SQL = """with recursive h as materialized (select date, symbol, isin, sum(value) as value, (sum(value) + 100) * case when date < date '1998-06-01' and isin is not null then 2.0::double else 1.0 end as price from {hist} group by date, symbol, isin),
    pairs as materialized (select distinct symbol, isin from h), edges as materialized (select distinct a.symbol as a, b.symbol as b from pairs a join pairs b on a.isin = b.isin),
    reach as (select symbol as a, symbol as b from pairs union select r.a, e.b from reach r join edges e on e.a = r.b), roots as materialized (select a as symbol, min(b) as root from reach group by 1),
    days as (select root, date, coalesce(cast(date_diff('day', lag(date) over (partition by root order by date), date) > 365 as integer), 0) as new from (select distinct root, date from h join roots using (symbol))),
    segments as materialized (select root, date, root || '#' || sum(new) over (partition by root order by date) as entity from days),
    best as materialized (select h.*, s.entity from h join roots using (symbol) join segments s on s.root = roots.root and s.date = h.date qualify row_number() over (partition by s.entity, h.date order by value desc, symbol) = 1),
    s as materialized (select distinct date from h), plan as materialized (select max(s.date) filter (s.date <= eff) as snapshot_date, ws, we, count(*) filter (s.date between ws and we) as n, min(s.date) as f, max(s.date) as l
      from (select last_day(make_date(y, e, 1)) as eff, last_day(make_date(y, w, 1)) as we, cast(last_day(make_date(y, w, 1)) - interval 6 month as date) + 1 as ws from range(1990, 2003) t(y), (values (3, 1), (9, 7)) v(e, w)) cross join s group by eff, ws, we),
    members as materialized (select snapshot_date, entity from (select snapshot_date, entity, count(distinct date) as days, sum(value) / n as v, n from best join plan on date between ws and we where isin like 'INE%' and ws >= f and snapshot_date > we and snapshot_date <= l group by snapshot_date, entity, n)
      where days >= n * 10 / 100.0 qualify row_number() over (partition by snapshot_date order by v desc, entity) <= 20),
    kept as materialized (select *, price / lag(price) over (partition by entity order by date) as gap from best where entity in (select entity from members)),
    placed as (select entity, count(*) as k from (select isin, arg_min(entity, date) as entity from kept where isin is not null group by 1) group by 1),
    applied as materialized (select * from (select entity, date, power(0.5, k) as factor, gap from kept join placed using (entity) where date between date '1998-06-01' and date '1998-07-01' qualify row_number() over (partition by entity order by date) = 1) where abs(ln(gap / factor)) < abs(ln(gap)))
    """.replace("{hist}", _HIST)


@registered(_PIT_SQL + "select entity, date, round(factor, 6) as factor, round(gap, 6) as gap from applied")
def pit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that the gap of their session confirms, after three publications."""
    return rounded(_universe(spark, sf_dir).events())


@registered(_PIT_SQL + "select * from members")
def pit_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).members()


@registered(_PIT_SQL + "select k.entity, k.date, round(price * m, 6) as open, round(price * m, 6) as close, round(greatest(price - 1, price) * m, 6) as high, round(least(price + 1, price) * m, 6) as low, round(value * 10 / m, 6) as volume from (select k.*, case when a.date > k.date then factor else 1 end as m from kept k left join applied a on a.entity = k.entity) k")
def pit_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted bars, one a day for each entity that ever was a member."""
    return rounded(_universe(spark, sf_dir).daily().drop("symbol"))


@registered(
    _PIT_SQL
    + """, last as (select entity, arg_max(symbol, date) as symbol, arg_max(isin, date) as isin, min(date) as listed_date, max(date) as last_date, list_sort(list(distinct isin) filter (isin is not null)) as isins from kept group by 1)
    select entity, case when row_number() over (partition by symbol order by last_date desc, entity) > 1 then symbol || '~' || extract('year' from last_date) else symbol end as symbol, case when row_number() over (partition by coalesce(isin, entity) order by last_date desc, entity) = 1 then isin end as isin,
    listed_date, last_date, case when last_date < (select max(date) from kept) - 30 then 'delisted' else 'listed' end as status, isins from last"""
)
def pit_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).entities()


# -------------------------------------------------------------- store of runs


def _results(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> Result:
    """A run for every customer: its orders are the curve, those of status F the trades."""
    o = table(spark, sf_dir, "orders")
    worth = F.sum(F.col("o_totalprice") * factor).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    none = lambda kind: F.lit(None).cast(kind)
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("run_id"), F.col("c_mktsegment").alias("sweep_id"), F.col("c_name").alias("name"), F.lit("{}").alias("params"), F.lit("{}").alias("metrics"), none("timestamp").alias("created_at"), F.concat(F.lit("e"), (F.col("c_custkey") % 3).cast("string")).alias("experiment")
    )
    day = o.select(F.col("o_custkey").cast("long").alias("run_id"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int")).alias("date"), worth.alias("equity"), "o_orderkey")
    curve = day.select("run_id", "date", "equity", none("double").alias("benchmark"), (-(F.col("o_orderkey") % 40)).cast("double").alias("drawdown"), none("double").alias("invested_pct"), none("int").alias("positions"), F.lit(0.0).alias("flow"))
    sold = o.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("long").alias("run_id"), F.lit(1).alias("symbol_id"), F.lit("A").alias("symbol"), none("string").alias("industry"), none("date").alias("signal_date"), F.to_date("o_orderdate").alias("entry_date"), none("double").alias("entry_price"), none("date").alias("exit_date"),
        none("double").alias("exit_price"), F.lit(1.0).alias("qty"), (F.col("o_totalprice") * factor).alias("pnl"), none("double").alias("pnl_pct"), none("int").alias("weeks_held"), none("string").alias("exit_reason"), none("double").alias("entry_score"),
    )
    return Result(runs, curve, sold)


@registered(
    """select c_custkey as run_id, 'e' || (c_custkey % 3) as experiment, c_name as name, c_mktsegment as sweep_id, cast(min(-(o_orderkey % 40)) as double) as worst_drawdown, count(*) filter (o_orderstatus = 'F') as trades,
    round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0) * case when c_custkey % 3 = 1 then 2 else 1 end, 4) as pnl from customer left join orders on o_custkey = c_custkey where c_custkey % 3 < 2 group by c_custkey, c_name, c_mktsegment"""
)
def run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experiments saved, one of them a second time with doubled results in place of the first; read back and joined by run without a shuffle."""
    store = RunStore(spark, _folder(spark, "runs"), 8)
    for experiment, factor in (("e0", 1.0), ("e1", 1.0), ("e1", 2.0)):
        made = _results(spark, sf_dir, factor)
        mine = made.runs.where(F.col("experiment") == experiment)
        own = lambda df: df.join(mine.select("run_id"), "run_id", "left_semi")  # noqa: B023, E731
        store.save(experiment, Result(mine, own(made.equity), own(made.trades)))
    return rounded(store.overview().drop("final_equity"), 4)


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every order, with JSON parameters of which some are absent, some of another kind, and some unknown."""
    k, when = F.col("o_orderkey"), F.when
    some = lambda every, value: when(k % every == 0, value)
    params = F.struct(
        some(5, F.lit("walk_forward")).alias("kind"), F.array((k % 9 + 1).cast("double"), F.lit(2.5)).alias("supertrend"), (k % 7).alias("top_n_sectors"), some(2, (k % 90).cast("double")).alias("min_score"), (k % 30).alias("max_positions"), F.lit("equal").alias("sizing"),
        when(k % 3 == 0, False).when(k % 3 == 1, True).alias("sector_exit"), some(4, F.struct(F.lit("ma").alias("exit"), some(8, F.lit("cash")).alias("regime"))).alias("variants"), F.lit("half").alias("bear_mode"), (k % 11).alias("not_known_before"),
    )
    metrics = F.struct((F.col("o_totalprice") / 1000).alias("mar"), when(k % 10 == 0, F.lit("none")).otherwise(F.lit(None)).alias("exposure_pct"), some(6, F.struct((k % 13).cast("double").alias("cagr_pct"))).alias("oos"))
    none = lambda kind: F.lit(None).cast(kind)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), none("long").alias("sweep_id"), F.lit("run").alias("name"), F.col("o_totalprice").alias("cagr"), *(none("double").alias(c) for c in ("max_drawdown", "sharpe", "profit_factor", "win_rate")), none("int").alias("trades"),
        when(k % 17 == 0, "{broken").otherwise(F.to_json(params)).alias("params"), F.to_json(metrics).alias("metrics"), F.to_json(F.struct(F.lit(7.5).alias("cagr_pct"))).alias("benchmark_metrics"),
    )


@registered(
    """with o as (select o_orderkey as id, o_orderkey % 17 <> 0 as whole, o_orderkey as k, o_totalprice as x from orders)
    select id, case when whole and k % 5 = 0 then 'walk_forward' else 'run' end as kind, case when whole then (k % 9 + 1) || ', 2.5' else '' end as st, case when whole then cast(k % 7 as integer) end as top_n, case when whole and k % 2 = 0 then cast(k % 90 as double) else 0.0 end as min_score,
    case when whole then cast(k % 30 as integer) end as k, case when whole then 'equal' end as sizing, case when whole and k % 4 = 0 then 'ma' when whole and k % 3 = 0 then 'st' else 'st+sector' end as exit_rule, 'scanner' as rank,
    case when whole and k % 8 = 0 then 'cash' when whole then 'half' end as regime, round(x / 1000, 6) as mar, cast(null as double) as exposure, 7.5 as bench_cagr, round(x - 7.5, 6) as alpha, case when k % 6 = 0 then cast(k % 13 as double) end as oos_cagr from o"""
)
def backtest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of backtests, their parameters flattened from variants."""
    rows = api.backtest_rows(_parameters(spark, sf_dir))
    return rounded(rows.select("id", "kind", "st", "top_n", "min_score", "k", "sizing", "exit_rule", "rank", "regime", "mar", "exposure", "bench_cagr", "alpha", "oos_cagr"))


@registered("select name, count(*) as runs, count(distinct value) as \"values\" from (select unnest([{'name': 'not_known_before', 'value': cast(o_orderkey % 11 as varchar)}, {'name': 'sizing', 'value': 'equal'}], recursive := true) from orders where o_orderkey % 17 <> 0) group by 1")
def parameter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a parameter is given and in how many values: one that the list has, and one that nothing here knows of."""
    every = api.run_parameters(_parameters(spark, sf_dir)).where("name in ('not_known_before', 'sizing')")
    return every.groupBy("name").agg(F.count("*").alias("runs"), F.countDistinct("value").alias("values"))


# -------------------------------------------------------------- recurrences


@registered(
    f"""with recursive days as materialized (select o_custkey as k, cast(o_orderdate as date) as d, sum(case when o_orderkey % 2 = 0 then -o_totalprice else o_totalprice * 1.2 end) as a from orders group by 1, 2),
    flows as materialized (select k, list({{'t': date_diff('day', first, d) / 365.25, 'a': a}} order by d) as f from (select *, min(d) over (partition by k) as first from days) group by k),
    halved as (select k, f, -0.99::double as lo, 10.0::double as hi, list_sum(list_transform(f, lambda x: x.a / pow(0.01, x.t))) as v, 0 as i from flows
      union all select k, f, case when v * m <= 0 then lo else mid end, case when v * m <= 0 then mid else hi end, case when v * m <= 0 then v else m end, i + 1
      from (select *, list_sum(list_transform(f, lambda x: x.a / pow(1 + mid, x.t))) as m from (select *, (lo + hi) / 2 as mid from halved where i < {figures.HALVINGS})))
    select k as run_id, case when list_sum(list_transform(f, lambda x: x.a / pow(0.01, x.t))) * list_sum(list_transform(f, lambda x: x.a / pow(11.0, x.t))) <= 0 then round((lo + hi) / 2 * 100, 6) end as xirr_pct from halved where i = {figures.HALVINGS}"""
)
def money_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money-weighted return of every customer's orders, every second one paid in."""
    o = table(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 1.2)
    return rounded(figures.xirr_by_run(o.select(F.col("o_custkey").alias("run_id"), F.to_date("o_orderdate").alias("date"), amount.alias("amount"))))


# ------------------------------------------------------------------ streams

#: The file of this day holds the rows of the day before: a holiday.
_HOLIDAY, _NEWEST = "1998-06-24", "1998-06-30"


def _day_lines(daily: DataFrame) -> DataFrame:
    """Text columns of the day's file, with the day of the file they are in; the holiday's file holds the rows of the day before."""
    text = lambda c: F.col(c).cast("string")
    wanted = F.explode(F.expr(f"case when date = '{_HOLIDAY}' then array() when date = date '{_HOLIDAY}' - 1 then array(date, date '{_HOLIDAY}') else array(date) end"))
    values = {
        "SYMBOL": F.concat(F.lit("S"), text("symbol_id")), "SERIES": F.lit(" EQ"), "DATE1": F.date_format("date", " dd-MMM-yyyy"), "PREV_CLOSE": text("open"), "OPEN_PRICE": text("open"), "HIGH_PRICE": text("high"), "LOW_PRICE": text("low"), "LAST_PRICE": text("close"),
        "CLOSE_PRICE": text("close"), "AVG_PRICE": text("close"), "TTL_TRD_QNTY": text("volume"), "TURNOVER_LACS": F.lit("0"), "NO_OF_TRADES": F.lit("1"), "DELIV_QTY": F.lit("-"), "DELIV_PER": F.lit("-"),
    }
    return cut(daily).withColumn("wanted", wanted).select("wanted", *(values[c].alias(c) for c in files.DAY_FILE))


@registered(
    query(
        f"""select date as wanted, case when holiday then 'holiday' else 'ok' end as status, count(*) filter (not bad) as rows, count(*) filter (bad) as bad from (
        select f.date, f.date = date '{_HOLIDAY}' as holiday, (d.symbol_id + extract('day' from d.date)) % 5 = 0 as bad from (select distinct date from daily) f join daily d on d.date = case when f.date = date '{_HOLIDAY}' then f.date - 1 else f.date end) group by date, holiday""",
        ["daily"],
    )
)
def landing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days as files, one line in five without a date that can be read: a status for each file, the lines put aside counted."""
    folder = _folder(spark, "landing")
    lines = _day_lines(market(spark, sf_dir).daily)
    day, number = F.substring(F.trim("DATE1"), 1, 2).cast("int"), F.substring("SYMBOL", 2, 9).cast("int")
    live.land_days(lines.withColumn("DATE1", F.when((number + day) % 5 == 0, "no date").otherwise(F.col("DATE1"))), folder)
    return files.land(spark, folder).status


def _run(stream_writer, folder: str) -> None:  # noqa: ANN001
    stream_writer.option("checkpointLocation", f"{folder}/{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()


@registered(query("select symbol_id, monday, week_end_date, " + _r("open high low close") + ", volume, trading_days from weekly where monday < (select date_trunc('week', max(date) - 21) from daily)", ["weekly", "daily"]))
def stream_late_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a stream whose rows of every ninth day come five weeks late: the gate keeps what a watermark would drop, and the repair makes those weeks anew."""
    folder = _folder(spark, "late")
    m = market(spark, sf_dir).daily.select("symbol_id", F.col("date").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    delay = F.when((F.dayofyear("ts") + F.col("symbol_id")) % 9 == 0, 35).otherwise(0)
    arrival = F.date_add(F.to_date("ts"), delay)
    arriving = cut(m.withColumn("half", F.year(arrival) * 2 + (F.month(arrival) > 6).cast("int")))
    for half in sorted(r.half for r in arriving.select("half").distinct().collect()):  # two a year, as they arrive
        arriving.where(F.col("half") == half).drop("half").coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    landed = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    _run(landed.writeStream.foreachBatch(live.late_gate(folder)), folder)
    closed = live.weekly_bars(spark.readStream.schema(m.schema).parquet(f"{folder}/ontime"))
    _run(closed.writeStream.format("parquet").option("path", f"{folder}/weekly").outputMode("append"), folder)
    weekly = spark.read.schema(closed.schema).parquet(f"{folder}/weekly")
    out = live.repair_weeks(weekly, live.dealt(spark, folder, "ontime", m.schema), live.dealt(spark, folder, "late", m.schema))
    return rounded(out)


@registered(query(f"select symbol_id, week_end_date, {_r('atr upper_band lower_band st_value')}, direction, weeks_in_trend, is_flip, {_r('close')} from series", ["series"]))
def stream_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend in batch to 1998 and as a stream after it, begun from the batch's states; symbols divisible by three are new to the stream."""
    folder = _folder(spark, "trend")
    weekly = cut(bars.weekly_bars(market(spark, sf_dir).daily).select("symbol_id", "week_end_date", "high", "low", "close"))
    before = weekly.where("week_end_date < '1999-01-01' and symbol_id % 3 <> 0")
    batch = cut(trend.fold(before))
    after = weekly.join(before.select("symbol_id", "week_end_date"), ["symbol_id", "week_end_date"], "left_anti")
    for years in ("week_end_date < '1999-07-01'", "week_end_date >= '1999-07-01'"):
        after.where(years).coalesce(2).write.mode("append").parquet(f"{folder}/landed")
    stream = live.trend(spark.readStream.schema(weekly.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/landed"), start=batch.select("symbol_id", F.col("state").alias("s")))
    _run(stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder)
    rows = batch.select("symbol_id", F.inline("rows")).unionByName(spark.read.schema(stream.schema).parquet(f"{folder}/out"))
    return rounded(rows.select("symbol_id", "week_end_date", "atr", "upper_band", "lower_band", "st_value", "direction", "weeks_in_trend", "is_flip", "close"))


@registered(
    query(
        f"""with days as (select cast(unnest(generate_series(date '{_NEWEST}' - 10, date '{_NEWEST}', interval 1 day)) as date) as d)
        select d as trade_date, case when d = date '{_HOLIDAY}' or isodow(d) = 6 then 'holiday' else 'ok' end as status, case when d = date '{_HOLIDAY}' then 0 else count(date) end as rows,
        case when d <> date '{_HOLIDAY}' then round(sum(close), 4) end as total_close from days left join daily on date = d where isodow(d) <> 7 group by d""",
        ["daily"],
    ).replace("\nwith days", ",\ndays", 1)
)
def stream_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a day each land for eight weeks; those of the last ten days are gone through, each day once, onto bars that end in April."""
    folder = _folder(spark, "days")
    m = market(spark, sf_dir)
    lines = _day_lines(m.daily.where(f"date between '1998-05-01' and '{_NEWEST}'"))
    live.land_days(lines, f"{folder}/landed")
    stored = m.daily.where("date < '1998-05-01'").select("symbol_id", "date", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), F.lit(None).cast("double").alias("delivery_qty"), F.lit(None).cast("double").alias("delivery_pct"), F.lit("first").alias("source"))
    stored.withColumn("month", F.to_date(F.date_trunc("month", "date"))).repartition("month").write.partitionBy("month").parquet(f"{folder}/bars")
    symbols = m.symbols.select(F.concat(F.lit("S"), F.col("symbol_id").cast("string")).alias("symbol"), F.col("symbol_id").alias("id"))
    aliases = spark.createDataFrame([], "old_symbol string, symbol_id int")
    _run(live.day_files(spark, f"{folder}/landed").writeStream.foreachBatch(live.catch_up(folder, "day", symbols, aliases, ["EQ"])), folder)
    now = spark.read.parquet(f"{folder}/bars").where("date >= '1998-05-01'").groupBy("date").agg(F.sum("close").alias("total_close"))
    log = live.ledger(spark, folder)
    return rounded(log.join(now, log.trade_date == now.date, "left").select("trade_date", "status", "rows", "total_close"), 4)
