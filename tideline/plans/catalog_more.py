"""Registered queries of stores, quality, ingest, universes, read API, figures of runs, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.backtest import metrics as figures
from tideline.backtest import study
from tideline.operators import bars, checks, history, ingest, jobs, scan, trend
from tideline.plans import api
from tideline.plans.catalog import TURNOVER, _r, registered, rounded, scan_config
from tideline.plans.oracle import CTES, query
from tideline.sources import files, store
from tideline.sources.lineage import cut, shared_folder, version, written
from tideline.sources.market import market, table
from tideline.streaming import live

# ------------------------------------------------------------------ quality


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with faults planted by rule, and an order of arrival."""
    d = market(spark, sf_dir).daily
    n = F.datediff("date", F.lit("1995-01-01")) + F.col("symbol_id")
    return d.select(
        F.concat(F.lit("S"), F.col("symbol_id").cast("string")).alias("symbol"),
        "date",
        F.when(n % 97 == 0, -1.0).otherwise(F.col("open")).alias("open"),
        F.when(n % 89 == 0, F.col("high") * 0.5).when(n % 83 == 0, F.col("close")).otherwise(F.col("high")).alias("high"),
        F.when(n % 83 == 0, F.col("close")).otherwise(F.col("low")).alias("low"),
        F.col("close"),
        F.when(n % 79 == 0, -5).when(n % 83 == 0, 0).otherwise(F.col("volume")).alias("volume"),
        n.alias("seq"),
    ).withColumn("open", F.when((F.col("seq") % 83 == 0) & (F.col("open") > 0), F.col("close")).otherwise(F.col("open")))


_DIRTY = """select symbol, date, case when seq % 83 = 0 and open > 0 then close else open end as open, high, low, close, volume, seq from (select 'S' || symbol_id as symbol, date,
  case when n % 97 = 0 then -1.0 else open end as open, case when n % 89 = 0 then high * 0.5 when n % 83 = 0 then close else high end as high, case when n % 83 = 0 then close else low end as low, close,
  case when n % 79 = 0 then -5 when n % 83 = 0 then 0 else volume end as volume, n as seq from (select *, date_diff('day', date '1995-01-01', date) + symbol_id as n from daily))"""


@registered(
    query(
        f"""select issue, count(*) as n from (select case when open <= 0 or high <= 0 or low <= 0 or close <= 0 then 'bad_price' when volume = 0 and open = close and high = close and low = close then 'phantom' else 'ok' end as s, * from ({_DIRTY})) q
        cross join lateral (select unnest(case when s = 'bad_price' then ['bad_price'] when s = 'ok' then list_filter([case when greatest(open, high, low, close) > high * 1.005 or least(open, high, low, close) < low * 0.995 then 'ohlc_inconsistent' end, case when volume < 0 then 'negative_volume' end], lambda x: x is not null) else [] end) as issue) group by 1
        union all select 'phantom_candle', count(distinct date) from ({_DIRTY}) where open > 0 and high > 0 and low > 0 and close > 0 and volume = 0 and open = close and high = close and low = close having count(*) > 0""",
        ["daily"],
    )
)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.issue_counts(checks.validate(_dirty(spark, sf_dir), "seq")[1])


@registered(
    query(
        f"""select symbol, date, {_r('open')}, round(greatest(open, high, low, close), 6) as high, round(least(open, high, low, close), 6) as low, {_r('close')}, case when volume >= 0 then volume end as volume from ({_DIRTY})
        where open > 0 and high > 0 and low > 0 and close > 0 and not (volume = 0 and open = close and high = close and low = close)""",
        ["daily"],
    )
)
def validation_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checks.validate(_dirty(spark, sf_dir), "seq")[0].drop("seq"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).daily.withColumn("symbol", F.concat(F.lit("S"), F.col("symbol_id").cast("string")))


@registered(query("select date from (select date, count(distinct symbol_id) as n from daily group by 1) where n >= (select count(distinct symbol_id) from daily) * 0.5", ["daily"]))
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.trading_calendar(_named(spark, sf_dir))


_CAL = "(select date from (select date, count(distinct symbol_id) as n from daily group by 1) where n >= (select count(distinct symbol_id) from daily) * 0.5)"


@registered(
    query(
        f"""select symbol, min(date) as date, count(*) as missing, array_to_string(list_sort(list(cast(date as varchar)) filter (k <= 20)), ',') as dates from (
        select 'S' || s.symbol_id as symbol, c.date, row_number() over (partition by s.symbol_id order by c.date) as k from (select symbol_id, min(date) as a, max(date) as b from daily group by 1) s join {_CAL} c on c.date between a and b
        where not exists (select 1 from daily d where d.symbol_id = s.symbol_id and d.date = c.date)) group by 1""",
        ["daily"],
    )
)
def gap_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _named(spark, sf_dir)
    return checks.gap_issues(d, checks.trading_calendar(d))


@registered(
    query(
        "select date, coalesce(n, 0) as rows, coalesce(n, 0) >= (select count(*) from symbols) * 0.9 as complete from (select distinct date from bench) left join (select date, count(*) as n from daily group by 1) using (date)",
        ["daily", "bench", "symbols"],
    )
)
def week_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir)
    return checks.week_coverage(m.daily, m.symbols, m.benchmark.select("date").distinct())


# ------------------------------------------------------------------- stores

_O = "select o_orderkey as k, o_custkey as c, o_totalprice as v, o_orderstatus as s from orders"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    new = o.where("k % 3 = 0").select((F.col("k") + F.when(F.col("k") % 2 == 0, 10_000_000).otherwise(0)).alias("k"), "c", F.when(F.col("k") % 5 != 0, F.col("v") * 2).alias("v"), F.lit("N").alias("s"))
    return o, new


_NEW = f"(select k + case when k % 2 = 0 then 10000000 else 0 end as k, c, case when k % 5 <> 0 then v * 2 end as v, 'N' as s from ({_O}) where k % 3 = 0)"


@registered(f"select * from {_NEW} union all select * from ({_O}) o where not exists (select 1 from {_NEW} n where n.k = o.k)")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_orders(spark, sf_dir), ["k"])


@registered(f"with b as (select c as k, k as c, v, s from ({_O}) qualify row_number() over (partition by c order by v desc, k desc) = 1), o as (select * from ({_O}) where k % 3 = 0) select * from b union all select * from o where k not in (select k from b)")
def store_upsert_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with many rows a key, of which the last by an order counts."""
    o, _ = _orders(spark, sf_dir)
    batch = o.select(F.col("c").alias("k"), F.col("k").alias("c"), "v", "s")
    return store.upsert(o.where("k % 3 = 0"), batch, ["k"], order=F.struct("v", "c"))


@registered(f"select * from ({_O}) union all select k, c, case when k % 4 = 0 then null else v end, null from ({_O}) where k % 9 = 0")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, _ = _orders(spark, sf_dir)
    more = o.where("k % 9 = 0").select("k", "c", F.when(F.col("k") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("v")).alias("v"))
    return store.append(o, more)


@registered(f"select * from ({_O}) union all select * from {_NEW} n where not exists (select 1 from ({_O}) o where n.k = o.k)")
def store_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_orders(spark, sf_dir), ["k"], [])


@registered(f"select o.k, o.c, case when n.k is not null then n.v else o.v end as v, o.s from ({_O}) o left join {_NEW} n on n.k = o.k")
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _orders(spark, sf_dir)
    return store.update_from(old, new.select("k", "v"), ["k"])


@registered(f"select * from ({_O}) where s <> 'F' union all select * from {_NEW}")
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _orders(spark, sf_dir)
    return store.replace_where(old, new, F.col("s") == "F")


_TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@registered(" union all ".join(f"select '{t}' as \"table\", count(*) as rows from {t}" for t in _TABLES))
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.row_counts(spark, {t: table(spark, sf_dir, t) for t in _TABLES})


@registered(
    query(
        "select symbol_id, min(week_end_date) as first_changed from (select symbol_id, monday, week_end_date from weekly where (symbol_id % 3 = 0 and extract('month' from monday) = 6) or (symbol_id % 4 = 0 and extract('year' from monday) = 1998)) group by 1",
        ["weekly"],
    )
)
def weekly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = bars.weekly_bars(market(spark, sf_dir).daily)
    touched = (F.col("symbol_id") % 3 == 0) & (F.month("monday") == 6)
    old = new.where(~((F.col("symbol_id") % 4 == 0) & (F.year("monday") == 1998))).withColumn("close", F.when(touched, F.col("close") * 1.01).otherwise(F.col("close")))
    return bars.first_changes(new, old)


# ------------------------------------------------------------------- ingest

_DAY, _PREV = "1998-06-10", "1998-06-09"


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = market(spark, sf_dir)
    stored = m.daily.where(f"not (date = '{_DAY}' and symbol_id % 2 = 0) and not (date > '{_DAY}' and symbol_id % 3 <> 0)")
    feed = m.symbols.select(
        "symbol_id", *(F.lit(v).alias(c) for c, v in (("open", 100.0), ("high", 110.0), ("low", 90.0), ("close", 105.0))), (F.lit(80.0) + F.col("symbol_id")).alias("prev_close"), F.lit(1000.0).alias("volume"), F.lit(500.0).alias("delivery_qty"), F.lit(50.0).alias("delivery_pct")
    )
    return feed, ingest.symbol_state(stored, m.symbols, _DAY)


@registered(
    query(
        f"""select symbol_id, route, coalesce(route = 'append' and follows and abs(ratio - 1) > 0.03, false) as is_action, round(ratio, 6) as ratio, round(105.0 * case when route = 'repair' then ratio else 1 end, 6) as close,
        round(1000.0 / case when route = 'repair' then ratio else 1 end, 6) as volume from (
        select *, case when exists_d then 'delivery' when not has_after then 'append' when follows and ratio between 0.01 and 100 then 'repair' else 'repair_skipped' end as route from (
        select symbol_id, arg_max(close, date) filter (date < date '{_DAY}') / (80.0 + symbol_id) as ratio, coalesce(max(date) filter (date < date '{_DAY}') = date '{_PREV}', false) as follows, bool_or(date = date '{_DAY}') as exists_d, bool_or(date > date '{_DAY}') as has_after
        from daily where not (date = date '{_DAY}' and symbol_id % 2 = 0) and not (date > date '{_DAY}' and symbol_id % 3 <> 0) group by symbol_id))""",
        ["daily"],
    )
)
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.plan_day(*_feed(spark, sf_dir), _PREV).select("symbol_id", "route", "is_action", "ratio", "close", "volume"))


@registered(
    query(
        f"select symbol_id, round(arg_max(close, date) filter (date < date '{_DAY}'), 6) as prev_close_db, max(date) filter (date < date '{_DAY}') as prev_date_db, coalesce(bool_or(date = date '{_DAY}'), false) as exists_d, coalesce(bool_or(date > date '{_DAY}'), false) as has_after, count(date) > 0 as has_any from symbols left join (select * from daily where not (date = date '{_DAY}' and symbol_id % 2 = 0) and not (date > date '{_DAY}' and symbol_id % 3 <> 0)) using (symbol_id) group by 1",
        ["daily", "symbols"],
    )
)
def ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_feed(spark, sf_dir)[1])


@registered(
    "select cast(s as date) as start, date '2001-12-31' as \"end\", string_agg(symbol, ',' order by symbol) as symbols from (select 'C' || c_custkey as symbol, coalesce(cast(max(o_orderdate) as date) + 1, date '1995-01-01') as s from customer left join orders on o_custkey = c_custkey group by c_custkey) where s <= date '2001-12-31' group by 1"
)
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last_date"))
    state = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), "last_date")
    return ingest.plan_downloads(state, "1995-01-01", "2001-12-31")


@registered(
    """with listing as (select 'I' || p_partkey as isin, case when p_partkey % 7 = 0 then 'X' else 'P' end || (p_partkey + case when p_partkey % 11 = 0 then 1 else 0 end) as symbol from part), existing as (select p_partkey as id, 'P' || p_partkey as symbol, 'I' || p_partkey as isin from part)
    select 'rename' as kind, e.id as symbol_id, e.symbol as old_symbol, l.symbol as new_symbol from existing e join listing l using (isin) where e.symbol <> l.symbol
    union all select 'collision', e.id, e.symbol, e.symbol || '#' || e.id from existing e join listing l on l.symbol = e.symbol where l.isin <> e.isin"""
)
def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    text = lambda c: c.cast("string")
    existing = p.select("id", F.concat(F.lit("P"), text(F.col("id"))).alias("symbol"), F.concat(F.lit("I"), text(F.col("id"))).alias("isin"))
    number = F.col("id") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)
    listing = p.select(F.concat(F.lit("I"), text(F.col("id"))).alias("isin"), F.concat(F.when(F.col("id") % 7 == 0, "X").otherwise("P"), text(number)).alias("symbol"))
    return ingest.symbol_changes(listing, existing)


@registered("select cast(s_suppkey as bigint) as symbol_id, string_agg(r_name, '|' order by r_name) as index_list from (select distinct s_suppkey, r_name from supplier join nation on n_nationkey = s_nationkey or n_nationkey = (s_nationkey + 7) % 25 join region on r_regionkey = n_regionkey) group by 1")
def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25)).alias("n"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    members = s.join(nation, F.col("n") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("index_id"), F.col("s_suppkey").alias("symbol_id")).distinct()
    indices = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("category"), F.col("r_name").alias("name"))
    return ingest.index_lists(members, indices)


_RAW = "select symbol_id, date, close * case when date < date '1997-03-12' then 3 when date < date '1998-06-10' then 2 else 1 end as close, date as d from daily"


@registered(
    query(
        f"""with raw as ({_RAW}), fresh as (select symbol_id, date, close * case when symbol_id % 3 = 0 and date < date '1998-06-10' then 1.5 when symbol_id % 5 = 0 and date < date '1997-03-12' then 1.4 else 1 end as close from daily),
        kind as (select symbol_id, case when symbol_id % 2 = 0 then null when symbol_id % 3 = 0 then null when symbol_id % 5 = 0 then date '1998-06-10' else date '1998-06-10' end as until,
          symbol_id % 2 = 1 and symbol_id % 3 <> 0 and symbol_id % 5 <> 0 as first_too from symbols)
        select r.symbol_id, r.date, round(case when r.date < until then f.close else r.close end, 6) as close, case when r.date < until then 'fresh' else 'file' end as source,
          case when r.date < until then 100.0 * 2 * case when first_too and r.date < date '1997-03-12' then 3 else 1 end else 100.0 end as delivery_qty
        from raw r join kind using (symbol_id) join fresh f on f.symbol_id = r.symbol_id and f.date = r.date""",
        ["daily", "symbols"],
    ).replace("\nwith raw", ",\nraw", 1)
)
def job_resolve_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two open actions a symbol, 3:1 and then 2:1; fresh history joins on at both, at the second only, or at none."""
    m = market(spark, sf_dir)
    first, second = F.lit("1997-03-12").cast("date"), F.lit("1998-06-10").cast("date")
    priced = lambda k: {c: F.col(c) * k for c in ("open", "high", "low", "close")}
    base = m.daily.select("symbol_id", "date", "open", "high", "low", "close", "volume", F.lit(100.0).alias("delivery_qty"), F.lit(50.0).alias("delivery_pct"), F.lit("file").alias("source"))
    daily = base.withColumns(priced(F.when(F.col("date") < first, 3.0).when(F.col("date") < second, 2.0).otherwise(1.0)))
    wrong = F.when((F.col("symbol_id") % 3 == 0) & (F.col("date") < second), 1.5).when((F.col("symbol_id") % 5 == 0) & (F.col("date") < first), 1.4).otherwise(1.0)
    odd = m.symbols.where("symbol_id % 2 = 1").select("symbol_id", F.explode(F.array(F.struct(first.alias("ex_date"), F.lit(3.0).alias("ratio")), F.struct(second.alias("ex_date"), F.lit(2.0).alias("ratio")))).alias("a"))
    actions = odd.select("symbol_id", "a.ex_date", "a.ratio", F.lit("open").alias("action_type"), F.lit(False).alias("resolved"))
    return rounded(jobs.resolve_actions(daily, base.withColumns(priced(wrong)), actions)[0].select("symbol_id", "date", "close", "source", "delivery_qty"))


@registered(
    query(
        """with cal as materialized (select distinct date from bench), seq as materialized (select date, row_number() over (order by date) as ix from cal), kept as materialized (select * from daily where (symbol_id + extract('doy' from date)) % 9 > 1),
        spans as (select symbol_id, min(date) as a, max(date) as b from kept group by 1), missing as (select s.symbol_id, c.date from spans s join cal c on c.date between s.a and s.b where not exists (select 1 from kept k where k.symbol_id = s.symbol_id and k.date = c.date)),
        raw as materialized (select symbol_id, date, close * 2 as close, lag(close) over (partition by symbol_id order by date) * 2 as prev_close, lag(date) over (partition by symbol_id order by date) as prev_date from daily),
        fixed as (select m.symbol_id, m.date, q.ix, r.close, r.prev_close, (select k.close from kept k join seq b on b.date = k.date where k.symbol_id = m.symbol_id and b.ix = q.ix - 1) as stored from missing m join raw r on r.symbol_id = m.symbol_id and r.date = m.date join seq q on q.date = m.date where r.prev_close is not null),
        walk as (select symbol_id, date, ix, close, stored / prev_close as scale from fixed where stored is not null
          union all select f.symbol_id, f.date, f.ix, f.close, w.scale * w.close / f.prev_close from walk w join fixed f on f.symbol_id = w.symbol_id and f.ix = w.ix + 1 and f.stored is null)
        select symbol_id, date, round(close * scale, 6) as close from walk where scale between 0.01 and 100""",
        ["daily", "bench"],
    ).replace("\nwith cal", ",\ncal", 1)
)
def job_repair_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions left out by rule, filled from an archive whose prices are twice as high."""
    m = market(spark, sf_dir)
    kept = m.daily.where((F.col("symbol_id") + F.dayofyear("date")) % 9 > 1)
    before = Window.partitionBy("symbol_id").orderBy("date")
    archive = m.daily.select("symbol_id", "date", *((F.col(c) * 2).alias(c) for c in ("open", "high", "low", "close")), "volume", (F.lag("close").over(before) * 2).alias("prev_close")).where("prev_close is not null")
    return rounded(jobs.repair_gaps(kept, m.benchmark.select("date").distinct(), archive).select("symbol_id", "date", "close"))


@registered(
    """with listing as (select 'I' || p_partkey as isin, case when p_partkey % 7 = 0 then 'X' else 'P' end || p_partkey as symbol, 'new ' || p_partkey as name from part where p_partkey % 10 <> 3 union all select 'N' || p_partkey, 'P' || p_partkey, 'other ' || p_partkey from part where p_partkey % 70 = 7 or p_partkey % 10 = 3),
    old as (select p_partkey as id, 'P' || p_partkey as symbol, 'I' || p_partkey as isin, 'old ' || p_partkey as name from part)
    select o.id, coalesce(l.symbol, case when c.symbol is not null then o.symbol || '#' || o.id end, o.symbol) as symbol, o.isin, coalesce(l.name, o.name) as name, l.isin is not null as is_active from old o left join listing l using (isin) left join listing c on c.symbol = o.symbol and c.isin <> o.isin
    union all select (select max(p_partkey) from part) + row_number() over (order by isin), symbol, isin, name, true from listing where isin not in (select isin from old)"""
)
def job_refresh_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing in which some are renamed, some are gone, and some texts have new owners."""
    k, text = F.col("p_partkey"), lambda p: F.concat(F.lit(p), F.col("p_partkey").cast("string"))
    part = table(spark, sf_dir, "part")
    symbols = part.select(k.alias("id"), text("P").alias("symbol"), text("I").alias("isin"), text("old ").alias("name"), F.lit(True).alias("is_active"))
    listed = part.where("p_partkey % 10 <> 3").select(text("I").alias("isin"), F.when(k % 7 == 0, text("X")).otherwise(text("P")).alias("symbol"), text("new ").alias("name"))
    others = part.where("p_partkey % 70 = 7 or p_partkey % 10 = 3").select(text("N").alias("isin"), text("P").alias("symbol"), text("other ").alias("name"))
    aliases = spark.createDataFrame([], "old_symbol string, symbol_id long, changed_on date")
    return jobs.refresh_symbols(symbols, aliases, listed.unionByName(others), "2002-01-01")[0]


# ---------------------------------------------------------------- universes


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with renamed, reused and unlinked tickers, made from lines."""
    t = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("value"))
    late = F.col("date") >= F.lit("1999-01-01")
    return t.select(
        "date", F.concat(F.lit("T"), (F.col("s") + F.when(late & (F.col("s") % 4 == 0), 1000).otherwise(0)).cast("string")).alias("symbol"),
        F.when(F.col("s") % 5 != 0, F.concat(F.lit("INE"), F.lpad(F.floor(F.col("s") / 2).cast("string"), 9, "0"))).alias("isin"), "value",
    )


_HIST = "(select cast(l_shipdate as date) as date, 'T' || (l_suppkey + case when l_shipdate >= timestamp '1999-01-01' and l_suppkey % 4 = 0 then 1000 else 0 end) as symbol, case when l_suppkey % 5 <> 0 then 'INE' || lpad(cast(l_suppkey // 2 as varchar), 9, '0') end as isin, l_quantity as value from lineitem)"


@registered(
    f"""with recursive h as materialized (select distinct symbol, isin from {_HIST}), edges as materialized (select distinct a.symbol as a, b.symbol as b from h a join h b on a.isin = b.isin),
    reach as (select symbol as a, symbol as b from h union select r.a, e.b from reach r join edges e on e.a = r.b) select a as symbol, min(b) as root from reach group by 1"""
)
def linked_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.linked_symbols(_history(spark, sf_dir))


@registered(
    query(
        """select symbol_id, date, round(open * m, 6) as open, round(close * m, 6) as close, round(volume / m, 6) as volume from (select *, coalesce(product(f) over (partition by symbol_id order by date rows between 1 following and unbounded following), 1.0) as m from (
        select *, case when date in (select date from events_at e where e.symbol_id = x.symbol_id) and abs(ln(gap / 0.5)) < abs(ln(gap)) then 0.5 else 1.0 end as f from (
        select *, open / lag(close) over (partition by symbol_id order by date) as gap from (select symbol_id, date, case when date >= date '1998-01-01' and symbol_id % 2 = 0 then open / 2 else open end as open, case when date >= date '1998-01-01' and symbol_id % 2 = 0 then close / 2 else close end as close, cast(volume as double) as volume from daily)) x))""",
        ["daily"],
    ).replace("\nselect symbol_id, date, round(open", ", events_at as (select symbol_id, min(date) as date from daily where date >= date '1998-01-01' and date <= date '1998-01-31' group by 1)\nselect symbol_id, date, round(open", 1)
)
def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = market(spark, sf_dir).daily
    halved = (F.col("date") >= "1998-01-01") & (F.col("symbol_id") % 2 == 0)
    raw = d.select(F.col("symbol_id").alias("entity"), "date", *(F.when(halved, F.col(c) / 2).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("double").alias("volume"))
    first = raw.where("date >= '1998-01-01' and date <= '1998-01-31'").groupBy("entity").agg(F.min("date").alias("date")).withColumn("factor", F.lit(0.5))
    return rounded(history.adjust(raw, first)[0].select(F.col("entity").alias("symbol_id"), "date", "open", "close", "volume"))


@registered(
    f"""with h as materialized (select * from {_HIST}), s as (select distinct date from h), plan as (select max(s.date) filter (s.date <= eff) as snapshot_date, ws, we, count(*) filter (s.date between ws and we) as n, min(s.date) as f, max(s.date) as l
      from (select last_day(make_date(y, e, 1)) as eff, last_day(make_date(y, w, 1)) as we, cast(last_day(make_date(y, w, 1)) - interval 6 month as date) + 1 as ws from range(1995, 2002) t(y), (values (3, 1), (9, 7)) v(e, w)) cross join s group by eff, ws, we)
    select snapshot_date, symbol as entity from (select snapshot_date, symbol, count(distinct date) as days, sum(value) / n as v, n from h join plan on date between ws and we where isin like 'INE%' and ws >= f and snapshot_date > we group by snapshot_date, symbol, n)
    where days >= n * 10 / 100.0 qualify row_number() over (partition by snapshot_date order by v desc, symbol) <= 5"""
)
def universe_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.snapshots(_history(spark, sf_dir).withColumnRenamed("symbol", "entity"), 5, 10.0)


@registered(
    query(
        "select symbol_id, date from daily d where exists (select 1 from (select distinct date_trunc('quarter', date) as q from daily) x where x.q <= d.date and (symbol_id + extract('quarter' from (select max(q) from (select distinct date_trunc('quarter', date) as q from daily) y where y.q <= d.date))) % 2 = 0)",
        ["daily"],
    )
)
def members_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = market(spark, sf_dir).daily.select("symbol_id", "date")
    quarters = d.select(F.to_date(F.date_trunc("quarter", "date")).alias("snapshot_date")).distinct()
    members = quarters.join(F.broadcast(d.select("symbol_id").distinct())).where((F.col("symbol_id") + F.quarter("snapshot_date")) % 2 == 0)
    return history.member_of(d, members).select("symbol_id", "date")


#: Subjects of announcements and what prices before them are multiplied by.
SUBJECTS = [
    ("Bonus 1:1", 0.5), ("Bonus 3:2", 0.4), ("BONUS ISSUE 1 : 2", 2 / 3), ("Bonus - 2:5", 5 / 7), ("Bonus Issue - 1:4 and dividend", 0.8), ("Bonus 0:1", None),
    ("Bonus declared, record date 12:30", None), ("Bonus of 1:1", None), ("Bonus debenture 1:1", None), ("Preference shares bonus 1:1", None), ("Ncrps bonus 4:1", None),
    ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share", 0.1), ("Stock Split From Rs.10/- To Rs.2/-", 0.2), ("Fv Splt Frm Rs 5 To Re 1", 0.2),
    ("Sub Division of shares of Rs 100 each into shares of Rs 10", None), ("Sub- Division From Rs 2.50 To Re 1", 0.4), ("Consolidation From Re 1 To Rs 10", 10.0),
    ("Consolidation of shares, book closure from 5 March to 9 March", None), ("Share split, record date 12 to be told, ratio 3", None), ("Split from 10 to 2", None),
    ("Split from Rs 10 to 2", None), ("Split from 10 to Rs 2", None), ("Split Rs 10 to be told to Rs 5", 0.5), ("From Rs 10 To Rs 5 split", None),
    ("Bonus 1:1 / Stock Split From Rs 10 To Rs 5", 0.25), ("Split Rs 10 To Rs 5 And Bonus 1:1", 0.25), ("Dividend - Rs 4 Per Share", None), ("Rights 1:5 @ Premium Rs 10", None),
    ("Annual General Meeting", None), ("Split From Rs 10 To Rs 10", None), ("Bonus\t1:3", 0.75), ("", None),
]


@registered("select c_custkey as id, round(factor, 6) as factor from customer join (values " + ", ".join(f"({i}, {'null' if f is None else f}::double)" for i, (_, f) in enumerate(SUBJECTS)) + f") v(k, factor) on k = c_custkey % {len(SUBJECTS)}")
def price_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of announcements; the SQL has them as literal values, not by a rule."""
    text = F.get(F.lit([t for t, _ in SUBJECTS]), (F.col("c_custkey") % len(SUBJECTS)).cast("int"))
    # keys alone take a byte or two each, so that a file of millions is a single task
    dealt = table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")
    return rounded(dealt.select(F.col("c_custkey").alias("id"), files.price_factor(text).alias("factor")))


# ----------------------------------------------------------------- read API

_PUBLISHED: dict[tuple, str] = {}


def published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the published snapshots of all weeks, a partition each; the scan is run and published once for a session and the files it is made of."""
    key = (spark.sparkContext.applicationId, sf_dir, *(version(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")))
    if key not in _PUBLISHED:
        root = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
        done = scan.scan(market(spark, sf_dir), scan_config())
        for part, frame in (("stocks", done.stocks), ("sectors", done.sectors), ("history", done.history)):
            store.write_slices(frame.repartition("week_end_date"), f"{root}/{part}", ["week_end_date"])
        _PUBLISHED[key] = root
    return spark.read.parquet(f"{_PUBLISHED[key]}/{name}")


def _stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir, "stocks")


@registered(
    query("select symbol_id, week_end_date, round_even(stock_score * 100, 0) / 100 as stock_score from scored where direction = 'Bullish' and weeks_in_trend <= 6 and pct_from_high <= 5 and price > sma50 and industry in ('Sector 1', 'Sector 2')", ["scored"], turnover=TURNOVER)
)
def api_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = api.FilterSpec.from_params({"preset": "nearhigh", "fresh": "6", "above": "50", "sector": "Sector 1, Sector 2"})
    return _stocks(spark, sf_dir).where(spec.condition()).select("symbol_id", "week_end_date", "stock_score")


@registered(query("select week_end_date, count(*) filter (direction = 'Bullish') as bullish, count(*) filter (direction = 'Bearish') as bearish, count(*) filter (direction = 'Bullish' and is_new_flip) as new_bullish, count(*) filter (direction = 'Bearish' and is_new_flip) as new_bearish from base group by 1", ["base"]))
def api_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.trend_counts(_stocks(spark, sf_dir))


@registered(query("select industry, week_end_date, round(rs_ratio, 5) as rs_ratio, round(rs_momentum, 5) as rs_momentum, cast(row_number() over (partition by industry order by week_end_date) as integer) as place from sector_panel where week_end_date <= date '2000-06-30' and week_end_date > date '2000-06-30' - 35 and rs_ratio is not null and rs_momentum is not null", ["sector_panel"]))
def api_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(api.sector_tails(published(spark, sf_dir, "history"), "2000-06-30"), 5)


@registered(
    query(
        """select week_end_date, symbol_id, change, case when change = 'exit' then why end as why, round_even(stock_score * 100, 0) / 100 as stock_score from (select *, unnest(list_filter([
          case when ok and not old then 'entry' when old and not ok then 'exit' end, case when is_new_flip then case when direction = 'Bullish' then 'bull_flip' else 'bear_flip' end end], lambda x: x is not null)) as change,
          case when direction = 'Bearish' then 'Turned bearish' when not coalesce(sector_tradeable, false) then 'Sector dropped out' else 'Failed: ' || coalesce(nullif(concat_ws(', ', case when not f_trend_template then 'trend template' end, case when not f_52w_range then '52W range' end,
            case when not f_rs then 'RS rating' end, case when not f_liquidity then 'liquidity' end, case when not f_price then 'price' end, case when not f_not_asm then 'ASM/GSM' end), ''), 'filters') end as why
        from (select n.*, n.direction = 'Bullish' and n.f_liquidity and n.f_price as ok, coalesce(o.direction = 'Bullish' and o.f_liquidity and o.f_price, false) as old from scored n
          join (select week_end_date, lag(week_end_date) over (order by week_end_date) as before from (select distinct week_end_date from scored)) w on w.week_end_date = n.week_end_date
          left join scored o on o.symbol_id = n.symbol_id and o.week_end_date = w.before))""",
        ["scored"], turnover=TURNOVER,
    )
)
def api_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of weeks, with fewer filters for ``qualified``, as hardly a stock of the test market passes all."""
    stocks = _stocks(spark, sf_dir).withColumn("qualified", F.col("f_trend") & F.col("f_liquidity") & F.col("f_price"))
    return api.run_diff(stocks).select("week_end_date", "symbol_id", "change", "why", "stock_score")


def _shown(header: str, column: str) -> str:
    if column in files.EXPORT_WHOLE:
        return f'cast(round_even({column}, 0) as bigint) as "{header}"'
    if column == "qualified":
        return f"case when qualified then 'Yes' else 'No' end as \"{header}\""
    if column == "flip_date":
        return f'cast(flip_date as varchar) as "{header}"'
    text = {"symbol", "direction", "industry", "grade", "reasons"}
    if column in text:
        return f'{column} as "{header}"'
    if column == "index_list":
        return f'cast(null as varchar) as "{header}"'
    value = "price * (symbol_id * 100000) / 1e7" if column == "market_cap_cr" else column
    return f'round_even({value} * 100, 0) / 100 as "{header}"'


@registered(
    query(f"select {', '.join(_shown(h, x) for h, x in (files.EXPORT | files.EXPORT_MORE).items())} from planned where week_end_date = (select max(week_end_date) from planned)", ["planned"], turnover=TURNOVER)
)
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest week's export, all its columns."""
    stocks = _stocks(spark, sf_dir)
    newest = stocks.agg(F.max("week_end_date").alias("_w"))
    return files.export_rows(stocks.join(F.broadcast(newest), F.col("week_end_date") == F.col("_w")), extended=True)


_PLAN = "score_freshness score_risk penalty stop_price risk_pct position_value"


@registered(query(f"select symbol_id, week_end_date, grade, {_r(_PLAN, 4)}, cast(position_qty as bigint) as position_qty from planned", ["planned"], turnover=TURNOVER))
def stock_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, penalty and trade plan of every stock and week."""
    return rounded(_stocks(spark, sf_dir).select("symbol_id", "week_end_date", "grade", *_PLAN.split(), F.col("position_qty").cast("long").alias("position_qty")), 4)


@registered(query("select symbol_id, week_end_date, reasons from planned", ["planned"], turnover=TURNOVER))
def stock_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stocks(spark, sf_dir).select("symbol_id", "week_end_date", "reasons")


_ENTRY = f"(direction = 'Bullish' and weeks_in_trend <= {api.RULE['max_weeks']} and shown >= {api.RULE['min_score']} and f_liquidity and f_price and f_not_asm)"
_RULE_ROWS = f"rule_rows as (select *, {_ENTRY} as entry, direction <> 'Bullish' or shown < {api.RULE['exit_score']} as leave, dense_rank() over (order by week_end_date) as ix from (select *, round_even(stock_score * 100, 0) / 100 as shown from scored))"


def _with(sql: str, more: str) -> str:
    """A further expression before the final select of a statement."""
    head, tail = sql.rsplit("\nselect", 1)
    return f"{head},\n{more}\nselect{tail}"


@registered(
    _with(
        query("select symbol_id, symbol, industry, signal_week, round(signal_price, 5) as signal_price, entry_score, round(price, 5) as price, score, grade, round(stop, 5) as stop, weeks, state, exit_reason, round((price / signal_price - 1) * 100, 5) as change_pct, round((price / stop - 1) * 100, 5) as stop_dist_pct from states", ["scored"], turnover=TURNOVER),
        f"""{_RULE_ROWS}, firsts as (
          select * from rule_rows where entry qualify row_number() over (partition by symbol_id order by ix - weeks_in_trend desc, ix) = 1
        ), walked as (
          select r.symbol_id, r.ix, r.direction, r.shown, r.ix - coalesce(lag(r.ix) over (partition by r.symbol_id order by r.ix), f.ix) as gap from rule_rows r join firsts f on f.symbol_id = r.symbol_id and r.ix > f.ix
        ), ends as (
          select symbol_id, case when gap > 1 then ix - gap + 1 else ix end as end_ix, case when gap > 1 then 'stale' when direction <> 'Bullish' then 'trend' when shown < {api.RULE['exit_score']} then 'score' end as why from walked
        ), ended as (
          select symbol_id, min(end_ix) as end_ix, arg_min(why, end_ix) as why from ends where why is not null group by 1
        ), states as (
          select f.symbol_id, f.symbol, f.industry, f.week_end_date as signal_week, f.price as signal_price, f.shown as entry_score, n.price, n.shown as score, case when n.direction = 'Bullish' then case when n.shown >= 80 then 'A+' when n.shown >= 70 then 'A' when n.shown >= 60 then 'B' else 'Watch' end end as grade, n.st_value as stop,
            n.ix - f.ix as weeks, case when f.ix = n.ix then 'buy' when e.end_ix is null then 'open' when e.end_ix = n.ix then 'exit' else 'closed' end as state, case when e.end_ix <= n.ix then e.why end as exit_reason
          from firsts f join rule_rows n on n.symbol_id = f.symbol_id and n.ix = (select max(ix) from rule_rows) left join ended e on e.symbol_id = f.symbol_id)""",
    )
)
def api_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(api.signals(_stocks(spark, sf_dir)), 5)


@registered(
    _with(
        query("select symbol_id, week_end_date, label from walk", ["scored"], turnover=TURNOVER),
        f"""{_RULE_ROWS}, steps as (select symbol_id, week_end_date, coalesce(entry, false) as entry, coalesce(leave, false) as leave, row_number() over (partition by symbol_id order by week_end_date) as n from rule_rows),
        walk as (select symbol_id, week_end_date, n, case when entry then 'buy' end as label, entry as held from steps where n = 1
          union all select s.symbol_id, s.week_end_date, s.n, case when w.held and s.leave then 'sell' when w.held then 'hold' when s.entry then 'buy' end, (w.held and not s.leave) or (not w.held and s.entry) from walk w join steps s on s.symbol_id = w.symbol_id and s.n = w.n + 1)""",
    )
)
def api_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.states(_stocks(spark, sf_dir))


@registered(query("select symbol_id, week_end_date, round_even(stock_score * 100, 0) / 100 as stock_score from scored where week_end_date = date '1999-06-04' order by direction desc, round_even(stock_score * 100, 0) / 100 desc nulls last, symbol limit 7 offset 7", ["scored"], turnover=TURNOVER))
def api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a week in its usual order."""
    return api.scanner(_stocks(spark, sf_dir), "1999-06-04", {"page": "2", "size": "7"}).select("symbol_id", "week_end_date", "stock_score")


@registered(query("select symbol_id, round(pct_from_high, 5) as pct_from_high from scored where week_end_date = date '1999-06-04' and symbol like '%2%' order by pct_from_high desc nulls last, symbol limit 5", ["scored"], turnover=TURNOVER))
def api_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in a week, sorted by a column."""
    return rounded(api.scanner(_stocks(spark, sf_dir), "1999-06-04", {"q": "2", "sort": "pct_from_high", "desc": "1", "size": "5"}).select("symbol_id", "pct_from_high"), 5)


@registered(
    query(
        """select 'sector' as part, week_end_date, industry as name, cast(sector_rank as integer) as place from sectors where sector_rank <= 2
        union all select 'stock', week_end_date, symbol, cast(k as integer) from (select week_end_date, symbol, row_number() over (partition by week_end_date order by qualified desc, stock_score desc, symbol) as k from planned where direction = 'Bullish' and grade in ('A+', 'A')) where k <= 3""",
        ["planned"], turnover=TURNOVER,
    )
)
def api_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every week's best sectors and best graded stocks."""
    sectors = api.top_sectors(published(spark, sf_dir, "sectors"), 2).select(F.lit("sector").alias("part"), "week_end_date", F.col("industry").alias("name"), F.col("sector_rank").cast("int").alias("place"))
    stocks = api.top_stocks(_stocks(spark, sf_dir), 3).select(F.lit("stock").alias("part"), "week_end_date", F.col("symbol").alias("name"), F.col("place").cast("int").alias("place"))
    return sectors.unionByName(stocks)


@registered(query("select week_end_date, round(index_value, 5) as index_value, round(bench_value, 5) as bench_value, round(st_breadth, 5) as st_breadth from sector_panel where industry = 'Sector 1' and index_value is not null and week_end_date <= date '2000-06-30' order by week_end_date desc limit 156", ["sector_panel"]))
def api_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(api.sector_detail(published(spark, sf_dir, "history"), "Sector 1", "2000-06-30"), 5)


@registered(query("select distinct 'sector' as kind, industry as value from scored", ["scored"], turnover=TURNOVER))
def api_filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.filter_options(_stocks(spark, sf_dir))


@registered(
    query(
        """select symbol_id, round(price, 5) as price, round(st_value, 5) as stop, round_even(stock_score * 100, 0) / 100 as stock_score, not coalesce(direction = 'Bullish', false) or coalesce(round_even(stock_score * 100, 0) / 100 < 40, false) as sell, round((price / 50 - 1) * 100, 5) as change_pct
        from (select symbol_id from symbols where symbol_id % 2 = 1) h left join (select * from scored where week_end_date = date '1999-06-04') s using (symbol_id)""",
        ["scored", "symbols"], turnover=TURNOVER,
    )
)
def api_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings in every second symbol against a week's rows."""
    held = market(spark, sf_dir).symbols.where("symbol_id % 2 = 1").select(
        "symbol_id", "symbol", "industry", F.lit("1999-01-04").cast("date").alias("entry_date"), F.lit(50.0).alias("entry_price"), F.lit(10).alias("qty"), F.lit("end").alias("exit_reason")
    )
    week = _stocks(spark, sf_dir).where("week_end_date = date '1999-06-04'")
    return rounded(api.portfolio(held, week, 40.0).select("symbol_id", "price", "stop", "stock_score", "sell", "change_pct"), 5)


@registered(query("select * from (select symbol_id, date, round(close, 6) as close, " + ", ".join(f"round(case when count(close) over (order by date rows {n - 1} preceding) >= {n} then avg(close) over (order by date rows {n - 1} preceding) end, 6) as sma{n}" for n in (50, 100, 150, 200)) + " from daily where symbol_id = 23) order by date desc limit 520", ["daily"]))
def api_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(api.stock_detail(market(spark, sf_dir).daily, 23))


@registered(query(f"select w.week_end_date, {_r('open high low').replace('round(', 'round(w.')}, round(w.close, 6) as close, w.volume, round(s.st_value, 6) as st_value, s.direction from weekly w left join series s on s.symbol_id = w.symbol_id and s.week_end_date = w.week_end_date where w.symbol_id = 23 and w.week_end_date <= date '2000-06-30'", ["weekly", "series"]))
def api_stock_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars and trend of one symbol up to a date."""
    weekly = bars.weekly_bars(market(spark, sf_dir).daily.where("symbol_id = 23"))
    return rounded(api.stock_weeks(weekly, trend.trend(weekly), 23, "2000-06-30"))


@registered(
    _with(
        query("select w.week_end_date, r.direction, r.shown as stock_score, r.qualified, cast(r.sector_rank as integer) as sector_rank, w.label from walk w join rule_rows r on r.symbol_id = 23 and r.week_end_date = w.week_end_date order by 1 desc limit 52", ["scored"], turnover=TURNOVER),
        f"""{_RULE_ROWS}, walked as materialized (select * from rule_rows where symbol_id = 23 and week_end_date <= date '2000-06-30' order by week_end_date desc limit 156), steps as (select week_end_date, coalesce(entry, false) as entry, coalesce(leave, false) as leave, row_number() over (order by week_end_date) as n from walked),
        walk as (select week_end_date, n, case when entry then 'buy' end as label, entry as held from steps where n = 1
          union all select s.week_end_date, s.n, case when w.held and s.leave then 'sell' when w.held then 'hold' when s.entry then 'buy' end, (w.held and not s.leave) or (not w.held and s.entry) from walk w join steps s on s.n = w.n + 1)""",
    )
)
def api_stock_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of one symbol's scans up to a date, with the state of the entry rule in each week."""
    rows = api.stock_history(_stocks(spark, sf_dir), 23, "2000-06-30")
    return rows.select("week_end_date", "direction", "stock_score", "qualified", F.col("sector_rank").cast("int").alias("sector_rank"), "label")


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run for every customer, in sweeps and experiments or by the entry rule, and a trade for every order."""
    k, when = F.col("c_custkey"), F.when
    params = F.struct(
        when(k % 7 == 3, 1).otherwise(2).alias("entry_max_weeks_in_trend"), F.lit(70.0).alias("min_score"), F.lit(0).alias("top_n_sectors"), F.lit(False).alias("sector_exit"), F.lit("tradeable").alias("entry_filters"), when(k % 2 == 0, "e").alias("experiment"),
        (k % 30).alias("max_positions"), F.lit("fixed").alias("sizing"), (k * 1000).alias("position_size"), (k % 60).alias("exit_score_below"), (k % 4 == 1).alias("add_capital"),
    )
    runs = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), when(k % 5 == 0, F.col("c_nationkey")).alias("sweep_id"), F.to_json(params).alias("params"), F.lit("1999-06-04").cast("date").alias("end_date"))
    o = F.col("o_orderkey")
    trades = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("run_id"), ((o % 5 + 1) * 10 + F.floor(o / 5) % 5 + 1).cast("int").alias("symbol_id"), F.lit("A").alias("symbol"), F.lit("B").alias("industry"), F.to_date("o_orderdate").alias("entry_date"),
        (o % 50 + 50).cast("double").alias("entry_price"), (o % 90).cast("double").alias("qty"), when(F.col("o_orderstatus") == "F", "stop").otherwise("end").alias("exit_reason"),
    )
    return runs, trades


_MODEL_SQL = "(select * from (select c_custkey as k, c_custkey % 5 = 0 as swept from customer) where not swept order by k desc limit 150)"
_MODEL_RUN = f"(select k from {_MODEL_SQL} where k % 7 = 3 and k % 2 = 1 order by k desc limit 1)"
_MODEL_RUN_OF_ALL = "(select max(c_custkey) as k from customer where c_custkey % 5 <> 0 and c_custkey % 7 = 3 and c_custkey % 2 = 1)"


@registered(f"select k as id, date '1999-06-04' as end_week, false as stale, cast(nullif(k % 30, 0) as integer) as k, cast(k * 1000 as double) as position_size, cast(null as double) as position_pct, k % 4 = 1 as add_capital, cast(k % 60 as double) as exit_score from {_MODEL_RUN}")
def api_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that the model portfolio is of."""
    return api.model_run(_model(spark, sf_dir)[0], "1999-06-04")


@registered(
    query(
        f"""select run_id, t.symbol_id, entry_date, entry_price, qty, s.shown as score, round(s.price, 5) as price, round(s.st_value, 5) as stop, not coalesce(s.direction = 'Bullish', false) or coalesce(run_id % 60 > 0 and s.shown < run_id % 60, false) as sell, round((s.price / entry_price - 1) * 100, 5) as change_pct, round((s.price / s.st_value - 1) * 100, 5) as stop_dist_pct
        from (select o_custkey as run_id, cast((o_orderkey % 5 + 1) * 10 + (o_orderkey // 5) % 5 + 1 as integer) as symbol_id, cast(o_orderdate as date) as entry_date, cast(o_orderkey % 50 + 50 as double) as entry_price, cast(o_orderkey % 90 as double) as qty from orders where o_orderstatus <> 'F' and o_custkey = (select k from {_MODEL_RUN_OF_ALL})) t
        left join (select *, round_even(stock_score * 100, 0) / 100 as shown from scored where week_end_date = date '1999-06-04') s on s.symbol_id = t.symbol_id""",
        ["scored"], turnover=TURNOVER,
    )
)
def api_model_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model portfolio still holds, against the week in which its run ends."""
    runs, trades = _model(spark, sf_dir)
    week = _stocks(spark, sf_dir).where("week_end_date = date '1999-06-04'")
    return rounded(api.model_holdings(api.model_run(runs, "1999-06-04"), trades, week).drop("symbol", "industry"), 5)


@registered(
    _with(
        query("select symbol_id, week_end_date, rs_rating, f_not_asm, index_list from rated", ["base", "daily"], turnover=TURNOVER),
        """months as materialized (select min(date) as d, extract('month' from min(date)) as m from daily group by date_trunc('month', date)), quarters as materialized (select min(date) as d, extract('quarter' from min(date)) as q from daily group by date_trunc('quarter', date)),
        at_week as materialized (select w.week_end_date, (select arg_max(m, d) from months where d <= w.week_end_date + 7) as m, (select arg_max(q, d) from quarters where d <= w.week_end_date) as q from (select distinct week_end_date from base) w),
        chosen as materialized (select b.*, b.symbol_id % 4 <> m % 4 as f_not_asm, case when b.symbol_id % 2 = 0 then 'All|Even' else 'All' end as index_list from base b join at_week using (week_end_date) where b.symbol_id % 6 <> 0 and (b.symbol_id + q) % 3 <> 0),
        rated_base as materialized ("""
        + CTES["rs_base"][1].replace("from base", "from chosen")
        + "), rated as ("
        + CTES["rs"][1].replace("from rs_base", "from rated_base")
        + ")",
    )
)
def scan_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of active symbols only, each week of that quarter's members, with monthly exclusions and index names of which one is left out."""
    m = market(spark, sf_dir)
    ids = m.symbols.select("symbol_id", (F.col("symbol_id") % 6 != 0).alias("is_active"))
    daily = cut(m.daily.select("symbol_id", "date"))

    def every(unit: str, kept: Column) -> DataFrame:
        """Symbols that traded in a month or quarter, with its first session."""
        cells = daily.withColumn("cell", F.date_trunc(unit, "date"))
        return cells.select("symbol_id", "cell").distinct().join(cells.groupBy("cell").agg(F.min("date").alias("d")), "cell").where(kept)

    members = every("quarter", (F.col("symbol_id") + F.quarter("d")) % 3 != 0).select(F.col("d").alias("snapshot_date"), "symbol_id")
    listed = every("month", F.col("symbol_id") % 4 == F.month("d") % 4).select(F.col("d").alias("as_of_date"), "symbol_id")
    indices = spark.createDataFrame([(1, "All", "broad"), (2, "Even", "sectoral"), (3, "Hidden", "broad")], "id int, name string, category string")
    named = m.symbols.select("symbol_id", F.explode(F.when(F.col("symbol_id") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(3)))).alias("index_id"))
    done = scan.scan(scan.active_only(m, ids), scan_config(), members=members, exclusions=listed, index_lists=ingest.index_lists(named, indices, ("Hidden",)))
    return done.stocks.select("symbol_id", "week_end_date", "rs_rating", "f_not_asm", "index_list")


@registered(query("select symbol_id, date, round(close / first_value(close) over (partition by symbol_id order by date) * 100, 6) as close_rebased from daily", ["daily"]))
def api_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(api.rebased(market(spark, sf_dir).daily, "symbol_id", "date", "close").select("symbol_id", "date", "close_rebased"))


# ---------------------------------------------------------------- backtests


_CURVE = "(select symbol_id as run_id, date, close as nav from daily)"


@registered(
    query(
        f"""select run_id, round((b / a - 1) * 100, 5) as total_return_pct, round((power(b / a, 1 / greatest(years, 1e-9)) - 1) * 100, 5) as cagr_pct, round(fall * 100, 5) as max_drawdown_pct, round(case when s > 0 then m / s * sqrt(52) end, 5) as sharpe, round(s * sqrt(52) * 100, 5) as volatility_pct, round(greatest(years, 1e-9), 5) as years, round(case when fall < 0 then (power(b / a, 1 / greatest(years, 1e-9)) - 1) / -fall end, 5) as mar
        from (select run_id, arg_min(nav, date) as a, arg_max(nav, date) as b, date_diff('day', min(date), max(date)) / 365.25 as years, avg(step) as m, stddev_pop(step) as s, min(fall) as fall from (select *, nav / lag(nav) over (partition by run_id order by date) - 1 as step, nav / max(nav) over (partition by run_id order by date) - 1 as fall from {_CURVE}) group by 1)""",
        ["daily"],
    )
)
def curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = market(spark, sf_dir).daily.select(F.col("symbol_id").alias("run_id"), "date", F.col("close").alias("nav"))
    return rounded(figures.curves(d), 5)


@registered(query(f"select run_id, cast(year as integer) as year, round((b / coalesce(lag(b) over (partition by run_id order by year), a) - 1) * 100, 5) as return_pct from (select run_id, extract('year' from date) as year, arg_max(nav, date) as b, arg_min(nav, date) as a from {_CURVE} group by 1, 2)", ["daily"]))
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = market(spark, sf_dir).daily.select(F.col("symbol_id").alias("run_id"), "date", F.col("close").alias("nav"))
    return rounded(figures.yearly(d), 5)


_TRADES = "(select c_mktsegment as run_id, o_totalprice - 150000 as pnl, (o_totalprice - 150000) / 1500 as pnl_pct, o_orderkey % 30 as weeks_held, o_orderstatus as exit_reason from orders join customer on c_custkey = o_custkey)"


def _order_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    pnl = F.col("o_totalprice") - 150_000
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.select(F.col("c_mktsegment").alias("run_id"), pnl.alias("pnl"), (pnl / 1500).alias("pnl_pct"), (F.col("o_orderkey") % 30).alias("weeks_held"), F.col("o_orderstatus").alias("exit_reason"))


@registered(
    f"""select run_id, count(*) as trades, round(avg(case when pnl > 0 then 1.0 else 0.0 end) * 100, 4) as win_rate_pct, round(coalesce(avg(pnl_pct) filter (pnl > 0), 0), 4) as avg_win_pct, round(coalesce(avg(pnl_pct) filter (pnl <= 0), 0), 4) as avg_loss_pct,
    round(case when sum(pnl) filter (pnl <= 0) < 0 then sum(case when pnl > 0 then pnl else 0 end) / -(sum(pnl) filter (pnl <= 0)) end, 4) as profit_factor, round(avg(pnl_pct), 4) as expectancy_pct, round(avg(pnl), 4) as expectancy_inr, round(avg(weeks_held), 4) as avg_weeks_held from {_TRADES} group by 1"""
)
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(figures.trade_stats(_order_trades(spark, sf_dir)), 4)


@registered(f"select run_id, exit_reason, count(*) as trades, round(avg(pnl), 4) as avg_pnl, round(avg(pnl_pct), 4) as avg_pnl_pct from {_TRADES} group by 1, 2")
def exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(figures.exit_reasons(_order_trades(spark, sf_dir)), 4)


_MC = "(select c_custkey as seed, c_acctbal / 100 as cagr, -(c_custkey % 40) as max_dd, c_acctbal / 5000 as sharpe, c_custkey % 17 - 8 as worst_year, c_custkey % 90 as trades from customer)"


@registered(
    "select figure, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 2) as p{q}" for q in study.PERCENTILES) + f", round(avg(v), 2) as mean from (unpivot (select cast(cagr as double) as cagr, cast(max_dd as double) as max_dd, cast(sharpe as double) as sharpe, cast(worst_year as double) as worst_year, cast(trades as double) as trades from {_MC}) on cagr, max_dd, sharpe, worst_year, trades into name figure value v) group by 1"
)
def monte_carlo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("seed"), (F.col("c_acctbal") / 100).alias("cagr"), (-(k % 40)).cast("double").alias("max_dd"), (F.col("c_acctbal") / 5000).alias("sharpe"), (k % 17 - 8).cast("double").alias("worst_year"), (k % 90).cast("double").alias("trades")
    )
    return study.summarize(rows)


# ------------------------------------------------------------------ streams


@registered(query("select symbol_id, monday, week_end_date, " + _r("open high low close") + ", volume, trading_days from weekly where monday < (select date_trunc('week', max(date) - 21) from daily)", ["weekly", "daily"]))
def stream_weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a stream over the daily rows; weeks the watermark has not passed are not out yet."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    m = market(spark, sf_dir).daily.select("symbol_id", F.col("date").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    m.write.parquet(f"{folder}/in")
    stream = live.weekly_bars(spark.readStream.schema(m.schema).parquet(f"{folder}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(f"{folder}/out"))


# --------------------------------------------------------------------- jobs


@registered(query("select symbol_id, monday, week_end_date, " + _r("open high low close") + ", volume, trading_days from weekly", ["weekly"]))
def job_rebuild_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars brought up to date from a store whose last weeks are missing or wrong."""
    d = market(spark, sf_dir).daily
    stored = bars.weekly_bars(d).where("monday < (date '2001-10-29' - interval 7 days) or symbol_id % 2 = 0").withColumn("close", F.when((F.col("symbol_id") % 4 == 0) & (F.col("monday") >= "2001-10-22"), 1.0).otherwise(F.col("close")))
    return rounded(jobs.rebuild_weeks(d, stored, 3).weekly.select("symbol_id", "monday", "week_end_date", "open", "high", "low", "close", "volume", "trading_days"))


@registered(query(f"select symbol_id, week_end_date, {_r('atr upper_band lower_band st_value')}, direction, weeks_in_trend, is_flip from series", ["series"]))
def job_update_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series from a state half way, some symbols rewritten and some without state; equal to the series made at once."""
    weekly = bars.weekly_bars(market(spark, sf_dir).daily)
    half = weekly.where("week_end_date < '1999-01-01' and symbol_id % 5 <> 0")
    series = trend.trend(half)
    state = trend.last_state(series, 7, 3.0)
    changed = weekly.where("symbol_id % 7 = 0").groupBy("symbol_id").agg(F.min("week_end_date").alias("first_changed"))
    return rounded(jobs.update_trend(weekly, series, state, changed)[0].select("symbol_id", "week_end_date", "atr", "upper_band", "lower_band", "st_value", "direction", "weeks_in_trend", "is_flip"))


_ARCHIVE = f"(select date, symbol, isin, sum(value) as value, 100.0 * case when date < date '1998-06-01' and isin is not null then 2 else 1 end as price from {_HIST} group by date, symbol, isin)"


@registered(
    f"""with recursive h as materialized (select * from {_ARCHIVE}), pairs as materialized (select distinct symbol, isin from h), edges as materialized (select distinct a.symbol as a, b.symbol as b from pairs a join pairs b on a.isin = b.isin),
    reach as (select symbol as a, symbol as b from pairs union select r.a, e.b from reach r join edges e on e.a = r.b), roots as materialized (select a as symbol, min(b) as root from reach group by 1),
    days as (select root, date, coalesce(cast(date_diff('day', lag(date) over (partition by root order by date), date) > 365 as integer), 0) as new from (select distinct root, date from h join roots using (symbol))),
    segments as materialized (select root, date, root || '#' || sum(new) over (partition by root order by date) as entity from days),
    linked as materialized (select h.*, s.entity from h join roots using (symbol) join segments s on s.root = roots.root and s.date = h.date)
    select entity, min(date) as listed_date, max(date) as last_date, list_sort(list(distinct isin) filter (isin is not null)) as isins from linked where entity in (select entity from linked where isin like 'INE%') group by 1"""
)
def job_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities of an archive in which shares were split in two in the middle of 1998, with the split as an event of each ISIN."""
    built = _point_in_time(spark, sf_dir)
    return built.entities.select("entity", "listed_date", "last_date", "isins")


def _point_in_time(spark: SparkSession, sf_dir: str) -> jobs.PointInTime:
    h = written(_history(spark, sf_dir).groupBy("date", "symbol", "isin").agg(F.sum("value").alias("value")))
    price = F.when((F.col("date") < "1998-06-01") & F.col("isin").isNotNull(), 200.0).otherwise(100.0)
    rows = h.select("date", "symbol", "isin", "value", *(price.alias(x) for x in ("open", "high", "low", "close")), F.col("value").alias("volume"))
    events = h.where("isin is not null").select("symbol", "isin").groupBy("isin").agg(F.min("symbol").alias("symbol")).select("symbol", "isin", F.lit("1998-06-01").cast("date").alias("ex_date"), F.lit(0.5).alias("factor"))
    return jobs.build_point_in_time(rows, events, 1_000_000, 0.0)


@registered("select 'F' as sweep_id, count(*) as runs, round(max(o_totalprice), 4) as best_cagr_pct from orders where o_orderstatus = 'F' union all select 'O', count(*), round(max(o_totalprice), 4) from orders where o_orderstatus = 'O' union all select 'P', count(*), round(max(o_totalprice), 4) from orders where o_orderstatus = 'P' having count(*) > 0")
def api_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return rounded(api.sweeps(o.select(F.col("o_orderstatus").alias("sweep_id"), F.to_json(F.struct(F.col("o_totalprice").alias("cagr_pct"))).alias("metrics"))), 4)
