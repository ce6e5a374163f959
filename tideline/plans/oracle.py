"""The same results in SQL, as named common table expressions that build on each other."""

from __future__ import annotations


def _mean(x: str, w: str, rows: int, least: int | None = None, end: int = 0) -> str:
    return _roll("avg", x, w, rows, least, end)


def _roll(f: str, x: str, w: str, rows: int, least: int | None = None, end: int = 0) -> str:
    edge = lambda n: "current row" if n == 0 else f"{-n} preceding"
    frame = f"over (partition by {w} rows between {edge(end - rows + 1)} and {edge(end)})"
    return f"(case when count({x}) {frame} >= {rows if least is None else least} then {f}({x}) {frame} end)"


def _rank(x: str, by: str, name: str = "") -> str:
    """Average-tie per cent rank; NULL stays NULL."""
    return f"(case when {x} is not null then (rank() over (partition by {by} order by {x} nulls last) + (count({x}) over (partition by {by}, {x}) - 1) / 2.0) / count({x}) over (partition by {by}) * 100 end)"


def _lin(x: str, zero: float, full: float) -> str:
    return f"(case when {x} is not null then least(greatest(({x} - {zero}) / ({full} - {zero}), 0.0), 1.0) * 100 end)"


_S = "symbol_id order by ix"
_I = "industry order by monday"

CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


_cte(
    "returns", [],
    """select cast(regexp_extract(p_brand, '([0-9]+)$', 1) as integer) as symbol_id, cast(l_shipdate as date) as date,
       cast(sum(cast(round(l_discount * 100) as bigint)) - 5 * count(*) as double) / 100 / count(*) as ret, max(l_tax) / 4 as spread, sum(l_quantity) as volume,
       sum(case when l_returnflag = 'N' then l_quantity else 0 end) / nullif(sum(l_quantity), 0) * 100 as delivery_pct
       from lineitem join part on l_partkey = p_partkey where isodow(l_shipdate) <= 5 group by 1, 2""",
)
_cte("closes", ["returns"], "select *, 100 * exp(sum(ret) over (partition by symbol_id order by date rows unbounded preceding)) as close from returns")
_cte("opened", ["closes"], "select *, coalesce(lag(close) over (partition by symbol_id order by date), 100.0) as open from closes")
_cte("daily", ["opened"], "select symbol_id, date, open, greatest(open, close) * (1 + spread) as high, least(open, close) * (1 - spread) as low, close, cast(volume as bigint) as volume, delivery_pct from opened")
_cte("bench", ["returns"], "select date, 100 * exp(sum(ret) over (order by date rows unbounded preceding)) as close from (select date, avg(ret) as ret from returns group by date)")
_cte("symbols", [], "select distinct cast(regexp_extract(p_brand, '([0-9]+)$', 1) as integer) as symbol_id, p_brand as symbol, 'Sector ' || (cast(regexp_extract(p_brand, '([0-9]+)$', 1) as integer) % 5) as industry from part")
_cte(
    "weekly", ["daily"],
    """select symbol_id, cast(date_trunc('week', date) as date) as monday, max(date) as week_end_date, min(date) as week_start_date, arg_min(open, date) as open, max(high) as high,
       min(low) as low, arg_max(close, date) as close, cast(coalesce(sum(volume), 0) as bigint) as volume, count(*) as trading_days from daily group by 1, 2""",
)
_cte("bars", ["weekly"], "select *, row_number() over (partition by symbol_id order by week_end_date) as k from weekly")
_cte(
    "bands", ["bars"],
    """select symbol_id, week_end_date, k, close, high - low as warm_sum, cast(null as double) as atr, cast(0.0 as double) as upper, cast(0.0 as double) as lower, 0 as direction, 0 as weeks, false as turned from bars where k = 1
       union all
       select symbol_id, week_end_date, k, close, warm_sum, cur, upper, lower, d, case when direction = 0 or d <> direction then case when d = 0 then 0 else 1 end else weeks + 1 end, direction <> 0 and d <> direction
       from (select *, case when cur is null then 0 when atr is null then -1 when direction = -1 then case when close > upper then 1 else -1 end else case when close < lower then -1 else 1 end end as d
         from (select symbol_id, week_end_date, k, close, warm_sum, cur, atr, direction, weeks,
             case when cur is null then p_upper when mid + 3.0 * cur < p_upper or p_close > p_upper then mid + 3.0 * cur else p_upper end as upper,
             case when cur is null then p_lower when mid - 3.0 * cur > p_lower or p_close < p_lower then mid - 3.0 * cur else p_lower end as lower
           from (select n.symbol_id, n.week_end_date, n.k, n.close, p.close as p_close, p.atr, p.upper as p_upper, p.lower as p_lower, p.direction, p.weeks, (n.high + n.low) / 2 as mid,
               p.warm_sum + greatest(n.high - n.low, abs(n.high - p.close), abs(n.low - p.close)) as warm_sum,
               case when p.atr is not null then (p.atr * 6 + greatest(n.high - n.low, abs(n.high - p.close), abs(n.low - p.close))) / 7
                    when n.k = 7 then (p.warm_sum + greatest(n.high - n.low, abs(n.high - p.close), abs(n.low - p.close))) / 7 end as cur
             from bands p join bars n on n.symbol_id = p.symbol_id and n.k = p.k + 1)))""",
)
_cte("series", ["bands"], "select symbol_id, week_end_date, atr, upper as upper_band, lower as lower_band, case when direction = 1 then lower else upper end as st_value, direction, weeks as weeks_in_trend, turned as is_flip, close from bands where direction <> 0")
_cte("flagged", ["series"], "select *, coalesce(direction <> lag(direction) over (partition by symbol_id order by week_end_date), false) as is_new from series")
_cte("numbered", ["flagged"], "select *, sum(case when is_new then 1 else 0 end) over (partition by symbol_id order by week_end_date) as run from flagged")
_cte(
    "runs", ["numbered"],
    """select symbol_id, week_end_date, st_value, direction, is_new as is_new_flip, cast(row_number() over (partition by symbol_id, run order by week_end_date) as integer) as weeks_in_trend,
       max(case when is_new then week_end_date end) over so_far as flip_date, last_value(case when is_new then close end ignore nulls) over so_far as flip_price
       from numbered window so_far as (partition by symbol_id order by week_end_date rows unbounded preceding)""",
)
_cte("sessions", ["daily"], "select date, row_number() over (order by date) as ix from (select distinct date from daily)")
_cte(
    "dense", ["daily", "sessions"],
    """select *, last_value(raw ignore nulls) over (partition by symbol_id order by ix rows between 5 preceding and current row) as close from (
       select s.symbol_id, t.date, t.ix, d.close as raw, coalesce(d.high, d.close) as high, coalesce(d.low, d.close) as low, d.volume, d.delivery_pct
       from (select distinct symbol_id from daily) s cross join sessions t left join daily d on d.symbol_id = s.symbol_id and d.date = t.date)""",
)
_cte(
    "ranges", ["dense"],
    """select symbol_id, ix, case when high is null or low is null then null else greatest(high - low, abs(high - coalesce(before, high)), abs(low - coalesce(before, low))) end as tr
       from (select *, lag(close) over (partition by symbol_id order by ix) as before from dense)""",
)


def _ewm(name: str, source: str, key: str, order: str, value: str, alpha: float) -> None:
    _cte(
        name, [source],
        f"""select {key}, {order}, {value} as m, 1.0::double as w, case when {value} is null then 0 else 1 end as n from {source} where {order} = 1
        union all select x.{key}, x.{order}, case when x.{value} is null then p.m when p.m is null then x.{value} else (p.w * {1 - alpha} * p.m + {alpha} * x.{value}) / (p.w * {1 - alpha} + {alpha}) end,
        case when x.{value} is null then p.w * {1 - alpha} else 1.0::double end, p.n + case when x.{value} is null then 0 else 1 end from {name} p join {source} x on x.{key} = p.{key} and x.{order} = p.{order} + 1""",
    )


_ewm("atr", "ranges", "symbol_id", "ix", "tr", 1 / 14)
_cte(
    "daily_made", ["dense", "atr"],
    f"""select d.symbol_id, d.date, d.ix, close as price, {', '.join(f'{_mean("close", _S, n)} as sma{n}' for n in (50, 100, 150, 200))},
        {_roll('max', 'high', _S, 252, 20)} as high_52w, {_roll('min', 'low', _S, 252, 20)} as low_52w,
        {', '.join(f"(close / nullif(lag(close, {n}) over (partition by {_S}), 0) - 1) * 100 as ret_{k}" for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("9m", 189), ("12m", 252)))},
        {_mean('volume', _S, 20, 10)} as avg_vol_20d, {_mean('raw * volume', _S, 20, 10)} / 1e7 as avg_turnover_20d_cr, case when a.n >= 14 then a.m end / close * 100 as atr_pct,
        {_mean('delivery_pct', _S, 20, 5)} as delivery_pct_20d, {_mean('delivery_pct', _S, 5, 3)} as delivery_pct_latest, count(raw) over (partition by {_S}) as history_days
        from dense d join (select symbol_id as a_s, ix as a_x, m, n from atr) a on a_s = d.symbol_id and a_x = d.ix""",
)
_cte("daily_ind", ["daily_made"], f"select *, lag(sma200, 20) over (partition by {_S}) as sma200_prev, lag(atr_pct, 20) over (partition by {_S}) as atr_pct_prev from daily_made")
_cte("bench_weekly", ["bench"], "select cast(date_trunc('week', date) as date) as monday, arg_max(close, date) as bench from bench group by 1")
_cte("week_grid", ["weekly", "bench_weekly"], "select monday, ix, last_value(bench ignore nulls) over (order by ix) as bench from (select monday, row_number() over (order by monday) as ix from (select monday from weekly union select monday from bench_weekly)) left join bench_weekly using (monday)")
_cte(
    "week_dense", ["weekly", "week_grid"],
    """select s.symbol_id, g.monday, g.ix, w.close, cast(w.volume as double) as volume, (w.high - w.low) / w.close as rng, w.close / g.bench as strength
       from (select distinct symbol_id from weekly) s cross join week_grid g left join weekly w on w.symbol_id = s.symbol_id and w.monday = g.monday""",
)
_cte(
    "weekly_ind", ["week_dense"],
    f"""select symbol_id, monday, ix, close as week_close, (close / lag(close, 1) over (partition by {_S}) - 1) * 100 as ret_1w, (close / lag(close, 13) over (partition by {_S}) - 1) * 100 as ret_13w,
        volume as week_volume, volume / nullif({_mean('volume', _S, 20, 10, -1)}, 0) as vol_ratio, {_mean('rng', _S, 3)} / nullif({_mean('rng', _S, 3, end=-3)}, 0) as tightness_ratio,
        strength / {_mean('strength', _S, 10)} as rs_vs_benchmark from week_dense""",
)
_cte(
    "sector_days", ["daily_ind", "symbols"],
    """select industry, date, ix, exp(sum(ln(1 + r)) over (partition by industry order by ix)) * 100 as level from (
       select industry, date, ix, coalesce(avg(r), 0.0) as r from (select symbol_id, date, ix, least(greatest(price / nullif(lag(price) over (partition by symbol_id order by ix), 0) - 1, -0.5), 1.0) as r0,
         case when price is null or lag(price) over (partition by symbol_id order by ix) is null then null else least(greatest(price / lag(price) over (partition by symbol_id order by ix) - 1, -0.5), 1.0) end as r from daily_ind)
       join symbols using (symbol_id) group by 1, 2, 3)""",
)
_cte(
    "sector_weekly", ["sector_days", "bench"],
    """select industry, monday, week_end_date, index_value, bench, index_value / bench as rs_ratio_raw, row_number() over (partition by industry order by monday) as k, 100 * index_value / bench as x
       from (select industry, cast(date_trunc('week', date) as date) as monday, arg_max(level, ix) as index_value, max(date) as week_end_date from sector_days group by 1, 2)
       join (select cast(date_trunc('week', date) as date) as monday, arg_max(close, date) as bench from bench group by 1) using (monday)""",
)
_ewm("smooth", "sector_weekly", "industry", "k", "x", 0.5)
_K = "industry order by k"
_cte("ratios", ["smooth"], f"select industry, k, 100 + (m - {_mean('m', _K, 10)}) / nullif({_roll('stddev_samp', 'm', _K, 10)}, 0) as rs_ratio from smooth")
_cte("rocs", ["ratios"], f"select *, 100 * rs_ratio / nullif(lag(rs_ratio) over (partition by {_K}), 0) as y from ratios")
_ewm("roc_smooth", "rocs", "industry", "k", "y", 0.5)
_cte("momenta", ["roc_smooth"], f"select industry, k, 100 + (m - {_mean('m', _K, 10)}) / nullif({_roll('stddev_samp', 'm', _K, 10)}, 0) as rs_momentum from roc_smooth")
_cte("breadth", ["series", "symbols"], "select industry, cast(date_trunc('week', week_end_date) as date) as monday, avg(case when direction = 1 then 1.0 else 0.0 end) * 100 as st_breadth from series join symbols using (symbol_id) group by 1, 2")
_cte(
    "sector_panel", ["sector_weekly", "ratios", "momenta", "breadth"],
    f"""select industry, monday, week_end_date, index_value, bench as bench_value, rs_ratio_raw, rs_ratio_raw / nullif({_mean('rs_ratio_raw', _K, 10)}, 0) as rs_trend, rs_ratio, rs_momentum,
        {_roll('stddev_samp', 'step', _K, 26)} * sqrt(52) * 100 as vol_26w,
        {', '.join(f"(index_value / lag(index_value, {n}) over (partition by {_K}) - 1) * 100 as ret_{n}w" for n in (1, 4, 13, 26, 52))},
        st_breadth, st_breadth - lag(st_breadth, 4) over (partition by {_K}) as breadth_change_4w
        from (select *, index_value / lag(index_value) over (partition by {_K}) - 1 as step from sector_weekly) join ratios using (industry, k) join momenta using (industry, k) left join breadth using (industry, monday)""",
)
_cte("weeks", ["runs"], "select cast(date_trunc('week', week_end_date) as date) as monday, max(week_end_date) as week_end_date from runs group by 1")
_cte(
    "held", ["runs", "weeks", "weekly_ind"],
    """select r.* exclude (week_end_date), r.week_end_date as st_week, w.monday, w.week_end_date, v.vol_ratio as flip_vol_ratio from weeks w join runs r on r.week_end_date <= w.week_end_date and r.week_end_date >= w.week_end_date - 14
       left join weekly_ind v on v.symbol_id = r.symbol_id and v.monday = date_trunc('week', r.flip_date)
       qualify row_number() over (partition by r.symbol_id, w.monday order by r.week_end_date desc) = 1""",
)
_cte(
    "base", ["held", "symbols", "daily_ind", "weekly_ind"],
    """select s.symbol_id, s.symbol, s.industry, h.monday, h.week_end_date, case when h.direction = 1 then 'Bullish' else 'Bearish' end as direction, h.st_value, h.st_week, h.weeks_in_trend, h.is_new_flip, h.flip_date, h.flip_price,
       d.* exclude (symbol_id, date, ix), w.ret_1w, w.ret_13w, w.vol_ratio, w.tightness_ratio, w.rs_vs_benchmark, h.flip_vol_ratio,
       (high_52w - price) / high_52w * 100 as pct_from_high, (price / low_52w - 1) * 100 as pct_above_low, (price / flip_price - 1) * 100 as pct_since_flip, (price - st_value) / price * 100 as pct_from_st,
       case when vol_ratio is null then case when weeks_in_trend <= 6 then flip_vol_ratio end when weeks_in_trend <= 6 and flip_vol_ratio is not null then greatest(vol_ratio, flip_vol_ratio) else vol_ratio end as confirm_vol_ratio
       from symbols s join held h using (symbol_id) join daily_ind d on d.symbol_id = s.symbol_id and d.date = h.week_end_date left join weekly_ind w on w.symbol_id = s.symbol_id and w.monday = h.monday where price is not null""",
)
_cte(
    "rs_base", ["base"],
    """select *, round(case when ret_3m is not null then (0.4 * ret_3m + 0.2 * coalesce(ret_6m, 0) + 0.2 * coalesce(ret_9m, 0) + 0.2 * coalesce(ret_12m, 0))
       / (0.4 + case when ret_6m is null then 0 else 0.2 end + case when ret_9m is null then 0 else 0.2 end + case when ret_12m is null then 0 else 0.2 end) end, 9) as rs_raw from base""",
)
_cte("rs", ["rs_base"], f"select *, case when rs_raw is not null then least(greatest(ceil(round({_rank('rs_raw', 'monday')} / 100 * 99, 9)), 1), 99) end as rs_rating from rs_base")
_cte(
    "sector_counts", ["rs", "sector_panel"],
    """select c.*, p.* exclude (industry, monday, week_end_date), ret_26w / nullif(vol_26w, 0) as risk_adj_return,
       case when rs_ratio >= 100 and rs_momentum >= 100 then 'Leading' when rs_ratio >= 100 and rs_momentum < 100 then 'Weakening' when rs_ratio < 100 and rs_momentum < 100 then 'Lagging' when rs_ratio < 100 and rs_momentum >= 100 then 'Improving' end as rrg_quadrant
       from (select monday, week_end_date, industry, count(*) as stock_count, count(*) filter (direction = 'Bullish') as bullish_count,
         avg(case when sma50 is not null then case when price > sma50 then 1.0 else 0.0 end end) * 100 as pct_above_sma50, avg(case when sma200 is not null then case when price > sma200 then 1.0 else 0.0 end end) * 100 as pct_above_sma200,
         avg(case when pct_from_high <= 10 then 1.0 else 0.0 end) * 100 as pct_near_high from rs group by 1, 2, 3) c left join sector_panel p on p.industry = c.industry and p.monday = c.monday""",
)
_cte(
    "sector_ranks", ["sector_counts"],
    f"select *, {_rank('ret_13w', 'monday')} as rank_ret_13w, {_rank('rs_trend', 'monday')} as rank_rs_trend, {_rank('st_breadth', 'monday')} as rank_st_breadth, {_rank('risk_adj_return', 'monday')} as rank_risk_adj from sector_counts",
)
_cte("sector_scores", ["sector_ranks"], "select *, 0.3 * coalesce(rank_ret_13w, 0) + 0.3 * coalesce(rank_rs_trend, 0) + 0.2 * coalesce(rank_st_breadth, 0) + 0.2 * coalesce(rank_risk_adj, 0) as sector_score from sector_ranks")
_cte(
    "sectors", ["sector_scores"],
    """select *, coalesce(sector_rank <= 5 and st_breadth >= 60 and rs_trend > 1 and rrg_quadrant in ('Leading', 'Improving') and stock_count >= 3, false) as tradeable
       from (select *, row_number() over (partition by monday order by round(sector_score, 9) desc, industry) as sector_rank from sector_scores)""",
)
_cte("bench_trend", ["bench"], f"select *, lag(sma, 20) over (order by date) as sma_before from (select date, close, {_mean('close', '1 order by date', 200)} as sma from bench)")
_cte(
    "regimes", ["rs", "bench_trend"],
    """select *, case when coalesce(above_200dma, false) and coalesce(sma200_rising, false) and market_breadth_pct >= 50 then 'bull'
       when coalesce(not above_200dma, false) and (coalesce(not sma200_rising, false) or market_breadth_pct < 50) then 'bear' else 'neutral' end as regime
       from (select m.*, b.close as bench_close, b.sma as bench_sma200, b.close > b.sma as above_200dma, b.sma > b.sma_before as sma200_rising
         from (select monday, week_end_date, avg(case when direction = 'Bullish' then 1.0 else 0.0 end) * 100 as market_breadth_pct,
           avg(case when sma200 is not null then case when price > sma200 then 1.0 else 0.0 end end) * 100 as pct_above_sma200 from rs group by 1, 2) m
         asof left join bench_trend b on m.week_end_date >= b.date)""",
)
_cte(
    "stocks_in", ["rs", "sectors", "regimes"],
    """select r.*, s.sector_score, s.sector_rank, s.tradeable as sector_tradeable, r.ret_13w - s.ret_13w as rs_vs_sector, n.n_sectors, g.regime
       from rs r left join sectors s on s.monday = r.monday and s.industry = r.industry join (select monday, count(*) as n_sectors from sectors group by 1) n on n.monday = r.monday join regimes g on g.monday = r.monday""",
)
_cte(
    "flags", ["stocks_in"],
    """select *, direction = 'Bullish' as f_trend, coalesce(sector_tradeable, false) as f_sector, coalesce(price > sma50 and sma50 > sma150 and sma150 > sma200 and sma200 > sma200_prev, false) as f_trend_template,
       coalesce(pct_above_low >= 30 and pct_from_high <= 25, false) as f_52w_range, coalesce(rs_rating >= 70, false) as f_rs, coalesce(avg_turnover_20d_cr >= {turnover}, false) as f_liquidity, coalesce(price >= 50, false) as f_price, true as f_not_asm,
       coalesce(direction = 'Bullish' and weeks_in_trend between 1 and 6, false) as sig_fresh_flip, coalesce(direction = 'Bullish' and pct_from_st <= 10, false) as sig_tight_stop,
       coalesce(direction = 'Bullish' and confirm_vol_ratio >= 1.5, false) as sig_vol_confirm, coalesce(tightness_ratio <= 0.75 and atr_pct < atr_pct_prev, false) as sig_vcp, coalesce(delivery_pct_latest > delivery_pct_20d, false) as sig_accumulation,
       coalesce(pct_from_high <= 5, false) as sig_near_high, coalesce(rs_vs_sector > 0, false) as sig_sector_leader,
       coalesce((price / sma50 - 1) * 100 > 25, false) or coalesce(direction = 'Bullish' and pct_since_flip > 40, false) as pen_overextended,
       coalesce(atr_pct >= quantile_cont(atr_pct, 0.9) over (partition by monday), false) as pen_high_atr, coalesce(direction = 'Bullish' and weeks_in_trend > 20, false) as pen_late_stage from stocks_in""",
)
_cte(
    "parts", ["flags"],
    f"""select *, {_rank('rs_rating', 'monday')} as score_rs, least(greatest(100.0 * (n_sectors - sector_rank) / greatest(n_sectors - 1, 1), 0), 100) as score_sector_raw, {_rank('round(-pct_from_high, 9)', 'monday')} as score_near_high,
        {_lin('confirm_vol_ratio', 0.8, 2.0)} as score_volume, 0.7 * coalesce({_lin('tightness_ratio', 1.25, 0.5)}, 0) + 0.3 * case when coalesce(atr_pct < atr_pct_prev, false) then 100.0 else 0.0 end as score_tightness,
        f_trend and f_sector and f_trend_template and f_52w_range and f_rs and f_liquidity and f_price and f_not_asm as qualified from flags""",
)
_cte(
    "scored", ["parts"],
    """select *, case when sector_rank is null then null else score_sector_raw end as score_sector, least(greatest(0.35 * coalesce(score_rs, 0) + 0.35 * coalesce(score_near_high, 0) + 0.1 * coalesce(score_volume, 0) + 0.1 * coalesce(score_tightness, 0)
       + 0.1 * coalesce(case when sector_rank is null then null else score_sector_raw end, 0), 0), 100) as stock_score from parts""",
)


_cte(
    "graded", ["scored"],
    f"""select * exclude (stock_score), round_even(stock_score * 100, 0) / 100 as stock_score, case when direction = 'Bullish' then least(greatest(100.0 - greatest(weeks_in_trend - 6, 0) * 6.0, 0), 100) else 0.0 end as score_freshness,
       case when direction = 'Bullish' then {_lin('pct_from_st', 15, 3)} else 0.0 end as score_risk, 0.0 as penalty from scored""",
)
_cte(
    "planned", ["graded"],
    """select *, case when direction = 'Bullish' then case when stock_score >= 80 then 'A+' when stock_score >= 70 then 'A' when stock_score >= 60 then 'B' else 'Watch' end end as grade, st_stop as stop_price,
       case when price > st_stop then (price - st_stop) / price * 100 end as risk_pct, qty as position_qty, qty * price as position_value,
       concat_ws(', ', case when direction <> 'Bullish' then case when is_new_flip then 'Bearish (new flip)' else 'Bearish' end end,
         case when direction = 'Bullish' and sig_fresh_flip then printf('Fresh flip %dw', cast(weeks_in_trend as bigint)) end, case when direction = 'Bullish' and sig_near_high then printf('Near high %.1f%%', pct_from_high) end,
         case when direction = 'Bullish' and sig_vol_confirm then printf('Vol %.1fx', confirm_vol_ratio) end, case when direction = 'Bullish' and sig_tight_stop then printf('Stop %.1f%%', pct_from_st) end,
         case when direction = 'Bullish' and sig_vcp then 'VCP' end, case when direction = 'Bullish' and sig_accumulation then 'Accumulation' end, case when direction = 'Bullish' and sig_sector_leader then 'Sector leader' end,
         case when pen_overextended then 'Overextended' end, case when pen_high_atr then 'High ATR' end, case when pen_late_stage then printf('Late stage %dw', cast(weeks_in_trend as bigint)) end,
         '✗ ' || nullif(concat_ws(', ', case when not f_sector then 'Sector' end, case when not f_trend_template then 'Trend template' end, case when not f_52w_range then '52W range' end,
           case when not f_rs then case when rs_rating is not null then printf('RS %d', cast(trunc(rs_rating) as bigint)) else 'RS n/a' end end, case when not f_liquidity then 'Liquidity' end, case when not f_price then 'Price' end, case when not f_not_asm then 'ASM/GSM' end), ''),
         case when direction = 'Bullish' and regime = 'bear' then 'Bear regime: reduce size' end) as reasons
       from (select *, case when direction = 'Bullish' then st_value end as st_stop, case when direction = 'Bullish' and price > st_value and price <> 0 then least(floor(1000000.0 * 1.0 / 100 * case when regime = 'bear' then 0.5 else 1 end / (price - st_value)), floor(1000000.0 * 25.0 / 100 / price)) end as qty from graded)""",
)


def query(select: str, needs: list[str], **values: float) -> str:
    """A whole statement from a final ``select`` and the expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in CTES[name][0]:
                add(n)
            order.append(name)

    for name in needs:
        add(name)
    recursive = {"bands", "atr", "smooth", "roc_smooth"}
    body = ",\n".join(f"{n} as {'' if n in recursive else 'materialized '}({CTES[n][1]})" for n in order)
    for key, value in values.items():
        body = body.replace("{" + key + "}", repr(value))
    return f"with recursive {body}\n{select}"
