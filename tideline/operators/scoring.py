"""Filters, signals, penalties, score, grade, reasons and trade plan, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Config
from tideline.functions.columns import clipped, half_even, linear, one_decimal, percent_rank, ratio, truth

FILTERS = ["f_trend", "f_sector", "f_trend_template", "f_52w_range", "f_rs", "f_liquidity", "f_price", "f_not_asm"]
SIGNALS = ["sig_fresh_flip", "sig_tight_stop", "sig_vol_confirm", "sig_vcp", "sig_accumulation", "sig_near_high", "sig_sector_leader"]
PENALTIES = ["pen_overextended", "pen_high_atr", "pen_late_stage"]

c = F.col


def bullish() -> Column:
    return c("direction") == "Bullish"


def rs_rating(stocks: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    """``rs_raw`` (weighted mean of the returns there are, the first required) and ``rs_rating`` 1 to 99."""
    names = list(weights)
    total = sum((F.coalesce(c(k), F.lit(0.0)) * float(weights[k]) for k in names), F.lit(0.0))
    weight = sum((F.when(c(k).isNotNull(), float(weights[k])).otherwise(0.0) for k in names), F.lit(0.0))
    raw = F.when(c(names[0]).isNotNull(), ratio(total, weight))
    ranked = stocks.withColumn("rs_raw", raw)
    # rounded before ranking: sums of the same returns may differ in the last digit
    share = percent_rank(F.round("rs_raw", 9), by) / 100
    return ranked.withColumn("rs_rating", clipped(F.ceil(F.round(share * 99, 9)).cast("double"), 1, 99))


def with_filters(stocks: DataFrame, cfg: Config) -> DataFrame:
    f = cfg.filters
    template = (c("price") > c("sma50")) & (c("sma50") > c("sma150")) & (c("sma150") > c("sma200")) & (c("sma200") > c("sma200_prev"))
    out = stocks.withColumns(
        {
            "f_trend": bullish(),
            "f_sector": truth(c("sector_tradeable")),
            "f_trend_template": truth(template),
            "f_52w_range": truth((c("pct_above_low") >= f.min_above_low_pct) & (c("pct_from_high") <= f.max_from_high_pct)),
            "f_rs": truth(c("rs_rating") >= f.min_rs_rating),
            "f_liquidity": truth(c("avg_turnover_20d_cr") >= f.min_turnover_cr),
            "f_price": truth(c("price") >= f.min_price),
            "f_not_asm": ~truth(c("in_asm_gsm")),
        }
    )
    return out.withColumn("qualified", reduce(lambda a, b: a & b, map(c, FILTERS)))


def with_signals(stocks: DataFrame, cfg: Config, by: list[str]) -> DataFrame:
    """Soft signals and penalty flags; the ATR cut is the exact percentile of each week's cross-section."""
    s, p = cfg.signals, cfg.penalties
    weeks = c("weeks_in_trend")
    cut = F.percentile("atr_pct", p.high_atr_percentile / 100).over(Window.partitionBy(*by))
    return stocks.withColumns(
        {
            "sig_fresh_flip": truth(bullish() & weeks.between(1, s.fresh_flip_max_weeks)),
            "sig_tight_stop": truth(bullish() & (c("pct_from_st") <= s.tight_stop_pct)),
            "sig_vol_confirm": truth(bullish() & (c("confirm_vol_ratio") >= s.vol_confirm_ratio)),
            "sig_vcp": truth((c("tightness_ratio") <= s.vcp_max_tightness) & (c("atr_pct") < c("atr_pct_prev"))),
            "sig_accumulation": truth(c("delivery_pct_latest") > c("delivery_pct_20d")),
            "sig_near_high": truth(c("pct_from_high") <= s.near_high_pct),
            "sig_sector_leader": truth(c("rs_vs_sector") > 0),
            "pen_overextended": truth((ratio(c("price"), c("sma50")) - 1) * 100 > p.overextended_sma50_pct) | truth(bullish() & (c("pct_since_flip") > p.overextended_since_flip_pct)),
            "pen_high_atr": truth(c("atr_pct") >= cut),
            "pen_late_stage": truth(bullish() & (weeks > p.late_stage_weeks)),
        }
    )


def with_score(stocks: DataFrame, cfg: Config, by: list[str]) -> DataFrame:
    """Seven components, penalty, score and grade; ``n_sectors`` is the number of sectors of the week."""
    sc, s = cfg.scoring, cfg.signals
    late = F.greatest(c("weeks_in_trend") - s.fresh_flip_max_weeks, F.lit(0))
    spread = F.greatest(c("n_sectors") - 1, F.lit(1))
    falling = F.when(truth(c("atr_pct") < c("atr_pct_prev")), 100.0).otherwise(0.0)
    parts = stocks.withColumns(
        {
            "score_rs": percent_rank(c("rs_rating"), by),
            "score_sector": clipped(100.0 * (c("n_sectors") - c("sector_rank")) / spread, 0, 100),
            "score_freshness": F.when(bullish(), clipped(100 - late * sc.freshness_decay_per_week, 0, 100)).otherwise(0.0),
            "score_near_high": percent_rank(F.round(-c("pct_from_high"), 9), by),
            "score_volume": linear(c("confirm_vol_ratio"), sc.volume_floor, sc.volume_full),
            "score_tightness": 0.7 * F.coalesce(linear(c("tightness_ratio"), sc.tightness_worst, sc.tightness_best), F.lit(0.0)) + 0.3 * falling,
            "score_risk": F.when(bullish(), linear(c("pct_from_st"), sc.risk_zero_pct, sc.risk_full_pct)).otherwise(0.0),
        }
    )
    points = cfg.penalties.points
    penalty = sum((F.when(c(f"pen_{k}"), float(v)).otherwise(0.0) for k, v in points.items()), F.lit(0.0))
    total = sum((F.lit(float(v)) * F.coalesce(f"score_{k}", F.lit(0.0)) for k, v in sc.weights.items()), F.lit(0.0))
    scored = parts.withColumn("penalty", penalty).withColumn("stock_score", half_even(clipped(total - c("penalty"), 0, 100), 2))
    g = sc.grades
    grade = F.when(c("stock_score") >= g["A+"], "A+").when(c("stock_score") >= g["A"], "A").when(c("stock_score") >= g["B"], "B").otherwise("Watch")
    return scored.withColumn("grade", F.when(bullish(), grade))


def reasons(regime: Column) -> Column:
    """Signals, penalties and failed filters in words, in a fixed order."""
    one = lambda text, x: F.format_string(text, x)
    whole = lambda x: x.cast("long")
    up, down = bullish(), ~bullish()
    said = [
        F.when(down, F.when(c("is_new_flip"), "Bearish (new flip)").otherwise("Bearish")),
        F.when(up & c("sig_fresh_flip"), one("Fresh flip %dw", whole(c("weeks_in_trend")))),
        F.when(up & c("sig_near_high"), F.concat(F.lit("Near high "), one_decimal(c("pct_from_high")), F.lit("%"))),
        F.when(up & c("sig_vol_confirm"), F.concat(F.lit("Vol "), one_decimal(c("confirm_vol_ratio")), F.lit("x"))),
        F.when(up & c("sig_tight_stop"), F.concat(F.lit("Stop "), one_decimal(c("pct_from_st")), F.lit("%"))),
        F.when(up & c("sig_vcp"), "VCP"),
        F.when(up & c("sig_accumulation"), "Accumulation"),
        F.when(up & c("sig_sector_leader"), "Sector leader"),
        F.when(c("pen_overextended"), "Overextended"),
        F.when(c("pen_high_atr"), "High ATR"),
        F.when(c("pen_late_stage"), one("Late stage %dw", whole(c("weeks_in_trend")))),
    ]
    missed = F.concat_ws(
        ", ",
        F.when(~c("f_sector"), "Sector"),
        F.when(~c("f_trend_template"), "Trend template"),
        F.when(~c("f_52w_range"), "52W range"),
        F.when(~c("f_rs"), F.when(c("rs_rating").isNotNull(), one("RS %d", whole(c("rs_rating")))).otherwise("RS n/a")),
        F.when(~c("f_liquidity"), "Liquidity"),
        F.when(~c("f_price"), "Price"),
        F.when(~c("f_not_asm"), "ASM/GSM"),
    )
    return F.concat_ws(", ", *said, F.when(missed != "", F.concat(F.lit("✗ "), missed)), F.when(up & (regime == "bear"), "Bear regime: reduce size"))


def with_plan(stocks: DataFrame, cfg: Config) -> DataFrame:
    """Stop, risk and size; none where the stop is not below the price. A bear regime scales the risk."""
    plan = cfg.plan
    stop = F.when(bullish(), c("st_value"))
    room = c("price") - c("stop_price")
    per_share = F.when(room > 0, room)
    risk = F.lit(plan.capital * plan.risk_pct / 100) * F.when(c("regime") == "bear", cfg.regime.bear_size_factor).otherwise(1.0)
    # NULL if either is: a missing stop gives no size
    by_risk, by_cap = F.floor(ratio(risk, per_share)), F.floor(ratio(F.lit(plan.capital * plan.max_position_pct / 100), c("price")))
    qty = F.when(by_risk.isNotNull() & by_cap.isNotNull(), F.least(by_risk, by_cap))
    return (
        stocks.withColumn("stop_price", stop)
        .withColumns({"risk_pct": ratio(per_share, c("price")) * 100, "position_qty": qty})
        .withColumn("position_value", c("position_qty") * c("price"))
    )


def score_stocks(stocks: DataFrame, cfg: Config, by: list[str]) -> DataFrame:
    """All of the above; ``stocks`` carries ``n_sectors`` and the week's ``regime``."""
    done = with_plan(with_score(with_signals(with_filters(stocks, cfg), cfg, by), cfg, by), cfg)
    return done.withColumn("reasons", reasons(c("regime")))
