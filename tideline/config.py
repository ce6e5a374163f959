"""Options of all operators.

Two sets of defaults exist: the typed ones, which are the field defaults here,
and the live ones (:func:`live`), which differ where ``LIVE`` says so.
Unknown keys are errors.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Trend:
    period: int = 7
    multiplier: float = 3.0


@dataclass(frozen=True)
class Indicators:
    fill_limit: int = 5
    stale_weeks: int = 2
    rising_days: int = 20
    near_high_breadth_pct: float = 10.0
    delivery_short_days: int = 5
    atr_days: int = 14


@dataclass(frozen=True)
class RelativeStrength:
    weights: dict[str, float] = field(default_factory=lambda: {"ret_3m": 0.4, "ret_6m": 0.2, "ret_9m": 0.2, "ret_12m": 0.2})
    sma_weeks: int = 10


@dataclass(frozen=True)
class Tradeable:
    max_rank: int = 5
    min_st_breadth: float = 60.0
    min_rs_trend: float = 1.0
    quadrants: tuple[str, ...] = ("Leading", "Improving")
    min_stocks: int = 3


@dataclass(frozen=True)
class Sectors:
    rrg_window: int = 10
    rrg_smooth: int = 3
    rs_sma_weeks: int = 10
    breadth_change_weeks: int = 4
    weights: dict[str, float] = field(default_factory=lambda: {"ret_13w": 0.3, "rs_trend": 0.3, "st_breadth": 0.2, "risk_adj": 0.2})
    tradeable: Tradeable = field(default_factory=Tradeable)


@dataclass(frozen=True)
class Regime:
    sma_days: int = 200
    slope_days: int = 20
    min_breadth: float = 50.0
    bear_size_factor: float = 0.5


@dataclass(frozen=True)
class Filters:
    min_rs_rating: float = 70.0
    min_above_low_pct: float = 30.0
    max_from_high_pct: float = 25.0
    min_turnover_cr: float = 10.0
    min_price: float = 50.0


@dataclass(frozen=True)
class Signals:
    fresh_flip_max_weeks: int = 6
    tight_stop_pct: float = 10.0
    vol_confirm_ratio: float = 1.5
    vcp_max_tightness: float = 0.75
    near_high_pct: float = 5.0


@dataclass(frozen=True)
class Penalties:
    overextended_sma50_pct: float = 25.0
    overextended_since_flip_pct: float = 40.0
    high_atr_percentile: float = 90.0
    late_stage_weeks: int = 20
    points: dict[str, float] = field(default_factory=lambda: {"overextended": 10, "high_atr": 5, "late_stage": 10})


@dataclass(frozen=True)
class Scoring:
    weights: dict[str, float] = field(default_factory=lambda: {"rs": 0.25, "sector": 0.15, "freshness": 0.15, "near_high": 0.15, "volume": 0.1, "tightness": 0.1, "risk": 0.1})
    freshness_decay_per_week: float = 6.0
    volume_floor: float = 0.8
    volume_full: float = 2.0
    tightness_best: float = 0.5
    tightness_worst: float = 1.25
    risk_full_pct: float = 3.0
    risk_zero_pct: float = 15.0
    grades: dict[str, float] = field(default_factory=lambda: {"A+": 80, "A": 70, "B": 60})


@dataclass(frozen=True)
class TradePlan:
    capital: float = 1_000_000.0
    risk_pct: float = 1.0
    max_position_pct: float = 25.0


@dataclass(frozen=True)
class Ingest:
    action_threshold: float = 0.03
    catch_up_days: int = 10
    min_coverage: float = 0.9
    ohlc_tolerance: float = 0.005
    calendar_min_fraction: float = 0.5
    rebuild_weeks: int = 3


@dataclass(frozen=True)
class Config:
    trend: Trend = field(default_factory=Trend)
    indicators: Indicators = field(default_factory=Indicators)
    relative_strength: RelativeStrength = field(default_factory=RelativeStrength)
    sectors: Sectors = field(default_factory=Sectors)
    regime: Regime = field(default_factory=Regime)
    filters: Filters = field(default_factory=Filters)
    signals: Signals = field(default_factory=Signals)
    penalties: Penalties = field(default_factory=Penalties)
    scoring: Scoring = field(default_factory=Scoring)
    plan: TradePlan = field(default_factory=TradePlan)
    ingest: Ingest = field(default_factory=Ingest)


#: Where the live options differ from the typed defaults.
LIVE: dict[str, Any] = {
    "penalties": {"points": {"overextended": 0, "high_atr": 0, "late_stage": 0}},
    "scoring": {"weights": {"rs": 0.35, "near_high": 0.35, "volume": 0.1, "tightness": 0.1, "sector": 0.1}},
}


def override(base: Any, changes: dict[str, Any]) -> Any:
    """``base`` with nested ``changes``; an unknown key raises ``KeyError``."""
    known = {f.name for f in dataclasses.fields(base)}
    if unknown := changes.keys() - known:
        raise KeyError(f"unknown options: {sorted(unknown)}")
    new = {}
    for key, value in changes.items():
        old = getattr(base, key)
        new[key] = override(old, value) if dataclasses.is_dataclass(old) and isinstance(value, dict) else value
    return dataclasses.replace(base, **new)


def live(changes: dict[str, Any] | None = None) -> Config:
    """The live options, with further changes."""
    return override(override(Config(), LIVE), changes or {})
