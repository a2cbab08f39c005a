"""Parameters of every job, as one frozen record.

The defaults are fixed values: results only match published numbers when they stay as they are.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

# England and Wales bank holidays and the days the site does not trade.
BANK_HOLIDAYS = (
    dt.date(2024, 1, 1),
    dt.date(2024, 3, 29),
    dt.date(2024, 4, 1),
    dt.date(2024, 5, 6),
    dt.date(2024, 5, 27),
    dt.date(2024, 8, 26),
    dt.date(2024, 12, 25),
    dt.date(2024, 12, 26),
    dt.date(2025, 1, 1),
    dt.date(2025, 4, 18),
    dt.date(2025, 4, 21),
    dt.date(2025, 5, 5),
    dt.date(2025, 5, 26),
    dt.date(2025, 8, 25),
    dt.date(2025, 12, 25),
    dt.date(2025, 12, 26),
    dt.date(2026, 1, 1),
    dt.date(2026, 4, 3),
    dt.date(2026, 4, 6),
    dt.date(2026, 5, 4),
    dt.date(2026, 5, 25),
    dt.date(2026, 8, 31),
    dt.date(2026, 12, 25),
    dt.date(2026, 12, 28),
)
CLOSED_DAYS = tuple(dt.date(y, 12, 25) for y in (2024, 2025, 2026))

# School holidays of every year as (month, first day, last day).
SCHOOL_HOLIDAYS = (
    (1, 1, 2),
    (2, 12, 18),
    (4, 1, 14),
    (5, 26, 31),
    (7, 1, 31),
    (8, 1, 31),
    (10, 26, 31),
    (12, 20, 31),
)

# Policy labels used in every comparison table.
BASELINE = "Manual par-level baseline"
CANDIDATE = "AI forecast + inventory policy"


@dataclass(frozen=True)
class Settings:
    """All knobs.  Money is GBP, stock is whole or fractional units, time is whole days."""

    # forecasting
    horizon_days: int = 7
    seasonal_period: int = 7
    min_history_days: int = 60
    refit_days: int = 7
    interval_level: float = 0.95
    two_sided_interval: bool = False
    folds: int = 12
    croston_alpha: float = 0.1
    intermittent_share: float = 0.25
    sigma_tail_days: int = 28
    seed: int = 42
    gbt_rounds: int = 300
    gbt_rate: float = 0.05
    gbt_depth: int = 6
    gbt_min_leaf: int = 20
    # SKU codes are folded into so many categories, however many SKUs there are
    gbt_sku_buckets: int = 64
    # Holt-Winters grid: every combination is scored per series
    hw_alpha: tuple[float, ...] = (0.05, 0.2, 0.5)
    hw_beta: tuple[float, ...] = (0.0, 0.01, 0.1)
    hw_gamma: tuple[float, ...] = (0.01, 0.1, 0.3)

    # features
    lags: tuple[int, ...] = (7, 14)
    rolls: tuple[int, ...] = (28,)
    promotions_known: bool = True
    zero_on_closed_days: bool = True
    bank_holidays: tuple[dt.date, ...] = BANK_HOLIDAYS
    closed_days: tuple[dt.date, ...] = CLOSED_DAYS
    school_holidays: tuple[tuple[int, int, int], ...] = SCHOOL_HOLIDAYS
    weekend_days: tuple[int, ...] = (4, 5, 6)

    # weather
    perfect_foresight: bool = False
    weather_noise_sd: float = 1.2
    weather_noise_growth: float = 0.35
    weather_seed: int = 42

    # ordering
    policy: str = "base_stock"
    service_level: float = 0.95
    reorder_multiplier: float = 1.0
    nominal_review_days: int = 2
    max_days_of_supply: float = 14.0
    shelf_life_cap: bool = True
    usable_fraction: float = 1.0
    pack_rounding: str = "nearest"
    lead_days: int = 2
    order_days: tuple[int, ...] = (0, 2, 4)
    order_fee: float = 12.5

    # costs
    holding_rate: float = 0.25
    holding_per_day: float | None = None
    waste_multiplier: float = 1.0
    disposal_cost: float = 0.05
    stockout_multiplier: float = 2.0
    stockout_per_unit: float | None = None
    default_unit_cost: float = 1.0
    default_pack: int = 1
    default_min_order: int = 0

    # replay
    start: dt.date = dt.date(2025, 7, 1)
    end: dt.date = dt.date(2025, 12, 31)
    warmup_days: int = 365
    opening_days: float = 2.0

    # manual baseline
    lookback_days: int = 28
    buffer: float = 0.20
    cover_days: int | None = None
    baseline_shelf_life_cap: bool = False

    # segmentation
    abc_cuts: tuple[float, float] = (0.80, 0.95)
    xyz_cuts: tuple[float, float] = (0.50, 1.00)
    segment_lookback_days: int = 365

    def __post_init__(self) -> None:
        unit_interval = {
            "interval_level": self.interval_level,
            "service_level": self.service_level,
        }
        for name, value in unit_interval.items():
            if not 0.0 < value < 1.0:
                raise ValueError(f"{name} must be strictly between 0 and 1, got {value}")
        if not self.order_days:
            raise ValueError("order_days must name at least one weekday")
        if self.pack_rounding not in ("nearest", "up", "none"):
            raise ValueError(f"pack_rounding must be nearest, up or none, got {self.pack_rounding!r}")
        if self.policy not in ("base_stock", "s_S"):
            raise ValueError(f"policy must be base_stock or s_S, got {self.policy!r}")
        if not 0.0 < self.usable_fraction <= 1.0:
            raise ValueError(f"usable_fraction must be in (0, 1], got {self.usable_fraction}")
        if self.start > self.end:
            raise ValueError(f"start {self.start} is after end {self.end}")
        for low, high in (self.abc_cuts, self.xyz_cuts):
            if not low < high:
                raise ValueError(f"thresholds must ascend, got {(low, high)}")

    def but(self, **changes) -> "Settings":
        """A copy with some values changed."""
        return replace(self, **changes)
