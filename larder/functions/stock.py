"""Stock arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.calendar import as_col
from larder.functions.normal import normal_cdf, normal_quantile

# Fixed values: (medium, high) thresholds.
STOCKOUT_RISK = (0.10, 0.25)
WASTE_RISK = (0.05, 0.15)
# Service-level change by ABC class and the range it is clipped to.
ABC_SERVICE_CHANGE = {"A": 0.02, "B": 0.0, "C": -0.03}
SERVICE_RANGE = (0.50, 0.995)


def floor_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def inventory_position(on_hand, on_order, backorders=0.0) -> Column:
    return as_col(on_hand) + as_col(on_order) - as_col(backorders)


def safety_stock(sigma, days, level) -> Column:
    """Quantile x sigma x sqrt(days), never negative."""
    return floor_zero(normal_quantile(as_col(level)) * as_col(sigma) * F.sqrt(as_col(days).cast("double")))


def safety_stock_variable_lead(sigma, days, level, mean_demand, lead_sd) -> Column:
    """Safety stock when the lead time itself varies."""
    spread = as_col(days) * as_col(sigma) * as_col(sigma) + F.pow(as_col(mean_demand) * as_col(lead_sd), F.lit(2.0))
    return floor_zero(normal_quantile(as_col(level)) * F.sqrt(spread))


def expected_demand(forecast, days) -> Column:
    """Demand over the first ``days`` of a daily forecast array.

    A fractional last day counts in part; days past the end count at the forecast mean.
    """
    f, n = as_col(forecast), as_col(days).cast("double")
    size = F.size(f)
    whole = F.least(F.floor(n), size.cast("double")).cast("int")
    plus = lambda acc, x: acc + x
    total = F.aggregate(f, F.lit(0.0), plus)
    mean = total / size
    head = F.aggregate(F.slice(f, F.lit(1), whole), F.lit(0.0), plus)
    following = F.coalesce(F.try_element_at(f, whole + 1), mean)
    return (
        F.when((n <= 0) | (size == 0), F.lit(0.0))
        .when(n < size + 1, head + (n - whole) * following)
        .otherwise(total + (n - size) * mean)
    )


def usable_life(shelf_life, fraction) -> Column:
    return F.greatest(as_col(shelf_life) * as_col(fraction), F.lit(1.0))


def stockout_probability(position, demand, sigma, days) -> Column:
    """Chance that demand over the period exceeds the position; a hard compare without uncertainty."""
    period_sd = as_col(sigma) * F.sqrt(F.greatest(as_col(days).cast("double"), F.lit(0.0)))
    gap = as_col(position) - as_col(demand)
    certain = (gap < 0).cast("double")
    return F.when(period_sd <= 0, certain).otherwise(F.lit(1.0) - normal_cdf(gap / period_sd))


def round_to_pack(quantity, pack, mode: str = "nearest") -> Column:
    """Whole supplier cases; ``nearest`` rounds halves to the even case."""
    q, p = as_col(quantity), as_col(pack).cast("double")
    if mode not in ("nearest", "up", "none"):
        raise ValueError(f"mode must be nearest, up or none, got {mode!r}")
    cases = {"nearest": F.rint(q / p), "up": F.ceil(q / p).cast("double"), "none": q / p}[mode]
    return F.when(q <= 0, F.lit(0.0)).otherwise(q if mode == "none" else cases * p)


def risk_class(value, thresholds) -> Column:
    medium, high = thresholds
    v = as_col(value)
    return F.when(v >= high, "high").when(v >= medium, "medium").otherwise("low")


def worse_risk(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    either = lambda level: (a == level) | (b == level)
    return F.when(either("high"), "high").when(either("medium"), "medium").otherwise("low")


def segment_service_level(abc, base) -> Column:
    """Service target adjusted by ABC class and clipped."""
    change = F.lit(0.0)
    for name, delta in ABC_SERVICE_CHANGE.items():
        change = F.when(as_col(abc) == name, F.lit(delta)).otherwise(change)
    low, high = SERVICE_RANGE
    return F.least(F.greatest(as_col(base) + change, F.lit(low)), F.lit(high))


def improvement_pct(base, other, higher_is_better) -> Column:
    """Percent better than ``base``; 0 for 0 vs 0, NULL when only ``base`` is 0."""
    b, o = as_col(base), as_col(other)
    gain = F.when(as_col(higher_is_better), o - b).otherwise(b - o)
    return F.when((b == 0) & (o == 0), F.lit(0.0)).when(b != 0, gain / F.abs(b) * 100.0)


def whole(x) -> Column:
    """Text of a number rounded half-even to a whole number, without a sign on zero.

    Rounded to six places first, so that a half is a half whatever the order of the sums behind it.
    """
    return F.rint(F.round(as_col(x), 6)).cast("bigint").cast("string")


def percent(x) -> Column:
    """Text of a share as a whole percentage."""
    return F.concat(whole(as_col(x) * 100.0), F.lit("%"))


def decimals(x, places: int) -> Column:
    """Text of a number with fixed decimals, rounded half-even."""
    return F.format_string(f"%.{places}f", F.bround(as_col(x), places))
