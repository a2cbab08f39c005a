"""From forecasts and stock to recommendations, and replays of whole policies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import days_to_order_day, is_order_day
from larder.functions.stock import expected_demand, segment_service_level, usable_life
from larder.operators.features import trailing_usage
from larder.operators.kpi import compute_kpis
from larder.operators.ledger import order_log, replay, share_order_fee, with_costs
from larder.operators.ordering import base_stock, build_policy, par_level, recommend, with_levels
from larder.settings import BASELINE, CANDIDATE, Settings
from larder.sources.sales import ECONOMICS_COLUMNS


def opening_stock(sales: DataFrame, start, s: Settings = Settings()) -> DataFrame:
    """Opening units per SKU: mean demand of the lookback before ``start`` times the days of supply."""
    d = F.col("date")
    window = sales.filter((d < F.lit(start)) & (d >= F.date_sub(F.lit(start), s.lookback_days)))
    return window.groupBy("sku").agg((F.avg("units_sold") * s.opening_days).alias("opening"))


def stock_positions(
    skus: DataFrame, sales: DataFrame, as_of, s: Settings = Settings(), ledger: DataFrame | None = None,
    warmup: DataFrame | None = None, warmup_days: int = 28,
) -> DataFrame:
    """On hand and on order per SKU with the source they came from.

    In order: closing position of the day before in a given ledger, in a warm-up replay, else a
    flat number of days of recent demand.
    """
    yesterday = F.date_sub(F.lit(as_of), 1)
    out = skus.select("sku")
    sources = []
    for frame, tag in ((ledger, "ledger"), (warmup, "warmup")):
        if frame is not None:
            at = frame.filter(F.col("date") == yesterday)
            out = out.join(at.select("sku", F.col("closing_stock").alias(f"{tag}_hand"), F.col("on_order").alias(f"{tag}_order")), "sku", "left")
            sources.append(tag)
    out = out.join(opening_stock(sales, as_of, s), "sku", "left")
    text = {
        "ledger": F.lit("closing position from the simulation run"),
        "warmup": F.concat(F.lit(f"{warmup_days}-day warm-up replay to "), F.date_format(yesterday, "dd MMM yyyy")),
    }
    source = F.lit(f"estimate of {s.opening_days:g} days of recent average demand")
    for tag in reversed(sources):
        source = F.when(F.col(f"{tag}_hand").isNotNull(), text[tag]).otherwise(source)
    hand = F.coalesce(*[F.col(f"{t}_hand") for t in sources], F.col("opening"), F.lit(0.0))
    order = F.coalesce(*[F.col(f"{t}_order") for t in sources], F.lit(0.0))
    return out.select("sku", hand.alias("on_hand"), order.alias("on_order"), source.alias("source"))


def decision_rows(
    forecasts: DataFrame, stock: DataFrame, economics: DataFrame, segments: DataFrame | None = None, s: Settings = Settings(),
) -> DataFrame:
    """Policy inputs per (as_of, SKU[, scenario]) from forecast arrays, stock and terms.

    ``forecasts`` rows: as_of, sku, daily_forecast, sigma, model and optionally the scenario
    columns.  Stock missing for a SKU counts as zero and negative stock is clipped.
    """
    keys = ["sku", "as_of"] if "as_of" in stock.columns else ["sku"]
    rows = forecasts.join(stock.select(*keys, "on_hand", "on_order"), keys, "left")
    rows = rows.join(economics.select("sku", *ECONOMICS_COLUMNS), "sku")
    level = F.lit(s.service_level)
    if segments is not None:
        rows = rows.join(segments.select("sku", "abc", "xyz", "segment"), "sku", "left")
        level = F.when(F.col("abc").isNotNull(), segment_service_level("abc", level)).otherwise(level)
    override = lambda name, other: F.coalesce(F.col(name), other) if name in rows.columns else other
    at_least_zero = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    return rows.withColumns(
        {
            "sigma_daily": F.col("sigma"),
            "on_hand": at_least_zero(override("stock_override", F.col("on_hand"))),
            "on_order": at_least_zero(F.col("on_order")),
            "lead_time_days": override("lead_override", F.lit(s.lead_days)).cast("int"),
            "review_period_days": days_to_order_day("as_of", s).cast("int"),
            "service_level": override("service_override", level),
        }
    )


def recommendations(forecasts: DataFrame, stock: DataFrame, economics: DataFrame, segments: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """Recommendations of every SKU at every decision date in ``forecasts``."""
    return recommend(decision_rows(forecasts, stock, economics, segments, s), s, build_policy(s.policy, s))


# -- policy replays -------------------------------------------------------------------------------


def review_dates(start: dt.date, end: dt.date, s: Settings = Settings()) -> Column:
    """Array of the days in a window on which an order may be placed (one literal per day)."""
    days = (start + dt.timedelta(days=i) for i in range((end - start).days + 1))
    return F.array(*[F.lit(d) for d in days if d.weekday() in s.order_days])


def settings_array(baseline_buffers, service_levels) -> Column:
    """The sweep as a literal array of (strategy, setting_name, setting_value)."""
    rows = [(BASELINE, "buffer_pct", b) for b in baseline_buffers] + [(CANDIDATE, "service_level", v) for v in service_levels]
    return F.array(*[
        F.struct(F.lit(a).alias("strategy"), F.lit(b).alias("setting_name"), F.lit(float(c)).alias("setting_value")) for a, b, c in rows
    ])


def baseline_terms(usage: DataFrame, economics: DataFrame, buffers, s: Settings = Settings()) -> DataFrame:
    """Review-day terms of the manual policy for each buffer: flat usage, no uncertainty."""
    horizon = max(s.horizon_days, s.lead_days + 7)
    rows = usage.join(economics.select("sku", *ECONOMICS_COLUMNS), "sku").withColumns(
        {
            "daily_forecast": F.array_repeat(F.greatest("usage", F.lit(0.0)), horizon), "sigma_daily": F.lit(0.0),
            "on_hand": F.lit(0.0), "on_order": F.lit(0.0), "lead_time_days": F.lit(s.lead_days),
            "review_period_days": days_to_order_day("as_of", s), "service_level": F.lit(s.service_level),
            "setting_value": F.explode(F.array(*[F.lit(float(b)) for b in buffers])),
        }
    )
    rows = with_levels(rows, par_level(s, F.col("setting_value")))
    return _terms(rows, BASELINE, "buffer_pct", s, s.baseline_shelf_life_cap)


def candidate_terms(forecasts: DataFrame, economics: DataFrame, levels, s: Settings = Settings(), segments: DataFrame | None = None) -> DataFrame:
    """Review-day terms of the forecast-driven policy for each base service level."""
    rows = forecasts.join(economics.select("sku", *ECONOMICS_COLUMNS), "sku")
    rows = rows.withColumn("setting_value", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    level = F.col("setting_value")
    if segments is not None:
        rows = rows.join(segments.select("sku", "abc"), "sku", "left")
        level = F.when(F.col("abc").isNotNull(), segment_service_level("abc", level)).otherwise(level)
    rows = rows.withColumns(
        {
            "sigma_daily": F.col("sigma"), "on_hand": F.lit(0.0), "on_order": F.lit(0.0), "lead_time_days": F.lit(s.lead_days),
            "review_period_days": days_to_order_day("as_of", s), "service_level": level,
        }
    )
    rows = with_levels(rows, build_policy(s.policy, s))
    return _terms(rows, CANDIDATE, "service_level", s, s.shelf_life_cap)


def _terms(rows: DataFrame, strategy: str, setting: str, s: Settings, enforce: bool) -> DataFrame:
    """What the fold needs on a review day; none of it depends on stock."""
    window = F.col("lead_time_days") + usable_life("shelf_life_days", s.usable_fraction)
    life = expected_demand("daily_forecast", window) if enforce else F.lit(None).cast("double")
    most = s.max_days_of_supply * F.col("mean_daily_forecast")
    return rows.select(
        "sku", F.col("as_of").alias("date"), F.lit(strategy).alias("strategy"), F.lit(setting).alias("setting_name"),
        "setting_value", F.col("target_stock").alias("target"), "reorder_point", life.alias("life_demand"),
        F.when(most > 0, most).alias("most"),
    )


REPLAY_KEYS = ["strategy", "setting_name", "setting_value", "sku"]


def run_replay(
    sales: DataFrame, terms: DataFrame, economics: DataFrame, settings: Column, start: dt.date, end: dt.date, s: Settings = Settings(),
) -> DataFrame:
    """Cost ledger of every (strategy, setting, SKU) over a window.

    ``terms`` holds review-day terms of all strategies.  The day grid is generated per SKU and
    setting; demand and terms join by key and day.
    """
    terms_of = economics.select("sku", *ECONOMICS_COLUMNS).join(opening_stock(sales, start, s), "sku", "left")
    grid = terms_of.withColumn("opening", F.coalesce("opening", F.lit(0.0))).select("*", F.inline(settings))
    grid = grid.select("*", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    demand = sales.filter(F.col("date").between(F.lit(start), F.lit(end))).select("sku", "date", F.col("units_sold").alias("demand"))
    days = grid.join(demand, ["sku", "date"], "left").join(terms, ["sku", "date", "strategy", "setting_name", "setting_value"], "left")
    days = days.withColumns({"demand": F.coalesce("demand", F.lit(0.0)), "is_review_day": is_order_day("date", s)})
    led = replay(days, REPLAY_KEYS, s)
    led = led.join(economics.select("sku", "unit_cost", "holding_cost_per_unit_per_day", "stockout_cost_per_unit"), "sku")
    return with_costs(share_order_fee(led, ["strategy", "setting_name", "setting_value"], s), s)


def frontier(ledger: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One KPI row per (strategy, setting), rounded to three places."""
    keys = ["strategy", "setting_name", "setting_value"]
    kpis = compute_kpis(ledger, keys, order_log(ledger, REPLAY_KEYS, s=s))
    return kpis.select(*keys, *[F.bround(c, 3).alias(c) for c in kpis.columns if c not in keys])


def usage_on_review_days(sales: DataFrame, start: dt.date, end: dt.date, s: Settings = Settings()) -> DataFrame:
    """Trailing average usage at every review day of a window."""
    return trailing_usage(sales, review_dates(start, end, s), s.lookback_days)


__all__ = ["base_stock", "baseline_terms", "candidate_terms", "frontier", "recommendations", "run_replay"]
