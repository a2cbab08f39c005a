"""Ordering policies, supplier constraints and order recommendations.

Input rows carry one decision each: ``as_of, sku, daily_forecast ARRAY<DOUBLE>, sigma_daily,
on_hand, on_order, lead_time_days, review_period_days, service_level`` and the economics columns.
Everything here is a projection; nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import as_col
from larder.functions.stock import (
    STOCKOUT_RISK, WASTE_RISK, expected_demand, floor_zero, inventory_position, risk_class, safety_stock,
    stockout_probability, usable_life, whole, worse_risk,
)
from larder.operators.settled import settled
from larder.settings import Settings

# Policy names as reported.
BASE_STOCK_NAME, REORDER_NAME, PAR_NAME = "Base stock (R, S)", "(s, S)", "Manual par level"


@dataclass(frozen=True)
class Levels:
    """What a policy derives from a decision row."""

    name: str
    expected: Column
    safety: Column
    target: Column
    reorder: Column
    should_order: Column


def protection_days() -> Column:
    return F.col("lead_time_days") + F.col("review_period_days")


def mean_forecast(column: str = "daily_forecast") -> Column:
    f = F.col(column)
    return F.when(F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x) / F.size(f))


def base_stock(s: Settings = Settings()) -> Levels:
    """Order up to demand over lead time and review period plus safety stock."""
    expected = expected_demand("daily_forecast", protection_days())
    safety = safety_stock("sigma_daily", protection_days(), "service_level")
    return Levels(BASE_STOCK_NAME, expected, safety, expected + safety, F.lit(None).cast("double"), F.lit(True))


def reorder_point(s: Settings = Settings()) -> Levels:
    """Same target, but only once the position has fallen to the lead-time level."""
    if s.reorder_multiplier <= 0:
        raise ValueError(f"reorder multiplier must be positive, got {s.reorder_multiplier}")
    top = base_stock(s)
    lead = F.col("lead_time_days")
    point = (expected_demand("daily_forecast", lead) + safety_stock("sigma_daily", lead, "service_level")) * s.reorder_multiplier
    return Levels(REORDER_NAME, top.expected, top.safety, top.target, point, F.col("inventory_position") <= point)


def par_level(s: Settings = Settings(), buffer=None) -> Levels:
    """Average usage times cover days, inflated by a flat buffer (a number or a column)."""
    buffer = F.lit(s.buffer) if buffer is None else as_col(buffer)
    cover = protection_days() if s.cover_days is None else F.lit(s.cover_days)
    expected = mean_forecast() * cover
    par = expected * (1.0 + buffer)
    return Levels(PAR_NAME, expected, par - expected, par, F.lit(None).cast("double"), F.lit(True))


#: A policy takes settings and returns Levels.  Add your own entry to use it.
Policy = Callable[[Settings], Levels]
POLICIES: dict[str, Policy] = {"base_stock": base_stock, "s_S": reorder_point, "par": par_level}


def build_policy(name: str, s: Settings = Settings()) -> Levels:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known: {sorted(POLICIES)}")
    return POLICIES[name](s)


def policy_input_violations(df: DataFrame) -> DataFrame:
    """Decision rows a policy cannot size, with the reason."""
    f = F.col("daily_forecast")
    reasons = F.array(
        F.when(f.isNull() | (F.size(f) == 0), "no forecast"),
        F.when(F.exists(f, lambda x: x < 0), "negative forecast"),
        F.when(F.col("lead_time_days") < 0, "negative lead time"),
        F.when(F.col("review_period_days") < 1, "review period below 1 day"),
        F.when((F.col("service_level") <= 0) | (F.col("service_level") >= 1), "service level outside (0, 1)"),
        F.when((F.col("on_hand") < 0) | (F.col("on_order") < 0), "negative stock"),
    )
    return df.withColumn("reason", F.explode(F.filter(reasons, lambda r: r.isNotNull()))).select("as_of", "sku", "reason")


def with_levels(df: DataFrame, levels: Levels) -> DataFrame:
    """Position, protection period, policy levels and the unconstrained quantity."""
    placed = settled(
        df,
        {
            "inventory_position": inventory_position("on_hand", "on_order"),
            "protection_period_days": protection_days(),
            "mean_daily_forecast": mean_forecast(),
        },
    )
    placed = settled(
        placed,
        {
            "policy": F.lit(levels.name),
            "expected_demand_protection": levels.expected,
            "safety_stock": levels.safety,
            "target_stock": levels.target,
            "reorder_point": levels.reorder,
            "should_order": levels.should_order,
        },
    )
    raw = F.when(F.col("should_order"), floor_zero(F.col("target_stock") - F.col("inventory_position"))).otherwise(0.0)
    return settled(placed, {"raw_order_quantity": raw})


def shelf_life_cap(s: Settings = Settings()) -> Column:
    """Most that can be used before the delivery expires, given what is already held or coming."""
    days = F.col("lead_time_days") + usable_life("shelf_life_days", s.usable_fraction)
    return floor_zero(expected_demand("daily_forecast", days) - F.col("inventory_position"))


def in_packs(quantity: Column, pack: Column, mode: str) -> Column:
    """Whole cases of a positive quantity; a pack of one leaves it alone."""
    if mode == "none":
        return quantity
    cases = F.rint(quantity / pack) if mode == "nearest" else F.ceil(quantity / pack).cast("double")
    return F.when(pack > 1, cases * pack).otherwise(quantity)


def constrain(df: DataFrame, s: Settings = Settings(), enforce_shelf_life: bool | None = None) -> DataFrame:
    """Shelf life, days of supply, packs, minimum order: in this order, each change recorded.

    Rounding comes after the caps, so a rounded order may exceed them, as published.
    """
    enforce = s.shelf_life_cap if enforce_shelf_life is None else enforce_shelf_life
    pack, least = F.col("pack_size").cast("double"), F.col("min_order_quantity").cast("double")
    most = s.max_days_of_supply * F.col("mean_daily_forecast")
    steps = settled(df, {"q_life": F.least("raw_order_quantity", shelf_life_cap(s)) if enforce else F.col("raw_order_quantity")})
    steps = settled(steps, {"q_supply": F.when(most > 0, F.least(F.col("q_life"), most)).otherwise(F.col("q_life"))})
    steps = settled(steps, {"q_pack": in_packs(F.col("q_supply"), pack, s.pack_rounding)})
    final = F.when(F.col("q_pack") > 0, F.greatest(F.col("q_pack"), least)).otherwise(0.0)
    steps = settled(steps, {"recommended_order_quantity": final})
    usable = usable_life("shelf_life_days", s.usable_fraction)
    # Adjustment names.
    notes = {
        "shelf_life_cap": ("raw_order_quantity", "q_life", F.concat(
            F.lit("Cut to what sells within "), whole(usable), F.lit(" days of usable life."))),
        "max_days_of_supply": ("q_life", "q_supply", F.lit(
            f"Cut to {s.max_days_of_supply:.0f} days of forecast demand.")),
        "pack_rounding": ("q_supply", "q_pack", F.concat(
            F.lit("Set to full packs of "), F.col("pack_size").cast("string"), F.lit(f" ({s.pack_rounding})."))),
        "min_order_quantity": ("q_pack", "recommended_order_quantity", F.concat(
            F.lit("Lifted to the least order of "), F.col("min_order_quantity").cast("string"), F.lit("."))),
    }
    changes = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(a).alias("before"), F.col(b).alias("after"), text.alias("note"))
        for name, (a, b, text) in notes.items()
    ])
    made = F.filter(changes, lambda x: F.abs(x["before"] - x["after"]) > 1e-9)
    return settled(steps, {"adjustments": made}).drop("q_life", "q_supply", "q_pack")


def assess(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Cover, stockout probability, projected waste, risks and money for constrained rows."""
    usable = usable_life("shelf_life_days", s.usable_fraction)
    before_expiry = expected_demand("daily_forecast", F.col("lead_time_days") + usable)
    mean, qty = F.col("mean_daily_forecast"), F.col("recommended_order_quantity")
    out = settled(
        df,
        {
            "expected_demand_horizon": F.aggregate("daily_forecast", F.lit(0.0), lambda acc, x: acc + x),
            "days_of_cover": F.when(mean > 0, F.col("on_hand") / mean),
            "stockout_probability": stockout_probability(
                "inventory_position", "expected_demand_protection", "sigma_daily", "protection_period_days"),
            "projected_waste_units": floor_zero(F.col("inventory_position") + qty - before_expiry),
            "order_value": qty * F.col("unit_cost"),
            "expected_shortfall_units": floor_zero(F.col("expected_demand_protection") - F.col("inventory_position")),
        },
    )
    stock = F.col("inventory_position") + qty
    waste_share = F.when(stock > 0, F.col("projected_waste_units") / stock).otherwise(0.0)
    out = settled(
        out,
        {
            "stockout_risk": risk_class("stockout_probability", STOCKOUT_RISK),
            "waste_risk": risk_class(waste_share, WASTE_RISK),
            "projected_stockout_cost":
                F.col("stockout_probability") * F.col("expected_shortfall_units") * F.col("stockout_cost_per_unit"),
            "projected_waste_cost": F.col("projected_waste_units") * F.col("waste_cost_per_unit"),
            "order_required": qty > 0,
        },
    )
    return settled(out, {"risk": worse_risk("stockout_risk", "waste_risk")})


def recommend(
    df: DataFrame, s: Settings = Settings(), levels: Levels | None = None, enforce_shelf_life: bool | None = None
) -> DataFrame:
    """Full recommendation per decision row."""
    levels = build_policy(s.policy, s) if levels is None else levels
    return assess(constrain(with_levels(df, levels), s, enforce_shelf_life), s)


def recommendation_table(recs: DataFrame) -> DataFrame:
    """The rounded row form used for display and storage, by decision date and SKU."""
    one = {
        "on_hand": "on_hand", "on_order": "on_order", "inventory_position": "inventory_position",
        "forecast_demand_horizon": "expected_demand_horizon", "forecast_demand_protection": "expected_demand_protection",
        "safety_stock": "safety_stock", "target_stock": "target_stock", "recommended_order": "recommended_order_quantity",
        "projected_waste_units": "projected_waste_units",
    }
    rounded = {name: F.bround(F.col(c), 1) for name, c in one.items()}
    rounded |= {
        "order_value": F.bround("order_value", 2), "days_of_cover": F.bround("days_of_cover", 2),
        "stockout_probability": F.bround("stockout_probability", 3),
    }
    return recs.select("sku", "as_of", *[c.alias(n) for n, c in rounded.items()], "risk", "model", "policy").orderBy("as_of", "sku")


def apply_overrides(recs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manager quantities beside the recommendation: ``overrides`` has ``as_of, sku, override_order``."""
    joined = recs.join(overrides.select("as_of", "sku", "override_order"), ["as_of", "sku"], "left")
    final = F.coalesce("override_order", "recommended_order_quantity")
    return joined.select(
        "as_of",
        "sku",
        F.col("recommended_order_quantity").alias("recommended_order"),
        "override_order",
        final.alias("final_order"),
        (final - F.col("recommended_order_quantity")).alias("difference"),
        (final * F.col("unit_cost")).alias("final_value"),
        F.col("override_order").isNotNull().alias("overridden"),
    )


def edited(view: DataFrame, quantity: str = "quantity", recommended: str = "recommended_order") -> DataFrame:
    """Rows whose quantity a manager moved, as override rows."""
    moved = F.abs(F.col(quantity) - F.col(recommended)) > 1e-9
    return view.filter(moved).select("as_of", "sku", F.col(quantity).alias("override_order"))


def order_sheet(view: DataFrame, recs: DataFrame) -> DataFrame:
    """What to send to the supplier: lines with something to order, largest first."""
    terms = recs.select("sku", "as_of", "pack_size", "min_order_quantity", "unit_cost")
    lines = view.filter("final_order > 0").join(terms, ["as_of", "sku"])
    return lines.select(
        F.col("as_of").cast("string").alias("order_date"),
        F.col("sku").alias("product"),
        F.rint("final_order").alias("order_units"),
        F.rint("recommended_order").alias("recommended_units"),
        F.when(F.col("overridden"), "yes").otherwise("no").alias("overridden"),
        "pack_size",
        F.col("min_order_quantity").alias("minimum_order"),
        F.bround("unit_cost", 2).alias("unit_cost"),
        F.bround("final_value", 2).alias("line_value"),
    ).orderBy("order_date", F.desc("order_units"), "product")


def order_overview(view: DataFrame, table: DataFrame) -> DataFrame:
    """Overrides view beside the recommendation table, with the quantity to place."""
    shown = table.select("as_of", "sku", F.col("on_hand").alias("current_stock"), "on_order", "model", "risk")
    return view.join(shown, ["as_of", "sku"], "left").withColumn("order_to_place", F.coalesce("override_order", "recommended_order"))


def attention(recs: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` riskiest products of each decision date, riskiest first."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("stockout_probability"), "sku"))
    return recs.filter("risk <> 'low'").withColumn("place", place).filter(F.col("place") <= n).orderBy("as_of", "place")


def overview_metrics(recs: DataFrame) -> DataFrame:
    """One row of headline counts and sums per decision date."""
    total = lambda c: F.sum(c)
    return recs.groupBy("as_of").agg(
        F.count_if(F.col("order_required")).alias("skus_requiring_orders"),
        F.count(F.lit(1)).alias("total_skus"),
        total("order_value").alias("total_order_value"),
        total("recommended_order_quantity").alias("total_order_units"),
        F.count_if(F.col("stockout_risk") == "high").alias("high_stockout_risk"),
        F.count_if(F.col("stockout_risk") == "medium").alias("medium_stockout_risk"),
        F.count_if(F.col("waste_risk") == "high").alias("high_waste_risk"),
        total("projected_waste_units").alias("projected_waste_units"),
        total("projected_waste_cost").alias("projected_waste_cost"),
        total("expected_shortfall_units").alias("projected_stockout_units"),
        total("projected_stockout_cost").alias("projected_stockout_cost"),
    )


# Measures of the base-versus-scenario table and their labels.
SIDE_BY_SIDE = {
    "inventory_position": "Inventory position",
    "expected_demand_protection": "Expected demand over protection period",
    "safety_stock": "Safety stock",
    "target_stock": "Target stock",
    "raw_order_quantity": "Raw order",
    "recommended_order_quantity": "Recommended order",
    "order_value": "Order value (£)",
}


def side_by_side(recs: DataFrame, base: str = "Base case") -> DataFrame:
    """Long table of measures: base case beside every other scenario, rounded to 0.1."""
    long = recs.unpivot(["as_of", "sku", "scenario"], list(SIDE_BY_SIDE), "key", "value")
    label = F.create_map(*[F.lit(x) for kv in SIDE_BY_SIDE.items() for x in kv])
    base_value = F.max(F.when(F.col("scenario") == base, F.col("value"))).alias("base_value")
    others = F.filter(F.collect_list(F.struct("scenario", "value")), lambda x: x["scenario"] != base)
    # At most one entry per scenario in each list.
    per = long.groupBy("as_of", "sku", "key").agg(base_value, others.alias("others"))
    rows = per.select("as_of", "sku", F.element_at(label, F.col("key")).alias("measure"), "base_value", F.inline("others"))
    return rows.select(
        "as_of", "sku", "measure", F.bround("base_value", 1).alias("base_case"), "scenario", F.bround("value", 1).alias("scenario_value")
    )
