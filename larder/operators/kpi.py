"""Outcome measures of a replay, policy comparison and matched operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.accuracy import non_zero
from larder.functions.stock import improvement_pct
from larder.operators.quality import require_columns
from larder.settings import BASELINE, CANDIDATE

# Key, label, better direction, unit, decimals.
METRIC_SPECS = (
    ("stockout_days", "Stockout days (SKU-days)", "lower_is_better", "days", 0),
    ("stockout_units", "Stockout units", "lower_is_better", "units", 0),
    ("unit_service_level", "Service level (unit fill rate)", "higher_is_better", "%", 2),
    ("day_service_level", "Service level (days without stockout)", "higher_is_better", "%", 2),
    ("waste_units", "Waste units", "lower_is_better", "units", 0),
    ("waste_share_of_supply", "Waste as share of stock received", "lower_is_better", "%", 2),
    ("waste_cost", "Waste cost", "lower_is_better", "GBP", 2),
    ("holding_cost", "Holding cost", "lower_is_better", "GBP", 2),
    ("ordering_cost", "Ordering cost", "lower_is_better", "GBP", 2),
    ("stockout_cost", "Stockout cost", "lower_is_better", "GBP", 2),
    ("total_cost", "Total cost", "lower_is_better", "GBP", 2),
    ("average_inventory_units", "Average inventory (units)", "lower_is_better", "units", 1),
    ("average_inventory_value", "Average inventory value", "lower_is_better", "GBP", 2),
    ("orders_placed", "Orders placed", "lower_is_better", "orders", 0),
)
KPI_KEYS = (*[spec[0] for spec in METRIC_SPECS], "total_demand", "total_received")
HEADLINE_KEYS = ("stockout_units", "waste_units", "unit_service_level", "total_cost", "average_inventory_units")
MONEY_KEYS = ("waste_cost", "stockout_cost", "holding_cost", "ordering_cost", "total_cost")
COSTS = ("holding_cost", "waste_cost", "stockout_cost", "ordering_cost")
LEDGER_COLUMNS = (
    "demand", "served", "stockout_units", "stockout_day", "expired_units", "closing_stock", "inventory_value", "received", *COSTS,
)


def metric_specs(spark: SparkSession) -> DataFrame:
    """The metric list as a literal table."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("key"), F.lit(label).alias("metric"),
                 F.lit(better).alias("better_when"), F.lit(unit).alias("unit"), F.lit(places).alias("places"))
        for i, (k, label, better, unit, places) in enumerate(METRIC_SPECS)
    ]))
    return spark.range(1).select(rows)


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def metric_label(key: Column) -> Column:
    """Display label; an unknown key is spaced and capitalised."""
    known = F.try_element_at(_lookup([(k, label) for k, label, *_ in METRIC_SPECS]), key)
    spaced = F.replace(key, F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))
    return F.coalesce(known, plain)


def kpi_expressions() -> list[Column]:
    demand, received, waste = F.sum("demand"), F.sum("received"), F.sum("expired_units")
    total = F.sum(F.col("holding_cost") + F.col("waste_cost") + F.col("stockout_cost") + F.col("ordering_cost"))
    parts = {
        "stockout_days": F.sum("stockout_day").cast("double"),
        "stockout_units": F.sum("stockout_units"),
        "unit_service_level": F.when(demand > 0, F.sum("served") / demand * 100.0).otherwise(100.0),
        "day_service_level": (1.0 - F.avg("stockout_day")) * 100.0,
        "waste_units": waste,
        "waste_share_of_supply": F.when(received > 0, waste / received * 100.0).otherwise(0.0),
        "waste_cost": F.sum("waste_cost"),
        "holding_cost": F.sum("holding_cost"),
        "ordering_cost": F.sum("ordering_cost"),
        "stockout_cost": F.sum("stockout_cost"),
        "total_cost": total,
        "average_inventory_units": F.avg("closing_stock"),
        "average_inventory_value": F.avg("inventory_value"),
        "total_demand": demand,
        "total_received": received,
    }
    return [c.alias(name) for name, c in parts.items()]


def compute_kpis(ledger: DataFrame, group: list[str], orders: DataFrame | None = None) -> DataFrame:
    """The KPI row of each group; the order count is NULL without an order log."""
    require_columns(ledger, LEDGER_COLUMNS)
    kpis = ledger.groupBy(*group).agg(*kpi_expressions()) if group else ledger.agg(*kpi_expressions())
    if orders is None:
        return kpis.withColumn("orders_placed", F.lit(None).cast("double"))
    if not group:
        return kpis.withColumn("orders_placed", orders.agg(F.count(F.lit(1)).cast("double")).scalar())
    counts = orders.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("orders_placed"))
    return kpis.join(counts, group, "left").withColumn("orders_placed", F.coalesce("orders_placed", F.lit(0.0)))


def kpis_by_sku(ledger: DataFrame, orders: DataFrame | None = None, group=("strategy",)) -> DataFrame:
    """Per-SKU KPIs, most expensive first."""
    return compute_kpis(ledger, [*group, "sku"], orders).orderBy(F.desc("total_cost"), *group, "sku")


DAILY_SUMS = {
    "demand": "demand", "served": "served", "stockout_units": "stockout_units", "waste_units": "expired_units",
    "closing_stock": "closing_stock", "inventory_value": "inventory_value", "total_cost": "total_cost",
}


def daily_totals(ledger: DataFrame, group=("strategy",)) -> DataFrame:
    """Site-level daily series."""
    return ledger.groupBy(*group, "date").agg(*[F.sum(c).alias(n) for n, c in DAILY_SUMS.items()])


def all_levels(ledger: DataFrame) -> DataFrame:
    """Whole run, per SKU and per day KPIs from a single pass; ``level`` tells them apart."""
    sets = [[F.col("strategy")], [F.col("strategy"), F.col("sku")], [F.col("strategy"), F.col("date")]]
    cube = ledger.groupingSets(sets, F.col("strategy"), F.col("sku"), F.col("date")).agg(
        *kpi_expressions(), F.grouping("sku").alias("no_sku"), F.grouping("date").alias("no_date")
    )
    level = F.when(F.col("no_sku") == 0, "sku").when(F.col("no_date") == 0, "day").otherwise("run")
    return cube.withColumn("level", level).drop("no_sku", "no_date")


def trailing_mean(series: DataFrame, column: str, group=("strategy",), days: int = 7) -> DataFrame:
    """Trailing mean over a daily series, partial at the start.  One row per day and group."""
    w = Window.partitionBy(*group).orderBy("date").rowsBetween(1 - days, 0)
    return series.withColumn(f"{column}_mean", F.avg(column).over(w))


def centred_mean(series: DataFrame, column: str, group=(), days: int = 7) -> DataFrame:
    """Centred mean over a daily series, NULL where the window is not full."""
    half = days // 2
    w = Window.partitionBy(*group).orderBy("date").rowsBetween(-half, half)
    return series.withColumn(f"{column}_mean", F.when(F.count(column).over(w) == days, F.avg(column).over(w)))


# -- comparison -----------------------------------------------------------------------------------


def melt_kpis(kpis: DataFrame, ids: list[str]) -> DataFrame:
    """One row per KPI."""
    present = [k for k in KPI_KEYS if k in kpis.columns]
    return kpis.unpivot(ids, present, "key", "value")


def compare(kpis: DataFrame, baseline: str = BASELINE, candidate: str = CANDIDATE) -> DataFrame:
    """Both policies side by side per KPI, with change and improvement; rounding per metric."""
    pick = lambda name: F.max(F.when(F.col("strategy") == name, F.col("value")))
    sides = melt_kpis(kpis, ["strategy"]).groupBy("key").agg(pick(baseline).alias("base"), pick(candidate).alias("other"))
    rows = metric_specs(kpis.sparkSession).join(F.broadcast(sides), "key", "left")
    places = lambda c: F.when(F.col("places") == 0, F.bround(c, 0)).when(F.col("places") == 1, F.bround(c, 1)).otherwise(F.bround(c, 2))
    gain = improvement_pct("base", "other", F.col("better_when") == "higher_is_better")
    return rows.select(
        "rank", "metric", "key", "unit", places(F.col("base")).alias("baseline"), places(F.col("other")).alias("candidate"),
        places(F.col("other") - F.col("base")).alias("absolute_change"), F.bround(gain, 1).alias("improvement_pct"), "better_when",
    )


def headline(comparison: DataFrame) -> DataFrame:
    """Improvement on the five headline KPIs."""
    return comparison.filter(F.col("key").isin(*HEADLINE_KEYS)).select("key", "improvement_pct")


def money_saved(kpis: DataFrame, baseline: str = BASELINE, candidate: str = CANDIDATE) -> DataFrame:
    """Baseline minus candidate per cost measure; a missing measure is an error."""
    require_columns(kpis, MONEY_KEYS)
    long = kpis.unpivot(["strategy"], list(MONEY_KEYS), "key", "value")
    pick = lambda name: F.sum(F.when(F.col("strategy") == name, F.col("value")))
    return long.groupBy("key").agg((pick(baseline) - pick(candidate)).alias("saved"))


def both_strategies(per_sku: DataFrame, columns, baseline: str = BASELINE, candidate: str = CANDIDATE, key: str = "sku") -> DataFrame:
    """Chosen KPIs of the two policies on one row per key, suffixed; a conditional aggregate, no self-join."""
    pick = lambda c, name: F.max(F.when(F.col("strategy") == name, F.col(c)))
    both = [pick(c, name).alias(f"{c}_{tag}") for c in columns for tag, name in (("baseline", baseline), ("candidate", candidate))]
    complete = F.count_if(F.col("strategy").isin(baseline, candidate)) == 2
    return per_sku.groupBy(key).agg(*both, complete.alias("complete")).filter("complete").drop("complete")


def indexed(comparison: DataFrame, keys=HEADLINE_KEYS) -> DataFrame:
    """KPIs with the baseline at 100."""
    ratio = 100.0 * F.col("candidate") / non_zero(F.col("baseline"))
    return comparison.filter(F.col("key").isin(*keys)).select(
        "key", "metric", F.lit(100.0).alias("baseline_indexed"), ratio.alias("candidate_indexed")
    )


def off_scale(frontier: DataFrame, measure: str = "waste_units", factor: float = 2.7, baseline: str = BASELINE, candidate: str = CANDIDATE) -> DataFrame:
    """Baseline points above ``factor`` times the candidate's maximum."""
    sweep = Window.partitionBy(F.lit(0))  # one row per parameter setting
    top = F.max(F.when(F.col("strategy") == candidate, F.col(measure))).over(sweep)
    marked = frontier.withColumn("_ceiling", top * factor)
    return marked.filter((F.col("strategy") == baseline) & (F.col(measure) > F.col("_ceiling"))).drop("_ceiling")


# -- matched operating points ---------------------------------------------------------------------


def interpolate(rows: DataFrame, is_point: Column, is_curve: Column, x: str, measures: list[str], keys: list[str] | None = None) -> DataFrame:
    """Piecewise-linear curve values at each point's ``x``; NULL outside the curve or with one point.

    Points and curve are rows of one table, told apart by the two conditions.  Each point takes its
    neighbours on the curve with two ordered passes per key, so no point meets every segment.
    Without keys the table is one sweep, a row per parameter setting.  Adds ``at_<measure>``.
    """
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    on_curve = F.when(is_curve, F.struct(F.col(x).alias("x"), *[F.col(m).alias(m) for m in measures]))
    # Range frames see curve points that share the exact x.
    below = part.orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    above = part.orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, 0)
    line = rows.withColumns({"_c": on_curve, "_n": F.count_if(is_curve).over(part)})
    near = line.withColumns({"_lo": F.last("_c", True).over(below), "_hi": F.last("_c", True).over(above)}).filter(is_point)
    x0, x1 = F.col("_lo.x"), F.col("_hi.x")
    out = {}
    for m in measures:
        y0, y1 = F.col(f"_lo.{m}"), F.col(f"_hi.{m}")
        sloped = y0 + (F.col(x) - x0) * (y1 - y0) / non_zero(x1 - x0)
        inside = x0.isNotNull() & x1.isNotNull() & (F.col("_n") >= 2)
        out[f"at_{m}"] = F.when(inside, F.when(x0 == x1, y0).otherwise(sloped))
    return near.withColumns(out).drop("_c", "_n", "_lo", "_hi")


def require_strategies(frontier: DataFrame, *names: str) -> None:
    """Raise when a policy has no points (collects the policy names of the sweep)."""
    present = {r[0] for r in frontier.select("strategy").distinct().collect()}
    missing = [n for n in names if n not in present]
    if missing:
        raise ValueError(f"frontier lacks {missing}; found {sorted(present)}")


def matched_service(frontier: DataFrame, keys: list[str] | None = None, baseline: str = BASELINE, candidate: str = CANDIDATE) -> DataFrame:
    """Waste, cost and stock of the candidate at each service level the baseline reached."""
    side = F.col("strategy")
    measures = ["waste_units", "total_cost", "average_inventory_units", "setting_value"]
    at = interpolate(frontier, side == baseline, side == candidate, "unit_service_level", measures, keys)
    at = at.filter("at_waste_units IS NOT NULL")
    cut = lambda m: F.when(F.col(m) > 0, F.bround((F.col(m) - F.col(f"at_{m}")) / F.col(m) * 100.0, 1))
    return at.select(
        *(keys or []),
        F.col("setting_value").alias("reference_setting"),
        F.bround("unit_service_level", 2).alias("matched_service_level_pct"),
        F.bround("at_setting_value", 4).alias("matched_ai_service_level_setting"),
        F.bround("waste_units", 1).alias("waste_units_baseline"),
        F.bround("at_waste_units", 1).alias("waste_units_ai"),
        cut("waste_units").alias("waste_reduction_pct"),
        F.bround("total_cost", 2).alias("total_cost_baseline"),
        F.bround("at_total_cost", 2).alias("total_cost_ai"),
        cut("total_cost").alias("cost_reduction_pct"),
        F.bround("average_inventory_units", 1).alias("avg_inventory_baseline"),
        F.bround("at_average_inventory_units", 1).alias("avg_inventory_ai"),
        cut("average_inventory_units").alias("inventory_reduction_pct"),
    )


def matched_waste(frontier: DataFrame, keys: list[str] | None = None, baseline: str = BASELINE, candidate: str = CANDIDATE) -> DataFrame:
    """Service level of the candidate at each amount of waste the baseline made."""
    side = F.col("strategy")
    at = interpolate(frontier, side == baseline, side == candidate, "waste_units", ["unit_service_level"], keys)
    at = at.filter("at_unit_service_level IS NOT NULL")
    return at.select(
        *(keys or []),
        F.col("setting_value").alias("reference_setting"),
        F.bround("waste_units", 1).alias("matched_waste_units"),
        F.bround("unit_service_level", 2).alias("service_level_baseline"),
        F.bround("at_unit_service_level", 2).alias("service_level_ai"),
        F.bround(F.col("at_unit_service_level") - F.col("unit_service_level"), 2).alias("service_level_gain_pp"),
    )


def add_cost_saved(matched: DataFrame) -> DataFrame:
    require_columns(matched, ["total_cost_baseline", "total_cost_ai"])
    return matched.withColumn("total_cost_saved", F.col("total_cost_baseline") - F.col("total_cost_ai"))


def best_matched(matched: DataFrame) -> DataFrame:
    """The matched point with the largest waste reduction."""
    row = matched.agg(F.max_by(F.struct("*"), "waste_reduction_pct").alias("r"))
    return row.select("r.*")
