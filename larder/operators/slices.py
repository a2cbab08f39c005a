"""Time slices, decision dates and scenario overrides."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.calendar import as_col, on_dates
from larder.functions.stock import whole
from larder.operators.quality import DataQualityError
from larder.settings import Settings


def history_as_of(sales: DataFrame, as_of, sku: str | None = None) -> DataFrame:
    """Rows strictly before the decision date."""
    past = sales.filter(F.col("date") < as_col(as_of))
    return past if sku is None else past.filter(F.col("sku") == sku)


def actuals_window(sales: DataFrame, start, horizon: int, sku: str | None = None) -> DataFrame:
    """Rows in ``[start, start + horizon)``."""
    d = F.col("date")
    rows = sales.filter((d >= as_col(start)) & (d < F.date_add(as_col(start), horizon)))
    return rows if sku is None else rows.filter(F.col("sku") == sku)


def horizon_rows(decisions: DataFrame, horizon: int, as_of: str = "as_of") -> DataFrame:
    """One row per decision and forecast day, with its step number from 1."""
    if horizon < 1:
        raise DataQualityError(f"horizon must be at least 1 day, got {horizon}")
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return decisions.select("*", steps).withColumn("forecast_date", F.date_add(as_of, F.col("step") - 1))


def to_wide(sales: DataFrame, skus: list[str], value: str = "units_sold") -> DataFrame:
    """Date x SKU matrix for a chosen list of SKUs (a pivot needs its column names up front)."""
    return sales.groupBy("date").pivot("sku", skus).agg(F.first(value))


def rolling_origins(sales: DataFrame, folds: int, horizon: int, min_train_days: int = 0) -> DataFrame:
    """``fold, origin``: the last fold's window ends on the last date.  Too little data fails at run time.

    The sorted date list holds one entry per calendar day, whatever the number of SKUs.
    """
    days = sales.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("days"))
    needed = horizon * folds + min_train_days
    short = F.concat(F.lit(f"need {needed} days for {folds} folds, have "), F.size("days"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    laid = days.filter(F.when(F.size("days") >= needed, F.lit(True)).otherwise(F.raise_error(short).cast("boolean")))
    at = F.size("days") - horizon * (folds - F.col("fold")) + 1
    return laid.select("days", fold).select("fold", F.element_at("days", at).alias("origin"))


def tiled_origins(as_of, first_date, lookback_days: int, s: Settings = Settings()) -> Column:
    """Array of replay origins one horizon apart, those before enough history left out."""
    n = max(1, -(-lookback_days // s.horizon_days))
    origins = [F.date_sub(as_col(as_of), s.horizon_days * k) for k in range(n, 0, -1)]
    earliest = F.date_add(as_col(first_date), s.min_history_days)
    return F.array_compact(F.array(*[F.when(o >= earliest, o) for o in origins]))


def recent_history(sales: DataFrame, days: int, as_of=None) -> DataFrame:
    """The last ``days`` observations of each SKU."""
    past = sales if as_of is None else history_as_of(sales, as_of)
    w = Window.partitionBy("sku").orderBy(F.desc("date"))
    return past.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= days).drop("recency")


def default_as_of(sales: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row: the last date whose whole horizon has been observed."""
    return sales.agg(F.date_sub(F.max("date"), s.horizon_days - 1).alias("as_of"))


def decision_range(sales: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row: the decision dates a user may pick."""
    return sales.agg(F.date_add(F.min("date"), s.min_history_days).alias("first_as_of"), F.max("date").alias("last_as_of"))


def latest_decision(df: DataFrame, column: str = "as_of") -> DataFrame:
    """Rows of the newest decision date."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def closure_rule(forecast: DataFrame, s: Settings = Settings(), day: str = "forecast_date") -> DataFrame:
    """Zero forecast and bounds on closed days; ``closed`` marks the rows changed."""
    closed = on_dates(day, s.closed_days) == 1 if s.zero_on_closed_days else F.lit(False)
    values = [c for c in ("predicted_demand", "lower_bound", "upper_bound") if c in forecast.columns]
    out = forecast.withColumn("closed", closed)
    return out.withColumns({c: F.when(F.col("closed"), F.lit(0.0)).otherwise(F.col(c)) for c in values})


def closure_dates(forecast: DataFrame, s: Settings = Settings(), keys=("as_of", "sku")) -> DataFrame:
    """Per forecast, the dates the closure rule changed; at most one horizon of dates each."""
    marked = closure_rule(forecast, s).filter("closed")
    return marked.groupBy(*keys).agg(F.array_sort(F.collect_list("forecast_date")).alias("closure_rule_applied"))


# -- scenarios ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """What-if overrides; None (or 0 for the uplift and the shift) leaves the input alone."""

    label: str = "Base case"
    demand_uplift_pct: float = 0.0
    temperature_c: float | None = None
    temperature_delta_c: float = 0.0
    promo: bool | None = None
    service_level: float | None = None
    lead_time_days: int | None = None
    current_stock: float | None = None

    def __post_init__(self) -> None:
        if self.demand_uplift_pct < -100.0:
            raise ValueError(f"a demand uplift of {self.demand_uplift_pct}% implies negative demand")


def scenario_structs(scenarios) -> Column:
    """A literal array with one struct per scenario, to be exploded onto rows."""
    def typed(value, kind):
        return F.lit(value).cast(kind)

    return F.array(*[
        F.struct(
            typed(x.label, "string").alias("scenario"),
            typed(x.demand_uplift_pct, "double").alias("demand_uplift_pct"),
            typed(x.temperature_c, "double").alias("temperature_c"),
            typed(x.temperature_delta_c, "double").alias("temperature_delta_c"),
            typed(None if x.promo is None else int(x.promo), "int").alias("promo_override"),
            typed(x.service_level, "double").alias("service_override"),
            typed(x.lead_time_days, "int").alias("lead_override"),
            typed(x.current_stock, "double").alias("stock_override"),
        )
        for x in scenarios
    ])


SCENARIO_FIELDS = (
    "scenario", "demand_uplift_pct", "temperature_c", "temperature_delta_c",
    "promo_override", "service_override", "lead_override", "stock_override",
)


def with_scenarios(df: DataFrame, scenarios) -> DataFrame:
    """Every row once per scenario: a map-side explode of a literal list."""
    return df.select("*", F.inline(scenario_structs(scenarios)))


def scenario_features(future: DataFrame) -> DataFrame:
    """Weather and promotion overrides on feature rows that carry the scenario columns."""
    return future.withColumns(
        {
            "temp_c": F.coalesce("temperature_c", "temp_c") + F.coalesce("temperature_delta_c", F.lit(0.0)),
            "promo": F.coalesce("promo_override", "promo"),
        }
    )


def scenario_forecast(forecast: DataFrame) -> DataFrame:
    """Scale forecast, bounds and sigma by the uplift; never below zero."""
    factor = 1.0 + F.coalesce("demand_uplift_pct", F.lit(0.0)) / 100.0
    negative = F.raise_error(F.lit("a demand uplift below -100% implies negative demand")).cast("double")
    factor = F.when(factor < 0, negative).otherwise(factor)
    scaled = [c for c in ("predicted_demand", "lower_bound", "upper_bound", "sigma") if c in forecast.columns]
    return forecast.withColumns({c: F.greatest(F.col(c) * factor, F.lit(0.0)) for c in scaled})


def signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("-"), whole(F.abs(x)))


def is_base_case() -> Column:
    unset = [F.col(c).isNull() for c in SCENARIO_FIELDS[4:]] + [F.col("temperature_c").isNull()]
    test = (F.col("demand_uplift_pct") == 0) & (F.col("temperature_delta_c") == 0)
    for u in unset:
        test = test & u
    return test


def scenario_changes() -> Column:
    """Array of the changes a scenario makes, in words."""
    up, fixed, shift = F.col("demand_uplift_pct"), F.col("temperature_c"), F.col("temperature_delta_c")
    lead = F.col("lead_override")
    parts = F.array(
        F.when(up != 0, F.concat(F.lit("demand adjusted by "), signed(up), F.lit("%"))),
        F.when(fixed.isNotNull(), F.concat(F.lit("temperature fixed at "), whole(fixed), F.lit("°C"))),
        F.when(shift != 0, F.concat(F.lit("temperature shifted by "), signed(shift), F.lit("°C"))),
        F.when(F.col("promo_override") == 1, "promotion forced on").when(F.col("promo_override") == 0, "promotion forced off"),
        F.when(F.col("service_override").isNotNull(),
               F.concat(F.lit("service level set to "), whole(F.col("service_override") * 100), F.lit("%"))),
        F.when(lead.isNotNull(), F.concat(F.lit("lead time set to "), lead, F.when(lead == 1, " day").otherwise(" days"))),
        F.when(F.col("stock_override").isNotNull(),
               F.concat(F.lit("current stock set to "), whole("stock_override"), F.lit(" units"))),
    )
    kept = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit("no changes (base case)"))).otherwise(kept)
