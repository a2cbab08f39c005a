"""Routed forecasts: each SKU by the model chosen for it, for any number of decision dates.

Routing and the global model belong to the refit anchor of a decision date, so a forecast does not depend on which other dates are asked
for.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.models import (
    BOOSTED, FORECAST_COLUMNS, SEASONAL, UNIVARIATE, Model, fit_rows, seasonal_naive, series_state, training_matrix,
)
from larder.operators.segments import VALIDATED_CANDIDATES, rule_choices, segment_skus, validated_choices
from larder.operators.settled import settled
from larder.operators.slices import (
    SCENARIO_FIELDS, Scenario, closure_rule, history_as_of, scenario_features, scenario_forecast, tiled_origins, with_scenarios,
)
from larder.plans.anchored import SIDE_BY_SIDE, Fits, dates_of, decision_anchors, fit_at, forecast_at, global_future
from larder.plans.backtest import run_backtest, with_actuals
from larder.settings import Settings
from larder.sources.folder import written


def kept(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Tables that many jobs of a plan read, written once: what they derive from is read, joined and broadcast once, not in each job."""
    return tuple(written(t) for t in tables)


def choose_models(
    sales: DataFrame, costs: DataFrame, as_of: dt.date, s: Settings = Settings(), strategy: str = "rule",
    folds: int = 4, candidates: dict[str, Model | None] | None = None,
) -> DataFrame:
    """One model per SKU at a decision date, by rule or by validated error.

    Candidates of the validated choice are the global model, Holt-Winters, seasonal naive and Croston (SBA) unless given.
    """
    if strategy == "validated":
        sales, costs = kept(sales, costs)
    history = history_as_of(sales, as_of)
    segments = segment_skus(sales, costs, as_of, s)
    span = history.agg(F.datediff(F.lit(as_of), F.min("date"))).scalar()
    rules = rule_choices(segments.withColumn("_days", span), F.col("_days"), as_of, s)
    if strategy == "rule":
        return rules
    if strategy != "validated":
        raise ValueError(f"strategy must be rule or validated, got {strategy!r}")
    chosen = candidates or {BOOSTED: None, **{k: UNIVARIATE[k] for k in VALIDATED_CANDIDATES}}
    metrics = run_backtest(history, s, models=chosen, folds=folds)
    return validated_choices(metrics, segments, rules, as_of, folds)


def choose_at_anchors(
    sales: DataFrame, costs: DataFrame, anchored: DataFrame, s: Settings = Settings(), strategy: str = "rule",
    folds: int = 4, candidates: dict[str, Model | None] | None = None,
) -> DataFrame:
    """``as_of, anchor`` and the columns of :func:`choose_models`: one routing per distinct anchor of ``anchored`` (as_of, anchor).

    Each routing scans only its own lookback window; they run side by side, each into a table of its own.
    """
    return _choices(*kept(sales, costs, anchored), s, strategy, folds, candidates)


def _choices(sales: DataFrame, costs: DataFrame, anchored: DataFrame, s: Settings, strategy: str, folds: int = 4, candidates: dict[str, Model | None] | None = None) -> DataFrame:
    served = dates_of(anchored)

    def choose(anchor: dt.date) -> DataFrame:
        return written(choose_models(sales, costs, anchor, s, strategy, folds, candidates).withColumn("anchor", F.lit(anchor)))

    if not served:
        raise ValueError("no decision dates are given")
    with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(served))) as pool:
        parts = list(pool.map(choose, served))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(anchored.select("as_of", "anchor"), "anchor")


def route(
    state: DataFrame, choices: DataFrame, horizon: int, s: Settings = Settings(), models: dict[str, Model] | None = None,
    served: DataFrame | None = None,
) -> DataFrame:
    """Forecasts of the univariate models for the SKUs routed to them; ``choices`` has (sku, model_name) or also as_of.

    A model runs on the series that some decision routes to it.  Where the chosen model has nothing to say (too short a history, or a
    model that returned no row) seasonal naive steps in and ``fallback`` marks its rows.  Those routed to the global model
    are left out unless ``served`` has the (as_of, sku) it answered for.
    """
    registry = UNIVARIATE if models is None else models
    keys = ["as_of", "sku"] if "as_of" in choices.columns else ["sku"]
    chosen = choices.select(*keys, F.col("model_name").alias("_model"))
    if served is None:
        chosen = chosen.filter(F.col("_model") != BOOSTED)
    own = None
    for name, fn in registry.items():
        mine = chosen.filter(F.col("_model") == name)
        rows = fn(state.join(mine.select("sku").distinct(), "sku", "left_semi"), horizon, s).join(mine.select(*keys), keys, "left_semi")
        own = rows if own is None else own.unionByName(rows)
    answered = own.select("as_of", "sku")
    if served is not None:
        answered = answered.unionByName(served)
    planned = chosen.filter(F.col("_model").isin(*registry, *([BOOSTED] if served is not None else [])) & (F.col("_model") != SEASONAL))
    rest = seasonal_naive(state.join(planned.select("sku").distinct(), "sku", "left_semi"), horizon, s)
    rest = rest.join(planned.select(*keys), keys, "left_semi").join(answered.distinct(), ["as_of", "sku"], "left_anti")
    both = own.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))
    return both.select(*FORECAST_COLUMNS, "fallback")


def forecast(
    sales: DataFrame, choices: DataFrame, origins: Column, horizon: int, s: Settings = Settings(),
    scenarios: list[Scenario] | None = None, global_model=None, models: dict[str, Model] | None = None,
) -> DataFrame:
    """Routed forecasts with the closure rule and scenario uplifts applied.

    ``choices`` has one model per SKU, or per (as_of, SKU) as :func:`choose_at_anchors` returns it.  ``global_model`` is the (pipeline,
    sigma table) pair of :func:`fit_boosted` for all dates or a dict of them by refit anchor; without it the global model is fitted
    at the anchors of the decision dates, if a SKU is routed to it.
    """
    (sales,) = kept(sales)
    return _forecast(sales, choices, origins, horizon, s, scenarios, global_model, models)


def _forecast(
    sales: DataFrame, choices: DataFrame, origins: Column, horizon: int, s: Settings, scenarios: list[Scenario] | None = None,
    global_model=None, models: dict[str, Model] | None = None,
) -> DataFrame:
    state = series_state(sales, origins, s)
    labels = [x for x in (scenarios or [Scenario()])]
    choices = written(choices)
    routed = choices.filter(F.col("model_name") == BOOSTED)
    if routed.isEmpty():
        return scenario_forecast(closure_rule(with_scenarios(route(state, choices, horizon, s, models), labels), s))
    decisions = sales.sparkSession.range(1).select(F.explode(origins).alias("origin"))
    anchored = written(decision_anchors(decisions, sales, s))
    served = dates_of(anchored)
    if global_model is None:
        fits: Fits = fit_at(training_matrix(sales, s), served, s)
    elif isinstance(global_model, dict):
        fits = {anchor: global_model[anchor] for anchor in served}
    else:
        fits = dict.fromkeys(served, global_model)
    keys = ["as_of", "sku"] if "as_of" in choices.columns else ["sku"]
    future = global_future(sales, anchored, horizon, s).join(routed.select(*keys).distinct(), keys, "left_semi")
    future = scenario_features(with_scenarios(future, labels))
    trees = written(forecast_at(fits, served, future, s, carry=SCENARIO_FIELDS).withColumn("fallback", F.lit(False)))
    rows = with_scenarios(route(state, choices, horizon, s, models, trees.select("as_of", "sku").distinct()), labels)
    return scenario_forecast(closure_rule(rows.unionByName(trees), s))


def anchored_forecast(
    sales: DataFrame, costs: DataFrame, origins: Column, horizon: int, s: Settings = Settings(), strategy: str = "rule",
    scenarios: list[Scenario] | None = None, models: dict[str, Model] | None = None,
) -> DataFrame:
    """Routing and forecasts of every decision date from its refit anchor."""
    return _anchored(*kept(sales, costs), origins, horizon, s, strategy, scenarios, models)


def _anchored(
    sales: DataFrame, costs: DataFrame, origins: Column, horizon: int, s: Settings, strategy: str,
    scenarios: list[Scenario] | None = None, models: dict[str, Model] | None = None,
) -> DataFrame:
    decisions = sales.sparkSession.range(1).select(F.explode(origins).alias("origin"))
    anchored = written(decision_anchors(decisions, sales, s))
    return _forecast(sales, _choices(sales, costs, anchored, s, strategy), origins, horizon, s, scenarios, models=models)


def replay_accuracy(
    sales: DataFrame, costs: DataFrame, as_of, lookback_days: int = 28, s: Settings = Settings(), strategy: str = "rule",
    models: dict[str, Model] | None = None,
) -> DataFrame:
    """What the service would have forecast for the recent past, from origins one horizon apart, with what was sold."""
    sales, costs = kept(sales, costs)
    first = sales.agg(F.min("date")).scalar()
    rows = _anchored(sales, costs, tiled_origins(F.lit(as_of), first, lookback_days, s), s.horizon_days, s, strategy, models=models)
    return with_actuals(rows, sales, F.date_sub(F.lit(as_of), lookback_days + s.horizon_days))


def fit_at_anchor(sales: DataFrame, as_of: dt.date, s: Settings = Settings(), grid_start: dt.date | None = None):
    """The global model that serves one decision date."""
    origins = sales.sparkSession.range(1).select(F.lit(as_of).alias("origin"))
    (anchor,) = dates_of(decision_anchors(origins, sales, s, grid_start))
    return fit_rows(training_matrix(history_as_of(sales, anchor), s), s)


def daily_arrays(forecast_rows: DataFrame, keys=("as_of", "sku")) -> DataFrame:
    """One row per forecast with its days as an array (at most one horizon long)."""
    point = F.array_sort(F.collect_list(F.struct("step", "predicted_demand")))
    extra = [F.first(c).alias(c) for c in ("model", "sigma") if c in forecast_rows.columns]
    per = forecast_rows.groupBy(*keys).agg(point.alias("p"), *extra)
    return settled(per, {"daily_forecast": F.transform("p", lambda x: x["predicted_demand"])}).drop("p")


__all__ = [
    "anchored_forecast", "choose_at_anchors", "choose_models", "daily_arrays", "decision_anchors", "fit_at_anchor", "forecast",
    "replay_accuracy", "route",
]
