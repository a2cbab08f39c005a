"""Routing, global models and their forecasts belong to refit anchors; the backtest has every model."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import features, models, slices
from larder.plans import anchored, backtest, service
from larder.settings import Settings

S = Settings(gbt_rounds=3, gbt_depth=2, gbt_min_leaf=5, sigma_tail_days=14, folds=2, perfect_foresight=True)
DATES = [dt.date(2025, 2, 10), dt.date(2025, 4, 8), dt.date(2025, 4, 10), dt.date(2025, 4, 17)]
KEY = ("as_of", "sku", "step")


def same(row, other):
    for name, value in row.asDict().items():
        if isinstance(value, float):
            assert value == pytest.approx(other[name], rel=1e-9), name
        else:
            assert value == other[name], name


def at(*dates):
    return F.array(*[F.lit(d) for d in dates])


@pytest.fixture(scope="module")
def costs(spark):
    return spark.createDataFrame([("Smooth", 2.0), ("Spiky", 1.0)], "sku string, unit_cost double")


@pytest.fixture(scope="module")
def served(panel, costs):
    rows = service.anchored_forecast(panel, costs, at(*DATES), 7, S)
    return {tuple(r[k] for k in KEY): r.asDict() for r in rows.collect()}


def test_anchors_lie_on_the_grid_and_give_way_to_short_history(spark, panel):
    origins = spark.createDataFrame([(d,) for d in DATES], "origin date")
    got = anchored.dates_of(anchored.decision_anchors(origins, panel, S))
    assert got == {DATES[0]: [DATES[0]], dt.date(2025, 4, 8): DATES[1:3], dt.date(2025, 4, 15): [DATES[3]]}


def test_all_three_rules_choose(panel, costs, spark, served):
    origins = spark.createDataFrame([(d,) for d in DATES], "origin date")
    choices = service.choose_at_anchors(panel, costs, anchored.decision_anchors(origins, panel, S), S).collect()
    assert {(r["as_of"], r["sku"]): r["model_name"] for r in choices} == {
        **{(d, "Spiky"): models.CROSTON_SBA for d in DATES}, (DATES[0], "Smooth"): models.SEASONAL, **{(d, "Smooth"): models.BOOSTED for d in DATES[1:]},
    }
    assert len({r["reason"].split()[0] for r in choices}) == 3
    assert {(k[0], k[1]): r["model"] for k, r in served.items()} == {(r["as_of"], r["sku"]): r["model_name"] for r in choices}
    assert not any(r["fallback"] for r in served.values())
    assert len(served) == len(DATES) * 2 * 7


@pytest.mark.parametrize("asked", [DATES[2:3], DATES[1:], DATES[3:] + DATES[:1]])
def test_forecasts_do_not_depend_on_the_dates_asked_for(panel, costs, served, asked):
    rows = service.anchored_forecast(panel, costs, at(*sorted(asked)), 7, S).collect()
    assert len(rows) == len(asked) * 14
    for r in rows:
        same(r, served[tuple(r[k] for k in KEY)])


def test_forecasts_see_nothing_from_the_decision_on(panel, costs, served):
    day = DATES[2]
    later = panel.withColumn("units_sold", F.when(F.col("date") >= F.lit(day), 1e6).otherwise(F.col("units_sold")))
    for r in service.anchored_forecast(later, costs, at(day), 7, S).collect():
        same(r, served[tuple(r[k] for k in KEY)])


def test_a_fit_at_an_anchor_is_the_fit_on_its_history(panel, served):
    anchor, day = dt.date(2025, 4, 8), DATES[2]
    model, sigma = models.fit_boosted(slices.history_as_of(panel, anchor), S)
    future = features.future_features(panel, at(day), 7, S, panel.select("sku", "date", "promo"), features.weather_series(panel))
    direct = {r["step"]: r for r in models.boosted(model, sigma, future, S).filter("sku = 'Smooth'").collect()}
    for step, r in direct.items():
        mine = served[day, "Smooth", step]
        assert (mine["predicted_demand"], mine["sigma"]) == pytest.approx((r["predicted_demand"], r["sigma"]))
    pair = service.fit_at_anchor(panel, day, S)
    again = models.boosted(*pair, future, S).filter("sku = 'Smooth'").collect()
    assert {r["step"]: r["predicted_demand"] for r in again} == pytest.approx({k: r["predicted_demand"] for k, r in direct.items()})


def test_a_global_model_without_an_answer_falls_back(panel, spark):
    short = panel.filter((F.col("sku") == "Smooth") | (F.col("date") >= F.lit(dt.date(2025, 4, 1))))
    choices = spark.createDataFrame([("Smooth", models.BOOSTED), ("Spiky", models.BOOSTED)], "sku string, model_name string")
    rows = service.forecast(short, choices, at(DATES[2]), 7, S).collect()
    assert {(r["sku"], r["model"], r["fallback"]) for r in rows} == {("Smooth", models.BOOSTED, False), ("Spiky", models.SEASONAL, True)}
    with pytest.raises(ValueError, match="history is too short"):
        service.forecast(panel, choices, at(dt.date(2025, 1, 20)), 7, S)


def test_scenarios_reach_both_kinds_of_models(panel, costs, served):
    labels = [slices.Scenario(), slices.Scenario("More", demand_uplift_pct=50.0), slices.Scenario("Promo", promo=True)]
    rows = service.anchored_forecast(panel, costs, at(DATES[2]), 7, S, scenarios=labels).collect()
    assert len(rows) == 3 * 14
    for r in rows:
        base = served[tuple(r[k] for k in KEY)]["predicted_demand"]
        if r["scenario"] != "Promo":
            assert r["predicted_demand"] == pytest.approx(base * (1.5 if r["scenario"] == "More" else 1.0))


@pytest.fixture(scope="module")
def scored(panel):
    return backtest.backtest_predictions(panel, S).collect()


def test_the_backtest_has_every_model(panel, scored):
    assert {(r["model"], r["sku"], r["fold"]) for r in scored} == {(m, k, f) for m in models.EVERY for k in ("Smooth", "Spiky") for f in (0, 1)}
    alone = backtest.backtest_predictions(panel, S, models.UNIVARIATE).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in scored if r["model"] != models.BOOSTED)
    assert {r["mase_scale"] for r in scored if r["model"] == models.BOOSTED} == {r["mase_scale"] for r in alone}
    one = backtest.backtest_predictions(panel, S, skus=panel.filter("sku = 'Spiky'").select("sku").distinct())
    assert {(r["model"], r["sku"]) for r in one.collect()} == {(m, "Spiky") for m in models.EVERY}
    metrics = backtest.run_backtest(panel, S)
    assert {r["model"] for r in backtest.legacy_table(metrics).collect()} == {"Naive", "Seasonal Naive", "ETS (Holt-Winters)", "Gradient Boosting"}


def test_each_fold_is_fitted_before_its_origin(panel, scored):
    for fold, origin in {(r["fold"], r["as_of"]) for r in scored}:
        model, sigma = models.fit_boosted(slices.history_as_of(panel, origin), S)
        future = features.future_features(panel, at(origin), 7, S, panel.select("sku", "date", "promo"), features.weather_series(panel))
        direct = {(r["sku"], r["step"]): r["predicted_demand"] for r in models.boosted(model, sigma, future, S).collect()}
        mine = {(r["sku"], r["step"]): r["predicted_demand"] for r in scored if r["fold"] == fold and r["model"] == models.BOOSTED}
        assert mine == pytest.approx(direct)


def test_validated_routing_compares_four_candidates(panel, costs):
    chosen = service.choose_models(panel, costs, DATES[3], S, "validated", 2).collect()
    four = {models.BOOSTED, models.HOLT_WINTERS, models.SEASONAL, models.CROSTON_SBA}
    for r in chosen:
        assert set(r["candidate_scores"]) == four and r["strategy"] == "validated"
        assert r["candidate_scores"][r["model_name"]] == min(r["candidate_scores"].values())


def test_recent_accuracy_is_that_of_the_service(panel, costs):
    rows = service.replay_accuracy(panel, costs, dt.date(2025, 5, 6), 14, S).collect()
    assert {(r["sku"], r["model"]) for r in rows} == {("Smooth", models.BOOSTED), ("Spiky", models.CROSTON_SBA)}
    assert {r["as_of"] for r in rows} == {dt.date(2025, 4, 22), dt.date(2025, 4, 29)} and len(rows) == 28
    sold = {(r["sku"], r["date"]): r["units_sold"] for r in panel.collect()}
    assert all(r["actual"] == sold[r["sku"], r["forecast_date"]] for r in rows)


def test_the_grid_of_holt_winters_is_its_points_one_by_one(panel):
    wide = S.but(hw_alpha=(0.1, 0.4), hw_beta=(0.0, 0.1), hw_gamma=(0.05, 0.2))
    state = models.series_state(panel, at(*DATES), wide)
    best = {(r["as_of"], r["sku"]): r["fit"] for r in models.holt_winters_states(state, wide).collect()}
    single = {}
    for a, b, g in models.holt_winters_grid(wide):
        for r in models.holt_winters_states(state, S.but(hw_alpha=(a,), hw_beta=(b,), hw_gamma=(g,))).collect():
            single.setdefault((r["as_of"], r["sku"]), []).append(r["fit"])
    assert len(best) == 8
    assert best == {k: min(v, key=lambda f: (f["sse"], f["alpha"], f["beta"], f["gamma"])) for k, v in single.items()}
