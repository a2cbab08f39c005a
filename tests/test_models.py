"""Forecast models against plain loops, the registry and the boosted model."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import features, models, slices
from larder.plans import backtest, service
from larder.settings import Settings
from larder.sources import exports

AS_OF = dt.date(2025, 5, 1)
S = Settings(perfect_foresight=True, folds=3, gbt_rounds=5, gbt_depth=3)


def series(panel, sku):
    return [r[0] for r in panel.filter((F.col("sku") == sku) & (F.col("date") < AS_OF)).orderBy("date").select("units_sold").collect()]


def forecast(panel, fn, s=S):
    state = models.series_state(panel, F.array(F.lit(AS_OF)), s)
    out = {}
    for r in fn(state, 7, s).orderBy("step").collect():
        out.setdefault(r["sku"], []).append(r["predicted_demand"])
    return out


def croston_by_hand(values, alpha, sba):
    hits = [i for i, v in enumerate(values) if v > 0]
    size, gap = values[hits[0]], hits[0] + 1.0
    for before, i in zip(hits, hits[1:]):
        size += alpha * (values[i] - size)
        gap += alpha * (i - before - gap)
    return size / max(gap, 1.0) * (1 - alpha / 2 if sba else 1)


def holt_winters_by_hand(y, a, b, g, m=7):
    level, trend = sum(y[:m]) / m, (sum(y[m:2 * m]) - sum(y[:m])) / m / m
    season, level0 = [v - sum(y[:m]) / m for v in y[:m]], None
    for v in y[m:]:
        level0, now = level, season.pop(0)
        level = a * (v - now) + (1 - a) * (level + trend)
        season.append(g * (v - level) + (1 - g) * now)
        trend = b * (level - level0) + (1 - b) * trend
    return [max(level + h * trend + season[h - 1], 0) for h in range(1, 8)]


def test_simple_models(panel):
    y = series(panel, "Smooth")
    assert forecast(panel, models.naive)["Smooth"] == [y[-1]] * 7
    assert forecast(panel, models.seasonal_naive)["Smooth"] == y[-7:]
    z = series(panel, "Spiky")
    assert forecast(panel, models.croston)["Spiky"] == pytest.approx([croston_by_hand(z, 0.1, True)] * 7)
    got = forecast(panel, lambda st, h, s: models.croston(st, h, s, "classic"))["Spiky"]
    assert got == pytest.approx([croston_by_hand(z, 0.1, False)] * 7)


def test_holt_winters_matches_the_recursion(panel):
    one = S.but(hw_alpha=(0.2,), hw_beta=(0.05,), hw_gamma=(0.1,))
    assert forecast(panel, models.holt_winters, one)["Smooth"] == pytest.approx(holt_winters_by_hand(series(panel, "Smooth"), 0.2, 0.05, 0.1))


def test_contract_and_pairs(panel):
    at = F.array(F.lit(AS_OF))
    every = models.forecast_all(panel, at, 7, S)
    assert models.contract_violations(every, 7).count() == 0
    state = models.series_state(panel, at, S)
    alone = models.naive(state, 7, S).unionByName(models.croston(state, 7, S))
    key = lambda df: sorted(map(tuple, df.select("sku", "model", "step", "predicted_demand", "upper_bound").collect()))
    assert key(alone) == key(every.filter(F.col("model").isin("Naive", "Croston (SBA)")))


def test_no_demand_and_short_series(spark):
    days = [(dt.date(2025, 4, 1) + dt.timedelta(days=i), sku, 0.0) for sku, n in (("quiet", 20), ("short", 5)) for i in range(30 - n, 30)]
    df = spark.createDataFrame(days, "date date, sku string, units_sold double")
    out = {(r["sku"], r["model"]): r for r in models.forecast_all(df, F.array(F.lit(AS_OF)), 7, S).filter("step = 1").collect()}
    assert out["quiet", "Croston"]["predicted_demand"] == 0.0 and out["quiet", "Croston"]["sigma"] == 0.0
    assert ("short", "Seasonal Naive") not in out and ("short", "ETS (Holt-Winters)") not in out and ("short", "Naive") in out


def test_own_model_joins_the_backtest(panel):
    def flat(state, horizon, s):
        rows = slices.horizon_rows(models.at_decisions(state), horizon)
        return models.finish(rows.withColumns({"predicted_demand": F.lit(10.0), "sigma": F.lit(1.0)}), "Flat", s)

    metrics = backtest.run_backtest(panel, S, models={"Flat": flat, "Naive": models.naive})
    table = backtest.improvement_vs_benchmark(backtest.summary(metrics), "Naive")
    assert {r["model"] for r in table.collect()} == {"Flat", "Naive"}
    with pytest.raises(Exception, match="is not in the table"):
        backtest.improvement_vs_benchmark(backtest.summary(metrics), "Nope").collect()


def test_routing_falls_back(panel, spark):
    choices = spark.createDataFrame([("Smooth", "ETS (Holt-Winters)"), ("Spiky", "Croston (SBA)")], "sku string, model_name string")
    early = dt.date(2025, 1, 11)  # ten days of history: too few for Holt-Winters
    out = {(r["sku"], r["model"], r["fallback"]) for r in service.forecast(panel, choices, F.array(F.lit(early)), 7, S).collect()}
    assert out == {("Smooth", "Seasonal Naive", True), ("Spiky", "Croston (SBA)", False)}


def test_boosted_model_round_trip(spark, panel, tmp_path):
    history = slices.history_as_of(panel, AS_OF)
    model, sigma = models.fit_boosted(history, S)
    assert {r["sku"] for r in sigma.collect()} == {"Smooth", "Spiky"}
    info = spark.createDataFrame([(AS_OF, history.count(), S.seed)], "as_of date, rows bigint, seed int")
    exports.save_global_model(model, info, str(tmp_path / "m"))
    loaded, about = exports.load_global_model(spark, str(tmp_path / "m"))
    assert about.first()["rows"] == history.count()
    future = features.future_features(panel, F.array(F.lit(AS_OF)), 7, S)
    a = models.boosted(model, sigma, future, S).orderBy("sku", "step").collect()
    b = models.boosted(loaded, sigma, future, S).orderBy("sku", "step").collect()
    assert a == b and len(a) == 14
    smooth = [r["predicted_demand"] for r in a if r["sku"] == "Smooth"]
    assert 80 < min(smooth) and max(smooth) < 180
