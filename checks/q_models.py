"""J, K, E7-E11, E20-E21, H2, H4, I13-I18: forecasts, scoring, segmentation, routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import panels as P
from checks.registry import block, query, shared
from larder.functions import accuracy
from larder.operators import features, models, segments, slices
from larder.plans import backtest, service
from larder.sources import exports, folder

S = P.S
A = "DATE '2001-07-02'"
FAST = {k: models.UNIVARIATE[k] for k in (models.NAIVE, models.SEASONAL, models.CROSTON, models.CROSTON_SBA)}
Z = models.interval_z(S)
FORECAST_DOUBLES = ["predicted_demand", "lower_bound", "upper_bound", "sigma", "mase_scale"]

# A backtest in SQL: state of each series at each origin from grouped aggregates, Croston in closed form.
block("bt_origins", """SELECT CAST(k AS INTEGER) AS fold, days[CAST(len(days) - 7 * (12 - k) + 1 AS BIGINT)] AS origin FROM
 (SELECT list_sort(list(DISTINCT date)) AS days FROM dense_brand), unnest(generate_series(0, 11)) AS t(k)""", "dense_brand")
block("bt_rows", """SELECT sku, date, units_sold AS u, units_sold - lag(units_sold) OVER w AS d1, units_sold - lag(units_sold, 7) OVER w AS d7, row_number() OVER w AS t
 FROM dense_brand WINDOW w AS (PARTITION BY sku ORDER BY date)""", "dense_brand")
block("bt_events", "SELECT sku, date, u, t - coalesce(lag(t) OVER w, 0) AS gap, row_number() OVER w AS k FROM bt_rows WHERE u > 0 WINDOW w AS (PARTITION BY sku ORDER BY date)", "bt_rows")


def backtest_blocks(tag: str, origins: str) -> None:
    block(f"{tag}_state", f"""SELECT origin, sku, count(*) AS n, max(date) AS last_date, arg_max(u, date) AS last_u, coalesce(stddev_samp(d1), 0) AS sd1,
 coalesce(stddev_samp(d7), 0) AS sd7, coalesce(stddev_samp(u), 0) AS sdu, avg(abs(d7)) AS scale FROM bt_rows JOIN {origins} ON date < origin GROUP BY 1, 2""", "bt_rows", origins)
    block(f"{tag}_croston", f"""SELECT e.origin, e.sku, sum(pow(0.9, e.n - e.k) * CASE WHEN e.k = 1 THEN 1 ELSE 0.1 END * e.u) AS size,
 greatest(sum(pow(0.9, e.n - e.k) * CASE WHEN e.k = 1 THEN 1 ELSE 0.1 END * e.gap), 1.0) AS gap FROM (SELECT o.origin, x.*, count(*) OVER (PARTITION BY o.origin, x.sku) AS n
 FROM bt_events x JOIN {origins} o ON x.date < o.origin) e GROUP BY 1, 2""", "bt_events", origins)
    # The date to look up is a column of its own: a plain join on two equalities, whatever the order of joins.
    block(f"{tag}_cycle", f"""SELECT s.*, CAST(h AS INTEGER) AS step, s.origin + CAST(h - 1 AS INTEGER) AS forecast_date,
 s.last_date - 6 + CAST((date_diff('day', s.last_date, s.origin) + h - 2) % 7 AS INTEGER) AS look_date FROM {tag}_state s, unnest(generate_series(1, 7)) AS t(h)""", f"{tag}_state")
    block(f"{tag}_points", f"""SELECT s.origin AS as_of, s.sku, CAST(h AS INTEGER) AS step, s.origin + CAST(h - 1 AS INTEGER) AS forecast_date, s.last_u AS p, s.sd1 AS sigma, 'Naive' AS model, s.scale
 FROM {tag}_state s, unnest(generate_series(1, 7)) AS t(h)
 UNION ALL SELECT s.origin, s.sku, s.step, s.forecast_date, r.u, s.sd7, 'Seasonal Naive', s.scale FROM {tag}_cycle s JOIN bt_rows r ON r.sku = s.sku AND r.date = s.look_date
 UNION ALL SELECT s.origin, s.sku, CAST(h AS INTEGER), s.origin + CAST(h - 1 AS INTEGER), coalesce(c.size / c.gap, 0), CASE WHEN c.size IS NULL THEN 0 ELSE s.sdu END, 'Croston', s.scale
 FROM {tag}_state s LEFT JOIN {tag}_croston c USING (origin, sku), unnest(generate_series(1, 7)) AS t(h)
 UNION ALL SELECT s.origin, s.sku, CAST(h AS INTEGER), s.origin + CAST(h - 1 AS INTEGER), coalesce(c.size / c.gap * 0.95, 0), CASE WHEN c.size IS NULL THEN 0 ELSE s.sdu END, 'Croston (SBA)', s.scale
 FROM {tag}_state s LEFT JOIN {tag}_croston c USING (origin, sku), unnest(generate_series(1, 7)) AS t(h)""", f"{tag}_state", f"{tag}_croston", f"{tag}_cycle", "bt_rows")
    block(f"{tag}_forecast", f"""SELECT as_of, sku, step, forecast_date, greatest(p, 0) AS predicted_demand, greatest(p - {Z!r} * sigma * sqrt(step), 0) AS lower_bound,
 p + {Z!r} * sigma * sqrt(step) AS upper_bound, sigma, model, scale AS mase_scale FROM {tag}_points""", f"{tag}_points")
    block(f"{tag}_scored", f"SELECT f.*, r.u AS actual FROM {tag}_forecast f JOIN bt_rows r ON r.sku = f.sku AND r.date = f.forecast_date", f"{tag}_forecast", "bt_rows")


backtest_blocks("bt", "bt_origins")
block("bt_metrics", """SELECT fold, as_of, sku, model, 100 * avg(CASE WHEN abs(actual) + abs(predicted_demand) = 0 THEN 0 ELSE 2 * abs(predicted_demand - actual) / (abs(actual) + abs(predicted_demand)) END) AS sMAPE,
 avg(abs(predicted_demand - actual)) / nullif(max(mase_scale), 0) AS MASE, 100 * sum(abs(predicted_demand - actual)) / nullif(sum(abs(actual)), 0) AS WAPE,
 avg(predicted_demand - actual) AS bias, avg(CASE WHEN actual BETWEEN lower_bound AND upper_bound THEN 1.0 ELSE 0.0 END) AS interval_coverage,
 sum(actual) AS actual_total, sum(predicted_demand) AS forecast_total FROM bt_scored JOIN bt_origins ON origin = as_of GROUP BY 1, 2, 3, 4 HAVING count(*) = 7""", "bt_scored", "bt_origins")
METRIC_DOUBLES = ["sMAPE", "MASE", "WAPE", "bias", "interval_coverage", "actual_total", "forecast_total"]


@shared
def brand(spark, d):
    return P.dense(P.daily_brand(spark, d))


@shared
def fold_state(spark, d):
    sales = brand(spark, d)
    return models.series_state(sales, features.origin_array(slices.rolling_origins(sales, 12, 7)), S)


def one(name, model, fn):
    @query(name, f"SELECT * FROM bt_forecast WHERE model = '{model}'", ["bt_forecast"], dates=["as_of", "forecast_date"], doubles=FORECAST_DOUBLES)
    def run(spark, d):
        return fn(fold_state(spark, d), 7, S)

    return run


one("j3_naive", "Naive", models.naive)
one("j4_seasonal_naive", "Seasonal Naive", models.seasonal_naive)
one("j5_croston", "Croston", lambda st, h, s: models.croston(st, h, s, "classic"))
one("j5_croston_sba", "Croston (SBA)", models.croston)


@query("j5_croston_parameters", """SELECT s.origin AS as_of, s.sku, coalesce(c.size, 0) AS smoothed_size, coalesce(c.gap, s.n) AS smoothed_interval,
 coalesce(c.size / c.gap, 0) AS rate, CASE WHEN c.size IS NULL THEN 0 ELSE s.sdu END AS sigma FROM bt_state s LEFT JOIN bt_croston c USING (origin, sku)""",
       ["bt_state", "bt_croston"], dates=["as_of"], doubles=["smoothed_size", "smoothed_interval", "rate", "sigma"])
def j5p(spark, d):
    return models.croston_parameters(fold_state(spark, d), S).select("as_of", "sku", "smoothed_size", "smoothed_interval", "rate", "sigma")


@query("h2_all_models", "SELECT * FROM bt_forecast", ["bt_forecast"], dates=["as_of", "forecast_date"], doubles=FORECAST_DOUBLES)
@shared
def h2(spark, d):
    sales = brand(spark, d)
    return models.forecast_all(sales, features.origin_array(slices.rolling_origins(sales, 12, 7)), 7, S, FAST)


@query("j9_intervals", """SELECT as_of, sku, model, step, upper_bound - predicted_demand AS width, lower_bound FROM bt_forecast""", ["bt_forecast"],
       dates=["as_of"], doubles=["width", "lower_bound"])
def j9(spark, d):
    return h2(spark, d).select("as_of", "sku", "model", "step", (F.col("upper_bound") - F.col("predicted_demand")).alias("width"), "lower_bound")


@query("j10_contract_violations", """SELECT as_of, sku, model, count(*) AS days, CAST(max(step) AS INTEGER) AS span, count(*) FILTER (predicted_demand < 0) AS bad_values,
 count(*) FILTER (lower_bound > predicted_demand) AS crossed FROM bt_forecast GROUP BY 1, 2, 3 HAVING count(*) <> 7 OR bad_values + crossed > 0""", ["bt_forecast"], dates=["as_of"])
def j10(spark, d):
    return models.contract_violations(h2(spark, d), 7)


block("bt_broken", f"""SELECT as_of, sku, model, step, forecast_date, CASE WHEN {P.NUMBER_SQL} % 7 = 1 AND step = 3 THEN -1.0 ELSE predicted_demand END AS predicted_demand,
 CASE WHEN {P.NUMBER_SQL} % 4 = 2 AND step >= 6 THEN predicted_demand + 1 ELSE least(lower_bound, -1) END AS lower_bound, upper_bound FROM bt_forecast WHERE NOT ({P.NUMBER_SQL} % 5 = 0 AND step = 4)""", "bt_forecast")


@query("j10_contract_seeded", """SELECT as_of, sku, model, count(*) AS days, CAST(date_diff('day', min(forecast_date), max(forecast_date)) + 1 AS INTEGER) AS span, count(*) FILTER (predicted_demand < 0) AS bad_values,
 count(*) FILTER (lower_bound > predicted_demand OR upper_bound < predicted_demand) AS crossed FROM bt_broken GROUP BY 1, 2, 3 HAVING count(*) <> 7 OR bad_values + crossed > 0""", ["bt_broken"], dates=["as_of"])
def j10_seeded(spark, d):
    """All forecasts, with a day missing, a negative value or a crossed bound in those of some products."""
    rows = h2(spark, d).filter(~((P.number() % 5 == 0) & (F.col("step") == 4)))
    broken = {
        "lower_bound": F.when((P.number() % 4 == 2) & (F.col("step") >= 6), F.col("predicted_demand") + 1).otherwise(F.least("lower_bound", F.lit(-1.0))),
        "predicted_demand": F.when((P.number() % 7 == 1) & (F.col("step") == 3), -1.0).otherwise(F.col("predicted_demand")),
    }
    return models.contract_violations(rows.withColumns(broken), 7)


@query("j11_total_demand", "SELECT as_of, sku, model, sum(predicted_demand) FILTER (step <= 3) AS total_demand FROM bt_forecast GROUP BY 1, 2, 3", ["bt_forecast"],
       dates=["as_of"], doubles=["total_demand"])
def j11(spark, d):
    return models.total_demand(h2(spark, d), 3)


@query("k1_i13_i18_backtest_metrics", "SELECT * FROM bt_metrics", ["bt_metrics"], dates=["as_of"], doubles=METRIC_DOUBLES)
@shared
def k1(spark, d):
    return backtest.run_backtest(brand(spark, d), S, models=FAST)


@query("k1_backtest_predictions", """SELECT fold, as_of, sku, model, step, forecast_date, predicted_demand, actual FROM bt_scored JOIN bt_origins ON origin = as_of""",
       ["bt_scored", "bt_origins"], dates=["as_of", "forecast_date"], doubles=["predicted_demand", "actual"])
def k1b(spark, d):
    p = backtest.backtest_predictions(brand(spark, d), S, FAST)
    return p.select("fold", "as_of", "sku", "model", "step", "forecast_date", "predicted_demand", "actual")


R = "round_even(avg({c}), 2) AS {c}"
MEANS = ", ".join(R.format(c=c) for c in ("sMAPE", "MASE", "WAPE", "bias", "interval_coverage"))


@query("e7_accuracy_by_model", f"SELECT model, {MEANS} FROM bt_metrics GROUP BY 1 ORDER BY sMAPE", ["bt_metrics"], doubles=METRIC_DOUBLES[:5])
def e7(spark, d):
    return backtest.summary(k1(spark, d))


@query("e7_accuracy_by_sku", f"SELECT sku, {MEANS} FROM bt_metrics GROUP BY 1 ORDER BY sMAPE", ["bt_metrics"], doubles=METRIC_DOUBLES[:5])
def e7b(spark, d):
    return backtest.summary(k1(spark, d), "sku")


@query("e8_summarise_metrics", f"SELECT model, {', '.join(R.format(c=c) for c in ('sMAPE', 'MASE', 'WAPE', 'bias'))} FROM bt_metrics GROUP BY 1", ["bt_metrics"], doubles=METRIC_DOUBLES[:4])
def e8(spark, d):
    return backtest.summarise_metrics(k1(spark, d))


@query("e9_vs_benchmark", """WITH t AS (SELECT model, round_even(avg(sMAPE), 2) AS sMAPE FROM bt_metrics GROUP BY 1)
 SELECT model, sMAPE, round_even((sMAPE - (SELECT sMAPE FROM t WHERE model = 'Seasonal Naive')) / (SELECT sMAPE FROM t WHERE model = 'Seasonal Naive') * 100, 1) AS vs_benchmark FROM t""",
       ["bt_metrics"], doubles=["sMAPE", "vs_benchmark"])
def e9(spark, d):
    return backtest.improvement_vs_benchmark(backtest.summary(k1(spark, d)).select("model", "sMAPE"))


@query("k4_headline_table", """WITH t AS (SELECT model, round_even(avg(sMAPE), 2) AS sMAPE, round_even(avg(MASE), 2) AS MASE, round_even(avg(WAPE), 2) AS WAPE FROM bt_metrics
 WHERE model IN ('Naive', 'Seasonal Naive') GROUP BY 1) SELECT *, round_even((sMAPE - (SELECT sMAPE FROM t WHERE model = 'Seasonal Naive')) /
 (SELECT sMAPE FROM t WHERE model = 'Seasonal Naive') * 100, 1) AS vs_benchmark FROM t""", ["bt_metrics"], doubles=["sMAPE", "MASE", "WAPE", "vs_benchmark"])
def k4(spark, d):
    return backtest.legacy_table(k1(spark, d))


@query("e20_largest_error_day", """SELECT sku, model, CAST(fold AS INTEGER) AS fold, w.forecast_date AS forecast_date, w.actual AS actual, w.predicted_demand AS predicted_demand, w.actual - w.predicted_demand AS error FROM (
 SELECT sku, model, fold, arg_max({forecast_date: forecast_date, actual: actual, predicted_demand: predicted_demand}, abs(actual - predicted_demand) * 1e6 - step) AS w
 FROM bt_scored JOIN bt_origins ON origin = as_of GROUP BY 1, 2, 3)""", ["bt_scored", "bt_origins"], dates=["forecast_date"], doubles=["actual", "predicted_demand", "error"])
def e20(spark, d):
    p = backtest.backtest_predictions(brand(spark, d), S, FAST)
    return backtest.largest_error_day(p)


# Decision dates are refit dates here.  The rows of the global model cannot be said in SQL; at the checked scale no series is routed to it.
block("tiled", f"SELECT {A} - CAST(7 * k AS INTEGER) AS origin FROM unnest(generate_series(1, 4)) AS t(k)")
backtest_blocks("tl", "tiled")
block("tl_choices", """SELECT origin, sku, CASE WHEN avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) >= 0.25 THEN 'Croston (SBA)' ELSE 'Gradient Boosting' END AS model_name
 FROM dense_brand JOIN tiled ON date < origin AND date >= origin - 365 GROUP BY 1, 2""", "dense_brand", "tiled")


@shared
def tiled(spark, d):
    return service.replay_accuracy(P.sales_brand(spark, d), P.econ(spark, d), P.AS_OF, 28, S)


DAILY_ACC = """SELECT forecast_date AS date, sum(actual) AS actual_units, sum(predicted_demand) AS predicted_units, sum(abs(predicted_demand - actual)) AS sku_abs_error_units,
 sum(predicted_demand) - sum(actual) AS error_units, abs(sum(predicted_demand) - sum(actual)) AS abs_error_units,
 CASE WHEN sum(actual) > 0 THEN (sum(predicted_demand) - sum(actual)) / sum(actual) * 100 END AS error_pct FROM (SELECT s.* REPLACE (CASE WHEN forecast_date IN ({closed}) THEN 0 ELSE predicted_demand END AS predicted_demand)
 FROM tl_scored s JOIN tl_choices c ON c.origin = s.as_of AND c.sku = s.sku AND c.model_name = s.model) GROUP BY 1"""
block("daily_acc", DAILY_ACC.replace("{closed}", P.C_SQL), "tl_scored", "tl_choices")


@query("k3_h4_d7_e10_daily_accuracy", "SELECT * FROM daily_acc", ["daily_acc"], dates=["date"],
       doubles=["actual_units", "predicted_units", "sku_abs_error_units", "error_units", "abs_error_units", "error_pct"])
def e10(spark, d):
    return backtest.daily_accuracy(tiled(spark, d))


@query("e11_accuracy_headline", """SELECT count(*) AS days, min(date) AS start, max(date) AS "end", 100 * sum(abs_error_units) / sum(actual_units) AS net_wape, avg(abs_error_units) AS net_mae_units,
 avg(error_units) AS bias_units, 100 * sum(sku_abs_error_units) / sum(actual_units) AS sku_wape, avg(sku_abs_error_units) AS sku_mae_units, sum(actual_units) AS total_actual,
 sum(predicted_units) AS total_predicted, arg_max(date, abs_error_units) AS worst_date, arg_max(error_units, abs_error_units) AS worst_error_units FROM daily_acc""", ["daily_acc"],
       dates=["start", '"end"', "worst_date"],
       doubles=["net_wape", "net_mae_units", "bias_units", "sku_wape", "sku_mae_units", "total_actual", "total_predicted", "worst_error_units"])
def e11(spark, d):
    return backtest.accuracy_headline(backtest.daily_accuracy(tiled(spark, d)))


# -- Holt-Winters at one grid point, against a recursive query --------------------------------------------

block("hw_rows", f"SELECT sku, units_sold AS u, row_number() OVER (PARTITION BY sku ORDER BY date) AS t FROM dense_type WHERE date < {A}", "dense_type")
block("hw", """hw(sku, t, l, b, s, sse, tot) AS (SELECT sku, CAST(7 AS BIGINT), l0, (l1 - l0) / 7, list_transform(us, lambda x: x - l0), 0.0::DOUBLE, 0.0::DOUBLE FROM (
 SELECT sku, avg(u) FILTER (t <= 7) AS l0, avg(u) FILTER (t BETWEEN 8 AND 14) AS l1, list(u ORDER BY t) FILTER (t <= 7) AS us FROM hw_rows GROUP BY sku)
 UNION ALL SELECT h.sku, h.t + 1, 0.2 * (r.u - h.s[1]) + 0.8 * (h.l + h.b),
 0.05 * (0.2 * (r.u - h.s[1]) + 0.8 * (h.l + h.b) - h.l) + 0.95 * h.b,
 list_append(h.s[2:7], 0.1 * (r.u - (0.2 * (r.u - h.s[1]) + 0.8 * (h.l + h.b))) + 0.9 * h.s[1]),
 h.sse + pow(r.u - h.l - h.b - h.s[1], 2), h.tot + (r.u - h.l - h.b - h.s[1]) FROM hw h JOIN hw_rows r ON r.sku = h.sku AND r.t = h.t + 1)""", "hw_rows")


@query("j6_holt_winters_one_point", f"""SELECT {A} AS as_of, sku, CAST(h AS INTEGER) AS step, greatest(l + h * b + s[h], 0) AS predicted_demand,
 sqrt(greatest((sse - tot * tot / (t - 7)) / (t - 8), 0)) AS sigma FROM hw, unnest(generate_series(1, 7)) AS g(h) WHERE t = (SELECT max(t) FROM hw_rows x WHERE x.sku = hw.sku)""",
       ["hw"], dates=["as_of"], doubles=["predicted_demand", "sigma"])
def j6(spark, d):
    one_point = S.but(hw_alpha=(0.2,), hw_beta=(0.05,), hw_gamma=(0.1,))
    state = models.series_state(P.dense(P.daily_type(spark, d)), F.array(F.lit(P.AS_OF)), one_point)
    return models.holt_winters(state, 7, one_point).select("as_of", "sku", "step", "predicted_demand", "sigma")


GRID = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(models.holt_winters_grid(S)))
block("hg_rows", "SELECT sku, units_sold AS u, row_number() OVER (PARTITION BY sku ORDER BY date) AS t FROM dense_brand", "dense_brand")
# All 27 points side by side, one day a step; y is what the season of the day leaves.
block("hg", f"""hg(sku, i, al, be, ga, t, l, b, s, sse, tot) AS (SELECT sku, i, al::DOUBLE, be::DOUBLE, ga::DOUBLE, CAST(7 AS BIGINT), l0, (l1 - l0) / 7, list_transform(us, lambda x: x - l0), 0.0::DOUBLE, 0.0::DOUBLE FROM (
 SELECT sku, avg(u) FILTER (t <= 7) AS l0, avg(u) FILTER (t BETWEEN 8 AND 14) AS l1, list(u ORDER BY t) FILTER (t <= 7) AS us FROM hg_rows GROUP BY sku), (VALUES {GRID}) AS v(i, al, be, ga)
 UNION ALL SELECT h.sku, h.i, h.al, h.be, h.ga, h.t + 1, h.l + h.b + h.al * (r.u - h.l - h.b - h.s[1]), h.b + h.al * h.be * (r.u - h.l - h.b - h.s[1]),
 list_append(h.s[2:7], h.s[1] + h.ga * (r.u - h.l - h.b - h.s[1]) * (1.0 - h.al)), h.sse + (r.u - h.l - h.b - h.s[1]) * (r.u - h.l - h.b - h.s[1]),
 h.tot + (r.u - h.l - h.b - h.s[1]) FROM hg h JOIN hg_rows r ON r.sku = h.sku AND r.t = h.t + 1)""", "hg_rows")
block("hg_best", """SELECT c.origin, c.sku, arg_min(h, struct_pack(e := h.sse, i := h.i)) AS h FROM (SELECT origin, sku, count(*) AS t FROM dense_brand JOIN bt_origins ON date < origin GROUP BY 1, 2) c
 JOIN hg h ON h.sku = c.sku AND h.t = c.t GROUP BY 1, 2""", "hg", "dense_brand", "bt_origins")
block("hg_points", f"""SELECT *, p + {Z!r} * sigma * sqrt(step) AS upper_bound, greatest(p - {Z!r} * sigma * sqrt(step), 0) AS lower_bound FROM (
 SELECT origin, sku, CAST(k AS INTEGER) AS step, greatest(h.l + k * h.b + h.s[k], 0) AS p, sqrt(greatest((h.sse - h.tot * h.tot / (h.t - 7)) / (h.t - 8), 0)) AS sigma
 FROM hg_best, unnest(generate_series(1, 7)) AS g(k))""", "hg_best")


@query("j6_holt_winters_grid", """SELECT origin AS as_of, sku, step, origin + CAST(step - 1 AS INTEGER) AS forecast_date, p AS predicted_demand, lower_bound, upper_bound, sigma,
 'ETS (Holt-Winters)' AS model, scale AS mase_scale FROM hg_points JOIN bt_state USING (origin, sku)""", ["hg_points", "bt_state"], dates=["as_of", "forecast_date"], doubles=FORECAST_DOUBLES)
def j6b(spark, d):
    """Every brand at all twelve origins, the best of 27 points each."""
    return models.holt_winters(fold_state(spark, d), 7, S)


block("k5_scored", """SELECT origin, sku, model, p, lower_bound, upper_bound, u AS actual, scale FROM hg_points JOIN bt_state USING (origin, sku), (VALUES ('ETS (Holt-Winters)')) AS m(model), bt_rows r
 WHERE r.sku = hg_points.sku AND r.date = origin + CAST(step - 1 AS INTEGER)
 UNION ALL SELECT as_of, sku, model, predicted_demand, lower_bound, upper_bound, actual, mase_scale FROM bt_scored""", "hg_points", "bt_state", "bt_rows", "bt_scored")


@query("k1_backtest_with_holt_winters", f"""SELECT model, {MEANS} FROM (SELECT origin, sku, model,
 100 * avg(CASE WHEN abs(actual) + abs(p) = 0 THEN 0 ELSE 2 * abs(p - actual) / (abs(actual) + abs(p)) END) AS sMAPE, avg(abs(p - actual)) / nullif(max(scale), 0) AS MASE,
 100 * sum(abs(p - actual)) / nullif(sum(abs(actual)), 0) AS WAPE, avg(p - actual) AS bias, avg(CASE WHEN actual BETWEEN lower_bound AND upper_bound THEN 1.0 ELSE 0.0 END) AS interval_coverage
 FROM k5_scored GROUP BY 1, 2, 3 HAVING count(*) = 7) GROUP BY 1""", ["k5_scored"], doubles=METRIC_DOUBLES[:5])
def k1c(spark, d):
    """Five models on every brand at twelve origins."""
    return backtest.summary(backtest.run_backtest(brand(spark, d), S, models=models.UNIVARIATE))


# -- segmentation and routing -----------------------------------------------------------------------------

block("seg_stats", f"""SELECT sku, sum(units_sold) AS total_units, avg(units_sold) AS mean_daily_demand, coalesce(stddev_samp(units_sold), 0) AS std_daily_demand,
 avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) AS zero_day_share, count(*) AS n_observations, min(date) AS lo FROM dense_brand
 WHERE date < {A} AND date >= {A} - 365 GROUP BY sku""", "dense_brand")
block("seg_value", f"""SELECT s.* EXCLUDE (lo), e.unit_cost, total_units * e.unit_cost * (365.0 / date_diff('day', (SELECT min(lo) FROM seg_stats), {A})) AS annual_value,
 CASE WHEN mean_daily_demand > 0 THEN std_daily_demand / mean_daily_demand ELSE 'inf'::DOUBLE END AS demand_cv FROM seg_stats s JOIN econ_brand e USING (sku)""", "seg_stats", "econ_brand")
block("segs", f"""SELECT *, abc || xyz AS segment, {A} AS as_of FROM (SELECT *, CASE WHEN cumulative_value_share - value_share < 0.8 THEN 'A' WHEN cumulative_value_share - value_share < 0.95 THEN 'B' ELSE 'C' END AS abc,
 CASE WHEN demand_cv < 0.5 THEN 'X' WHEN demand_cv < 1 THEN 'Y' ELSE 'Z' END AS xyz FROM (SELECT *, annual_value / sum(annual_value) OVER () AS value_share,
 sum(annual_value) OVER (ORDER BY annual_value DESC, sku ROWS UNBOUNDED PRECEDING) / sum(annual_value) OVER () AS cumulative_value_share FROM seg_value))""", "seg_value")
SEG_DOUBLES = ["total_units", "mean_daily_demand", "std_daily_demand", "zero_day_share", "unit_cost", "annual_value", "demand_cv", "value_share", "cumulative_value_share"]


@shared
def segs(spark, d):
    return segments.segment_skus(brand(spark, d), P.econ(spark, d), P.AS_OF, S)


@query("j12_f6_segmentation", "SELECT * FROM segs", ["segs"], dates=["as_of"], doubles=SEG_DOUBLES)
def j12(spark, d):
    return segs(spark, d)


DESCRIBE = """segment || ': ' || CASE abc WHEN 'A' THEN 'top-value' WHEN 'B' THEN 'mid-value' ELSE 'low-value' END || ' product, ' ||
 CASE xyz WHEN 'X' THEN 'steady demand' WHEN 'Y' THEN 'changeable demand' ELSE 'irregular demand' END"""


@query("j13_segment_description", f"SELECT sku, {DESCRIBE} AS text, zero_day_share > 0 AND xyz = 'Z' AS intermittent FROM segs", ["segs"])
def j13(spark, d):
    return segs(spark, d).select("sku", segments.describe_segment().alias("text"), segments.is_intermittent().alias("intermittent"))


@query("e14_segment_counts", "SELECT segment, count(*) AS n FROM segs GROUP BY 1", ["segs"])
def e14(spark, d):
    return segs(spark, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("e19_value_boundaries", """SELECT 'A | B' AS boundary, sqrt(min(annual_value) FILTER (abc = 'A') * max(annual_value) FILTER (abc = 'B')) AS annual_value FROM segs
 UNION ALL SELECT 'B | C', sqrt(min(annual_value) FILTER (abc = 'B') * max(annual_value) FILTER (abc = 'C')) FROM segs""", ["segs"], doubles=["annual_value"])
def e19(spark, d):
    return segments.value_boundaries(segs(spark, d))


CHOICE_SQL = f"""SELECT sku, CASE WHEN zero_day_share >= 0.25 THEN 'Croston (SBA)' WHEN days < 60 THEN 'Seasonal Naive' ELSE 'Gradient Boosting' END AS model_name,
 CASE WHEN zero_day_share >= 0.25 THEN CAST(round_even(zero_day_share * 100, 0) AS BIGINT) || '% of days without sales reach the limit of 25%: one daily rate is forecast (Croston, corrected).'
 WHEN days < 60 THEN 'History of ' || days || ' days is shorter than the 60 that the global model needs; the last cycle is repeated.'
 ELSE 'Served by the global model: ' || CASE WHEN xyz = 'X' THEN 'steady' ELSE 'changeable but regular' END || ' sales (CV ' || printf('%.2f', round_even(demand_cv, 2)) || ', ' ||
 CAST(round_even(zero_day_share * 100, 0) AS BIGINT) || '% days without sales).' END AS reason,
 segment, 'rule' AS strategy, '2001-07-02' AS selected_at FROM segs, (SELECT date_diff('day', min(date), {A}) AS days FROM dense_brand)"""
block("choices", CHOICE_SQL, "segs", "dense_brand")


@query("j14_j16_rule_choices", "SELECT * FROM choices", ["choices"])
@shared
def j14(spark, d):
    return service.choose_models(brand(spark, d), P.econ(spark, d), P.AS_OF, S).drop("candidate_scores")


@query("e14_model_counts", "SELECT model_name, count(*) AS n FROM choices GROUP BY 1", ["choices"])
def e14b(spark, d):
    return j14(spark, d).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))


@query("d11_segments_with_choice", "SELECT s.sku, s.segment, s.annual_value, c.model_name FROM segs s LEFT JOIN choices c USING (sku)", ["segs", "choices"], doubles=["annual_value"])
def d11(spark, d):
    return segs(spark, d).join(j14(spark, d).select("sku", "model_name"), "sku", "left").select("sku", "segment", "annual_value", "model_name")


block("val_origins", f"""SELECT CAST(k AS INTEGER) AS fold, days[CAST(len(days) - 7 * (4 - k) + 1 AS BIGINT)] AS origin FROM
 (SELECT list_sort(list(DISTINCT date)) AS days FROM dense_brand WHERE date < {A}), unnest(generate_series(0, 3)) AS t(k)""", "dense_brand")
backtest_blocks("vl", "val_origins")
block("val_scores", """SELECT sku, model, avg(w) AS wape FROM (SELECT as_of, sku, model, 100 * sum(abs(predicted_demand - actual)) / nullif(sum(abs(actual)), 0) AS w
 FROM vl_scored WHERE model IN ('Seasonal Naive', 'Croston (SBA)') GROUP BY 1, 2, 3 HAVING count(*) = 7) GROUP BY 1, 2 HAVING avg(w) IS NOT NULL""", "vl_scored")


@query("j15_validated_choices", f"""SELECT s.sku, r.model AS model_name, 'Least error of the candidates over 4 past periods before 2001-07-02: WAPE ' || printf('%.1f', round_even(r.wape, 1)) || '%'
 || CASE WHEN r.next_model IS NULL THEN '' ELSE ', ' || printf('%.1f', round_even(r.next_wape - r.wape, 1)) || ' points below the next (' || r.next_model || ')' END
 || '; class ' || s.segment || ' (' || split_part({DESCRIBE}, ': ', 2) || ').' AS reason, s.segment, 'validated' AS strategy, '2001-07-02' AS selected_at FROM segs s JOIN (
 SELECT sku, model, wape, lead(model) OVER w AS next_model, lead(wape) OVER w AS next_wape, row_number() OVER w AS rn FROM val_scores WINDOW w AS (PARTITION BY sku ORDER BY wape, model)) r
 ON r.sku = s.sku AND r.rn = 1""", ["segs", "val_scores"])
def j15(spark, d):
    two = {k: models.UNIVARIATE[k] for k in (models.SEASONAL, models.CROSTON_SBA)}
    return service.choose_models(brand(spark, d), P.econ(spark, d), P.AS_OF, S, "validated", 4, two).drop("candidate_scores")


block("as_of_one", f"SELECT {A} AS origin")
backtest_blocks("one", "as_of_one")
ROUTED = f"""SELECT f.as_of, f.sku, f.step, f.forecast_date, CASE WHEN f.forecast_date IN ({P.C_SQL}) THEN 0 ELSE f.predicted_demand END AS predicted_demand, f.sigma, f.model
 FROM one_forecast f JOIN choices c ON c.sku = f.sku AND f.model = CASE c.model_name WHEN 'Gradient Boosting' THEN 'Seasonal Naive' ELSE c.model_name END"""
block("routed", ROUTED, "one_forecast", "choices")


def routed(spark, d, scenarios=None):
    return service.forecast(P.sales_brand(spark, d), j14(spark, d), F.array(F.lit(P.AS_OF)), 7, S, scenarios, models=FAST)


@query("j17_routed_forecast", "SELECT * FROM routed", ["routed"], dates=["as_of", "forecast_date"], doubles=["predicted_demand", "sigma"])
def j17(spark, d):
    return routed(spark, d).select("as_of", "sku", "step", "forecast_date", "predicted_demand", "sigma", "model")


@query("j17_scenario_forecast", """SELECT as_of, sku, step, scenario, greatest(predicted_demand * (1 + up / 100), 0) AS predicted_demand FROM routed,
 (VALUES ('Base case', 0.0), ('Coach party', 25.0)) AS v(scenario, up)""", ["routed"], dates=["as_of"], doubles=["predicted_demand"])
def j17b(spark, d):
    rows = routed(spark, d, [slices.Scenario(), slices.Scenario("Coach party", demand_uplift_pct=25.0)])
    return rows.select("as_of", "sku", "step", "scenario", "predicted_demand")


@query("j19_anchored_routing", """SELECT as_of, CASE WHEN a < (SELECT min(date) + 60 FROM dense_brand) THEN as_of ELSE a END AS anchor FROM (SELECT origin AS as_of,
 DATE '2001-01-01' + CAST(7 * floor(date_diff('day', DATE '2001-01-01', origin) / 7.0) AS INTEGER) AS a FROM bt_origins)""", ["bt_origins", "dense_brand"], dates=["as_of", "anchor"])
def j19(spark, d):
    sales = brand(spark, d)
    return service.decision_anchors(slices.rolling_origins(sales, 12, 7), sales, S)


@query("a13_model_metadata", "SELECT sku, model_name, reason, segment, strategy, selected_at, '{}' AS candidate_scores FROM choices", ["choices"])
def a13(spark, d):
    from larder.sources import store

    return store.metadata_rows(service.choose_models(brand(spark, d), P.econ(spark, d), P.AS_OF, S))


@query("a7_sku_master_with_segments", """SELECT m.sku, m.category, m.shelf_life_days, m.unit_cost, m.pack_size, m.min_order_quantity, m.holding_cost_per_unit_per_day, m.waste_cost_per_unit,
 m.stockout_cost_per_unit, s.abc, s.xyz, s.segment FROM master m LEFT JOIN segs s USING (sku)""", ["master", "segs"],
       doubles=["unit_cost", "holding_cost_per_unit_per_day", "waste_cost_per_unit", "stockout_cost_per_unit"])
def a7(spark, d):
    from checks.q_sources import master
    from larder.sources import store

    return store.sku_rows(master(spark, d), segs(spark, d))


@query("a9_forecast_rows", "SELECT 'run-1' AS run_id, as_of, sku, forecast_date, predicted_demand, model FROM routed", ["routed"], dates=["as_of", "forecast_date"], doubles=["predicted_demand"])
def a9(spark, d):
    from larder.sources import store

    rows = routed(spark, d).withColumn("run_id", F.lit("run-1")).select(*store.columns_of("forecasts"))
    return store.replace_rows(None, rows, store.keys_of("forecasts")).drop("lower_bound", "upper_bound")


TREES = S.but(gbt_rounds=8, gbt_depth=4)


@query("j7_j8_boosted_forecast")
def j7(spark, d):
    """One global model over all brands, fitted before the decision date, with held-out error spread."""
    sales = P.sales_brand(spark, d)
    model, sigma = models.fit_boosted(slices.history_as_of(sales, P.AS_OF), TREES)
    future = features.future_features(sales, F.array(F.lit(P.AS_OF)), 7, TREES, sales.select("sku", "date", "promo"), features.weather_series(sales))
    return models.boosted(model, sigma, future, TREES)


@query("e21_heldout_sigma")
def e21(spark, d):
    return models.fit_boosted(slices.history_as_of(P.sales_brand(spark, d), P.AS_OF), TREES)[1]


# -- routing and the global model at refit anchors --------------------------------------------------------

DECISIONS = tuple(dt.date.fromisoformat(x) for x in ("1995-02-14", "1998-03-12", "2001-07-04", "2001-07-07"))
block("mx_decisions", f"""SELECT as_of, CASE WHEN a < (SELECT min(date) + 60 FROM dense_mixed) THEN as_of ELSE a END AS anchor FROM (SELECT as_of,
 DATE '2001-01-01' + CAST(7 * floor(date_diff('day', DATE '2001-01-01', as_of) / 7.0) AS INTEGER) AS a FROM (VALUES {", ".join(f"(DATE '{x}')" for x in DECISIONS)}) AS v(as_of))""", "dense_mixed")
block("mx_stats", """SELECT anchor, sku, sum(units_sold) AS total, avg(units_sold) AS mean, coalesce(stddev_samp(units_sold), 0) AS sd, avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) AS zero_day_share
 FROM dense_mixed JOIN (SELECT DISTINCT anchor FROM mx_decisions) ON date < anchor AND date >= anchor - 365 GROUP BY 1, 2""", "dense_mixed", "mx_decisions")
block("mx_segs", """SELECT *, CASE WHEN so_far - value < 0.8 * whole THEN 'A' WHEN so_far - value < 0.95 * whole THEN 'B' ELSE 'C' END || xyz AS segment FROM (
 SELECT *, sum(value) OVER (PARTITION BY anchor) AS whole, sum(value) OVER (PARTITION BY anchor ORDER BY value DESC, sku ROWS UNBOUNDED PRECEDING) AS so_far,
 CASE WHEN cv < 0.5 THEN 'X' WHEN cv < 1 THEN 'Y' ELSE 'Z' END AS xyz FROM (SELECT m.*, total * e.unit_cost AS value, CASE WHEN mean > 0 THEN sd / mean ELSE 'inf'::DOUBLE END AS cv
 FROM mx_stats m JOIN (SELECT sku, unit_cost FROM econ_brand UNION ALL SELECT sku, unit_cost FROM econ_type) e USING (sku)))""", "mx_stats", "econ_brand", "econ_type")
block("mx_choices", """SELECT as_of, anchor, sku, CASE WHEN zero_day_share >= 0.25 THEN 'Croston (SBA)' WHEN days < 60 THEN 'Seasonal Naive' ELSE 'Gradient Boosting' END AS model_name, segment, 'rule' AS strategy,
 zero_day_share, days, xyz, cv FROM mx_decisions JOIN mx_segs USING (anchor) JOIN (SELECT anchor, date_diff('day', (SELECT min(date) FROM dense_mixed), anchor) AS days
 FROM (SELECT DISTINCT anchor FROM mx_decisions)) USING (anchor)""", "mx_decisions", "mx_segs", "dense_mixed")


def anchored_mixed(spark, d):
    sales = P.sales_mixed(spark, d)
    origins = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in DECISIONS])).alias("origin"))
    return service.decision_anchors(origins, sales, S)


@shared
def mixed_choices(spark, d):
    return service.choose_at_anchors(P.sales_mixed(spark, d), P.econ_mixed(spark, d), anchored_mixed(spark, d), S)


@query("j14_j19_choices_by_date", "SELECT as_of, anchor, sku, model_name, segment, strategy FROM mx_choices", ["mx_choices"], dates=["as_of", "anchor"])
def j14_dates(spark, d):
    """All three rules: short history at the first date, smooth and intermittent products later."""
    return mixed_choices(spark, d).select("as_of", "anchor", "sku", "model_name", "segment", "strategy")


@query("e14_model_counts_by_date", "SELECT as_of, model_name, count(*) AS n FROM mx_choices GROUP BY 1, 2", ["mx_choices"], dates=["as_of"])
def e14_dates(spark, d):
    return mixed_choices(spark, d).groupBy("as_of", "model_name").agg(F.count(F.lit(1)).alias("n"))


# Fitted trees cannot be said in SQL; tests compare these plans with direct fits.  Eight rounds of depth 4 instead of the settings' 300 of depth 6.


@query("j17_j19_anchored_forecast")
def j17_dates(spark, d):
    """Routing, fits and forecasts from each decision's anchor; the global model serves the smooth products."""
    at = F.array(*[F.lit(x) for x in DECISIONS])
    rows = service.anchored_forecast(P.sales_mixed(spark, d), P.econ_mixed(spark, d), at, 7, TREES)
    return rows.select("as_of", "sku", "step", "forecast_date", "predicted_demand", "lower_bound", "upper_bound", "sigma", "model", "fallback")


@query("k3_routed_accuracy")
def k3_routed(spark, d):
    """Four recent origins of the routed service, the global model among its models."""
    rows = service.replay_accuracy(P.sales_mixed(spark, d), P.econ_mixed(spark, d), P.AS_OF, 28, TREES)
    return backtest.daily_accuracy(rows)


@shared
def every_model(spark, d):
    return backtest.run_backtest(P.sales_mixed(spark, d), TREES)


@query("k1_e7_every_model")
def k1_every(spark, d):
    """All six models on every product at twelve origins."""
    return backtest.summary(every_model(spark, d))


@query("k4_headline_of_four_models")
def k4_every(spark, d):
    return backtest.legacy_table(every_model(spark, d))


@query("j15_four_candidates")
def j15_every(spark, d):
    """Validated routing of every product among the global model, Holt-Winters, seasonal naive and Croston (SBA)."""
    chosen = service.choose_models(P.sales_mixed(spark, d), P.econ_mixed(spark, d), P.AS_OF, TREES, "validated", 4)
    return chosen.withColumn("candidate_scores", F.to_json("candidate_scores"))


# -- exports and registries -------------------------------------------------------------------------------


@query("a18_metrics_as_csv", "SELECT * FROM bt_metrics", ["bt_metrics"], dates=["as_of"], doubles=METRIC_DOUBLES)
def a18_csv(spark, d):
    """Backtest metrics written as CSV and read back."""
    path, metrics = folder.fresh(spark), k1(spark, d)
    exports.export(metrics, path, "csv")
    return spark.read.schema(metrics.schema).option("header", True).csv(path)


@query("a18_predictions_as_json", """SELECT fold, as_of, sku, model, step, forecast_date, predicted_demand, actual FROM bt_scored JOIN bt_origins ON origin = as_of""",
       ["bt_scored", "bt_origins"], dates=["as_of", "forecast_date"], doubles=["predicted_demand", "actual"])
def a18_json(spark, d):
    """All predictions written as JSON and read back."""
    path, rows = folder.fresh(spark), k1b(spark, d)
    exports.export(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("a19_choice_registry", "SELECT * FROM choices", ["choices"])
def a19(spark, d):
    """Model choices saved and loaded."""
    path = folder.fresh(spark)
    exports.save_choices(service.choose_models(brand(spark, d), P.econ(spark, d), P.AS_OF, S), path)
    return exports.load_choices(spark, path).drop("candidate_scores")


@query("a20_saved_global_model", f"SELECT {A} AS as_of, count(*) AS rows, 42 AS seed, {len(features.feature_columns(S))} AS features FROM sales_brand WHERE date < {A}", ["sales_brand"], dates=["as_of"])
def a20(spark, d):
    """A fitted global model saved with what it was fitted on, and loaded."""
    history, path = slices.history_as_of(P.sales_brand(spark, d), P.AS_OF), folder.fresh(spark)
    model, _ = models.fit_boosted(history, TREES, estimate_sigma=False)
    info = history.agg(F.lit(P.AS_OF).alias("as_of"), F.count(F.lit(1)).alias("rows"), F.lit(TREES.seed).alias("seed"))
    exports.save_global_model(model, info, path)
    loaded, about = exports.load_global_model(spark, path)
    return about.withColumn("features", F.lit(loaded.stages[-1].numFeatures))
