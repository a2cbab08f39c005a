"""Forecast drivers and their wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import panels as P
from checks.q_features import month_origins
from checks.q_models import FAST, TREES, brand, h2
from checks.q_ordering import f1, w
from checks.registry import block, query, shared
from larder.operators import explain, features, models, slices

S = P.S
# A fixed linear rule stands in for the fitted model, so that SQL can say what every contribution is.
RULE = {"weekend": 5.0, "bank_holiday": 8.0, "school_holiday": -2.0, "is_closed": -30.0, "promo": 6.0, "temp_c": 0.4, "dow": 1.5, "lag7": 0.3, "lag14": 0.2, "roll28": 0.4}
# Days to look up are columns of a table that stands before the joins: both equalities of a join name the same two tables.
block("fut_days", """fut_days AS MATERIALIZED (SELECT o.origin, s.*, s.date - 7 AS week_before, s.date - 14 AS two_before
 FROM (SELECT origin, origin + CAST(h AS INTEGER) AS day FROM month_origins, unnest(generate_series(0, 6)) AS t(h)) o JOIN sales_brand s ON s.date = o.day)""", "month_origins", "sales_brand")
block("fut_means", """fut_means AS MATERIALIZED (SELECT o.origin, x.sku, avg(x.units_sold) AS roll28
 FROM (SELECT origin, origin - CAST(h AS INTEGER) AS day FROM month_origins, unnest(generate_series(1, 28)) AS t(h)) o JOIN dense_brand x ON x.date = o.day GROUP BY 1, 2)""", "month_origins", "dense_brand")
block("fut7", f"""SELECT s.origin AS as_of, s.sku, s.date, a.units_sold AS lag7, b.units_sold AS lag14, r.roll28, s.temp_c, s.promo, s.weekend, s.dow, s.bank_holiday, s.school_holiday,
 CASE WHEN s.date IN ({P.C_SQL}) THEN 1 ELSE 0 END AS is_closed FROM fut_days s
 JOIN dense_brand a ON a.sku = s.sku AND a.date = s.week_before JOIN dense_brand b ON b.sku = s.sku AND b.date = s.two_before
 JOIN fut_means r ON r.origin = s.origin AND r.sku = s.sku""", "fut_days", "fut_means", "dense_brand")
block("refs", "SELECT sku, avg(temp_c) AS ref_temp_c, avg(units_sold) AS long_run FROM sales_brand WHERE date < DATE '2001-01-01' GROUP BY 1", "sales_brand")
REF = {k: "0.0" for k in ("weekend", "bank_holiday", "school_holiday", "is_closed", "promo")} | {"dow": "2.0", "temp_c": "ref_temp_c", "lag7": "long_run", "lag14": "long_run", "roll28": "long_run"}
X_SQL = "20 + " + " + ".join(f"({c}) * {f}" for f, c in RULE.items())
N_SQL = "20 + " + " + ".join(f"({c}) * {REF[f]}" for f, c in RULE.items())
block("explained", f"SELECT *, {X_SQL} AS predicted, {N_SQL} AS reference_prediction FROM fut7 JOIN refs USING (sku)", "fut7", "refs")
block("all_drivers", " UNION ALL ".join(
    f"SELECT as_of, sku, date, predicted, reference_prediction, '{f}' AS feature, '{features.FEATURE_LABELS[f]}' AS label, CAST({f} AS DOUBLE) AS value, CAST({REF[f]} AS DOUBLE) AS reference_value, ({c}) * ({f} - {REF[f]}) AS contribution_units FROM explained"
    for f, c in RULE.items()), "explained")
block("drivers", """SELECT * EXCLUDE (cd, cw) FROM (SELECT *, max(abs(contribution_units)) FILTER (feature = 'dow') OVER p AS cd, max(abs(contribution_units)) FILTER (feature = 'weekend') OVER p AS cw
 FROM all_drivers WINDOW p AS (PARTITION BY as_of, sku, date)) WHERE NOT (feature = 'dow' AND cd <= cw) AND NOT (feature = 'weekend' AND cw < cd)""", "all_drivers")
DD = ["predicted", "reference_prediction", "value", "reference_value", "contribution_units"]


@shared
def future(spark, d):
    sales = P.sales_brand(spark, d)
    return features.future_features(sales, month_origins(), 7, S, sales.select("sku", "date", "promo"), features.weather_series(sales))


@shared
def reference(spark, d):
    return explain.reference_day(slices.history_as_of(P.sales_brand(spark, d), P.START), S)


@shared
def all_drivers(spark, d):
    rows = explain.ablation_rows(future(spark, d), reference(spark, d), S)
    value = F.lit(20.0)
    for f, c in RULE.items():
        value = value + F.col(f) * c
    return explain.contributions(rows.withColumn("prediction", value), S)


@shared
def drivers(spark, d):
    return explain.one_calendar_driver(all_drivers(spark, d))


@query("m1_reference_day", """SELECT sku, ref_temp_c, long_run AS ref_lag7, long_run AS ref_lag14, long_run AS ref_roll28, 0.0::DOUBLE AS ref_weekend, 0.0::DOUBLE AS ref_bank_holiday, 0.0::DOUBLE AS ref_school_holiday,
 0.0::DOUBLE AS ref_is_closed, 0.0::DOUBLE AS ref_promo, 2.0::DOUBLE AS ref_dow FROM refs""", ["refs"],
       doubles=["ref_temp_c", "ref_lag7", "ref_lag14", "ref_roll28", *[f"ref_{c}" for c in ("weekend", "bank_holiday", "school_holiday", "is_closed", "promo", "dow")]])
def m1(spark, d):
    return reference(spark, d)


@query("m2_ablation_contributions", "SELECT * FROM all_drivers", ["all_drivers"], dates=["as_of", "date"], doubles=DD)
def m2(spark, d):
    return all_drivers(spark, d)


@query("m2_m7_boosted_drivers")
def m2b(spark, d):
    """Drivers of the fitted global model, one row per forecast day and feature."""
    sales = P.sales_brand(spark, d)
    model, _ = models.fit_boosted(slices.history_as_of(sales, P.START), TREES, estimate_sigma=False)
    rows = explain.ablation_rows(future(spark, d), reference(spark, d), S)
    predicted = model.transform(rows.drop("raw", "features")).withColumn("prediction", F.greatest("raw_prediction", F.lit(0.0)))
    return explain.one_calendar_driver(explain.contributions(predicted, S))


@query("m3_one_calendar_driver", "SELECT * FROM drivers", ["drivers"], dates=["as_of", "date"], doubles=DD)
def m3(spark, d):
    return drivers(spark, d)


@query("m4_unexplained_units", """SELECT as_of, sku, date, max(predicted) AS predicted, max(reference_prediction) AS reference_prediction, max(predicted) - max(reference_prediction) - sum(contribution_units) AS unexplained_units
 FROM drivers GROUP BY 1, 2, 3""", ["drivers"], dates=["as_of", "date"], doubles=["predicted", "reference_prediction", "unexplained_units"])
def m4(spark, d):
    return explain.unexplained(drivers(spark, d))


TOP = "(SELECT *, row_number() OVER (PARTITION BY as_of, sku, date ORDER BY abs(contribution_units) DESC, feature) AS rank FROM drivers)"


@query("g2_top_drivers", f"SELECT as_of, sku, date, CAST(rank AS INTEGER) AS rank, feature, abs(contribution_units) AS size FROM {TOP} WHERE rank <= 4", ["drivers"], dates=["as_of", "date"], doubles=["size"])
def g2(spark, d):
    return explain.top_drivers(drivers(spark, d), 4).select("as_of", "sku", "date", "rank", "feature", F.abs("contribution_units").alias("size"))


@query("e13_m7_aggregate_drivers", "SELECT as_of, sku, feature, label, sum(contribution_units) AS contribution_units FROM drivers GROUP BY 1, 2, 3, 4", ["drivers"], dates=["as_of"], doubles=["contribution_units"])
def e13(spark, d):
    return explain.aggregate_drivers(drivers(spark, d))


SAY = f"""CASE feature WHEN 'weekend' THEN CASE WHEN value <> 0 THEN 'Weekend trading (Fri-Sun)' ELSE 'Trading from Monday to Thursday' END WHEN 'bank_holiday' THEN CASE WHEN value <> 0 THEN 'Public holiday' ELSE 'No public holiday' END
 WHEN 'school_holiday' THEN CASE WHEN value <> 0 THEN 'Schools closed' ELSE 'Schools open' END WHEN 'is_closed' THEN CASE WHEN value <> 0 THEN 'No trading that day' ELSE 'Open as usual' END
 WHEN 'promo' THEN CASE WHEN value <> 0 THEN 'On promotion' ELSE 'At normal price' END WHEN 'temp_c' THEN 'Temperature ' || {w('value')} || '°C (usually ' || {w('reference_value')} || '°C)'
 WHEN 'dow' THEN 'Falls on ' || ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][CAST(value AS INTEGER) + 1] WHEN 'lag7' THEN 'Sold a week before: ' || {w('value')} || ' units'
 WHEN 'lag14' THEN 'Sold two weeks before: ' || {w('value')} || ' units' ELSE 'Four-week mean: ' || {w('value')} || ' units/day' END || '; this ' || CASE WHEN contribution_units > 0 THEN 'adds' ELSE 'removes' END ||
 ' some ' || {w('abs(contribution_units)')} || ' units.'"""


@query("m5_driver_sentences", f"SELECT as_of, sku, date, feature, {SAY} AS text FROM drivers", ["drivers"], dates=["as_of", "date"])
def m5(spark, d):
    return drivers(spark, d).select("as_of", "sku", "date", "feature", explain.describe_driver().alias("text"))


HEAD = f"""strftime(date, '%d %b') || ' (' || strftime(date, '%A') || CASE WHEN date IN ({P.H_SQL}) THEN ', bank holiday' ELSE '' END ||
 CASE WHEN {P.SCHOOL_SQL.format(d='date')} = 1 THEN ', school holiday' ELSE '' END || CASE WHEN date IN ({P.C_SQL}) THEN ', site closed' ELSE '' END || ')' ||
 ': expecting ' || {w('predicted')} || ' units; a neutral day would see ' || {w('reference_prediction')} || '. Main drivers:'"""


# Sizes are brought to seven decimals on both sides, so that equal drivers come in the order of their names.
@query("m5_narratives", f"""SELECT as_of, sku, date, any_value(h) || string_agg(chr(10) || '  - ' || t, '' ORDER BY rank) AS narrative FROM (
 SELECT as_of, sku, date, {SAY} AS t, {HEAD} AS h, row_number() OVER (PARTITION BY as_of, sku, date ORDER BY round(abs(contribution_units), 7) DESC, feature) AS rank FROM drivers) GROUP BY 1, 2, 3""",
       ["drivers"], dates=["as_of", "date"])
def m5b(spark, d):
    """Narratives over all drivers, as text."""
    rounded = drivers(spark, d).withColumn("contribution_units", F.round("contribution_units", 7))
    return explain.narratives(rounded, 10, S)


@query("m6_croston_notes", f"""SELECT origin AS as_of, sku, 'Croston (SBA)' AS model, 'Sales come in bursts, so one daily rate is forecast. Typical sale: ' || {f1('size')} || ' units, about every ' || {f1('gap')}
 || ' days; rate ' || printf('%.2f', round_even(size / gap * 0.95, 2)) || ' units a day (Croston, corrected). Dates, weather and prices play no part.' AS note
 FROM bt_croston""", ["bt_croston"], dates=["as_of"])
def m6(spark, d):
    sales = brand(spark, d)
    state = models.series_state(sales, features.origin_array(slices.rolling_origins(sales, 12, 7)), S)
    return explain.croston_note(models.croston_parameters(state, S))


@query("m6_simple_notes", """SELECT as_of, sku, model, arg_min(predicted_demand, step) AS predicted, avg(predicted_demand) AS reference_prediction, CASE model WHEN 'Naive' THEN 'Last observed day, carried forward.'
 WHEN 'Seasonal Naive' THEN 'Each weekday as in the last cycle.' ELSE 'Model: ' || model || '.' END AS note FROM bt_forecast GROUP BY 1, 2, 3""", ["bt_forecast"],
       dates=["as_of"], doubles=["predicted", "reference_prediction"])
def m6b(spark, d):
    return explain.simple_note(h2(spark, d))


@query("j18_future_frame", f"""SELECT as_of, sku, date, scenario, CAST(coalesce(fixed, temp_c) AS DOUBLE) AS temp_c, CAST(coalesce(forced, promo) AS INTEGER) AS promo, lag7, lag14, roll28 FROM fut7, (VALUES ('Base case', NULL, NULL), ('Warm promo', 25.0, 1)) AS v(scenario, fixed, forced)""",
       ["fut7"], dates=["as_of", "date"], doubles=["temp_c", "lag7", "lag14", "roll28"])
def j18(spark, d):
    rows = slices.with_scenarios(future(spark, d), [slices.Scenario(), slices.Scenario("Warm promo", temperature_c=25.0, promo=True)])
    return slices.scenario_features(rows).select("as_of", "sku", "date", "scenario", "temp_c", "promo", "lag7", "lag14", "roll28")
