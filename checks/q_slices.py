"""C: time slices, decision dates, scenarios; G and H where they belong to slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import panels as P
from checks.registry import block, query
from larder.functions import calendar as cal
from larder.operators import features, slices
from larder.plans import service

S = P.S
A = "DATE '2001-07-02'"
MONTHS = "(SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS as_of FROM daily_type)"


def month_starts(spark, d):
    return P.daily_type(spark, d).select(F.trunc("date", "month").alias("as_of")).distinct()


@query("c1_history_as_of", f"SELECT sku, date, units_sold FROM daily_type WHERE date < {A}", ["daily_type"], dates=["date"], doubles=["units_sold"])
def c1(spark, d):
    return slices.history_as_of(P.daily_type(spark, d), P.AS_OF)


@query("c2_actuals_window", f"SELECT sku, date, units_sold FROM daily_type WHERE date >= {A} AND date < {A} + 28", ["daily_type"],
       dates=["date"], doubles=["units_sold"])
def c2(spark, d):
    return slices.actuals_window(P.daily_type(spark, d), P.AS_OF, 28)


@query("c3_horizon_rows", f"""SELECT as_of, CAST(step AS INTEGER) AS step, as_of + CAST(step - 1 AS INTEGER) AS forecast_date
 FROM {MONTHS}, unnest(generate_series(1, 7)) AS t(step)""", ["daily_type"], dates=["as_of", "forecast_date"])
def c3(spark, d):
    return slices.horizon_rows(month_starts(spark, d), 7)


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("c4_wide_matrix", "SELECT date, " + ", ".join(f"max(units_sold) FILTER (sku = '{t}') AS {t}" for t in TYPES) + " FROM daily_type GROUP BY date",
       ["daily_type"], dates=["date"], doubles=TYPES)
def c4(spark, d):
    return slices.to_wide(P.daily_type(spark, d), TYPES)


block("origins", """SELECT CAST(k AS INTEGER) AS fold, days[CAST(len(days) - 7 * (12 - k) + 1 AS BIGINT)] AS origin FROM
 (SELECT list_sort(list(DISTINCT date)) AS days FROM daily_type), unnest(generate_series(0, 11)) AS t(k)""", "daily_type")


@query("c5_rolling_origins", "SELECT * FROM origins", ["origins"], dates=["origin"])
def c5(spark, d):
    return slices.rolling_origins(P.daily_type(spark, d), 12, 7)


@query("c6_recent_history", f"""SELECT sku, date, units_sold FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS rn
 FROM daily_brand WHERE date < {A}) WHERE rn <= 30""", ["daily_brand"], dates=["date"], doubles=["units_sold"])
def c6(spark, d):
    return slices.recent_history(P.daily_brand(spark, d), 30, P.AS_OF)


@query("c7_refit_anchor", f"""SELECT as_of, CASE WHEN a < (SELECT min(date) + 60 FROM daily_type) THEN as_of ELSE a END AS anchor FROM
 (SELECT as_of, DATE '2001-01-01' + CAST(7 * floor(date_diff('day', DATE '2001-01-01', as_of) / 7.0) AS INTEGER) AS a FROM {MONTHS})""",
       ["daily_type"], dates=["as_of", "anchor"])
def c7(spark, d):
    origins = month_starts(spark, d).withColumnRenamed("as_of", "origin")
    return service.decision_anchors(origins, P.daily_type(spark, d), S)


@query("c8_tiled_origins", f"""SELECT as_of, as_of - CAST(7 * k AS INTEGER) AS origin FROM {MONTHS}, unnest(generate_series(1, 5)) AS t(k)
 WHERE as_of - CAST(7 * k AS INTEGER) >= (SELECT min(date) + 60 FROM daily_type)""", ["daily_type"], dates=["as_of", "origin"])
def c8(spark, d):
    first = P.daily_type(spark, d).agg(F.min("date")).scalar()
    rows = month_starts(spark, d).withColumn("first", first)
    return rows.select("as_of", F.explode(slices.tiled_origins(F.col("as_of"), F.col("first"), 30, S)).alias("origin"))


@query("c9_default_as_of", "SELECT max(date) - 6 AS as_of FROM daily_type", ["daily_type"], dates=["as_of"])
def c9(spark, d):
    return slices.default_as_of(P.daily_type(spark, d), S)


SCENARIOS = [
    slices.Scenario(),
    slices.Scenario("Hot week", temperature_c=30.0, promo=True, demand_uplift_pct=15.0),
    slices.Scenario("Cold snap", temperature_delta_c=-4.0, promo=False, demand_uplift_pct=-10.0, service_level=0.9),
    slices.Scenario("Late supplier", lead_time_days=4, current_stock=120.0),
]
SC_SQL = """(SELECT * FROM (VALUES ('Base case', 0.0, NULL, 0.0, NULL), ('Hot week', 15.0, 30.0, 0.0, 1), ('Cold snap', -10.0, NULL, -4.0, 0),
 ('Late supplier', 0.0, NULL, 0.0, NULL)) AS v(scenario, uplift, fixed, delta, forced))"""


@query("c10_d13_scenario_features", f"""SELECT sku, date, scenario, CAST(coalesce(fixed, temp_c) + delta AS DOUBLE) AS temp_c, CAST(coalesce(forced, promo) AS INTEGER) AS promo
 FROM sales_type, {SC_SQL}""", ["sales_type"], dates=["date"], doubles=["temp_c"])
def c10(spark, d):
    future = P.sales_type(spark, d).select("sku", "date", "temp_c", "promo")
    return slices.scenario_features(slices.with_scenarios(future, SCENARIOS)).select("sku", "date", "scenario", "temp_c", "promo")


@query("c11_scenario_forecast", f"""SELECT sku, date, scenario, greatest(units_sold * (1 + uplift / 100), 0.0) AS predicted_demand,
 greatest(units_sold * 0.5 * (1 + uplift / 100), 0.0) AS lower_bound FROM sales_type, {SC_SQL}""", ["sales_type"], dates=["date"],
       doubles=["predicted_demand", "lower_bound"])
def c11(spark, d):
    f = P.sales_type(spark, d).select("sku", "date", F.col("units_sold").alias("predicted_demand"), (F.col("units_sold") * 0.5).alias("lower_bound"))
    out = slices.scenario_forecast(slices.with_scenarios(f, SCENARIOS))
    return out.select("sku", "date", "scenario", "predicted_demand", "lower_bound")


@query("c12_scenario_descriptions", """SELECT sku, scenario, is_base, text FROM (SELECT DISTINCT sku FROM daily_type), (VALUES
 ('Base case', true, 'no changes (base case)'),
 ('Hot week', false, 'demand adjusted by +15%; temperature fixed at 30°C; promotion forced on'),
 ('Cold snap', false, 'demand adjusted by -10%; temperature shifted by -4°C; promotion forced off; service level set to 90%'),
 ('Late supplier', false, 'lead time set to 4 days; current stock set to 120 units')) AS v(scenario, is_base, text)""", ["daily_type"])
def c12(spark, d):
    rows = slices.with_scenarios(P.daily_type(spark, d).select("sku").distinct(), SCENARIOS)
    return rows.select("sku", "scenario", slices.is_base_case().alias("is_base"), F.array_join(slices.scenario_changes(), "; ").alias("text"))


@query("c13_closure_rule", f"""SELECT sku, date AS forecast_date, date IN ({P.C_SQL}) AS closed, CASE WHEN date IN ({P.C_SQL}) THEN 0.0 ELSE units_sold END AS predicted_demand
 FROM daily_type""", ["daily_type"], dates=["forecast_date"], doubles=["predicted_demand"])
def c13(spark, d):
    f = P.daily_type(spark, d).select("sku", F.col("date").alias("forecast_date"), F.col("units_sold").alias("predicted_demand"))
    return slices.closure_rule(f, S)


@query("c13_closure_dates", f"""SELECT sku, array_to_string(list_sort(list(CAST(date AS VARCHAR))), ',') AS dates FROM daily_type WHERE date IN ({P.C_SQL}) GROUP BY sku""",
       ["daily_type"])
def c13b(spark, d):
    f = P.daily_type(spark, d).select("sku", F.col("date").alias("forecast_date"), F.col("units_sold").alias("predicted_demand"))
    return slices.closure_dates(f, S, ["sku"]).select("sku", F.array_join(F.col("closure_rule_applied").cast("array<string>"), ",").alias("dates"))


@query("c18_weather_series", "SELECT date, min(temp_c) AS temp_c FROM gappy_type GROUP BY date", ["gappy_type"], dates=["date"], doubles=["temp_c"])
def c18(spark, d):
    return features.weather_series(P.gappy_type(spark, d))


@query("c18_climatology", f"SELECT avg(temp_c) AS temp_c FROM (SELECT date, min(temp_c) AS temp_c FROM gappy_type GROUP BY date) WHERE date < {A}",
       ["gappy_type"], doubles=["temp_c"])
def c18b(spark, d):
    return features.climatology(features.weather_series(P.gappy_type(spark, d)), P.AS_OF)


@query("c19_promo_calendar", "SELECT date, sku, promo FROM sales_type", ["sales_type"], dates=["date"])
def c19(spark, d):
    return P.sales_type(spark, d).select("date", "sku", "promo")


@query("c20_latest_decision", "SELECT sku, date, units_sold FROM daily_type WHERE date = (SELECT max(date) FROM daily_type)", ["daily_type"],
       dates=["date"], doubles=["units_sold"])
def c20(spark, d):
    return slices.latest_decision(P.daily_type(spark, d), "date")


@query("c21_decision_range", "SELECT min(date) + 60 AS first_as_of, max(date) AS last_as_of FROM daily_type", ["daily_type"],
       dates=["first_as_of", "last_as_of"])
def c21(spark, d):
    return slices.decision_range(P.daily_type(spark, d), S)


@query("g1_panel_order", "SELECT sku, date, units_sold FROM daily_type ORDER BY sku, date", ["daily_type"], dates=["date"], doubles=["units_sold"])
def g1(spark, d):
    return P.daily_type(spark, d).orderBy("sku", "date")


# -- I1-I10: calendar -------------------------------------------------------------------------------

DAYS = "(SELECT DISTINCT date FROM daily_type)"
CAL_SQL = f"""SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS dow, CASE WHEN isodow(date) >= 5 THEN 1 ELSE 0 END AS weekend,
 CASE WHEN date IN ({P.H_SQL}) THEN 1 ELSE 0 END AS bank_holiday, {P.SCHOOL_SQL.format(d='date')} AS school_holiday,
 CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month, CASE WHEN date IN ({P.C_SQL}) THEN 1 ELSE 0 END AS is_closed FROM {DAYS}"""
block("calendar", CAL_SQL, "daily_type")


def days(spark, d):
    return P.daily_type(spark, d).select("date").distinct()


@query("i1_i6_calendar_block", "SELECT * FROM calendar", ["calendar"], dates=["date"])
def i6(spark, d):
    return days(spark, d).withColumns(cal.calendar_columns("date", S))


@query("i4_school_holidays", f"SELECT date, {P.SCHOOL_SQL.format(d='date')} AS school FROM {DAYS}", ["daily_type"], dates=["date"])
def i4(spark, d):
    return days(spark, d).withColumn("school", cal.is_school_holiday("date"))


@query("i7_day_label", """SELECT date, strftime(date, '%d %b') || ' (' || strftime(date, '%A') || CASE WHEN bank_holiday = 1 THEN ', bank holiday' ELSE '' END
 || CASE WHEN school_holiday = 1 THEN ', school holiday' ELSE '' END || CASE WHEN is_closed = 1 THEN ', site closed' ELSE '' END || ')' AS label FROM calendar""",
       ["calendar"], dates=["date"])
def i7(spark, d):
    return days(spark, d).withColumn("label", cal.day_label("date", S))


@query("i8_i9_next_order_date", """SELECT date, date + CAST(CASE dow WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS INTEGER) AS next_with_today,
 date + CAST(CASE dow WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS INTEGER) AS next_after,
 CAST(CASE dow WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS INTEGER) AS review_days FROM calendar""",
       ["calendar"], dates=["date", "next_with_today", "next_after"])
def i8(spark, d):
    return days(spark, d).select(
        "date", cal.next_order_date("date", S, True).alias("next_with_today"), cal.next_order_date("date", S, False).alias("next_after"),
        cal.days_to_order_day("date", S).alias("review_days"))


@query("i10_horizon_highlights", """SELECT a.date, CASE WHEN max(b.weekend) = 1 THEN 'a weekend' ELSE '' END ||
 CASE WHEN max(b.bank_holiday) = 1 THEN '|a bank holiday (' || strftime(min(b.date) FILTER (b.bank_holiday = 1), '%d %b') || ')' ELSE '' END ||
 CASE WHEN max(b.school_holiday) = 1 THEN '|school holidays' ELSE '' END AS text
 FROM calendar a JOIN calendar b ON b.date BETWEEN a.date AND a.date + 6 WHERE a.date <= (SELECT max(date) - 6 FROM calendar) GROUP BY a.date""", ["calendar"], dates=["date"])
def i10(spark, d):
    all_days = days(spark, d)
    last = all_days.agg(F.date_sub(F.max("date"), 6)).scalar()
    return all_days.filter(F.col("date") <= last).select("date", F.array_join(cal.horizon_highlights("date", 7, S), "|").alias("text"))
