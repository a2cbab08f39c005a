"""Policies, orders and their reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import panels as P
from checks.q_features import cdf_sql, month_origins, quantile_sql
from checks.q_models import DESCRIBE, backtest_blocks, brand, segs
from checks.registry import block, half_even, query, shared
from larder.functions import stock
from larder.operators import explain, features, models, ordering, slices
from larder.plans import decisions, service

S = P.S
A = "DATE '2001-07-02'"
backtest_blocks("mo", "month_origins")


def ed_sql(f: str, n: str) -> str:
    """Expected demand over the first n days of a list."""
    return f"""CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} < len({f}) + 1 THEN coalesce(list_sum({f}[1:CAST(floor({n}) AS BIGINT)]), 0.0)
 + ({n} - floor({n})) * coalesce({f}[CAST(floor({n}) AS BIGINT) + 1], list_avg({f})) ELSE list_sum({f}) + ({n} - len({f})) * list_avg({f}) END"""


REVIEW = "CASE isodow(as_of) - 1 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END"
block("arrays", """SELECT as_of, sku, list(predicted_demand ORDER BY step) AS f, max(sigma) AS sigma, 'Seasonal Naive' AS model FROM mo_forecast
 WHERE model = 'Seasonal Naive' GROUP BY 1, 2""", "mo_forecast")
block("dense_usage", """SELECT o.origin AS as_of, s.sku, avg(units_sold) FILTER (s.date >= o.origin - 28) AS usage
 FROM dense_brand s JOIN month_origins o ON s.date < o.origin GROUP BY 1, 2""", "dense_brand", "month_origins")
block("stock", f"SELECT as_of, sku, usage * 2 AS on_hand, CAST({P.NUMBER_SQL} % 3 * 10 AS DOUBLE) AS on_order, usage FROM dense_usage", "dense_usage")
block("dec", f"""SELECT a.as_of, a.sku, a.f, a.sigma AS sigma_daily, a.model, s.on_hand, s.on_order, s.on_hand + s.on_order AS pos, s.usage, 2 AS lead, {REVIEW.replace('as_of', 'a.as_of')} AS review,
 least(greatest(0.95 + CASE g.abc WHEN 'A' THEN 0.02 WHEN 'B' THEN 0.0 ELSE -0.03 END, 0.5), 0.995) AS level, e.* EXCLUDE (sku), g.abc, g.xyz, g.segment
 FROM arrays a JOIN stock s USING (as_of, sku) JOIN econ_brand e ON e.sku = a.sku JOIN segs g ON g.sku = a.sku""", "arrays", "stock", "econ_brand", "segs")
block("dec_levels", f"""SELECT *, list_avg(f) AS mean, {ed_sql('f', '(lead + review)')} AS expected, greatest({quantile_sql('level')} * sigma_daily * sqrt(lead + review), 0) AS safety,
 {ed_sql('f', 'lead')} AS lead_demand, greatest({quantile_sql('level')} * sigma_daily * sqrt(lead), 0) AS lead_safety, {ed_sql('f', '(lead + shelf_life_days)')} AS life_demand, list_sum(f) AS horizon_demand FROM dec""", "dec")
block("dec_raw", "SELECT *, expected + safety AS target, greatest(expected + safety - pos, 0) AS raw FROM dec_levels", "dec_levels")
block("dec_life", "SELECT *, least(raw, greatest(life_demand - pos, 0)) AS q1 FROM dec_raw", "dec_raw")
block("dec_supply", "SELECT *, CASE WHEN mean > 0 THEN least(q1, 14 * mean) ELSE q1 END AS q2 FROM dec_life", "dec_life")
block("dec_pack", "SELECT *, CASE WHEN pack_size > 1 THEN round_even(q2 / pack_size, 0) * pack_size ELSE q2 END AS q3 FROM dec_supply", "dec_supply")
block("dec_final", "SELECT *, CASE WHEN q3 > 0 THEN greatest(q3, min_order_quantity) ELSE 0 END AS q FROM dec_pack", "dec_pack")
X = "((pos - expected) / (sigma_daily * sqrt(lead + review)))"
block("dec_prob", f"""SELECT *, CASE WHEN sigma_daily <= 0 THEN CASE WHEN pos < expected THEN 1.0 ELSE 0.0 END ELSE 1 - ({cdf_sql(X)}) END AS prob,
 greatest(pos + q - life_demand, 0) AS waste, greatest(expected - pos, 0) AS shortfall, CASE WHEN mean > 0 THEN on_hand / mean END AS cover FROM dec_final""", "dec_final")
block("dec_risk", """SELECT *, CASE WHEN prob >= 0.25 THEN 'high' WHEN prob >= 0.1 THEN 'medium' ELSE 'low' END AS stockout_risk,
 CASE WHEN w >= 0.15 THEN 'high' WHEN w >= 0.05 THEN 'medium' ELSE 'low' END AS waste_risk FROM (SELECT *, CASE WHEN pos + q > 0 THEN waste / (pos + q) ELSE 0 END AS w FROM dec_prob)""", "dec_prob")
block("rec", """SELECT *, CASE WHEN 'high' IN (stockout_risk, waste_risk) THEN 'high' WHEN 'medium' IN (stockout_risk, waste_risk) THEN 'medium' ELSE 'low' END AS risk FROM dec_risk""", "dec_risk")


@shared
def forecast_arrays(spark, d, scenarios=None):
    state = models.series_state(brand(spark, d), month_origins(), S)
    rows = models.seasonal_naive(state, 7, S)
    return service.daily_arrays(rows)


@shared
def stock_rows(spark, d):
    usage = features.trailing_usage(brand(spark, d), month_origins(), 28)
    return usage.select("as_of", "sku", (F.col("usage") * 2).alias("on_hand"), (P.number() % 3 * 10).cast("double").alias("on_order"),
                        F.col("usage").alias("recent_average"))


@shared
def inputs(spark, d, s=S):
    rows = decisions.decision_rows(forecast_arrays(spark, d), stock_rows(spark, d), P.econ(spark, d), segs(spark, d), s)
    return rows


@shared
def recs(spark, d, s=S):
    rows = decisions.decision_rows(forecast_arrays(spark, d), stock_rows(spark, d), P.econ(spark, d), segs(spark, d), s)
    usage = stock_rows(spark, d).select("as_of", "sku", "recent_average")
    return ordering.recommend(rows.join(usage, ["as_of", "sku"]), s)


# -- scalar functions over every day of the panel --------------------------------------------------------


@query("i19_safety_stock", f"SELECT sku, date, greatest({quantile_sql('p')} * units_sold * sqrt(4), 0) AS ss FROM (SELECT *, 0.4 + length(sku) / 16.0 AS p FROM daily_brand)",
       ["daily_brand"], dates=["date"], doubles=["ss"])
def i19(spark, d):
    level = 0.4 + F.length("sku") / 16.0
    return P.daily_brand(spark, d).select("sku", "date", stock.safety_stock("units_sold", F.lit(4), level).alias("ss"))


@query("i20_safety_stock_variable_lead", f"""SELECT sku, date, greatest({quantile_sql('p')} * sqrt(3 * 25 + pow(units_sold * 0.5, 2)), 0) AS ss FROM (SELECT *, 0.9 AS p FROM daily_brand)""",
       ["daily_brand"], dates=["date"], doubles=["ss"])
def i20(spark, d):
    ss = stock.safety_stock_variable_lead(F.lit(5.0), F.lit(3), F.lit(0.9), F.col("units_sold"), F.lit(0.5))
    return P.daily_brand(spark, d).select("sku", "date", ss.alias("ss"))


@query("i21_expected_demand", f"""SELECT as_of, sku, {ed_sql('f', '2.5')} AS d25, {ed_sql('f', '7.5')} AS d75, {ed_sql('f', '10.25')} AS d1025, {ed_sql('f', '0')} AS d0 FROM arrays""",
       ["arrays"], dates=["as_of"], doubles=["d25", "d75", "d1025", "d0"])
def i21(spark, d):
    ed = lambda n: stock.expected_demand("daily_forecast", F.lit(n))
    return forecast_arrays(spark, d).select("as_of", "sku", ed(2.5).alias("d25"), ed(7.5).alias("d75"), ed(10.25).alias("d1025"), ed(0.0).alias("d0"))


@query("i22_inventory_position", "SELECT as_of, sku, pos FROM dec", ["dec"], dates=["as_of"], doubles=["pos"])
def i22(spark, d):
    return inputs(spark, d).select("as_of", "sku", stock.inventory_position("on_hand", "on_order").alias("pos"))


@query("i23_i24_shelf_life_cap", f"""SELECT as_of, sku, greatest(shelf_life_days * 0.8, 1) AS usable, greatest({ed_sql('f', '(lead + greatest(shelf_life_days * 0.8, 1))')} - pos, 0) AS cap FROM dec""",
       ["dec"], dates=["as_of"], doubles=["usable", "cap"])
def i23(spark, d):
    s = S.but(usable_fraction=0.8)
    rows = ordering.with_levels(inputs(spark, d), ordering.base_stock(s))
    return rows.select("as_of", "sku", stock.usable_life("shelf_life_days", 0.8).alias("usable"), ordering.shelf_life_cap(s).alias("cap"))


@query("i25_pack_rounding", """SELECT sku, date, CASE WHEN units_sold <= 0 THEN 0 ELSE round_even(units_sold / 12, 0) * 12 END AS nearest,
 CASE WHEN units_sold <= 0 THEN 0 ELSE ceil(units_sold / 12) * 12 END AS up FROM daily_brand""", ["daily_brand"], dates=["date"], doubles=["nearest", "up"])
def i25(spark, d):
    f = lambda mode: stock.round_to_pack("units_sold", F.lit(12), mode)
    return P.daily_brand(spark, d).select("sku", "date", f("nearest").alias("nearest"), f("up").alias("up"))


@query("i26_i27_risk_classes", """SELECT as_of, sku, stockout_risk, waste_risk, risk FROM rec""", ["rec"], dates=["as_of"])
def i26(spark, d):
    return recs(spark, d).select("as_of", "sku", "stockout_risk", "waste_risk", "risk")


@query("i28_segment_service_level", "SELECT sku, least(greatest(0.98 + CASE abc WHEN 'A' THEN 0.02 WHEN 'B' THEN 0 ELSE -0.03 END, 0.5), 0.995) AS level FROM segs", ["segs"], doubles=["level"])
def i28(spark, d):
    return segs(spark, d).select("sku", stock.segment_service_level("abc", F.lit(0.98)).alias("level"))


@query("i31_projected_costs", """SELECT as_of, sku, shortfall AS expected_shortfall_units, prob * shortfall * stockout_cost_per_unit AS projected_stockout_cost,
 waste * waste_cost_per_unit AS projected_waste_cost FROM rec""", ["rec"], dates=["as_of"], doubles=["expected_shortfall_units", "projected_stockout_cost", "projected_waste_cost"])
def i31(spark, d):
    return recs(spark, d).select("as_of", "sku", "expected_shortfall_units", "projected_stockout_cost", "projected_waste_cost")


# -- policies ---------------------------------------------------------------------------------------------

LEVELS = ["expected_demand_protection", "safety_stock", "target_stock", "raw_order_quantity"]


@query("l1_l5_base_stock_levels", """SELECT as_of, sku, expected AS expected_demand_protection, safety AS safety_stock, target AS target_stock, raw AS raw_order_quantity FROM dec_raw""",
       ["dec_raw"], dates=["as_of"], doubles=LEVELS)
def l1(spark, d):
    return ordering.with_levels(inputs(spark, d), ordering.base_stock(S)).select("as_of", "sku", *LEVELS)


@query("l2_reorder_point_levels", """SELECT as_of, sku, target AS target_stock, (lead_demand + lead_safety) * 1.2 AS reorder_point, pos <= (lead_demand + lead_safety) * 1.2 AS should_order,
 CASE WHEN pos <= (lead_demand + lead_safety) * 1.2 THEN raw ELSE 0 END AS raw_order_quantity FROM dec_raw""", ["dec_raw"], dates=["as_of"],
       doubles=["target_stock", "reorder_point", "raw_order_quantity"])
def l2(spark, d):
    s = S.but(policy="s_S", reorder_multiplier=1.2)
    return ordering.with_levels(inputs(spark, d), ordering.build_policy("s_S", s)).select("as_of", "sku", "target_stock", "reorder_point", "should_order", "raw_order_quantity")


@query("l3_par_levels", """SELECT as_of, sku, mean * (lead + review) AS expected_demand_protection, mean * (lead + review) * 0.2 AS safety_stock, mean * (lead + review) * 1.2 AS target_stock,
 greatest(mean * (lead + review) * 1.2 - pos, 0) AS raw_order_quantity FROM dec_levels""", ["dec_levels"], dates=["as_of"], doubles=LEVELS)
def l3(spark, d):
    return ordering.with_levels(inputs(spark, d), ordering.par_level(S)).select("as_of", "sku", *LEVELS)


@query("l6_policy_inputs", f"""SELECT as_of, sku, CAST(lead + review AS INTEGER) AS protection_period_days, mean AS mean_daily_forecast FROM dec_levels""",
       ["dec_levels"], dates=["as_of"], doubles=["mean_daily_forecast"])
def l6(spark, d):
    return inputs(spark, d).select("as_of", "sku", ordering.protection_days().alias("protection_period_days"), ordering.mean_forecast().alias("mean_daily_forecast"))


@query("l6_input_violations", "SELECT as_of, sku, 'negative stock' AS reason FROM dec WHERE on_hand < 60", ["dec"], dates=["as_of"])
def l6b(spark, d):
    return ordering.policy_input_violations(inputs(spark, d).withColumn("on_hand", F.col("on_hand") - 60))


@query("l7_order_constraints", """SELECT as_of, sku, q AS recommended_order_quantity, concat_ws(',', CASE WHEN abs(raw - q1) > 1e-9 THEN 'shelf_life_cap' END, CASE WHEN abs(q1 - q2) > 1e-9 THEN 'max_days_of_supply' END,
 CASE WHEN abs(q2 - q3) > 1e-9 THEN 'pack_rounding' END, CASE WHEN abs(q3 - q) > 1e-9 THEN 'min_order_quantity' END) AS changes FROM dec_final""", ["dec_final"],
       dates=["as_of"], doubles=["recommended_order_quantity"])
def l7(spark, d):
    rows = ordering.constrain(ordering.with_levels(inputs(spark, d), ordering.base_stock(S)), S)
    return rows.select("as_of", "sku", "recommended_order_quantity", F.array_join(F.transform("adjustments", lambda a: a["name"]), ",").alias("changes"))


REC_COLUMNS = ["inventory_position", "expected_demand_protection", "expected_demand_horizon", "safety_stock", "target_stock", "recommended_order_quantity", "order_value",
               "days_of_cover", "stockout_probability", "projected_waste_units"]


@query("l8_l9_recommendations", """SELECT as_of, sku, pos AS inventory_position, expected AS expected_demand_protection, horizon_demand AS expected_demand_horizon, safety AS safety_stock,
 target AS target_stock, q AS recommended_order_quantity, q * unit_cost AS order_value, cover AS days_of_cover, prob AS stockout_probability, waste AS projected_waste_units, risk FROM rec""",
       ["rec"], dates=["as_of"], doubles=REC_COLUMNS)
def l8(spark, d):
    return recs(spark, d).select("as_of", "sku", *REC_COLUMNS, "risk")


def r1(c: str, n: int = 1) -> str:
    return half_even(c, n)


TABLE_SQL = f"""SELECT sku, as_of, {r1('on_hand')} AS on_hand, {r1('on_order')} AS on_order, {r1('pos')} AS inventory_position, {r1('horizon_demand')} AS forecast_demand_horizon,
 {r1('expected')} AS forecast_demand_protection, {r1('safety')} AS safety_stock, {r1('target')} AS target_stock, {r1('q')} AS recommended_order, {r1('waste')} AS projected_waste_units,
 {r1('q * unit_cost', 2)} AS order_value, {r1('cover', 2)} AS days_of_cover, {r1('prob', 3)} AS stockout_probability, risk, model, 'Base stock (R, S)' AS policy FROM rec"""
TABLE_DOUBLES = ["on_hand", "on_order", "inventory_position", "forecast_demand_horizon", "forecast_demand_protection", "safety_stock", "target_stock", "recommended_order",
                 "projected_waste_units", "order_value", "days_of_cover", "stockout_probability"]


@query("l10_g3_recommendation_table", TABLE_SQL + " ORDER BY sku", ["rec"], dates=["as_of"], doubles=TABLE_DOUBLES)
def l10(spark, d):
    return ordering.recommendation_table(recs(spark, d))


@query("a10_recommendation_rows", f"SELECT 'run-1' AS run_id, * FROM ({TABLE_SQL})", ["rec"], dates=["as_of"], doubles=TABLE_DOUBLES)
def a10(spark, d):
    from larder.sources import store

    rows = ordering.recommendation_table(recs(spark, d)).withColumn("run_id", F.lit("run-1")).select(*store.columns_of("recommendations"))
    return store.replace_rows(None, rows, store.keys_of("recommendations"))


@query("e12_overview_metrics", """SELECT as_of, count(*) FILTER (q > 0) AS skus_requiring_orders, count(*) AS total_skus, sum(q * unit_cost) AS total_order_value, sum(q) AS total_order_units,
 count(*) FILTER (stockout_risk = 'high') AS high_stockout_risk, count(*) FILTER (stockout_risk = 'medium') AS medium_stockout_risk, count(*) FILTER (waste_risk = 'high') AS high_waste_risk,
 sum(waste) AS projected_waste_units, sum(waste * waste_cost_per_unit) AS projected_waste_cost, sum(shortfall) AS projected_stockout_units,
 sum(prob * shortfall * stockout_cost_per_unit) AS projected_stockout_cost FROM rec GROUP BY 1""", ["rec"], dates=["as_of"],
       doubles=["total_order_value", "total_order_units", "projected_waste_units", "projected_waste_cost", "projected_stockout_units", "projected_stockout_cost"])
def e12(spark, d):
    return ordering.overview_metrics(recs(spark, d))


@query("g4_attention_list", """SELECT as_of, sku, prob AS stockout_probability, CAST(place AS INTEGER) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY prob DESC, sku) AS place FROM rec WHERE risk <> 'low') WHERE place <= 6""", ["rec"],
       dates=["as_of"], doubles=["stockout_probability"])
def g4(spark, d):
    """The six riskiest products of all nine decision dates."""
    return ordering.attention(recs(spark, d)).select("as_of", "sku", "stockout_probability", "place")


@query("p4_days_of_cover", "SELECT sku, as_of, cover AS days_of_cover, risk FROM rec ORDER BY cover", ["rec"], dates=["as_of"], doubles=["days_of_cover"])
def p4(spark, d):
    return recs(spark, d).select("sku", "as_of", "days_of_cover", "risk").orderBy("days_of_cover")


# -- overrides: one decision date ---------------------------------------------------------------------------

block("overridden", f"""SELECT as_of, sku, q AS recommended_order, ov AS override_order, coalesce(ov, q) AS final_order, coalesce(ov, q) - q AS difference, coalesce(ov, q) * unit_cost AS final_value, ov IS NOT NULL AS overridden
 FROM (SELECT *, CASE WHEN {P.NUMBER_SQL} % 3 = 0 THEN q + 6 WHEN {P.NUMBER_SQL} % 5 = 0 THEN 0 END AS ov FROM rec)""", "rec")


def override_rows(rows):
    q = F.col("recommended_order_quantity")
    ov = F.when(P.number() % 3 == 0, q + 6).when(P.number() % 5 == 0, F.lit(0.0))
    return rows.select("as_of", "sku", ov.alias("override_order")).filter("override_order IS NOT NULL")


@query("c16_apply_overrides", "SELECT * FROM overridden", ["overridden"], dates=["as_of"], doubles=["recommended_order", "override_order", "final_order", "difference", "final_value"])
def c16(spark, d):
    rows = recs(spark, d)
    return ordering.apply_overrides(rows, override_rows(rows))


@query("c15_order_sheet", f"""SELECT CAST(as_of AS VARCHAR) AS order_date, sku AS product, round_even(final_order, 0) AS order_units, round_even(recommended_order, 0) AS recommended_units,
 CASE WHEN overridden THEN 'yes' ELSE 'no' END AS overridden, r.pack_size, r.min_order_quantity AS minimum_order, round_even(r.unit_cost, 2) AS unit_cost, round_even(final_value, 2) AS line_value
 FROM overridden o JOIN rec r USING (as_of, sku) WHERE final_order > 0""", ["overridden", "rec"], doubles=["order_units", "recommended_units", "unit_cost", "line_value"])
def c15(spark, d):
    rows = recs(spark, d)
    return ordering.order_sheet(ordering.apply_overrides(rows, override_rows(rows)), rows)


@query("c17_edited_rows", "SELECT as_of, sku, final_order AS override_order FROM overridden WHERE abs(final_order - recommended_order) > 1e-9", ["overridden"], dates=["as_of"], doubles=["override_order"])
def c17(spark, d):
    rows = recs(spark, d)
    return ordering.edited(ordering.apply_overrides(rows, override_rows(rows)), "final_order")


@query("d10_order_overview", f"""SELECT o.*, {r1('r.on_hand')} AS current_stock, {r1('r.on_order')} AS on_order, r.model, r.risk, coalesce(o.override_order, o.recommended_order) AS order_to_place
 FROM overridden o LEFT JOIN rec r USING (as_of, sku)""", ["overridden", "rec"], dates=["as_of"],
       doubles=["recommended_order", "override_order", "final_order", "difference", "final_value", "current_stock", "on_order", "order_to_place"])
def d10(spark, d):
    rows = recs(spark, d)
    return ordering.order_overview(ordering.apply_overrides(rows, override_rows(rows)), ordering.recommendation_table(rows))


# -- scenarios through the whole chain -----------------------------------------------------------------------

UPLIFT = [slices.Scenario(), slices.Scenario("Event", demand_uplift_pct=20.0, current_stock=30.0)]


@query("l22_side_by_side", f"""WITH sc AS (SELECT as_of, sku, f, sigma_daily, lead, review, level, pack_size, min_order_quantity, shelf_life_days, unit_cost, 'Base case' AS scenario, pos FROM dec
 UNION ALL SELECT as_of, sku, list_transform(f, lambda x: x * 1.2), sigma_daily * 1.2, lead, review, level, pack_size, min_order_quantity, shelf_life_days, unit_cost, 'Event', 30.0 + on_order FROM dec),
 a AS (SELECT *, {ed_sql('f', '(lead + review)')} AS expected, greatest({quantile_sql('level')} * sigma_daily * sqrt(lead + review), 0) AS safety, {ed_sql('f', '(lead + shelf_life_days)')} AS life FROM sc),
 b AS (SELECT *, expected + safety AS target, greatest(expected + safety - pos, 0) AS raw FROM a),
 c AS (SELECT *, least(raw, greatest(life - pos, 0), CASE WHEN list_avg(f) > 0 THEN 14 * list_avg(f) ELSE 1e18 END) AS q2 FROM b),
 e AS (SELECT *, CASE WHEN pack_size > 1 THEN round_even(q2 / pack_size, 0) * pack_size ELSE q2 END AS q3 FROM c),
 g AS (SELECT *, CASE WHEN q3 > 0 THEN greatest(q3, min_order_quantity) ELSE 0 END AS q FROM e),
 m AS (SELECT as_of, sku, scenario, unnest(['Inventory position', 'Expected demand over protection period', 'Safety stock', 'Target stock', 'Raw order', 'Recommended order', 'Order value (£)']) AS measure,
 unnest([pos, expected, safety, target, raw, q, q * unit_cost]) AS v FROM g)
 SELECT x.as_of, x.sku, x.measure, {half_even('x.v')} AS base_case, 'Event' AS scenario, {half_even('y.v')} AS scenario_value FROM m x JOIN m y ON x.as_of = y.as_of AND x.sku = y.sku AND x.measure = y.measure AND x.scenario = 'Base case' AND y.scenario = 'Event'""",
       ["dec"], dates=["as_of"], doubles=["base_case", "scenario_value"])
def l22(spark, d):
    state = models.series_state(brand(spark, d), month_origins(), S)
    rows = slices.scenario_forecast(slices.with_scenarios(models.seasonal_naive(state, 7, S), UPLIFT))
    arrays = service.daily_arrays(rows, ["as_of", "sku", *slices.SCENARIO_FIELDS])
    rec = decisions.recommendations(arrays, stock_rows(spark, d).drop("recent_average"), P.econ(spark, d), segs(spark, d), S)
    return ordering.side_by_side(rec)


@query("l12_opening_stock", f"SELECT sku, avg(units_sold) * 2 AS opening FROM dense_brand WHERE date < DATE '2001-01-01' AND date >= DATE '2001-01-01' - 28 GROUP BY 1", ["dense_brand"], doubles=["opening"])
def l12(spark, d):
    return decisions.opening_stock(brand(spark, d), P.START, S)


# -- reasons ----------------------------------------------------------------------------------------------------


def w(c: str) -> str:
    return f"CAST(round_even(round({c}, 6), 0) AS BIGINT)"


def f1(c: str) -> str:
    return f"printf('%.1f', round_even({c}, 1))"


EVENTS = f"""(SELECT concat_ws(', ', CASE WHEN count(*) FILTER (isodow(x) >= 5) > 0 THEN 'a weekend' END,
 CASE WHEN count(*) FILTER (x IN ({P.H_SQL})) > 0 THEN 'a bank holiday (' || strftime(min(x) FILTER (x IN ({P.H_SQL})), '%d %b') || ')' END,
 CASE WHEN max({P.SCHOOL_SQL.format(d='x')}) = 1 THEN 'school holidays' END) FROM (SELECT as_of + CAST(h AS INTEGER) AS x FROM unnest(generate_series(0, 6)) AS t(h)))"""
CHANGE = "((mean - usage) / usage * 100)"
DEMAND = f"""CASE WHEN coalesce(usage, 0) <= 0 THEN 'Forecast: ' || {w('mean')} || ' units a day for 7 days.'
 WHEN abs({CHANGE}) >= 5 THEN 'Forecast of ' || {w('mean')} || ' units a day for 7 days: ' || {w(f'abs({CHANGE})')} || '% ' || CASE WHEN {CHANGE} > 0 THEN 'above' ELSE 'below' END || ' the recent mean of ' || {w('usage')} || '.'
 ELSE 'Forecast of ' || {w('mean')} || ' units a day, close to the recent mean of ' || {w('usage')} || '.' END"""
HEAD = f"""CASE WHEN q > 0 THEN 'Buy ' || {w('q')} || ' x ' || sku || ', roughly £' || printf('%,.2f', round_even(q * unit_cost, 2)) || '.'
 ELSE 'Nothing to buy for ' || sku || ': ' || {w('pos')} || ' units in stock and on the way reach the target ' || {w('target')} || '.' END"""


@query("m8_order_headline_and_demand", f"""SELECT as_of, sku, {DEMAND} AS demand, 'Days ahead with effects in the forecast: ' || {EVENTS} || '.' AS ahead FROM rec""",
       ["rec"], dates=["as_of"])
def m8(spark, d):
    out = explain.explain_recommendations(recs(spark, d), S)
    return out.select("as_of", "sku", F.col("demand_reason")[0].alias("demand"), F.col("demand_reason")[1].alias("ahead"))


@query("m8_order_cover", f"""SELECT as_of, sku, concat_ws('|', 'On hand: ' || {w('on_hand')} || ' units, enough for ' || CASE WHEN cover IS NULL THEN 'any time ahead' ELSE {f1('cover')} || ' days' END || '.',
 CASE WHEN on_order > 0 THEN 'On order: ' || {w('on_order')} || ' units more, ' || {w('pos')} || ' in all.' END,
 'Target: ' || {w('target')} || ' units = ' || {w('expected')} || ' for ' || (lead + review) || ' days (2 of lead time, ' || review || ' to the next delivery) + ' || {w('safety')} || ' of safety stock at ' || {w('level * 100')} || '% service.',
 'Class ' || {DESCRIBE} || '; served at ' || {w('level * 100')} || '%.') AS cover_text FROM rec""", ["rec"], dates=["as_of"])
def m8b(spark, d):
    return explain.explain_recommendations(recs(spark, d), S).select("as_of", "sku", F.array_join("cover_reason", "|").alias("cover_text"))


@query("m8_order_constraints_and_risk", f"""SELECT as_of, sku, {HEAD} AS headline, concat_ws('|', CASE WHEN raw > 0 AND (abs(raw - q1) > 1e-9 OR abs(q1 - q2) > 1e-9 OR abs(q2 - q3) > 1e-9 OR abs(q3 - q) > 1e-9) THEN
 'Before limits: ' || {w('raw')} || ' units (target ' || {w('target')} || ' minus ' || {w('pos')} || '). Limits applied:' END,
 CASE WHEN abs(raw - q1) > 1e-9 THEN 'Cut to what sells within ' || shelf_life_days || ' days of usable life.' END,
 CASE WHEN abs(q1 - q2) > 1e-9 THEN 'Cut to 14 days of forecast demand.' END,
 CASE WHEN abs(q2 - q3) > 1e-9 THEN 'Set to full packs of ' || pack_size || ' (nearest).' END,
 CASE WHEN abs(q3 - q) > 1e-9 THEN 'Lifted to the least order of ' || min_order_quantity || '.' END) AS constraints,
 concat_ws('|', CASE WHEN stockout_risk <> 'low' THEN 'Stockout risk ' || stockout_risk || ': chance ' || {w('prob * 100')} || '% of running short before the next delivery.' END,
 CASE WHEN waste_risk <> 'low' THEN 'Waste risk ' || waste_risk || ': some ' || {w('waste')} || ' units may outlive their ' || shelf_life_days || ' days.' END,
 CASE WHEN risk = 'low' THEN 'Low risk of stockout (' || {w('prob * 100')} || '%) and of waste.' END) AS risks FROM rec""", ["rec"], dates=["as_of"])
def m8c(spark, d):
    out = explain.explain_recommendations(recs(spark, d), S)
    return out.select("as_of", "sku", "headline", F.array_join("constraint_reason", "|").alias("constraints"), F.array_join("risk_reason", "|").alias("risks"))


@query("m9_explanation_table", f"""SELECT as_of, sku, {r1('on_hand')} AS current_stock, {r1('on_order')} AS on_order, {r1('horizon_demand')} AS forecast_demand, {r1('q')} AS recommended_order, {r1('q * unit_cost', 2)} AS order_value,
 risk, model, {DEMAND} AS reason FROM rec""", ["rec"], dates=["as_of"], doubles=["current_stock", "on_order", "forecast_demand", "recommended_order", "order_value"])
def m9(spark, d):
    return explain.explanation_table(recs(spark, d), S)
