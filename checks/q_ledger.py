"""Ledgers, replays, KPIs and policy comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import panels as P
from checks.q_models import backtest_blocks, brand
from checks.q_ordering import ed_sql, r1
from checks.q_features import quantile_sql
from checks.registry import block, half_even, query, shared
from larder.operators import features, kpi, ledger, models
from larder.plans import decisions, service
from larder.settings import BASELINE, CANDIDATE
from larder.sources import exports, store

S = P.S
LEDGER = ["opening_stock", "received", "demand", "served", "stockout_units", "closing_stock"]


@shared
def log(spark, d):
    return ledger.full_days(ledger.daily_movements(P.moves(spark, d)))


def shelf(df):
    return df.withColumn("shelf_life_days", (3 + P.number() % 5).cast("int"))


# -- ledgers over a movement log ----------------------------------------------------------------------------

block("log_t", f"SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date) AS t, CAST(3 + {P.NUMBER_SQL} % 5 AS INTEGER) AS life FROM log", "log")
block("lost", """lost(sku, t, date, opening_stock, received, demand, served, closing_stock) AS (SELECT sku, t, date, 0.0::DOUBLE, received, demand, least(demand, received), received - least(demand, received)
 FROM log_t WHERE t = 1 UNION ALL SELECT l.sku, l.t, l.date, p.closing_stock, l.received, l.demand, least(l.demand, p.closing_stock + l.received), p.closing_stock + l.received - least(l.demand, p.closing_stock + l.received)
 FROM lost p JOIN log_t l ON l.sku = p.sku AND l.t = p.t + 1)""", "log_t")


@query("l13_f12_lost_sales_ledger", "SELECT sku, date, opening_stock, received, demand, served, demand - served AS stockout_units, closing_stock FROM lost", ["lost"], dates=["date"], doubles=LEDGER)
def l13(spark, d):
    return ledger.lost_sales_ledger(log(spark, d))


block("log_in", """SELECT *, sum(received) OVER (PARTITION BY sku ORDER BY date) AS total_in, coalesce((SELECT sum(x.received) FROM log_t x WHERE x.sku = l.sku AND x.t <= l.t - l.life), 0) AS aged FROM log_t l""", "log_t")
block("perish", """perish(sku, t, date, life, opening_stock, received, expired_units, demand, served, gone, total_in) AS (
 SELECT sku, CAST(0 AS BIGINT), CAST(NULL AS DATE), 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT sku FROM log_in)
 UNION ALL SELECT l.sku, l.t, l.date, l.life, p.total_in - p.gone, l.received, greatest(p.gone, l.aged) - p.gone, l.demand, least(l.demand, l.total_in - greatest(p.gone, l.aged)),
 greatest(p.gone, l.aged) + least(l.demand, l.total_in - greatest(p.gone, l.aged)), l.total_in FROM perish p JOIN log_in l ON l.sku = p.sku AND l.t = p.t + 1)""", "log_in")


@query("l14_perishable_ledger", """SELECT sku, date, life AS shelf_life_days, opening_stock, received, expired_units, demand, served, demand - served AS stockout_units, total_in - gone AS closing_stock
 FROM perish WHERE t > 0""", ["perish"], dates=["date"], doubles=[*LEDGER, "expired_units"])
def l14(spark, d):
    return ledger.perishable_ledger(shelf(log(spark, d))).drop("gone", "total_in")


@query("l15_batch_allocation", """SELECT r.sku, r.date AS received_on, i.date AS issued_on, least(r.hi, i.hi) - greatest(r.lo, i.lo) AS units FROM
 (SELECT sku, date, sum(received) OVER w AS hi, sum(received) OVER w - received AS lo FROM lost WINDOW w AS (PARTITION BY sku ORDER BY date)) r JOIN
 (SELECT sku, date, sum(served) OVER w AS hi, sum(served) OVER w - served AS lo FROM lost WINDOW w AS (PARTITION BY sku ORDER BY date)) i
 ON r.sku = i.sku AND least(r.hi, i.hi) > greatest(r.lo, i.lo)""", ["lost"], dates=["received_on", "issued_on"], doubles=["units"])
def l15(spark, d):
    return ledger.batch_allocation(ledger.lost_sales_ledger(log(spark, d)))


@query("l16_batch_ages", """SELECT p.sku, p.date, p.life AS shelf_life_days, p.total_in - p.gone AS closing_stock, coalesce(CAST(count(*) FILTER (q > 1e-9) AS INTEGER), 0) AS batches,
 coalesce(CASE WHEN max(p.total_in - p.gone) > 1e-9 THEN sum(q * (p.t - b.t)) / max(p.total_in - p.gone) ELSE 0 END, 0) AS mean_age_days, coalesce(sum(q) FILTER (p.life - (p.t - b.t) <= 2), 0) AS expiring_soon
 FROM (SELECT * FROM perish WHERE t > 0) p LEFT JOIN LATERAL (SELECT b.t, greatest(b.total_in - greatest(p.gone, b.total_in - b.received), 0) AS q FROM log_in b WHERE b.sku = p.sku AND b.t <= p.t AND b.t > p.t - p.life) b ON true
 GROUP BY p.sku, p.date, p.life, p.total_in, p.gone""", ["perish", "log_in"], dates=["date"], doubles=["closing_stock", "mean_age_days", "expiring_soon"])
def l16(spark, d):
    return ledger.batch_ages(ledger.perishable_ledger(shelf(log(spark, d))))


@query("l21_f13_ledger_invariants", """SELECT unnest(['conservation', 'carry_over', 'served_within_demand', 'shortage_balance', 'non_negative']) AS rule, CAST(unnest([
 count(*) FILTER (abs(opening_stock + received - expired_units - served - (total_in - gone)) > 1e-6), count(*) FILTER (abs(coalesce(prev, 0) - opening_stock) > 1e-6), count(*) FILTER (served > demand), 0, count(*) FILTER (served < 0)]) AS BIGINT) AS violations
 FROM (SELECT *, lag(total_in - gone) OVER (PARTITION BY sku ORDER BY t) AS prev FROM perish WHERE t > 0)""", ["perish"])
def l21(spark, d):
    return ledger.ledger_violations(ledger.perishable_ledger(shelf(log(spark, d))), [])


# -- policy replay over half a year -------------------------------------------------------------------------

block("review_days", f"SELECT CAST(x AS DATE) AS origin FROM unnest(generate_series(DATE '{P.START}', DATE '{P.END}', INTERVAL 1 DAY)) AS t(x) WHERE isodow(x) IN (1, 3, 5)")
backtest_blocks("rv", "review_days")
BUFFERS, SERVICE = (0.0, 0.1, 0.2, 0.5), (0.5, 0.8, 0.95, 0.99)
RV = "CASE isodow(as_of) - 1 WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 3 END"
block("rv_usage", "SELECT origin AS as_of, sku, avg(units_sold) AS usage FROM dense_brand JOIN review_days ON date < origin AND date >= origin - 28 GROUP BY 1, 2", "dense_brand", "review_days")
block("rv_base", f"""SELECT '{BASELINE}' AS strategy, 'buffer_pct' AS setting_name, CAST(b AS DOUBLE) AS setting_value, u.sku, as_of AS date, usage * (2 + {RV}) * (1 + b) AS target, CAST(NULL AS DOUBLE) AS life_demand,
 CASE WHEN usage > 0 THEN 14 * usage END AS most FROM rv_usage u, (VALUES {', '.join(f'({b})' for b in BUFFERS)}) AS v(b)""", "rv_usage")
block("rv_cand", f"""SELECT '{CANDIDATE}' AS strategy, 'service_level' AS setting_name, CAST(level AS DOUBLE) AS setting_value, sku, as_of AS date, {ed_sql('f', f'(2 + {RV})')} + greatest({quantile_sql('level')} * sigma * sqrt(2 + {RV}), 0) AS target,
 {ed_sql('f', '(2 + shelf_life_days)')} AS life_demand, CASE WHEN list_avg(f) > 0 THEN 14 * list_avg(f) END AS most
 FROM (SELECT as_of, sku, list(predicted_demand ORDER BY step) AS f, max(sigma) AS sigma FROM rv_forecast WHERE model = 'Seasonal Naive' GROUP BY 1, 2) JOIN econ_brand USING (sku),
 (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in SERVICE)}) AS v(level)""", "rv_forecast", "econ_brand")
block("rp_terms", "SELECT * FROM rv_base UNION ALL SELECT * FROM rv_cand", "rv_base", "rv_cand")
block("rp_open", f"SELECT sku, avg(units_sold) * 2 AS opening FROM dense_brand WHERE date < DATE '{P.START}' AND date >= DATE '{P.START}' - 28 GROUP BY 1", "dense_brand")
block("rp_days", f"""SELECT g.*, t.target, t.life_demand, t.most, CAST(date_diff('day', DATE '{P.START}', g.date) AS INTEGER) AS i FROM (SELECT k.strategy, k.setting_name, k.setting_value, e.sku, e.shelf_life_days AS life,
 e.pack_size AS pack, e.min_order_quantity AS moq, coalesce(o.opening, 0) AS opening, s.date, s.units_sold AS demand, isodow(s.date) IN (1, 3, 5) AS review
 FROM (SELECT DISTINCT strategy, setting_name, setting_value FROM rp_terms) k, econ_brand e JOIN dense_brand s ON s.sku = e.sku AND s.date BETWEEN DATE '{P.START}' AND DATE '{P.END}' LEFT JOIN rp_open o ON o.sku = e.sku) g
 LEFT JOIN rp_terms t ON t.strategy = g.strategy AND t.setting_value = g.setting_value AND t.sku = g.sku AND t.date = g.date""", "rp_terms", "rp_open", "econ_brand", "dense_brand")
UP = lambda k: f"CASE WHEN {k} >= 0 THEN coalesce(r.placed[{k} + 1], 0) ELSE 0 END"
block("rp", f"""rp(strategy, setting_name, setting_value, sku, i, date, placed, gone, opening_stock, received, expired_units, demand, closing_stock, on_order, recommended_order, review) AS (
 SELECT DISTINCT strategy, setting_name, setting_value, sku, -1, CAST(NULL AS DATE), CAST([] AS DOUBLE[]), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, opening::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false FROM rp_days
 UNION ALL SELECT strategy, setting_name, setting_value, sku, i, date, list_append(placed, ordered + q), least(infl, past + demand), infl0 - gone, infl - infl0, past - gone, demand, infl - least(infl, past + demand), opening + ordered + q - infl, q, review FROM (
 SELECT *, CASE WHEN review AND cases > 1e-9 THEN greatest(cases, moq) ELSE 0 END AS q FROM (
 SELECT *, CASE WHEN pack > 1 THEN round_even(capped / pack, 0) * pack ELSE capped END AS cases FROM (
 SELECT *, least(greatest(coalesce(target, 0) - (opening + ordered - past), 0), CASE WHEN life_demand IS NULL THEN 1e18 ELSE greatest(life_demand - (opening + ordered - past), 0) END, coalesce(most, 1e18)) AS capped FROM (
 SELECT z.*, r.placed, r.gone, {UP('z.i - 1')} AS ordered, z.opening + {UP('z.i - 2')} AS infl, z.opening + {UP('z.i - 3')} AS infl0,
 greatest(r.gone, CASE WHEN z.i - z.life >= -1 THEN z.opening + {UP('z.i - z.life - 2')} ELSE 0 END) AS past
 FROM rp r JOIN rp_days z ON z.strategy = r.strategy AND z.setting_value = r.setting_value AND z.sku = r.sku AND z.i = r.i + 1)))))""", "rp_days")
block("rp_ledger", f"""SELECT *, closing_stock * holding_cost_per_unit_per_day AS holding_cost, expired_units * (unit_cost + 0.05) AS waste_cost, stockout_units * stockout_cost_per_unit AS stockout_cost,
 closing_stock * unit_cost AS inventory_value, CASE WHEN stockout_units > 1e-9 THEN 1 ELSE 0 END AS stockout_day, CASE WHEN recommended_order > 0 THEN 12.5 / count(*) FILTER (recommended_order > 0) OVER (PARTITION BY strategy, setting_value, date) ELSE 0 END AS ordering_cost
 FROM (SELECT rp.*, opening_stock + received - expired_units - closing_stock AS served, demand - (opening_stock + received - expired_units - closing_stock) AS stockout_units, unit_cost, holding_cost_per_unit_per_day, stockout_cost_per_unit
 FROM rp JOIN econ_brand USING (sku) WHERE i >= 0)""", "rp", "econ_brand")
KPI_SQL = """sum(stockout_day)::DOUBLE AS stockout_days, sum(stockout_units) AS stockout_units, CASE WHEN sum(demand) > 0 THEN sum(served) / sum(demand) * 100 ELSE 100 END AS unit_service_level,
 (1 - avg(stockout_day)) * 100 AS day_service_level, sum(expired_units) AS waste_units, CASE WHEN sum(received) > 0 THEN sum(expired_units) / sum(received) * 100 ELSE 0 END AS waste_share_of_supply,
 sum(waste_cost) AS waste_cost, sum(holding_cost) AS holding_cost, sum(ordering_cost) AS ordering_cost, sum(stockout_cost) AS stockout_cost, sum(holding_cost + waste_cost + stockout_cost + ordering_cost) AS total_cost,
 avg(closing_stock) AS average_inventory_units, avg(inventory_value) AS average_inventory_value, sum(demand) AS total_demand, sum(received) AS total_received, count(*) FILTER (recommended_order > 0)::DOUBLE AS orders_placed"""
KPIS = list(kpi.KPI_KEYS)
KEYS = ["strategy", "setting_name", "setting_value"]
block("rp_kpis", f"SELECT strategy, setting_name, setting_value, {KPI_SQL} FROM rp_ledger GROUP BY 1, 2, 3", "rp_ledger")
PAIR = f"(strategy = '{BASELINE}' AND setting_value = 0.2 OR strategy = '{CANDIDATE}' AND setting_value = 0.95)"
block("pair_ledger", f"SELECT * FROM rp_ledger WHERE {PAIR}", "rp_ledger")
block("pair_kpis", f"SELECT strategy, {KPI_SQL} FROM pair_ledger GROUP BY 1", "pair_ledger")
block("frontier", "SELECT strategy, setting_name, setting_value, " + ", ".join(f"{half_even(k, 3)} AS {k}" for k in KPIS) + " FROM rp_kpis", "rp_kpis")


def replay_inputs(spark, d, buffers, levels):
    sales, econ = brand(spark, d), P.econ(spark, d)
    days = decisions.review_dates(P.START, P.END, S)
    arrays = service.daily_arrays(models.seasonal_naive(models.series_state(sales, days, S), 7, S))
    usage = features.trailing_usage(sales, days, S.lookback_days)
    terms = decisions.baseline_terms(usage, econ, buffers, S).unionByName(decisions.candidate_terms(arrays, econ, levels, S))
    return sales, econ, terms, decisions.settings_array(buffers, levels)


@shared
def sweep(spark, d, buffers=BUFFERS, levels=SERVICE):
    sales, econ, terms, grid = replay_inputs(spark, d, buffers, levels)
    return decisions.run_replay(sales, terms, econ, grid, P.START, P.END, S)


@shared
def pair(spark, d):
    return sweep(spark, d, (0.2,), (0.95,))


def pair_orders(led):
    return ledger.order_log(led, decisions.REPLAY_KEYS, s=S)


@shared
def pair_kpis(spark, d):
    led = pair(spark, d)
    return kpi.compute_kpis(led, ["strategy"], pair_orders(led))


RP = ["opening_stock", "received", "expired_units", "demand", "served", "stockout_units", "closing_stock", "on_order", "recommended_order"]


@query("l19_policy_replay", f"SELECT strategy, setting_value, sku, date, {', '.join(RP)}, CASE WHEN review THEN 1 ELSE 0 END AS is_review_day FROM rp_ledger", ["rp_ledger"], dates=["date"],
       doubles=[*RP, "setting_value"])
def l19(spark, d):
    return sweep(spark, d).select("strategy", "setting_value", "sku", "date", *RP, "is_review_day")


COST = ["holding_cost", "waste_cost", "stockout_cost", "ordering_cost", "total_cost"]


@query("l17_l18_costs", "SELECT strategy, sku, date, holding_cost, waste_cost, stockout_cost, ordering_cost, holding_cost + waste_cost + stockout_cost + ordering_cost AS total_cost FROM pair_ledger",
       ["pair_ledger"], dates=["date"], doubles=COST)
def l17(spark, d):
    return pair(spark, d).select("strategy", "sku", "date", *COST)


@query("l21_replay_invariants", "SELECT unnest(['conservation', 'carry_over', 'served_within_demand', 'shortage_balance', 'non_negative', 'cost_parts']) AS rule, CAST(0 AS BIGINT) AS violations FROM (SELECT count(*) FROM pair_ledger)",
       ["pair_ledger"])
def l21b(spark, d):
    led = pair(spark, d)
    first = F.col("date") == F.lit(P.START)
    return ledger.ledger_violations(led.filter(~first), ["strategy"])


@query("l11_stock_positions", f"""SELECT sku, closing_stock AS on_hand, on_order, 'closing position from the simulation run' AS source FROM pair_ledger WHERE strategy = '{CANDIDATE}' AND date = DATE '2001-03-01'""",
       ["pair_ledger"], doubles=["on_hand", "on_order"])
def l11(spark, d):
    led = pair(spark, d).filter(F.col("strategy") == CANDIDATE)
    return decisions.stock_positions(P.econ(spark, d), brand(spark, d), F.lit("2001-03-02").cast("date"), S, led)


@query("e3_kpis", f"SELECT * FROM rp_kpis", ["rp_kpis"], doubles=[*KPIS, "setting_value"])
def e3(spark, d):
    led = sweep(spark, d)
    return kpi.compute_kpis(led, KEYS, ledger.order_log(led, decisions.REPLAY_KEYS, s=S))


@query("e4_g5_kpis_by_sku", f"SELECT strategy, sku, {KPI_SQL} FROM pair_ledger GROUP BY 1, 2", ["pair_ledger"], doubles=KPIS)
def e4(spark, d):
    led = pair(spark, d)
    return kpi.kpis_by_sku(led, pair_orders(led))


@query("e5_daily_totals", """SELECT strategy, date, sum(demand) AS demand, sum(served) AS served, sum(stockout_units) AS stockout_units, sum(expired_units) AS waste_units, sum(closing_stock) AS closing_stock,
 sum(inventory_value) AS inventory_value, sum(holding_cost + waste_cost + stockout_cost + ordering_cost) AS total_cost FROM pair_ledger GROUP BY 1, 2""", ["pair_ledger"], dates=["date"],
       doubles=["demand", "served", "stockout_units", "waste_units", "closing_stock", "inventory_value", "total_cost"])
def e5(spark, d):
    return kpi.daily_totals(pair(spark, d))


E6 = [k for k in KPIS if k != "orders_placed"]
E6_SQL = ", ".join(x for x in KPI_SQL.split(", count(*)")[:1])


@query("e6_all_levels", f"""SELECT strategy, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS DATE) AS date, {E6_SQL}, 'run' AS level FROM pair_ledger GROUP BY strategy
 UNION ALL SELECT strategy, sku, NULL, {E6_SQL}, 'sku' FROM pair_ledger GROUP BY strategy, sku UNION ALL SELECT strategy, NULL, date, {E6_SQL}, 'day' FROM pair_ledger GROUP BY strategy, date""",
       ["pair_ledger"], dates=["date"], doubles=E6)
def e6(spark, d):
    return kpi.all_levels(pair(spark, d))


SIDES = "SELECT '{k}' AS key, max({k}) FILTER (strategy = '%s') AS b, max({k}) FILTER (strategy = '%s') AS c FROM pair_kpis" % (BASELINE, CANDIDATE)
COMPARE = " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS rank, '{label}' AS metric, key, '{unit}' AS unit, {half_even('b', p)} AS baseline, {half_even('c', p)} AS candidate, {half_even('(c - b)', p)} AS absolute_change,
 {half_even(f"(CASE WHEN b = 0 AND c = 0 THEN 0 WHEN b <> 0 THEN {'(b - c)' if better.startswith('lower') else '(c - b)'} / abs(b) * 100 END)", 1)} AS improvement_pct, '{better}' AS better_when FROM ({SIDES.format(k=k)})"""
    for i, (k, label, better, unit, p) in enumerate(kpi.METRIC_SPECS))
block("comparison", COMPARE, "pair_kpis")
CD = ["baseline", "candidate", "absolute_change", "improvement_pct"]


@query("n1_n7_comparison", "SELECT * FROM comparison", ["comparison"], doubles=CD)
def n1(spark, d):
    return kpi.compare(pair_kpis(spark, d))


@query("n2_headline", "SELECT key, improvement_pct FROM comparison WHERE key IN ('stockout_units', 'waste_units', 'unit_service_level', 'total_cost', 'average_inventory_units')", ["comparison"],
       doubles=["improvement_pct"])
def n2(spark, d):
    return kpi.headline(n1(spark, d))


@query("i29_improvement", f"""SELECT sku, CASE WHEN b = 0 AND c = 0 THEN 0 WHEN b <> 0 THEN (b - c) / abs(b) * 100 END AS gain FROM (SELECT sku, sum(expired_units) FILTER (strategy = '{BASELINE}') AS b,
 sum(expired_units) FILTER (strategy = '{CANDIDATE}') AS c FROM pair_ledger GROUP BY 1)""", ["pair_ledger"], doubles=["gain"])
def i29(spark, d):
    from larder.functions.stock import improvement_pct

    led = pair(spark, d)
    side = lambda n: F.sum(F.when(F.col("strategy") == n, F.col("expired_units")))
    return led.groupBy("sku").agg(side(BASELINE).alias("b"), side(CANDIDATE).alias("c")).select("sku", improvement_pct("b", "c", F.lit(False)).alias("gain"))


@query("i33_metric_labels", "SELECT key, metric AS label FROM comparison UNION ALL SELECT 'total_demand', 'Total demand' UNION ALL SELECT 'total_received', 'Total received'", ["comparison"])
def i33(spark, d):
    long = kpi.melt_kpis(pair_kpis(spark, d), ["strategy"]).select("key").distinct()
    return long.select("key", kpi.metric_label(F.col("key")).alias("label"))


@query("e15_money_saved", " UNION ALL ".join(f"SELECT '{k}' AS key, max({k}) FILTER (strategy = '{BASELINE}') - max({k}) FILTER (strategy = '{CANDIDATE}') AS saved FROM pair_kpis" for k in kpi.MONEY_KEYS),
       ["pair_kpis"], doubles=["saved"])
def e15(spark, d):
    return kpi.money_saved(pair_kpis(spark, d))


@query("a12_melted_kpis", " UNION ALL ".join(f"SELECT 'run-1' AS run_id, strategy, '{k}' AS metric, {k} AS value FROM pair_kpis" for k in KPIS), ["pair_kpis"], doubles=["value"])
def a12(spark, d):
    return store.result_rows(pair_kpis(spark, d), "run-1")


@query("a12_order_log", "SELECT strategy, sku, date AS ordered_on, date + 2 AS arrives_on, recommended_order AS quantity, recommended_order * unit_cost AS order_value FROM pair_ledger WHERE recommended_order > 0",
       ["pair_ledger"], dates=["ordered_on", "arrives_on"], doubles=["quantity", "order_value"])
def a12b(spark, d):
    return ledger.order_log(pair(spark, d), ["strategy", "sku"], s=S)


@query("a17_run_comparison", "SELECT strategy AS run_id, strategy, metric, value FROM (" + " UNION ALL ".join(f"SELECT strategy, '{k}' AS metric, {k} AS value FROM pair_kpis" for k in KPIS) + ")",
       ["pair_kpis"], doubles=["value"])
def a17(spark, d):
    kpis = pair_kpis(spark, d)
    named = lambda df: df.withColumn("run_id", F.col("strategy"))
    runs = named(store.run_header(kpis, "x", P.START, P.END))
    return store.run_comparison(runs, named(store.result_rows(kpis, "x"))).select("run_id", "strategy", "metric", "value")


# -- frontier and matching ----------------------------------------------------------------------------------


@shared
def frontier(spark, d):
    return decisions.frontier(sweep(spark, d), S)


@query("n6_d14_h3_frontier", "SELECT * FROM frontier", ["frontier"], doubles=[*KPIS, "setting_value"])
def n6(spark, d):
    return frontier(spark, d)


def interp(x: str, y: str) -> str:
    return f"""(SELECT CASE WHEN a.x = c.x THEN a.y ELSE a.y + (p.{x} - a.x) * (c.y - a.y) / (c.x - a.x) END FROM
 (SELECT {x} AS x, {y} AS y FROM frontier WHERE strategy = '{CANDIDATE}' AND {x} <= p.{x} ORDER BY 1 DESC LIMIT 1) a,
 (SELECT {x} AS x, {y} AS y FROM frontier WHERE strategy = '{CANDIDATE}' AND {x} >= p.{x} ORDER BY 1 LIMIT 1) c)"""


MATCHED_RAW = f"""SELECT p.*, {interp('unit_service_level', 'waste_units')} AS w, {interp('unit_service_level', 'total_cost')} AS c, {interp('unit_service_level', 'average_inventory_units')} AS inv,
 {interp('unit_service_level', 'setting_value')} AS st, {interp('waste_units', 'unit_service_level')} AS sl FROM frontier p WHERE strategy = '{BASELINE}'"""
block("matched_raw", MATCHED_RAW, "frontier")


def cut(base: str, other: str) -> str:
    return half_even(f"(CASE WHEN {base} > 0 THEN ({base} - {other}) / {base} * 100 END)", 1)


MATCHED_SQL = f"""SELECT setting_value AS reference_setting, {half_even('unit_service_level', 2)} AS matched_service_level_pct, {half_even('st', 4)} AS matched_ai_service_level_setting,
 {r1('waste_units')} AS waste_units_baseline, {r1('w')} AS waste_units_ai, {cut('waste_units', 'w')} AS waste_reduction_pct, {r1('total_cost', 2)} AS total_cost_baseline, {r1('c', 2)} AS total_cost_ai,
 {cut('total_cost', 'c')} AS cost_reduction_pct, {r1('average_inventory_units')} AS avg_inventory_baseline, {r1('inv')} AS avg_inventory_ai, {cut('average_inventory_units', 'inv')} AS inventory_reduction_pct
 FROM matched_raw WHERE w IS NOT NULL"""
block("matched", MATCHED_SQL, "matched_raw")
MATCHED = ["reference_setting", "matched_service_level_pct", "matched_ai_service_level_setting", "waste_units_baseline", "waste_units_ai", "waste_reduction_pct", "total_cost_baseline", "total_cost_ai",
           "cost_reduction_pct", "avg_inventory_baseline", "avg_inventory_ai", "inventory_reduction_pct"]


@query("n3_d9_interpolation", "SELECT setting_value, w AS at_waste_units, c AS at_total_cost FROM matched_raw", ["matched_raw"], doubles=["setting_value", "at_waste_units", "at_total_cost"])
def n3(spark, d):
    side = F.col("strategy")
    at = kpi.interpolate(frontier(spark, d), side == BASELINE, side == CANDIDATE, "unit_service_level", ["waste_units", "total_cost"])
    return at.select("setting_value", "at_waste_units", "at_total_cost")


@query("n4_matched_service", "SELECT * FROM matched", ["matched"], doubles=MATCHED)
@shared
def n4(spark, d):
    return kpi.matched_service(frontier(spark, d))


@query("n5_matched_waste", f"""SELECT setting_value AS reference_setting, {r1('waste_units')} AS matched_waste_units, {r1('unit_service_level', 2)} AS service_level_baseline, {r1('sl', 2)} AS service_level_ai,
 {r1('(sl - unit_service_level)', 2)} AS service_level_gain_pp FROM matched_raw WHERE sl IS NOT NULL""", ["matched_raw"],
       doubles=["reference_setting", "matched_waste_units", "service_level_baseline", "service_level_ai", "service_level_gain_pp"])
def n5(spark, d):
    return kpi.matched_waste(frontier(spark, d))


@query("n8_cost_saved", "SELECT reference_setting, total_cost_baseline - total_cost_ai AS total_cost_saved FROM matched", ["matched"], doubles=["reference_setting", "total_cost_saved"])
def n8(spark, d):
    return kpi.add_cost_saved(n4(spark, d)).select("reference_setting", "total_cost_saved")


@query("e16_best_matched_point", "SELECT * FROM matched ORDER BY waste_reduction_pct DESC LIMIT 1", ["matched"], doubles=MATCHED)
def e16(spark, d):
    return kpi.best_matched(n4(spark, d))


@query("p5_off_scale_points", f"SELECT setting_value, waste_units FROM frontier WHERE strategy = '{BASELINE}' AND waste_units > 0.5 * (SELECT max(waste_units) FROM frontier WHERE strategy = '{CANDIDATE}')",
       ["frontier"], doubles=["setting_value", "waste_units"])
def p5(spark, d):
    return kpi.off_scale(frontier(spark, d), factor=0.5).select("setting_value", "waste_units")


@query("p1_indexed_kpis", "SELECT key, metric, 100.0::DOUBLE AS baseline_indexed, 100 * candidate / nullif(baseline, 0) AS candidate_indexed FROM comparison WHERE key IN ('stockout_units', 'waste_units', 'unit_service_level', 'total_cost', 'average_inventory_units')",
       ["comparison"], doubles=["candidate_indexed", "baseline_indexed"])
def p1(spark, d):
    return kpi.indexed(n1(spark, d))


@query("p2_site_series", """SELECT strategy, date, waste, avg(waste) OVER (PARTITION BY strategy ORDER BY date ROWS 6 PRECEDING) AS waste_mean FROM (SELECT strategy, date, sum(expired_units) AS waste FROM pair_ledger GROUP BY 1, 2)""",
       ["pair_ledger"], dates=["date"], doubles=["waste", "waste_mean"])
def p2(spark, d):
    series = kpi.daily_totals(pair(spark, d)).select("strategy", "date", F.col("waste_units").alias("waste"))
    return kpi.trailing_mean(series, "waste")


BOTH = f"""SELECT sku, max(unit_service_level) FILTER (strategy = '{BASELINE}') AS unit_service_level_baseline, max(unit_service_level) FILTER (strategy = '{CANDIDATE}') AS unit_service_level_candidate,
 max(waste_units) FILTER (strategy = '{BASELINE}') AS waste_units_baseline, max(waste_units) FILTER (strategy = '{CANDIDATE}') AS waste_units_candidate,
 max(total_cost) FILTER (strategy = '{BASELINE}') AS total_cost_baseline, max(total_cost) FILTER (strategy = '{CANDIDATE}') AS total_cost_candidate
 FROM (SELECT strategy, sku, {KPI_SQL} FROM pair_ledger GROUP BY 1, 2) GROUP BY sku"""
BOTH_DOUBLES = [f"{k}_{t}" for k in ("unit_service_level", "waste_units", "total_cost") for t in ("baseline", "candidate")]


@query("d8_both_policies_by_sku", BOTH, ["pair_ledger"], doubles=BOTH_DOUBLES)
def d8(spark, d):
    return kpi.both_strategies(kpi.compute_kpis(pair(spark, d), ["strategy", "sku"]), ["unit_service_level", "waste_units", "total_cost"])


@query("p3_waste_change_by_sku", f"SELECT sku, waste_units_baseline, waste_units_candidate FROM ({BOTH}) WHERE waste_units_baseline + waste_units_candidate > 0", ["pair_ledger"],
       doubles=["waste_units_baseline", "waste_units_candidate"])
def p3(spark, d):
    both = kpi.both_strategies(kpi.compute_kpis(pair(spark, d), ["strategy", "sku"]), ["waste_units"])
    return both.filter(F.col("waste_units_baseline") + F.col("waste_units_candidate") > 0)


@query("a21_per_sku_table", "SELECT sku, " + ", ".join(f"{half_even(c, 2)} AS {c}" for c in BOTH_DOUBLES) + f" FROM ({BOTH})", ["pair_ledger"], doubles=BOTH_DOUBLES)
def a21(spark, d):
    return exports.per_sku_table(kpi.compute_kpis(pair(spark, d), ["strategy", "sku"]))


@query("a21_segmentation_table", f"SELECT sku, abc, xyz, segment, {half_even('annual_value', 3)} AS annual_value, {half_even('demand_cv', 3)} AS demand_cv, {half_even('zero_day_share', 3)} AS zero_day_share FROM segs",
       ["segs"], doubles=["annual_value", "demand_cv", "zero_day_share"])
def a21b(spark, d):
    from checks.q_models import segs

    return exports.segmentation_table(segs(spark, d))
