"""Costs and comparisons over ledgers of the recorded order lines.

Two records of the same demand (open lines): the stock of one comes from the accepted lines, that of the other from the returned lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import panels as P
from checks.q_ledger import COMPARE, COST, E6, E6_SQL, KPI_SQL, KPIS, MATCHED, MATCHED_RAW, MATCHED_SQL
from checks.registry import block, half_even, query, shared
from larder.operators import kpi, ledger
from larder.plans import decisions, recorded
from larder.settings import BASELINE, CANDIDATE
from larder.sources.folder import written

S = P.S
REC_KPI = KPI_SQL.replace("recommended_order", "received")

# The recursion walks the days of a record; what expires by a day was received a shelf life before.
block("rec_raw", f"""SELECT strategy, p_type AS sku, CAST(l_shipdate AS DATE) AS date, coalesce(sum(CASE WHEN l_returnflag = CASE strategy WHEN '{BASELINE}' THEN 'A' ELSE 'R' END THEN l_quantity END), 0.0) AS received,
 coalesce(sum(CASE WHEN l_returnflag NOT IN ('A', 'R') THEN l_quantity END), 0.0) AS demand FROM lineitem JOIN part ON l_partkey = p_partkey, (VALUES ('{BASELINE}'), ('{CANDIDATE}')) AS v(strategy) GROUP BY 1, 2, 3""")
block("rec_log", f"""SELECT g.strategy, g.sku, g.date, coalesce(m.received, 0.0) AS received, coalesce(m.demand, 0.0) AS demand, CAST(3 + {P.NUMBER_SQL.replace('sku', 'g.sku')} % 5 AS INTEGER) AS life,
 row_number() OVER w AS t, sum(coalesce(m.received, 0.0)) OVER w AS total_in, coalesce(sum(coalesce(m.received, 0.0)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0.0) AS on_order FROM
 (SELECT strategy, sku, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM rec_raw GROUP BY 1, 2) g
 LEFT JOIN rec_raw m USING (strategy, sku, date) WINDOW w AS (PARTITION BY g.strategy, g.sku ORDER BY g.date)""", "rec_raw")
block("rec_in", "SELECT l.*, coalesce(b.total_in, 0.0) AS aged FROM rec_log l LEFT JOIN rec_log b ON b.strategy = l.strategy AND b.sku = l.sku AND b.t = l.t - l.life", "rec_log")
block("rec_walk", """rec_walk(strategy, sku, t, opening_stock, expired_units, served, gone, total_in) AS (
 SELECT strategy, sku, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT strategy, sku FROM rec_in)
 UNION ALL SELECT l.strategy, l.sku, l.t, p.total_in - p.gone, greatest(p.gone, l.aged) - p.gone, least(l.demand, l.total_in - greatest(p.gone, l.aged)),
 greatest(p.gone, l.aged) + least(l.demand, l.total_in - greatest(p.gone, l.aged)), l.total_in FROM rec_walk p JOIN rec_in l ON l.strategy = p.strategy AND l.sku = p.sku AND l.t = p.t + 1)""", "rec_in")
block("rec_ledger", """SELECT *, closing_stock * holding_cost_per_unit_per_day AS holding_cost, expired_units * (unit_cost + 0.05) AS waste_cost, stockout_units * stockout_cost_per_unit AS stockout_cost,
 closing_stock * unit_cost AS inventory_value, CASE WHEN stockout_units > 1e-9 THEN 1 ELSE 0 END AS stockout_day,
 CASE WHEN received > 0 THEN 12.5 / count(*) FILTER (received > 0) OVER (PARTITION BY strategy, date) ELSE 0 END AS ordering_cost
 FROM (SELECT w.strategy, w.sku, l.date, l.t, w.opening_stock, l.received, w.expired_units, l.demand, w.served, l.demand - w.served AS stockout_units, w.total_in - w.gone AS closing_stock, l.on_order,
 unit_cost, holding_cost_per_unit_per_day, stockout_cost_per_unit FROM rec_walk w JOIN rec_log l USING (strategy, sku, t) JOIN econ_type USING (sku))""", "rec_walk", "rec_log", "econ_type")
block("rec_kpis", f"SELECT strategy, {REC_KPI} FROM rec_ledger GROUP BY 1", "rec_ledger")
block("rec_comparison", COMPARE.replace("pair_kpis", "rec_kpis"), "rec_kpis")


@shared
def log(spark, d):
    """Receipts and demand per day of both records."""
    li, part = P.table(spark, d, "lineitem"), P.table(spark, d, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("sku"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))
    flag, quantity = F.col("flag"), F.col("quantity")
    demand = F.when(~flag.isin("A", "R"), quantity)
    return recorded.split_by(rows, {BASELINE: (F.when(flag == "A", quantity), demand), CANDIDATE: (F.when(flag == "R", quantity), demand)})


@shared
def records(spark, d):
    """The cost ledger of both records, written once for all queries of this module."""
    return written(recorded.recorded_ledger(log(spark, d), P.econ(spark, d, "type"), S))


def record_kpis(spark, d):
    return recorded.recorded_kpis(records(spark, d), S)


FLOW = [*recorded.FLOWS, "on_order"]


@query("l14_recorded_ledger", f"SELECT strategy, sku, date, {', '.join(FLOW)} FROM rec_ledger", ["rec_ledger"], dates=["date"], doubles=FLOW)
def l14(spark, d):
    return records(spark, d).select("strategy", "sku", "date", *FLOW)


@query("l17_l18_recorded_costs", "SELECT strategy, sku, date, holding_cost, waste_cost, stockout_cost, ordering_cost, holding_cost + waste_cost + stockout_cost + ordering_cost AS total_cost FROM rec_ledger",
       ["rec_ledger"], dates=["date"], doubles=COST)
def l17(spark, d):
    return records(spark, d).select("strategy", "sku", "date", *COST)


@query("l21_recorded_invariants", """SELECT unnest(['conservation', 'carry_over', 'served_within_demand', 'shortage_balance', 'non_negative', 'cost_parts']) AS rule, CAST(unnest([
 count(*) FILTER (abs(opening_stock + received - expired_units - served - closing_stock) > 1e-6), count(*) FILTER (abs(coalesce(prev, 0) - opening_stock) > 1e-6), count(*) FILTER (served - demand > 1e-6),
 count(*) FILTER (abs(served + stockout_units - demand) > 1e-6), count(*) FILTER (least(closing_stock, served, expired_units, stockout_units) < -1e-6), count(*) FILTER (holding_cost + waste_cost + stockout_cost + ordering_cost < -1e-6)]) AS BIGINT) AS violations
 FROM (SELECT *, lag(closing_stock) OVER (PARTITION BY strategy, sku ORDER BY date) AS prev FROM rec_ledger)""", ["rec_ledger"])
def l21(spark, d):
    return ledger.ledger_violations(records(spark, d), ["strategy"])


@query("l11_recorded_positions", f"""SELECT sku, closing_stock AS on_hand, on_order, 'closing position from the simulation run' AS source FROM rec_ledger WHERE strategy = '{CANDIDATE}' AND date = DATE '1999-03-01'""",
       ["rec_ledger"], doubles=["on_hand", "on_order"])
def l11(spark, d):
    led = records(spark, d).filter(F.col("strategy") == CANDIDATE)
    return decisions.stock_positions(P.econ(spark, d, "type"), P.sales_type(spark, d), F.lit("1999-03-02").cast("date"), S, led)


@query("e3_recorded_kpis", "SELECT * FROM rec_kpis", ["rec_kpis"], doubles=KPIS)
def e3(spark, d):
    return record_kpis(spark, d)


@query("e4_g5_recorded_by_sku", f"SELECT strategy, sku, {REC_KPI} FROM rec_ledger GROUP BY 1, 2", ["rec_ledger"], doubles=KPIS)
def e4(spark, d):
    led = records(spark, d)
    return kpi.kpis_by_sku(led, recorded.recorded_orders(led, S))


@query("e5_recorded_daily", """SELECT strategy, date, sum(demand) AS demand, sum(served) AS served, sum(stockout_units) AS stockout_units, sum(expired_units) AS waste_units, sum(closing_stock) AS closing_stock,
 sum(inventory_value) AS inventory_value, sum(holding_cost + waste_cost + stockout_cost + ordering_cost) AS total_cost FROM rec_ledger GROUP BY 1, 2""", ["rec_ledger"], dates=["date"],
       doubles=["demand", "served", "stockout_units", "waste_units", "closing_stock", "inventory_value", "total_cost"])
def e5(spark, d):
    return kpi.daily_totals(records(spark, d))


@query("e6_recorded_levels", f"""SELECT strategy, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS DATE) AS date, {E6_SQL}, 'run' AS level FROM rec_ledger GROUP BY strategy
 UNION ALL SELECT strategy, sku, NULL, {E6_SQL}, 'sku' FROM rec_ledger GROUP BY strategy, sku UNION ALL SELECT strategy, NULL, date, {E6_SQL}, 'day' FROM rec_ledger GROUP BY strategy, date""",
       ["rec_ledger"], dates=["date"], doubles=E6)
def e6(spark, d):
    return kpi.all_levels(records(spark, d))


@query("n1_n7_recorded_comparison", "SELECT * FROM rec_comparison", ["rec_comparison"], doubles=["baseline", "candidate", "absolute_change", "improvement_pct"])
def n1(spark, d):
    return kpi.compare(record_kpis(spark, d))


@query("n2_recorded_headline", f"SELECT key, improvement_pct FROM rec_comparison WHERE key IN ({', '.join(repr(k) for k in kpi.HEADLINE_KEYS)})", ["rec_comparison"], doubles=["improvement_pct"])
def n2(spark, d):
    return kpi.headline(n1(spark, d))


@query("p1_recorded_index", f"""SELECT key, metric, 100.0::DOUBLE AS baseline_indexed, 100.0 * candidate / nullif(baseline, 0) AS candidate_indexed FROM rec_comparison
 WHERE key IN ({', '.join(repr(k) for k in kpi.HEADLINE_KEYS)})""", ["rec_comparison"], doubles=["baseline_indexed", "candidate_indexed"])
def p1(spark, d):
    return kpi.indexed(n1(spark, d))


@query("p2_recorded_series", """SELECT strategy, date, sum(closing_stock) AS closing_stock, avg(sum(closing_stock)) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS closing_stock_mean
 FROM rec_ledger GROUP BY 1, 2""", ["rec_ledger"], dates=["date"], doubles=["closing_stock", "closing_stock_mean"])
def p2(spark, d):
    return kpi.trailing_mean(kpi.daily_totals(records(spark, d)), "closing_stock").select("strategy", "date", "closing_stock", "closing_stock_mean")


@query("e15_recorded_saved", " UNION ALL ".join(f"SELECT '{k}' AS key, max({k}) FILTER (strategy = '{BASELINE}') - max({k}) FILTER (strategy = '{CANDIDATE}') AS saved FROM rec_kpis" for k in kpi.MONEY_KEYS),
       ["rec_kpis"], doubles=["saved"])
def e15(spark, d):
    return kpi.money_saved(record_kpis(spark, d))


@query("d8_p3_recorded_both_by_sku", " UNION ALL ".join(
    f"""SELECT sku, sum({c}) FILTER (strategy = '{BASELINE}') AS baseline, sum({c}) FILTER (strategy = '{CANDIDATE}') AS candidate, '{k}' AS key FROM rec_ledger GROUP BY 1"""
    for k, c in (("waste_units", "expired_units"), ("stockout_units", "stockout_units"))), ["rec_ledger"], doubles=["baseline", "candidate"])
def d8(spark, d):
    both = kpi.both_strategies(kpi.kpis_by_sku(records(spark, d)), ("waste_units", "stockout_units"))
    sides = [F.struct(F.lit(k).alias("key"), F.col(f"{k}_baseline").alias("baseline"), F.col(f"{k}_candidate").alias("candidate")) for k in ("waste_units", "stockout_units")]
    return both.select("sku", F.inline(F.array(*sides)))


@query("a12_recorded_orders", "SELECT strategy, sku, date - 2 AS ordered_on, date AS arrives_on, received AS quantity, received * unit_cost AS order_value FROM rec_ledger WHERE received > 0",
       ["rec_ledger"], dates=["ordered_on", "arrives_on"], doubles=["quantity", "order_value"])
def a12(spark, d):
    return recorded.recorded_orders(records(spark, d), S)


# -- a grid of shelf lives over both records ------------------------------------------------------------------

LIVES = (1, 2, 3, 4, 6, 8)
block("grid_in", f"""SELECT l.* REPLACE (v.n AS life), coalesce(b.total_in, 0.0) AS aged FROM rec_log l, (VALUES {', '.join(f'({n})' for n in LIVES)}) AS v(n)
 LEFT JOIN rec_log b ON b.strategy = l.strategy AND b.sku = l.sku AND b.t = l.t - v.n""", "rec_log")
block("grid_walk", """grid_walk(strategy, life, sku, t, opening_stock, received, expired_units, demand, served, gone, total_in, date) AS (
 SELECT strategy, life, sku, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(NULL AS DATE) FROM (SELECT DISTINCT strategy, life, sku FROM grid_in)
 UNION ALL SELECT l.strategy, l.life, l.sku, l.t, p.total_in - p.gone, l.received, greatest(p.gone, l.aged) - p.gone, l.demand, least(l.demand, l.total_in - greatest(p.gone, l.aged)),
 greatest(p.gone, l.aged) + least(l.demand, l.total_in - greatest(p.gone, l.aged)), l.total_in, l.date FROM grid_walk p JOIN grid_in l ON l.strategy = p.strategy AND l.life = p.life AND l.sku = p.sku AND l.t = p.t + 1)""", "grid_in")
block("grid_ledger", """SELECT *, closing_stock * holding_cost_per_unit_per_day AS holding_cost, expired_units * (unit_cost + 0.05) AS waste_cost, stockout_units * stockout_cost_per_unit AS stockout_cost,
 closing_stock * unit_cost AS inventory_value, CASE WHEN stockout_units > 1e-9 THEN 1 ELSE 0 END AS stockout_day,
 CASE WHEN received > 0 THEN 12.5 / count(*) FILTER (received > 0) OVER (PARTITION BY strategy, life, date) ELSE 0 END AS ordering_cost
 FROM (SELECT w.*, w.demand - w.served AS stockout_units, w.total_in - w.gone AS closing_stock, unit_cost, holding_cost_per_unit_per_day, stockout_cost_per_unit FROM grid_walk w JOIN econ_type USING (sku) WHERE t > 0)""",
      "grid_walk", "econ_type")
block("grid_kpis", f"SELECT strategy, 'shelf_life_days' AS setting_name, CAST(life AS DOUBLE) AS setting_value, {REC_KPI} FROM grid_ledger GROUP BY 1, 3", "grid_ledger")
block("grid", "SELECT strategy, setting_name, setting_value, " + ", ".join(f"{half_even(k, 3)} AS {k}" for k in KPIS) + " FROM grid_kpis", "grid_kpis")
block("grid_matched_raw", MATCHED_RAW.replace("frontier", "grid"), "grid")
block("grid_matched", MATCHED_SQL.replace("matched_raw", "grid_matched_raw"), "grid_matched_raw")


@shared
def grid(spark, d):
    """KPIs of every (record, shelf life), written once."""
    led = recorded.recorded_ledger(log(spark, d), P.econ(spark, d, "type"), S, LIVES)
    return written(recorded.recorded_frontier(led, S))


@query("n6_d14_h3_recorded_frontier", "SELECT * FROM grid", ["grid"], doubles=[*KPIS, "setting_value"])
def n6(spark, d):
    return grid(spark, d)


@query("n3_d9_recorded_interpolation", "SELECT setting_value, w AS at_waste_units, c AS at_total_cost FROM grid_matched_raw", ["grid_matched_raw"], doubles=["setting_value", "at_waste_units", "at_total_cost"])
def n3(spark, d):
    side = F.col("strategy")
    at = kpi.interpolate(grid(spark, d), side == BASELINE, side == CANDIDATE, "unit_service_level", ["waste_units", "total_cost"])
    return at.select("setting_value", "at_waste_units", "at_total_cost")


@query("n4_recorded_matched_service", "SELECT * FROM grid_matched", ["grid_matched"], doubles=MATCHED)
def n4(spark, d):
    return kpi.matched_service(grid(spark, d))


@query("n5_recorded_matched_waste", f"""SELECT setting_value AS reference_setting, {half_even('waste_units', 1)} AS matched_waste_units, {half_even('unit_service_level', 2)} AS service_level_baseline, {half_even('sl', 2)} AS service_level_ai,
 {half_even('(sl - unit_service_level)', 2)} AS service_level_gain_pp FROM grid_matched_raw WHERE sl IS NOT NULL""", ["grid_matched_raw"],
       doubles=["reference_setting", "matched_waste_units", "service_level_baseline", "service_level_ai", "service_level_gain_pp"])
def n5(spark, d):
    return kpi.matched_waste(grid(spark, d))


@query("n8_recorded_cost_saved", "SELECT reference_setting, total_cost_baseline - total_cost_ai AS total_cost_saved FROM grid_matched", ["grid_matched"], doubles=["reference_setting", "total_cost_saved"])
def n8(spark, d):
    return kpi.add_cost_saved(n4(spark, d)).select("reference_setting", "total_cost_saved")


@query("p5_recorded_off_scale", f"SELECT setting_value, waste_units FROM grid WHERE strategy = '{BASELINE}' AND waste_units > 0.5 * (SELECT max(waste_units) FROM grid WHERE strategy = '{CANDIDATE}')",
       ["grid"], doubles=["setting_value", "waste_units"])
def p5(spark, d):
    return kpi.off_scale(grid(spark, d), factor=0.5).select("setting_value", "waste_units")
