"""Policies, ledgers and replays against plain batch-by-batch loops; recorded comparison tables; storage."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import kpi, ledger, ordering
from larder.plans import decisions
from larder.settings import BASELINE, CANDIDATE, Settings
from larder.sources import exports, store

S = Settings()
DAY = dt.date(2025, 3, 3)
DECISION = """as_of date, sku string, daily_forecast array<double>, sigma_daily double, on_hand double, on_order double, lead_time_days int,
 review_period_days int, service_level double, unit_cost double, pack_size int, min_order_quantity int, shelf_life_days int,
 waste_cost_per_unit double, stockout_cost_per_unit double"""


def decision(spark, **changes):
    row = dict(as_of=DAY, sku="X", daily_forecast=[20.0] * 7, sigma_daily=0.0, on_hand=30.0, on_order=10.0, lead_time_days=2, review_period_days=1,
               service_level=0.95, unit_cost=2.0, pack_size=10, min_order_quantity=10, shelf_life_days=5, waste_cost_per_unit=2.05, stockout_cost_per_unit=4.0)
    row.update(changes)
    return spark.createDataFrame([tuple(row.values())], DECISION)


def test_base_stock_order(spark):
    r = ordering.recommend(decision(spark), S).first()
    assert (r["target_stock"], r["raw_order_quantity"], r["recommended_order_quantity"], r["order_value"], r["days_of_cover"]) == (60.0, 20.0, 20.0, 40.0, 1.5)
    assert r["adjustments"] == [] and r["stockout_probability"] == 1.0


@pytest.mark.parametrize("changes, quantity, names", [
    (dict(pack_size=12, min_order_quantity=0), 24.0, ["pack_rounding"]),
    (dict(pack_size=1, min_order_quantity=50), 50.0, ["min_order_quantity"]),
    (dict(pack_size=1, min_order_quantity=0, review_period_days=9, shelf_life_days=3), 60.0, ["shelf_life_cap"]),
    (dict(pack_size=1, min_order_quantity=0, sigma_daily=200.0, shelf_life_days=60), 280.0, ["max_days_of_supply"]),
    (dict(on_hand=500.0), 0.0, []),
    (dict(pack_size=100, min_order_quantity=40), 0.0, ["pack_rounding"]),
])
def test_constraints(spark, changes, quantity, names):
    r = ordering.recommend(decision(spark, **changes), S).first()
    assert r["recommended_order_quantity"] == pytest.approx(quantity)
    assert [a["name"] for a in r["adjustments"]] == names


def test_reorder_point_and_bad_inputs(spark):
    s = S.but(policy="s_S")
    high = ordering.recommend(decision(spark, on_hand=31.0), s).first()
    low = ordering.recommend(decision(spark, on_hand=29.0), s).first()
    assert (high["raw_order_quantity"], low["raw_order_quantity"]) == (0.0, 21.0)
    bad = decision(spark, daily_forecast=[-1.0], review_period_days=0, service_level=1.0)
    assert {r["reason"] for r in ordering.policy_input_violations(bad).collect()} == {"negative forecast", "review period below 1 day", "service level outside (0, 1)"}
    with pytest.raises(ValueError):
        ordering.build_policy("guess")


def batches_by_hand(days, life):
    """Receive, expire, serve oldest first, one batch list."""
    stock, out = [], []
    for t, (received, demand) in enumerate(days):
        if received > 0:
            stock.append([t, received])
        wasted = sum(q for r, q in stock if r + life <= t)
        stock = [b for b in stock if b[0] + life > t]
        left = demand
        for b in stock:
            take = min(b[1], left)
            b[1] -= take
            left -= take
        stock = [b for b in stock if b[1] > 1e-9]
        total = sum(q for _, q in stock)
        age = sum(q * (t - r) for r, q in stock) / total if total else 0.0
        out.append((wasted, demand - left, total, age, len(stock)))
    return out


def test_perishable_ledger_against_batches(spark):
    rng, rows, want = random.Random(11), [], {}
    for k in range(60):
        life = rng.randint(1, 6)
        days = [(float(rng.choice([0, 0, rng.randint(1, 20)])), float(rng.randint(0, 9))) for _ in range(30)]
        want[f"s{k}"] = batches_by_hand(days, life)
        rows += [(f"s{k}", DAY + dt.timedelta(days=i), r, d, life) for i, (r, d) in enumerate(days)]
    log = spark.createDataFrame(rows, "sku string, date date, received double, demand double, shelf_life_days int")
    led = ledger.perishable_ledger(log).cache()
    ages = {(r["sku"], r["date"]): r for r in ledger.batch_ages(led).collect()}
    for r in led.collect():
        i = (r["date"] - DAY).days
        wasted, served, closing, age, n = want[r["sku"]][i]
        a = ages[r["sku"], r["date"]]
        assert (r["expired_units"], r["served"], r["closing_stock"], a["mean_age_days"]) == pytest.approx((wasted, served, closing, age), abs=1e-9)
        assert a["batches"] == n
    assert led.count() == 1800
    assert ledger.ledger_violations(led, []).agg(F.sum("violations")).first()[0] == 0


def replay_by_hand(g, s):
    opening, life, pack, moq, days = g
    stock = [[-1, opening]] if opening > 0 else []
    pipeline, out = [], []
    for t, (demand, review, target, reorder, life_demand, most) in enumerate(days):
        for arrives, q in pipeline:
            if arrives == t:
                stock.append([t, q])
        pipeline = [p for p in pipeline if p[0] > t]
        wasted = sum(q for r, q in stock if r + life <= t)
        stock = [b for b in stock if b[0] + life > t]
        q = 0.0
        if review:
            pos = sum(b[1] for b in stock) + sum(p[1] for p in pipeline)
            if reorder is None or pos <= reorder:
                q = max(target - pos, 0.0)
            if q > 0 and life_demand is not None:
                q = min(q, max(life_demand - pos, 0.0))
            if q > 0 and most is not None:
                q = min(q, most)
            if q > 0 and pack > 1:
                q = round(q / pack) * float(pack)
            if 0 < q < moq:
                q = float(moq)
            if q > 0:
                pipeline.append((t + s.lead_days, q))
        left = demand
        for b in stock:
            take = min(b[1], left)
            b[1] -= take
            left -= take
        stock = [b for b in stock if b[1] > 1e-9]
        out.append((wasted, demand - left, sum(b[1] for b in stock), q, sum(p[1] for p in pipeline)))
    return out


@pytest.mark.parametrize("lead", [1, 3])
def test_replay_against_batches(spark, lead):
    rng, rows, want, s = random.Random(lead), [], {}, S.but(lead_days=lead)
    for k in range(50):
        life, pack, moq, opening = rng.randint(1, 6), rng.choice([1, 4, 6]), rng.choice([0, 5]), float(rng.randint(0, 20))
        days = []
        for i in range(25):
            review = rng.random() < 0.5
            terms = (float(rng.randint(5, 40)), rng.choice([None, 12.0]), rng.choice([None, 25.0]), rng.choice([None, 18.0])) if review else (None,) * 4
            days.append((float(rng.randint(0, 9)), review, *terms))
            rows.append((f"s{k}", DAY + dt.timedelta(days=i), *days[-1], opening, life, pack, moq))
        want[f"s{k}"] = replay_by_hand((opening, life, pack, moq, days), s)
    df = spark.createDataFrame(rows, """sku string, date date, demand double, is_review_day boolean, target double, reorder_point double, life_demand double, most double,
     opening double, shelf_life_days int, pack_size int, min_order_quantity int""")
    n = 0
    for r in ledger.replay(df, ["sku"], s).collect():
        got = (r["expired_units"], r["served"], r["closing_stock"], r["recommended_order"], r["on_order"])
        assert got == pytest.approx(want[r["sku"]][(r["date"] - DAY).days], abs=1e-9), (r["sku"], r["date"])
        n += 1
    assert n == 1250
    with pytest.raises(ValueError):
        ledger.replay(df, ["sku"], S.but(lead_days=0))


def test_allocation_conserves_units(spark):
    rows = [("a", DAY, 10.0, 4.0), ("a", DAY + dt.timedelta(days=1), 0.0, 6.0), ("a", DAY + dt.timedelta(days=2), 5.0, 3.0)]
    out = ledger.batch_allocation(spark.createDataFrame(rows, "sku string, date date, received double, served double"))
    got = sorted((r["received_on"], r["issued_on"], r["units"]) for r in out.collect())
    d = lambda i: DAY + dt.timedelta(days=i)
    assert got == [(d(0), d(0), 4.0), (d(0), d(1), 6.0), (d(2), d(2), 3.0)]


# Published sweep (strategy, setting, fill rate %, waste units, total cost, average inventory).
SWEEP = [
    (BASELINE, 0.0, 94.795, 1637.786, 29517.597, 69.549), (BASELINE, 0.05, 96.756, 2498.786, 22501.942, 80.236), (BASELINE, 0.1, 97.902, 3373.8, 18201.83, 92.7),
    (BASELINE, 0.5, 99.306, 25725.8, 31599.55, 204.9), (CANDIDATE, 0.7, 96.447, 1742.8, 21330.79, 59.3), (CANDIDATE, 0.8, 97.209, 1845.8, 18249.94, 63.5),
    (CANDIDATE, 0.9, 97.853, 2012.8, 16042.50, 70.1), (CANDIDATE, 0.95, 98.156, 2165.8, 15969.81, 76.1), (CANDIDATE, 0.99, 98.437, 2530.8, 16446.91, 88.0),
]


def test_matched_tables_reproduce_published_numbers(spark):
    f = spark.createDataFrame(SWEEP, "strategy string, setting_value double, unit_service_level double, waste_units double, total_cost double, average_inventory_units double")
    rows = {r["reference_setting"]: r for r in kpi.add_cost_saved(kpi.matched_service(f)).collect()}
    assert set(rows) == {0.05, 0.1}
    assert (rows[0.05]["waste_units_ai"], rows[0.05]["waste_reduction_pct"], rows[0.1]["waste_units_ai"], rows[0.1]["waste_reduction_pct"]) == pytest.approx((1784.6, 28.6, 2037.5, 39.6), abs=0.15)
    assert rows[0.1]["total_cost_ai"] == pytest.approx(16030.74, abs=0.5)
    assert rows[0.1]["total_cost_saved"] == pytest.approx(2171.09, abs=0.5)
    waste = {r["reference_setting"]: r["service_level_ai"] for r in kpi.matched_waste(f).collect()}
    assert waste == pytest.approx({0.05: 98.41}, abs=0.01)
    none = kpi.matched_service(f.filter((F.col("strategy") == BASELINE) | (F.col("setting_value") == 0.9)))
    assert none.count() == 0 and "waste_reduction_pct" in none.columns
    with pytest.raises(ValueError):
        kpi.require_strategies(f.filter(F.col("strategy") == BASELINE), BASELINE, CANDIDATE)


def test_comparison_and_money(spark):
    # Published KPIs of the two policies.
    keys = ["waste_units", "unit_service_level", "total_cost", "waste_cost", "stockout_cost", "holding_cost", "ordering_cost"]
    a = [6574.0, 98.89, 16385.71, 6903.07, 8273.86, 221.28, 987.5]
    b = [2242.0, 98.23, 15994.0, 3989.45, 10848.64, 168.40, 987.5]
    df = spark.createDataFrame([(BASELINE, *a), (CANDIDATE, *b)], "strategy string, " + ", ".join(f"{k} double" for k in keys))
    rows = {r["key"]: r for r in kpi.compare(df).collect()}
    assert len(rows) == 14 and rows["orders_placed"]["improvement_pct"] is None
    assert (rows["waste_units"]["improvement_pct"], rows["unit_service_level"]["improvement_pct"], rows["total_cost"]["improvement_pct"]) == (65.9, -0.7, 2.4)
    saved = {r["key"]: r["saved"] for r in kpi.money_saved(df).collect()}
    assert saved["total_cost"] == pytest.approx(391.71) and saved["ordering_cost"] == 0.0
    with pytest.raises(Exception):
        kpi.money_saved(df.drop("waste_cost"))


def test_stock_position_sources(spark, panel):
    skus = panel.select("sku").distinct()
    led = spark.createDataFrame([("Smooth", dt.date(2025, 4, 30), 12.0, 3.0)], "sku string, date date, closing_stock double, on_order double")
    rows = {r["sku"]: r for r in decisions.stock_positions(skus, panel, dt.date(2025, 5, 1), S, led).collect()}
    assert (rows["Smooth"]["on_hand"], rows["Smooth"]["on_order"]) == (12.0, 3.0) and rows["Smooth"]["source"].startswith("closing")
    assert rows["Spiky"]["source"].startswith("estimate of 2 days")


def test_store_round_trip(spark, panel, tmp_path):
    st = store.Store(spark, str(tmp_path / "db"))
    st.save_sales(panel)
    st.save_sales(panel.filter("sku = 'Spiky'").withColumn("units_sold", F.lit(1.0)))
    kept = st.load_table("sales")
    assert kept.count() == panel.count() and kept.filter("sku = 'Spiky'").agg(F.max("units_sold")).first()[0] == 1.0
    over = spark.createDataFrame([("r1", DAY, "X", 5.0, 9.0), ("r2", DAY, "X", 5.0, 0.0)], "run_id string, as_of date, sku string, recommended_order double, override_order double")
    st.record_overrides(over)
    assert st.load_overrides("r1").count() == 1 and st.load_overrides().count() == 2
    with pytest.raises(Exception, match="cannot be negative"):
        st.record_overrides(over.withColumn("override_order", F.lit(-1.0)))
    assert st.tables() == ["recommendation_overrides", "sales"]
    with pytest.raises(ValueError, match="available"):
        st.load_table("nothing")
    assert st.read("SELECT count(*) AS n FROM sales WHERE units_sold >= :u", {"u": 0}).first()["n"] == panel.count()


def test_choices_and_exports(spark, tmp_path):
    rows = [("X", "Naive", "because", "AX", "rule", "2025-01-01", {"Naive": 1.5})]
    choices = spark.createDataFrame(rows, exports.CHOICE_SCHEMA)
    exports.save_choices(choices, str(tmp_path / "c"))
    assert exports.load_choices(spark, str(tmp_path / "c")).collect() == choices.collect()
    with pytest.raises(FileNotFoundError):
        exports.load_choices(spark, str(tmp_path / "none"))
    exports.export(choices, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["candidate_scores"] == '{"Naive":1.5}'
    exports.export(choices, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    with pytest.raises(ValueError):
        exports.export(choices, str(tmp_path / "x"), "xlsx")
