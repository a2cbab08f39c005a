"""Cost ledgers of recorded movements against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import kpi, ledger
from larder.plans import recorded
from larder.settings import BASELINE, CANDIDATE, Settings

S = Settings()
DAY = dt.date(2025, 1, 30)
LIVES = {"a": 2, "b": 3}


@pytest.fixture(scope="module")
def moves():
    rng = random.Random(7)
    rows = [(sku, DAY + dt.timedelta(days=rng.randrange(70)), rng.choice("ARN"), float(rng.randint(1, 30))) for sku in LIVES for _ in range(150)]
    return [*rows, ("b", DAY, "A", 5.0), ("a", DAY, "A", None), ("no terms", DAY, "A", 5.0)]


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(sku, life, 1.5, 0.01, 4.0) for sku, life in LIVES.items()]
    return spark.createDataFrame(rows, "sku string, shelf_life_days int, unit_cost double, holding_cost_per_unit_per_day double, stockout_cost_per_unit double")


def split(spark, rows):
    df = spark.createDataFrame(rows, "sku string, date date, flag string, units double")
    demand = F.when(F.col("flag") == "N", F.col("units"))
    return recorded.split_by(df, {BASELINE: (F.when(F.col("flag") == "A", F.col("units")), demand), CANDIDATE: (F.when(F.col("flag") == "R", F.col("units")), demand)})


def walked(moves, sku, flag, life):
    """Batches in a list, oldest first: drop what is too old, take in, serve."""
    mine = [m for m in moves if m[0] == sku]
    first, last = min(m[1] for m in mine), max(m[1] for m in mine)
    held, out = [], []
    for k in range((last - first).days + 1):
        day = first + dt.timedelta(days=k)
        total = lambda f, at: sum(m[3] or 0.0 for m in mine if m[1] == at and m[2] == f)
        opening = sum(q for _, q in held)
        expired = sum(q for born, q in held if (day - born).days >= life)
        held = [b for b in held if (day - b[0]).days < life]
        came, wanted = total(flag, day), total("N", day)
        held.append((day, came))
        served, left = 0.0, []
        for born, q in held:
            take = min(q, wanted - served)
            served += take
            left.append((born, q - take))
        held = [b for b in left if b[1] > 0]
        soon = sum(total(flag, day + dt.timedelta(days=n)) for n in (1, 2))
        out.append((day, opening, came, expired, wanted, served, wanted - served, sum(q for _, q in held), soon))
    return out


COLUMNS = ["date", *recorded.FLOWS, "on_order"]


def test_ledgers_match_a_walk_over_batches(spark, moves, terms):
    led = recorded.recorded_ledger(split(spark, moves), terms, S).cache()
    assert {r["sku"] for r in led.select("sku").distinct().collect()} == set(LIVES)
    for name, flag in ((BASELINE, "A"), (CANDIDATE, "R")):
        for sku, life in LIVES.items():
            got = led.filter((F.col("strategy") == name) & (F.col("sku") == sku)).orderBy("date").select(*COLUMNS).collect()
            assert [tuple(r) for r in got] == [(w[0], *(pytest.approx(x) for x in w[1:])) for w in walked(moves, sku, flag, life)]
    assert {r["violations"] for r in ledger.ledger_violations(led, ["strategy"]).collect()} == {0}
    # One charge a delivery day, whatever the number of SKUs delivered.
    fees = led.filter("received > 0").groupBy("strategy", "date").agg(F.sum("ordering_cost").alias("fee")).collect()
    assert fees and all(r["fee"] == pytest.approx(S.order_fee) for r in fees)
    orders = recorded.recorded_orders(led, S)
    assert orders.filter(F.col("arrives_on") != F.date_add("ordered_on", S.lead_days)).count() == 0
    kpis = {r["strategy"]: r for r in recorded.recorded_kpis(led, S).collect()}
    assert kpis[BASELINE]["orders_placed"] == orders.filter(F.col("strategy") == BASELINE).count()
    assert kpi.compare(recorded.recorded_kpis(led, S)).count() == len(kpi.METRIC_SPECS)


def test_a_grid_of_shelf_lives(spark, moves, terms):
    led = recorded.recorded_ledger(split(spark, moves), terms, S, (1, 4)).cache()
    for life in (1, 4):
        got = led.filter((F.col("strategy") == CANDIDATE) & (F.col("sku") == "a") & (F.col("setting_value") == life)).orderBy("date").select(*COLUMNS).collect()
        assert [tuple(r) for r in got] == [(w[0], *(pytest.approx(x) for x in w[1:])) for w in walked(moves, "a", "R", life)]
    points = {(r["strategy"], r["setting_value"]): r for r in recorded.recorded_frontier(led, S).collect()}
    assert len(points) == 4
    for name in (BASELINE, CANDIDATE):
        assert points[name, 1.0]["waste_units"] > points[name, 4.0]["waste_units"]
        assert points[name, 1.0]["unit_service_level"] < points[name, 4.0]["unit_service_level"]


def test_no_movements(spark, terms):
    led = recorded.recorded_ledger(split(spark, []), terms, S)
    assert led.count() == 0 and recorded.recorded_kpis(led, S).count() == 0
