"""Queries over small tables of their own: routed forecasts with the global model, rankings by value, one pass over the tables."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import panels, q_features, q_models
from larder.operators import models
from larder.plans import service
from larder.settings import Settings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One brand sold every day, one every fourth day; prices whose sums are no doubles."""
    root = str(tmp_path_factory.mktemp("tables"))
    first = dt.datetime(2001, 2, 1)
    lines = []
    for i in range(165):
        day = first + dt.timedelta(days=i)
        lines.append((i, 1, 1, 20.0 + i % 7, 0.1, day))
        if i % 4 == 0:
            lines.append((i, 2, 2, 3.0, 0.7, day))
    lines += [(900 + i, 3, 3, 1.0, x, first) for i, x in enumerate([1e9 + 0.01, *[0.1] * 30])] + [(950 + i, 4, 4, 1.0, x, first) for i, x in enumerate([*[0.1] * 30, 1e9 + 0.01])]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{root}/lineitem.parquet")
    parts = [(1, "a", "Brand#1", "T1", 10.0), (2, "b", "Brand#2", "T2", 20.0), (3, "z", "Brand#1", "T1", 10.0), (4, "y", "Brand#1", "T1", 10.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{root}/part.parquet")
    return root


def test_routed_queries_serve_products_of_the_global_model(spark, folder, monkeypatch):
    monkeypatch.setattr(q_models, "S", q_models.S.but(gbt_rounds=2, gbt_depth=2))
    served = {(r["sku"], r["model"]) for r in q_models.j17(spark, folder).collect()}
    assert served == {("Brand#1", models.BOOSTED), ("Brand#2", models.CROSTON_SBA)}
    scenarios = q_models.j17b(spark, folder).groupBy("sku", "scenario").count().collect()
    assert {(r["sku"], r["scenario"], r["count"]) for r in scenarios} == {(s, x, 7) for s in ("Brand#1", "Brand#2") for x in ("Base case", "Coach party")}
    saved = q_models.a9(spark, folder)
    assert saved.count() == 14 and {r["model"] for r in saved.filter("sku = 'Brand#1'").collect()} == {models.BOOSTED}


def jobs_until_now(spark) -> int:
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "count")
    spark.range(1).count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_saved_forecasts_take_few_jobs(spark, folder, monkeypatch):
    """Sixty rounds of depth 6, twice: a job for each level of a tree would be 720."""
    monkeypatch.setattr(q_models, "S", q_models.S.but(gbt_rounds=60))
    first = jobs_until_now(spark)
    rows = q_models.a9(spark, folder).collect()
    assert jobs_until_now(spark) - first < 400
    assert {(r["sku"], r["model"]) for r in rows} == {("Brand#1", models.BOOSTED), ("Brand#2", models.CROSTON_SBA)} and len(rows) == 14


def test_recent_accuracy_takes_few_jobs(spark, folder, monkeypatch):
    """Four origins with two fits each, sixty rounds of depth 6: a job for each level of a tree would be 2,880."""
    monkeypatch.setattr(q_models, "S", q_models.S.but(gbt_rounds=60))
    first = jobs_until_now(spark)
    (row,) = q_models.e11(spark, folder).collect()
    assert jobs_until_now(spark) - first < 1200
    # The two brands sell 20 to 26 every day and 3 every fourth.
    assert (row["days"], row["start"], row["end"]) == (28, dt.date(2001, 6, 4), dt.date(2001, 7, 1))
    assert row["total_actual"] == sum(20.0 + i % 7 + (3.0 if i % 4 == 0 else 0.0) for i in range(123, 151))
    assert row["total_predicted"] == pytest.approx(row["total_actual"], rel=0.05)


def test_values_are_summed_exactly_and_equal_ones_rank_by_name(spark, folder):
    rows = [tuple(r) for r in q_features.f6(spark, folder).orderBy("position").collect()]
    big = Decimal("1000000003.01")
    total = [big, 2 * big, 2 * big + Decimal("29.4"), 2 * big + Decimal("45.9")]
    assert rows == [(sku, i + 1, float(v)) for i, (sku, v) in enumerate(zip(("y4", "z3", "b2", "a1"), total, strict=True))]


def test_plans_of_many_jobs_compute_their_panel_once(spark, panel):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(units):
        read.add(1)
        return units

    sales = panel.withColumn("units_sold", counted.asNondeterministic()("units_sold"))
    costs = spark.createDataFrame([("Smooth", 2.0), ("Spiky", 1.0)], "sku string, unit_cost double")
    s = Settings(gbt_rounds=1, gbt_depth=1, gbt_min_leaf=5, sigma_tail_days=14, perfect_foresight=True)
    anchored = spark.createDataFrame([(d, d) for d in (dt.date(2025, 4, 8), dt.date(2025, 4, 15))], "as_of date, anchor date")
    rows = service.choose_at_anchors(sales, costs, anchored, s)
    assert rows.count() == 4
    assert read.value == panel.count()
    service.anchored_forecast(sales, costs, F.array(F.lit(dt.date(2025, 4, 8)), F.lit(dt.date(2025, 4, 15))), 7, s).collect()
    assert read.value == 2 * panel.count()
    service.choose_models(sales, costs, dt.date(2025, 5, 1), s, "validated", 2, {models.SEASONAL: models.seasonal_naive}).collect()
    assert read.value == 3 * panel.count()
    assert panels.S.gbt_rounds == Settings().gbt_rounds
