"""Checks, repair, ordering without a global sort, features and leakage."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import features, models, ordered, quality, repair, segments, slices
from larder.settings import Settings
from larder.sources import sales as src

S = Settings(perfect_foresight=True)
AS_OF = dt.date(2025, 5, 1)


def rows(df, *keys):
    return sorted(map(tuple, df.select(*keys).collect()))


def test_clean_feed_is_left_alone(feed):
    quality.require_valid(feed)
    fixed = repair.repair_sales(feed, s=S)
    assert rows(fixed.drop("imputed"), *feed.columns) == rows(feed, *feed.columns)
    report = repair.repair_report(feed).first()
    assert report["clean"] and report["summary"] == "Sales feed needed no repair."


def test_damage_is_repaired_and_counted(spark, feed):
    gone = (F.col("sku") == "Milk") & F.col("date").isin(dt.date(2025, 1, 15), dt.date(2025, 1, 22))
    extra = feed.filter("sku = 'Bacon'").limit(1)
    null = feed.withColumn("units_sold", F.when((F.col("sku") == "Bacon") & (F.col("date") == dt.date(2025, 1, 20)), None).otherwise(F.col("units_sold")))
    hurt = null.filter(~gone).unionByName(extra)
    with pytest.raises(quality.DataQualityError, match="missing_days"):
        quality.require_valid(hurt)
    fixed = repair.repair_sales(hurt, s=S)
    quality.require_valid(fixed)
    filled = {(r["sku"], r["date"]): r for r in fixed.filter("imputed").collect()}
    assert set(filled) == {("Milk", dt.date(2025, 1, 15)), ("Milk", dt.date(2025, 1, 22)), ("Bacon", dt.date(2025, 1, 20))}
    assert filled["Milk", dt.date(2025, 1, 15)]["units_sold"] == 41.0 and filled["Milk", dt.date(2025, 1, 15)]["dow"] == 2
    report = repair.repair_report(hurt).first()
    assert (report["invalid_rows_dropped"], report["duplicate_rows_dropped"], report["missing_days_filled"], report["skus_affected"]) == (1, 1, 3, 2)
    again = repair.repair_sales(fixed, s=S)
    assert rows(again, *fixed.columns) == rows(fixed, *fixed.columns)


def test_running_order_matches_a_plain_sort(spark):
    rng = random.Random(3)
    # A third of the values are equal: ties must not gather in one range.
    data = [(f"s{i:05d}", 5.0 if i % 3 == 0 else float(rng.randint(0, 400))) for i in range(3000)]
    df = spark.createDataFrame(data, "sku string, v double").repartition(7)
    got = {r["sku"]: (r["position"], r["total"]) for r in ordered.running(df, [-F.col("v"), F.col("sku")], {"total": F.col("v")}, 16).collect()}
    total = 0.0
    for i, (sku, v) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        total += v
        assert got[sku][0] == i and got[sku][1] == pytest.approx(total)


def test_lags_and_rolling_means(panel):
    out = features.engineer(panel, S).filter("sku = 'Spiky'").orderBy("date").collect()
    units = [r["units_sold"] for r in out]
    assert all(r["roll28"] is None for r in out[:28])
    assert out[60]["lag7"] == units[53] and out[60]["lag14"] == units[46]
    assert out[60]["roll28"] == pytest.approx(sum(units[32:60]) / 28)


@pytest.mark.parametrize("factor", [0.0, 100.0])
def test_future_demand_never_moves_the_past(panel, factor):
    poked = panel.withColumn("units_sold", F.when(F.col("date") >= AS_OF, F.col("units_sold") * factor + 7).otherwise(F.col("units_sold")))
    at = F.array(F.lit(AS_OF))
    costs = panel.select("sku", F.lit(2.0).alias("unit_cost")).distinct()

    def outcome(df):
        fc = models.forecast_all(df, at, 7, S)
        ft = features.future_features(df, at, 7, S)
        sg = segments.segment_skus(df, costs, AS_OF, S)
        return (rows(fc, "sku", "model", "step", "predicted_demand", "sigma"), rows(ft, "sku", "step", "lag7", "lag14", "roll28", "temp_c"),
                rows(sg, "sku", "segment", "annual_value"))

    assert outcome(panel) == outcome(poked)


def test_guards(panel):
    with pytest.raises(quality.DataQualityError):
        quality.require_no_outcomes(panel)
    with pytest.raises(Exception, match="not before"):
        quality.require_past_only(panel, AS_OF).collect()
    with pytest.raises(Exception, match="need 1400 days"):
        slices.rolling_origins(panel, 200, 7).collect()
    with pytest.raises(ValueError):
        slices.Scenario(demand_uplift_pct=-150.0)
    assert quality.window_problems(dt.date(2025, 2, 1), dt.date(2025, 3, 1), dt.date(2025, 1, 1), dt.date(2025, 5, 20), 365)[0].startswith("warning")
    assert len(quality.window_problems(dt.date(2024, 1, 1), dt.date(2026, 1, 1), dt.date(2025, 1, 1), dt.date(2025, 5, 20), 0)) == 2


def test_csv_source(spark, feed, tmp_path):
    path = str(tmp_path / "sales")
    feed.write.option("header", True).csv(path)
    assert rows(src.load_sales(spark, path), *feed.columns) == rows(feed, *feed.columns)
    with pytest.raises(FileNotFoundError):
        src.load_sales(spark, str(tmp_path / "nothing"))


def test_synthetic_panel_ignores_partitioning(spark):
    cat = spark.createDataFrame([("A", "C", 50.0, 1.5, 0.1, 0.2, 0.0, 5), ("B", "C", 3.0, 1.2, 0.0, 0.0, 0.5, 3)],
                                "sku string, category string, base double, weekend_factor double, temp_effect double, holiday_effect double, zero_inflation double, shelf_life_days int")
    make = lambda df: src.synthetic_sales(df, dt.date(2024, 1, 1), dt.date(2025, 12, 31))
    one, many = make(cat), make(cat.repartition(5))
    assert rows(one, "sku", "date", "units_sold", "temp_c") == rows(many, "sku", "date", "units_sold", "temp_c")
    stats = {r["sku"]: r for r in one.groupBy("sku").agg(F.avg("units_sold").alias("m"), F.avg((F.col("units_sold") == 0).cast("int")).alias("z"), F.count("*").alias("n")).collect()}
    assert stats["A"]["n"] == 731 and 50 < stats["A"]["m"] < 75 and 0.4 < stats["B"]["z"] < 0.65
    assert one.filter("date = '2025-12-25'").agg(F.max("units_sold")).first()[0] <= 1
