"""Column functions against hand-computed numbers."""

from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from larder.functions import accuracy, calendar, normal, stock
from larder.settings import Settings


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_normal_curves(spark):
    ps = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.71, 0.95, 0.995, 1 - 1e-7]
    xs = [-9.0, -4.2, -1.0, 0.0, 0.3, 2.5, 7.5]
    q = one(spark, **{f"q{i}": normal.normal_quantile(F.lit(p)) for i, p in enumerate(ps)})
    c = one(spark, **{f"c{i}": normal.normal_cdf(F.lit(x)) for i, x in enumerate(xs)})
    assert list(q) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12)
    assert list(c) == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)
    assert one(spark, x=normal.normal_quantile(F.lit(1.0)))["x"] is None


def test_safety_stock_and_expected_demand(spark):
    f, seven = F.array(*[F.lit(v) for v in (10.0, 20.0, 30.0)]), F.array_repeat(F.lit(20.0), 7)
    row = one(
        spark,
        ss=stock.safety_stock(F.lit(10.0), F.lit(4), F.lit(0.95)),
        low=stock.safety_stock(F.lit(10.0), F.lit(4), F.lit(0.3)),
        part=stock.expected_demand(f, F.lit(2.5)),
        beyond=stock.expected_demand(seven, F.lit(10)),
        edge=stock.expected_demand(f, F.lit(3.5)),
        none=stock.expected_demand(f, F.lit(0)),
    )
    assert row["ss"] == pytest.approx(32.897, abs=1e-3)
    assert (row["low"], row["part"], row["none"]) == (0.0, 45.0, 0.0)
    assert row["beyond"] == pytest.approx(200.0)
    assert row["edge"] == pytest.approx(70.0)


def test_pack_rounding_risk_and_service_levels(spark):
    row = one(
        spark,
        even=stock.round_to_pack(F.lit(30.0), F.lit(12)), up=stock.round_to_pack(F.lit(25.0), F.lit(12), "up"),
        zero=stock.round_to_pack(F.lit(-3.0), F.lit(12)), worse=stock.worse_risk(F.lit("low"), F.lit("medium")),
        a=stock.segment_service_level(F.lit("A"), F.lit(0.99)), c=stock.segment_service_level(F.lit("C"), F.lit(0.95)),
        sure=stock.stockout_probability(F.lit(5.0), F.lit(6.0), F.lit(0.0), F.lit(3)), life=stock.usable_life(F.lit(1), F.lit(0.4)),
        both=stock.improvement_pct(F.lit(0.0), F.lit(0.0), F.lit(True)), undefined=stock.improvement_pct(F.lit(0.0), F.lit(2.0), F.lit(True)),
    )
    assert (row["even"], row["up"], row["zero"], row["worse"]) == (24.0, 36.0, 0.0, "medium")
    assert row["a"] == 0.995 and row["c"] == pytest.approx(0.92)
    assert (row["sure"], row["life"], row["both"], row["undefined"]) == (1.0, 1.0, 0.0, None)
    with pytest.raises(ValueError):
        stock.round_to_pack(F.lit(1.0), F.lit(2), "sideways")


def test_accuracy_measures(spark):
    df = spark.createDataFrame([(0.0, 5.0, 2.0), (101.0, 106.0, 2.0), (0.0, 0.0, 2.0)], "y double, f double, s double")
    row = df.agg(accuracy.smape("y", "f").alias("sm"), accuracy.wape("y", "f").alias("wa"), accuracy.mase("y", "f", "s").alias("ma"),
                 accuracy.bias("y", "f").alias("bi")).first()
    assert row["sm"] == pytest.approx((200 + 200 * 5 / 207) / 3)
    assert (row["wa"], row["ma"], row["bi"]) == pytest.approx((1000 / 101, 10 / 3 / 2, 10 / 3))
    empty = df.filter("y = 0 AND f = 5").agg(accuracy.wape("y", "f").alias("wa")).first()
    assert empty["wa"] is None


def test_calendar(spark):
    s = Settings()
    xmas, friday = F.lit(dt.date(2025, 12, 25)), F.lit(dt.date(2025, 7, 4))
    row = one(
        spark, label=calendar.day_label(xmas, s), today=calendar.next_order_date(friday, s), later=calendar.next_order_date(friday, s, False),
        review=calendar.days_to_order_day(friday, s), anchor=calendar.refit_anchor(F.lit(dt.date(2025, 6, 29)), s.start, F.lit(dt.date(2024, 3, 1)), s),
        early=calendar.refit_anchor(F.lit(dt.date(2024, 3, 3)), s.start, F.lit(dt.date(2024, 3, 1)), s),
    )
    assert row["label"] == "25 Dec (Thursday, bank holiday, school holiday, site closed)"
    assert (row["today"], row["later"], row["review"]) == (dt.date(2025, 7, 4), dt.date(2025, 7, 7), 3)
    assert row["anchor"] == dt.date(2025, 6, 24)
    assert row["early"] == dt.date(2024, 3, 3)


def test_settings_are_checked():
    for bad in ({"service_level": 1.0}, {"pack_rounding": "down"}, {"policy": "x"}, {"usable_fraction": 0.0}, {"order_days": ()}):
        with pytest.raises(ValueError):
            Settings(**bad)
