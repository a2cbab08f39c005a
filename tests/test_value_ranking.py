"""f6_value_ranking: equal values are ties, in whatever order their prices are summed."""

import checks


def test_equal_sums_are_ranked_by_sku(spark, tmp_path):
    part = spark.createDataFrame([(1, "b"), (2, "a")], "p_partkey long, p_name string")
    prices = [(1, 1e15), (1, 0.3), (1, 0.3), (1, 0.3), (2, 0.3), (2, 0.3), (2, 0.3), (2, 1e15)]
    lines = spark.createDataFrame(prices, "l_partkey long, l_extendedprice double").coalesce(1)
    part.write.parquet(f"{tmp_path}/part.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = checks.queries()["f6_value_ranking"](spark, str(tmp_path)).orderBy("position").collect()
    assert [r["sku"] for r in rows] == ["a2", "b1"]
