"""The store reads and writes only what changes and never loses a complete state."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators.quality import DataQualityError
from larder.sources import store


def sales(panel, factor=1.0):
    return panel.withColumn("units_sold", F.col("units_sold") * factor)


def rows(df):
    return sorted((r["sku"], r["date"], r["units_sold"]) for r in df.select("sku", "date", "units_sold").collect())


def test_only_partitions_with_new_rows_are_written(spark, panel, tmp_path):
    kept = store.Store(spark, str(tmp_path / "db"))
    kept.save_sales(panel)
    number, before = kept.manifest("sales")
    assert number == 1 and set(before) == {"2025-01", "2025-02", "2025-03", "2025-04", "2025-05"}
    march = F.month("date") == 3
    kept.save_sales(sales(panel, 2.0).filter(march))
    number, after = kept.manifest("sales")
    assert number == 2 and {p for p in after if after[p] != before[p]} == {"2025-03"}
    assert rows(kept.load_table("sales")) == rows(panel.withColumn("units_sold", F.col("units_sold") * F.when(march, 2.0).otherwise(1.0)))
    read = kept.load_table("sales").inputFiles()
    assert len({f.split("/part=")[1].split("/")[0] for f in read}) == 5 and kept.load_table("sales").count() == panel.count()
    assert kept.expire("sales") == 0  # the first folder still holds four months
    kept.save_sales(sales(panel, 3.0))
    assert kept.expire("sales") == 2 and rows(kept.load_table("sales")) == rows(sales(panel, 3.0))


def test_the_second_of_two_writers_starts_over(spark, panel, tmp_path, monkeypatch):
    kept, other = (store.Store(spark, str(tmp_path / "db")) for _ in range(2))
    kept.save_sales(panel)
    first, second = dt.date(2025, 1, 5), dt.date(2025, 1, 9)
    write, calls = kept._write, []

    def interrupted(table, data):
        calls.append(table)
        if len(calls) == 1:  # someone else saves between the read and the commit
            other.save_sales(sales(panel, 2.0).filter(F.col("date") == F.lit(first)))
        return write(table, data)

    monkeypatch.setattr(kept, "_write", interrupted)
    kept.save_sales(sales(panel, 3.0).filter(F.col("date") == F.lit(second)))
    assert len(calls) == 2 and kept.manifest("sales")[0] == 3
    factor = F.when(F.col("date") == F.lit(first), 2.0).when(F.col("date") == F.lit(second), 3.0).otherwise(1.0)
    assert rows(other.load_table("sales")) == rows(panel.withColumn("units_sold", F.col("units_sold") * factor))


def test_a_lost_save_leaves_the_last_state(spark, panel, tmp_path):
    kept = store.Store(spark, str(tmp_path / "db"))
    kept.save_sales(panel)
    broken = panel.withColumn("units_sold", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        kept.save_sales(broken)
    assert kept.manifest("sales")[0] == 1 and rows(kept.load_table("sales")) == rows(panel)


def test_tables_without_dates_batches_and_queries(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "db"))
    with pytest.raises(DataQualityError, match="no table 'skus'"):
        kept.load_table("skus")
    columns = store.columns_of("simulation_results")
    kept.replace("simulation_results", spark.createDataFrame([("r", "a", f"m{i}", float(i)) for i in range(40)], columns))
    kept.replace("simulation_results", spark.createDataFrame([("r", "a", "m7", 70.0), ("r", "a", "m7", 71.0), ("s", "a", "m7", 1.0)], columns))
    got = {(r["run_id"], r["metric"]): r["value"] for r in kept.load_table("simulation_results").collect()}
    assert len(got) == 41 and got["r", "m7"] == 71.0 and got["r", "m8"] == 8.0
    kept.replace("simulation_results", spark.createDataFrame([], "run_id string, strategy string, metric string, value double"))
    assert kept.manifest("simulation_results")[0] == 2
    over = "run_id string, as_of date, sku string, recommended_order double, override_order double"
    for quantity in (1.0, 2.0):
        kept.record_overrides(spark.createDataFrame([("r", dt.date(2025, 1, 1), "x", 5.0, quantity)], over))
    assert sorted(r["override_order"] for r in kept.load_overrides("r").collect()) == [1.0, 2.0]
    found = kept.read("SELECT count(*) AS n FROM simulation_results WHERE value >= :least", {"least": 30.0}).first()["n"]
    assert found == 11 and kept.tables() == ["recommendation_overrides", "simulation_results"]
