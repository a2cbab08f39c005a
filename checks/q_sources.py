"""A: sources, SKU dimension, keyed tables, report tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import panels as P
from checks.registry import query
from larder.operators import ordering
from larder.plans import decisions
from larder.sources import exports, folder, sales as src, store

S = P.S


@query("a1_sales_scan", """SELECT sku, date, category, shelf_life_days, units_sold, temp_c, bank_holiday, school_holiday, weekend, dow, promo
 FROM gappy_type""", ["gappy_type"], dates=["date"], doubles=["units_sold", "temp_c"])
def a1(spark, d):
    """The panel as a CSV file with one more column, read back."""
    path = folder.fresh(spark)
    P.gappy_type(spark, d).select(*src.SALES_COLUMNS, F.lit(1).alias("ingest_seq")).write.option("header", True).csv(path)
    rows = src.load_sales(spark, path, validate=False)
    return rows.filter("ingest_seq = 1").drop("ingest_seq")


@query("a2_sku_economics", "SELECT * FROM econ_brand", ["econ_brand"],
       doubles=["unit_cost", "holding_cost_per_unit_per_day", "waste_cost_per_unit", "stockout_cost_per_unit"])
def a2(spark, d):
    return P.econ(spark, d)


MASTER = """SELECT m.*, e.unit_cost, e.pack_size, e.min_order_quantity, e.holding_cost_per_unit_per_day, e.waste_cost_per_unit,
 e.stockout_cost_per_unit FROM (SELECT sku, arg_min(category, date) AS category, arg_min(shelf_life_days, date) AS shelf_life_days,
 avg(units_sold) AS mean_daily_units, avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) AS zero_day_share
 FROM sales_brand GROUP BY sku) m JOIN econ_brand e USING (sku)"""
P.block("master", MASTER, "sales_brand", "econ_brand")
MONEY = ["unit_cost", "holding_cost_per_unit_per_day", "waste_cost_per_unit", "stockout_cost_per_unit"]


def master(spark, d):
    return src.sku_master(P.sales_brand(spark, d), P.terms(spark, d), S)


@query("a3_sku_master", "SELECT * FROM master", ["master"], doubles=[*MONEY, "mean_daily_units", "zero_day_share"])
def a3(spark, d):
    return master(spark, d)


@query("a4_sku_list", "SELECT DISTINCT sku FROM gappy_type ORDER BY sku", ["gappy_type"])
def a4(spark, d):
    return src.sku_list(P.gappy_type(spark, d))


@query("a5_keyed_replace", """SELECT sku, date, units_sold, origin FROM (SELECT *, row_number() OVER (PARTITION BY sku, date ORDER BY age DESC) AS rn FROM (
 SELECT sku, date, units_sold, 'old' AS origin, 0 AS age FROM daily_type UNION ALL
 SELECT sku, date, units_sold * 2, 'new', 1 FROM daily_type WHERE day(date) <= 7)) WHERE rn = 1""", ["daily_type"], dates=["date"], doubles=["units_sold"])
def a5(spark, d):
    old = P.daily_type(spark, d).withColumn("origin", F.lit("old"))
    new = P.daily_type(spark, d).filter(F.dayofmonth("date") <= 7)
    new = new.withColumns({"units_sold": F.col("units_sold") * 2, "origin": F.lit("new")})
    return store.replace_rows(old, new, ["sku", "date"])


@query("a5_store_upsert", """SELECT sku, date, CASE WHEN day(date) <= 7 AND year(date) = 1998 THEN units_sold * 2 ELSE units_sold END AS units_sold, promo FROM gappy_type""",
       ["gappy_type"], dates=["date"], doubles=["units_sold"])
def a5_store(spark, d):
    """The panel saved, then the first week of every month of a year saved again: only those months are read and written."""
    kept, panel = store.Store(spark, folder.fresh(spark)), P.gappy_type(spark, d)
    kept.save_sales(panel)
    again = panel.filter((F.dayofmonth("date") <= 7) & (F.year("date") == 1998))
    kept.save_sales(again.withColumn("units_sold", F.col("units_sold") * 2))
    return kept.load_table("sales").select("sku", "date", "units_sold", "promo")


@query("a6_append_rows", """SELECT o_orderpriority AS sku, count(*) AS lines, sum(o_totalprice * 2) AS quantity FROM orders GROUP BY 1""", doubles=["quantity"])
def a6(spark, d):
    """Overrides recorded in two batches: appended, nothing replaced."""
    o = P.table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.lit(P.AS_OF).alias("as_of"), F.col("o_orderpriority").alias("sku"), F.lit("batch").alias("reason"),
        F.col("o_totalprice").cast("double").alias("recommended_order"), (F.col("o_totalprice") * 2).cast("double").alias("override_order"), "o_orderkey",
    )
    kept = store.Store(spark, folder.fresh(spark))
    for half in (0, 1):
        kept.record_overrides(rows.filter(F.col("o_orderkey") % 2 == half).drop("o_orderkey"))
    return kept.load_overrides().groupBy("sku").agg(F.count(F.lit(1)).alias("lines"), F.sum("override_order").alias("quantity"))


@query("a8_sales_rows", """SELECT date, sku, units_sold, temp_c, bank_holiday, school_holiday, weekend, dow, promo FROM sales_type""",
       ["sales_type"], dates=["date"], doubles=["units_sold", "temp_c"])
def a8(spark, d):
    return store.replace_rows(None, P.sales_type(spark, d).select(*store.columns_of("sales")), store.keys_of("sales"))


@query("a11_overrides", f"""SELECT 'run-1' AS run_id, o_orderpriority AS sku, CAST(count(*) AS DOUBLE) AS recommended_order,
 CAST(count(*) * 2 AS DOUBLE) AS override_order, 'event' AS reason, CAST('{P.AS_OF}' AS DATE) AS as_of FROM orders GROUP BY 2""", dates=["as_of"])
def a11(spark, d):
    """Manager overrides: checked rows without the clock column."""
    n = P.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("sku")).agg(F.count(F.lit(1)).cast("double").alias("recommended_order"))
    rows = n.withColumns({
        "override_order": F.col("recommended_order") * 2, "run_id": F.lit("run-1"), "as_of": F.lit(P.AS_OF), "reason": F.lit("event"),
    })
    return store.checked_overrides(rows).drop("recorded_at")


def stored_sales(spark, d):
    """The panel written to a store, its first week of each month twice."""
    kept = store.Store(spark, folder.fresh(spark))
    kept.save_sales(P.sales_type(spark, d).withColumn("units_sold", F.when(F.dayofmonth("date") <= 7, -1.0).otherwise(F.col("units_sold"))))
    kept.save_sales(P.sales_type(spark, d).filter(F.dayofmonth("date") <= 7))
    return kept


@query("a15_parameter_query", """SELECT sku, count(*) AS days, sum(units_sold) AS units FROM sales_type WHERE units_sold >= 100 GROUP BY sku""",
       ["sales_type"], doubles=["units"])
def a15(spark, d):
    return stored_sales(spark, d).read("SELECT sku, count(*) AS days, sum(units_sold) AS units FROM sales WHERE units_sold >= :least GROUP BY sku", {"least": 100})


@query("a16_overrides_newest_first", "SELECT o_orderkey AS run_id, o_custkey AS sku, CAST(o_orderdate AS DATE) AS recorded_at FROM orders", dates=["recorded_at"])
def a16(spark, d):
    o = P.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("sku"), F.col("o_orderdate").cast("date").alias("recorded_at"))
    return store.newest_overrides(o)


@query("a14_load_table", "SELECT sku, count(*) AS days, sum(units_sold) AS units FROM sales_type GROUP BY sku", ["sales_type"], doubles=["units"])
def a14(spark, d):
    return stored_sales(spark, d).load_table("sales").groupBy("sku").agg(F.count(F.lit(1)).alias("days"), F.sum("units_sold").alias("units"))


@query("a22_synthetic_panel")
def a22(spark, d):
    """A made-up panel for the brands of the parts table, drawn per (SKU, day)."""
    parts = P.table(spark, d, "part").groupBy(F.col("p_brand").alias("sku")).agg(F.avg("p_size").alias("base"))
    cat = parts.select(
        "sku", F.concat(F.lit("C"), (P.number() % 7).cast("string")).alias("category"), "base",
        F.lit(1.4).alias("weekend_factor"), F.lit(0.05).alias("temp_effect"), F.lit(0.3).alias("holiday_effect"),
        F.when(P.number() % 4 == 0, 0.4).otherwise(0.0).alias("zero_inflation"), (3 + P.number() % 5).cast("int").alias("shelf_life_days"))
    return src.synthetic_sales(cat, dt.date(1999, 1, 1), dt.date(2000, 12, 31), S)
