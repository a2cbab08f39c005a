"""B: data checks and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import panels as P
from checks.registry import block, query
from larder.operators import quality, repair

S = P.S


def numeric_feed(spark, d):
    return repair.typed_units(P.feed(spark, d))


NUM = "SELECT date, sku, try_cast(units_sold AS DOUBLE) AS units_sold, ingest_seq, shelf_life_days, promo FROM feed"
block("feed_num", NUM, "feed")


@query("b2_b4_b5_b7_row_checks", """SELECT count(*) AS rows, count(*) FILTER (units_sold IS NULL) AS null_units,
 count(*) FILTER (units_sold < 0) AS negative_units, count(*) FILTER (promo NOT IN (0, 1)) AS bad_promo FROM feed_num""", ["feed_num"])
def b2(spark, d):
    return quality.row_check_counts(numeric_feed(spark, d))


@query("b5_negative_examples", """SELECT date, sku, units_sold FROM feed_num WHERE units_sold < 0 ORDER BY sku, date, units_sold LIMIT 5""",
       ["feed_num"], dates=["date"], doubles=["units_sold"])
def b5(spark, d):
    return quality.negative_examples(numeric_feed(spark, d))


@query("b6_duplicate_keys", "SELECT sku, date, count(*) AS copies FROM feed GROUP BY 1, 2 HAVING count(*) > 1", ["feed"], dates=["date"])
def b6(spark, d):
    return quality.duplicate_keys(P.feed(spark, d))


@query("b6_g6_duplicate_examples", """SELECT sku, date, count(*) AS copies FROM feed GROUP BY 1, 2 HAVING count(*) > 1
 ORDER BY sku, date LIMIT 5""", ["feed"], dates=["date"])
def b6b(spark, d):
    return quality.duplicate_examples(P.feed(spark, d))


@query("b8_shelf_life_constant", """SELECT sku, count(DISTINCT shelf_life_days) AS "values" FROM (SELECT sku,
 shelf_life_days + promo AS shelf_life_days FROM feed) GROUP BY 1 HAVING count(DISTINCT shelf_life_days) > 1""", ["feed"])
def b8(spark, d):
    rows = P.feed(spark, d).withColumn("shelf_life_days", F.col("shelf_life_days") + F.col("promo"))
    return quality.inconsistent_shelf_life(rows)


@query("b9_grid_gaps", """SELECT sku, date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS missing_days FROM daily_brand
 GROUP BY 1 HAVING missing_days > 0""", ["daily_brand"])
def b9(spark, d):
    return quality.grid_gaps(P.daily_brand(spark, d))


@query("b10_short_histories", "SELECT sku, count(*) AS days FROM daily_brand GROUP BY 1 HAVING count(*) < 1550", ["daily_brand"])
def b10(spark, d):
    return quality.short_histories(P.daily_brand(spark, d), 1550)


@query("b11_quality_report", """SELECT 'non_empty' AS "check", CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS violations,
 CAST(NULL AS VARCHAR) AS sample FROM feed_num
 UNION ALL SELECT 'null_units', count(*), min(sku) FROM feed_num WHERE units_sold IS NULL
 UNION ALL SELECT 'negative_units', count(*), min(sku) FROM feed_num WHERE units_sold < 0
 UNION ALL SELECT 'duplicate_rows', CAST(sum(n - 1) AS BIGINT), min(sku) FILTER (n > 1) FROM (SELECT sku, count(*) AS n FROM feed_num GROUP BY sku, date)
 UNION ALL SELECT 'flag_promo', count(*), min(sku) FROM feed_num WHERE promo NOT IN (0, 1)
 UNION ALL SELECT 'shelf_life_constant', count(*), min(sku) FROM (SELECT sku FROM feed_num GROUP BY sku HAVING min(shelf_life_days) <> max(shelf_life_days))
 UNION ALL SELECT 'missing_days', CAST(sum(m) AS BIGINT), min(sku) FILTER (m > 0) FROM (SELECT sku,
 date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS m FROM feed_num GROUP BY sku)""", ["feed_num"])
def b11(spark, d):
    return quality.quality_report(numeric_feed(spark, d))


@query("b12_drop_invalid", "SELECT * FROM feed_valid", ["feed_valid"], dates=["date"], doubles=["units_sold"])
def b12(spark, d):
    return repair.drop_invalid(P.feed(spark, d))


@query("b13_keep_first", "SELECT * FROM feed_first", ["feed_first"], dates=["date"], doubles=["units_sold"])
def b13(spark, d):
    return repair.clean_rows(P.feed(spark, d))


@query("b14_densify", "SELECT * FROM dense_brand", ["dense_brand"], dates=["date"], doubles=["units_sold"])
def b14(spark, d):
    return P.dense(P.daily_brand(spark, d))


block("missing", """SELECT g.sku, g.date FROM dense_brand g ANTI JOIN daily_brand o ON o.sku = g.sku AND o.date = g.date""", "dense_brand")


@query("h5_d16_missing_days", "SELECT * FROM missing", ["missing"], dates=["date"])
def h5(spark, d):
    return repair.missing_days(P.daily_brand(spark, d))


block("imputed", """SELECT m.sku, m.date,
 (SELECT median(o.units_sold) FROM daily_brand o WHERE o.sku = m.sku AND o.date < m.date AND o.date >= m.date - 28 AND isodow(o.date) = isodow(m.date)) AS same_weekday,
 (SELECT median(o.units_sold) FROM daily_brand o WHERE o.sku = m.sku AND o.date < m.date AND o.date >= m.date - 28) AS recent,
 (SELECT median(o.units_sold) FROM daily_brand o WHERE o.sku = m.sku) AS overall FROM missing m""", "missing")


@query("b15_impute", """SELECT sku, date, coalesce(same_weekday, recent, overall, 0.0) AS units_sold, true AS imputed,
 CASE WHEN same_weekday IS NOT NULL THEN 'same_weekday' WHEN recent IS NOT NULL THEN 'recent' WHEN overall IS NOT NULL THEN 'overall' ELSE 'zero' END AS source
 FROM imputed UNION ALL SELECT sku, date, units_sold, false, NULL FROM daily_brand""", ["imputed"], dates=["date"], doubles=["units_sold"])
def b15(spark, d):
    return repair.impute(repair.densify(P.daily_brand(spark, d)))


@query("b16_sku_constants", """SELECT m.sku, m.date, f.category, f.shelf_life_days FROM (SELECT g.sku, g.date FROM dense_type g ANTI JOIN daily_type o
 ON o.sku = g.sku AND o.date = g.date) m JOIN (SELECT sku, arg_min(category, date) AS category, arg_min(shelf_life_days, date) AS shelf_life_days
 FROM gappy_type GROUP BY sku) f USING (sku)""", ["gappy_type", "dense_type"], dates=["date"])
def b16(spark, d):
    return repair.repair_sales(P.gappy_type(spark, d), s=S).filter("imputed").select("sku", "date", "category", "shelf_life_days")


@query("b17_shared_by_date", """SELECT date, arg_min(temp_c, sku) AS temp_c, arg_min(dow, sku) AS dow, arg_min(bank_holiday, sku) AS bank_holiday, true AS date_known
 FROM gappy_type GROUP BY date""", ["gappy_type"], dates=["date"], doubles=["temp_c"])
def b17(spark, d):
    return repair.shared_by_date(P.gappy_type(spark, d), ["temp_c", "dow", "bank_holiday"])


@query("b18_b19_repaired_panel", """WITH cal AS (SELECT DISTINCT date, temp_c, bank_holiday, school_holiday FROM gappy_type),
 m AS (SELECT g.sku, g.date FROM dense_type g ANTI JOIN daily_type o ON o.sku = g.sku AND o.date = g.date),
 e AS (SELECT m.*, (SELECT median(o.units_sold) FROM daily_type o WHERE o.sku = m.sku AND o.date < m.date AND o.date >= m.date - 28 AND isodow(o.date) = isodow(m.date)) AS a,
 (SELECT median(o.units_sold) FROM daily_type o WHERE o.sku = m.sku AND o.date < m.date AND o.date >= m.date - 28) AS b,
 (SELECT median(o.units_sold) FROM daily_type o WHERE o.sku = m.sku) AS c FROM m)
 SELECT date, sku, units_sold, temp_c, bank_holiday, school_holiday, weekend, dow, promo, false AS imputed FROM gappy_type UNION ALL
 SELECT e.date, e.sku, coalesce(a, b, c, 0.0), cal.temp_c, cal.bank_holiday, cal.school_holiday, CASE WHEN isodow(e.date) >= 5 THEN 1 ELSE 0 END,
 CAST(isodow(e.date) - 1 AS INTEGER), 0, true FROM e LEFT JOIN cal ON cal.date = e.date""", ["gappy_type", "dense_type", "daily_type"],
       dates=["date"], doubles=["units_sold", "temp_c"])
def b18(spark, d):
    return repair.repair_sales(P.gappy_type(spark, d), s=S).drop("category", "shelf_life_days")


@query("b20_repair_report", """WITH c AS (SELECT (SELECT count(*) FROM feed) - (SELECT count(*) FROM feed_valid) AS invalid_rows_dropped,
 (SELECT count(*) FROM feed_valid) - (SELECT count(*) FROM feed_first) AS duplicate_rows_dropped,
 (SELECT CAST(sum(date_diff('day', lo, hi) + 1 - n) AS BIGINT) FROM (SELECT min(date) AS lo, max(date) AS hi, count(*) AS n FROM feed_first GROUP BY sku)) AS missing_days_filled,
 (SELECT count(DISTINCT sku) FROM feed) AS skus_affected,
 (SELECT count(*) FROM (SELECT sku, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM feed_first GROUP BY sku)
  WHERE date NOT IN (SELECT date FROM feed_first)) AS days_without_calendar)
 SELECT *, false AS clean, 'Sales feed repaired: ' || invalid_rows_dropped || ' invalid row(s) dropped; ' || duplicate_rows_dropped ||
 ' duplicate row(s) dropped; ' || missing_days_filled || ' missing day(s) filled' || CASE WHEN days_without_calendar > 0 THEN ' (' || days_without_calendar ||
 ' without a calendar to copy)' ELSE '' END || '. Products affected: ' || skus_affected || '.' AS summary FROM c""", ["feed_first"])
def b20(spark, d):
    return repair.repair_report(P.feed(spark, d))


@query("b20_affected_skus", """SELECT f.sku, f.n - v.n AS invalid_rows_dropped, v.n - k.n AS duplicate_rows_dropped,
 date_diff('day', lo, hi) + 1 - k.n AS missing_days_filled FROM (SELECT sku, count(*) AS n FROM feed GROUP BY 1) f
 JOIN (SELECT sku, count(*) AS n FROM feed_valid GROUP BY 1) v USING (sku)
 JOIN (SELECT sku, count(*) AS n, min(date) AS lo, max(date) AS hi FROM feed_first GROUP BY 1) k USING (sku)""", ["feed_first"])
def b20b(spark, d):
    return repair.affected_skus(P.feed(spark, d))


@query("b22_past_only", "SELECT sku, count(*) AS days FROM daily_type WHERE date < DATE '2001-07-02' GROUP BY sku", ["daily_type"])
def b22(spark, d):
    past = P.daily_type(spark, d).filter(F.col("date") < F.lit(P.AS_OF))
    return quality.require_past_only(past, P.AS_OF).groupBy("sku").agg(F.count(F.lit(1)).alias("days"))


@query("b22_leaking_rows", "SELECT sku, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM daily_type WHERE date >= DATE '2001-07-02' GROUP BY sku", ["daily_type"], dates=["first_date", "last_date"])
def b22_leaks(spark, d):
    """The whole panel as history of a decision in its middle: everything from that day on leaks."""
    return quality.leaking_rows(P.daily_type(spark, d), P.AS_OF)


@query("b23_unknown_keys", "SELECT DISTINCT sku FROM daily_brand ANTI JOIN terms_brand USING (sku)", ["daily_brand", "terms_brand"])
def b23(spark, d):
    return quality.unknown_keys(P.daily_brand(spark, d), P.terms(spark, d))
