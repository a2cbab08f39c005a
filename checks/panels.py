"""Sales panels, dimensions and logs derived from the driver's tables, with the same text in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import block, shared
from larder.functions.calendar import calendar_columns
from larder.operators.repair import densify
from larder.settings import Settings
from larder.sources.sales import economics

YEARS = range(1995, 2002)


def _monday(year: int, month: int, last: bool) -> dt.date:
    if last:
        day = dt.date(year, month, 31)
        return day - dt.timedelta(days=day.weekday())
    day = dt.date(year, month, 1)
    return day + dt.timedelta(days=-day.weekday() % 7)


HOLIDAYS = tuple(
    sorted(
        d for y in YEARS
        for d in (dt.date(y, 1, 1), _monday(y, 5, False), _monday(y, 5, True), _monday(y, 8, True), dt.date(y, 12, 25), dt.date(y, 12, 26))
    )
)
CLOSED = tuple(dt.date(y, 12, 25) for y in YEARS)
AS_OF = dt.date(2001, 7, 2)
START, END = dt.date(2001, 1, 1), dt.date(2001, 6, 30)
S = Settings(bank_holidays=HOLIDAYS, closed_days=CLOSED, perfect_foresight=True, start=START, end=END)


def sql_dates(dates) -> str:
    return ", ".join(f"DATE '{d}'" for d in dates)


H_SQL, C_SQL = sql_dates(HOLIDAYS), sql_dates(CLOSED)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@shared
def daily(spark: SparkSession, d: str, sku: str, flag: str | None = None) -> DataFrame:
    """Units per (SKU, day) from order lines.

    The join is left to the planner: small parts are broadcast by their measured size, large ones
    sort-merge with adaptive skew splitting.  The aggregate combines lines map-side.
    """
    li = table(spark, d, "lineitem")
    if flag:
        li = li.filter(F.col("l_returnflag") == flag)
    li = li.select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    part = table(spark, d, "part").select("p_partkey", F.col(sku).alias("sku"))
    return li.join(part, li.l_partkey == part.p_partkey).groupBy("sku", "date").agg(F.sum("l_quantity").alias("units_sold"))


DAILY_SQL = """SELECT {sku} AS sku, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS units_sold
FROM lineitem JOIN part ON l_partkey = p_partkey {where} GROUP BY 1, 2"""
block("daily_type", DAILY_SQL.format(sku="p_type", where=""))
block("daily_brand", DAILY_SQL.format(sku="p_brand", where=""))


def daily_type(spark, d):
    return daily(spark, d, "p_type")


def daily_brand(spark, d):
    return daily(spark, d, "p_brand")


def number() -> "F.Column":
    """A small number for each SKU from its name."""
    return F.coalesce(F.expr("try_cast(substring(sku, 7) AS int)"), F.length("sku"))


NUMBER_SQL = "coalesce(try_cast(substr(sku, 7) AS INTEGER), CAST(length(sku) AS INTEGER))"


def enrich(panel: DataFrame) -> DataFrame:
    """Add the other columns of a sales panel by fixed rules on the SKU name and the date."""
    cal = calendar_columns("date", S)
    doy = F.dayofyear("date")
    return panel.select(
        "date", "sku",
        F.concat(F.lit("C"), (number() % 7).cast("string")).alias("category"),
        (3 + number() % 5).cast("int").alias("shelf_life_days"),
        "units_sold",
        (11.0 + 8.0 * F.sin(2 * 3.141592653589793 * (doy - 110) / 365.25)).alias("temp_c"),
        *[cal[c].alias(c) for c in ("bank_holiday", "school_holiday", "weekend", "dow")],
        ((doy + F.length("sku")) % 12 == 0).cast("int").alias("promo"),
    )


# Month, first and last day.
SCHOOL = ((1, 1, 2), (2, 12, 18), (4, 1, 14), (5, 26, 31), (7, 1, 31), (8, 1, 31), (10, 26, 31), (12, 20, 31))
SCHOOL_SQL = f"CASE WHEN {' OR '.join(f'(month({{d}}) = {m} AND day({{d}}) BETWEEN {a} AND {b})' for m, a, b in SCHOOL)} THEN 1 ELSE 0 END"


def enrich_sql(source: str) -> str:
    return f"""SELECT date, sku, 'C' || ({NUMBER_SQL} % 7) AS category, 3 + {NUMBER_SQL} % 5 AS shelf_life_days, units_sold,
 11.0 + 8.0 * sin(2 * pi() * (dayofyear(date) - 110) / 365.25) AS temp_c,
 CASE WHEN date IN ({H_SQL}) THEN 1 ELSE 0 END AS bank_holiday, {SCHOOL_SQL.format(d='date')} AS school_holiday,
 CASE WHEN isodow(date) >= 5 THEN 1 ELSE 0 END AS weekend, CAST(isodow(date) - 1 AS INTEGER) AS dow,
 CASE WHEN (dayofyear(date) + length(sku)) % 12 = 0 THEN 1 ELSE 0 END AS promo FROM {source}"""


def dense(observed: DataFrame) -> DataFrame:
    return densify(observed, {"units_sold": 0.0}).drop("is_observed")


DENSE_SQL = """SELECT g.sku, g.date, coalesce(o.units_sold, 0.0) AS units_sold
FROM (SELECT sku, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM {src} GROUP BY sku) g
LEFT JOIN {src} o ON o.sku = g.sku AND o.date = g.date"""
for kind in ("type", "brand"):
    block(f"dense_{kind}", DENSE_SQL.format(src=f"daily_{kind}"), f"daily_{kind}")
    block(f"sales_{kind}", enrich_sql(f"dense_{kind}"), f"dense_{kind}")
block("gappy_type", enrich_sql("daily_type"), "daily_type")


@shared
def sales_type(spark, d):
    """Six smooth series, zero-filled."""
    return enrich(dense(daily_type(spark, d)))


@shared
def sales_brand(spark, d):
    """Twenty-five series, zero-filled; intermittent at small scale."""
    return enrich(dense(daily_brand(spark, d)))


@shared
def sales_mixed(spark, d):
    """Smooth and intermittent series side by side: every type and every brand is a product."""
    return enrich(dense(daily_brand(spark, d).unionByName(daily_type(spark, d))))


block("dense_mixed", "SELECT * FROM dense_brand UNION ALL SELECT * FROM dense_type", "dense_brand", "dense_type")


@shared
def econ_mixed(spark, d):
    return econ(spark, d).unionByName(econ(spark, d, "type"))


@shared
def gappy_type(spark, d):
    """Observed days only."""
    return enrich(daily_type(spark, d))


@shared
def feed(spark: SparkSession, d: str) -> DataFrame:
    """A raw feed at order-line grain: many copies per (SKU, day), bad and missing quantities as text."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    code = F.col("l_orderkey") + F.col("l_linenumber")
    qty = F.col("l_quantity").cast("bigint").cast("string")
    text = F.when(code % 41 == 0, F.lit(None)).when(code % 43 == 0, F.concat(F.lit("-"), qty)).when(code % 47 == 0, "n/a").otherwise(qty)
    rows = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("p_brand").alias("sku"), text.alias("units_sold"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"), (3 + F.length("p_brand") % 5).alias("shelf_life_days"),
        (F.col("l_linenumber") % 2).alias("promo"),
    )
    return rows


block("feed", """SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS sku,
 CASE WHEN (l_orderkey + l_linenumber) % 41 = 0 THEN NULL WHEN (l_orderkey + l_linenumber) % 43 = 0 THEN '-' || CAST(l_quantity AS BIGINT)
 WHEN (l_orderkey + l_linenumber) % 47 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS units_sold,
 l_orderkey * 10 + l_linenumber AS ingest_seq, CAST(3 + length(p_brand) % 5 AS INTEGER) AS shelf_life_days, l_linenumber % 2 AS promo
FROM lineitem JOIN part ON l_partkey = p_partkey""")
block("feed_valid", """SELECT date, sku, try_cast(units_sold AS DOUBLE) AS units_sold, ingest_seq, shelf_life_days, promo
FROM feed WHERE try_cast(units_sold AS DOUBLE) >= 0""", "feed")
block("feed_first", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sku, date
 ORDER BY ingest_seq, units_sold, shelf_life_days, promo) AS rn FROM feed_valid) WHERE rn = 1""", "feed_valid")


@shared
def terms(spark: SparkSession, d: str, sku: str = "p_brand") -> DataFrame:
    """Commercial overrides per SKU from the parts table; some SKUs are left to the defaults."""
    rows = table(spark, d, "part").groupBy(F.col(sku).alias("sku")).agg(F.round(F.avg("p_retailprice") / 1000, 2).alias("unit_cost"))
    rows = rows.withColumns({"n": number()})
    return rows.filter("n % 9 <> 0").select(
        "sku", "unit_cost", (1 + F.col("n") % 6 * 4).cast("int").alias("pack_size"), (F.col("n") % 4 * 10).cast("int").alias("min_order_quantity"),
    )


TERMS_SQL = """SELECT sku, unit_cost, CAST(1 + n % 6 * 4 AS INTEGER) AS pack_size, CAST(n % 4 * 10 AS INTEGER) AS min_order_quantity
FROM (SELECT sku, unit_cost, {n} AS n FROM (SELECT {sku} AS sku, round(avg(p_retailprice) / 1000, 2) AS unit_cost FROM part GROUP BY 1)) WHERE n % 9 <> 0"""
ECON_SQL = """SELECT sku, unit_cost, pack_size, min_order_quantity, shelf_life_days, unit_cost * 0.25 / 365 AS holding_cost_per_unit_per_day,
 unit_cost + 0.05 AS waste_cost_per_unit, unit_cost * 2 AS stockout_cost_per_unit FROM (
 SELECT f.sku, coalesce(t.unit_cost, 1.0) AS unit_cost, coalesce(t.pack_size, 1) AS pack_size,
 coalesce(t.min_order_quantity, 0) AS min_order_quantity, f.shelf_life_days
 FROM (SELECT sku, 3 + {n} % 5 AS shelf_life_days FROM (SELECT DISTINCT p_{k} AS sku FROM part)) f LEFT JOIN terms_{k} t ON t.sku = f.sku)"""
for kind in ("type", "brand"):
    block(f"terms_{kind}", TERMS_SQL.format(n=NUMBER_SQL, sku=f"p_{kind}"))
    block(f"econ_{kind}", ECON_SQL.format(k=kind, n=NUMBER_SQL), f"terms_{kind}")


@shared
def econ(spark, d, kind: str = "brand") -> DataFrame:
    skus = table(spark, d, "part").select(F.col(f"p_{kind}").alias("sku")).distinct()
    skus = skus.withColumn("shelf_life_days", (3 + number() % 5).cast("int"))
    return economics(skus, terms(spark, d, f"p_{kind}"), S)


def moves(spark, d) -> DataFrame:
    """Movement log per type: accepted and returned lines (flags A and R) come into stock, all others are demand."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    into = F.col("l_returnflag").isin("A", "R")
    quantity = F.col("l_quantity")
    return rows.select(
        F.col("p_type").alias("sku"), F.col("l_shipdate").cast("date").alias("date"), F.when(into, quantity).alias("received"), F.when(~into, quantity).alias("demand"),
    )


block("log", """SELECT g.sku, g.date, coalesce(m.received, 0.0) AS received, coalesce(m.demand, 0.0) AS demand FROM
 (SELECT sku, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM log_raw GROUP BY sku) g
 LEFT JOIN log_raw m ON m.sku = g.sku AND m.date = g.date""", "log_raw")
block("log_raw", """SELECT p_type AS sku, CAST(l_shipdate AS DATE) AS date, coalesce(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity END), 0.0) AS received,
 coalesce(sum(CASE WHEN l_returnflag NOT IN ('A', 'R') THEN l_quantity END), 0.0) AS demand
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
