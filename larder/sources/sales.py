"""The sales panel and its SKU dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.accuracy import non_zero, zero_share
from larder.functions.calendar import calendar_columns
from larder.operators.quality import require_columns
from larder.settings import Settings

SALES_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("sku", T.StringType()), T.StructField("category", T.StringType())]
    + [T.StructField("shelf_life_days", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("units_sold", "temp_c")]
    + [T.StructField(c, T.IntegerType()) for c in ("bank_holiday", "school_holiday", "weekend", "dow", "promo")]
)
SALES_COLUMNS = tuple(SALES_SCHEMA.fieldNames())
ECONOMICS_COLUMNS = (
    "unit_cost", "pack_size", "min_order_quantity", "shelf_life_days",
    "holding_cost_per_unit_per_day", "waste_cost_per_unit", "stockout_cost_per_unit",
)


def load_sales(
    spark: SparkSession, path: str, fmt: str = "csv", *, validate: bool = True, repair: bool = False,
    s: Settings = Settings(),
) -> DataFrame:
    """Read a sales panel and give its columns their types; a value that does not fit its type is null.

    A CSV needs a header row; further columns, such as ``ingest_seq``, pass through.  The file is not sorted: windows sort what
    they need.  With ``repair`` the feed is mended first; with ``validate`` every data check is run as one job and a failing
    check raises.
    """
    try:
        df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no sales data could be read at {path}; generate or copy it there first") from error
    df = df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in SALES_SCHEMA if f.name in df.columns})
    if repair:
        from larder.operators.repair import repair_sales

        df = repair_sales(df, s=s)
    if validate:
        from larder.operators.quality import require_valid

        require_valid(df)
    return df


def economics(skus: DataFrame, overrides: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Commercial terms per SKU: the override where one is set, else the default.

    ``skus`` has ``sku`` and ``shelf_life_days``; ``overrides`` any of ``unit_cost``, ``pack_size``,
    ``min_order_quantity`` and ``shelf_life_days``.  Both grow with the number of SKUs, so the join
    strategy is left to the planner.
    """
    names = ("unit_cost", "pack_size", "min_order_quantity", "shelf_life_days")
    given = overrides.select("sku", *[F.col(c).alias(f"set_{c}") for c in names if c in overrides.columns])
    for c in names:
        if f"set_{c}" not in given.columns:
            given = given.withColumn(f"set_{c}", F.lit(None))
    # A pack size or shelf life of zero means "not set".
    resolved = {
        "unit_cost": F.coalesce("set_unit_cost", F.lit(s.default_unit_cost)).cast("double"),
        "pack_size": F.coalesce(non_zero(F.col("set_pack_size")), F.lit(s.default_pack)).cast("int"),
        "min_order_quantity": F.coalesce("set_min_order_quantity", F.lit(s.default_min_order)).cast("int"),
        "shelf_life_days": F.coalesce(non_zero(F.col("set_shelf_life_days")), "shelf_life_days").cast("int"),
    }
    cost = F.col("unit_cost")
    derived = {
        "holding_cost_per_unit_per_day": cost * s.holding_rate / 365.0 if s.holding_per_day is None
        else F.lit(float(s.holding_per_day)),
        "waste_cost_per_unit": cost * s.waste_multiplier + s.disposal_cost,
        "stockout_cost_per_unit": cost * s.stockout_multiplier if s.stockout_per_unit is None
        else F.lit(float(s.stockout_per_unit)),
    }
    joined = skus.join(given, "sku", "left").withColumns(resolved)
    return joined.withColumns(derived).drop(*[f"set_{c}" for c in names])


def sku_master(sales: DataFrame, overrides: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per SKU: first category and shelf life, mean demand, zero share, commercial terms."""
    facts = sales.groupBy("sku").agg(
        F.min_by("category", "date").alias("category"),
        F.min_by("shelf_life_days", "date").alias("shelf_life_days"),
        F.avg("units_sold").alias("mean_daily_units"),
        zero_share("units_sold").alias("zero_day_share"),
    )
    return economics(facts, overrides, s)


def sku_list(sales: DataFrame) -> DataFrame:
    """Distinct SKUs in order."""
    require_columns(sales, ["sku"])
    return sales.select("sku").distinct().orderBy("sku")


def uniform(seed: int, *keys) -> "F.Column":
    """A number in (0, 1) that depends on the keys only, whatever the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def gaussian(seed: int, *keys) -> "F.Column":
    """A standard normal draw from two keyed uniforms."""
    u, v = uniform(seed, F.lit("u"), *keys), uniform(seed, F.lit("v"), *keys)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * F.lit(3.141592653589793) * v)


def synthetic_sales(catalogue: DataFrame, first: dt.date, last: dt.date, s: Settings = Settings()) -> DataFrame:
    """A made-up panel with trend, season, weekday, weather, holiday and promotion effects.

    ``catalogue``: sku, category, base, weekend_factor, temp_effect, holiday_effect,
    zero_inflation, shelf_life_days.  Every draw is keyed by (seed, sku, date), so the panel does
    not depend on how it is partitioned.  Counts are Poisson draws: inverse distribution function
    for a small mean, rounded normal approximation for a large one.
    """
    span = (last - first).days + 1
    grid = catalogue.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    grid = grid.withColumnRenamed("weekend_factor", "weekend_lift").withColumns(calendar_columns("date", s))
    doy = F.dayofyear("date")
    wave = lambda shift: F.sin(2 * 3.141592653589793 * (doy - shift) / 365.25)
    season = 11.0 + 8.0 * wave(110)
    lift = 1 + 0.12 * F.datediff("date", F.lit(first)) / F.lit(max(span - 1, 1))
    weekday = F.when(F.col("weekend") == 1, F.col("weekend_lift")).when(F.col("dow").isin(0, 1), 0.9).otherwise(1.0)
    frame = grid.withColumns(
        {
            "temp_c": F.round(season + 2.2 * gaussian(s.seed, F.lit("temp"), "date"), 1),
            "promo": (uniform(s.seed, F.lit("promo"), "sku", "date") < 0.08).cast("int"),
        }
    )
    mean = (
        F.col("base") * lift * (1 + 0.12 * wave(40)) * weekday
        * (1 + F.col("temp_effect") * (F.col("temp_c") - 11.0) / 10.0)
        * (1 + F.col("holiday_effect") * F.col("bank_holiday"))
        * (1 + 0.35 * F.col("promo")) * (1 - F.col("is_closed"))
    )
    frame = frame.withColumn("mean", F.greatest(mean, F.lit(0.01)))
    u = uniform(s.seed, F.lit("count"), "sku", "date")
    # Small means: count the distribution steps below the uniform draw.
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.lit(0).alias("n")),
        lambda a, k: F.struct(
            (a["p"] * F.col("mean") / k).alias("p"),
            (a["c"] + a["p"] * F.col("mean") / k).alias("c"),
            (a["n"] + (u > a["c"]).cast("int")).alias("n"),
        ),
        lambda a: a["n"].cast("double"),
    )
    large = F.greatest(F.rint(F.col("mean") + F.sqrt("mean") * gaussian(s.seed, F.lit("count"), "sku", "date")), F.lit(0.0))
    drawn = F.when(F.col("mean") < 30, steps).otherwise(large)
    inflated = (uniform(s.seed, F.lit("zero"), "sku", "date") < F.col("zero_inflation")) & (F.col("bank_holiday") == 0)
    return frame.withColumn("units_sold", F.when(inflated, F.lit(0.0)).otherwise(drawn)).select(*SALES_COLUMNS)
