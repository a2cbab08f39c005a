"""Leakage-free features for training rows and for future rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.calendar import as_col, calendar_columns
from larder.operators.ordered import sku_codes
from larder.operators.quality import require_columns, require_no_outcomes
from larder.operators.slices import horizon_rows
from larder.settings import Settings
from larder.sources.sales import gaussian

BASE_FEATURES = (
    "dow", "weekend", "bank_holiday", "school_holiday", "is_closed", "promo", "temp_c", "week_of_year", "month",
)
# Display names of the features.
FEATURE_LABELS = {
    "dow": "Day of week",
    "weekend": "Weekend (Fri-Sun)",
    "bank_holiday": "Bank holiday",
    "school_holiday": "School holiday",
    "is_closed": "Site closed",
    "promo": "Promotion running",
    "temp_c": "Temperature",
    "week_of_year": "Week of year",
    "month": "Month",
    "sku_code": "Product identity",
    "lag7": "Demand 7 days ago",
    "lag14": "Demand 14 days ago",
    "roll28": "28-day average demand",
}


def by_day() -> Window:
    """One SKU's days in order.  A panel has at most one row per (SKU, day), which bounds the partition."""
    return Window.partitionBy("sku").orderBy("date")


def feature_columns(s: Settings = Settings()) -> list[str]:
    return [*BASE_FEATURES, *[f"lag{k}" for k in s.lags], *[f"roll{n}" for n in s.rolls], "sku_code"]


def lag_expressions(s: Settings = Settings(), value: str = "units_sold") -> dict[str, Column]:
    return {f"lag{k}": F.lag(value, k).over(by_day()) for k in s.lags}


def rolling_mean(n: int, value: str = "units_sold", upto: int = -1) -> Column:
    """Mean of ``n`` rows ending ``upto`` rows from the current one; NULL unless all are there."""
    frame = by_day().rowsBetween(upto - n + 1, upto)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def engineer(sales: DataFrame, s: Settings = Settings(), codes: DataFrame | None = None) -> DataFrame:
    """Training rows: calendar refreshed, lags and rolling means inside each SKU, SKU code.

    Rows whose lags are not yet defined keep NULLs.  All windows share one shuffle by SKU.
    """
    require_columns(sales, ["date", "sku", "units_sold", "temp_c"])
    frame = sales if "promo" in sales.columns else sales.withColumn("promo", F.lit(0))
    frame = frame.withColumns(calendar_columns("date", s))
    frame = frame.withColumns({**lag_expressions(s), **{f"roll{n}": rolling_mean(n) for n in s.rolls}})
    return frame.join(sku_codes(sales) if codes is None else codes, "sku")


def feature_matrix(frame: DataFrame, s: Settings = Settings(), dropna: bool = True) -> DataFrame:
    """The features in their fixed order as doubles, with keys and (if present) demand."""
    columns = feature_columns(s)
    require_columns(frame, columns)
    kept = frame.dropna(subset=columns) if dropna else frame
    carry = [c for c in ("as_of", "sku", "date", "units_sold") if c in frame.columns]
    return kept.select(*carry, *[F.col(c).cast("double").alias(c) for c in columns])


def demand_volatility(sales: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per SKU: spread of seasonal differences over sqrt(2); plain spread for a short series."""
    m = s.seasonal_period
    diffs = sales.withColumn("diff", F.col("units_sold") - F.lag("units_sold", m).over(by_day()))
    plain = F.coalesce(F.stddev_samp("units_sold"), F.lit(0.0))
    seasonal = F.coalesce(F.stddev_samp("diff"), F.lit(0.0)) / F.sqrt(F.lit(2.0))
    return diffs.groupBy("sku").agg(F.when(F.count("units_sold") <= m, plain).otherwise(seasonal).alias("volatility"))


# -- weather ------------------------------------------------------------------------------------


def weather_series(sales: DataFrame) -> DataFrame:
    """One temperature per date: the first SKU's reading."""
    return sales.groupBy("date").agg(F.min_by("temp_c", "sku").alias("temp_c"))


def climatology(weather: DataFrame, before=None) -> DataFrame:
    """One row: mean temperature, of the dates before a decision date when one is given."""
    seen = weather if before is None else weather.filter(F.col("date") < as_col(before))
    return seen.agg(F.avg("temp_c").alias("temp_c"))


def noise_sd(as_of, day, s: Settings = Settings()) -> Column:
    """Spread of the temperature forecast error by lead time."""
    lead = F.datediff(as_col(day), as_col(as_of))
    if s.perfect_foresight:
        return F.lit(0.0)
    grown = s.weather_noise_sd + s.weather_noise_growth * F.greatest(lead - 1, F.lit(0))
    return F.when(lead <= 0, F.lit(0.0)).otherwise(grown)


def with_temperature(rows: DataFrame, weather: DataFrame, s: Settings = Settings(), day: str = "forecast_date") -> DataFrame:
    """``temp_c`` as known on ``as_of``: the reading plus lead-time noise, else the mean so far.

    The weather side has one row per calendar day.  The mean of the days before each decision comes
    from a running aggregate over that side.
    """
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = weather.select("date", "temp_c", F.avg("temp_c").over(so_far).alias("mean_before"))
    readings = F.broadcast(days.select(F.col("date").alias(day), F.col("temp_c").alias("reading")))
    means = F.broadcast(days.select(F.col("date").alias("as_of"), "mean_before"))
    known = rows.join(readings, day, "left").join(means, "as_of", "left")
    noise = F.lit(0.0) if s.perfect_foresight else gaussian(s.weather_seed, "as_of", day) * noise_sd("as_of", day, s)
    temp = F.coalesce("reading", "mean_before") + noise
    return known.withColumn("temp_c", temp).drop("reading", "mean_before")


# -- the state of every series at every decision date ---------------------------------------------


def with_cuts(sales: DataFrame, origins: Column) -> DataFrame:
    """``cuts``: the decision dates at which a row is the last one known.

    ``origins`` is an ascending array of dates.  This replaces a (decision x history) join: running
    aggregates evaluated at a row *are* the history as of each of its cuts.  Rows outside the range
    of the decisions skip the search.
    """
    frame = sales.withColumns({"_next": F.lead("date").over(by_day()), "_origins": origins})
    first, last = F.try_element_at("_origins", F.lit(1)), F.try_element_at("_origins", F.lit(-1))
    in_range = (F.col("date") < last) & (F.col("_next").isNull() | (F.col("_next") >= first))
    found = F.filter("_origins", lambda o: (o > F.col("date")) & (F.col("_next").isNull() | (o <= F.col("_next"))))
    none = F.array().cast("array<date>")
    return frame.withColumn("cuts", F.when(in_range, found).otherwise(none)).drop("_next", "_origins")


def origin_array(origins: DataFrame, column: str = "origin") -> Column:
    """A decision-date table as one array value (a scalar subquery); one entry per decision date."""
    return origins.agg(F.array_sort(F.collect_set(column)).alias("origins")).scalar()


def lag_state(sales: DataFrame, origins: Column, s: Settings = Settings()) -> DataFrame:
    """``as_of, sku, newest, roll.., by_weekday, recent``: what each series' lags are looked up in, per decision.

    A day says only to which decisions it is the newest day, the newest of its weekday or one of the last days; days that matter to
    none are dropped at once, and a decision gathers seven weekdays and the few days that lags reach.
    """
    frame = with_cuts(sales.select("sku", "date", "units_sold"), origins)
    day, furthest = F.weekday("date"), max(s.lags)
    again = Window.partitionBy("sku", F.weekday("date")).orderBy("date")
    frame = frame.withColumns({**{f"roll{n}": rolling_mean(n, upto=0) for n in s.rolls}, "_again": F.lead("date").over(again), "_origins": origins})
    first, last = F.try_element_at("_origins", F.lit(1)), F.try_element_at("_origins", F.lit(-1))
    served = (F.col("date") < last) & (F.col("_again").isNull() | (F.col("_again") >= first) | (F.date_add("date", furthest) >= first))
    after = lambda o: o > F.col("date")
    weekdays = F.filter("_origins", lambda o: after(o) & (F.col("_again").isNull() | (o <= F.col("_again"))))
    lately = F.filter("_origins", lambda o: after(o) & (o <= F.date_add("date", furthest)))
    named = lambda dates, kind: F.transform(dates, lambda o: F.struct(o.alias("as_of"), F.lit(kind).alias("kind")))
    uses = F.concat(named("cuts", "newest"), named(weekdays, "weekday"), named(lately, "day"))
    used = frame.filter(served).select("sku", "date", "units_sold", *[f"roll{n}" for n in s.rolls], F.inline(uses))
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    gathered = lambda kind, key: F.map_from_entries(F.collect_list(only(kind, F.struct(key.alias("k"), F.col("units_sold").alias("v")))))
    return used.groupBy("as_of", "sku").agg(
        F.max(only("newest", F.col("units_sold"))).alias("newest"), *[F.max(only("newest", F.col(f"roll{n}"))).alias(f"roll{n}") for n in s.rolls],
        gathered("weekday", day).alias("by_weekday"), gathered("day", F.col("date")).alias("recent"),
    )


def future_features(
    sales: DataFrame, origins: Column, horizon: int, s: Settings = Settings(), promos: DataFrame | None = None,
    weather: DataFrame | None = None, codes: DataFrame | None = None,
) -> DataFrame:
    """One row per (as_of, SKU, forecast day) with every model feature and no demand.

    Lags come from demand seen before ``as_of`` only: the day itself when it was observed, else the
    newest same weekday, else the newest value.  Rolling means are frozen at ``as_of``.
    """
    state = lag_state(sales, origins, s)
    rows = horizon_rows(state, horizon)
    for k in s.lags:
        wanted = F.date_sub("forecast_date", k)
        same_weekday = F.try_element_at("by_weekday", F.weekday(wanted))
        rows = rows.withColumn(f"lag{k}", F.coalesce(F.try_element_at("recent", wanted), same_weekday, "newest"))
    rows = rows.withColumns(calendar_columns("forecast_date", s)).drop("newest", "by_weekday", "recent")
    rows = with_temperature(rows, weather_series(sales) if weather is None else weather, s)
    plan = promos if promos is not None else (sales.select("sku", "date", "promo") if "promo" in sales.columns else None)
    if s.promotions_known and plan is not None:
        planned = plan.select("sku", F.col("date").alias("forecast_date"), F.col("promo").alias("planned"))
        rows = rows.join(planned, ["sku", "forecast_date"], "left")
        rows = rows.withColumn("promo", F.coalesce("planned", F.lit(0))).drop("planned")
    else:
        rows = rows.withColumn("promo", F.lit(0))
    rows = rows.join(sku_codes(sales) if codes is None else codes, "sku")
    return require_no_outcomes(rows.withColumn("date", F.col("forecast_date")))


def trailing_usage(sales: DataFrame, origins: Column, days: int) -> DataFrame:
    """``as_of, sku, usage``: mean demand over the last ``days`` days; of all history when that is empty."""
    upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
    plain = sales.select("sku", "date", "units_sold")
    opened = with_cuts(plain, F.transform(origins, lambda o: F.date_sub(o, days))).withColumnRenamed("cuts", "_opened")
    # Sums up to the last day before the decision, less those up to the last day before its window.
    frame = with_cuts(opened, origins).withColumns({"total": F.sum("units_sold").over(upto), "n": F.count("units_sold").over(upto)})
    uses = F.concat(
        F.transform("cuts", lambda o: F.struct(o.alias("as_of"), F.lit(False).alias("before"))),
        F.transform("_opened", lambda o: F.struct(F.date_add(o, days).alias("as_of"), F.lit(True).alias("before"))),
    )
    used = frame.filter((F.size("cuts") > 0) | (F.size("_opened") > 0)).select("sku", "total", "n", F.inline(uses))
    at = lambda name, before: F.max(F.when(F.col("before") == before, F.col(name)))
    per = used.groupBy("as_of", "sku").agg(
        at("total", False).alias("total"), at("n", False).alias("n"),
        F.coalesce(at("total", True), F.lit(0.0)).alias("total_before"), F.coalesce(at("n", True), F.lit(0)).alias("n_before"),
    )
    seen = F.col("n") - F.col("n_before")
    recent = F.when(seen > 0, (F.col("total") - F.col("total_before")) / seen)
    return per.filter(F.col("n").isNotNull()).select("as_of", "sku", F.coalesce(recent, F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("usage"))
