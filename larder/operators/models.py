"""Forecast models for many series and many decision dates at once.

Every model returns rows ``as_of, sku, step, forecast_date, predicted_demand, lower_bound,
upper_bound, sigma, model, mase_scale``.  The univariate models share one shuffle by SKU: running
aggregates give each series' state at every decision date, and recursive models fold once over the
series' day-ordered array (at most one entry per calendar day).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.features import by_day, with_cuts
from larder.operators.slices import horizon_rows
from larder.settings import Settings

FORECAST_COLUMNS = (
    "as_of", "sku", "step", "forecast_date", "predicted_demand", "lower_bound", "upper_bound", "sigma", "model",
    "mase_scale",
)
NAIVE, SEASONAL, HOLT_WINTERS = "Naive", "Seasonal Naive", "ETS (Holt-Winters)"
CROSTON, CROSTON_SBA, BOOSTED = "Croston", "Croston (SBA)", "Gradient Boosting"


def interval_z(s: Settings) -> float:
    """Half-width multiplier.  One-sided by default, as published; ``two_sided_interval`` widens it."""
    level = 0.5 + s.interval_level / 2 if s.two_sided_interval else s.interval_level
    return NormalDist().inv_cdf(level)


def with_interval(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Clip the point forecast at zero and add bounds that widen with the square root of the step."""
    point = F.greatest("predicted_demand", F.lit(0.0))
    width = interval_z(s) * F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    return rows.withColumns({"predicted_demand": point}).withColumns(
        {
            "lower_bound": F.greatest(F.col("predicted_demand") - width, F.lit(0.0)),
            "upper_bound": F.col("predicted_demand") + width,
        }
    )


def finish(rows: DataFrame, model: str, s: Settings) -> DataFrame:
    named = rows.withColumn("model", F.lit(model))
    return with_interval(named, s).select(*FORECAST_COLUMNS)


def series_state(sales: DataFrame, origins: Column, s: Settings = Settings()) -> DataFrame:
    """Every day of every series with running statistics of all days up to it, and its cuts."""
    m = s.seasonal_period
    upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
    frame = with_cuts(sales.select("sku", "date", F.col("units_sold").cast("double").alias("units_sold")), origins)
    frame = frame.withColumns(
        {
            "step_diff": F.col("units_sold") - F.lag("units_sold", 1).over(by_day()),
            "season_diff": F.col("units_sold") - F.lag("units_sold", m).over(by_day()),
        }
    )
    spread = lambda c: F.coalesce(F.stddev_samp(c).over(upto), F.lit(0.0))
    return frame.withColumns(
        {
            "n": F.count("units_sold").over(upto),
            "sd_step": spread("step_diff"),
            "sd_season": spread("season_diff"),
            "sd_units": spread("units_sold"),
            "mase_scale": F.avg(F.abs("season_diff")).over(upto),
            "cycle": F.collect_list("units_sold").over(by_day().rowsBetween(1 - m, 0)),
        }
    ).drop("step_diff", "season_diff")


def at_decisions(state: DataFrame) -> DataFrame:
    """One row per (as_of, SKU): the state of the series when the decision is made."""
    rows = state.filter(F.size("cuts") > 0).withColumn("as_of", F.explode("cuts")).drop("cuts")
    return rows.withColumnRenamed("date", "last_date").withColumnRenamed("units_sold", "last_units")


def naive(state: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    """The last value, for every day ahead."""
    rows = horizon_rows(at_decisions(state), horizon)
    return finish(rows.withColumns({"predicted_demand": F.col("last_units"), "sigma": F.col("sd_step")}), NAIVE, s)


def seasonal_naive(state: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    """The value at the same position of the last full cycle; series shorter than a cycle are left out."""
    m = s.seasonal_period
    rows = horizon_rows(at_decisions(state).filter(F.col("n") >= m), horizon)
    place = F.pmod(F.datediff("forecast_date", "last_date") - 1, F.lit(m)).cast("int") + 1
    value = {"predicted_demand": F.element_at("cycle", place), "sigma": F.col("sd_season")}
    return finish(rows.withColumns(value), SEASONAL, s)


def series_arrays(state: DataFrame, carry=("sd_units", "mase_scale")) -> DataFrame:
    """One row per SKU: its days in order as an array.  Reuses the SKU partitioning of ``state``."""
    entry = F.struct("date", "units_sold", "n", "cuts", *carry)
    return state.groupBy("sku").agg(F.array_sort(F.collect_list(entry)).alias("days"))


# -- Croston --------------------------------------------------------------------------------------


def croston_parameters(state: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Smoothed demand size and interval of each series at each decision date.

    One fold over the days: a non-zero day moves size and interval by ``alpha``; the first one sets
    them.  A series without demand has size 0 and an interval of its length.
    """
    a = s.croston_alpha
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("size"), zero.alias("gap"), zero.alias("since"), F.lit(0).alias("events"),
        F.array().cast(
            "array<struct<as_of:date,size:double,gap:double,events:int,n:bigint,sd_units:double,mase_scale:double>>"
        ).alias("out"),
    )

    def step(acc, day):
        u, since = day["units_sold"], acc["since"] + 1.0
        sold, first = u > 0, acc["events"] == 0
        moved = lambda old, new: F.when(~sold, old).when(first, new).otherwise(old + (new - old) * a)
        size, gap = moved(acc["size"], u), moved(acc["gap"], since)
        events = acc["events"] + sold.cast("int")
        emit = F.transform(
            day["cuts"],
            lambda o: F.struct(
                o.alias("as_of"), size.alias("size"), gap.alias("gap"), events.alias("events"), day["n"].alias("n"),
                day["sd_units"].alias("sd_units"), day["mase_scale"].alias("mase_scale"),
            ),
        )
        return F.struct(
            size.alias("size"), gap.alias("gap"), F.when(sold, zero).otherwise(since).alias("since"),
            events.alias("events"), F.when(F.size(day["cuts"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], emit)).alias("out"),
        )

    folded = series_arrays(state).select("sku", F.aggregate("days", start, step, lambda acc: acc["out"]).alias("out"))
    rows = folded.select("sku", F.inline("out"))
    active = F.col("events") > 0
    interval = F.when(active, F.greatest("gap", F.lit(1.0))).otherwise(F.col("n").cast("double"))
    rows = rows.withColumns({"smoothed_size": F.col("size"), "smoothed_interval": interval, "active": active})
    return rows.withColumns(
        {
            "rate": F.when(F.col("active"), F.col("smoothed_size") / F.col("smoothed_interval")).otherwise(0.0),
            # The rate is one constant, so errors around it spread exactly as the demand does.
            "sigma": F.when(F.col("active"), F.col("sd_units")).otherwise(0.0),
        }
    ).drop("size", "gap", "sd_units", "active")


def croston(state: DataFrame, horizon: int, s: Settings = Settings(), variant: str = "sba") -> DataFrame:
    """A flat demand rate for intermittent series; ``sba`` removes the known upward bias."""
    if variant not in ("classic", "sba"):
        raise ValueError(f"variant must be classic or sba, got {variant!r}")
    factor = 1.0 - s.croston_alpha / 2.0 if variant == "sba" else 1.0
    rows = croston_parameters(state, s).withColumn("predicted_demand", F.col("rate") * factor)
    return finish(horizon_rows(rows, horizon), CROSTON_SBA if variant == "sba" else CROSTON, s)


# -- Holt-Winters ---------------------------------------------------------------------------------


def holt_winters_grid(s: Settings) -> list[tuple[float, float, float]]:
    return list(product(s.hw_alpha, s.hw_beta, s.hw_gamma))


def holt_winters_states(state: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Level, trend and seasonal values of each series at each decision date, best grid point each.

    Additive trend and season.  The first cycle sets the level and season, the step between the first two cycles sets the trend.  One
    fold over one copy of the series carries a record per smoothing triple with its squared one-step error; at a decision date
    the triple with the least error so far wins.
    """
    m = s.seasonal_period
    plus = lambda acc, x: acc + x
    arrays = series_arrays(state, carry=("mase_scale",)).filter(F.size("days") >= 2 * m)
    units = F.transform(F.slice("days", 1, 2 * m), lambda d: d["units_sold"])
    arrays = arrays.withColumn("opening", units).withColumns(
        {
            "level0": F.aggregate(F.slice("opening", 1, m), F.lit(0.0), plus) / m,
            "level1": F.aggregate(F.slice("opening", m + 1, m), F.lit(0.0), plus) / m,
            "rest": F.slice("days", F.lit(m + 1), F.size("days") - m),
        }
    )
    # The error comes first: the least record is the best fit, the smaller parameters among equals.
    fields = ("sse", "alpha", "beta", "gamma", "level", "trend", "season", "total")
    kind = "struct<sse:double,alpha:double,beta:double,gamma:double,level:double,trend:double,season:array<double>,total:double>"
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for a, b, g in holt_winters_grid(s)])
    season0 = F.transform(F.slice("opening", 1, m), lambda u: u - F.col("level0"))
    opened = F.transform(
        grid,
        lambda g: F.struct(
            F.lit(0.0).alias("sse"), g["alpha"].alias("alpha"), g["beta"].alias("beta"), g["gamma"].alias("gamma"), F.col("level0").alias("level"),
            ((F.col("level1") - F.col("level0")) / m).alias("trend"), season0.alias("season"), F.lit(0.0).alias("total"),
        ),
    )
    start = F.struct(opened.cast(f"array<{kind}>").alias("fits"), F.array().cast(f"array<struct<as_of:date,mase_scale:double,k:bigint,fit:{kind}>>").alias("out"))

    def moved(fit: Column, y: Column) -> Column:
        # Error-correction form of the three smoothing equations.
        now = F.element_at(fit["season"], 1)
        ahead = fit["level"] + fit["trend"]
        error = y - ahead - now
        season = F.concat(F.slice(fit["season"], 2, m - 1), F.array(now + fit["gamma"] * error * (1.0 - fit["alpha"])))
        new = (
            fit["sse"] + error * error, fit["alpha"], fit["beta"], fit["gamma"], ahead + fit["alpha"] * error,
            fit["trend"] + fit["alpha"] * fit["beta"] * error, season, fit["total"] + error,
        )
        return F.struct(*[value.alias(name) for name, value in zip(fields, new, strict=True)])

    def step(acc: Column, day: Column) -> Column:
        fits = F.transform(acc["fits"], lambda fit: moved(fit, day["units_sold"]))
        decided = (F.size(day["cuts"]) > 0) & (day["n"] >= 2 * m)
        best = F.array_min(fits)
        emit = F.transform(day["cuts"], lambda o: F.struct(o.alias("as_of"), day["mase_scale"].alias("mase_scale"), (day["n"] - m).alias("k"), best.alias("fit")))
        return F.struct(fits.alias("fits"), F.when(decided, F.concat(acc["out"], emit)).otherwise(acc["out"]).alias("out"))

    fits = arrays.select("sku", F.inline(F.aggregate("rest", start, step, lambda acc: acc["out"])))
    k, total = F.col("k"), F.col("fit.total")
    variance = (F.col("fit.sse") - total * total / k) / (k - 1)
    return fits.withColumn("sigma", F.when(k >= 2, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0))


def holt_winters(state: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    m = s.seasonal_period
    rows = horizon_rows(holt_winters_states(state, s), horizon)
    season = F.element_at("fit.season", F.pmod(F.col("step") - 1, F.lit(m)).cast("int") + 1)
    value = F.col("fit.level") + F.col("step") * F.col("fit.trend") + season
    return finish(rows.withColumn("predicted_demand", value), HOLT_WINTERS, s)


# -- registry -------------------------------------------------------------------------------------

def naive_pair(state: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    """Naive and seasonal naive from one pass over the decision rows."""
    m = s.seasonal_period
    rows = horizon_rows(at_decisions(state), horizon)
    place = F.pmod(F.datediff("forecast_date", "last_date") - 1, F.lit(m)).cast("int") + 1
    options = F.array(
        F.struct(F.lit(NAIVE).alias("model"), F.col("last_units").alias("predicted_demand"), F.col("sd_step").alias("sigma")),
        F.struct(F.lit(SEASONAL).alias("model"), F.try_element_at("cycle", place).alias("predicted_demand"), F.col("sd_season").alias("sigma")),
    )
    rows = rows.select("as_of", "sku", "step", "forecast_date", "mase_scale", "n", F.inline(options))
    rows = rows.filter((F.col("model") == NAIVE) | (F.col("n") >= m))
    return with_interval(rows, s).select(*FORECAST_COLUMNS)


def croston_pair(state: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    """Both Croston variants from one fold."""
    options = F.array(
        F.struct(F.lit(CROSTON).alias("model"), F.col("rate").alias("predicted_demand")),
        F.struct(F.lit(CROSTON_SBA).alias("model"), (F.col("rate") * (1.0 - s.croston_alpha / 2.0)).alias("predicted_demand")),
    )
    rows = croston_parameters(state, s).select("*", F.inline(options))
    return with_interval(horizon_rows(rows, horizon), s).select(*FORECAST_COLUMNS)


#: A model takes (state, horizon, settings) and returns forecast rows.  Add your own entry to use it.
Model = Callable[[DataFrame, int, Settings], DataFrame]
UNIVARIATE: dict[str, Model] = {
    NAIVE: naive,
    SEASONAL: seasonal_naive,
    HOLT_WINTERS: holt_winters,
    CROSTON: lambda state, horizon, s: croston(state, horizon, s, "classic"),
    CROSTON_SBA: croston,
}


#: Every model of a backtest.  The global one is no function of one series' state; plans fit it at their decision dates.
EVERY: dict[str, Model | None] = {**UNIVARIATE, BOOSTED: None}


def shared_passes(models: dict[str, Model]) -> list[Model]:
    """The built-in pairs run together when both are asked for; every other model on its own."""
    left = dict(models)
    passes = []
    for first, second, both in ((NAIVE, SEASONAL, naive_pair), (CROSTON, CROSTON_SBA, croston_pair)):
        if left.get(first) is UNIVARIATE[first] and left.get(second) is UNIVARIATE[second]:
            del left[first], left[second]
            passes.append(both)
    return passes + list(left.values())


def forecast_all(
    sales: DataFrame, origins: Column, horizon: int, s: Settings = Settings(), models: dict[str, Model] | None = None,
) -> DataFrame:
    """Every model on every series at every decision date."""
    state = series_state(sales, origins, s)
    parts = [fn(state, horizon, s) for fn in shared_passes(UNIVARIATE if models is None else models)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contract_violations(forecast: DataFrame, horizon: int) -> DataFrame:
    """Forecasts that break the contract: wrong number of days, gaps, negative or crossed values."""
    per = forecast.groupBy("as_of", "sku", "model").agg(
        F.count(F.lit(1)).alias("days"),
        (F.datediff(F.max("forecast_date"), F.min("forecast_date")) + 1).alias("span"),
        F.count_if((F.col("predicted_demand") < 0) | F.col("predicted_demand").isNull()).alias("bad_values"),
        F.count_if(
            (F.col("lower_bound") > F.col("predicted_demand")) | (F.col("upper_bound") < F.col("predicted_demand"))
        ).alias("crossed"),
    )
    return per.filter((F.col("days") != horizon) | (F.col("span") != horizon) | (F.col("bad_values") + F.col("crossed") > 0))


def total_demand(forecast: DataFrame, days: int) -> DataFrame:
    """Expected demand over the first ``days`` days of each forecast."""
    part = F.sum(F.when(F.col("step") <= days, F.col("predicted_demand")).otherwise(0.0))
    return forecast.groupBy("as_of", "sku", "model").agg(part.alias("total_demand"))


# -- boosted trees --------------------------------------------------------------------------------


def boosted_stages(s: Settings):
    """Unfitted MLlib pipeline on the fixed feature order.

    One rule for any number of SKUs: the code is folded into ``gbt_sku_buckets`` categories.  It and the day of week are
    categorical, all other features are ordered numbers; the number of bins is fixed.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorIndexer
    from pyspark.ml.regression import GBTRegressor

    from larder.operators.features import feature_columns

    numbers = [c for c in feature_columns(s) if c not in ("sku_code", "dow")]
    fold = SQLTransformer(statement=f"SELECT *, CAST(pmod(CAST(sku_code AS BIGINT), {s.gbt_sku_buckets}) AS DOUBLE) AS sku_bucket FROM __THIS__")
    named = VectorAssembler(inputCols=["sku_bucket", "dow"], outputCol="named", handleInvalid="error")
    index = VectorIndexer(inputCol="named", outputCol="categories", maxCategories=s.gbt_sku_buckets, handleInvalid="keep")
    assemble = VectorAssembler(inputCols=["categories", *numbers], outputCol="features", handleInvalid="error")
    trees = GBTRegressor(
        featuresCol="features", labelCol="units_sold", predictionCol="raw_prediction", maxIter=s.gbt_rounds,
        stepSize=s.gbt_rate, maxDepth=s.gbt_depth, minInstancesPerNode=s.gbt_min_leaf, seed=s.seed, maxBins=2 * s.gbt_sku_buckets,
    )
    return Pipeline(stages=[fold, named, index, assemble, trees])


def training_matrix(sales: DataFrame, s: Settings = Settings(), codes: DataFrame | None = None) -> DataFrame:
    """The training rows of all dates, written once to the shared folder.

    Every feature of a row looks back only, so the rows before a date are the matrix as of that date: a fit at any date is a date
    filter on this table, which skips the files behind it (rows are laid out by date).
    """
    from larder.operators.features import engineer, feature_matrix
    from larder.operators.ordered import sku_codes
    from larder.sources.folder import written

    matrix = feature_matrix(engineer(sales, s, sku_codes(sales) if codes is None else codes), s)
    return written(matrix.repartitionByRange("date", "sku").sortWithinPartitions("date", "sku"))


def fit_rows(rows: DataFrame, s: Settings = Settings(), estimate_sigma: bool = True):
    """Fit one model on training rows and estimate each SKU's error on their last days; (fitted pipeline, ``sku, sigma`` table).

    The model and the one that the error is taken from are fitted side by side.
    """
    from larder.operators import boosting

    newest = rows.agg(F.max("date")).first()[0]
    if newest is None:
        raise ValueError("no training rows are left after dropping undefined lags; the history is too short")
    pipeline = boosted_stages(s)
    checked, asked = rows, [rows]
    if estimate_sigma and s.sigma_tail_days > 0:
        cutoff = F.date_sub(F.lit(newest), s.sigma_tail_days)
        head, tail = rows.filter(F.col("date") < cutoff), rows.filter(F.col("date") >= cutoff)
        if not head.isEmpty():
            checked, asked = tail, [rows, head]
    with ThreadPoolExecutor(len(asked)) as pool:
        fitted = list(pool.map(lambda x: boosting.fit(pipeline, x), asked))
    model, probe = fitted[0], fitted[-1]
    residual = F.col("units_sold") - F.greatest("raw_prediction", F.lit(0.0))
    sigma = probe.transform(checked).groupBy("sku").agg(F.coalesce(F.stddev_samp(residual), F.lit(0.0)).alias("sigma"))
    return model, sigma


def fit_boosted(sales: DataFrame, s: Settings = Settings(), codes: DataFrame | None = None, estimate_sigma: bool = True):
    """Fit one model over all SKUs and estimate each SKU's error on the held-out last days.

    Returns (fitted pipeline, ``sku, sigma`` table).  Runs Spark jobs: the training matrix, written to the shared folder so that
    a lost executor costs none of it, the cut-off date and the MLlib fits.
    """
    return fit_rows(training_matrix(sales, s, codes), s, estimate_sigma)


def boosted(model, sigma: DataFrame, future: DataFrame, s: Settings = Settings(), scale: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Forecast rows from a fitted pipeline and future features; ``carry`` names further columns of ``future`` to keep."""
    from larder.operators.features import feature_columns

    ready = future.withColumns({c: F.col(c).cast("double") for c in feature_columns(s)}).dropna(subset=feature_columns(s))
    rows = model.transform(ready).join(sigma, "sku", "left")
    rows = rows.withColumns(
        {"predicted_demand": F.greatest("raw_prediction", F.lit(0.0)), "sigma": F.coalesce("sigma", F.lit(0.0))}
    )
    if scale is None:
        rows = rows.withColumn("mase_scale", F.lit(None).cast("double"))
    else:
        rows = rows.join(scale.select("as_of", "sku", "mase_scale"), ["as_of", "sku"], "left")
    return with_interval(rows.withColumn("model", F.lit(BOOSTED)), s).select(*FORECAST_COLUMNS, *carry)
