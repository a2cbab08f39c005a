"""Rolling-origin evaluation of forecast models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.accuracy import bias, coverage, mase, non_zero, smape, wape
from larder.operators.features import origin_array
from larder.operators.models import BOOSTED, EVERY, Model, at_decisions, forecast_all, series_state, training_matrix
from larder.operators.quality import DataQualityError
from larder.operators.slices import rolling_origins
from larder.plans.anchored import dates_of, fit_at, forecast_at, global_future
from larder.settings import Settings
from larder.sources.folder import written

METRICS = ("sMAPE", "MASE", "WAPE", "bias")


def with_actuals(forecast: DataFrame, sales: DataFrame, first: Column) -> DataFrame:
    """Forecast rows beside what was sold from ``first`` on; days without an observation drop out.

    Only forecast days matter, so the date filter reaches the scan before the join shuffles.
    """
    seen = sales.select("sku", F.col("date").alias("forecast_date"), F.col("units_sold").cast("double").alias("actual"))
    return forecast.join(seen.filter(F.col("forecast_date") >= first), ["sku", "forecast_date"])


def score(scored: DataFrame, horizon: int) -> DataFrame:
    """Accuracy per (fold, SKU, model); windows that are not complete are left out."""
    per = scored.groupBy("fold", "as_of", "sku", "model").agg(
        smape("actual", "predicted_demand").alias("sMAPE"),
        mase("actual", "predicted_demand", "mase_scale").alias("MASE"),
        wape("actual", "predicted_demand").alias("WAPE"),
        bias("actual", "predicted_demand").alias("bias"),
        coverage("actual", "lower_bound", "upper_bound").alias("interval_coverage"),
        F.sum("actual").alias("actual_total"),
        F.sum("predicted_demand").alias("forecast_total"),
        F.count(F.lit(1)).alias("days"),
    )
    return per.filter(F.col("days") == horizon).drop("days")


def first_origin(origins: DataFrame) -> Column:
    return origins.agg(F.min("origin")).scalar()


def numbered(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Attach the fold number; the origins table has one row per fold."""
    return rows.join(F.broadcast(origins.select("fold", F.col("origin").alias("as_of"))), "as_of")


def backtest_predictions(
    sales: DataFrame, s: Settings = Settings(), models: dict[str, Model | None] | None = None, folds: int | None = None,
    horizon: int | None = None, skus: DataFrame | None = None,
) -> DataFrame:
    """Predictions with actuals for every fold, SKU and model (all six by default).

    The univariate models are one lazy plan.  ``Gradient Boosting`` among ``models`` is fitted on all SKUs, once per fold.
    """
    folds, horizon = folds or s.folds, horizon or s.horizon_days
    chosen = EVERY if models is None else models
    if BOOSTED in chosen:
        sales = written(sales)  # its fits are many jobs
    origins = rolling_origins(sales, folds, horizon)
    panel = sales if skus is None else sales.join(skus.select("sku"), "sku", "left_semi")
    alone = {name: fn for name, fn in chosen.items() if name != BOOSTED}
    parts = []
    if alone:
        forecast = forecast_all(panel, origin_array(origins), horizon, s, alone)
        parts.append(numbered(with_actuals(forecast, panel, first_origin(origins)), origins))
    if BOOSTED in chosen:
        rows = boosted_backtest(sales, s, folds, horizon)
        parts.append(rows if skus is None else rows.join(skus.select("sku"), "sku", "left_semi"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def run_backtest(sales: DataFrame, s: Settings = Settings(), **kw) -> DataFrame:
    """Metrics per (fold, SKU, model); arguments as for the predictions."""
    return score(backtest_predictions(sales, s, **kw), kw.get("horizon") or s.horizon_days)


def boosted_backtest(sales: DataFrame, s: Settings = Settings(), folds: int | None = None, horizon: int | None = None,
                     estimate_sigma: bool = True) -> DataFrame:
    """Predictions of the global model, fitted at every fold's origin from one training matrix."""
    folds, horizon = folds or s.folds, horizon or s.horizon_days
    origins = rolling_origins(sales, folds, horizon)
    anchored = origins.select(F.col("origin").alias("as_of"), F.col("origin").alias("anchor"))
    served = dates_of(anchored)
    fits = fit_at(training_matrix(sales, s), served, s, estimate_sigma)
    scale = at_decisions(series_state(sales, origin_array(origins), s))
    forecast = forecast_at(fits, served, global_future(sales, anchored, horizon, s), s, scale)
    return numbered(with_actuals(forecast, sales, first_origin(origins)), origins)


def summary(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Mean metrics per model or SKU, rounded, best sMAPE first."""
    means = [F.bround(F.avg(c), 2).alias(c) for c in (*METRICS, "interval_coverage") if c in metrics.columns]
    return metrics.groupBy(by).agg(*means).orderBy("sMAPE", by)


def summarise_metrics(records: DataFrame, by: str = "model") -> DataFrame:
    present = [c for c in METRICS if c in records.columns]
    if not present:
        raise DataQualityError(f"no metric columns in {sorted(records.columns)}")
    return records.groupBy(by).agg(*[F.bround(F.avg(c), 2).alias(c) for c in present])


def improvement_vs_benchmark(table: DataFrame, benchmark: str = "Seasonal Naive", metric: str = "sMAPE") -> DataFrame:
    """Percent change against one row; a missing benchmark fails at run time.

    ``table`` has one row per model, which is all the unpartitioned window sees.
    """
    everything = Window.partitionBy(F.lit(1))
    base = F.max(F.when(F.col("model") == benchmark, F.col(metric))).over(everything)
    missing = F.raise_error(F.lit(f"benchmark {benchmark!r} is not in the table")).cast("double")
    base = F.when(base.isNull(), missing).otherwise(base)
    return table.withColumn("vs_benchmark", F.bround((F.col(metric) - base) / base * 100.0, 1))


def legacy_table(metrics: DataFrame, models=("Naive", "Seasonal Naive", "ETS (Holt-Winters)", BOOSTED)) -> DataFrame:
    """Mean sMAPE, MASE, WAPE of the four headline models and the change against seasonal naive."""
    table = metrics.filter(F.col("model").isin(*models)).groupBy("model").agg(
        *[F.bround(F.avg(c), 2).alias(c) for c in ("sMAPE", "MASE", "WAPE")]
    )
    return improvement_vs_benchmark(table)


def daily_accuracy(scored: DataFrame) -> DataFrame:
    """Totals per date: signed, absolute and percentage error, and the per-SKU absolute error."""
    day = scored.groupBy(F.col("forecast_date").alias("date")).agg(
        F.sum("actual").alias("actual_units"), F.sum("predicted_demand").alias("predicted_units"),
        F.sum(F.abs(F.col("predicted_demand") - F.col("actual"))).alias("sku_abs_error_units"),
    )
    error = F.col("predicted_units") - F.col("actual_units")
    return day.withColumns(
        {
            "error_units": error, "abs_error_units": F.abs(error),
            "error_pct": F.when(F.col("actual_units") > 0, error / F.col("actual_units") * 100.0),
        }
    )


def accuracy_headline(daily: DataFrame) -> DataFrame:
    """One row: net and per-SKU error of a daily accuracy table, and its worst date."""
    total = non_zero(F.sum("actual_units"))
    worst = F.max_by(F.struct("date", "error_units"), F.struct("abs_error_units", -F.unix_date("date")))
    row = daily.agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("start"), F.max("date").alias("end"),
        (100.0 * F.sum("abs_error_units") / total).alias("net_wape"), F.avg("abs_error_units").alias("net_mae_units"),
        F.avg("error_units").alias("bias_units"), (100.0 * F.sum("sku_abs_error_units") / total).alias("sku_wape"),
        F.avg("sku_abs_error_units").alias("sku_mae_units"), F.sum("actual_units").alias("total_actual"),
        F.sum("predicted_units").alias("total_predicted"), worst.alias("worst"),
    )
    return row.select("*", F.col("worst.date").alias("worst_date"), F.col("worst.error_units").alias("worst_error_units")).drop("worst")


def largest_error_day(predictions: DataFrame, by=("sku", "model", "fold")) -> DataFrame:
    """The day with the largest absolute error of each forecast."""
    miss = F.col("actual") - F.col("predicted_demand")
    worst = F.max_by(F.struct("forecast_date", "actual", "predicted_demand"), F.struct(F.abs(miss), -F.unix_date("forecast_date")))
    return predictions.groupBy(*by).agg(worst.alias("w")).select(*by, "w.*", (F.col("w.actual") - F.col("w.predicted_demand")).alias("error"))


def weekday_means(sales: DataFrame) -> DataFrame:
    """Mean site units per weekday: total over distinct dates.  Two-step, so dates are counted once."""
    daily = sales.groupBy("date").agg(F.sum("units_sold").alias("units"))
    return daily.groupBy(F.weekday("date").alias("dow")).agg((F.sum("units") / F.count(F.lit(1))).alias("mean_units"))


def holiday_uplift(sales: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Mean daily total on open bank holidays against other days, in percent."""
    from larder.functions.calendar import on_dates

    daily = sales.groupBy("date").agg(F.sum("units_sold").alias("units"))
    holiday, closed = on_dates("date", s.bank_holidays), on_dates("date", s.closed_days)
    row = daily.agg(
        F.avg(F.when((holiday == 1) & (closed == 0), F.col("units"))).alias("holiday_mean"),
        F.avg(F.when(holiday == 0, F.col("units"))).alias("normal_mean"),
    )
    return row.withColumn("uplift_pct", 100.0 * (F.col("holiday_mean") - F.col("normal_mean")) / F.col("normal_mean"))
