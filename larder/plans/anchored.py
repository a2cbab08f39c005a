"""Global models by refit date: which decision uses which fit, the fits themselves and their forecasts.

A decision is served by the model fitted at its anchor, which depends on the decision date alone.  All fits cut one written training
matrix by a date filter and run side by side from a bounded pool; the number of fits is that of distinct anchors, never of rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import refit_anchor
from larder.operators.features import future_features, origin_array, weather_series
from larder.operators.models import FORECAST_COLUMNS, boosted, fit_rows, training_matrix
from larder.settings import Settings
from larder.sources.folder import written

# Fits that run at the same time; each is a chain of short jobs that leaves most of a cluster idle.
SIDE_BY_SIDE = 4

Fits = dict[dt.date, tuple]  # anchor -> (fitted pipeline, sku and sigma)


def decision_anchors(origins: DataFrame, sales: DataFrame, s: Settings = Settings(), grid_start: dt.date | None = None) -> DataFrame:
    """``as_of, anchor``: the date whose model and routing serve each decision."""
    earliest = sales.agg(F.date_add(F.min("date"), s.min_history_days)).scalar()
    rows = origins.select(F.col("origin").alias("as_of"), earliest.alias("earliest"))
    return rows.select("as_of", refit_anchor("as_of", grid_start or s.start, F.col("earliest"), s).alias("anchor"))


def dates_of(anchored: DataFrame) -> dict[dt.date, list[dt.date]]:
    """Anchor -> its decision dates; one entry per decision date."""
    out: dict[dt.date, list[dt.date]] = {}
    for row in anchored.select("anchor", "as_of").distinct().orderBy("anchor", "as_of").collect():
        out.setdefault(row["anchor"], []).append(row["as_of"])
    return out


def fit_at(matrix: DataFrame, anchors: Iterable[dt.date], s: Settings = Settings(), estimate_sigma: bool = True) -> Fits:
    """One model per distinct anchor, fitted on the rows of ``matrix`` before it."""
    wanted = sorted(set(anchors))

    def fit(anchor: dt.date):
        return fit_rows(matrix.filter(F.col("date") < F.lit(anchor)), s, estimate_sigma)

    if not wanted:
        return {}
    with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(wanted))) as pool:
        return dict(zip(wanted, pool.map(fit, wanted), strict=True))


def global_future(sales: DataFrame, anchored: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    """Future features at every decision date of ``anchored``."""
    promos = sales.select("sku", "date", "promo") if "promo" in sales.columns else None
    return future_features(sales, origin_array(anchored, "as_of"), horizon, s, promos, weather_series(sales))


def forecast_at(
    fits: Fits, served: dict[dt.date, list[dt.date]], future: DataFrame, s: Settings = Settings(), scale: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame | None:
    """Rows of every decision date by the model of its anchor; features are written once and read by decision date.  None without fits."""
    laid = written(future, "as_of") if fits else future
    out = None
    for anchor, (model, sigma) in sorted(fits.items()):
        rows = boosted(model, sigma, laid.filter(F.col("as_of").isin(served[anchor])), s, scale, carry)
        out = rows if out is None else out.unionByName(rows)
    return out


__all__ = ["FORECAST_COLUMNS", "Fits", "dates_of", "decision_anchors", "fit_at", "forecast_at", "global_future", "training_matrix"]
