"""Forecast models written in Python, run on every series and decision date side by side."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.models import FORECAST_COLUMNS, Model, with_interval
from larder.settings import Settings


class CannotFit(Exception):
    """Raised by a model that declines a series; the series then has no forecast of this model."""


class SeriesModel(Protocol):
    """What a model of one series offers.  ``sigma`` is read after ``fit``: the spread of its one-step errors."""

    sigma: float

    def fit(self, dates: np.ndarray, units: np.ndarray) -> None:
        """Learn from the days before the decision, ascending (``datetime64[D]`` and doubles)."""

    def predict(self, horizon: int) -> np.ndarray:
        """One value for each of the ``horizon`` days from the decision date on."""


FITTED = "as_of date, sku string, points array<double>, sigma double, mase_scale double"
SENT = ("sku", "date", "units_sold", "mase_scale", "cuts")


def checked(points, sigma, horizon: int, where: str) -> tuple[list[float], float]:
    """The forecast contract: ``horizon`` finite values and a finite spread that is not negative."""
    values = np.asarray(points, dtype="float64")
    if values.shape != (horizon,):
        raise ValueError(f"{where}: expected {horizon} values, got an array of shape {values.shape}")
    spread = float(sigma)
    if not np.isfinite(values).all() or not np.isfinite(spread) or spread < 0:
        raise ValueError(f"{where}: values and spread must be finite and the spread not negative")
    return values.tolist(), spread


def python_model(name: str, make: Callable[[], SeriesModel], min_days: int = 1) -> Model:
    """A forecast model for ``models=`` from a class of your own; ``make`` gives a fresh object for every fit.
    The workers must be able to import its module (``spark.addArtifacts`` or ``--py-files``).

    The state of the series is partitioned by SKU already, so its days go to Python without another shuffle, one Arrow table a SKU
    (at most one row per calendar day, whatever the SKU sells).  One object is fitted per decision date on the days before it.
    Days without a known quantity are left out; a series with fewer than ``min_days`` known days, or one the model
    declines with ``CannotFit``, has no rows.  Any other error, a wrong number of values or a value that is not finite fails the
    job and names model, SKU and date.  Negative values are clipped at zero, bounds widen as for every other model.
    """

    def model(state: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
        def fitted(days: pa.Table) -> pa.Table:
            days = days.sort_by("date")
            sku = days["sku"][0].as_py()
            dates = days["date"].to_numpy().astype("datetime64[D]")
            units = days["units_sold"].to_numpy().astype("float64")
            known = ~np.isnan(units)
            scales, cuts = days["mase_scale"].to_pylist(), days["cuts"].to_pylist()
            out = []
            for i, decided in enumerate(cuts):
                if not decided or known[: i + 1].sum() < max(min_days, 1):
                    continue
                seen = known[: i + 1]
                for as_of in decided:
                    where = f"{name}, {sku}, {as_of}"
                    own = make()
                    try:
                        own.fit(dates[: i + 1][seen], units[: i + 1][seen])
                        points = own.predict(horizon)
                    except CannotFit:
                        continue
                    except Exception as error:
                        raise RuntimeError(f"{where}: {error}") from error
                    points, sigma = checked(points, own.sigma, horizon, where)
                    out.append((as_of, sku, points, sigma, scales[i]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.date32(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            fields = ("as_of", "sku", "points", "sigma", "mase_scale")
            return pa.table({f: pa.array(c, k) for f, c, k in zip(fields, columns, kinds, strict=True)})

        fits = state.select(*SENT).groupBy("sku").applyInArrow(fitted, FITTED)
        rows = fits.select("as_of", "sku", "sigma", "mase_scale", F.posexplode("points").alias("place", "predicted_demand"))
        rows = rows.withColumns({"step": F.col("place") + 1, "model": F.lit(name)})
        rows = rows.withColumn("forecast_date", F.date_add("as_of", F.col("place")))
        return with_interval(rows, s).select(*FORECAST_COLUMNS)

    return model
