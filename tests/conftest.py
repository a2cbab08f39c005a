from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from larder.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4)
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Two SKUs, 140 days: a smooth one and a spiky one, from fixed arithmetic."""
    rows = []
    for i in range(140):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=i)
        weekend = int(day.weekday() >= 4)
        smooth = float(round(100 * (1.5 if weekend else 1.0) + (i * 37) % 11))
        spiky = float((i * 7) % 9) if (i * 13) % 20 >= 9 else 0.0
        for sku, units, life in (("Smooth", smooth, 5), ("Spiky", spiky, 3)):
            rows.append((day, sku, "C1", life, units, 12.0 + i % 5, 0, 0, weekend, day.weekday(), int((i + life) % 13 == 0)))
    from larder.sources.sales import SALES_SCHEMA

    return spark.createDataFrame(rows, SALES_SCHEMA).persist()


@pytest.fixture(scope="session")
def feed(spark):
    """28 days of two products, no noise."""
    from larder.sources.sales import SALES_SCHEMA

    rows = []
    for i in range(28):
        day = dt.date(2025, 1, 6) + dt.timedelta(days=i)
        for k, sku in enumerate(("Bacon", "Milk")):
            units = 40.0 + 10 * (day.weekday() >= 5) + k
            rows.append((day, sku, "Dairy", 5, units, 12.0, 0, 0, int(day.weekday() >= 4), day.weekday(), 0))
    return spark.createDataFrame(rows, SALES_SCHEMA)
