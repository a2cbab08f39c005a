"""The (SKU, day) panel on storage, laid out by month and SKU.

A window or join by SKU over this table needs no shuffle, a range of dates reads the folders of its months only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "panel_month"


def save_clustered(panel: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Write a panel once as table ``name`` under ``path``, in months and ``buckets`` hash buckets of the SKU.

    The rows are dealt to tasks by the hash that the buckets use, so every task writes one file a month.  A SKU has at most one row per
    day, so a hot SKU is no bigger than others.  Choose ``buckets`` so that all months of one bucket fit a task; tables that are joined
    by SKU should have the same number.
    """
    rows = panel.withColumn(MONTH, F.date_format("date", "yyyy-MM")).repartition(buckets, "sku")
    writer = rows.write.format("parquet").partitionBy(MONTH).bucketBy(buckets, "sku").sortBy("sku", "date")
    writer.option("path", path).mode("error").saveAsTable(name)
    return panel.sparkSession.table(name)


def open_clustered(spark: SparkSession, name: str, path: str, columns: str, buckets: int = 64) -> DataFrame:
    """Make a panel that another session wrote known to this one.  ``columns`` is its schema as text, without the month."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {MONTH} STRING) USING parquet PARTITIONED BY ({MONTH}) "
        f"CLUSTERED BY (sku) SORTED BY (sku, date) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def between(panel: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Days ``first`` to ``last``, both included; the months prune folders, the days go to the scan."""
    for day, at in ((first, F.Column.__ge__), (last, F.Column.__le__)):
        if day is not None:
            panel = panel.filter(at(F.col(MONTH), F.lit(f"{day:%Y-%m}")) & at(F.col("date"), F.lit(day)))
    return panel.drop(MONTH)
