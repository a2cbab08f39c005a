"""Row numbers and running totals along one global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.folder import written


def running(
    df: DataFrame, order: list[Column], totals: dict[str, Column] | None = None, ranges: int | None = None,
    whole: dict[str, tuple] | None = None,
) -> DataFrame:
    """Add ``position`` (from 1) and running totals along a unique ``order``.

    ``whole`` adds aggregates over all rows as ``name: (function, column)`` with a function that
    combines with itself (``F.sum``, ``F.min``, ``F.max``).

    The rows are written once, in the engine's own ranges of the order (as many as it sees fit, or ``ranges``) and with the number of
    their range.  Each range is numbered on
    its own and shifted by the totals of the ranges before it; that table has one row per range, which is what the broadcast and the
    one unpartitioned window see.
    """
    totals, whole = totals or {}, whole or {}
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    laid = keyed.repartitionByRange(ranges, "_key") if ranges else keyed.repartitionByRange("_key")
    ranged = written(laid.withColumn("_range", F.spark_partition_id()))

    sums = [F.sum(v).alias(f"_sum_{name}") for name, v in totals.items()]
    wholes = [fn(c).alias(f"_part_{name}") for name, (fn, c) in whole.items()]
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *sums, *wholes)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        "_range",
        *[
            F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
            for c in ["_n", *[f"_sum_{name}" for name in totals]]
        ],
        *[fn(f"_part_{name}").over(every).alias(name) for name, (fn, _) in whole.items()],
    )
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(offsets), "_range")
    placed = placed.withColumns(
        {
            "position": F.count(F.lit(1)).over(inside) + F.col("_n_before"),
            **{name: F.sum(v).over(inside) + F.col(f"_sum_{name}_before") for name, v in totals.items()},
        }
    )
    return placed.drop("_key", "_range", "_n_before", *[f"_sum_{name}_before" for name in totals])


def sku_codes(sales: DataFrame) -> DataFrame:
    """``sku, sku_code``: integer codes from 0 in SKU order."""
    numbered = running(sales.select("sku").distinct(), [F.col("sku")])
    return numbered.select("sku", (F.col("position") - 1).cast("int").alias("sku_code"))
