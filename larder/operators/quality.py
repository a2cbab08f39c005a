"""Data checks: a full report instead of stopping at the first failure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = ("bank_holiday", "school_holiday", "weekend", "promo")
REQUIRED = (
    "date", "sku", "category", "shelf_life_days", "units_sold", "temp_c",
    "bank_holiday", "school_holiday", "weekend", "dow", "promo",
)


class DataQualityError(ValueError):
    """A sales panel failed a check."""


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataQualityError(f"missing column(s) {missing}; present: {sorted(df.columns)}")


def require_date(df: DataFrame, column: str = "date") -> None:
    if not isinstance(df.schema[column].dataType, T.DateType):
        raise DataQualityError(f"column {column!r} must be DATE, is {df.schema[column].dataType.simpleString()}")


def row_check_counts(df: DataFrame) -> DataFrame:
    """One pass over the rows: size, null and negative quantities, non-binary flags."""
    flags = [F.count_if(~F.col(c).isin(0, 1)).alias(f"bad_{c}") for c in FLAGS if c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("units_sold").isNull()).alias("null_units"),
        F.count_if(F.col("units_sold") < 0).alias("negative_units"),
        *flags,
    )


def negative_examples(df: DataFrame, n: int = 5) -> DataFrame:
    """The first few offending rows, a bounded top-k report."""
    return df.filter("units_sold < 0").select("date", "sku", "units_sold").orderBy("sku", "date", "units_sold").limit(n)


def duplicate_keys(df: DataFrame) -> DataFrame:
    """(sku, date) pairs that occur more than once."""
    return df.groupBy("sku", "date").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_examples(df: DataFrame, n: int = 5) -> DataFrame:
    return duplicate_keys(df).orderBy("sku", "date").limit(n)


def inconsistent_shelf_life(df: DataFrame) -> DataFrame:
    """SKUs that carry more than one shelf life."""
    return df.groupBy("sku").agg(F.countDistinct("shelf_life_days").alias("values")).filter("values > 1")


def grid_gaps(df: DataFrame) -> DataFrame:
    """Missing days per SKU inside its own first..last range; SKUs without gaps are left out."""
    # Distinct (sku, date) first: repeated rows of one hot SKU collapse before the second shuffle.
    days = df.select("sku", "date").distinct()
    span = days.groupBy("sku").agg((F.datediff(F.max("date"), F.min("date")) + 1 - F.count("date")).alias("missing_days"))
    return span.filter("missing_days > 0")


def short_histories(df: DataFrame, min_days: int) -> DataFrame:
    """SKUs with fewer observations than a model needs."""
    return df.groupBy("sku").agg(F.count(F.lit(1)).alias("days")).filter(F.col("days") < min_days)


def unknown_keys(df: DataFrame, known: DataFrame, key: str = "sku") -> DataFrame:
    """Key values of ``df`` that the dimension does not hold."""
    return df.select(key).distinct().join(known.select(key), key, "left_anti")


def quality_report(df: DataFrame) -> DataFrame:
    """One row per check: ``check, violations, sample``.

    All checks read one pre-aggregate at (sku, date) grain, so a hot SKU with many raw rows is
    combined before anything is shuffled by SKU.
    """
    require_columns(df, ["date", "sku", "units_sold"])
    require_date(df)
    flags = [c for c in FLAGS if c in df.columns]
    life = F.col("shelf_life_days") if "shelf_life_days" in df.columns else F.lit(None).cast("int")
    by_day = df.groupBy("sku", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("units_sold").isNull()).alias("nulls"),
        F.count_if(F.col("units_sold") < 0).alias("negatives"),
        F.min(life).alias("life_lo"),
        F.max(life).alias("life_hi"),
        *[F.count_if(~F.col(c).isin(0, 1)).alias(f"bad_{c}") for c in flags],
    )
    by_sku = by_day.groupBy("sku").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.sum("negatives").alias("negatives"),
        F.sum(F.col("n") - 1).alias("extra"),
        F.datediff(F.max("date"), F.min("date")).alias("span"),
        F.count("date").alias("days"),
        (F.min("life_lo") != F.max("life_hi")).cast("int").alias("life"),
        *[F.sum(f"bad_{c}").alias(f"bad_{c}") for c in flags],
    )
    measures = {
        "null_units": F.col("nulls"),
        "negative_units": F.col("negatives"),
        "duplicate_rows": F.col("extra"),
        **{f"flag_{c}": F.col(f"bad_{c}") for c in flags},
        "shelf_life_constant": F.coalesce("life", F.lit(0)),
        "missing_days": F.col("span") + 1 - F.col("days"),
    }
    totals = []
    for name, value in measures.items():
        totals.append(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name))
        totals.append(F.min(F.when(value > 0, F.col("sku"))).alias(f"{name}_sample"))
    row = by_sku.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *totals)
    lines = [F.struct(F.lit("non_empty").alias("check"), (F.col("rows") == 0).cast("bigint").alias("violations"),
                      F.lit(None).cast("string").alias("sample"))]
    lines += [
        F.struct(F.lit(name).alias("check"), F.col(name).alias("violations"), F.col(f"{name}_sample").alias("sample"))
        for name in measures
    ]
    return row.select(F.inline(F.array(*lines)))


def require_valid(df: DataFrame) -> DataFrame:
    """Run the report and raise when any check fails (one job, about ten rows to the driver)."""
    require_columns(df, REQUIRED)
    failed = quality_report(df).filter("violations > 0").collect()
    if failed:
        raise DataQualityError("; ".join(f"{r['check']}: {r['violations']} (e.g. {r['sample']})" for r in failed))
    return df


def require_past_only(history: DataFrame, as_of: dt.date) -> DataFrame:
    """Fail at run time when a history holds the decision date or anything later."""
    late = F.concat(F.lit("history holds "), F.col("date").cast("string"), F.lit(f", not before {as_of}"))
    return history.filter(F.when(F.col("date") < F.lit(as_of), F.lit(True)).otherwise(F.raise_error(late).cast("boolean")))


def leaking_rows(history: DataFrame, as_of: dt.date) -> DataFrame:
    """Per SKU, the rows that a decision at ``as_of`` must not see: how many, the first and the last."""
    late = history.filter(~F.coalesce(F.col("date") < F.lit(as_of), F.lit(False)))
    return late.groupBy("sku").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def require_no_outcomes(future: DataFrame, outcomes=("units_sold",)) -> DataFrame:
    """Refuse a future frame that carries observed demand."""
    leaked = [c for c in outcomes if c in future.columns]
    if leaked:
        raise DataQualityError(f"future rows must not carry outcome column(s) {leaked}")
    return future


def window_problems(start: dt.date, end: dt.date, first: dt.date, last: dt.date, warmup_days: int) -> list[str]:
    """Why a replay window cannot be served; a short warm-up is the last, non-fatal, entry."""
    problems = []
    if start > end:
        problems.append(f"start {start} is after end {end}")
    if start <= first:
        problems.append(f"start {start} needs history before it; data begins {first}")
    if end > last:
        problems.append(f"end {end} is past the last observation {last}")
    if not problems and (start - first).days < warmup_days:
        problems.append(f"warning: {(start - first).days} days of history, {warmup_days} wanted")
    return problems
