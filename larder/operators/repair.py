"""Mend an imperfect sales feed and say what was changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.calendar import calendar_columns
from larder.operators.quality import require_columns
from larder.settings import Settings

PER_SKU = ("category", "shelf_life_days")
LOOKBACK_WEEKS = 4


def typed_units(df: DataFrame) -> DataFrame:
    """``units_sold`` as a number; anything that is not one becomes NULL."""
    return df.withColumn("units_sold", F.expr("try_cast(units_sold AS double)"))


def drop_invalid(df: DataFrame) -> DataFrame:
    """Keep rows with a known, non-negative quantity."""
    return typed_units(df).filter("units_sold >= 0")


def keep_first(df: DataFrame, order: str | None = "ingest_seq") -> DataFrame:
    """One row per (sku, date): the earliest by ``order``, ties broken by all other columns.

    A ``min_by`` aggregate combines copies before the shuffle, so many copies of one key do not
    travel and never meet in one sort.
    """
    rest = [c for c in df.columns if c not in ("sku", "date")]
    rank = F.struct(*([order] if order in df.columns else []), *[c for c in rest if c != order])
    first = df.groupBy("sku", "date").agg(F.min_by(F.struct(*rest), rank).alias("row"))
    return first.select("date", "sku", "row.*").select(*df.columns)


def last_before_next() -> Column:
    """The day before a SKU's next row, or the row's own day when nothing is missing in between."""
    following = F.lead("date").over(Window.partitionBy("sku").orderBy("date"))
    return F.greatest(F.col("date"), F.date_sub(following, 1))


def densify(observed: DataFrame, values: dict | None = None) -> DataFrame:
    """Every day between a SKU's own first and last day.

    ``values`` maps a column to what inserted rows hold (others are NULL); ``is_observed`` marks
    original rows.  Each row emits itself and the missing days up to the next row, so there is no
    join, and windows by SKU that follow need no further shuffle.
    """
    rest = [c for c in observed.columns if c not in ("sku", "date")]
    spans = observed.withColumn("_until", last_before_next())
    rows = spans.select("sku", *rest, F.posexplode(F.sequence("date", "_until")).alias("_after", "date"))
    first = F.col("_after") == 0
    fill = {c: F.when(first, F.coalesce(c, F.lit(v))).otherwise(F.lit(v)) for c, v in (values or {}).items()}
    blank = {c: F.when(first, F.col(c)) for c in rest if c not in fill}
    rows = rows.withColumns({**fill, **blank, "is_observed": first})
    return rows.select("sku", "date", *rest, "is_observed")


def missing_days(observed: DataFrame) -> DataFrame:
    """The (sku, date) pairs absent inside each SKU's own range."""
    spans = observed.select("sku", "date").withColumn("_until", last_before_next()).filter(F.col("_until") > F.col("date"))
    return spans.select("sku", F.explode(F.sequence(F.date_add("date", 1), F.col("_until"))).alias("date"))


def middle(values: Column) -> Column:
    """Median of an array, NULLs left out; NULL when nothing remains."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    lower, upper = F.try_element_at(v, F.floor((n + 1) / 2).cast("int")), F.try_element_at(v, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lower + upper) / 2.0)


def estimates(dense: DataFrame) -> dict[str, Column]:
    """The three imputation candidates on a dense grid where unobserved units are NULL.

    Same weekday in the last four weeks, any day in them, all of the SKU's history.  A series holds
    at most one row per calendar day, which bounds each window partition.
    """
    w = Window.partitionBy("sku").orderBy("date")
    same = F.array(*[F.lag("units_sold", 7 * k).over(w) for k in range(1, LOOKBACK_WEEKS + 1)])
    recent = F.percentile("units_sold", F.lit(0.5)).over(w.rowsBetween(-7 * LOOKBACK_WEEKS, -1))
    return {
        "same_weekday": middle(same),
        "recent": recent,
        "overall": F.median("units_sold").over(Window.partitionBy("sku")),
    }


def impute(dense: DataFrame) -> DataFrame:
    """Fill unobserved days and flag them ``imputed``; ``source`` names the estimate used."""
    e = dense.withColumns(estimates(dense))
    gap = ~F.col("is_observed")
    source = (
        F.when(~gap, F.lit(None))
        .when(F.col("same_weekday").isNotNull(), "same_weekday")
        .when(F.col("recent").isNotNull(), "recent")
        .when(F.col("overall").isNotNull(), "overall")
        .otherwise("zero")
    )
    value = F.coalesce("same_weekday", "recent", "overall", F.lit(0.0))
    e = e.withColumns({"source": source, "imputed": gap, "units_sold": F.when(gap, value).otherwise(F.col("units_sold"))})
    return e.drop("same_weekday", "recent", "overall", "is_observed")


def shared_by_date(df: DataFrame, columns) -> DataFrame:
    """Per date, each column's first known value in SKU order."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("sku"))).alias(c) for c in columns]
    return df.groupBy("date").agg(*first, F.lit(True).alias("date_known"))


def clean_rows(df: DataFrame) -> DataFrame:
    """Invalid rows dropped and copies removed."""
    return keep_first(drop_invalid(df))


def repair_sales(df: DataFrame, promos: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """A gap-free panel with an ``imputed`` flag.  Repairing a repaired panel changes nothing.

    Inserted days copy the SKU's constants and the calendar and weather other SKUs recorded that
    day; ``dow`` and ``weekend`` are derived when no SKU recorded it.  The promotion flag of an
    inserted day comes from ``promos`` (sku, date, promo), else it is 0: a promotion belongs to one
    product and is not copied from another.
    """
    require_columns(df, ["date", "sku", "units_sold"])
    already = "imputed" in df.columns
    if already:
        df = df.withColumnRenamed("imputed", "was_imputed")
    rows = clean_rows(df).drop("ingest_seq")
    constants = [c for c in PER_SKU if c in rows.columns]
    shared = [c for c in rows.columns if c not in {"date", "sku", "units_sold", "promo", "was_imputed", *constants}]
    panel = impute(densify(rows)).drop("source")
    per_sku = rows.groupBy("sku").agg(*[F.min_by(c, "date").alias(f"{c}_first") for c in constants]) if constants else None
    if per_sku is not None:
        panel = panel.join(per_sku, "sku")
        panel = panel.withColumns({c: F.when(F.col("imputed"), F.col(f"{c}_first")).otherwise(F.col(c)) for c in constants})
        panel = panel.drop(*[f"{c}_first" for c in constants])
    if shared:
        # One row per calendar day, so the broadcast side is bounded by the length of the calendar.
        cal = shared_by_date(rows, shared).select("date", *[F.col(c).alias(f"{c}_day") for c in shared], "date_known")
        panel = panel.join(F.broadcast(cal), "date", "left")
        derived = calendar_columns("date", s)
        fill = {}
        for c in shared:
            other = F.col(f"{c}_day")
            if c in ("dow", "weekend"):
                other = F.when(F.col("date_known"), other).otherwise(derived[c])
            fill[c] = F.when(F.col("imputed"), other).otherwise(F.col(c))
        panel = panel.withColumns(fill).drop("date_known", *[f"{c}_day" for c in shared])
    if "promo" in panel.columns:
        planned = F.lit(0)
        if promos is not None:
            panel = panel.join(promos.select("sku", "date", F.col("promo").alias("planned")), ["sku", "date"], "left")
            planned = F.coalesce("planned", F.lit(0))
        panel = panel.withColumn("promo", F.when(F.col("imputed"), planned).otherwise(F.col("promo"))).drop("planned")
    if already:
        panel = panel.withColumn("imputed", F.col("imputed") | F.coalesce("was_imputed", F.lit(False))).drop("was_imputed")
    kept = [c for c in df.columns if c not in ("ingest_seq", "was_imputed")]
    return panel.select(*kept, "imputed")


def repair_report(df: DataFrame) -> DataFrame:
    """One row: what a repair of ``df`` changes, the number of SKUs affected and a sentence.

    The counts come from one aggregate at (sku, date) grain, then one per SKU; SKU names are
    reported by :func:`affected_skus`, which stays a table.
    """
    by_sku = _changes(df)
    counts = by_sku.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in CHANGES],
        F.count_if(_touched()).alias("skus_affected"),
    )
    days = clean_rows(typed_units(df)).select("date").distinct()
    gaps = missing_days(clean_rows(typed_units(df))).join(days, "date", "left_anti")
    counts = counts.withColumn("days_without_calendar", gaps.agg(F.count(F.lit(1)).cast("bigint")).scalar())
    filled = F.concat(
        F.concat_ws(" ", "missing_days_filled", F.lit("missing day(s) filled")),
        F.when(F.col("days_without_calendar") > 0,
               F.concat(F.lit(" ("), "days_without_calendar", F.lit(" without a calendar to copy)"))).otherwise(""),
    )
    parts = F.concat_ws(
        "; ",
        F.when(F.col("invalid_rows_dropped") > 0, F.concat("invalid_rows_dropped", F.lit(" invalid row(s) dropped"))),
        F.when(F.col("duplicate_rows_dropped") > 0, F.concat("duplicate_rows_dropped", F.lit(" duplicate row(s) dropped"))),
        F.when(F.col("missing_days_filled") > 0, filled),
    )
    clean = (F.col("invalid_rows_dropped") + F.col("duplicate_rows_dropped") + F.col("missing_days_filled")) == 0
    text = F.when(clean, F.lit("Sales feed needed no repair.")).otherwise(
        F.concat(F.lit("Sales feed repaired: "), parts, F.lit(". Products affected: "), "skus_affected", F.lit("."))
    )
    return counts.withColumns({"clean": clean, "summary": text})


CHANGES = ("invalid_rows_dropped", "duplicate_rows_dropped", "missing_days_filled")


def _changes(df: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("units_sold") >= 0, F.lit(False))
    by_day = typed_units(df).groupBy("sku", "date").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    kept_day = F.when(F.col("good") > 0, F.col("date"))
    return by_day.groupBy("sku").agg(
        F.sum("bad").alias("invalid_rows_dropped"),
        F.sum(F.greatest(F.col("good") - 1, F.lit(0))).alias("duplicate_rows_dropped"),
        F.coalesce(F.datediff(F.max(kept_day), F.min(kept_day)) + 1 - F.count(kept_day), F.lit(0)).alias("missing_days_filled"),
    )


def _touched() -> Column:
    return F.greatest(*CHANGES) > 0


def affected_skus(df: DataFrame) -> DataFrame:
    """SKUs touched by a repair, with the three counts."""
    return _changes(df).filter(_touched()).select("sku", *CHANGES)
