"""Cost ledgers of recorded movements, one for every strategy whose receipts and issues were logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.kpi import compute_kpis
from larder.operators.ledger import DUST, full_days, perishable_ledger, share_order_fee, with_costs
from larder.settings import Settings

TERMS = ("unit_cost", "holding_cost_per_unit_per_day", "stockout_cost_per_unit")
FLOWS = ("opening_stock", "received", "expired_units", "demand", "served", "stockout_units", "closing_stock")


def split_by(moves: DataFrame, strategies: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``strategy, sku, date, received, demand`` from one pass over raw movements.

    ``strategies`` maps a name to its columns of receipts and demand (NULL where a row is neither).  All sums are taken together at
    (SKU, day) first, so raw rows are shuffled once however many strategies there are.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{k}_{i}") for i, pair in enumerate(strategies.values()) for k, c in zip(("in", "out"), pair, strict=True)]
    days = moves.groupBy("sku", "date").agg(*sums)
    sides = [
        F.struct(F.lit(name).alias("strategy"), F.col(f"in_{i}").alias("received"), F.col(f"out_{i}").alias("demand")) for i, name in enumerate(strategies)
    ]
    return days.select("sku", "date", F.inline(F.array(*sides)))


GROUP = ("strategy", "setting_name", "setting_value")


def grouped(ledger: DataFrame) -> list[str]:
    """The columns that tell the ledgers of one table apart, the SKU aside."""
    return [c for c in GROUP if c in ledger.columns]


def recorded_ledger(log: DataFrame, economics: DataFrame, s: Settings = Settings(), shelf_lives: tuple[int, ...] | None = None) -> DataFrame:
    """Daily stock and cost of every (strategy, SKU) between its first and last movement.

    ``log``: strategy, sku, date, received, demand, one row per key as :func:`split_by` gives them; days without movement are put in.
    A SKU without commercial terms has no costs and is left out.  The stock starts empty, the oldest is served first and expires after the
    shelf life.  Every receipt was ordered ``lead_days`` before: ``on_order`` is what arrives in the lead time to come, and a
    delivery day has one charge, shared by the SKUs delivered.

    With ``shelf_lives`` there is a ledger for each of them instead of the one of the SKU's own, told apart by ``setting_name`` and
    ``setting_value``: what the same movements would have left with another shelf life.
    """
    days = full_days(log.select(F.struct("strategy", "sku").alias("sku"), "date", "received", "demand"))
    if shelf_lives is None:
        lives = economics.select(F.col("sku").alias("terms_of"), "shelf_life_days")
        days = days.join(lives, F.col("sku.sku") == F.col("terms_of")).drop("terms_of")
        keys = ["strategy"]
    else:
        days = days.withColumn("shelf_life_days", F.explode(F.array(*[F.lit(n) for n in shelf_lives])))
        setting = (F.lit("shelf_life_days").alias("setting_name"), F.col("shelf_life_days").cast("double").alias("setting_value"))
        days = days.withColumn("sku", F.struct("sku.strategy", *setting, "sku.sku"))
        keys = list(GROUP)
    led = perishable_ledger(days)
    ahead = Window.partitionBy("sku").orderBy("date").rowsBetween(1, s.lead_days)
    led = led.withColumn("on_order", F.coalesce(F.sum("received").over(ahead), F.lit(0.0)))
    led = led.select(*[f"sku.{k}" for k in keys], "sku.sku", "date", "shelf_life_days", *FLOWS, "on_order")
    led = led.join(economics.select("sku", *TERMS), "sku")
    return with_costs(share_order_fee(led, keys, s, quantity="received"), s)


def recorded_orders(ledger: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The orders behind the receipts of a ledger."""
    came = ledger.filter(F.col("received") > DUST)
    return came.select(
        *grouped(ledger), "sku", F.date_sub("date", s.lead_days).alias("ordered_on"), F.col("date").alias("arrives_on"), F.col("received").alias("quantity"),
        (F.col("received") * F.col("unit_cost")).alias("order_value"),
    )


def recorded_kpis(ledger: DataFrame, s: Settings = Settings(), by: tuple[str, ...] = ()) -> DataFrame:
    """The KPI row of each ledger, or of each ledger and value of ``by``."""
    return compute_kpis(ledger, [*grouped(ledger), *by], recorded_orders(ledger, s))


def recorded_frontier(ledger: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One KPI row per (strategy, setting), rounded to three places."""
    kpis = recorded_kpis(ledger, s)
    return kpis.select(*[c if c in GROUP else F.bround(c, 3).alias(c) for c in kpis.columns])
