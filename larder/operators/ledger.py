"""Stock ledgers over a movement log, and replay of ordering policies over history.

A log has one row per (SKU, day): ``sku, date, received, demand`` after pre-aggregation, so every
per-SKU partition and array below is bounded by the number of calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ordering import in_packs
from larder.operators.repair import densify
from larder.settings import Settings


def daily_movements(moves: DataFrame) -> DataFrame:
    """Pre-aggregate raw movements to one row per (SKU, day)."""
    return moves.groupBy("sku", "date").agg(
        F.coalesce(F.sum("received"), F.lit(0.0)).alias("received"), F.coalesce(F.sum("demand"), F.lit(0.0)).alias("demand")
    )


def full_days(log: DataFrame) -> DataFrame:
    """One row for every day between a SKU's first and last movement."""
    return densify(log, {"received": 0.0, "demand": 0.0}).drop("is_observed")


def lost_sales_ledger(log: DataFrame, opening: float = 0.0) -> DataFrame:
    """Non-perishable stock with unmet demand lost: two running aggregates, no fold.

    With ``free`` the balance ignoring lost sales, stock after each day is ``free`` minus the lowest
    ``free`` so far when that is negative (reflection at zero).
    """
    w = Window.partitionBy("sku").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy("sku").orderBy("date")
    led = log.withColumn("free", opening + F.sum(F.col("received") - F.col("demand")).over(w))
    led = led.withColumn("closing_stock", F.col("free") - F.least(F.lit(0.0), F.min("free").over(w)))
    led = led.withColumn("opening_stock", F.coalesce(F.lag("closing_stock").over(prior), F.lit(float(opening))))
    served = F.col("opening_stock") + F.col("received") - F.col("closing_stock")
    led = led.withColumns({"served": served, "stockout_units": F.col("demand") - served})
    return led.select("sku", "date", "opening_stock", "received", "demand", "served", "stockout_units", "closing_stock")


def perishable_ledger(log: DataFrame, shelf_life: str = "shelf_life_days") -> DataFrame:
    """Perishable stock, oldest served first; a batch expires ``shelf_life`` days after receipt.

    With A(t) units received up to day t and Dep(t) units gone (sold or expired):
    Dep(t) = min(A(t), max(Dep(t-1), A(t-L)) + demand(t)).  A day is a map x -> min(u, max(x + c, l)), and maps of this form compose to
    one of the same form.  So each month is composed on its own, the months of a SKU are passed through in order, and every month
    puts out its days from the state it opens with: no task walks a series day by day, and what a group holds is a month of days or a
    SKU's months.  ``log`` must have consecutive days per SKU.
    """
    w = Window.partitionBy("sku").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0.0)
    # What has expired by a day at the latest is what was received a shelf life before: receipts come back on that day.
    lines = log.select("sku", shelf_life, "date", "received", "demand", none.alias("aging"), F.lit(True).alias("own"))
    again = log.filter("received > 0").select("sku", shelf_life, F.date_add("date", F.col(shelf_life)).alias("date"), none, none, F.col("received"), F.lit(False))
    both = lines.union(again).groupBy("sku", shelf_life, "date").agg(*[F.sum(c).alias(c) for c in ("received", "demand", "aging")], F.max("own").alias("own"))
    rows = both.withColumns({"total_in": F.sum("received").over(w), "aged": F.sum("aging").over(w)}).filter("own")

    entry = F.struct("date", "received", "demand", "total_in", "aged")
    months = rows.groupBy("sku", shelf_life, F.trunc("date", "month").alias("month")).agg(F.array_sort(F.collect_list(entry)).alias("days"))
    same = F.struct(F.lit(float("inf")).alias("u"), none.alias("c"), F.lit(float("-inf")).alias("l"))
    composed = F.aggregate("days", same, lambda m, d: F.struct(
        F.least(d["total_in"], F.greatest(m["u"] + d["demand"], d["aged"] + d["demand"])).alias("u"), (m["c"] + d["demand"]).alias("c"),
        F.greatest(m["l"] + d["demand"], d["aged"] + d["demand"]).alias("l"),
    ))
    maps = months.select("sku", "month", composed.alias("m")).groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("month", "m"))).alias("maps"))
    start = F.struct(none.alias("gone"), F.array().cast("array<struct<month:date,opening:double>>").alias("out"))
    opened = F.aggregate("maps", start, lambda acc, x: F.struct(
        F.least(x["m"]["u"], F.greatest(acc["gone"] + x["m"]["c"], x["m"]["l"])).alias("gone"),
        F.concat(acc["out"], F.array(F.struct(x["month"].alias("month"), acc["gone"].alias("opening")))).alias("out"),
    ), lambda acc: acc["out"])
    months = months.join(maps.select("sku", F.inline(opened)), ["sku", "month"])

    first = F.struct(F.col("opening").alias("gone"), F.array().cast("array<double>").alias("trace"))

    def step(acc, d):
        gone = F.least(d["total_in"], F.greatest(acc["gone"], d["aged"]) + d["demand"])
        return F.struct(gone.alias("gone"), F.concat(acc["trace"], F.array(gone)).alias("trace"))

    months = months.withColumn("trace", F.aggregate("days", first, step, lambda acc: acc["trace"]))

    def line(d, i):
        past = F.when(i > 0, F.get("trace", i - 1)).otherwise(F.col("opening"))
        expired, gone = F.greatest(past, d["aged"]), F.get("trace", i)
        return F.struct(
            d["date"].alias("date"), (d["total_in"] - d["received"] - past).alias("opening_stock"), d["received"].alias("received"),
            (expired - past).alias("expired_units"), d["demand"].alias("demand"), (gone - expired).alias("served"),
            (d["demand"] - (gone - expired)).alias("stockout_units"), (d["total_in"] - gone).alias("closing_stock"),
            gone.alias("gone"), d["total_in"].alias("total_in"),
        )

    return months.select("sku", shelf_life, F.inline(F.transform("days", line)))


def batch_allocation(log: DataFrame) -> DataFrame:
    """Which receipt served which issue, oldest first, for a log without expiry.

    Receipts and issues are laid end to end as intervals of cumulative units; served units are the
    overlap.  Sweeping the sorted interval ends pairs each elementary piece with its receipt and its
    issue, so the work is linear in the log and no (receipt, issue) pairs are formed.
    ``log`` rows: sku, date, received, served.
    """
    w = Window.partitionBy("sku").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = log.withColumns({"in_to": F.sum("received").over(w), "out_to": F.sum("served").over(w)})
    ends = sums.select(
        "sku",
        F.inline(F.array(
            F.struct(F.col("in_to").alias("at"), F.when(F.col("received") > 0, F.col("date")).alias("received_on"), F.lit(None).cast("date").alias("issued_on")),
            F.struct(F.col("out_to").alias("at"), F.lit(None).cast("date").alias("received_on"), F.when(F.col("served") > 0, F.col("date")).alias("issued_on")),
        )),
    ).filter("received_on IS NOT NULL OR issued_on IS NOT NULL")
    ends = ends.groupBy("sku", "at").agg(F.max("received_on").alias("received_on"), F.max("issued_on").alias("issued_on"))
    # The piece ending at ``at`` lies in the interval whose end is the nearest at or after it.
    down = Window.partitionBy("sku").orderBy(F.desc("at"))
    seen = down.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select(
        "sku", "at",
        F.last("received_on", True).over(seen).alias("received_on"),
        F.last("issued_on", True).over(seen).alias("issued_on"),
        F.coalesce(F.lead("at").over(down), F.lit(0.0)).alias("from"),
    )
    both = pieces.filter("received_on IS NOT NULL AND issued_on IS NOT NULL AND at > `from`")
    return both.groupBy("sku", "received_on", "issued_on").agg(F.sum(F.col("at") - F.col("from")).alias("units"))


def batch_ages(ledger: DataFrame, unit_cost: str | None = None, soon_days: int = 2, shelf_life: str = "shelf_life_days") -> DataFrame:
    """Per day of a perishable ledger: batches held, mean age, units about to expire, value.

    What is left of the receipt of day a is ``A(a) - max(Dep, A(a-1))``, never below zero.  The
    lookback per day is one shelf life, over a per-SKU array of cumulative receipts.
    """
    w = Window.partitionBy("sku").orderBy("date")
    rows = ledger.withColumn("day", F.row_number().over(w))
    life = F.col(shelf_life)
    # Cumulative receipts of the last shelf life of days, oldest first; element 0 is the level before them.
    entry = F.struct("day", "date", "total_in", "gone", "closing_stock", *([unit_cost] if unit_cost else []))
    per = rows.groupBy("sku", shelf_life).agg(F.array_sort(F.collect_list(entry)).alias("days"))
    per = per.withColumn("inflow", F.transform("days", lambda d: d["total_in"]))

    def held(d):
        ages = F.sequence(F.lit(0), F.least(life, d["day"]) - 1)
        level = lambda day: F.coalesce(F.when(day > 0, F.get("inflow", day - 1)), F.lit(0.0))
        left = lambda age: F.greatest(level(d["day"] - age) - F.greatest(d["gone"], level(d["day"] - age - 1)), F.lit(0.0))
        return F.transform(ages, lambda age: F.struct(age.alias("age"), left(age).alias("units")))

    flat = per.select("sku", shelf_life, F.inline(F.transform(
        "days", lambda d: F.struct(d["date"].alias("date"), d["closing_stock"].alias("closing_stock"),
                                   *([d[unit_cost].alias("unit_cost")] if unit_cost else []), held(d).alias("held")))))
    total = lambda value: F.aggregate("held", F.lit(0.0), lambda acc, b: acc + value(b))
    out = {
        "batches": F.size(F.filter("held", lambda b: b["units"] > 1e-9)),
        "mean_age_days": F.when(F.col("closing_stock") > 1e-9, total(lambda b: b["units"] * b["age"]) / F.col("closing_stock")).otherwise(0.0),
        "expiring_soon": total(lambda b: F.when(life - b["age"] <= soon_days, b["units"]).otherwise(0.0)),
    }
    if unit_cost:
        out["inventory_value"] = F.col("closing_stock") * F.col("unit_cost")
    return flat.withColumns(out).drop("held", "unit_cost")


# -- costs ----------------------------------------------------------------------------------------


def with_costs(ledger: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Holding, waste and stockout cost of ledger rows that carry the economics columns."""
    out = ledger.withColumns(
        {
            "holding_cost": F.col("closing_stock") * F.col("holding_cost_per_unit_per_day"),
            "waste_cost": F.col("expired_units") * (F.col("unit_cost") + s.disposal_cost),
            "stockout_cost": F.col("stockout_units") * F.col("stockout_cost_per_unit"),
            "inventory_value": F.col("closing_stock") * F.col("unit_cost"),
            "stockout_day": (F.col("stockout_units") > DUST).cast("int"),
        }
    )
    if "ordering_cost" not in out.columns:
        out = out.withColumn("ordering_cost", F.lit(0.0))
    return out.withColumn("total_cost", F.col("holding_cost") + F.col("waste_cost") + F.col("stockout_cost") + F.col("ordering_cost"))


def share_order_fee(ledger: DataFrame, group: list[str], s: Settings = Settings(), quantity: str = "recommended_order") -> DataFrame:
    """One delivery charge per order day, split equally over the SKUs ordered that day.

    The number of SKUs per day is counted by a partial aggregate and joined back (one row per group
    and calendar day; the planner chooses the join by its size), not by a window that would gather all SKUs of a day.
    """
    ordered = F.col(quantity) > DUST
    lines = ledger.filter(ordered).groupBy(*group, "date").agg(F.count(F.lit(1)).alias("lines"))
    joined = ledger.join(lines, [*group, "date"], "left")
    return joined.withColumn("ordering_cost", F.when(ordered, s.order_fee / F.col("lines")).otherwise(0.0)).drop("lines")


def ledger_violations(ledger: DataFrame, group: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Broken invariants per rule: conservation, carry-over, served <= demand, cost parts."""
    prior = Window.partitionBy(*group, "sku").orderBy("date")
    carried = F.lag("closing_stock").over(prior)
    c = F.col
    rows = ledger.withColumns(
        {
            "conservation": F.abs(c("opening_stock") + c("received") - c("expired_units") - c("served") - c("closing_stock")),
            "carry_over": F.coalesce(F.abs(carried - c("opening_stock")), F.lit(0.0)),
            "served_within_demand": F.greatest(c("served") - c("demand"), F.lit(0.0)),
            "shortage_balance": F.abs(c("served") + c("stockout_units") - c("demand")),
            "non_negative": F.greatest(-F.least("closing_stock", "served", "expired_units", "stockout_units"), F.lit(0.0)),
        }
    )
    rules = ["conservation", "carry_over", "served_within_demand", "shortage_balance", "non_negative"]
    if "total_cost" in ledger.columns:
        parts = c("holding_cost") + c("waste_cost") + c("stockout_cost") + c("ordering_cost")
        rows = rows.withColumn("cost_parts", F.abs(c("total_cost") - parts))
        rules.append("cost_parts")
    row = rows.agg(*[F.count_if(c(r) > tolerance).alias(r) for r in rules])
    return row.unpivot([], rules, "rule", "violations")


# Quantities below this are rounding noise of the arithmetic, not stock and not orders.
DUST = 1e-9

# -- policy replay --------------------------------------------------------------------------------

REPLAY_COLUMNS = (
    "opening_stock", "received", "expired_units", "available_stock", "demand", "served", "stockout_units",
    "closing_stock", "on_order", "mean_age_days", "recommended_order", "is_review_day",
)


def replay(days: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """Replay ordering over consecutive days for every key group (SKU, policy, setting, ...).

    ``days`` rows: keys, ``date, demand, is_review_day`` and, on review days, stock-independent
    terms: ``target, reorder_point (or NULL), life_demand (or NULL: no cap), most (or NULL)``; plus
    per-group constants ``opening, shelf_life_days, pack_size, min_order_quantity``.

    Each day: receive what was ordered ``lead`` days ago, drop expired stock, order on review days
    from the position then known, serve demand oldest stock first.  Orders depend on stock only
    through units placed and units gone, so the fold state is those two traces; groups run in
    parallel and each holds one entry per replayed day.
    """
    lead = s.lead_days
    if lead < 1:
        raise ValueError("a replay needs a lead time of at least one day")
    constants = ["opening", "shelf_life_days", "pack_size", "min_order_quantity"]
    entry = F.struct("date", "demand", "is_review_day", "target", "reorder_point", "life_demand", "most")
    per = days.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("days"), *[F.first(c).alias(c) for c in constants]
    )
    opening, life = F.col("opening"), F.col("shelf_life_days")
    pack, least = F.col("pack_size").cast("double"), F.col("min_order_quantity").cast("double")
    # Traces are cumulative; an index below zero is before the first day.
    upto = lambda trace, i: F.coalesce(F.when(i >= 0, F.get(trace, i)), F.lit(0.0))
    # Units received by the end of day i (0-based); the opening batch arrived on day -1.
    inflow = lambda placed, i: opening + upto(placed, i - lead)
    aged = lambda placed, i: F.when(i - life >= -1, inflow(placed, i - life)).otherwise(0.0)
    start = F.struct(F.array().cast("array<double>").alias("placed"), F.array().cast("array<double>").alias("gone"))

    def step(acc, d):
        i = F.size(acc["placed"])
        ordered = upto(acc["placed"], i - 1)
        past = F.greatest(upto(acc["gone"], i - 1), aged(acc["placed"], i))
        position = opening + ordered - past
        raw = F.greatest(d["target"] - position, F.lit(0.0))
        # LEAST skips NULLs, so a missing cap or limit does not bind.
        cap = F.when(d["life_demand"].isNotNull(), F.greatest(d["life_demand"] - position, F.lit(0.0)))
        capped = F.least(raw, cap, d["most"])
        cases = in_packs(capped, pack, s.pack_rounding)
        wanted = d["is_review_day"] & (d["reorder_point"].isNull() | (position <= d["reorder_point"]))
        q = F.when(wanted, F.transform(F.array(cases), lambda c: F.when(c > DUST, F.greatest(c, least)).otherwise(0.0))[0]).otherwise(0.0)
        gone = F.least(inflow(acc["placed"], i), past + d["demand"])
        return F.struct(
            F.concat(acc["placed"], F.array(ordered + q)).alias("placed"), F.concat(acc["gone"], F.array(gone)).alias("gone")
        )

    per = per.withColumn("trace", F.aggregate("days", start, step)).withColumns(
        {"placed": F.col("trace.placed"), "gone": F.col("trace.gone")}
    )
    placed = F.col("placed")

    def line(d, i):
        past, gone = upto(F.col("gone"), i - 1), F.get("gone", i)
        spoiled = F.greatest(past, aged(placed, i))
        total, before = inflow(placed, i), inflow(placed, i - 1)
        ages = F.sequence(F.lit(0), F.least(life - 1, i + 1))
        level = lambda k: F.when(k >= -1, inflow(placed, k)).otherwise(0.0)
        left = lambda age: F.greatest(level(i - age) - F.greatest(gone, level(i - age - 1)), F.lit(0.0))
        weighted = F.aggregate(ages, F.lit(0.0), lambda acc, age: acc + age * left(age))
        closing = total - gone
        return F.struct(
            d["date"].alias("date"), (before - past).alias("opening_stock"), (total - before).alias("received"),
            (spoiled - past).alias("expired_units"), (total - spoiled).alias("available_stock"), d["demand"].alias("demand"),
            (gone - spoiled).alias("served"), (d["demand"] - (gone - spoiled)).alias("stockout_units"),
            closing.alias("closing_stock"), (opening + F.get(placed, i) - total).alias("on_order"),
            F.when(closing > 1e-9, weighted / closing).otherwise(0.0).alias("mean_age_days"),
            (F.get(placed, i) - upto(placed, i - 1)).alias("recommended_order"),
            d["is_review_day"].cast("int").alias("is_review_day"),
        )

    return per.select(*keys, F.inline(F.transform("days", line)))


def order_log(ledger: DataFrame, keys: list[str], unit_cost: str = "unit_cost", s: Settings = Settings()) -> DataFrame:
    """Orders placed: one row per ledger day with a quantity."""
    placed = ledger.filter(F.col("recommended_order") > DUST)
    return placed.select(
        *keys, F.col("date").alias("ordered_on"), F.date_add("date", s.lead_days).alias("arrives_on"),
        F.col("recommended_order").alias("quantity"), (F.col("recommended_order") * F.col(unit_cost)).alias("order_value"),
    )
