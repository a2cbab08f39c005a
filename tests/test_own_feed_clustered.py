"""Models of one's own in Python, feeds in drops and the clustered panel."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import features, models
from larder.operators.own import CannotFit, python_model
from larder.operators.repair import keep_first
from larder.plans import backtest
from larder.settings import Settings
from larder.sources import clustered
from larder.sources.store import Store
from larder.streaming import feed

AS_OF = dt.date(2025, 5, 1)
S = Settings(perfect_foresight=True, folds=3)


def last_value():
    """The built-in naive model, written as a user would; a class made here travels to the workers by value."""

    class LastValue:
        def fit(self, dates, units):
            self.last = units[-1]
            self.sigma = float(np.diff(units).std(ddof=1)) if len(units) > 2 else 0.0

        def predict(self, horizon):
            return np.full(horizon, self.last)

    return LastValue


def compared(df, names):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def test_python_model_equals_the_built_in_one(panel):
    own = {"Naive": models.naive, "Own": python_model("Own", last_value())}
    rows = backtest.backtest_predictions(panel, S, models=own)
    names = [c for c in rows.columns if c != "model"]
    a, b = (compared(rows.filter(F.col("model") == m), names) for m in own)
    assert a == b and len(a) == 2 * 3 * 7
    metrics = backtest.run_backtest(panel, S, models=own)
    assert {r["model"]: r["n"] for r in metrics.groupBy("model").agg(F.count("WAPE").alias("n")).collect()} == {"Naive": 6, "Own": 6}


def test_python_model_adds_no_shuffle(panel):
    state = models.series_state(panel, F.array(F.lit(AS_OF)), S)
    plan = python_model("Own", last_value())(state, 7, S)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroupsInArrow" in plan


def own_rows(spark, rows, make, **kw):
    sales = spark.createDataFrame(rows, "sku string, date date, units_sold double")
    state = models.series_state(sales, F.array(F.lit(AS_OF), F.lit(AS_OF + dt.timedelta(days=1))), S)
    return python_model("Own", make, **kw)(state, 3, S).orderBy("sku", "as_of", "step").collect()


def test_python_model_edges(spark):
    day = lambda i: dt.date(2025, 4, 21) + dt.timedelta(days=i)
    long = [("long", day(i), float(i)) for i in range(10)]

    LastValue = last_value()

    class Strict(LastValue):
        def fit(self, dates, units):
            assert (np.diff(dates) > np.timedelta64(0, "D")).all() and not np.isnan(units).any()
            if units[-1] == 77:
                raise CannotFit
            super().fit(dates, units)
            self.last = -5.0 if units[-1] == 9 else self.last

    rows = [*long, ("gap", day(0), 4.0), ("gap", day(1), None), ("declined", day(0), 77.0), ("unknown", day(0), None), ("later", day(20), 1.0)]
    got = own_rows(spark, rows, Strict)
    assert [(r["sku"], r["as_of"], r["step"], r["predicted_demand"]) for r in got] == [
        (sku, AS_OF + dt.timedelta(days=k), h, v) for sku, v in (("gap", 4.0), ("long", 0.0)) for k in (0, 1) for h in (1, 2, 3)
    ]
    assert got[0]["forecast_date"] == AS_OF and got[-1]["forecast_date"] == AS_OF + dt.timedelta(days=3)
    assert {r["sku"] for r in own_rows(spark, rows, Strict, min_days=5)} == {"long"}
    assert own_rows(spark, [], Strict) == []

    class Short(LastValue):
        def predict(self, horizon):
            return [1.0]

    class Infinite(LastValue):
        def predict(self, horizon):
            return [float("inf")] * horizon

    class Broken(LastValue):
        def fit(self, dates, units):
            raise KeyError("no such column")

    for make, said in ((Short, "expected 3 values"), (Infinite, "must be finite"), (Broken, "Own, long, 2025-05-01")):
        with pytest.raises(Exception, match=said):
            own_rows(spark, long, make)


# -- feeds ----------------------------------------------------------------------------------------


SCHEMA = "date date, sku string, units_sold string, ingest_seq bigint, promo int, extra string"


def drop(spark, folder, rows):
    spark.createDataFrame([(dt.date.fromisoformat(d) if d else None, *r, 0, "x") for d, *r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


DROPS = (
    [("2025-01-01", "a", "5", 1), ("2025-01-01", "a", "6", 2), ("2025-01-02", "b", "n/a", 3), ("2025-01-30", "b", "7", 4), (None, "a", "1", 5)],
    [("2025-01-30", "b", "8", 6), ("2025-02-01", "a", "-1", 7), ("2025-02-01", "a", "9", 8), ("2025-02-02", None, "1", 9)],
    [("2025-02-01", "a", "2", 0), ("2025-01-03", "c", "3", 11), ("2025-03-01", "c", "4", 12), ("2025-02-20", "c", None, 13)],
)


def kept(df):
    return sorted((str(r["date"]), r["sku"], r["units_sold"], r["ingest_seq"]) for r in df.collect())


def test_three_drops_equal_the_batch(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "db"))
    checkpoint, before = str(tmp_path / "done"), None
    for n, rows in enumerate(DROPS):
        drop(spark, inbox, rows)
        assert feed.take_in(feed.read_feed(spark, inbox, SCHEMA), store, checkpoint) == n + 1
        number, entries = store.manifest(feed.FEED)
        if n == 1:  # January and February are touched by the second drop, nothing else exists
            assert set(entries) == {"2025-01", "2025-02"}
        before = entries
    batch = keep_first(feed.feed_rows(spark.read.schema(SCHEMA).parquet(inbox)), "ingest_seq")
    want = kept(batch)
    assert kept(store.load_table(feed.FEED)) == want
    # The copy with the smallest number stays although it came last; a row two months late is taken.
    assert ("2025-02-01", "a", 2.0, 0) in want and ("2025-01-03", "c", 3.0, 11) in want and len(want) == 5
    # Nothing new: nothing happens.  The same batch once more, as after a failure: nothing changes.
    feed.take_in(feed.read_feed(spark, inbox, SCHEMA), store, checkpoint)
    assert store.manifest(feed.FEED)[1] == before
    feed.merge(spark.read.schema(SCHEMA).parquet(inbox), store)
    assert kept(store.load_table(feed.FEED)) == want


def test_an_empty_drop_and_a_clashing_column(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    empty = spark.createDataFrame([], SCHEMA)
    feed.merge(empty, store)
    assert store.tables() == []
    rows = spark.createDataFrame([(dt.date(2025, 1, 1), "a", "5", 1, "p")], "date date, sku string, units_sold string, ingest_seq bigint, part string")
    feed.merge(rows, store)
    assert kept(store.load_table(feed.FEED)) == [("2025-01-01", "a", 5.0, 1)]


def test_first_arrivals_within_the_lateness(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in DROPS:
        drop(spark, inbox, rows)
        once = feed.first_arrivals(feed.read_feed(spark, inbox, SCHEMA), "20 days")
        query = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "done")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(d, k) for d, k, *_ in kept(spark.read.parquet(out))]
    # January 3rd arrives after the watermark has passed it (January 12th by then); every other day stands once.
    assert got == [("2025-01-01", "a"), ("2025-01-30", "b"), ("2025-02-01", "a"), ("2025-03-01", "c")]


# -- the clustered panel --------------------------------------------------------------------------


def test_clustered_panel(spark, panel, tmp_path):
    path, columns = str(tmp_path / "panel"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = clustered.save_clustered(panel, "test_clustered", path, 4)
        names = panel.columns
        assert compared(clustered.between(held), names) == compared(panel, names)
        lagged = clustered.between(held).withColumns(features.lag_expressions(S))
        joined = lagged.join(clustered.between(held).groupBy("sku").agg(F.avg("units_sold").alias("mean")), "sku")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = panel.withColumns(features.lag_expressions(S)).join(panel.groupBy("sku").agg(F.avg("units_sold").alias("mean")), "sku")
        assert compared(joined, want.columns) == compared(want, want.columns)
        march = clustered.between(held, dt.date(2025, 3, 5), dt.date(2025, 4, 2))
        plan = march._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(panel_month" in plan and "GreaterThanOrEqual(date,2025-03-05)" in plan
        assert compared(march, names) == compared(panel.filter(F.col("date").between("2025-03-05", "2025-04-02")), names)
        spark.sql("DROP TABLE test_clustered")
        again = clustered.open_clustered(spark, "test_clustered", path, columns, 4)
        assert compared(clustered.between(again), names) == compared(panel, names)
        plan = clustered.between(again).withColumns(features.lag_expressions(S))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        with pytest.raises(Exception, match="already exists"):
            clustered.save_clustered(panel, "test_clustered", path, 4)
    finally:
        spark.sql("DROP TABLE IF EXISTS test_clustered")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- an ordering strategy of one's own ------------------------------------------------------------


def test_own_ordering_strategy(spark, panel):
    """Fill up to twice a fixed quantity on review days, for two quantities, beside nothing else."""
    from larder.plans import decisions
    from larder.sources.sales import economics

    start, end = dt.date(2025, 3, 3), dt.date(2025, 4, 6)
    skus = panel.select("sku", "shelf_life_days").distinct().withColumn("shelf_life_days", F.lit(60))
    terms_of = economics(skus, spark.createDataFrame([("Smooth", 1, 0)], "sku string, pack_size int, min_order_quantity int"), S)
    grid = F.array(*[F.struct(F.lit("Fill up").alias("strategy"), F.lit("quantity").alias("setting_name"), F.lit(v).alias("setting_value")) for v in (300.0, 800.0)])
    nothing = F.lit(None).cast("double")
    terms = skus.select("sku", F.explode(decisions.review_dates(start, end, S)).alias("date"), F.inline(grid)).select(
        "sku", "date", "strategy", "setting_name", "setting_value", (F.col("setting_value") * 2).alias("target"),
        nothing.alias("reorder_point"), nothing.alias("life_demand"), nothing.alias("most"))
    led = decisions.run_replay(panel, terms, terms_of, grid, start, end, S).cache()
    assert {(r[0], r[1]) for r in led.select("strategy", "setting_value").distinct().collect()} == {("Fill up", 300.0), ("Fill up", 800.0)}
    days = led.groupBy("setting_value", "sku").count().collect()
    assert len(days) == 4 and {r["count"] for r in days} == {35}
    # On a review day the stock before the day's sales and all orders under way reach the target, or exceed it and nothing is ordered.
    position = F.col("available_stock") + F.col("on_order")
    reviewed = led.filter("is_review_day = 1")
    assert reviewed.filter((F.col("recommended_order") > 0) & (F.abs(position - F.col("setting_value") * 2) > 1e-6)).count() == 0
    assert reviewed.filter((F.col("recommended_order") == 0) & (position < F.col("setting_value") * 2 - 1e-6)).count() == 0
    assert led.filter("is_review_day = 0 AND recommended_order > 0").count() == 0
    points = {r["setting_value"]: r["stockout_units"] for r in decisions.frontier(led, S).collect()}
    assert points[800.0] <= points[300.0] and led.filter("recommended_order > 0").count() > 4
