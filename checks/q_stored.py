"""The panel on clustered storage, feeds in drops, models of one's own."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from checks import panels as P
from checks.q_models import FORECAST_DOUBLES, Z, fold_state
from checks.registry import block, query, shared
from larder.operators import features, models, ordered, slices
from larder.operators.own import python_model
from larder.plans import decisions
from larder.sources import clustered, folder
from larder.sources.store import Store
from larder.streaming import feed

S = P.S


# -- the clustered panel ------------------------------------------------------------------------------


@shared
def held(spark, d):
    """The panel of all brands, written once in months and buckets."""
    return clustered.save_clustered(P.sales_brand(spark, d), f"panel_{uuid.uuid4().hex}", folder.fresh(spark), 8)


@query("a8_clustered_panel", "SELECT * FROM sales_brand", ["sales_brand"], dates=["date"], doubles=["units_sold", "temp_c"])
def a8(spark, d):
    return clustered.between(held(spark, d))


@query("a8_j1_clustered_features", "SELECT * FROM engineered", ["engineered"], dates=["date"], doubles=["units_sold", "temp_c", "lag7", "lag14", "roll28"])
def a8_features(spark, d):
    """Windows and the join of codes by SKU without a shuffle of the panel."""
    panel = clustered.between(held(spark, d))
    return features.engineer(panel, S, ordered.sku_codes(panel))


@query("a8_l12_clustered_opening", "SELECT sku, avg(units_sold) * 2 AS opening FROM dense_brand WHERE date < DATE '2001-01-01' AND date >= DATE '2001-01-01' - 28 GROUP BY 1",
       ["dense_brand"], doubles=["opening"])
def a8_opening(spark, d):
    """The scan opens the folders of two months."""
    return decisions.opening_stock(clustered.between(held(spark, d), P.START - timedelta(days=S.lookback_days), P.START), P.START, S)


@query("a8_j3_clustered_naive", "SELECT * FROM bt_forecast WHERE model = 'Naive'", ["bt_forecast"], dates=["as_of", "forecast_date"], doubles=FORECAST_DOUBLES)
def a8_naive(spark, d):
    panel = clustered.between(held(spark, d))
    state = models.series_state(panel, features.origin_array(slices.rolling_origins(panel, 12, 7)), S)
    return models.naive(state, 7, S)


# -- feeds --------------------------------------------------------------------------------------------

DROPS = 3


@shared
def taken(spark, d):
    """The raw feed in three drops, each an equal share of the order lines whatever their day, taken in one after the other."""
    inbox, store, done = folder.fresh(spark), Store(spark, folder.fresh(spark)), folder.fresh(spark)
    rows = P.feed(spark, d)
    for n in range(DROPS):
        # Later drops bring earlier copies of many days.
        rows.filter(F.pmod("ingest_seq", F.lit(DROPS)) == DROPS - 1 - n).write.mode("append").parquet(inbox)
        feed.take_in(feed.read_feed(spark, inbox, rows.schema), store, done)
    return store


FED = ["date", "sku", "units_sold", "ingest_seq", "shelf_life_days", "promo"]


@query("b12_b13_feed_in_drops", "SELECT date, sku, units_sold, ingest_seq, shelf_life_days, CAST(promo AS INTEGER) AS promo FROM feed_first", ["feed_first"],
       dates=["date"], doubles=["units_sold"])
def fed(spark, d):
    return taken(spark, d).load_table(feed.FEED).select(*FED)


# -- a model of one's own -----------------------------------------------------------------------------


def month_mean():
    """Mean and spread of the last 28 days, as a class without Spark."""
    import numpy as np

    class MonthMean:
        def fit(self, dates, units):
            self.mean, self.sigma = float(np.mean(units[-28:])), float(np.std(units[-28:], ddof=1))

        def predict(self, horizon):
            return np.full(horizon, self.mean)

    return MonthMean


block("own_state", """SELECT origin, sku, avg(u) AS mean, stddev_samp(u) AS sd FROM (SELECT o.origin, r.sku, r.u, row_number() OVER (PARTITION BY o.origin, r.sku ORDER BY r.date DESC) AS rn
 FROM bt_rows r JOIN bt_origins o ON r.date < o.origin) WHERE rn <= 28 GROUP BY 1, 2 HAVING count(*) = 28""", "bt_rows", "bt_origins")


@query("u1_python_model", f"""SELECT o.origin AS as_of, o.sku, CAST(h AS INTEGER) AS step, o.origin + CAST(h - 1 AS INTEGER) AS forecast_date, o.mean AS predicted_demand,
 greatest(o.mean - {Z!r} * o.sd * sqrt(h), 0) AS lower_bound, o.mean + {Z!r} * o.sd * sqrt(h) AS upper_bound, o.sd AS sigma, 'Month mean' AS model, s.scale AS mase_scale
 FROM own_state o JOIN bt_state s USING (origin, sku), unnest(generate_series(1, 7)) AS t(h)""", ["own_state", "bt_state"], dates=["as_of", "forecast_date"], doubles=FORECAST_DOUBLES)
def u1(spark, d):
    return python_model("Month mean", month_mean(), min_days=28)(fold_state(spark, d), 7, S)
