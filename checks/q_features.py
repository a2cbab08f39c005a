"""D, E1-E2, E17-E23, F, I11-I12, I30, I32, J1-J2: joins, windows and features."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import panels as P
from checks.registry import block, query
from larder.functions import normal, stock
from larder.functions.accuracy import spread, zero_share
from larder.operators import features, kpi, models, ordered, segments, slices
from larder.plans import backtest, decisions
from larder.sources.sales import gaussian

S = P.S
A = "DATE '2001-07-02'"

block("codes_brand", "SELECT sku, CAST(row_number() OVER (ORDER BY sku) - 1 AS INTEGER) AS sku_code FROM (SELECT DISTINCT sku FROM daily_brand)", "daily_brand")
block("engineered", f"""SELECT s.* EXCLUDE (weekend, dow, bank_holiday, school_holiday), c.*  EXCLUDE (date),
 lag(units_sold, 7) OVER w AS lag7, lag(units_sold, 14) OVER w AS lag14,
 CASE WHEN count(units_sold) OVER r = 28 THEN avg(units_sold) OVER r END AS roll28, k.sku_code
 FROM sales_brand s JOIN calendar c USING (date) JOIN codes_brand k USING (sku)
 WINDOW w AS (PARTITION BY sku ORDER BY date), r AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""",
      "sales_brand", "calendar", "codes_brand")


@query("i32_sku_codes", "SELECT * FROM codes_brand", ["codes_brand"])
def i32(spark, d):
    return ordered.sku_codes(P.daily_brand(spark, d))


@query("j1_d1_f1_f2_engineered_features", "SELECT * FROM engineered", ["engineered"], dates=["date"],
       doubles=["units_sold", "temp_c", "lag7", "lag14", "roll28"])
def j1(spark, d):
    return features.engineer(P.sales_brand(spark, d), S)


FM = features.feature_columns(S)


@query("c14_feature_matrix", f"SELECT sku, date, units_sold, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FM)} FROM engineered WHERE roll28 IS NOT NULL AND lag14 IS NOT NULL",
       ["engineered"], dates=["date"], doubles=["units_sold", "temp_c", "lag7", "lag14", "roll28"])
def c14(spark, d):
    return features.feature_matrix(features.engineer(P.sales_brand(spark, d), S), S)


@query("f1_lags", """SELECT sku, date, lag(units_sold, 7) OVER w AS lag7, lag(units_sold, 14) OVER w AS lag14 FROM dense_brand
 WINDOW w AS (PARTITION BY sku ORDER BY date)""", ["dense_brand"], dates=["date"], doubles=["lag7", "lag14"])
def f1(spark, d):
    return P.dense(P.daily_brand(spark, d)).select("sku", "date", *[c.alias(n) for n, c in features.lag_expressions(S).items()])


@query("f2_rolling_mean", """SELECT sku, date, CASE WHEN count(*) OVER r = 28 THEN avg(units_sold) OVER r END AS roll28 FROM dense_brand
 WINDOW r AS (PARTITION BY sku ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""", ["dense_brand"], dates=["date"], doubles=["roll28"])
def f2(spark, d):
    return P.dense(P.daily_brand(spark, d)).select("sku", "date", features.rolling_mean(28).alias("roll28"))


block("month_origins", "SELECT CAST(m AS DATE) AS origin FROM unnest(generate_series(DATE '2001-01-01', DATE '2001-09-01', INTERVAL 1 MONTH)) AS t(m)")


def month_origins():
    return F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2001-09-01").cast("date"), F.expr("INTERVAL 1 MONTH"))


@query("f3_frozen_rolling_mean", """SELECT origin AS as_of, sku, CASE WHEN count(*) = 28 THEN avg(units_sold) END AS roll28 FROM (
 SELECT o.origin, s.sku, s.units_sold, row_number() OVER (PARTITION BY o.origin, s.sku ORDER BY s.date DESC) AS rn
 FROM daily_brand s JOIN month_origins o ON s.date < o.origin) WHERE rn <= 28 GROUP BY 1, 2""", ["daily_brand", "month_origins"],
       dates=["as_of"], doubles=["roll28"])
def f3(spark, d):
    frame = features.with_cuts(P.daily_brand(spark, d), month_origins()).withColumn("roll28", features.rolling_mean(28, upto=0))
    return frame.filter(F.size("cuts") > 0).select(F.explode("cuts").alias("as_of"), "sku", "roll28")


block("future", f"""SELECT o.origin AS as_of, k.sku, CAST(h AS INTEGER) AS step, o.origin + CAST(h - 1 AS INTEGER) AS forecast_date
 FROM month_origins o, (SELECT DISTINCT sku FROM daily_brand WHERE date < DATE '2001-01-01') k, unnest(generate_series(1, 14)) AS t(h)""", "month_origins", "daily_brand")


def lag_sql(k: int) -> str:
    return f"""coalesce((SELECT any_value(units_sold) FROM daily_brand s WHERE s.sku = f.sku AND s.date = f.forecast_date - {k} AND s.date < f.as_of),
 (SELECT arg_max(units_sold, date) FROM daily_brand s WHERE s.sku = f.sku AND s.date < f.as_of AND isodow(s.date) = isodow(f.forecast_date - {k})),
 (SELECT arg_max(units_sold, date) FROM daily_brand s WHERE s.sku = f.sku AND s.date < f.as_of)) AS lag{k}"""


@query("d4_lag_lookup", f"SELECT f.*, {lag_sql(7)}, {lag_sql(14)} FROM future f", ["future", "daily_brand"], dates=["as_of", "forecast_date"], doubles=["lag7", "lag14"])
def d4(spark, d):
    rows = features.future_features(P.enrich(P.daily_brand(spark, d)), month_origins(), 14, S)
    return rows.select("as_of", "sku", "step", "forecast_date", "lag7", "lag14")


block("obs_brand", P.enrich_sql("daily_brand"), "daily_brand")


@query("j2_future_features", f"""SELECT f.*, {lag_sql(7)}, {lag_sql(14)}, r.roll28,
 CAST(isodow(f.forecast_date) - 1 AS INTEGER) AS dow, CASE WHEN isodow(f.forecast_date) >= 5 THEN 1 ELSE 0 END AS weekend,
 CASE WHEN f.forecast_date IN ({P.H_SQL}) THEN 1 ELSE 0 END AS bank_holiday, {P.SCHOOL_SQL.format(d='f.forecast_date')} AS school_holiday,
 CAST(weekofyear(f.forecast_date) AS INTEGER) AS week_of_year, CAST(month(f.forecast_date) AS INTEGER) AS month,
 CASE WHEN f.forecast_date IN ({P.C_SQL}) THEN 1 ELSE 0 END AS is_closed,
 coalesce(w.temp_c, (SELECT avg(temp_c) FROM (SELECT date, min(temp_c) AS temp_c FROM obs_brand GROUP BY date) x WHERE x.date < f.as_of)) AS temp_c,
 coalesce(p.promo, 0) AS promo, k.sku_code, f.forecast_date AS date
 FROM future f LEFT JOIN (SELECT as_of, sku, CASE WHEN count(*) = 28 THEN avg(units_sold) END AS roll28 FROM (
 SELECT o.origin AS as_of, s.sku, s.units_sold, row_number() OVER (PARTITION BY o.origin, s.sku ORDER BY s.date DESC) AS rn
 FROM daily_brand s JOIN month_origins o ON s.date < o.origin) WHERE rn <= 28 GROUP BY 1, 2) r ON r.as_of = f.as_of AND r.sku = f.sku
 LEFT JOIN (SELECT date, min(temp_c) AS temp_c FROM obs_brand GROUP BY date) w ON w.date = f.forecast_date
 LEFT JOIN obs_brand p ON p.sku = f.sku AND p.date = f.forecast_date JOIN codes_brand k ON k.sku = f.sku""",
       ["future", "obs_brand", "codes_brand", "month_origins"], dates=["as_of", "forecast_date", "date"], doubles=["lag7", "lag14", "roll28", "temp_c"])
def j2(spark, d):
    return features.future_features(P.enrich(P.daily_brand(spark, d)), month_origins(), 14, S)


@query("d2_temperature_known", """SELECT o.origin AS as_of, o.origin + CAST(h AS INTEGER) AS forecast_date, coalesce(w.temp_c,
 (SELECT avg(temp_c) FROM (SELECT date, min(temp_c) AS temp_c FROM gappy_type GROUP BY date) x WHERE x.date < o.origin)) AS temp_c
 FROM (SELECT origin FROM month_origins UNION SELECT DATE '2001-11-01') o, unnest(generate_series(0, 9)) AS t(h)
 LEFT JOIN (SELECT date, min(temp_c) AS temp_c FROM gappy_type GROUP BY date) w ON w.date = o.origin + CAST(h AS INTEGER)""",
       ["gappy_type", "month_origins"], dates=["as_of", "forecast_date"], doubles=["temp_c"])
def d2(spark, d):
    sales = P.gappy_type(spark, d)
    starts = F.concat(month_origins(), F.array(F.lit("2001-11-01").cast("date")))
    decisions_ = sales.select("date").distinct().filter(F.array_contains(starts, F.col("date"))).select(F.col("date").alias("as_of"))
    rows = slices.horizon_rows(decisions_, 10)
    return features.with_temperature(rows, features.weather_series(sales), S).select("as_of", "forecast_date", "temp_c")


@query("i30_noise_sd", """SELECT date, CAST(h AS INTEGER) AS lead, CASE WHEN h = 0 THEN 0.0 ELSE 1.2 + 0.35 * greatest(h - 1, 0) END AS sd
 FROM (SELECT DISTINCT date FROM daily_type), unnest(generate_series(0, 13)) AS t(h)""", ["daily_type"], dates=["date"], doubles=["sd"])
def i30(spark, d):
    noisy = S.but(perfect_foresight=False)
    rows = P.daily_type(spark, d).select("date").distinct().select("date", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("lead"))
    return rows.withColumn("sd", features.noise_sd("date", F.date_add("date", F.col("lead")), noisy))


@query("i30_weather_noise")
def i30b(spark, d):
    """Noisy temperature forecasts: the draw depends on (seed, decision, day) only."""
    noisy = S.but(perfect_foresight=False)
    rows = P.daily_type(spark, d).select(F.col("date").alias("as_of")).distinct()
    rows = slices.horizon_rows(rows, 7)
    return features.with_temperature(rows, features.weather_series(P.gappy_type(spark, d)), noisy)


@query("i30_noise_moments", "SELECT true AS mean_near_zero, true AS sd_near_one FROM (SELECT count(*) FROM lineitem)")
def i30c(spark, d):
    """Keyed normal draws over every order line have the right mean and spread."""
    g = gaussian(7, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return P.table(spark, d, "lineitem").select(g.alias("g")).agg(
        (F.abs(F.avg("g")) < 0.05).alias("mean_near_zero"), (F.abs(F.stddev_samp("g") - 1) < 0.05).alias("sd_near_one"))


@query("d3_planned_promotions", """SELECT g.sku, g.date, coalesce(p.promo, 0) AS promo FROM dense_type g LEFT JOIN gappy_type p ON p.sku = g.sku AND p.date = g.date""",
       ["dense_type", "gappy_type"], dates=["date"])
def d3(spark, d):
    grid, plan = P.dense(P.daily_type(spark, d)).select("sku", "date"), P.gappy_type(spark, d).select("sku", "date", "promo")
    return grid.join(plan, ["sku", "date"], "left").withColumn("promo", F.coalesce("promo", F.lit(0)))


@query("d5_economics_join", "SELECT s.sku, s.date, s.units_sold * e.unit_cost AS value FROM daily_brand s JOIN econ_brand e USING (sku)",
       ["daily_brand", "econ_brand"], dates=["date"], doubles=["value"])
def d5(spark, d):
    joined = P.daily_brand(spark, d).join(P.econ(spark, d), "sku")
    return joined.select("sku", "date", (F.col("units_sold") * F.col("unit_cost")).alias("value"))


@query("d6_cost_or_default", """SELECT s.sku, sum(s.units_sold) * coalesce(max(t.unit_cost), 1.0) AS value FROM daily_brand s LEFT JOIN terms_brand t USING (sku) GROUP BY s.sku""",
       ["daily_brand", "terms_brand"], doubles=["value"])
def d6(spark, d):
    units = P.daily_brand(spark, d).groupBy("sku").agg(F.sum("units_sold").alias("u"))
    joined = units.join(P.terms(spark, d), "sku", "left")
    return joined.select("sku", (F.col("u") * F.coalesce("unit_cost", F.lit(S.default_unit_cost))).alias("value"))


@query("d12_demand_or_zero", "SELECT * FROM dense_type", ["dense_type"], dates=["date"], doubles=["units_sold"])
def d12(spark, d):
    return P.dense(P.daily_type(spark, d))


@query("d15_stock_or_zero", """SELECT k.sku, greatest(coalesce(a.units_sold - 40, 0.0), 0.0) AS on_hand FROM (SELECT DISTINCT sku FROM daily_brand) k
 LEFT JOIN (SELECT * FROM daily_brand WHERE date = DATE '2001-07-01') a USING (sku)""", ["daily_brand"], doubles=["on_hand"])
def d15(spark, d):
    sales = P.daily_brand(spark, d)
    stock_rows = sales.filter(F.col("date") == F.lit("2001-07-01").cast("date")).select("sku", (F.col("units_sold") - 40).alias("on_hand"))
    joined = sales.select("sku").distinct().join(stock_rows, "sku", "left")
    return joined.select("sku", F.greatest(F.coalesce("on_hand", F.lit(0.0)), F.lit(0.0)).alias("on_hand"))


@query("d16_chosen_skus", "SELECT sku, count(*) AS days FROM daily_brand WHERE sku IN (SELECT sku FROM terms_brand) GROUP BY sku", ["daily_brand", "terms_brand"])
def d16(spark, d):
    kept = P.daily_brand(spark, d).join(P.terms(spark, d).select("sku"), "sku", "left_semi")
    return kept.groupBy("sku").agg(F.count(F.lit(1)).alias("days"))


# -- E and F over panels --------------------------------------------------------------------------------


@query("e1_zero_share", "SELECT sku, avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM dense_brand GROUP BY sku", ["dense_brand"], doubles=["zero_share"])
def e1(spark, d):
    return P.dense(P.daily_brand(spark, d)).groupBy("sku").agg(zero_share("units_sold").alias("zero_share"))


@query("e2_sku_statistics", """SELECT sku, sum(units_sold) AS total_units, avg(units_sold) AS mean_daily_demand, coalesce(stddev_samp(units_sold), 0) AS std_daily_demand,
 avg(CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END) AS zero_day_share, count(*) AS n_observations FROM dense_brand GROUP BY sku""", ["dense_brand"],
       doubles=["total_units", "mean_daily_demand", "std_daily_demand", "zero_day_share"])
def e2(spark, d):
    return segments.sku_statistics(P.dense(P.daily_brand(spark, d)))


@query("e17_weekday_means", """SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, sum(units_sold) / count(DISTINCT date) AS mean_units FROM daily_brand GROUP BY 1""",
       ["daily_brand"], doubles=["mean_units"])
def e17(spark, d):
    return backtest.weekday_means(P.daily_brand(spark, d))


@query("e18_holiday_uplift", f"""SELECT *, 100 * (holiday_mean - normal_mean) / normal_mean AS uplift_pct FROM (SELECT
 avg(u) FILTER (date IN ({P.H_SQL}) AND date NOT IN ({P.C_SQL})) AS holiday_mean, avg(u) FILTER (date NOT IN ({P.H_SQL})) AS normal_mean
 FROM (SELECT date, sum(units_sold) AS u FROM daily_brand GROUP BY date))""", ["daily_brand"], doubles=["holiday_mean", "normal_mean", "uplift_pct"])
def e18(spark, d):
    return backtest.holiday_uplift(P.daily_brand(spark, d), S)


@query("e22_residual_spread", """SELECT sku, coalesce(stddev_samp(r), 0) AS sigma FROM (SELECT sku, units_sold - lag(units_sold) OVER (PARTITION BY sku ORDER BY date) AS r
 FROM dense_brand) GROUP BY sku""", ["dense_brand"], doubles=["sigma"])
def e22(spark, d):
    diff = F.col("units_sold") - F.lag("units_sold").over(features.by_day())
    return P.dense(P.daily_brand(spark, d)).withColumn("r", diff).groupBy("sku").agg(spread("r").alias("sigma"))


@query("e23_demand_volatility", """SELECT sku, stddev_samp(r) / sqrt(2) AS volatility FROM (SELECT sku, units_sold - lag(units_sold, 7) OVER (PARTITION BY sku ORDER BY date) AS r
 FROM dense_brand) GROUP BY sku""", ["dense_brand"], doubles=["volatility"])
def e23(spark, d):
    return features.demand_volatility(P.dense(P.daily_brand(spark, d)), S)


@query("f4_first_difference", "SELECT sku, date, units_sold - lag(units_sold) OVER (PARTITION BY sku ORDER BY date) AS diff FROM dense_type", ["dense_type"],
       dates=["date"], doubles=["diff"])
def f4(spark, d):
    return P.dense(P.daily_type(spark, d)).select("sku", "date", (F.col("units_sold") - F.lag("units_sold").over(features.by_day())).alias("diff"))


@query("f5_seasonal_difference", "SELECT sku, date, units_sold - lag(units_sold, 7) OVER (PARTITION BY sku ORDER BY date) AS diff FROM dense_type", ["dense_type"],
       dates=["date"], doubles=["diff"])
def f5(spark, d):
    return P.dense(P.daily_type(spark, d)).select("sku", "date", (F.col("units_sold") - F.lag("units_sold", 7).over(features.by_day())).alias("diff"))


@query("f6_value_ranking", """SELECT sku, row_number() OVER w AS position, sum(v) OVER w AS value_so_far FROM (SELECT p_name || p_partkey AS sku, sum(l_extendedprice) AS v
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WINDOW w AS (ORDER BY v DESC, sku ROWS UNBOUNDED PRECEDING)""", doubles=["value_so_far"])
def f6(spark, d):
    li, part = P.table(spark, d, "lineitem"), P.table(spark, d, "part")
    v = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.concat("p_name", F.col("p_partkey").cast("string")).alias("sku"))
    # Prices are decimals held as doubles: decimal sums don't depend on the order of rows, and equal values stay equal.
    v = v.agg(F.sum(F.col("l_extendedprice").cast("decimal(28,10)")).alias("v"))
    ranked = ordered.running(v, [-F.col("v"), F.col("sku")], {"value_so_far": F.col("v")})
    return ranked.select("sku", "position", F.col("value_so_far").cast("double").alias("value_so_far"))


@query("f7_trailing_mean", """SELECT date, avg(units) OVER (ORDER BY date ROWS 6 PRECEDING) AS units_mean, units FROM (SELECT date, sum(units_sold) AS units FROM daily_brand GROUP BY date)""",
       ["daily_brand"], dates=["date"], doubles=["units", "units_mean"])
def f7(spark, d):
    return kpi.trailing_mean(P.daily_brand(spark, d).groupBy("date").agg(F.sum("units_sold").alias("units")), "units", ())


@query("f8_centred_mean", """SELECT date, units, CASE WHEN count(*) OVER w = 7 THEN avg(units) OVER w END AS units_mean FROM (SELECT date, sum(units_sold) AS units FROM daily_brand GROUP BY date)
 WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", ["daily_brand"], dates=["date"], doubles=["units", "units_mean"])
def f8(spark, d):
    return kpi.centred_mean(P.daily_brand(spark, d).groupBy("date").agg(F.sum("units_sold").alias("units")), "units")


block("usage", """SELECT o.origin AS as_of, s.sku, coalesce(avg(units_sold) FILTER (s.date >= o.origin - 28), avg(units_sold)) AS usage
 FROM daily_brand s JOIN month_origins o ON s.date < o.origin GROUP BY 1, 2""", "daily_brand", "month_origins")


@query("f9_f10_trailing_usage", "SELECT * FROM usage", ["usage"], dates=["as_of"], doubles=["usage"])
def f9(spark, d):
    return features.trailing_usage(P.daily_brand(spark, d), month_origins(), 28)


@query("f11_interval_steps", """SELECT sku, date, CAST(date_diff('day', DATE '2001-07-02', date) + 1 AS INTEGER) AS step, 1.6448536269514722 * sqrt(date_diff('day', DATE '2001-07-02', date) + 1) AS width
 FROM daily_type WHERE date >= DATE '2001-07-02'""", ["daily_type"], dates=["date"], doubles=["width"])
def f11(spark, d):
    step = F.datediff("date", F.lit(P.AS_OF)) + 1
    rows = P.daily_type(spark, d).filter(F.col("date") >= F.lit(P.AS_OF)).select("sku", "date", step.alias("step"))
    return rows.withColumn("width", models.interval_z(S) * F.sqrt(F.col("step").cast("double")))


# -- I11, I12: normal curves ----------------------------------------------------------------------------


def horner(x: str, coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def quantile_sql(p: str) -> str:
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    frac = lambda x, pair: f"{horner(x, pair[0])} / {horner(x, pair[1])}"
    mid = f"{q} * " + frac(f"(0.180625 - {q} * {q})", normal.QUANTILE_MID)
    tail, far = frac(f"({r} - 1.6)", normal.QUANTILE_TAIL), frac(f"({r} - 5.0)", normal.QUANTILE_FAR)
    return f"CASE WHEN abs({q}) <= 0.425 THEN {mid} ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {tail} ELSE {far} END END"


def cdf_sql(x: str) -> str:
    """Power series of the normal distribution function; independent of the rational form in Spark."""
    term = f"exp((2 * k + 1) * ln(abs({x})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    half = f"exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 220), lambda k: {term}))"
    return f"CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 9 THEN 1.0 WHEN {x} < -9 THEN 0.0 ELSE 0.5 + sign({x}) * {half} END"


@query("i11_normal_quantile", f"""SELECT sku, date, {quantile_sql('p')} AS z FROM (SELECT sku, date, (units_sold + 1) / (units_sold + 2 + length(sku) * 10) AS p FROM daily_brand)""",
       ["daily_brand"], dates=["date"], doubles=["z"])
def i11(spark, d):
    p = (F.col("units_sold") + 1) / (F.col("units_sold") + 2 + F.length("sku") * 10)
    return P.daily_brand(spark, d).select("sku", "date", normal.normal_quantile(p).alias("z"))


@query("i12_normal_cdf", f"SELECT sku, date, {cdf_sql('x')} AS p FROM (SELECT sku, date, (units_sold - 60) / 15 AS x FROM daily_brand)", ["daily_brand"],
       dates=["date"], doubles=["p"])
def i12(spark, d):
    return P.daily_brand(spark, d).select("sku", "date", normal.normal_cdf((F.col("units_sold") - 60) / 15).alias("p"))


@query("i12_stockout_probability", f"""SELECT sku, date, CASE WHEN sd <= 0 THEN CASE WHEN pos < 50 THEN 1.0 ELSE 0.0 END ELSE 1 - ({cdf_sql('((pos - 50) / sd)')}) END AS p
 FROM (SELECT sku, date, units_sold AS pos, (length(sku) - 7) * 10 * sqrt(4) AS sd FROM daily_brand)""", ["daily_brand"], dates=["date"], doubles=["p"])
def i12b(spark, d):
    sigma = (F.length("sku") - 7) * 10.0
    return P.daily_brand(spark, d).select("sku", "date", stock.stockout_probability("units_sold", F.lit(50.0), sigma, F.lit(4)).alias("p"))
