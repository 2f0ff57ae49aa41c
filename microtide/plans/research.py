"""Queries of research reductions: unit-root tests, rescaled range, autoregressions, depth and distribution fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from microtide.operators import bars, importance, joins, joint_hmm, regression
from microtide.plans.market import BAR, HOURLY, TICK, hourly, r, ticks
from microtide.plans.market import T as TICKS
from microtide.plans.market import W
from microtide.plans.registry import query

#: The Dickey-Fuller regression with one lagged change in closed form, over rows q (key columns, dx, v, d1).
ADF1 = """SELECT {keys}, count(*) AS n, var_pop(dx) AS y, var_pop(v) AS a, var_pop(d1) AS b, covar_pop(v, d1) AS ab, covar_pop(v, dx) AS ay, covar_pop(d1, dx) AS by_
  FROM q WHERE dx IS NOT NULL AND v IS NOT NULL AND d1 IS NOT NULL GROUP BY {keys}"""
SOLVED = """SELECT *, (ay * b - by_ * ab) / (a * b - ab * ab) AS gamma, (by_ * a - ay * ab) / (a * b - ab * ab) AS delta FROM g WHERE n > 3"""
STAT = "gamma / sqrt((y - gamma * ay - delta * by_) / (n - 3) * b / (a * b - ab * ab))"


@query(TICKS + f""", q0 AS (SELECT symbol, day, ts_us, event_id, price AS v0, price - lag(price) OVER ({W}) AS dx, lag(price) OVER ({W}) AS v FROM t), q AS (SELECT *, lag(dx) OVER ({W}) AS d1 FROM q0),
  g AS ({ADF1.format(keys='symbol, day')}), s AS ({SOLVED})
  SELECT symbol, day, n, round(gamma, 6) AS gamma, round({STAT}, 5) AS adf_stat, {STAT} < -2.86154 AS stationary FROM s""")
def adf_sessions(spark, d):
    out = regression.adf(ticks(spark, d), ["symbol", "day"], TICK.order, "price", 1).where("n > 3")
    return out.select("symbol", "day", "n", r("gamma").alias("gamma"), r("adf_stat", 5).alias("adf_stat"), "stationary")


@query(TICKS + HOURLY + f""", p AS (SELECT x.symbol AS a_, y.symbol AS b_, x.bar_ts, x.close AS va, y.close AS vb FROM b x JOIN b y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol),
  h AS (SELECT a_, b_, regr_slope(va, vb) AS hedge_ratio FROM p GROUP BY 1, 2),
  z AS (SELECT p.a_, p.b_, bar_ts, hedge_ratio, va - hedge_ratio * vb AS s FROM p JOIN h ON p.a_ = h.a_ AND p.b_ = h.b_),
  q0 AS (SELECT *, s - lag(s) OVER o AS dx, lag(s) OVER o AS v FROM z WINDOW o AS (PARTITION BY a_, b_ ORDER BY bar_ts)), q AS (SELECT *, lag(dx) OVER (PARTITION BY a_, b_ ORDER BY bar_ts) AS d1 FROM q0),
  g AS ({ADF1.format(keys='a_, b_, hedge_ratio')}), s AS ({SOLVED})
  SELECT a_ AS a, b_ AS b, round(hedge_ratio, 6) AS hedge_ratio, n, round({STAT}, 5) AS adf_stat, {STAT} < -2.86154 AS stationary FROM s""")
def cointegration(spark, d):
    p = joins.align_pairs(hourly(spark, d), "symbol", "bar_ts", "close")
    out = regression.engle_granger(p, ["a", "b"], ["bar_ts"], "value_a", "value_b", 1)
    return out.select("a", "b", r("hedge_ratio").alias("hedge_ratio"), "n", r("adf_stat", 5).alias("adf_stat"), "stationary")


@query()
def adf_by_aic(spark, d):
    out = regression.adf(ticks(spark, d), ["symbol", "day"], TICK.order, "price", 4, by_aic=True)
    return out.select("symbol", "day", "n", "lags", r("gamma").alias("gamma"), r("adf_stat", 5).alias("adf_stat"), "stationary")


@query(TICKS + f""", x AS (SELECT symbol, day, price, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol, day) AS n FROM t), l AS (SELECT x.*, lag, i // lag AS blk FROM x, range(2, 20) l(lag) WHERE n >= 40 AND (i // lag + 1) * lag <= n),
  m AS (SELECT symbol, day, lag, blk, avg(price) AS mu, stddev_pop(price) AS sd FROM l GROUP BY 1, 2, 3, 4),
  c AS (SELECT l.symbol, l.day, l.lag, l.blk, sd, sum(price - mu) OVER (PARTITION BY l.symbol, l.day, l.lag, l.blk ORDER BY i) AS dev FROM l JOIN m ON l.symbol = m.symbol AND l.day = m.day AND l.lag = m.lag AND l.blk = m.blk),
  r AS (SELECT symbol, day, lag, blk, (max(dev) - min(dev)) / any_value(sd) AS rs FROM c WHERE sd > 1e-12 GROUP BY 1, 2, 3, 4), a AS (SELECT symbol, day, lag, avg(rs) AS rs FROM r GROUP BY 1, 2, 3 HAVING avg(rs) > 0),
  f AS (SELECT symbol, day, count(*) AS lags, regr_slope(ln(rs), ln(lag)) AS h FROM a GROUP BY 1, 2), s AS (SELECT symbol, day, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT s.symbol, s.day, n, coalesce(lags, 0) AS lags, CASE WHEN lags >= 5 THEN round(h, 6) END AS hurst FROM s LEFT JOIN f ON s.symbol = f.symbol AND s.day = f.day""")
def hurst_exponent(spark, d):
    """Sessions of 40 ticks at least; the operator's default lags go to 100, as in sessions of one-second bars."""
    out = regression.hurst(ticks(spark, d), ["symbol", "day"], TICK.order, "price", 2, 20)
    return out.select("symbol", "day", "n", "lags", r("hurst").alias("hurst"))


@query()
def rolling_ar5(spark, d):
    out = regression.rolling_ar(ticks(spark, d).withColumn("ret", TICK.diff("price")), TICK, "ret", 40, 5, 20)
    return out.select("event_id", *[r(f"phi{k}").alias(f"ar5_phi{k}") for k in range(1, 6)])


@query(TICKS + f""", g AS (SELECT symbol, (ts_us - lag(ts_us) OVER ({W})) / 1e6 AS gap FROM t), p AS (SELECT * FROM g WHERE gap > 0), m AS (SELECT symbol, count(*) AS n, avg(gap) AS mu FROM p GROUP BY 1),
  f AS (SELECT p.symbol, n, mu, 1 - exp(-gap / mu) AS f, row_number() OVER (PARTITION BY p.symbol ORDER BY gap) AS k FROM p JOIN m ON p.symbol = m.symbol)
  SELECT symbol, n, round(any_value(mu), 6) AS mean_gap, round(max(greatest(k / n - f, f - (k - 1) / n)), 7) AS ks FROM f GROUP BY 1, 2""")
def interarrival_ks(spark, d):
    g = ticks(spark, d).select("symbol", (TICK.diff("ts_us") / 1e6).alias("gap"))
    out = regression.exponential_ks(g, ["symbol"], "gap")
    return out.select("symbol", "n", r("mean").alias("mean_gap"), r("ks", 7).alias("ks"))


@query()
def smallest_stationary_d(spark, d):
    out = regression.minimum_d(ticks(spark, d), ["symbol", "day"], TICK.order, "price", threshold=1e-2)
    return out.select("symbol", "day", "d", r("adf_stat", 4).alias("adf_stat"), r("corr", 4).alias("corr"), "n")


@query(TICKS + """, l AS (SELECT event_id, i, i * 0.5e0 * (1 + qty % 3) AS away, price, (qty * (i + 3)) % 50 AS q FROM t, range(5) r(i)), k AS (SELECT event_id, ln(q) AS y, CASE WHEN i = 0 THEN 0.05e0 ELSE away END AS x FROM l WHERE q > 0 AND price - away > 0),
  f AS (SELECT event_id, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k GROUP BY 1)
  SELECT t.event_id, round(CASE WHEN n >= 2 THEN exp(a) ELSE 140.0 END, 5) AS a, round(CASE WHEN n >= 2 THEN greatest(0.1, -b) ELSE 1.5 END, 6) AS kappa FROM t LEFT JOIN f ON t.event_id = f.event_id""")
def depth_decay_fit(spark, d):
    t = ticks(spark, d)
    levels = F.sequence(F.lit(0), F.lit(4))
    prices = F.transform(levels, lambda i: F.col("price") - i * 0.5 * (1 + F.col("qty") % 3))
    quantities = F.transform(levels, lambda i: (F.col("qty") * (i + 3)) % 50)
    t = t.select("event_id", F.explode(F.array(regression.depth_fit(prices, quantities, 0.05, (140.0, 1.5)))).alias("fit"))
    return t.select("event_id", r("fit.a", 5).alias("a"), r("fit.kappa").alias("kappa"))


@query(TICKS + HOURLY + """, l AS (SELECT symbol, day, bar_ts AS s, lead(bar_ts, 3) OVER (PARTITION BY symbol, day ORDER BY bar_ts) AS e FROM b), i AS (SELECT * FROM l WHERE e IS NOT NULL),
  c AS (SELECT b.symbol, b.day, b.bar_ts, count(*) AS live FROM b JOIN i ON b.symbol = i.symbol AND b.day = i.day AND b.bar_ts BETWEEN i.s AND i.e GROUP BY 1, 2, 3)
  SELECT i.symbol, i.s AS bar_ts, round(avg(1 / live), 6) AS uniqueness FROM i JOIN c ON c.symbol = i.symbol AND c.day = i.day AND c.bar_ts BETWEEN i.s AND i.e GROUP BY 1, 2""")
def label_uniqueness(spark, d):
    b = hourly(spark, d).select("symbol", "day", "bar_ts")
    labels = b.select("symbol", "day", F.col("bar_ts").alias("s"), BAR.lead("bar_ts", 3).alias("e")).where("e is not null")
    out = importance.uniqueness(labels, b, ["symbol", "day"], "bar_ts", "s", "e")
    return out.select("symbol", F.col("s").alias("bar_ts"), r("uniqueness").alias("uniqueness"))


@query()
def joint_regimes(spark, d):
    """Three regimes of half-hours by their number of ticks and their return, filtered session by session."""
    t = ticks(spark, d)
    b = bars.time_bars(t, ["symbol", "day"], "ts_sec", TICK.order, "price", "qty", 1800)
    g = bars.regularize(b, ["symbol", "day"], "bar_ts", 1800, ["close"], ["tick_count"])
    g = g.withColumns({"cat": F.least(F.col("tick_count"), F.lit(3)).cast("int"), "x_bp": 100 * F.log(F.col("close") / BAR.lag("close"))})
    model = joint_hmm.fit(g, ["symbol", "day"], ["bar_ts"], "cat", "x_bp", k=3, starts=1, rounds=10)
    out = joint_hmm.apply(g, model, ["symbol", "day"], "bar_ts", "cat", "x_bp", 21_600)
    return out.select("symbol", "bar_ts", "state", r("p_state").alias("p_state"))


@query()
def feature_importance(spark, d):
    """Which of three features tells the sign of the next tick's change, over two purged halves of the month."""
    t = ticks(spark, d).withColumns({"gap": TICK.diff("price"), "size": F.col("qty").cast("double"), "dev": F.col("price") - TICK.rolling("avg", "price", 10), "ahead": TICK.lead("price") - F.col("price")})
    t = t.dropna(subset=["gap", "size", "dev", "ahead"]).withColumns({"y": (F.col("ahead") > 0).cast("double"), "half": F.dayofmonth("day")})
    folds = [(F.col("half") > 17, F.col("half") <= 15), (F.col("half") <= 15, F.col("half") > 17)]
    out = importance.importance(t.select("event_id", "gap", "size", "dev", "y", "half"), ["gap", "size", "dev"], "y", "event_id", folds, trees=5, depth=3)
    return out.select("feature", r("mdi", 4).alias("mdi"), r("mda", 4).alias("mda"), r("sfi", 4).alias("sfi"))
