"""Queries of book features, forward labels, regimes and quote formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from microtide.functions import scalar
from microtide.operators import evaluate, joins, windows
from microtide.operators.quantiles import exact_quantiles
from microtide.plans.market import BAR, HOURLY, IC, RET, T, TICK, TOUCH, W, _returns, _signals, hourly, r, ticks
from microtide.plans.reference_data import BOOK, book
from microtide.plans.registry import query
from microtide.sources.tables import driver_table

L5 = T + BOOK + """, l AS (SELECT *, """ + ", ".join(f"bid - 0.01 * {i} AS bp{i + 1}, ask + 0.01 * {i} AS ap{i + 1}, (qty * {2 * i + 3} + {i}) % 50 + 1 AS bq{i + 1}, (qty * {3 * i + 5} + {i}) % 50 + 1 AS aq{i + 1}" for i in range(5)) + " FROM k)"


def levels(spark, d):
    """Five levels a side, made from the tick by fixed expressions."""
    q = F.col("qty")
    cols = {}
    for i in range(5):
        cols |= {f"bp{i + 1}": F.col("bid") - 0.01 * i, f"ap{i + 1}": F.col("ask") + 0.01 * i, f"bq{i + 1}": (q * (2 * i + 3) + i) % 50 + 1, f"aq{i + 1}": (q * (3 * i + 5) + i) % 50 + 1}
    return book(spark, d).withColumns(cols)


def total(prefix: str):
    return sum((F.col(f"{prefix}{i}") for i in range(2, 6)), F.col(f"{prefix}1"))


BID5, ASK5 = (" + ".join(f"{p}{i}" for i in range(1, 6)) for p in ("bq", "aq"))


@query(L5 + f""" SELECT event_id, round((bq1 - aq1) / (bq1 + aq1 + 1e-9), 8) AS queue_imbalance_l1, round((({BID5}) - ({ASK5})) / ({BID5} + {ASK5} + 1e-9), 8) AS depth_imbalance_l5,
  round((({" + ".join(f"bp{i} * bq{i}" for i in range(1, 6))}) / ({BID5}) + ({" + ".join(f"ap{i} * aq{i}" for i in range(1, 6))}) / ({ASK5})) / 2, 8) AS depth_mid FROM l""")
def book_imbalance(spark, d):
    side = lambda p, q: sum((F.col(f"{p}{i}") * F.col(f"{q}{i}") for i in range(2, 6)), F.col(f"{p}1") * F.col(f"{q}1")) / total(q)
    b, a = total("bq"), total("aq")
    return levels(spark, d).select("event_id", r((F.col("bq1") - F.col("aq1")) / (F.col("bq1") + F.col("aq1") + 1e-9), 8).alias("queue_imbalance_l1"), r((b - a) / (b + a + 1e-9), 8).alias("depth_imbalance_l5"), r((side("bp", "bq") + side("ap", "aq")) / 2, 8).alias("depth_mid"))


def _contrast(p: str, w: tuple) -> str:
    return " + ".join(f"{v} * ln(1 + {p}{i + 1})" for i, v in enumerate(w))


SLOPE, CURVE = (-2.0, -1.0, 0.0, 1.0, 2.0), (2.0, -1.0, -2.0, -1.0, 2.0)


@query(L5 + f" SELECT event_id, round((({_contrast('bq', SLOPE)}) - ({_contrast('aq', SLOPE)})) / 10, 7) AS slope_asymmetry, round((({_contrast('bq', CURVE)}) - ({_contrast('aq', CURVE)})) / 14, 7) AS curvature_asymmetry FROM l")
def book_geometry(spark, d):
    made = lambda p, w: sum((v * F.log1p(f"{p}{i + 1}") for i, v in enumerate(w)), F.lit(0.0))
    return levels(spark, d).select("event_id", r((made("bq", SLOPE) - made("aq", SLOPE)) / 10, 7).alias("slope_asymmetry"), r((made("bq", CURVE) - made("aq", CURVE)) / 14, 7).alias("curvature_asymmetry"))


WEIGHTS = (0.40, 0.25, 0.15, 0.12, 0.08)


@query(L5 + ", m AS (SELECT *, " + ", ".join(f"lag({p}{i}) OVER ({W}) AS l_{p}{i}" for p in ("bp", "ap", "bq", "aq") for i in range(1, 6)) + " FROM l) SELECT event_id, round(" + " + ".join(f"{w} * ((bq{i} - l_bq{i}) * sign(bp{i} - l_bp{i}) - (aq{i} - l_aq{i}) * sign(ap{i} - l_ap{i}))" for i, w in enumerate(WEIGHTS, 1)) + ", 6) AS ofi_weighted FROM m WHERE l_bp1 IS NOT NULL")
def weighted_ofi(spark, d):
    m = levels(spark, d).withColumns({f"l_{p}{i}": TICK.lag(f"{p}{i}") for p in ("bp", "ap", "bq", "aq") for i in range(1, 6)}).where("l_bp1 is not null")
    c = F.col
    part = lambda i: (c(f"bq{i}") - c(f"l_bq{i}")) * F.signum(c(f"bp{i}") - c(f"l_bp{i}")) - (c(f"aq{i}") - c(f"l_aq{i}")) * F.signum(c(f"ap{i}") - c(f"l_ap{i}"))
    return m.select("event_id", r(sum((w * part(i) for i, w in enumerate(WEIGHTS[1:], 2)), WEIGHTS[0] * part(1))).alias("ofi_weighted"))


@query(T + BOOK + f""", m AS (SELECT *, lag(bid) OVER ({W}) AS b0, lag(ask) OVER ({W}) AS a0 FROM k), s AS (SELECT event_id, sum(CASE WHEN bid < b0 THEN 1 ELSE 0 END) OVER w AS x, sum(CASE WHEN ask > a0 THEN 1 ELSE 0 END) OVER w AS y, count(*) OVER w AS n FROM m WINDOW w AS ({W} ROWS 29 PRECEDING))
  SELECT event_id, CASE WHEN n = 30 THEN round((y - x) / (x + y + 1), 8) END AS retreat_imbalance FROM s""")
def quote_retreat(spark, d):
    m = book(spark, d).withColumns({"b0": TICK.lag("bid"), "a0": TICK.lag("ask")})
    w = TICK.rows(30)
    x, y = (F.sum(F.when(t, 1).otherwise(0)).over(w) for t in (F.col("bid") < F.col("b0"), F.col("ask") > F.col("a0")))
    return m.select("event_id", F.when(F.count(F.lit(1)).over(w) == 30, r((y - x) / (x + y + 1), 8)).alias("retreat_imbalance"))


@query(T + BOOK + f""", m AS (SELECT *, lag(bid) OVER ({W}) AS b0, lag(ask) OVER ({W}) AS a0, lag(bq) OVER ({W}) AS q0, lag(aq) OVER ({W}) AS r0 FROM k),
  s AS (SELECT event_id, sum(CASE WHEN abs(bid - b0) < 2 THEN greatest(bq - q0, 0) ELSE 0 END) OVER w AS x, sum(CASE WHEN abs(ask - a0) < 2 THEN greatest(aq - r0, 0) ELSE 0 END) OVER w AS y FROM m WINDOW w AS ({W} ROWS 59 PRECEDING))
  SELECT event_id, round(ln(1 + x) - ln(1 + y), 8) AS replenishment_pressure FROM s""")
def replenishment_pressure(spark, d):
    m = book(spark, d).withColumns({"b0": TICK.lag("bid"), "a0": TICK.lag("ask"), "q0": TICK.lag("bq"), "r0": TICK.lag("aq")})
    w = TICK.rows(60)
    add = lambda p, p0, q, q0: F.sum(F.when(F.abs(F.col(p) - F.col(p0)) < 2, F.greatest(F.col(q) - F.col(q0), F.lit(0))).otherwise(0)).over(w)
    return m.select("event_id", r(F.log1p(add("bid", "b0", "bq", "q0")) - F.log1p(add("ask", "a0", "aq", "r0")), 8).alias("replenishment_pressure"))


@query(RET + f", v AS (SELECT event_id, sqrt(sum(ret * ret) OVER (PARTITION BY symbol, day ORDER BY ts_us, event_id ROWS 59 PRECEDING)) AS a, sqrt(sum(ret * ret) OVER (PARTITION BY symbol, day ORDER BY ts_us, event_id ROWS 299 PRECEDING)) AS b FROM q) SELECT event_id, round(ln(1 + b), 7) AS log_rv_300, round(a / (b + 1e-12), 7) AS rv_ratio_60_300 FROM v WHERE b IS NOT NULL")
def realized_vol_ratio(spark, d):
    sq = F.col("ret") * F.col("ret")
    t = _returns(spark, d).withColumns({"a": F.sqrt(TICK.rolling("sum", sq, 60)), "b": F.sqrt(TICK.rolling("sum", sq, 300))}).where("b is not null")
    return t.select("event_id", r(F.log1p("b"), 7).alias("log_rv_300"), r(F.col("a") / (F.col("b") + 1e-12), 7).alias("rv_ratio_60_300"))


@query(T + HOURLY + """, f AS (SELECT symbol, bar_ts, lead(close, 6) OVER (PARTITION BY symbol, day ORDER BY bar_ts) / close - 1 AS fwd FROM b) SELECT symbol, bar_ts, CASE WHEN fwd > 0.1 THEN 1 WHEN fwd < -0.1 THEN -1 ELSE 0 END AS label FROM f""")
def three_class_label(spark, d):
    fwd = BAR.lead("close", 6) / F.col("close") - 1
    return hourly(spark, d).select("symbol", "bar_ts", F.when(fwd > 0.1, 1).when(fwd < -0.1, -1).otherwise(0).alias("label"))


@query(T + HOURLY + """, d AS (SELECT symbol, day, bar_ts, close - lag(close) OVER (PARTITION BY symbol, day ORDER BY bar_ts) AS ret FROM b), f AS (SELECT symbol, bar_ts, sum(ret * ret) OVER (PARTITION BY symbol, day ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS fv, lead(bar_ts, 6) OVER (PARTITION BY symbol, day ORDER BY bar_ts) AS e FROM d)
  SELECT symbol, bar_ts, CASE WHEN e - bar_ts = 21600 THEN round(fv, 6) END AS forward_variance FROM f""")
def forward_variance(spark, d):
    t = hourly(spark, d).withColumn("ret", BAR.diff("close"))
    fv = F.sum(F.col("ret") * F.col("ret")).over(BAR.w.rowsBetween(1, 6))
    return t.select("symbol", "bar_ts", F.when(BAR.lead("bar_ts", 6) - F.col("bar_ts") == 21_600, r(fv)).alias("forward_variance"))


@query(IC + """, m AS (SELECT symbol, quantile_cont(abs(sig), 0.5) AS q FROM v GROUP BY 1) SELECT v.symbol, CASE WHEN abs(sig) > q THEN 'high' ELSE 'low' END AS regime, count(*) AS n, round(CASE WHEN isfinite(corr(sig, fwd)) THEN corr(sig, fwd) END, 6) AS ic, round(avg(sign(sig) * fwd) / nullif(stddev_samp(sign(sig) * fwd), 0) * sqrt(252 * 23400), 3) AS sharpe FROM v JOIN m ON v.symbol = m.symbol GROUP BY 1, 2""")
def regime_ic(spark, d):
    v = _signals(spark, d)
    m = exact_quantiles(v.withColumn("size", F.abs("sig")), ["symbol"], "size", [0.5], ["q"])
    g = F.signum("sig") * F.col("fwd")
    out = v.join(m, "symbol").groupBy("symbol", F.when(F.abs("sig") > F.col("q"), "high").otherwise("low").alias("regime"))
    return out.agg(F.count(F.lit(1)).alias("n"), r(evaluate.correlation("sig", "fwd")).alias("ic"), r(F.avg(g) / F.nullif(F.stddev_samp(g), F.lit(0.0)) * ((252 * 23_400) ** 0.5), 3).alias("sharpe"))


@query(IC + """, dd AS (SELECT symbol, dayno, CASE WHEN isfinite(corr(sig, fwd)) THEN corr(sig, fwd) END AS ic FROM v GROUP BY 1, 2 HAVING count(*) >= 10) SELECT symbol, count(*) AS days, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(min(ic), 6) AS ic_min, round(max(ic), 6) AS ic_max FROM dd GROUP BY 1""")
def daily_ic(spark, d):
    dd = _signals(spark, d).groupBy("symbol", "dayno").agg(evaluate.correlation("sig", "fwd").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return dd.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), r(F.avg("ic")).alias("ic_mean"), r(F.stddev_samp("ic")).alias("ic_std"), r(F.min("ic")).alias("ic_min"), r(F.max("ic")).alias("ic_max"))


@query(IC + """, f AS (SELECT symbol, CASE WHEN bar_ts // 86400 % 3 = 0 THEN 'test' ELSE 'train' END AS fold, close FROM v), s AS (SELECT symbol, avg(close) AS mu, stddev_pop(close) AS sd FROM f WHERE fold = 'train' GROUP BY 1)
  SELECT f.symbol, count(*) AS n, round(avg((close - mu) / sd), 6) AS z_mean, round(stddev_pop((close - mu) / sd), 6) AS z_std FROM f JOIN s ON f.symbol = s.symbol WHERE fold = 'test' GROUP BY 1""")
def train_test_zscore(spark, d):
    z = _signals(spark, d).select("symbol", F.when(F.floor(F.col("bar_ts") / 86_400) % 3 == 0, "test").otherwise("train").alias("fold"), "close")
    s = z.where("fold = 'train'").groupBy("symbol").agg(F.avg("close").alias("mu"), F.stddev_pop("close").alias("sd"))
    x = (F.col("close") - F.col("mu")) / F.col("sd")
    return z.where("fold = 'test'").join(s, "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.avg(x)).alias("z_mean"), r(F.stddev_pop(x)).alias("z_std"))


@query(T + " SELECT symbol, ts_sec - ts_sec % 7200 AS bucket, arg_max(price, {'a': ts_us, 'b': event_id}) AS last_price FROM t GROUP BY 1, 2")
def resample_last(spark, d):
    bucket = F.col("ts_sec") - F.pmod("ts_sec", F.lit(7200))
    return ticks(spark, d).groupBy("symbol", bucket.alias("bucket")).agg(F.max_by("price", F.struct("ts_us", "event_id")).alias("last_price"))


@query(T + f", g AS (SELECT symbol, (ts_us - lag(ts_us) OVER ({W})) / 1e6 AS gap FROM t) SELECT symbol, count(gap) AS n, round(avg(gap), 4) AS mean_gap, round(1 / avg(gap), 9) AS rate, round(stddev_samp(gap) / avg(gap), 6) AS cv FROM g GROUP BY 1")
def interarrival_fit(spark, d):
    g = ticks(spark, d).select("symbol", ((F.col("ts_us") - TICK.lag("ts_us")) / 1e6).alias("gap"))
    return g.groupBy("symbol").agg(F.count("gap").alias("n"), r(F.avg("gap"), 4).alias("mean_gap"), r(1 / F.avg("gap"), 9).alias("rate"), r(F.stddev_samp("gap") / F.avg("gap")).alias("cv"))


@query(T + f", x AS (SELECT symbol, qty AS x, price - lag(price) OVER ({W}) AS y FROM t), m AS (SELECT symbol, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM x WHERE y IS NOT NULL GROUP BY 1) SELECT symbol, round(xy / xx, 9) AS lambda, round(greatest(0, 1 - (yy - 2 * xy / xx * xy + xy / xx * xy / xx * xx) / yy), 7) AS r2 FROM m")
def impact_through_origin(spark, d):
    x = ticks(spark, d).select("symbol", F.col("qty").alias("x"), TICK.diff("price").alias("y")).where("y is not null")
    product = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(a + b)
    m = x.groupBy("symbol").agg(product("x", "y"), product("x", "x"), product("y", "y"))
    fit = F.col("xy") / F.col("xx")
    return m.select("symbol", r(fit, 9).alias("lambda"), r(F.greatest(F.lit(0.0), 1 - (F.col("yy") - 2 * fit * F.col("xy") + fit * fit * F.col("xx")) / F.col("yy")), 7).alias("r2"))


@query(T + HOURLY + """, p AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_ts, ln(x.close) - ln(y.close) AS s FROM b x JOIN b y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol), q AS (SELECT a, b, s, lag(s) OVER (PARTITION BY a, b, bar_ts // 86400 ORDER BY bar_ts) AS s0 FROM p)
  SELECT a, b, round(regr_slope(s - s0, s0), 6) AS ar_beta, CASE WHEN regr_slope(s - s0, s0) < 0 THEN round(-ln(2) / regr_slope(s - s0, s0), 5) END AS half_life FROM q GROUP BY 1, 2""")
def spread_half_life(spark, d):
    p = joins.align_pairs(hourly(spark, d), "symbol", "bar_ts", "close").withColumn("s", F.log("value_a") - F.log("value_b"))
    p = p.withColumn("s0", F.lag("s").over(Window.partitionBy("a", "b", F.floor(F.col("bar_ts") / 86_400)).orderBy("bar_ts")))
    beta = F.regr_slope(F.col("s") - F.col("s0"), F.col("s0"))
    return p.groupBy("a", "b").agg(r(beta).alias("ar_beta"), F.when(beta < 0, r(-F.log(F.lit(2.0)) / beta, 5)).alias("half_life"))


@query("""WITH q AS (SELECT p_partkey, 0.05 + p_size * 0.01 AS g, 1.0 + p_partkey % 5 AS k, 0.1 + p_size * 0.02 AS s, CAST(p_partkey % 11 AS DOUBLE) - 5 AS i, (p_partkey % 100) / 100 AS left_t, p_retailprice AS m FROM part)
  SELECT p_partkey, round(m - i * g * s * s * left_t * (1 + abs(i) / 5 * (1 - left_t)), 5) AS reservation, round(greatest(0.1, m * 0.0005, least(g * s * s * left_t + 2 / g * ln(1 + g / k), 1.5)), 7) AS optimal_spread, round(1 / g * ln(1 + g / k) + (2 * i + 1) / 2 * sqrt(s * s * g / (2 * k) * power(1 + g / k, 1 + k / g)), 6) AS asymptotic_bid FROM q""")
def quote_formulas(spark, d):
    p, z = F.col("p_partkey"), F.col("p_size")
    q = driver_table(spark, d, "part").select("p_partkey", (0.05 + z * 0.01).alias("g"), (1.0 + p % 5).alias("k"), (0.1 + z * 0.02).alias("s"), ((p % 11).cast("double") - 5).alias("i"), (p % 100 / 100).alias("left_t"), F.col("p_retailprice").alias("m"))
    g, k, s, i, t = (F.col(c) for c in ("g", "k", "s", "i", "left_t"))
    base = F.log(1 + g / k)
    return q.select("p_partkey", r(scalar.reservation_price(F.col("m"), i, g, s, t, 5), 5).alias("reservation"), r(scalar.optimal_spread(F.col("m"), g, k, s, t, 0.1, 1.5), 7).alias("optimal_spread"), r(1 / g * base + (2 * i + 1) / 2 * F.sqrt(s * s * g / (2 * k) * F.pow(1 + g / k, 1 + k / g))).alias("asymptotic_bid"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS bal, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal / 100 END AS ratio, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS growth FROM customer)
  SELECT c_custkey, CAST((bal IS NOT NULL)::INT + (ratio IS NOT NULL)::INT + (growth IS NOT NULL)::INT AS INT) AS filled, CASE WHEN ratio IS NOT NULL AND growth IS NOT NULL THEN 'FULL' WHEN ratio IS NOT NULL OR growth IS NOT NULL THEN 'PARTIAL' ELSE 'MINIMAL' END AS tier,
    CASE WHEN bal > 5000 THEN 40 WHEN bal > 0 THEN 25 ELSE 5 END + CASE WHEN ratio > 50 THEN 30 WHEN ratio > 0 THEN 15 ELSE 0 END + CASE WHEN growth > 12 THEN 30 WHEN growth IS NOT NULL THEN 10 ELSE 0 END AS score FROM c""")
def fundamental_quality(spark, d):
    c = driver_table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") / 100).alias("ratio"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("growth"))
    filled = sum((F.col(x).isNotNull().cast("int") for x in ("ratio", "growth")), F.col("bal").isNotNull().cast("int"))
    both = F.when(F.col("ratio").isNotNull() & F.col("growth").isNotNull(), "FULL").when(F.col("ratio").isNotNull() | F.col("growth").isNotNull(), "PARTIAL").otherwise("MINIMAL")
    score = F.when(F.col("bal") > 5000, 40).when(F.col("bal") > 0, 25).otherwise(5) + F.when(F.col("ratio") > 50, 30).when(F.col("ratio") > 0, 15).otherwise(0) + F.when(F.col("growth") > 12, 30).when(F.col("growth").isNotNull(), 10).otherwise(0)
    return c.select("c_custkey", filled.alias("filled"), both.alias("tier"), score.alias("score"))


@query(T + f""", c AS (SELECT symbol, day, user_id, price, CASE WHEN user_id % 5 = 0 THEN 'FII' WHEN user_id % 5 = 1 THEN 'DII' ELSE 'OTHER' END AS cat FROM t)
  SELECT day, round(sum(CASE WHEN cat = 'FII' THEN price ELSE 0 END), 4) AS fii, round(sum(CASE WHEN cat = 'DII' THEN price ELSE 0 END), 4) AS dii, sum(CASE WHEN cat = 'FII' THEN price ELSE 0 END) > sum(CASE WHEN cat = 'DII' THEN price ELSE 0 END) AS foreign_buying FROM c GROUP BY 1""")
def flow_pivot(spark, d):
    cat = F.when(F.col("user_id") % 5 == 0, "FII").when(F.col("user_id") % 5 == 1, "DII").otherwise("OTHER")
    part = lambda n: F.sum(F.when(F.col("cat") == n, F.col("price")).otherwise(0.0))
    return ticks(spark, d).withColumn("cat", cat).groupBy("day").agg(r(part("FII"), 4).alias("fii"), r(part("DII"), 4).alias("dii"), (part("FII") > part("DII")).alias("foreign_buying"))


@query(T + HOURLY + """, e AS (SELECT symbol, count(*) AS n, avg(close) AS mu, stddev_samp(close) AS sd, quantile_cont(close, 0.5) AS med FROM b GROUP BY 1), x AS (SELECT a.symbol AS old, z.symbol AS new, greatest(0.5, least(2.0, z.sd / a.sd)) AS ratio FROM e a JOIN e z ON a.symbol != z.symbol)
  SELECT old, new, round(ratio, 7) AS ratio, round(greatest(0.01, least(1.0, 0.1 / ratio)), 7) AS gamma_new, round(sqrt(ratio), 7) AS spread_scale, ratio BETWEEN 0.8 AND 1.25 AS stable FROM x""")
def parameter_transfer(spark, d):
    e = hourly(spark, d).groupBy("symbol").agg(F.stddev_samp("close").alias("sd"))
    x = e.select(F.col("symbol").alias("old"), F.col("sd").alias("s0")).join(e.select(F.col("symbol").alias("new"), F.col("sd").alias("s1")), F.col("old") != F.col("new"))
    ratio = scalar.clamp(F.col("s1") / F.col("s0"), 0.5, 2.0)
    return x.select("old", "new", r(ratio, 7).alias("ratio"), r(scalar.clamp(0.1 / ratio, 0.01, 1.0), 7).alias("gamma_new"), r(F.sqrt(ratio), 7).alias("spread_scale"), ratio.between(0.8, 1.25).alias("stable"))


@query(IC + """, k AS (SELECT *, 0.1 AS cost FROM v), g AS (SELECT symbol, CASE WHEN abs(sig) > 5 THEN 1 ELSE 0 END AS take, sign(sig) * fwd AS gain FROM k)
  SELECT symbol, round(avg(take), 6) AS signal_rate, round(avg(CASE WHEN take = 1 THEN CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END END), 6) AS confident_accuracy, round(sqrt(avg(power(gain, 2))), 6) AS rmse FROM g GROUP BY 1""")
def confident_accuracy(spark, d):
    g = _signals(spark, d).select("symbol", F.when(F.abs("sig") > 5, 1).otherwise(0).alias("take"), (F.signum("sig") * F.col("fwd")).alias("gain"))
    hit = F.when(F.col("take") == 1, F.when(F.col("gain") > 0, 1.0).otherwise(0.0))
    return g.groupBy("symbol").agg(r(F.avg("take")).alias("signal_rate"), r(F.avg(hit)).alias("confident_accuracy"), r(F.sqrt(F.avg(F.col("gain") * F.col("gain")))).alias("rmse"))


@query(T + HOURLY + TOUCH.format(h=21600) + " SELECT symbol, count(label) AS n, round(avg(CASE WHEN label IS NOT NULL THEN CASE WHEN label = 1 THEN 1.0 ELSE 0 END END), 6) AS up_share, round(avg(CASE WHEN label IS NOT NULL THEN CASE WHEN label = -1 THEN 1.0 ELSE 0 END END), 6) AS down_share FROM y GROUP BY 1")
def label_summary(spark, d):
    """Labels whose whole horizon lies in their session."""
    y = evaluate.triple_barrier(hourly(spark, d), ["symbol", "day"], "bar_ts", "close", 0.5, 0.5, 21_600, whole=True)
    share = lambda v: r(F.avg((F.col("label") == v).cast("double")))
    return y.groupBy("symbol").agg(F.count("label").alias("n"), share(1).alias("up_share"), share(-1).alias("down_share"))
