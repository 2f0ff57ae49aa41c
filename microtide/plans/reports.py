"""Queries of roll-ups over sessions, signals and portfolios, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from microtide.operators import evaluate, joins
from microtide.operators.quantiles import exact_quantiles
from microtide.plans.market import BAR, FILLS, HOURLY, T, TICK, W, fills, hourly, r, ticks
from microtide.plans.registry import query


@query(T + """, h AS (SELECT symbol, day, list_distinct(list(CAST(ts_sec % 86400 // 3600 AS BIGINT))) AS seen FROM t GROUP BY 1, 2), m AS (SELECT *, list_filter(range(24), lambda x: NOT list_contains(seen, x)) AS missing FROM h)
  SELECT symbol, day, CAST(len(missing) AS INT) AS n_missing, array_to_string(missing, ',') AS missing_hours FROM m""")
def missing_hours(spark, d):
    hour = F.floor(F.pmod("ts_sec", F.lit(86_400)) / 3600)
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")), F.col("seen"))
    h = ticks(spark, d).groupBy("symbol", "day").agg(F.collect_set(hour).alias("seen"))
    return h.select("symbol", "day", F.size(missing).alias("n_missing"), F.array_join(missing.cast("array<string>"), ",").alias("missing_hours"))


@query(T + """, c AS (SELECT symbol, day, count(DISTINCT ts_sec // 3600) / 24 AS share FROM t GROUP BY 1, 2)
  SELECT symbol, count(*) FILTER (share >= 0.95) AS healthy, count(*) FILTER (share >= 0.8 AND share < 0.95) AS degraded, count(*) FILTER (share < 0.8) AS incomplete, round(avg(share) * 100, 6) AS mean_coverage FROM c GROUP BY 1""")
def health_rollup(spark, d):
    share = F.col("share")
    c = ticks(spark, d).groupBy("symbol", "day").agg((F.count_distinct(F.floor(F.col("ts_sec") / 3600)) / 24).alias("share"))
    n = lambda test: F.count(F.when(test, 1))
    return c.groupBy("symbol").agg(n(share >= 0.95).alias("healthy"), n((share >= 0.8) & (share < 0.95)).alias("degraded"), n(share < 0.8).alias("incomplete"), r(F.avg(share) * 100).alias("mean_coverage"))


@query(T + f""", s AS (SELECT symbol, price, CASE WHEN price > avg(price) OVER ({W} ROWS 19 PRECEDING) THEN 'above' ELSE 'below' END AS state FROM t), n AS (SELECT symbol, count(*) AS n FROM s GROUP BY 1)
  SELECT s.symbol, state, count(*) AS size, round(count(*) / any_value(n), 6) AS share, round(avg(price), 6) AS mean_price, round(quantile_cont(price, 0.5), 6) AS median_price, round(stddev_samp(price), 6) AS std_price FROM s JOIN n ON s.symbol = n.symbol GROUP BY 1, 2""")
def state_profile(spark, d):
    # A mean of equal prices may be rounded below them; what isn't above the least price isn't above the mean.
    above = (F.col("price") > TICK.rolling("avg", "price", 20)) & (F.col("price") > TICK.rolling("min", "price", 20))
    s = ticks(spark, d).select("symbol", "price", F.when(above, "above").otherwise("below").alias("state"))
    by = s.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("size"), r(F.avg("price")).alias("mean_price"), r(F.stddev_samp("price")).alias("std_price"))
    middle = exact_quantiles(s, ["symbol", "state"], "price", [0.5], ["q"]).select("symbol", "state", r("q").alias("median_price"))
    total = by.groupBy("symbol").agg(F.sum("size").alias("n"))
    return by.join(total, "symbol").join(middle, ["symbol", "state"]).withColumn("share", r(F.col("size") / F.col("n"))).drop("n")


B = "PARTITION BY symbol, day ORDER BY bar_ts"


@query(T + HOURLY + f""", x AS (SELECT symbol, close - avg(close) OVER ({B} ROWS 9 PRECEDING) AS deviation, close - lag(close) OVER ({B}) AS change, lead(close, 1) OVER ({B}) / nullif(close, 0) - 1 AS f1, lead(close, 3) OVER ({B}) / nullif(close, 0) - 1 AS f3 FROM b),
  u AS (SELECT symbol, 'deviation' AS signal, 1 AS horizon, deviation AS s, f1 AS f FROM x UNION ALL SELECT symbol, 'deviation', 3, deviation, f3 FROM x UNION ALL SELECT symbol, 'change', 1, change, f1 FROM x UNION ALL SELECT symbol, 'change', 3, change, f3 FROM x),
  i AS (SELECT signal, horizon, symbol, CASE WHEN isfinite(corr(s, f)) THEN corr(s, f) END AS ic, avg(CASE WHEN sign(s) = sign(f) THEN 1.0 ELSE 0.0 END) AS hit FROM u WHERE s IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2, 3)
  SELECT signal, horizon, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(hit), 6) AS hit_mean, count(DISTINCT symbol) AS symbols FROM i GROUP BY 1, 2""")
def signal_ranking(spark, d):
    ahead = lambda h: evaluate.forward_return("close", h, ["symbol", "day"], "bar_ts")
    x = hourly(spark, d).withColumns({"deviation": F.col("close") - BAR.rolling("avg", "close", 10), "change": BAR.diff("close"), "f1": ahead(1), "f3": ahead(3)})
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"), F.col(s).alias("s"), F.col(f"f{h}").alias("f")) for s in ("deviation", "change") for h in (1, 3)])
    u = x.select("symbol", F.inline(rows)).where("s is not null and f is not null")
    i = u.groupBy("signal", "horizon", "symbol").agg(evaluate.correlation("s", "f").alias("ic"), F.avg((F.signum("s") == F.signum("f")).cast("double")).alias("hit"))
    return i.groupBy("signal", "horizon").agg(r(F.avg("ic")).alias("ic_mean"), r(F.stddev_samp("ic")).alias("ic_std"), r(F.avg("hit")).alias("hit_mean"), F.count_distinct("symbol").alias("symbols"))


@query(T + f""", v AS (SELECT *, stddev_samp(price) OVER ({W} ROWS 9 PRECEDING) AS sd FROM t), n AS (SELECT symbol, sd, lead(sd, 10) OVER ({W}) AS nx FROM v)
  SELECT symbol, round(corr(sd, nx), 5) AS corr_next, round(avg(abs(nx - sd)), 6) AS mae FROM n WHERE sd IS NOT NULL AND nx IS NOT NULL GROUP BY 1""")
def volatility_predictiveness(spark, d):
    v = ticks(spark, d).withColumn("sd", TICK.rolling("stddev_samp", "price", 10)).withColumn("nx", TICK.lead("sd", 10)).where("sd is not null and nx is not null")
    return v.groupBy("symbol").agg(r(F.corr("sd", "nx"), 5).alias("corr_next"), r(F.avg(F.abs(F.col("nx") - F.col("sd")))).alias("mae"))


@query(T + """, l AS (SELECT user_id AS k, symbol, ts_sec AS a, ts_sec + 86400 AS b FROM t), s AS (SELECT k, a AS x, 1 AS v FROM l UNION ALL SELECT k, b + 1, -1 FROM l), c AS (SELECT k, x, sum(sum(v)) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS live FROM s GROUP BY 1, 2)
  SELECT symbol, count(*) AS labels, round(power(sum(1 / live), 2) / sum(1 / (live * live)), 4) AS effective_size FROM l JOIN c ON l.k = c.k AND l.a = c.x GROUP BY 1""")
def effective_sample_size(spark, d):
    l = ticks(spark, d).select("user_id", "symbol", "ts_sec", (F.col("ts_sec") + 86_400).alias("end"), "event_id")
    w = 1 / F.col("overlaps")
    size = F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w)
    return joins.overlap_counts(l, ["user_id"], "ts_sec", "end").groupBy("symbol").agg(F.count(F.lit(1)).alias("labels"), r(size, 4).alias("effective_size"))


@query(FILLS + """, n AS (SELECT day, l_suppkey, CAST(round(sum(CASE WHEN side = 'SELL' THEN 1 ELSE -1 END * qty * price) * 100) AS BIGINT) AS cents FROM f GROUP BY 1, 2)
  SELECT day, count(*) AS symbols, CAST(sum(cents) AS BIGINT) AS net_cents, count(*) FILTER (cents > 0) AS winners, arg_max(l_suppkey, {'a': cents, 'b': l_suppkey}) AS best, arg_min(l_suppkey, {'a': cents, 'b': l_suppkey}) AS worst FROM n GROUP BY 1""")
def portfolio_summary(spark, d):
    value = F.when(F.col("side") == "SELL", 1).otherwise(-1) * F.col("qty") * F.col("price")
    n = fills(spark, d).groupBy("day", "l_suppkey").agg(F.round(F.sum(value) * 100).cast("long").alias("cents"))
    at = F.struct("cents", "l_suppkey")
    return n.groupBy("day").agg(F.count(F.lit(1)).alias("symbols"), F.sum("cents").alias("net_cents"), F.count(F.when(F.col("cents") > 0, 1)).alias("winners"), F.max_by("l_suppkey", at).alias("best"), F.min_by("l_suppkey", at).alias("worst"))
