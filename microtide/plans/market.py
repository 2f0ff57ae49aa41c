"""Queries over the driver's tables with their DuckDB counterparts.

``events`` is the tick stream: event_type is the symbol, value the price, props.k the quantity.
``lineitem`` joined with ``orders`` gives fills. Computed doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.functions import scalar
from microtide.operators import bars, evaluate, joins, regression, windows
from microtide.operators.quantiles import exact_quantiles
from microtide.operators.windows import Series
from microtide.plans.registry import query
from microtide.sources.tables import driver_table

T = """WITH t AS (
  SELECT event_id, event_type AS symbol, user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts_sec, CAST(epoch_us(ts) AS BIGINT) AS ts_us,
    value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, CAST(ts AS DATE) AS day
  FROM events)"""
HOURLY = """, b AS (
  SELECT symbol, day, ts_sec - ts_sec % 3600 AS bar_ts, arg_min(price, {'a': ts_us, 'b': event_id}) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, {'a': ts_us, 'b': event_id}) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS tick_count, sum(price * qty) / nullif(sum(qty), 0) AS vwap
  FROM t WHERE price > 0 GROUP BY 1, 2, 3)"""
#: A session is a symbol's day; no window of ticks or bars reads across sessions.
W = "PARTITION BY symbol, day ORDER BY ts_us, event_id"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return driver_table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("symbol"), "user_id", F.floor(us / 1_000_000).alias("ts_sec"), us.alias("ts_us"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"), F.col("ts").cast("date").alias("day"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.time_bars(ticks(spark, sf_dir), ["symbol", "day"], "ts_sec", ["ts_us", "event_id"], "price", "qty", 3600)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = driver_table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", side.alias("side"), F.col("l_quantity").cast("long").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").cast("date").alias("day"))


FILLS = """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  CAST(l_quantity AS BIGINT) AS qty, l_extendedprice / l_quantity AS price, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""

TICK = Series(["symbol", "day"], ["ts_us", "event_id"])
BAR = Series(["symbol", "day"], "bar_ts")


def r(c, n: int = 6):
    return F.round(c, n)


# ---- bars -------------------------------------------------------------------------------


@query(T + HOURLY + " SELECT symbol, bar_ts, open, high, low, close, volume, tick_count, round(vwap, 10) AS vwap FROM b")
def ohlc_bars(spark, d):
    return hourly(spark, d).select("symbol", "bar_ts", "open", "high", "low", "close", "volume", "tick_count", r("vwap", 10).alias("vwap"))


@query(T + HOURLY + """ SELECT symbol, bar_ts, close, round(stddev_samp(close) OVER w, 6) AS close_std_10, round(avg(close) OVER w, 6) AS close_ma_10,
  round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS close_z_10,
  round((close - lag(close, 10) OVER o) / nullif(lag(close, 10) OVER o, 0), 6) AS momentum_10, round(volume / nullif(avg(volume) OVER w, 0), 6) AS volume_ratio_10
  FROM b WINDOW w AS (PARTITION BY symbol, day ORDER BY bar_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), o AS (PARTITION BY symbol, day ORDER BY bar_ts)""")
def ohlc_rolling_bars(spark, d):
    out = bars.rolling_features(hourly(spark, d), ["symbol", "day"])
    return out.select("symbol", "bar_ts", "close", *[r(c).alias(c) for c in ("close_std_10", "close_ma_10", "close_z_10", "momentum_10", "volume_ratio_10")])


@query(T + """ SELECT symbol, day, arg_max(price, {'a': ts_us, 'b': event_id}) AS last_price, arg_max(qty, {'a': ts_us, 'b': event_id}) AS last_qty, arg_max(user_id, {'a': ts_us, 'b': event_id}) AS last_user FROM t GROUP BY 1, 2""")
def last_snapshot(spark, d):
    out = bars.last_snapshot(ticks(spark, d), ["symbol", "day"], ["ts_us", "event_id"], ["price", "qty", "user_id"])
    return out.select("symbol", "day", F.col("price").alias("last_price"), F.col("qty").alias("last_qty"), F.col("user_id").alias("last_user"))


@query(T + HOURLY + """, g AS (SELECT symbol, day, unnest(generate_series(min(bar_ts), max(bar_ts), 3600)) AS bar_ts FROM b GROUP BY 1, 2)
  SELECT g.symbol, g.bar_ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol, g.day ORDER BY g.bar_ts ROWS UNBOUNDED PRECEDING) AS close,
    coalesce(b.volume, 0) AS volume, CASE WHEN b.close IS NULL THEN 0 ELSE 1 END AS is_observed
  FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.bar_ts = b.bar_ts""")
def grid_regularize(spark, d):
    return bars.regularize(hourly(spark, d), ["symbol", "day"], "bar_ts", 3600, ["close"], ["volume"]).select("symbol", "bar_ts", "close", "volume", "is_observed")


@query(T + """ SELECT symbol, day, count(DISTINCT ts_sec // 3600) AS present, 24 AS expected, round(count(DISTINCT ts_sec // 3600) / 24 * 100, 6) AS coverage_pct,
  CASE WHEN count(DISTINCT ts_sec // 3600) / 24 >= 0.95 THEN 'HEALTHY' WHEN count(DISTINCT ts_sec // 3600) / 24 >= 0.8 THEN 'DEGRADED' ELSE 'INCOMPLETE' END AS status FROM t GROUP BY 1, 2""")
def coverage_report(spark, d):
    return bars.coverage(ticks(spark, d), ["symbol", "day"], F.floor(F.col("ts_sec") / 3600), 24).withColumn("coverage_pct", r("coverage_pct"))


@query(T + """, h AS (SELECT DISTINCT symbol, day, ts_sec // 3600 AS hour FROM t), g AS (SELECT symbol, day, hour - lag(hour) OVER (PARTITION BY symbol, day ORDER BY hour) - 1 AS gap FROM h)
  SELECT symbol, day, CAST(coalesce(sum(gap), 0) AS BIGINT) AS missing, coalesce(max(gap), 0) AS longest_gap, count(*) FILTER (gap > 0) AS gaps FROM g GROUP BY 1, 2""")
def longest_gap(spark, d):
    return bars.longest_gap(ticks(spark, d).withColumn("hour", F.floor(F.col("ts_sec") / 3600)), ["symbol", "day"], "hour")


@query(T + f""", f AS (SELECT symbol, day, ts_us, event_id, price > 20 AS up, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY symbol, day) AS rows FROM t),
  i AS (SELECT symbol, day, n, rows, n - row_number() OVER ({W}) AS g FROM f WHERE up), l AS (SELECT symbol, count(*) AS k FROM i GROUP BY symbol, day, g HAVING max(n) < any_value(rows))
  SELECT symbol, count(*) AS runs, max(k) AS longest_run, quantile_cont(k, 0.5) AS median_run, quantile_cont(k, 0.75) AS p75_run FROM l GROUP BY 1""")
def run_lengths(spark, d):
    return bars.run_lengths(ticks(spark, d).withColumn("up", F.col("price") > 20), TICK, ["symbol"], "up")


@query(T + """, h AS (SELECT symbol, day, ts_sec % 86400 // 3600 AS hour, avg(price) AS m FROM t GROUP BY 1, 2, 3) SELECT symbol, hour, round(avg(m), 6) AS mean_price, count(*) AS days FROM h GROUP BY 1, 2""")
def time_of_day_profile(spark, d):
    hour = F.floor(F.pmod("ts_sec", F.lit(86_400)) / 3600).alias("hour")
    daily = ticks(spark, d).groupBy("symbol", "day", hour).agg(F.avg("price").alias("m"))
    return daily.groupBy("symbol", "hour").agg(r(F.avg("m")).alias("mean_price"), F.count(F.lit(1)).alias("days"))


@query(T + " SELECT symbol, " + ", ".join(f"round(quantile_cont(price, {q / 100}), 6) AS p{q}" for q in (25, 50, 75, 90, 95, 99)) + " FROM t GROUP BY 1")
def quantile_profile(spark, d):
    qs = (25, 50, 75, 90, 95, 99)
    got = exact_quantiles(ticks(spark, d), ["symbol"], "price", [q / 100 for q in qs], [f"p{q}" for q in qs])
    return got.select("symbol", *[r(f"p{q}").alias(f"p{q}") for q in qs])


# ---- windows ----------------------------------------------------------------------------


def _tick_window(cols: str, frames: str = "") -> str:
    return T + f" SELECT event_id, {cols} FROM t WINDOW o AS ({W})" + frames


@query(_tick_window("CASE WHEN count(price) OVER w >= 20 THEN round(sum(price) OVER w, 6) END AS sum_60, CASE WHEN count(price) OVER w >= 20 THEN round(var_pop(price) OVER w, 6) END AS var_60", f", w AS ({W} ROWS 59 PRECEDING)"))
def rolling_minperiods(spark, d):
    return ticks(spark, d).select("event_id", r(TICK.rolling("sum", "price", 60, 20)).alias("sum_60"), r(TICK.rolling("var_pop", "price", 60, 20)).alias("var_60"))


@query(_tick_window("round(quantile_cont(price, 0.5) OVER w, 6) AS median_30", f", w AS ({W} ROWS 29 PRECEDING)"))
def rolling_median(spark, d):
    return ticks(spark, d).select("event_id", r(TICK.quantile("price", 0.5, 30)).alias("median_30"))


@query(T + f""", l AS (SELECT event_id, price, list(price) OVER ({W} ROWS 49 PRECEDING) AS seen FROM t)
  SELECT event_id, round((len(list_filter(seen, lambda v: v < price)) + (len(list_filter(seen, lambda v: v = price)) + 1) / 2) / len(seen), 6) AS rank_50 FROM l""")
def rolling_rank_pct(spark, d):
    return ticks(spark, d).withColumn("rank_50", TICK.rank_pct("price", 50)).select("event_id", r("rank_50").alias("rank_50"))


@query(T + f""", l AS (SELECT *, lag(price) OVER ({W}) AS past FROM t)
  SELECT event_id, CASE WHEN count(past) OVER w >= 40 THEN round(corr(price, past) OVER w, 5) END AS acf_100 FROM l WINDOW w AS ({W} ROWS 99 PRECEDING)""")
def rolling_corr_lag(spark, d):
    t = ticks(spark, d).withColumn("past", TICK.lag("price"))
    return regression.rolling_corr(t, TICK, "price", "past", 100, 40, "c").select("event_id", r("c", 5).alias("acf_100"))


@query(T + f""", m AS (SELECT *, count(*) OVER w AS n, avg(qty) OVER w AS x, avg(price) OVER w AS y, avg(qty * qty) OVER w AS xx, avg(qty * price) OVER w AS xy FROM t WINDOW w AS ({W} ROWS 99 PRECEDING)),
  b AS (SELECT *, CASE WHEN n >= 30 THEN (xy - x * y) / (xx - x * x + 1e-12) END AS b FROM m)
  SELECT event_id, round(lag(b) OVER ({W}), 5) AS ols_slope, round(lag(y - b * x) OVER ({W}), 5) AS ols_intercept FROM b""")
def rolling_ols_moments(spark, d):
    out = windows.rolling_ols(ticks(spark, d), TICK, "qty", "price", 100, 30)
    return out.select("event_id", r("ols_slope", 5).alias("ols_slope"), r("ols_intercept", 5).alias("ols_intercept"))


@query(T + f""", l AS (SELECT event_id, price, list_sort(list(price) OVER ({W} ROWS 19 PRECEDING)) AS s FROM t),
  m AS (SELECT *, (s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2 AS med FROM l), a AS (SELECT *, list_sort(list_transform(s, lambda v: abs(v - med))) AS q FROM m)
  SELECT event_id, round((price - med) / nullif(1.4826 * (q[(len(q) - 1) // 2 + 1] + q[len(q) // 2 + 1]) / 2, 0), 6) AS robust_z FROM a""")
def robust_z(spark, d):
    return windows.robust_z(ticks(spark, d), TICK, "price", 20).select("event_id", r("robust_z").alias("robust_z"))


def _returns(spark, d):
    return ticks(spark, d).withColumn("ret", F.col("price") - TICK.lag("price"))


RET = T + f", q AS (SELECT *, price - lag(price) OVER ({W}) AS ret FROM t)"


@query(RET + f""", s AS (SELECT event_id, sum(CASE WHEN ret > 0 THEN ret * ret ELSE 0 END) OVER w AS u, sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) OVER w AS v FROM q WINDOW w AS ({W} ROWS 99 PRECEDING))
  SELECT event_id, round((u - v) / (u + v + 1e-12), 6) AS semivar_imbalance FROM s""")
def semivariance(spark, d):
    sq = F.col("ret") * F.col("ret")
    up, down = (TICK.rolling("sum", F.when(c, sq).otherwise(0.0), 100) for c in (F.col("ret") > 0, F.col("ret") < 0))
    return _returns(spark, d).select("event_id", r((up - down) / (up + down + 1e-12)).alias("semivar_imbalance"))


@query(RET + f""", p AS (SELECT *, abs(ret) * abs(lag(ret) OVER ({W})) AS bp FROM q), s AS (SELECT event_id, sum(ret * ret) OVER w AS rv, pi() / 2 * sum(bp) OVER w AS bv FROM p WINDOW w AS ({W} ROWS 99 PRECEDING))
  SELECT event_id, round(greatest(rv - bv, 0) / (rv + 1e-12), 6) AS jump_ratio FROM s WHERE bv IS NOT NULL""")
def jump_ratio(spark, d):
    t = _returns(spark, d).withColumn("bp", F.abs("ret") * F.abs(TICK.lag("ret")))
    t = t.withColumns({"rv": TICK.rolling("sum", F.col("ret") * F.col("ret"), 100), "bv": F.lit(3.141592653589793) / 2 * TICK.rolling("sum", "bp", 100)}).where("bv is not null")
    return t.select("event_id", r(F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)) / (F.col("rv") + 1e-12)).alias("jump_ratio"))


@query(RET + f""", g AS (SELECT *, sign(ret) AS s, last_value(nullif(sign(ret), 0) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM q),
  c AS (SELECT event_id, count(*) FILTER (s = p AND s != 0) OVER w AS same, count(*) FILTER (s != 0 AND p != 0) OVER w AS valid FROM g WINDOW w AS ({W} ROWS 99 PRECEDING))
  SELECT event_id, CASE WHEN valid >= 20 THEN round(same / valid, 6) END AS sign_persistence FROM c""")
def sign_persistence(spark, d):
    t = _returns(spark, d).withColumn("s", F.signum("ret")).withColumn("p", F.last(F.nullif("s", F.lit(0.0)), ignorenulls=True).over(TICK.before()))
    w = TICK.rows(100)
    same = F.count(F.when((F.col("s") == F.col("p")) & (F.col("s") != 0), 1)).over(w)
    valid = F.count(F.when((F.col("s") != 0) & (F.col("p") != 0), 1)).over(w)
    return t.select("event_id", F.when(valid >= 20, r(same / valid)).alias("sign_persistence"))


@query(_tick_window("round((price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w + 1e-12), 6) AS range_position", f", w AS ({W} ROWS 49 PRECEDING)"))
def range_position(spark, d):
    low, high = TICK.rolling("min", "price", 50), TICK.rolling("max", "price", 50)
    return ticks(spark, d).select("event_id", r((F.col("price") - low) / (high - low + 1e-12)).alias("range_position"))


@query(T + " SELECT event_id, count(*) OVER w AS n_hour, CAST(sum(qty) OVER w AS BIGINT) AS qty_hour FROM t WINDOW w AS (PARTITION BY symbol, day ORDER BY ts_sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)")
def clock_window_counts(spark, d):
    w = Series(["symbol", "day"], "ts_sec").clock(3600)
    return ticks(spark, d).select("event_id", F.count(F.lit(1)).over(w).alias("n_hour"), F.sum("qty").over(w).alias("qty_hour"))


def _fano_sql() -> str:
    counts = ", ".join(f"count(*) OVER (PARTITION BY symbol, day ORDER BY ts_sec RANGE BETWEEN {21599 - 3600 * j} PRECEDING AND {21600 - 3600 * (j + 1)} PRECEDING) AS c{j}" for j in range(6))
    mean = "(" + " + ".join(f"c{j}" for j in range(6)) + ") / 6"
    var = "(" + " + ".join(f"(c{j} - {mean}) * (c{j} - {mean})" for j in range(6)) + ") / 6"
    return T + f", c AS (SELECT event_id, {counts} FROM t) SELECT event_id, round({var} / nullif({mean}, 0), 6) AS fano FROM c"


@query(_fano_sql())
def fano_blocks(spark, d):
    return ticks(spark, d).select("event_id", r(windows.fano(Series(["symbol", "day"], "ts_sec"), F.lit(True), 3600, 6)).alias("fano"))


@query(T + f""", g AS (SELECT symbol, day, ts_sec, event_id, ts_sec - lag(ts_sec) OVER ({W}) AS gap FROM t)
  SELECT event_id, CASE WHEN count(gap) OVER w >= 3 THEN round(stddev_pop(gap) OVER w / nullif(avg(gap) OVER w, 0), 5) END AS cv FROM g WINDOW w AS (PARTITION BY symbol, day ORDER BY ts_sec RANGE BETWEEN 43199 PRECEDING AND CURRENT ROW)""")
def interarrival_cv(spark, d):
    g = ticks(spark, d).withColumn("gap", F.col("ts_sec") - TICK.lag("ts_sec"))
    s, gap = Series(["symbol", "day"], "ts_sec"), F.col("gap")
    g = g.select("event_id", *[s.clock_sum(x, 43_200).alias(c) for c, x in (("n", gap.isNotNull().cast("long")), ("one", gap), ("two", gap * gap))])
    # Whole numbers: a session's gaps sum to a day at most.
    cv = F.sqrt((F.col("n") * F.col("two") - F.col("one") * F.col("one")).cast("double")) / F.nullif(F.col("one"), F.lit(0))
    return g.select("event_id", F.when(F.col("n") >= 3, r(cv, 5)).alias("cv"))


@query(T + f""", e AS (SELECT *, last_value(CASE WHEN qty >= 95 THEN ts_sec END IGNORE NULLS) OVER w AS ets, last_value(CASE WHEN qty >= 95 THEN price END IGNORE NULLS) OVER w AS ep FROM t WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING))
  SELECT event_id, CASE WHEN ts_sec - ets < 7200 THEN ts_sec - ets END AS event_age, CASE WHEN ts_sec - ets < 7200 THEN ep END AS event_price FROM e""")
def event_propagation(spark, d):
    out = windows.propagate(ticks(spark, d).withColumn("shock", F.col("qty") >= 95), TICK, "ts_sec", "shock", ["price"], 7200)
    return out.select("event_id", "event_age", "event_price")


@query(T + f" SELECT event_id, CASE WHEN count(qty) OVER w = 3 AND min(qty) OVER w > 40 THEN true ELSE false END AS confirmed FROM t WINDOW w AS ({W} ROWS 2 PRECEDING)")
def consecutive_confirmation(spark, d):
    w = TICK.rows(3)
    return ticks(spark, d).select("event_id", F.coalesce((F.count("qty").over(w) == 3) & (F.min("qty").over(w) > 40), F.lit(False)).alias("confirmed"))


@query(_tick_window("round((price - avg(price) OVER w) / nullif(stddev_pop(price) OVER w, 0), 5) AS z_past_60", f", w AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"))
def zscore_excluding_current(spark, d):
    mean, sd = (TICK.rolling(f, "price", 60, skip=1) for f in ("avg", "stddev_pop"))
    return ticks(spark, d).select("event_id", r((F.col("price") - mean) / F.nullif(sd, F.lit(0.0)), 5).alias("z_past_60"))


@query(_tick_window("round(sum(price * qty) OVER w / nullif(sum(qty) OVER w, 0), 6) AS vwap", f", w AS ({W} ROWS UNBOUNDED PRECEDING)"))
def cumulative_vwap(spark, d):
    w = TICK.so_far()
    return ticks(spark, d).select("event_id", r(F.sum(F.col("price") * F.col("qty")).over(w) / F.nullif(F.sum("qty").over(w), F.lit(0))).alias("vwap"))


@query(T + f""", l AS (SELECT event_id, list(price) OVER ({W} ROWS 3 PRECEDING) AS s FROM t)
  SELECT event_id, CASE WHEN len(s) = 4 THEN round(s[4] - 0.5 * s[3] - 0.125 * s[2] - 0.0625 * s[1], 6) END AS frac_diff FROM l""")
def fractional_difference(spark, d):
    return ticks(spark, d).select("event_id", r(windows.frac_diff(TICK, "price", scalar.frac_diff_weights(0.5, 4))).alias("frac_diff"))


@query(RET + f""", g AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (ret > 0) OVER w AS u, count(*) FILTER (ret < 0) OVER w AS v FROM q WINDOW w AS ({W} ROWS 49 PRECEDING))
  SELECT event_id, round(0.0 - (CASE WHEN u > 0 THEN u / n * ln(u / n) ELSE 0 END + CASE WHEN v > 0 THEN v / n * ln(v / n) ELSE 0 END), 6) AS sign_entropy, round((u - v) / n, 6) AS direction_bias FROM g""")
def sign_entropy(spark, d):
    w = TICK.rows(50)
    n, u, v = (F.count(F.when(c, 1)).over(w) for c in (F.lit(True), F.col("ret") > 0, F.col("ret") < 0))
    part = lambda k: F.when(k > 0, k / n * F.log(k / n)).otherwise(0.0)
    return _returns(spark, d).select("event_id", r(-(part(u) + part(v))).alias("sign_entropy"), r((u - v) / n).alias("direction_bias"))


@query(T + """, l AS (SELECT user_id AS k, ts_sec AS a, ts_sec + 86400 AS b, event_id FROM t), s AS (SELECT k, a AS x, 1 AS v FROM l UNION ALL SELECT k, b + 1, -1 FROM l),
  c AS (SELECT k, x, sum(sum(v)) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS live FROM s GROUP BY 1, 2) SELECT event_id, CAST(live AS BIGINT) AS overlaps FROM l JOIN c ON l.k = c.k AND l.a = c.x""")
def interval_overlap(spark, d):
    l = ticks(spark, d).select("user_id", "ts_sec", (F.col("ts_sec") + 86_400).alias("end"), "event_id")
    return joins.overlap_counts(l, ["user_id"], "ts_sec", "end").select("event_id", "overlaps")


# ---- joins ------------------------------------------------------------------------------


@query(T + """, l AS (SELECT * FROM t WHERE symbol = 'purchase'), x AS (SELECT day, ts_us, max(price) AS price FROM t WHERE symbol = 'view' GROUP BY 1, 2)
  SELECT l.event_id, x.ts_us AS r_ts_us, x.price AS r_price FROM l ASOF LEFT JOIN x ON l.day = x.day AND l.ts_us >= x.ts_us""")
def asof_join(spark, d):
    t = ticks(spark, d)
    left = t.where("symbol = 'purchase'").select("day", "ts_us", "event_id")
    right = t.where("symbol = 'view'").select("day", "ts_us", "price")
    return joins.asof_join(left, right, ["day"], "ts_us", ["price"], bucket=3_600_000_000).select("event_id", "r_ts_us", "r_price")


@query(T + """, l AS (SELECT user_id, ts_us, event_id FROM t WHERE symbol = 'purchase'), x AS (SELECT user_id, ts_us, max(price) AS price FROM t WHERE symbol != 'purchase' GROUP BY 1, 2)
  SELECT l.event_id, CASE WHEN l.ts_us - x.ts_us <= 86400000000 THEN x.price END AS r_price FROM l ASOF LEFT JOIN x ON l.user_id = x.user_id AND l.ts_us >= x.ts_us""")
def asof_join_by_key(spark, d):
    t = ticks(spark, d)
    left = t.where("symbol = 'purchase'").select("user_id", "ts_us", "event_id")
    right = t.where("symbol != 'purchase'").select("user_id", "ts_us", "price")
    return joins.asof_join(left, right, ["user_id"], "ts_us", ["price"], tolerance=86_400_000_000).select("event_id", "r_price")


@query(T + HOURLY + " SELECT b.symbol, b.bar_ts, b.close, a.close AS close_6h FROM b LEFT JOIN b a ON a.symbol = b.symbol AND a.bar_ts = b.bar_ts + 21600")
def exact_lag_join(spark, d):
    return joins.exact_offset_join(hourly(spark, d).select("symbol", "bar_ts", "close"), ["symbol"], "bar_ts", "close", 21_600, "close_6h")


@query(T + HOURLY + " SELECT x.symbol AS a, y.symbol AS b, x.bar_ts, x.close AS value_a, y.close AS value_b FROM b x JOIN b y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol")
def pair_align(spark, d):
    return joins.align_pairs(hourly(spark, d), "symbol", "bar_ts", "close")


@query(T + HOURLY + """ SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(regr_slope(y.close, x.close), 6) AS hedge_ratio, round(regr_intercept(y.close, x.close), 6) AS intercept, round(corr(x.close, y.close), 6) AS corr
  FROM b x JOIN b y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol GROUP BY 1, 2""")
def pair_hedge_ratio(spark, d):
    p = joins.align_pairs(hourly(spark, d), "symbol", "bar_ts", "close")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r(F.regr_slope("value_b", "value_a")).alias("hedge_ratio"), r(F.regr_intercept("value_b", "value_a")).alias("intercept"), r(F.corr("value_a", "value_b")).alias("corr"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_pending(spark, d):
    jobs = driver_table(spark, d, "customer").select(F.col("c_custkey"))
    return joins.pending(jobs, driver_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT DISTINCT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def semi_banned(spark, d):
    banned = driver_table(spark, d, "nation").where("n_regionkey = 2")
    s = driver_table(spark, d, "supplier")
    return s.join(banned, s["s_nationkey"] == banned["n_nationkey"], "left_semi").select("s_suppkey", "s_name").distinct()


@query("""WITH p AS (SELECT p_brand AS key, round(avg(p_retailprice), 4) AS gamma FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 UNION ALL SELECT p_type, round(avg(p_retailprice), 4) FROM part WHERE p_partkey % 7 = 0 AND p_size > 25 GROUP BY 1)
  SELECT p_partkey, coalesce(a.gamma, b.gamma, 1.0) AS gamma, CASE WHEN a.gamma IS NOT NULL THEN 'exact' WHEN b.gamma IS NOT NULL THEN 'base' ELSE 'default' END AS matched
  FROM part LEFT JOIN p a ON p_type = a.key LEFT JOIN p b ON p_brand = b.key""")
def param_priority_lookup(spark, d):
    part = driver_table(spark, d, "part")
    by = lambda c, test: part.where(test).groupBy(F.col(c).alias("key")).agg(F.round(F.avg("p_retailprice"), 4).alias("gamma"))
    params = by("p_brand", "p_partkey % 3 = 0").unionByName(by("p_type", "p_partkey % 7 = 0 and p_size > 25"))
    return joins.priority_lookup(part.select("p_partkey", "p_type", "p_brand"), params, "p_type", "p_brand", "key", ["gamma"], {"gamma": 1.0}).select("p_partkey", "gamma", "matched")


@query(T + """, f AS (SELECT CAST(i AS INT) AS fold, 1704067200 + i * 518400 AS lo, 1704067200 + (i + 1) * 518400 - 1 AS hi FROM range(5) r(i))
  SELECT fold, CASE WHEN ts_sec BETWEEN lo AND hi THEN 'test' WHEN ts_sec + 3600 < lo OR ts_sec > hi + 7200 THEN 'train' ELSE 'purged' END AS role, count(*) AS n FROM t, f GROUP BY 1, 2""")
def purged_folds(spark, d):
    folds = spark.range(5).select(F.col("id").cast("int").alias("fold"), (F.lit(1_704_067_200) + F.col("id") * 518_400).alias("lo"), (F.lit(1_704_067_200) + (F.col("id") + 1) * 518_400 - 1).alias("hi"))
    rows = ticks(spark, d).select("ts_sec", (F.col("ts_sec") + 3600).alias("end"))
    return joins.purged_folds(rows, folds, "ts_sec", "end", 7200).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 500 = 0), s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
  SELECT day, CAST((SELECT min(d) FROM l WHERE d >= day) - day AS INT) AS days_to_next FROM s""")
def days_to_next_listed(spark, d):
    listed = driver_table(spark, d, "orders").where("o_orderkey % 500 = 0").select(F.col("o_orderdate").cast("date").alias("listed"))
    days = driver_table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return joins.next_listed(days, "day", listed, "listed")


@query(T + " SELECT user_id, symbol, event_id, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY ts_us, event_id) AS n FROM t) WHERE n = 1")
def dedup_first(spark, d):
    return joins.first_by(ticks(spark, d), ["user_id", "symbol"], ["ts_us", "event_id"]).select("user_id", "symbol", "event_id", "price")


# ---- labels and evaluation --------------------------------------------------------------


#: First touches within {h} seconds in the bar's own session (columns u, d), and the last bar ahead.
TOUCH = """, h AS (SELECT a.symbol, a.day, a.bar_ts, min(CASE WHEN z.close / a.close - 1 >= 0.5 THEN z.bar_ts END) AS u, min(CASE WHEN z.close / a.close - 1 <= -0.5 THEN z.bar_ts END) AS d, max(z.bar_ts) AS last
    FROM b a LEFT JOIN b z ON a.symbol = z.symbol AND a.day = z.day AND z.bar_ts > a.bar_ts AND z.bar_ts <= a.bar_ts + {h} GROUP BY 1, 2, 3),
  y AS (SELECT *, CASE WHEN last = bar_ts + {h} THEN CASE WHEN u < coalesce(d, 4611686018427387904) THEN 1 WHEN d < coalesce(u, 4611686018427387904) THEN -1 ELSE 0 END END AS label FROM h)"""


@query(T + HOURLY + TOUCH.format(h=43200) + " SELECT symbol, bar_ts, label, CASE WHEN last = bar_ts + 43200 AND u IS DISTINCT FROM d THEN least(coalesce(u, 4611686018427387904), coalesce(d, 4611686018427387904)) END AS touch_ts FROM y")
def triple_barrier(spark, d):
    return evaluate.triple_barrier(hourly(spark, d), ["symbol", "day"], "bar_ts", "close", 0.5, 0.5, 43_200, whole=True).drop("day")


IC = T + HOURLY + """, z AS (SELECT *, (close - avg(close) OVER w) AS sig, lead(close, 3) OVER (PARTITION BY symbol, day ORDER BY bar_ts) / nullif(close, 0) - 1 AS fwd FROM b WINDOW w AS (PARTITION BY symbol, day ORDER BY bar_ts ROWS 9 PRECEDING)),
  v AS (SELECT *, CAST(bar_ts // 86400 AS BIGINT) AS dayno FROM z WHERE fwd IS NOT NULL)"""


def _signals(spark, d):
    b = hourly(spark, d)
    b = b.withColumns({"sig": F.col("close") - BAR.rolling("avg", "close", 10), "fwd": evaluate.forward_return("close", 3, ["symbol", "day"], "bar_ts")})
    return b.where("fwd is not null").withColumn("dayno", F.floor(F.col("bar_ts") / 86_400))


@query(IC + """, k AS (SELECT *, rank() OVER (PARTITION BY symbol, dayno ORDER BY sig) + (count(*) OVER (PARTITION BY symbol, dayno, sig) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol, dayno ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, dayno, fwd) - 1) / 2 AS ry FROM v)
  SELECT symbol, dayno, round(CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END, 6) AS ic, round(avg(CASE WHEN sign(sig) = sign(fwd) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM k GROUP BY 1, 2""")
def forward_return_ic(spark, d):
    return evaluate.spearman(_signals(spark, d), ["symbol", "dayno"], "sig", "fwd").select("symbol", "dayno", r("ic").alias("ic"), r("hit_rate").alias("hit_rate"), "n")


@query(IC + """, c AS (SELECT symbol, dayno, sum(sign(sig) * fwd) AS gain, avg(fwd) AS score FROM v GROUP BY 1, 2), p AS (SELECT *, avg(score) OVER (PARTITION BY symbol ORDER BY dayno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_mean FROM c)
  SELECT dayno, arg_max(symbol, {'a': train_mean, 'b': symbol}) AS symbol, round(max(train_mean), 6) AS train_mean, round(arg_max(gain, {'a': train_mean, 'b': symbol}), 6) AS test_value FROM p WHERE train_mean IS NOT NULL GROUP BY 1""")
def walk_forward(spark, d):
    daily = _signals(spark, d).groupBy("symbol", "dayno").agg(F.sum(F.signum("sig") * F.col("fwd")).alias("gain"), F.avg("fwd").alias("score"))
    out = evaluate.walk_forward(daily, ["symbol"], "dayno", "score", "gain")
    return out.select("dayno", "symbol", r("train_mean").alias("train_mean"), r("test_value").alias("test_value"))


@query(RET + """ SELECT symbol, """ + ", ".join(f"round(corr(ret, l{k}), 6) AS acf_{k}" for k in (1, 2, 5)) + f""" FROM (SELECT symbol, ret, lag(ret, 1) OVER ({W}) AS l1, lag(ret, 2) OVER ({W}) AS l2, lag(ret, 5) OVER ({W}) AS l5 FROM q) GROUP BY 1""")
def autocorr_lags(spark, d):
    t = _returns(spark, d).withColumns({f"l{k}": TICK.lag("ret", k) for k in (1, 2, 5)})
    return t.groupBy("symbol").agg(*[r(F.corr("ret", f"l{k}")).alias(f"acf_{k}") for k in (1, 2, 5)])


@query(T + f", q AS (SELECT symbol, price - lag(price) OVER ({W}) AS r1, price - lag(price, 5) OVER ({W}) AS r5 FROM t) SELECT symbol, round(var_samp(r5) / (5 * var_samp(r1)), 6) AS variance_ratio_5 FROM q GROUP BY 1")
def variance_ratio(spark, d):
    t = ticks(spark, d).select("symbol", TICK.diff("price").alias("r1"), TICK.diff("price", 5).alias("r5"))
    return t.groupBy("symbol").agg(r(F.var_samp("r5") / (5 * F.var_samp("r1"))).alias("variance_ratio_5"))


@query(T + f""", v AS (SELECT symbol, price, stddev_samp(price) OVER ({W} ROWS 29 PRECEDING) AS sd FROM t), q AS (SELECT symbol, quantile_cont(sd, 1 / 3) AS a, quantile_cont(sd, 2 / 3) AS b FROM v GROUP BY 1)
  SELECT v.symbol, CASE WHEN sd < a THEN 'low' WHEN sd < b THEN 'mid' ELSE 'high' END AS regime, count(*) AS n, round(avg(price), 6) AS mean_price FROM v JOIN q ON v.symbol = q.symbol WHERE sd IS NOT NULL GROUP BY 1, 2""")
def vol_terciles(spark, d):
    v = ticks(spark, d).withColumn("sd", TICK.rolling("stddev_samp", "price", 30))
    q = exact_quantiles(v, ["symbol"], "sd", [1 / 3, 2 / 3], ["low", "high"])
    name = F.when(F.col("sd") < F.col("low"), "low").when(F.col("sd") < F.col("high"), "mid").otherwise("high")
    return v.join(q, "symbol").where("sd is not null").groupBy("symbol", name.alias("regime")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("price")).alias("mean_price"))


@query(T + """, m AS (SELECT symbol, avg(price) AS mu, count(*) AS n FROM t GROUP BY 1), c AS (SELECT t.symbol, any_value(n) AS n, avg(power(price - mu, 2)) AS m2, avg(power(price - mu, 3)) AS m3, avg(power(price - mu, 4)) AS m4 FROM t JOIN m ON t.symbol = m.symbol GROUP BY 1)
  SELECT symbol, n, round(m3 / power(m2, 1.5), 5) AS skew, round(m4 / (m2 * m2) - 3, 5) AS excess_kurtosis, round(n / 6 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 2) AS jarque_bera FROM c""")
def jarque_bera(spark, d):
    out = evaluate.jarque_bera(ticks(spark, d), ["symbol"], "price")
    return out.select("symbol", "n", r("skew", 5).alias("skew"), r("excess_kurtosis", 5).alias("excess_kurtosis"), r("jarque_bera", 2).alias("jarque_bera"))


@query(T + """, n AS (SELECT symbol, day, qty, price, (row_number() OVER (PARTITION BY symbol, day ORDER BY ts_us, event_id) - 1) // 20 AS chunk FROM t)
  SELECT a.symbol, a.day, a.chunk, count(*) AS slopes, round(quantile_cont((b.price - a.price) / (b.qty - a.qty), 0.5), 6) AS theil_sen FROM n a JOIN n b ON a.symbol = b.symbol AND a.day = b.day AND a.chunk = b.chunk AND a.qty < b.qty GROUP BY 1, 2, 3""")
def theil_sen(spark, d):
    n = ticks(spark, d).withColumn("chunk", F.floor((F.row_number().over(TICK.w) - 1) / 20))
    return evaluate.theil_sen(n, ["symbol", "day"], "qty", "price", "chunk").where("slopes > 0").select("symbol", "day", "chunk", "slopes", r("theil_sen").alias("theil_sen"))


# ---- fills, costs, rankings -------------------------------------------------------------


def _cost_sql() -> str:
    cases = []
    for kind, (sale, ex, reg, stamp, flat) in scalar.COSTS.items():
        fees = f"({flat} + v * {ex:.8f} + v * {reg:.8f})"
        cases.append(f"WHEN kind = '{kind}' THEN {fees} * (1 + {scalar.SERVICE_TAX}) + CASE WHEN side = 'SELL' THEN v * {sale!r} ELSE 0.0 END + CASE WHEN side = 'BUY' THEN v * {stamp:.8f} ELSE 0.0 END")
    return FILLS + ", c AS (SELECT side, qty * price AS v, CASE l_linenumber % 4 WHEN 0 THEN 'equity_futures' WHEN 1 THEN 'currency_futures' WHEN 2 THEN 'equity_options' ELSE 'currency_options' END AS kind FROM f) SELECT kind, side, count(*) AS n, round(CAST(sum(CASE " + " ".join(cases) + " END) AS DOUBLE), 2) AS cost FROM c GROUP BY 1, 2"


@query(_cost_sql())
def transaction_costs(spark, d):
    m = F.col("l_linenumber") % 4
    kind = F.when(m == 0, "equity_futures").when(m == 1, "currency_futures").when(m == 2, "equity_options").otherwise("currency_options")
    f = fills(spark, d).select("side", (F.col("qty") * F.col("price")).alias("v"), kind.alias("kind"))
    return f.groupBy("kind", "side").agg(F.count(F.lit(1)).alias("n"), r(F.sum(scalar.transaction_cost(F.col("kind"), F.col("side"), F.col("v"))), 2).alias("cost"))


@query(FILLS + """, g AS (SELECT l_suppkey, day, l_orderkey, l_linenumber, CASE WHEN side = 'SELL' THEN qty ELSE -qty END AS gain FROM f), c AS (SELECT *, sum(gain) OVER w AS cum FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY day, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT *, greatest(max(cum) OVER (PARTITION BY l_suppkey ORDER BY day, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING), 0) AS peak FROM c)
  SELECT l_suppkey, CAST(sum(gain) AS BIGINT) AS net, count(*) FILTER (gain > 0) AS wins, count(*) FILTER (gain < 0) AS losses, CAST(max(peak - cum) AS DOUBLE) AS max_drawdown, round(avg(gain) / nullif(stddev_samp(gain), 0) * sqrt(252), 5) AS sharpe FROM p GROUP BY 1""")
def drawdown(spark, d):
    g = fills(spark, d).withColumn("gain", F.when(F.col("side") == "SELL", F.col("qty")).otherwise(-F.col("qty")))
    out = evaluate.drawdown(g, ["l_suppkey"], ["day", "l_orderkey", "l_linenumber"], "gain")
    return out.withColumn("sharpe", r("sharpe", 5))


@query(FILLS + """, c AS (SELECT l_partkey, side, price, qty, sum(qty) OVER (PARTITION BY l_partkey, side ORDER BY day, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS e FROM f),
  x AS (SELECT b.l_partkey, least(b.e, s.e) - greatest(b.e - b.qty, s.e - s.qty) AS n, s.price - b.price AS g FROM c b JOIN c s ON b.l_partkey = s.l_partkey AND b.side = 'BUY' AND s.side = 'SELL' AND b.e - b.qty < s.e AND s.e - s.qty < b.e)
  SELECT l_partkey, CAST(sum(n) AS BIGINT) AS matched_qty, round(sum(n * g), 7) AS realised FROM x GROUP BY 1""")
def fifo_match(spark, d):
    out = evaluate.fifo_match(fills(spark, d), ["l_partkey"], ["day", "l_orderkey", "l_linenumber"], "side", "qty", "price")
    return out.select("l_partkey", "matched_qty", r("realised", 7).alias("realised"))


@query("""SELECT o_custkey, net, rank FROM (SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, row_number() OVER (ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, o_custkey) AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) WHERE rank <= 20""")
def topk_symbols(spark, d):
    l, o = driver_table(spark, d, "lineitem"), driver_table(spark, d, "orders")
    net = l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"))
    top = net.orderBy(F.col("net").desc(), "o_custkey").limit(20)  # a top-k report
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("net").desc(), "o_custkey")))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part) SELECT p_brand, p_partkey, p_size, n FROM p WHERE n <= 2""")
def nearest_expiries(spark, d):
    p = driver_table(spark, d, "part").withColumn("n", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size"))).where("n <= 2")
    return p.select("p_brand", "p_partkey", "p_size", "n")


@query("SELECT p_brand, min(p_size) AS front_size, arg_min(p_partkey, {'a': p_size, 'b': p_partkey}) AS front_part FROM part GROUP BY 1")
def front_contract(spark, d):
    return driver_table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("front_size"), F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("front_part"))


@query("""WITH m AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_totalprice FROM orders) SELECT day, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS f_mean, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS o_mean
  FROM m GROUP BY 1 HAVING f_mean IS NOT NULL AND o_mean IS NOT NULL""")
def pivot_state(spark, d):
    o = driver_table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    p = o.groupBy("day").pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.avg("o_totalprice"), 6))
    return p.withColumnsRenamed({"F": "f_mean", "O": "o_mean"}).dropna(subset=["f_mean", "o_mean"])


@query(T + """, g AS (SELECT w, k FROM (VALUES (5), (10), (20)) a(w), (VALUES (1.0), (1.5), (2.0)) b(k)), s AS (SELECT symbol, day, price, row_number() OVER (PARTITION BY symbol, day ORDER BY ts_us, event_id) AS n FROM t),
  x AS (SELECT symbol, w, k, day, sum(CASE WHEN n % w = 0 THEN price * k ELSE -price / w END) AS score FROM s, g GROUP BY 1, 2, 3, 4), m AS (SELECT symbol, w, CAST(k AS DOUBLE) AS k, avg(score) AS mean_score FROM x GROUP BY 1, 2, 3)
  SELECT symbol, w, k, round(mean_score, 4) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(mean_score, 4) DESC, w, k) AS r FROM m) WHERE r = 1""")
def param_grid_best(spark, d):
    s = ticks(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts_us", "event_id")))
    combos = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w in (5, 10, 20) for k in (1.0, 1.5, 2.0)])
    x = s.withColumn("c", F.explode(combos)).select("symbol", "day", "price", "n", "c.w", "c.k")
    score = F.sum(F.when(F.col("n") % F.col("w") == 0, F.col("price") * F.col("k")).otherwise(-F.col("price") / F.col("w")))
    m = x.groupBy("symbol", "w", "k", "day").agg(score.alias("score")).groupBy("symbol", "w", "k").agg(r(F.avg("score"), 4).alias("mean_score"))
    return joins.first_by(m, ["symbol"], [F.col("mean_score").desc(), "w", "k"])
