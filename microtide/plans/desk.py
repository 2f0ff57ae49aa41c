"""Queries of instrument bars, spot prices, validated merges, option scalars, pair rules and contract rolls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from microtide.functions import scalar
from microtide.operators import desk, evaluate, joins
from microtide.plans.market import HOURLY, TICK, W, hourly, r, ticks
from microtide.plans.market import T as TICKS
from microtide.plans.reference_data import _phi, options
from microtide.plans.registry import query
from microtide.sources.tables import driver_table

AT = "{'a': ts_us, 'b': event_id}"
#: Ticks with the day's cumulative volume, and their hourly bars.
CUM = TICKS + f""", c AS (SELECT *, CAST(sum(qty) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS volume FROM t),
  b AS (SELECT symbol, day, ts_sec - ts_sec % 3600 AS bar_ts, arg_min(price, {AT}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {AT}) AS close, arg_max(volume, {AT}) - arg_min(volume, {AT}) AS volume_delta, arg_max(volume, {AT}) AS volume_last,
    count(*) AS tick_count, avg(price) AS price_mean, stddev_samp(price) AS price_std FROM c WHERE price > 0 GROUP BY 1, 2, 3)"""


def _bars(spark, d):
    t = ticks(spark, d).withColumn("volume", F.sum("qty").over(TICK.so_far()))
    return desk.instrument_bars(t, ["symbol", "day"], "ts_sec", ["ts_us", "event_id"], "price", "volume", 3600)


@query(CUM + " SELECT symbol, bar_ts, open, high, low, close, volume_delta, tick_count, round(price_mean, 6) AS price_mean, round(price_std, 6) AS price_std FROM b")
def volume_delta_bars(spark, d):
    return _bars(spark, d).select("symbol", "bar_ts", "open", "high", "low", "close", "volume_delta", "tick_count", r("price_mean").alias("price_mean"), r("price_std").alias("price_std"))


@query(CUM + " SELECT symbol, bar_ts, open, high, low, close, volume_last FROM b")
def option_bars(spark, d):
    return _bars(spark, d).select("symbol", "bar_ts", "open", "high", "low", "close", "volume_last")


#: Spot is what user 0 to 9 of a group buy, the fallback what they view; a group and day without spot takes the fallback.
SPOT = TICKS + f""", s AS (SELECT user_id % 10 AS underlying, day, ts_sec, ts_us, event_id, price, CASE WHEN symbol = 'purchase' AND user_id % 3 = 0 THEN 0 WHEN symbol = 'view' THEN 1 END AS rank FROM t WHERE price > 0),
  k AS (SELECT *, min(rank) OVER (PARTITION BY underlying, day) AS best FROM s WHERE rank IS NOT NULL), p AS (SELECT underlying, day, ts_sec, arg_max(price, {AT}) AS spot_price, best AS rank FROM k WHERE rank = best GROUP BY underlying, day, ts_sec, best)"""


def _spot(spark, d):
    rank = F.when((F.col("symbol") == "purchase") & (F.col("user_id") % 3 == 0), 0).when(F.col("symbol") == "view", 1)
    t = ticks(spark, d).withColumn("underlying", F.col("user_id") % 10)
    return desk.spot_prices(t, ["underlying", "day"], "ts_sec", ["ts_us", "event_id"], "price", rank)


@query(SPOT + " SELECT underlying, ts_sec, spot_price, rank FROM p")
def spot_prices(spark, d):
    return _spot(spark, d).select("underlying", "ts_sec", "spot_price", "rank")


@query(SPOT + """, o AS (SELECT event_id, user_id % 10 AS underlying, day, ts_sec FROM t WHERE symbol = 'click'), m AS (SELECT o.event_id, o.underlying, o.day, o.ts_sec, p.spot_price AS s FROM o LEFT JOIN p ON o.underlying = p.underlying AND o.day = p.day AND o.ts_sec - o.ts_sec % 600 = p.ts_sec - p.ts_sec % 600 QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY p.ts_sec DESC) = 1)
  SELECT event_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY underlying, day ORDER BY ts_sec, event_id ROWS UNBOUNDED PRECEDING), first_value(s IGNORE NULLS) OVER (PARTITION BY underlying, day ORDER BY ts_sec, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS spot FROM m""")
def spot_joined_bars(spark, d):
    """Options with the spot of their ten minutes, gaps filled forward and, at a day's start, backward."""
    slot = lambda: F.col("ts_sec") - F.pmod("ts_sec", F.lit(600))
    spot = _spot(spark, d).withColumn("slot", slot()).groupBy("underlying", "day", "slot").agg(F.max_by("spot_price", "ts_sec").alias("s"))
    o = ticks(spark, d).where("symbol = 'click'").select("event_id", (F.col("user_id") % 10).alias("underlying"), "day", "ts_sec").withColumn("slot", slot())
    m = o.join(spot, ["underlying", "day", "slot"], "left")
    m = m.withColumn("at", F.struct("ts_sec", "event_id"))
    return desk.fill_both_ways(m, ["underlying", "day"], "at", "s").select("event_id", F.col("s").alias("spot"))


@query(TICKS + HOURLY + f""", v AS (SELECT symbol, bar_ts, stddev_samp(close) OVER (PARTITION BY symbol, day ORDER BY bar_ts ROWS 5 PRECEDING) AS vol FROM b) SELECT b.symbol, b.bar_ts, close, round(vol, 6) AS vol FROM b JOIN v ON b.symbol = v.symbol AND b.bar_ts = v.bar_ts""")
def validated_merge(spark, d):
    """Two feature frames of the same bars, joined only if their keys are unique."""
    from microtide.plans.market import BAR

    b = hourly(spark, d)
    vol = b.select("symbol", "bar_ts", r(BAR.rolling("stddev_samp", "close", 6)).alias("vol"))
    return desk.merge_one_to_one(b.select("symbol", "bar_ts", "close"), vol, ["symbol", "bar_ts"])


_RAW = ", ".join(f"CASE WHEN event_id % {11 + i} = 0 THEN NULL ELSE price + 1 - 0.01e0 * {i} END AS bp{i + 1}, CASE WHEN event_id % 19 = 0 THEN price ELSE price + 1.02e0 + 0.01e0 * {i} END AS ap{i + 1}, CASE WHEN event_id % {23 + i} = 0 THEN -qty ELSE qty END AS bq{i + 1}, qty + {i} AS aq{i + 1}" for i in range(5))
_CELLS = [f"{p}{i}" for p in ("bp", "ap", "bq", "aq") for i in range(1, 6)]


@query(TICKS + f""", k AS (SELECT symbol, day, ts_sec - ts_sec % 1800 AS ts, event_id, {_RAW} FROM t), c AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts) AS gap FROM k)
  SELECT symbol, count(*) AS rows, count(*) FILTER (gap = 0) AS repeated, count(*) FILTER (gap != 1800 AND gap != 0) AS off_grid, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in _CELLS)}) AS missing, count(*) FILTER ({' OR '.join(f'{c} < 0' for c in _CELLS)}) AS negative,
    count(*) FILTER ({' AND '.join(f'{c} > 0' if c[1] == 'p' else f'{c} >= 0' for c in _CELLS)} AND ap1 >= bp1) AS valid_books FROM c GROUP BY 1""")
def book_violations(spark, d):
    """The book contract over ticks that break it: repeated and missing times, nulls, negative quantities, crossed books."""
    from microtide.operators import book
    from microtide.operators.windows import Series

    i, p, q, cols = F.col("event_id"), F.col("price"), F.col("qty"), {}
    for n in range(5):
        cols |= {f"bp{n + 1}": F.when(i % (11 + n) != 0, p + 1 - 0.01 * n), f"ap{n + 1}": F.when(i % 19 == 0, p).otherwise(p + 1.02 + 0.01 * n), f"bq{n + 1}": F.when(i % (23 + n) == 0, -q).otherwise(q), f"aq{n + 1}": q + n}
    k = ticks(spark, d).withColumn("ts", F.col("ts_sec") - F.pmod("ts_sec", F.lit(1800))).withColumns(cols)
    return book.checks(k, ["symbol"], Series(["symbol", "day"], "ts"), "ts", 1800)


OPT = "WITH o AS (SELECT p_partkey, p_partkey % 2 = 0 AS call, 100.0 + p_size AS k, 120.0 AS s, 0.05 + (p_size % 10) * 0.1 AS t, 0.1 + (p_partkey % 40) * 0.01 AS v FROM part)"


@query(OPT + f""", e AS (SELECT *, (ln(s / k) + (0.07 + v * v / 2) * t) / (v * sqrt(t)) AS d1, CASE WHEN call THEN 1.0 ELSE -1.0 END AS g FROM o), x AS (SELECT *, g * (d1 - v * sqrt(t)) AS b FROM e)
  SELECT p_partkey, round((s - k) / s, 6) AS moneyness, round((-s * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * v / (2 * sqrt(t)) - g * 0.07 * k * exp(-0.07 * t) * {_phi('b')}) / 365, 7) AS theta FROM x""")
def option_theta(spark, d):
    o = options(spark, d)
    call, s, k, t, v = (F.col(c) for c in ("call", "s", "k", "t", "v"))
    return o.select("p_partkey", r(desk.moneyness(s, k)).alias("moneyness"), r(scalar.bs_greeks(call, s, k, t, 0.07, v)["theta"], 7).alias("theta"))


@query()
def implied_vol_newton(spark, d):
    """Every option's volatility from its price, in the money or not; tested against a plain Newton loop."""
    o = options(spark, d)
    call, s, k, t, v = (F.col(c) for c in ("call", "s", "k", "t", "v"))
    o = o.withColumn("price", F.round(scalar.bs_price(call, s, k, t, 0.065, v), 4))
    return o.select("p_partkey", r(desk.implied_vol_newton(call, F.col("price"), s, k, t), 4).alias("iv"))


@query(TICKS + HOURLY + """, p AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_ts, x.close - y.close AS s FROM b x JOIN b y ON x.bar_ts = y.bar_ts AND x.symbol < y.symbol), g AS (SELECT a, b, count(*) AS n, stddev_samp(s) AS sd, avg(s) AS m FROM p GROUP BY 1, 2)
  SELECT a, b, CASE WHEN n % 7 * 300 < 30 THEN 'half_life too fast' WHEN n % 7 * 300 > 1800 THEN 'half_life too slow' WHEN sd < 2 THEN 'spread too small' WHEN n % 9 < 5 THEN 'few signals' WHEN m <= 0 THEN 'negative hedge' ELSE 'ok' END AS verdict FROM g""")
def pair_rules(spark, d):
    p = joins.align_pairs(hourly(spark, d), "symbol", "bar_ts", "close")
    s = F.col("value_a") - F.col("value_b")
    g = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(s).alias("sd"), F.avg(s).alias("m"))
    return g.select("a", "b", desk.tradeable(F.col("n") % 7 * 300, F.col("sd"), F.col("n") % 9, F.col("m")).alias("verdict"))


@query(TICKS + HOURLY + """, z AS (SELECT symbol, (qty_ % 100) / 50.0 - 1 AS sig, lead(close, 3) OVER (PARTITION BY symbol, day ORDER BY bar_ts) / close - 1 AS fwd FROM (SELECT *, volume AS qty_ FROM b))
  SELECT symbol, count(*) FILTER (abs(sig) > 0.2 AND fwd IS NOT NULL) AS n_signals, round(100 * avg(CASE WHEN abs(sig) > 0.2 THEN 1.0 ELSE 0 END), 4) AS pct_active, round(100 * count(*) FILTER (abs(sig) > 0.2 AND sign(sig) = sign(fwd)) / count(*) FILTER (abs(sig) > 0.2 AND fwd IS NOT NULL), 4) AS hit_rate_pct FROM z GROUP BY 1 HAVING count(*) FILTER (abs(sig) > 0.2 AND fwd IS NOT NULL) >= 50""")
def signal_hit_rate(spark, d):
    b = hourly(spark, d).withColumns({"sig": (F.col("volume") % 100) / 50.0 - 1, "fwd": evaluate.forward_return("close", 3, ["symbol", "day"], "bar_ts")})
    out = desk.hit_rate(b, ["symbol"], "sig", "fwd")
    return out.select("symbol", "n_signals", r("pct_active", 4).alias("pct_active"), r("hit_rate_pct", 4).alias("hit_rate_pct"))


@query(TICKS + f""", s AS (SELECT symbol, h, price - avg(price) OVER ({W} ROWS 9 PRECEDING) AS sig, lead(price, CAST(h AS INTEGER)) OVER ({W.replace('PARTITION BY symbol', 'PARTITION BY h, symbol')}) - price AS fwd FROM t, range(1, 6) r(h)),
  c AS (SELECT symbol, h, abs(corr(sig, fwd)) AS ic FROM s WHERE fwd IS NOT NULL GROUP BY 1, 2), f AS (SELECT symbol, count(*) AS n, exp(regr_intercept(ln(ic), h)) AS ic0, -regr_slope(ln(ic), h) AS rate FROM c WHERE ic > 0 GROUP BY 1)
  SELECT c.symbol, round(any_value(ic0), 6) AS ic0, round(any_value(rate), 6) AS decay_rate, round(max(ic), 6) AS peak_ic FROM c JOIN f ON c.symbol = f.symbol GROUP BY 1""".replace(f"OVER ({W} ROWS 9 PRECEDING)", f"OVER ({W.replace('PARTITION BY symbol', 'PARTITION BY h, symbol')} ROWS 9 PRECEDING)"))
def ic_decay(spark, d):
    """How fast the size of a signal's correlation falls with the horizon, in ticks."""
    t = ticks(spark, d).withColumn("sig", F.col("price") - TICK.rolling("avg", "price", 10))
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), (TICK.lead("price", h) - F.col("price")).alias("fwd")) for h in range(1, 6)])
    t = t.withColumn("ahead", ahead).select("symbol", "sig", F.explode("ahead").alias("e")).select("symbol", "sig", "e.h", "e.fwd").where("fwd is not null")
    ics = t.groupBy("symbol", "h").agg(F.abs(evaluate.correlation("sig", "fwd")).alias("ic"))
    out = desk.ic_decay(ics, ["symbol"], "h", "ic")
    return out.select("symbol", r("ic0").alias("ic0"), r("decay_rate").alias("decay_rate"), r("peak_ic").alias("peak_ic"))


@query("""WITH f AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS up, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS down FROM lineitem),
  e AS (SELECT l_suppkey, quantile_cont(price, 0.5) FILTER (up <= 100) AS a, quantile_cont(price, 0.5) FILTER (down <= 100) AS z FROM f GROUP BY 1)
  SELECT s_suppkey AS old_key, s_suppkey + 1 AS new_key, round(CASE WHEN n.a IS NOT NULL AND o.z IS NOT NULL THEN greatest(0.7, least(1.3, n.a / o.z)) ELSE 1.0 END, 6) AS price_ratio FROM supplier LEFT JOIN e o ON s_suppkey = o.l_suppkey LEFT JOIN e n ON s_suppkey + 1 = n.l_suppkey""")
def contract_price_ratio(spark, d):
    li = driver_table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    pairs = driver_table(spark, d, "supplier").select(F.col("s_suppkey").alias("old_key"), (F.col("s_suppkey") + 1).alias("new_key"))
    out = desk.price_ratio(li, "l_suppkey", ["l_orderkey", "l_linenumber"], "price", pairs, "old_key", "new_key")
    return out.select("old_key", "new_key", r("price_ratio").alias("price_ratio"))


@query("""SELECT o_orderkey, CAST(date_diff('day', DATE '1995-06-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_until FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1995-06-11' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def upcoming_events(spark, d):
    o = driver_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("date"))
    c = driver_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return desk.upcoming(o, c, "c_custkey", "date", F.lit("1995-06-01").cast("date"), 10).select("o_orderkey", "days_until")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, d):
    by = driver_table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy())))  # one row per type


#: File names of contracts made from parts: futures and options of six bases over a few days.
FILES = """WITH f AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'NIFTY' WHEN 1 THEN 'BANKNIFTY' WHEN 2 THEN 'USDINR' WHEN 3 THEN 'NIFTYNXT50' WHEN 4 THEN 'RELIANCE' ELSE 'TCS' END || '26' || CASE p_size % 3 WHEN 0 THEN 'MAY' WHEN 1 THEN 'JUN' ELSE 'JAN' END || CASE p_partkey % 4 WHEN 0 THEN 'FUT' WHEN 1 THEN CAST(p_size * 100 AS VARCHAR) || 'CE' WHEN 2 THEN CAST(p_size * 100 AS VARCHAR) || 'PE' ELSE 'FUT' END AS symbol, '2026-05-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS date FROM part)"""


def _files(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    pick = lambda x, names: F.element_at(F.array(*map(F.lit, names)), (x % len(names) + 1).cast("int"))
    base = pick(k, ["NIFTY", "BANKNIFTY", "USDINR", "NIFTYNXT50", "RELIANCE", "TCS"])
    strike = (z * 100).cast("string")
    kind = F.when(k % 4 == 1, F.concat(strike, F.lit("CE"))).when(k % 4 == 2, F.concat(strike, F.lit("PE"))).otherwise("FUT")
    date = F.concat(F.lit("2026-05-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    return driver_table(spark, d, "part").select(F.concat(base, F.lit("26"), pick(z, ["MAY", "JUN", "JAN"]), kind).alias("symbol"), date.alias("date"))


@query(FILES + """ SELECT CASE WHEN starts_with(symbol, 'BANKNIFTY') THEN 'BANKNIFTY' ELSE 'NIFTY' END AS underlying, date FROM f WHERE (ends_with(symbol, 'CE') OR ends_with(symbol, 'PE')) AND (starts_with(symbol, 'BANKNIFTY') OR starts_with(symbol, 'NIFTY') AND NOT starts_with(symbol, 'NIFTYNXT'))
  EXCEPT SELECT 'NIFTY', date FROM f WHERE symbol LIKE 'TCS%'""")
def pending_option_jobs(spark, d):
    f = _files(spark, d)
    done = f.where("symbol like 'TCS%'").select(F.lit("NIFTY").alias("underlying"), "date").distinct()
    return desk.option_jobs(f, done)


@query(FILES + " SELECT regexp_replace(symbol, '[0-9]{2}[A-Z]{3}FUT$', '') AS base, max(symbol) AS symbol FROM f WHERE regexp_matches(symbol, '[0-9]{2}[A-Z]{3}FUT$') AND date BETWEEN '2026-05-03' AND '2026-05-20' GROUP BY 1")
def best_contracts(spark, d):
    return desk.best_contracts(_files(spark, d), "symbol", "date", "2026-05-03", "2026-05-20")


@query(FILES + """, e AS (SELECT CASE WHEN symbol NOT LIKE '%USDINR%' THEN nullif(regexp_replace(symbol, '[0-9]{2}[A-Z]{3}FUT$', ''), '') END AS equity, date FROM f), x AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'RELIANCE' WHEN 1 THEN 'TCS' ELSE 'INFY' END AS equity, count(*) AS events FROM supplier GROUP BY 1)
  SELECT e.equity, date, count(*) AS n_files, any_value(events) AS events FROM e JOIN x ON e.equity = x.equity GROUP BY 1, 2""")
def equity_events(spark, d):
    """Events of the equity behind each contract file."""
    s = F.col("s_suppkey") % 3
    x = driver_table(spark, d, "supplier").groupBy(F.when(s == 0, "RELIANCE").when(s == 1, "TCS").otherwise("INFY").alias("equity")).agg(F.count(F.lit(1)).alias("events"))
    f = _files(spark, d).withColumn("equity", desk.equity_key(F.col("symbol")))
    return f.join(x, "equity").groupBy("equity", "date").agg(F.count(F.lit(1)).alias("n_files"), F.first("events").alias("events"))


@query(TICKS + " SELECT user_id, event_id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, event_id DESC) AS n FROM t) WHERE n <= 5")
def recent_rows(spark, d):
    return desk.recent_rows(ticks(spark, d), ["user_id"], ["ts_us", "event_id"], 5).select("user_id", "event_id", "symbol")


@query(TICKS + f""", l AS (SELECT *, ln(price) - lag(ln(price)) OVER ({W}) AS lr FROM t WHERE price > 0) SELECT event_id, round(coalesce(var_pop(lr) OVER ({W} ROWS 18 PRECEDING), 0), 6) AS realized_var, round(sqrt(coalesce(var_pop(lr) OVER ({W} ROWS 18 PRECEDING), 0) * 22500), 4) AS annualized_vol,
  round(CASE WHEN count(lr) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN var_samp(lr) OVER ({W} ROWS 19 PRECEDING) END, 6) AS rolling_var FROM l""")
def realized_variance(spark, d):
    out = desk.realized_variance(ticks(spark, d).where("price > 0"), ["symbol", "day"], TICK.order, "price")
    return out.select("event_id", r("realized_var").alias("realized_var"), r("annualized_vol", 4).alias("annualized_vol"), r("rolling_var").alias("rolling_var"))
