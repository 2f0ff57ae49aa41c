"""Queries of scalar functions, calendars, set operations, news and signal reductions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from microtide.functions import scalar
from microtide.operators import joins
from microtide.operators.quantiles import exact_quantiles
from microtide.plans.market import HOURLY, T, TICK, W, fills, hourly, r, ticks
from microtide.plans.registry import query
from microtide.sources.tables import driver_table


@query(T + """ SELECT event_id, ts_sec, CAST((ts_sec + 19800) % 86400 AS BIGINT) AS ist_sec, (ts_sec + 19800) % 86400 BETWEEN 33300 AND 55800 AS in_session,
  CASE WHEN (ts_sec + 19800) % 86400 < 35100 THEN 'open' WHEN (ts_sec + 19800) % 86400 < 52200 THEN 'midday' ELSE 'close' END AS label,
  lpad(CAST((ts_sec + 19800) % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((ts_sec + 19800) % 3600 // 60 AS VARCHAR), 2, '0') AS hhmm FROM t""")
def session_filter(spark, d):
    c = F.col("ts_sec")
    return ticks(spark, d).select("event_id", "ts_sec", scalar.ist_second(c).alias("ist_sec"), scalar.in_session(c, F.col("symbol")).alias("in_session"), scalar.session_label(c).alias("label"), scalar.hhmm(c).alias("hhmm"))


BOOK = """, k AS (SELECT *, price - 0.01 * (1 + qty % 7) AS bid, price + 0.01 * (1 + qty % 5) AS ask, qty AS bq, 101 - qty AS aq FROM t)"""


def book(spark, d):
    q = F.col("qty")
    return ticks(spark, d).withColumns({"bid": F.col("price") - 0.01 * (1 + q % 7), "ask": F.col("price") + 0.01 * (1 + q % 5), "bq": q, "aq": 101 - q})


@query(T + BOOK + """ SELECT event_id, round((bid * aq + ask * bq) / nullif(bq + aq, 0), 8) AS wmid, round((ask - bid) * 10000 / nullif((ask + bid) / 2, 0), 6) AS spread_bps, round((bq - aq) / (bq + aq), 8) AS imbalance,
  round(sign(bq - aq) * ln(1 + abs(bq - aq)), 8) AS slog FROM k""")
def weighted_mid(spark, d):
    b, a, x, y = (F.col(c) for c in ("bid", "ask", "bq", "aq"))
    return book(spark, d).select("event_id", r(scalar.weighted_mid(b, a, x, y), 8).alias("wmid"), r(scalar.spread_bps(b, a)).alias("spread_bps"), r((x - y) / (x + y), 8).alias("imbalance"), r(scalar.signed_log(x - y), 8).alias("slog"))


@query(T + BOOK + f""", l AS (SELECT *, lag(bid) OVER ({W}) AS b0, lag(ask) OVER ({W}) AS a0, lag(bq) OVER ({W}) AS q0, lag(aq) OVER ({W}) AS r0 FROM k)
  SELECT event_id, CAST(CASE WHEN bid >= b0 THEN bq ELSE 0 END - CASE WHEN bid <= b0 THEN q0 ELSE 0 END - CASE WHEN ask <= a0 THEN aq ELSE 0 END + CASE WHEN ask >= a0 THEN r0 ELSE 0 END AS BIGINT) AS ofi_event,
    CAST((bq - q0) * sign(bid - b0) - (aq - r0) * sign(ask - a0) AS DOUBLE) AS ofi_delta FROM l WHERE b0 IS NOT NULL""")
def order_flow_imbalance(spark, d):
    k = book(spark, d).withColumns({"b0": TICK.lag("bid"), "a0": TICK.lag("ask"), "q0": TICK.lag("bq"), "r0": TICK.lag("aq")}).where("b0 is not null")
    c = F.col
    part = lambda test, v: F.when(test, c(v)).otherwise(0)
    event = part(c("bid") >= c("b0"), "bq") - part(c("bid") <= c("b0"), "q0") - part(c("ask") <= c("a0"), "aq") + part(c("ask") >= c("a0"), "r0")
    delta = (c("bq") - c("q0")) * F.signum(c("bid") - c("b0")) - (c("aq") - c("r0")) * F.signum(c("ask") - c("a0"))
    return k.select("event_id", event.cast("long").alias("ofi_event"), r(delta).alias("ofi_delta"))


DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"


@query(f"""WITH s AS ({DAYS}) SELECT d, CAST(last_day(d) - CAST(greatest((dayofweek(last_day(d)) + 6) % 7 - 4, 0) AS INT) AS DATE) AS last_business, CAST(last_day(d) - CAST(((dayofweek(last_day(d)) + 6) % 7 - 3 + 7) % 7 AS INT) AS DATE) AS last_thursday,
  upper(strftime(d, '%y%b')) || 'FUT' AS contract, round(greatest((last_day(d) - d) / 365, 1 / 365), 10) AS tte FROM s""")
def contract_calendar(spark, d):
    day = F.col("d")
    s = driver_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return s.select("d", scalar.last_business_day(day).alias("last_business"), scalar.last_weekday(day).alias("last_thursday"), scalar.contract_code(day).alias("contract"), r(scalar.years_to_expiry(day, F.last_day(day)), 10).alias("tte"))


SYMBOLS = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NIFTY26MAY' || CAST(p_size * 50 AS VARCHAR) || 'CE' WHEN 1 THEN 'USDINR25OCT' || CAST(p_size AS VARCHAR) || '.5PE' ELSE 'BANKNIFTY26JANFUT' END AS s FROM part"""


@query(f"""WITH p AS ({SYMBOLS}), x AS (SELECT *, regexp_extract(s, '^([A-Z&-]+?)([0-9]{{2}})({scalar.MONTHS})([0-9]+(?:\\.[0-9]+)?)(CE|PE)$', ['u', 'y', 'm', 'k', 't']) AS g FROM p)
  SELECT p_partkey, s AS symbol, nullif(g.u, '') AS underlying, CAST(nullif(g.y, '') AS INT) AS yy, nullif(g.m, '') AS mon, CAST(nullif(g.k, '') AS DOUBLE) AS strike, nullif(g.t, '') AS opt_type,
    regexp_replace(s, '[0-9]{{2}}({scalar.MONTHS})FUT$', '', 'i') AS base, CASE WHEN s LIKE '%CE' OR s LIKE '%PE' THEN 'option' WHEN s LIKE '%INR%' THEN 'currency' WHEN s LIKE '%FUT' THEN 'future' ELSE 'equity' END AS kind FROM x""")
def symbol_parse(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    s = F.when(k == 0, F.concat(F.lit("NIFTY26MAY"), (size * 50).cast("string"), F.lit("CE"))).when(k == 1, F.concat(F.lit("USDINR25OCT"), size.cast("string"), F.lit(".5PE"))).otherwise("BANKNIFTY26JANFUT")
    p = driver_table(spark, d, "part").select("p_partkey", s.alias("symbol"))
    return p.withColumn("o", scalar.option_parts(F.col("symbol"))).select("p_partkey", "symbol", "o.*", scalar.base_symbol(F.col("symbol")).alias("base"), scalar.instrument_class(F.col("symbol")).alias("kind"))


NEWS = ("Quarterly results due", "Interim dividend", "Board meeting", "Stock split 1:5", "Merger approved", "Annual general meeting", "Plant visit", "Rights issue of shares", "Q3 call")
NEWS_SQL = "SELECT o_orderkey, ['" + "', '".join(NEWS) + "'][1 + o_orderkey % 9] AS headline, CAST(o_orderkey % 10 AS INT) AS days FROM orders"


@query(f"""WITH n AS ({NEWS_SQL}), u AS (SELECT *, upper(headline) AS h FROM n),
  e AS (SELECT *, CASE WHEN regexp_matches(h, 'RESULT|EARNING|FINANCIAL|QUARTERLY|Q1|Q2|Q3|Q4') THEN 'EARNINGS' WHEN regexp_matches(h, 'DIVIDEND|INTERIM DIV|FINAL DIV') THEN 'DIVIDEND' WHEN regexp_matches(h, 'BOARD MEETING|BOARD MTG') THEN 'BOARD_MEETING' WHEN regexp_matches(h, 'AGM|EGM|ANNUAL GENERAL') THEN 'AGM'
    WHEN regexp_matches(h, 'BONUS|SPLIT|SUBDIVISION') THEN 'BONUS_SPLIT' WHEN regexp_matches(h, 'RIGHTS|RIGHT ISSUE') THEN 'RIGHTS_ISSUE' WHEN regexp_matches(h, 'MERGER|AMALGAMATION|ACQUISITION|TAKEOVER') THEN 'MERGER_ACQUIRE' ELSE 'OTHER' END AS kind FROM u),
  v(k, upto, action, factor, pause) AS (VALUES ('EARNINGS', 0, 'PAUSE', 3.0, 120), ('EARNINGS', 1, 'WIDEN', 2.0, 0), ('EARNINGS', 3, 'WIDEN', 1.5, 0), ('EARNINGS', 7, 'WIDEN', 1.2, 0), ('MERGER_ACQUIRE', 1, 'AVOID', 5.0, 0), ('MERGER_ACQUIRE', 7, 'WIDEN', 2.5, 0),
    ('BOARD_MEETING', 0, 'WIDEN', 1.5, 0), ('BOARD_MEETING', 2, 'WIDEN', 1.2, 0), ('BONUS_SPLIT', 1, 'WIDEN', 1.3, 0), ('DIVIDEND', 0, 'WIDEN', 1.2, 0)),
  m AS (SELECT o_orderkey, arg_min(action, upto) AS action, arg_min(factor, upto) AS factor, arg_min(pause, upto) AS pause FROM e JOIN v ON k = kind AND days <= upto GROUP BY 1)
  SELECT o_orderkey, kind, coalesce(action, 'NORMAL') AS action, CAST(coalesce(factor, 1.0) AS DOUBLE) AS factor, CAST(coalesce(pause, 0) AS INT) AS pause, substr(md5('wire:' || headline), 1, 12) AS id FROM e LEFT JOIN m USING (o_orderkey)""")
def event_impact(spark, d):
    n = driver_table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, NEWS)), (1 + F.col("o_orderkey") % 9).cast("int")).alias("headline"), (F.col("o_orderkey") % 10).cast("int").alias("days"))
    n = n.withColumn("kind", scalar.event_type(F.col("headline"))).withColumn("i", scalar.event_impact(F.col("kind"), F.col("days")))
    return n.select("o_orderkey", "kind", "i.action", "i.factor", "i.pause", scalar.news_id(F.lit("wire"), F.col("headline")).alias("id"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS priority, 1 + (o_orderkey % 3) * 0.25 AS factor, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS why FROM orders)
  SELECT o_custkey, max(priority) AS priority, round(least(exp(sum(ln(factor))), 4.0), 8) AS factor, min(day) AS first_day, string_agg(DISTINCT why, ';' ORDER BY why) AS reasons FROM s GROUP BY 1""")
def signal_aggregate(spark, d):
    o = driver_table(spark, d, "orders")
    s = o.select("o_custkey", (F.col("o_orderkey") % 4).alias("priority"), (1 + F.col("o_orderkey") % 3 * 0.25).alias("factor"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("why"))
    return s.groupBy("o_custkey").agg(F.max("priority").alias("priority"), r(F.least(F.exp(F.sum(F.log("factor"))), F.lit(4.0)), 8).alias("factor"), F.min("day").alias("first_day"), F.array_join(F.array_sort(F.collect_set("why")), ";").alias("reasons"))


@query(T + """, m AS (SELECT day, avg(price) AS v FROM t GROUP BY 1) SELECT day, round(v, 6) AS level, CASE WHEN v < 12 THEN 'LOW' WHEN v < 18 THEN 'NORMAL' WHEN v < 25 THEN 'HIGH' ELSE 'EXTREME' END AS regime,
  round((v - avg(v) OVER (ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), 6) AS change FROM m""")
def macro_regime(spark, d):
    m = ticks(spark, d).groupBy("day").agg(F.avg("price").alias("v"))
    past = F.avg("v").over(Window.orderBy("day").rowsBetween(-5, -1))  # one row per calendar day
    return m.select("day", r("v").alias("level"), scalar.regime(F.col("v"), scalar.VIX_REGIMES, "EXTREME").alias("regime"), r(F.col("v") - past).alias("change"))


@query("""WITH m AS (SELECT p_partkey, (p_partkey % 9 - 4) / 8 AS dxy, (p_size - 25) / 20 AS crude, 10 + p_size / 2 AS vix, (p_partkey % 41 - 20) * 100 AS net, (p_partkey % 5 - 2) / 4 AS bank FROM part),
  i AS (SELECT p_partkey, 0.30 * (dxy / 0.5) + 0.25 * (crude / 1.0) + 0.20 * (vix / 15 - 1) + 0.15 * (-net / 1000) + 0.10 * (-bank / 0.5) AS x FROM m)
  SELECT p_partkey, round(CAST(x AS DOUBLE), 4) + 0.0 AS pressure, CASE WHEN x > 0.5 THEN 'STRONG_PRESSURE' WHEN x > 0.2 THEN 'MILD_PRESSURE' WHEN x > -0.2 THEN 'NEUTRAL' WHEN x > -0.5 THEN 'MILD_SUPPORT' ELSE 'STRONG_SUPPORT' END AS regime FROM i""")
def currency_pressure(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    m = driver_table(spark, d, "part").select("p_partkey", scalar.currency_pressure((k % 9 - 4) / 8, (z - 25) / 20, 10 + z / 2, (k % 41 - 20) * 100, (k % 5 - 2) / 4).alias("x"))
    return m.select("p_partkey", (r(F.col("x"), 4) + 0.0).alias("pressure"), scalar.pressure_regime(F.col("x")).alias("regime"))


@query(T + HOURLY + """ SELECT symbol, count(*) AS bars, count(*) >= 300 AND stddev_samp(close) > 0 AS accepted FROM b GROUP BY 1""")
def bar_acceptance(spark, d):
    return hourly(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), ((F.count(F.lit(1)) >= 300) & (F.stddev_samp("close") > 0)).alias("accepted"))


@query(T + """, q AS (SELECT symbol, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM t GROUP BY 1) SELECT t.symbol, count(*) AS kept, round(avg(price), 6) AS trimmed_mean FROM t JOIN q ON t.symbol = q.symbol WHERE price BETWEEN lo AND hi GROUP BY 1""")
def quantile_trim(spark, d):
    t = ticks(spark, d)
    q = exact_quantiles(t, ["symbol"], "price", [0.01, 0.99], ["low", "high"])
    return t.join(q, "symbol").where("price between low and high").groupBy("symbol").agg(F.count(F.lit(1)).alias("kept"), r(F.avg("price")).alias("trimmed_mean"))


@query(T + """, k AS (SELECT *, dense_rank() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM t)) SELECT CASE WHEN n <= 15 THEN 'train' WHEN n <= 20 THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows, min(t.day) AS first_day FROM t JOIN k ON t.day = k.day GROUP BY 1""")
def calendar_split(spark, d):
    t = ticks(spark, d)
    k = t.select("day").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("day")))  # one row per calendar day
    name = F.when(F.col("n") <= 15, "train").when(F.col("n") <= 20, "validation").otherwise("test")
    return t.join(k, "day").groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') UNION ALL
  SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') UNION ALL
  SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')""")
def set_operations(spark, d):
    l = driver_table(spark, d, "lineitem")
    a, b = l.where("l_returnflag = 'R'").select("l_partkey"), l.where("l_linestatus = 'O'").select("l_partkey")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n") for n, x in made.items()]
    return out[0].union(out[1]).union(out[2])


@query("""SELECT r_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def cube_extra(spark, d):
    c, n, g = (driver_table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
    return j.cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), r(F.sum("c_acctbal"), 4).alias("balance"))


@query("""WITH f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS p FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, p) AS n FROM f)
  SELECT o_custkey, count(*) AS n, arg_max(p, n) AS last_price, round(arg_max(p, n) - arg_min(p, n), 4) AS move, max(n) >= 3 AS trend FROM g GROUP BY 1 HAVING count(*) >= 2""")
def alpha_prior(spark, d):
    g = driver_table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("p"))
    g = g.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("day", "p")))
    out = g.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("p", F.col("n")).alias("last_price"), r(F.max_by("p", F.col("n")) - F.min_by("p", F.col("n")), 4).alias("move"), (F.max("n") >= 3).alias("trend"))
    return out.where("n >= 2")


@query("SELECT count(DISTINCT event_type) AS symbols, count(DISTINCT CAST(ts AS DATE)) AS dates, count(*) AS n_rows FROM events")
def catalog_status(spark, d):
    from microtide.sources.tables import catalog_status as status

    return status(ticks(spark, d).withColumn("date", F.col("day")))


@query("""WITH f AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice / l_quantity AS p FROM lineitem) SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS net_qty, CAST(sum(abs(q)) AS BIGINT) AS gross_qty, round(CAST(sum(q * p) AS DOUBLE), 2) AS net_value FROM f GROUP BY 1""")
def exposure(spark, d):
    q = F.when(F.col("side") == "SELL", -F.col("qty")).otherwise(F.col("qty"))
    f = fills(spark, d).select("l_suppkey", q.alias("q"), "price")
    return f.groupBy("l_suppkey").agg(F.sum("q").alias("net_qty"), F.sum(F.abs("q")).alias("gross_qty"), r(F.sum(F.col("q") * F.col("price")), 2).alias("net_value"))


OPTIONS = "SELECT p_partkey, p_partkey % 2 = 0 AS call, 100.0 + p_size AS k, 120.0 AS s, 0.05 + (p_size % 10) * 0.1 AS t, 0.1 + (p_partkey % 40) * 0.01 AS v FROM part"


def _phi(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query(f"""WITH o AS ({OPTIONS}), e AS (SELECT *, (ln(s / k) + (0.07 + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM o), x AS (SELECT *, d1 - v * sqrt(t) AS d2, CASE WHEN call THEN 1.0 ELSE -1.0 END AS g FROM e),
  y AS (SELECT *, g * d1 AS a, g * d2 AS b FROM x) SELECT p_partkey, round(g * (s * {_phi('a')} - k * exp(-0.07 * t) * {_phi('b')}), 6) AS price, round(g * {_phi('a')}, 6) AS delta, round(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (s * v * sqrt(t)), 8) AS gamma, round(s * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t) / 100, 6) AS vega FROM y""")
def bs_greeks(spark, d):
    o = options(spark, d)
    call, s, k, t, v = (F.col(c) for c in ("call", "s", "k", "t", "v"))
    g = scalar.bs_greeks(call, s, k, t, 0.07, v)
    return o.select("p_partkey", r(scalar.bs_price(call, s, k, t, 0.07, v)).alias("price"), r(g["delta"]).alias("delta"), r(g["gamma"], 8).alias("gamma"), r(g["vega"]).alias("vega"))


def options(spark, d):
    p, z = F.col("p_partkey"), F.col("p_size")
    return driver_table(spark, d, "part").select("p_partkey", (p % 2 == 0).alias("call"), (100.0 + z).alias("k"), F.lit(120.0).alias("s"), (0.05 + z % 10 * 0.1).alias("t"), (0.1 + p % 40 * 0.01).alias("v"))


@query(f"WITH o AS ({OPTIONS}) SELECT p_partkey, round(v, 3) AS iv FROM o WHERE abs(ln(s / k)) < 2 * v * sqrt(t) AND call = (k >= s)")
def implied_vol(spark, d):
    """The volatility comes back from the price it made, where the price still depends on it."""
    o = options(spark, d).where("abs(ln(s / k)) < 2 * v * sqrt(t) and call = (k >= s)")
    call, s, k, t = (F.col(c) for c in ("call", "s", "k", "t"))
    o = o.withColumn("price", scalar.bs_price(call, s, k, t, 0.07, F.col("v")))
    return o.select("p_partkey", r(scalar.implied_vol(call, F.col("price"), s, k, t, r=0.07), 3).alias("iv"))


@query("""WITH a AS (SELECT vec_id, label, embedding FROM embeddings) SELECT label, count(*) AS n, round(avg(list_sum([x * x for x in embedding])), 4) AS mean_square FROM a GROUP BY 1""")
def vector_profile(spark, d):
    sq = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return driver_table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg(sq), 4).alias("mean_square"))


@query(T + """ SELECT user_id, symbol, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, event_id) AS n FROM t) WHERE n = 1""")
def best_by_key(spark, d):
    return joins.first_by(ticks(spark, d), ["user_id"], [F.col("price").desc(), "event_id"]).select("user_id", "symbol", "price")
