"""Queries of the book features on a half-hour grid of each session, with their DuckDB counterparts.

The book is made from the ticks by fixed expressions: prices move in coarse steps, so that best
prices stand still often. Windows count grid rows and are shorter than the operators' defaults,
which are for one-second grids.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from microtide.operators import bars, book, windows
from microtide.operators.windows import Series
from microtide.plans.market import T, r, ticks
from microtide.plans.registry import query

STEP = 1800
GRID = Series(["symbol", "day"], "ts")
S = "PARTITION BY symbol, day ORDER BY ts"
#: Sums whose rounded zero may have either sign.
SIGNED = ("ofi_sum_signed_log", "ofi_rate_diff", "near_migration_asym", "migration_activity_asym")
AT = "{'a': ts_us, 'b': event_id}"
LADDER = ", ".join(f"p - 0.01 * {i} AS bp{i + 1}, p + 0.01 * {2 * i + 1} AS ap{i + 1}, (q * {2 * i + 3} + {7 * i}) % 50 + 1 AS bq{i + 1}, (q * {3 * i + 5} + {i}) % 50 + 1 AS aq{i + 1}" for i in range(5))
B, A = (" + ".join(f"{p}{i}" for i in range(1, 6)) for p in ("bq", "aq"))
G = T + f""", l AS (SELECT *, floor(price / 20) * 0.1 + 10 AS p, ts_sec - ts_sec % {STEP} AS ts FROM t), s AS (SELECT symbol, day, ts, arg_max(p, {AT}) AS p, arg_max(qty, {AT}) AS q FROM l GROUP BY 1, 2, 3),
  g AS (SELECT symbol, day, unnest(generate_series(min(ts), max(ts), {STEP})) AS ts FROM s GROUP BY 1, 2),
  f AS (SELECT g.symbol, g.day, g.ts, last_value(s.p IGNORE NULLS) OVER w AS p, last_value(s.q IGNORE NULLS) OVER w AS q, CASE WHEN s.ts IS NULL THEN 0 ELSE 1 END AS is_observed FROM g LEFT JOIN s ON g.symbol = s.symbol AND g.day = s.day AND g.ts = s.ts
    WINDOW w AS (PARTITION BY g.symbol, g.day ORDER BY g.ts ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, (bp1 + ap1) / 2 AS mid, {B} AS bid_depth, {A} AS ask_depth FROM (SELECT symbol, day, ts, is_observed, {LADDER} FROM f))"""


def grid(spark, d):
    t = ticks(spark, d).withColumns({"p": F.floor(F.col("price") / 20) * 0.1 + 10, "ts": F.col("ts_sec") - F.pmod("ts_sec", F.lit(STEP))})
    last = bars.last_snapshot(t, ["symbol", "day", "ts"], ["ts_us", "event_id"], ["p", "qty"])
    g, p, q = bars.regularize(last, ["symbol", "day"], "ts", STEP, ["p", "qty"], []), F.col("p"), F.col("qty")
    cols = {}
    for i in range(5):
        cols |= {f"bp{i + 1}": p - 0.01 * i, f"ap{i + 1}": p + 0.01 * (2 * i + 1), f"bq{i + 1}": (q * (2 * i + 3) + 7 * i) % 50 + 1, f"aq{i + 1}": (q * (3 * i + 5) + i) % 50 + 1}
    return g.withColumns(cols)


def shown(df, *names):
    return df.select("symbol", "ts", *[(r(c) + 0.0 if c in SIGNED else r(c)).alias(c) for c in names])


@query(G + f""" SELECT symbol, ts, round((bq1 - aq1) / (bq1 + aq1 + 1e-9), 6) AS queue_imbalance_ctrl, round((bid_depth - ask_depth) / (bid_depth + ask_depth + 1e-9), 6) AS depth_imbalance_ctrl, round(ln(1 + bid_depth + ask_depth), 6) AS log_total_depth_ctrl,
  round(1e4 * (ap1 - bp1) / mid, 6) AS spread_bps_ctrl, round(bq1 / (bid_depth + 1e-9), 6) AS bid_l1_concentration_ctrl, round(aq1 / (ask_depth + 1e-9), 6) AS ask_l1_concentration_ctrl, round(1e4 * ln(mid / lag(mid, 2) OVER ({S})), 6) AS momentum_2_ctrl FROM k""")
def book_controls(spark, d):
    return shown(book.controls(grid(spark, d), GRID, "ts", (2,), STEP), "queue_imbalance_ctrl", "depth_imbalance_ctrl", "log_total_depth_ctrl", "spread_bps_ctrl", "bid_l1_concentration_ctrl", "ask_l1_concentration_ctrl", "momentum_2_ctrl")


def _gap_sql() -> str:
    raw = [math.exp(-0.7 * k) for k in range(4)]
    b, a = (lambda i: f"1e4 * (bp{i} - bp{i + 1}) / mid"), (lambda i: f"1e4 * (ap{i + 1} - ap{i}) / mid")
    w = [x / sum(raw) for x in raw]
    wide = " + ".join(f"{x!r} * ({b(i)} - {a(i)})" for i, x in enumerate(w, 1))
    frail = " + ".join(f"{x!r} * ({b(i)} / sqrt(1 + bq{i}) - {a(i)} / sqrt(1 + aq{i}))" for i, x in enumerate(w, 1))
    return G + f" SELECT symbol, ts, round({wide}, 6) AS weighted_gap_asymmetry, round({frail}, 6) AS fragility_asymmetry FROM k"


@query(_gap_sql())
def gap_asymmetry(spark, d):
    return shown(book.gap_asymmetry(grid(spark, d)), "weighted_gap_asymmetry", "fragility_asymmetry")


def _away(p: str, q: str, total: str) -> str:
    return "(" + " + ".join(f"1e4 * abs({p}{i} - {p}1) / mid * {q}{i}" for i in range(1, 6)) + f") / ({total})"


@query(G + f""", m AS (SELECT *, {_away("bp", "bq", "bid_depth")} AS x, {_away("ap", "aq", "ask_depth")} AS y FROM k), c AS (SELECT symbol, ts, x - lag(x, 4) OVER ({S}) AS u, y - lag(y, 4) OVER ({S}) AS v FROM m)
  SELECT symbol, ts, round((u - v) / (abs(u) + abs(v) + 1e-9), 5) AS relative_migration FROM c""")
def relative_migration(spark, d):
    return book.relative_migration(grid(spark, d), GRID, "ts", 4, STEP).select("symbol", "ts", r("relative_migration", 5).alias("relative_migration"))


ALL = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in book.BOOK) + "]"


def _shock_sql() -> str:
    event = lambda x, v: f"last_value(CASE WHEN real AND {x}_was > 0 AND {x}_was - {x}_depth >= 0.2 * {x}_was THEN {v} END IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING)"
    cols = ", ".join(f"{event(x, 'ts')} AS {x}_ts, {event(x, f'{x}_depth')} AS {x}_left, {event(x, f'{x}_was - {x}_depth')} AS {x}_lost" for x in ("bid", "ask"))
    back = lambda x: f"CASE WHEN ts - {x}_ts < {6 * STEP} THEN least(2.0, greatest(0.0, ({x}_depth - {x}_left) / {x}_lost)) END"
    return G + f""", d AS (SELECT *, is_observed = 1 AND ts - lag(ts) OVER ({S}) = {STEP} AND {ALL} != lag({ALL}) OVER ({S}) AS real, lag(bid_depth) OVER ({S}) AS bid_was, lag(ask_depth) OVER ({S}) AS ask_was FROM k), e AS (SELECT *, {cols} FROM d)
  SELECT symbol, ts, round({back("bid")}, 6) AS bid_recovery, round({back("ask")}, 6) AS ask_recovery, CASE WHEN ts - bid_ts < {6 * STEP} THEN ts - bid_ts END AS bid_shock_age, CASE WHEN ts - ask_ts < {6 * STEP} THEN ts - ask_ts END AS ask_shock_age,
    round(coalesce({back("bid")}, 0.0) - coalesce({back("ask")}, 0.0), 6) AS recovery_pressure FROM e"""


@query(_shock_sql())
def shock_recovery(spark, d):
    out = book.shock_recovery(grid(spark, d), GRID, "ts", 6, STEP)
    return out.select("symbol", "ts", r("bid_recovery").alias("bid_recovery"), r("ask_recovery").alias("ask_recovery"), "bid_shock_age", "ask_shock_age", r("recovery_pressure").alias("recovery_pressure"))


def _near_sql() -> str:
    past = lambda v, n: f"last_value(CASE WHEN is_observed = 1 THEN {v} END IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}"
    moved = lambda p, x: f"CASE WHEN is_observed = 1 AND ts - past <= {3 * STEP} AND {p} = past_{p} THEN {x} - past_{x} ELSE 0.0 END"
    return G + f""", n AS (SELECT *, (bq1 + bq2) / bid_depth AS x, (aq1 + aq2) / ask_depth AS y FROM k), z AS (SELECT *, {past("ts", "past")}, {past("bp1", "past_bp1")}, {past("ap1", "past_ap1")}, {past("x", "past_x")}, {past("y", "past_y")}, min(ts) OVER (PARTITION BY symbol, day) AS start FROM n),
  c AS (SELECT symbol, day, ts, start, {moved("bp1", "x")} AS u, {moved("ap1", "y")} AS v FROM z)
  SELECT symbol, ts, CASE WHEN ts >= start + {5 * STEP} THEN round(sum(u - v) OVER w, 6) + 0.0 END AS near_migration_asym, CASE WHEN ts >= start + {5 * STEP} THEN round(sum(abs(u) - abs(v)) OVER w, 6) + 0.0 END AS migration_activity_asym
  FROM c WINDOW w AS ({S} RANGE BETWEEN {6 * STEP - 1} PRECEDING AND CURRENT ROW)"""


@query(_near_sql())
def near_migration(spark, d):
    return shown(book.near_migration(grid(spark, d), GRID, "ts", 6, STEP, 3), "near_migration_asym", "migration_activity_asym")


FLOW = G + f""", v AS (SELECT *, lag(ts) OVER ({S}) AS t0, lag(bp1) OVER ({S}) AS b0, lag(ap1) OVER ({S}) AS a0, lag(bq1) OVER ({S}) AS x0, lag(aq1) OVER ({S}) AS y0, lag(mid) OVER ({S}) AS m0 FROM k),
  o AS (SELECT *, CASE WHEN t0 IS NOT NULL THEN CASE WHEN bp1 >= b0 THEN bq1 ELSE 0 END - CASE WHEN bp1 <= b0 THEN x0 ELSE 0 END + CASE WHEN ap1 >= a0 THEN y0 ELSE 0 END - CASE WHEN ap1 <= a0 THEN aq1 ELSE 0 END END AS ofi, ln(mid) - ln(m0) AS ret,
    (bq1 - aq1) / (bq1 + aq1 + 1e-9) AS queue, (bid_depth - ask_depth) / (bid_depth + ask_depth + 1e-9) AS deep, ln(mid) - lag(ln(mid), 5) OVER ({S}) AS k5 FROM v)"""


def _frame(n: int, least: int, x: str, seen: str) -> str:
    w = f"OVER ({S} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({seen}) {w} >= {least} THEN {x} {w} END"


@query(FLOW + f""", x AS (SELECT *, {_frame(12, 4, "sum(ofi)", "ofi")} AS s12, {_frame(6, 2, "sum(ofi)", "ofi")} AS s6, {_frame(18, 6, "sum(ofi)", "ofi")} AS s18, {_frame(18, 6, "var_samp(k5)", "k5")} AS vk, {_frame(18, 6, "var_samp(ret)", "ret")} AS v1 FROM o)
  SELECT symbol, ts, round(sign(s12) * ln(1 + abs(s12)), 6) + 0.0 AS ofi_sum_signed_log, round(sign(s6 / 6 - s18 / 18) * ln(1 + abs(s6 / 6 - s18 / 18)), 6) + 0.0 AS ofi_rate_diff, round({_frame(12, 4, "avg(CASE WHEN ofi != 0 THEN 1.0 WHEN ofi = 0 THEN 0.0 END)", "ofi")}, 6) AS ofi_activity,
    round({_frame(18, 6, "avg(is_observed)", "is_observed")}, 6) AS update_rate, round({_frame(6, 2, "avg(CASE WHEN ret != 0 THEN 1.0 WHEN ret = 0 THEN 0.0 END)", "ret")}, 6) AS price_move_rate, round(queue - lag(queue) OVER ({S}), 6) AS queue_imbalance_delta,
    round(deep - lag(deep) OVER ({S}), 6) AS depth_imbalance_delta, round(CASE WHEN vk IS NOT NULL AND v1 IS NOT NULL THEN ln(greatest(vk / (5 * v1 + 1e-12), 1e-6)) END, 4) + 0.0 AS log_variance_ratio_5 FROM x""")
def flow_features(spark, d):
    out = book.flow_features(grid(spark, d), GRID, "ts", 6, 12, 18, STEP)
    out = out.withColumn("log_variance_ratio_5", r("log_variance_ratio_5", 4) + 0.0)
    return shown(out, "ofi_sum_signed_log", "ofi_rate_diff", "ofi_activity", "update_rate", "price_move_rate", "queue_imbalance_delta", "depth_imbalance_delta", "log_variance_ratio_5")


@query(FLOW + f""", m AS (SELECT *, count(ofi) OVER w AS n, avg(ofi) OVER w AS x, avg(CASE WHEN ofi IS NOT NULL THEN ret END) OVER w AS y, avg(ofi * ofi) OVER w AS xx, avg(ofi * ret) OVER w AS xy FROM o WINDOW w AS ({S} ROWS 11 PRECEDING)),
  b AS (SELECT *, CASE WHEN n >= 4 THEN (xy - x * y) / (xx - x * x + 1e-12) END AS b FROM m), e AS (SELECT *, ret - lag(y - b * x) OVER ({S}) - lag(b) OVER ({S}) * ofi AS e FROM b), p AS (SELECT *, lag(e) OVER ({S}) AS e0 FROM e)
  SELECT symbol, ts, CASE WHEN count(e0) OVER w >= 4 AND stddev_samp(e0) OVER w > 1e-12 THEN round(-sign(ofi) * e / stddev_samp(e0) OVER w, 4) + 0.0 END AS ofi_response_gap_z FROM p WINDOW w AS ({S} ROWS 11 PRECEDING)""")
def ofi_response_gap(spark, d):
    return book.response_gap(grid(spark, d), GRID, "ts", 12, 4).select("symbol", "ts", (r("ofi_response_gap_z", 4) + 0.0).alias("ofi_response_gap_z"))


@query(FLOW + f""", x AS (SELECT symbol, ts, {_frame(6, 3, "sum(ofi)", "ofi")} AS net, {_frame(6, 3, "sum(abs(ofi))", "ofi")} AS gross, 1e4 * ln(mid / lag(mid, 6) OVER ({S})) AS m, 1e4 * sqrt({_frame(6, 3, "sum(ret * ret)", "ret")}) AS v FROM o), q AS (SELECT *, CASE WHEN gross > 0 THEN net / gross WHEN gross = 0 THEN 0.0 END AS p FROM x)
  SELECT symbol, ts, CASE WHEN p IS NOT NULL AND m IS NOT NULL AND v IS NOT NULL THEN round(CASE WHEN p * m < 0 THEN p * least(abs(m) / greatest(v, 0.1), 3.0) ELSE 0.0 END, 6) END AS ofi_disagreement FROM q""")
def ofi_disagreement(spark, d):
    return shown(book.ofi_disagreement(grid(spark, d), GRID, "ts", 6, 3, STEP), "ofi_disagreement")


@query(G + f""", q AS (SELECT *, count(*) OVER w AS n, quantile_cont(bid_depth + ask_depth, 0.5) OVER w AS med FROM k WINDOW w AS ({S} ROWS 11 PRECEDING)) SELECT symbol, ts, CASE WHEN n >= 10 THEN round(ln(1 + 1e4 * (ap1 - bp1) / mid / sqrt(med + 1)), 6) END AS spread_depth_stress FROM q""")
def spread_depth_stress(spark, d):
    return shown(book.spread_depth_stress(grid(spark, d), GRID, 12, 10), "spread_depth_stress")


def _available_sql() -> str:
    past = f"({S} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    rel = lambda x: f"CASE WHEN count({x}_depth) OVER {past} >= 10 THEN {x}_depth / quantile_cont({x}_depth, 0.5) OVER {past} END AS {x}"
    test = lambda x: f"count(*) FILTER ({x} IS NOT NULL AND {x}_was IS NOT NULL) OVER w >= 10 AND count(*) FILTER ({x} IS NOT NULL AND {x}_was < 0.75) OVER w >= 2"
    return G + f""", e AS (SELECT symbol, day, ts, {rel("bid")}, {rel("ask")} FROM k), z AS (SELECT *, lag(bid) OVER ({S}) AS bid_was, lag(ask) OVER ({S}) AS ask_was FROM e)
  SELECT symbol, ts, CASE WHEN {test("bid")} AND {test("ask")} THEN 1 ELSE 0 END AS recovery_available FROM z WINDOW w AS ({S} ROWS 11 PRECEDING)"""


@query(_available_sql())
def recovery_available(spark, d):
    return book.recovery_available(grid(spark, d), GRID, "ts", 12, 10, 2, 0.75, STEP).select("symbol", "ts", "recovery_available")


@query(G + f""", c AS (SELECT symbol, ts - lag(ts) OVER ({S}) AS gap FROM k) SELECT symbol, count(*) AS rows, count(*) FILTER (gap = 0) AS repeated, count(*) FILTER (gap != {STEP} AND gap != 0) AS off_grid, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS negative, count(*) AS valid_books FROM c GROUP BY 1""")
def book_checks(spark, d):
    return book.checks(grid(spark, d), ["symbol"], GRID, "ts", STEP)


@query(G + f""", y AS (SELECT *, lag(mid, 3) OVER ({S}) AS m3, lag(mid) OVER ({S}) AS m1 FROM k), w AS (SELECT symbol, ts, mid, CASE WHEN count(m3) OVER w >= 5 AND stddev_pop(CASE WHEN m3 IS NOT NULL THEN mid END) OVER w * stddev_pop(m3) OVER w > 1e-12 THEN covar_pop(mid, m3) OVER w / nullif(stddev_pop(CASE WHEN m3 IS NOT NULL THEN mid END) OVER w * stddev_pop(m3) OVER w, 0) END AS acf,
    CASE WHEN count(m1) OVER w >= 5 AND var_pop(m1) OVER w > 1e-12 THEN covar_pop(mid, m1) OVER w / nullif(var_pop(m1) OVER w, 0) END AS ar, CASE WHEN stddev_samp(mid) OVER z > 1e-9 THEN mid / stddev_samp(mid) OVER z END AS bz FROM y WINDOW w AS ({S} ROWS 8 PRECEDING), z AS ({S} ROWS 11 PRECEDING))
  SELECT symbol, ts, round(acf, 9) + 0.0 AS acf_3, round(ar, 9) + 0.0 AS ar1_beta, round(bz, 6) AS basis_z FROM w""")
def rolling_autoregression(spark, d):
    g = grid(spark, d).withColumn("mid", book.mid())
    g = g.withColumns({"m3": GRID.lag("mid", 3), "m1": GRID.lag("mid")})
    sd = GRID.rolling("stddev_samp", "mid", 12)
    return g.select("symbol", "ts", (r(GRID.corr("mid", "m3", 9, 5), 9) + 0.0).alias("acf_3"), (r(windows.slope(GRID, "m1", "mid", 9, 5), 9) + 0.0).alias("ar1_beta"), r(F.when(sd > 1e-9, F.col("mid") / F.nullif(sd, F.lit(0.0))), 6).alias("basis_z"))
