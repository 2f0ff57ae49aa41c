"""Queries over gap-free sessions: every symbol-day on a 30-second grid, so that windows of 300 rows are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.operators import bars, evaluate, features, quantiles, regression, windows
from microtide.operators.windows import Series
from microtide.plans.market import T as TICKS
from microtide.plans.market import r, ticks
from microtide.plans.registry import query

STEP = 30
S = Series(["symbol", "day"], "bar_ts")
O = "PARTITION BY symbol, day ORDER BY bar_ts"

#: The grid: the last close carried forward, above 0.9, and a tick's worth of change per row, so that returns vary.
GRID = TICKS + f""", b0 AS (SELECT symbol, day, ts_sec - ts_sec % {STEP} AS bar_ts, arg_max(price, {{'a': ts_us, 'b': event_id}}) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS tick_count FROM t WHERE price > 0 GROUP BY 1, 2, 3),
  g0 AS (SELECT symbol, day, unnest(range(min(bar_ts), max(bar_ts) + 1, {STEP})) AS bar_ts FROM b0 GROUP BY 1, 2),
  g1 AS (SELECT g0.symbol, g0.day, g0.bar_ts, b0.close AS c, coalesce(volume, 0) AS volume, CASE WHEN b0.close IS NULL THEN 0 ELSE 1 END AS is_observed FROM g0 LEFT JOIN b0 ON g0.symbol = b0.symbol AND g0.day = b0.day AND g0.bar_ts = b0.bar_ts),
  g AS (SELECT symbol, day, bar_ts, volume, is_observed, bar_ts // {STEP} AS i, last_value(c IGNORE NULLS) OVER ({O}) + 1 + ((bar_ts // {STEP} * 7) % 13 - 6) * 0.01e0 AS close FROM g1)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    b = bars.time_bars(ticks(spark, d), ["symbol", "day"], "ts_sec", ["ts_us", "event_id"], "price", "qty", STEP)
    g = bars.regularize(b, ["symbol", "day"], "bar_ts", STEP, ["close"], ["volume"]).withColumn("i", F.floor(F.col("bar_ts") / STEP))
    return g.withColumn("close", F.col("close") + 1 + ((F.col("i") * 7) % 13 - 6) * 0.01)


def _frame(n: int) -> str:
    return f"OVER ({O} ROWS {n - 1} PRECEDING)"


@query(GRID + f""", x AS (SELECT symbol, day, bar_ts, is_observed, volume, close, {', '.join(f'stddev_samp(close) {_frame(n)} AS std_{n}' for n in (10, 30, 60, 300))}, {', '.join(f'avg(close) {_frame(n)} AS ma_{n}' for n in (10, 30, 60))},
    (close - avg(close) {_frame(300)}) / nullif(stddev_samp(close) {_frame(300)}, 0) AS z_300, volume / nullif(avg(volume) {_frame(60)}, 0) AS volume_ratio_60, {', '.join(f'(close - lag(close, {n}) OVER ({O})) / nullif(lag(close, {n}) OVER ({O}), 0) AS mom_{n}' for n in (10, 30, 60))} FROM g)
  SELECT symbol, bar_ts, {', '.join(f'round({c} + 1e-9, 5) AS {c}' for c in ('std_10', 'std_30', 'std_60', 'std_300', 'ma_10', 'ma_30', 'ma_60', 'z_300', 'volume_ratio_60', 'mom_10', 'mom_30', 'mom_60'))} FROM x WHERE is_observed = 1""")
def rolling_bar_features(spark, d):
    """Rolling features at their full lengths, at the bars that had ticks."""
    g = regression.rolling_stats(grid(spark, d), S, "close", (10, 30, 60, 300))
    g = regression.rolling_stats(g.withColumn("v", F.col("volume").cast("double")), S, "v", (60,))
    made = {f"std_{n}": F.col(f"close_std{n}") for n in (10, 30, 60, 300)} | {f"ma_{n}": F.col(f"close_mean{n}") for n in (10, 30, 60)}
    made |= {"z_300": (F.col("close") - F.col("close_mean300")) / F.nullif(F.col("close_std300"), F.lit(0.0)), "volume_ratio_60": F.col("volume") / F.nullif(F.col("v_mean60"), F.lit(0.0))} | {f"mom_{n}": S.momentum("close", n) for n in (10, 30, 60)}
    return g.withColumns(made).where("is_observed = 1").select("symbol", "bar_ts", *[r(F.col(c) + 1e-9, 5).alias(c) for c in made])


_SQL_BOOK = ", ".join([f"CAST((volume + i * {k}) % 97 AS DOUBLE) AS bid_q{k}, CAST((volume * 2 + i * {k + 5}) % 89 AS DOUBLE) AS ask_q{k}" for k in range(1, 6)])
_W5 = [f"{w}e0" for w in features.LEVEL_WEIGHTS]
_SIDE = {s: " + ".join(f"{w} * {s}_q{k}" for k, w in enumerate(_W5, 1)) for s in ("bid", "ask")}
_DIFF = {s: " + ".join(f"{w} * coalesce({s}_q{k} - lag({s}_q{k}) OVER o, 0)" for k, w in enumerate(_W5, 1)) for s in ("bid", "ask")}
_FULL = lambda how, x, n, part="o": f"CASE WHEN count({x}) OVER w{n} >= {n} THEN {how}({x}) OVER w{n} END"
_WINDOWS = f"WINDOW o AS ({O}), w60 AS ({O} ROWS 59 PRECEDING), w300 AS ({O} ROWS 299 PRECEDING)"


@query(GRID + f""", k AS (SELECT *, {_SQL_BOOK}, CASE WHEN i % 11 = 0 THEN NULL ELSE close + 0.01e0 * (i % 3) END AS wm, close + 0.02e0 * (i % 5 - 2) AS vwap, volume * 3 + i % 7 AS oi, CAST(i % 9 AS DOUBLE) AS tb, CAST(i % 8 AS DOUBLE) AS ta,
    CASE WHEN i % 5 = 0 THEN 0e0 ELSE 0.5e0 * (i % 5) END AS v10, CASE WHEN i % 6 = 0 THEN NULL ELSE 0.25e0 * (i % 6) END AS v60, 0.125e0 * (1 + i % 4) AS v300 FROM g),
  m AS (SELECT *, coalesce(wm, close) AS mid, {_SIDE['bid']} AS wb, {_SIDE['ask']} AS wa, {_DIFF['bid']} - ({_DIFF['ask']}) AS ofi, coalesce(CAST(oi - lag(oi) OVER o AS DOUBLE), 0) AS doi FROM k WINDOW o AS ({O})),
  q AS (SELECT *, CASE WHEN mid > lag(mid) OVER o THEN 1e0 ELSE 0e0 END AS up, coalesce(mid / lag(mid) OVER o - 1, 0) AS ret, row_number() OVER o AS n FROM m WINDOW o AS ({O})),
  z AS (SELECT *, coalesce({_FULL('avg', 'up', 60)}, 0.5) AS td, coalesce(v60, 2) AS u60, lag(ret) OVER o AS y, lag(ret, 2) OVER o AS x FROM q {_WINDOWS}),
  f AS (SELECT *, CASE WHEN n > 60 AND stddev_pop(y) OVER w60 > 1e-10 THEN corr(x, y) OVER (PARTITION BY symbol, day ORDER BY bar_ts ROWS 58 PRECEDING) END AS ac, coalesce(nullif({_FULL('stddev_samp', 'td', 300)}, 0), 0.1) AS tdsd, coalesce(nullif({_FULL('stddev_samp', 'doi', 300)}, 0), 1) AS oisd, {_FULL('avg', 'u60', 60)} AS vc, {_FULL('avg', 'v300', 300)} AS vl FROM z {_WINDOWS})
  SELECT symbol, bar_ts, round((wb - wa) / CASE WHEN wb + wa = 0 THEN 1 ELSE wb + wa END, 6) AS book_imbalance_weighted, round(ofi, 5) AS ofi_weighted, round((td - 0.5) / tdsd, 5) AS tick_direction_z, round(CASE WHEN isfinite(ac) THEN ac ELSE 0 END, 3) AS price_autocorr_60, round(coalesce(vc / CASE WHEN vl = 0 THEN 2 ELSE vl END, 1), 6) AS vol_regime_ratio,
    round(ln(greatest(0.1, least(10, coalesce(nullif(tb, 0) / nullif(ta, 0), 1)))), 6) AS depth_ratio, round((mid - vwap) / vwap, 6) AS mid_vs_vwap, round(v10 / CASE WHEN u60 = 0 THEN 2 ELSE u60 END, 6) AS vol_ratio_10_60, round(doi / oisd, 5) AS oi_change_z,
    round(sin(2 * pi() * ((bar_ts + 19800) % 86400) / 86400), 6) AS ist_sin, round(greatest(0, least(375, ((bar_ts + 19800) % 86400 - 33300) / 60)), 4) AS mins_since_open FROM f WHERE is_observed = 1""")
def model_feature_block(spark, d):
    """The computed columns of the 29-column block, with 60- and 300-row windows, at the bars that had ticks."""
    i, v = F.col("i"), F.col("volume")
    book = {f"bid_q{k}": ((v + i * k) % 97).cast("double") for k in range(1, 6)} | {f"ask_q{k}": ((v * 2 + i * (k + 5)) % 89).cast("double") for k in range(1, 6)}
    vols = {"realized_vol_10s": F.when(i % 5 == 0, 0.0).otherwise(0.5 * (i % 5)), "realized_vol_60s": F.when(i % 6 != 0, 0.25 * (i % 6)), "realized_vol_300s": 0.125 * (1 + i % 4)}
    g = grid(spark, d).withColumns(book | vols | {"weighted_mid": F.when(i % 11 != 0, F.col("close") + 0.01 * (i % 3)), "vwap": F.col("close") + 0.02 * (i % 5 - 2), "oi": v * 3 + i % 7, "total_bid_qty": (i % 9).cast("double"), "total_ask_qty": (i % 8).cast("double"), "spread_bps": F.lit(None).cast("double")})
    out = features.model_features(g, S, "bar_ts").where("is_observed = 1")
    places = {"ofi_weighted": 5, "tick_direction_z": 5, "price_autocorr_60": 3, "oi_change_z": 5, "mins_since_open": 4}
    names = ["book_imbalance_weighted", "ofi_weighted", "tick_direction_z", "price_autocorr_60", "vol_regime_ratio", "depth_ratio", "mid_vs_vwap", "vol_ratio_10_60", "oi_change_z", "ist_sin", "mins_since_open"]
    return out.select("symbol", "bar_ts", *[(r(c, places.get(c, 6)) + 0.0).alias(c) for c in names])


@query(GRID + f""", s AS (SELECT symbol, day, bar_ts, round(close - avg(close) {_frame(60)}, 8) AS sig, round(lead(close, 10) OVER ({O}) / close - 1, 8) AS fwd FROM g), v AS (SELECT *, (row_number() OVER ({O}) - 1) // 300 AS chunk, count(*) OVER (PARTITION BY symbol, day) AS n FROM s WHERE fwd IS NOT NULL),
  w AS (SELECT * FROM v WHERE (chunk + 1) * 300 <= n), k AS (SELECT *, rank() OVER (PARTITION BY symbol, day, chunk ORDER BY sig) + (count(*) OVER (PARTITION BY symbol, day, chunk, sig) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol, day, chunk ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, day, chunk, fwd) - 1) / 2 AS ry FROM w),
  c AS (SELECT symbol, day, chunk, CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END AS ic FROM k GROUP BY 1, 2, 3) SELECT symbol, count(ic) AS chunks, round(avg(ic), 4) AS ic_mean, round(stddev_pop(ic), 4) AS ic_std, round(avg(ic) / greatest(stddev_pop(ic), 0.001), 2) AS ic_t FROM c GROUP BY 1""")
def chunked_ic(spark, d):
    """Rank correlation with the return ten rows ahead in whole blocks of 300 rows, its mean, deviation and their ratio."""
    g = grid(spark, d).withColumns({"sig": r(F.col("close") - S.rolling("avg", "close", 60), 8), "fwd": r(evaluate.forward_return("close", 10, ["symbol", "day"], "bar_ts"), 8)})
    c = evaluate.chunked_ic(g.where("fwd is not null"), ["symbol", "day"], "bar_ts", "sig", "fwd", 300)
    sd = F.stddev_pop("ic")
    return c.groupBy("symbol").agg(F.count("ic").alias("chunks"), r(F.avg("ic"), 4).alias("ic_mean"), r(sd, 4).alias("ic_std"), r(F.avg("ic") / F.greatest(sd, F.lit(0.001)), 2).alias("ic_t"))


@query(GRID + f""", v AS (SELECT *, row_number() OVER ({O}) AS n, stddev_samp(close) {_frame(60)} AS s FROM g), w AS (SELECT *, avg(s) {_frame(300)} AS m FROM v) SELECT symbol, bar_ts, round(CASE WHEN n <= 300 THEN s ELSE m END + 1e-9, 5) AS sigma FROM w WHERE is_observed = 1""")
def smoothed_sigma(spark, d):
    g = regression.rolling_stats(grid(spark, d), S, "close", (60,))
    g = regression.rolling_stats(g.withColumn("s", F.col("close_std60")), S, "s", (300,))
    sigma = F.when(F.row_number().over(S.w) <= 300, F.col("s")).otherwise(F.col("s_mean300"))
    return g.withColumn("sigma", sigma).where("is_observed = 1").select("symbol", "bar_ts", r(F.col("sigma") + 1e-9, 5).alias("sigma"))


@query(GRID + f""", v AS (SELECT *, row_number() OVER ({O}) AS n, stddev_samp(close) {_frame(60)} AS vol, close / lag(close) OVER ({O}) - 1 AS r1, close / lag(close, 10) OVER ({O}) - 1 AS r10 FROM g), p AS (SELECT symbol, day, quantile_cont(vol, 0.75) AS p75 FROM v GROUP BY 1, 2),
  w AS (SELECT symbol, day, bar_ts, is_observed, n, avg(vol) OVER ({O} ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING) AS mv, var_samp(r10) OVER ({O} ROWS BETWEEN 290 PRECEDING AND 1 PRECEDING) / nullif(10 * var_samp(r1) OVER ({O} ROWS BETWEEN 299 PRECEDING AND 1 PRECEDING), 0) AS vr FROM v)
  SELECT w.symbol, bar_ts, CASE WHEN n <= 300 THEN 'CHOPPY' WHEN mv > 1.5 * p75 THEN 'VOLATILE' WHEN vr < 0.85 THEN 'MEAN_REVERTING' WHEN vr > 1.15 THEN 'TRENDING' ELSE 'CHOPPY' END AS regime FROM w JOIN p ON w.symbol = p.symbol AND w.day = p.day WHERE is_observed = 1""")
def variance_regime(spark, d):
    g = regression.rolling_stats(grid(spark, d), S, "close", (60,)).withColumnRenamed("close_std60", "vol")
    calm = quantiles.exact_quantiles(g, ["symbol", "day"], "vol", [0.75], ["calm"])
    out = windows.variance_regime(g.join(calm, ["symbol", "day"]), S, "close", 300, 10, "vol", "calm")
    return out.where("is_observed = 1").select("symbol", "bar_ts", "regime")
