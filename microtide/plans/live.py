"""Streaming queries: the event table read as a stream, held against what SQL says of the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microtide.plans.market import T as TICKS
from microtide.plans.market import HOURLY, r
from microtide.plans.registry import query
from microtide.sources.tables import shared_folder
from microtide.streaming import state
from microtide.streaming.bars import stream_bars


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with columns like those of ``ticks``."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), "user_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the input that is there, through a checkpoint and a Parquet sink in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/microtide/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def with_book(t: DataFrame) -> DataFrame:
    """The inputs of the features, made from a tick's price and quantity."""
    levels = {f"{s}_q{k}": ((F.col("qty") * (k + m)) % 97).cast("double") for s, m in (("bid", 2), ("ask", 5)) for k in range(1, 6)}
    vol = {f"realized_vol_{n}s": (1 + (F.col("qty") * n) % m).cast("double") for n, m in ((10, 7), (60, 5), (300, 11))}
    return t.withColumns({"mid": F.col("price"), "vwap": F.col("price") + F.col("qty") % 5 - 2, "oi": (F.col("qty") * 13 % 101).cast("double"), "total_bid_qty": (F.col("qty") % 17).cast("double"), "total_ask_qty": (F.col("qty") % 19).cast("double")} | levels | vol)


_LEVELS = "[" + ", ".join(f"struct_pack(w := {w}e0, b := CAST((qty * {k + 2}) % 97 AS DOUBLE), a := CAST((qty * {k + 5}) % 97 AS DOUBLE))" for k, w in enumerate(state.LEVEL_WEIGHTS, 1)) + "]"


@query(TICKS + f""", x AS (SELECT event_id, symbol, ts_us, price, qty, CASE WHEN price > 0 THEN price END AS pm, CAST((qty * 13) % 101 AS DOUBLE) AS oi, 1e0 + (qty * 10) % 7 AS v10, 1e0 + (qty * 60) % 5 AS v60, 1e0 + (qty * 300) % 11 AS v300,
    list_sum(list_transform({_LEVELS}, lambda l: l.w * l.b)) AS wb, list_sum(list_transform({_LEVELS}, lambda l: l.w * l.a)) AS wa FROM t),
  m AS (SELECT *, coalesce(last_value(pm IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_us, event_id), 1) AS mid FROM x),
  q AS (SELECT *, row_number() OVER o - 1 AS i, coalesce((mid - lag(mid) OVER o) / lag(mid) OVER o, 0) AS ret FROM m WINDOW o AS (PARTITION BY symbol ORDER BY ts_us, event_id)),
  z AS (SELECT *, CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END AS up, lag(ret) OVER o AS prev FROM q WINDOW o AS (PARTITION BY symbol ORDER BY ts_us, event_id)),
  f AS (SELECT *, CASE WHEN i >= 60 AND i % 10 = 0 AND stddev_pop(ret) OVER c > 1e-10 AND stddev_pop(prev) OVER c > 1e-10 THEN corr(prev, ret) OVER c END AS ac,
      avg(up) OVER w60 AS up60, CASE WHEN i < 4 THEN 1 ELSE stddev_pop(up) OVER w300 END AS upsd, avg(v60) OVER w60 AS mv60, avg(v300) OVER w300 AS mv300,
      CASE WHEN i < 4 THEN 1 ELSE stddev_pop(oi) OVER w300 END AS oisd, lag(oi) OVER o AS oi0, lag(wb) OVER o AS wb0, lag(wa) OVER o AS wa0, CASE WHEN price + qty % 5 - 2 > 0 THEN price + qty % 5 - 2 ELSE mid END AS vwap
    FROM z WINDOW o AS (PARTITION BY symbol ORDER BY ts_us, event_id), c AS (PARTITION BY symbol ORDER BY ts_us, event_id ROWS 58 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY ts_us, event_id ROWS 59 PRECEDING), w300 AS (PARTITION BY symbol ORDER BY ts_us, event_id ROWS 299 PRECEDING))
  SELECT event_id, round((wb - wa) / greatest(wb + wa, 1e-8), 6) AS book_imbalance_weighted, round(wb - coalesce(wb0, 0) - wa + coalesce(wa0, 0), 6) AS ofi_weighted, round(CASE WHEN i >= 29 THEN (up60 - 0.5) / greatest(upsd, 0.01) ELSE 0 END, 6) AS tick_direction_z,
    round(coalesce(last_value(ac IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_us, event_id), 0), 6) AS price_autocorr_60, round(mv60 / greatest(mv300, 0.01), 6) AS vol_regime_ratio,
    round(ln(greatest(qty % 17, 1e-8) / greatest(qty % 19, 1e-8)), 6) AS depth_ratio, round((mid - vwap) / greatest(vwap, 1e-8), 6) AS mid_vs_vwap, round(v10 / v60, 6) AS vol_ratio_10_60, round(CASE WHEN i > 0 THEN (oi - oi0) / greatest(oisd, 1e-8) ELSE 0 END, 6) AS oi_change_z FROM f""")
def stream_feature_state(spark, d):
    """Constant-cost features of each symbol's whole stream."""
    with state.with_rocksdb(spark):
        made = state.feature_stream(with_book(event_stream(spark, d)), "symbol", ["at", "event_id"])
        out = drained(made, "features")
    return out.select("event_id", *[(r(f) + 0.0).alias(f) for f in state.FEATURES])


@query(TICKS + """, s AS (SELECT user_id, event_id, ts_us // 1000 AS ms, CASE event_type WHEN 'click' THEN 'WIDEN' WHEN 'error' THEN 'AVOID' WHEN 'purchase' THEN 'PAUSE' ELSE 'NORMAL' END AS action, CASE WHEN event_type = 'purchase' AND value > 20 THEN epoch_us(ts) // 1000 + 60000 END AS pause FROM (SELECT *, epoch_us(ts) AS ts_us FROM events)),
  e AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, action) AS nxt, max(ms) OVER () AS last FROM s),
  u AS (SELECT user_id, ms, CASE WHEN action IN ('PAUSE', 'AVOID') AND (pause IS NULL AND action = 'AVOID' OR ms < pause) THEN 'paused' WHEN action = 'WIDEN' THEN 'widened' ELSE 'normal' END AS state, action FROM e
    UNION ALL SELECT user_id, ms + 900000, 'stale', action FROM e WHERE nxt > ms + 900000 OR nxt IS NULL AND last >= ms + 900000)
  SELECT user_id, ms AS at_ms, state, action FROM u""")
def stream_signal_cache(spark, d):
    """Signals by user with a life of 15 minutes: each one's state when it comes, and when it goes stale."""
    s = event_stream(spark, d)
    action = F.when(F.col("symbol") == "click", "WIDEN").when(F.col("symbol") == "error", "AVOID").when(F.col("symbol") == "purchase", "PAUSE").otherwise("NORMAL")
    pause = F.when((F.col("symbol") == "purchase") & (F.col("price") > 20), F.col("at") + F.expr("INTERVAL 60 SECONDS"))
    with state.with_rocksdb(spark):
        out = drained(state.cached_signals(s.select("user_id", "at", action.alias("action"), pause.alias("pause_until")), "user_id", "at"), "signals")
    return out.select("user_id", F.unix_millis("at").alias("at_ms"), "state", "action")


@query(TICKS + """, s AS (SELECT user_id, ts_us // 1000 AS ms, CASE symbol WHEN 'click' THEN 'WIDEN' WHEN 'error' THEN 'AVOID' ELSE 'NORMAL' END AS action FROM t), l AS (SELECT user_id, arg_max(action, {'a': ms, 'b': action}) AS action, max(ms) AS ms FROM s GROUP BY 1), n AS (SELECT max(ms) AS now FROM s)
  SELECT count(*) AS cached, count(*) FILTER (now - ms > 3600000) AS stale, count(*) FILTER (now - ms <= 3600000 AND action = 'AVOID') AS paused, count(*) FILTER (now - ms <= 3600000 AND action = 'WIDEN') AS widened, count(*) FILTER (now - ms <= 3600000 AND action NOT IN ('AVOID', 'WIDEN')) AS normal FROM l, n""")
def signal_cache_counts(spark, d):
    """How many users' last signals are stale an hour after them, paused, widened or normal at the last event."""
    from microtide.plans.market import ticks

    t = ticks(spark, d)
    action = F.when(F.col("symbol") == "click", "WIDEN").when(F.col("symbol") == "error", "AVOID").otherwise("NORMAL")
    s = t.select("user_id", F.floor(F.col("ts_us") / 1000).alias("ms"), action.alias("action"))
    last = s.groupBy("user_id").agg(F.max(F.struct("ms", "action")).alias("l"))
    now = F.broadcast(s.agg(F.max("ms").alias("now")))  # one row
    fresh = F.col("now") - F.col("l.ms") <= 3_600_000
    count = lambda test: F.count(F.when(test, 1))
    return last.crossJoin(now).agg(
        F.count(F.lit(1)).alias("cached"), count(~fresh).alias("stale"), count(fresh & (F.col("l.action") == "AVOID")).alias("paused"),
        count(fresh & (F.col("l.action") == "WIDEN")).alias("widened"), count(fresh & ~F.col("l.action").isin("AVOID", "WIDEN")).alias("normal"))


@query(TICKS + HOURLY + " SELECT symbol, bar_ts, open, high, low, close, volume, tick_count FROM b")
def stream_replay_bars(spark, d):
    """Hourly bars in append mode: a bar is written once, when the watermark has passed it.

    A closing row, a year after 2024's ticks and without a symbol, comes with the stream: it
    moves the watermark past all bars, and its own bar stays open.
    """
    s = event_stream(spark, d).where("price > 0").select("symbol", "at", "price", "qty")
    closing = f"{shared_folder(spark)}/microtide/closing-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(None).cast("string").alias("symbol"), F.to_timestamp(F.lit("2025-06-01")).alias("at"), F.lit(1.0).alias("price"), F.lit(0).cast("long").alias("qty")).write.parquet(closing)
    both = s.unionByName(spark.readStream.schema(s.schema).parquet(closing))
    out = drained(stream_bars(both, "symbol", "at", "price", "qty", "1 hour"), "bars")
    return out.select("symbol", F.unix_seconds("bar_start").alias("bar_ts"), "open", "high", "low", "close", "volume", "tick_count")
