"""Queries of sequential, iterative and streaming operators: SQL counterparts only where there are any."""

from __future__ import annotations

from pyspark.sql import functions as F

from microtide.operators import bars, regimes, simulate
from microtide.operators.windows import Series
from microtide.plans.market import BAR, TICK, fills, hourly, r, ticks
from microtide.plans.registry import query


def _daily(spark, d):
    """Hourly bars with the day as session and a momentum signal."""
    b = hourly(spark, d).withColumn("day", F.floor(F.col("bar_ts") / 86_400))
    return b.withColumn("signal", Series(["symbol", "day"], "bar_ts").zscore("close", 5))


@query()
def dollar_bars(spark, d):
    return bars.dollar_bars(ticks(spark, d), ["symbol", "day"], ["ts_us", "event_id"], "price", "qty", 5_000.0)


@query()
def ewm_volatility(spark, d):
    return bars.ewm(ticks(spark, d), ["symbol", "day"], ["ts_us", "event_id"], "price", 60)


@query()
def intensity_decay(spark, d):
    binned = ticks(spark, d).groupBy("symbol", F.floor(F.col("price") / 5).cast("double").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n")).where("bin <= 20")
    return bars.decay_fit(binned, ["symbol"], "bin", "n")


@query()
def mm_backtest(spark, d):
    grid = simulate.grid(spark, gamma=[0.05, 0.1, 0.2])
    return simulate.replay(_daily(spark, d).crossJoin(F.broadcast(grid)), ["symbol", "day", "combo"], ["bar_ts"], simulate.Maker(), "fills long, pnl double, max_drawdown double")


@query()
def directional_backtest(spark, d):
    return simulate.replay(_daily(spark, d), ["symbol", "day"], ["bar_ts"], simulate.Directional(), "entry long, exit long, side int, gain double, reason string")


@query()
def pairs_backtest(spark, d):
    from microtide.operators.joins import align_pairs

    p = align_pairs(hourly(spark, d).select("symbol", "bar_ts", "close"), "symbol", "bar_ts", "close").withColumn("spread", F.log("value_a") - F.log("value_b"))
    p = p.withColumn("day", F.floor(F.col("bar_ts") / 86_400))
    p = p.withColumn("z", Series(["a", "b", "day"], "bar_ts").zscore("spread", 10))
    return simulate.replay(p, ["a", "b", "day"], ["bar_ts"], simulate.Pairs(), "entry long, exit long, side int, gain double, reason string")


@query()
def position_keeping(spark, d):
    return simulate.replay(fills(spark, d), ["l_suppkey"], ["day", "l_orderkey", "l_linenumber"], simulate.positions, "fills long, position double, average double, realised double")


@query()
def risk_gate(spark, d):
    f = fills(spark, d).withColumn("gain", F.when(F.col("side") == "SELL", 1.0).otherwise(-0.5)).withColumn("qty", F.when(F.col("side") == "SELL", -F.col("qty")).otherwise(F.col("qty")))
    return simulate.replay(f, ["l_suppkey"], ["day", "l_orderkey", "l_linenumber"], simulate.RiskGate(), "i long, verdict string, position double, day_gain double")


@query()
def hawkes_intensity(spark, d):
    return simulate.replay(ticks(spark, d).select("symbol", "day", "ts_sec", "event_id"), ["symbol", "day"], ["ts_sec", "event_id"], simulate.hawkes, "ts_sec long, intensity double")


@query()
def hmm_regimes(spark, d):
    t = hourly(spark, d).withColumn("ret", F.log("close") - F.log(BAR.lag("close"))).withColumn("day", F.floor(F.col("bar_ts") / 86_400))
    model = regimes.fit_hmm(t.where("ret is not null"), ["symbol", "day"], ["bar_ts"], "ret", k=3)
    return regimes.apply_hmm(t, model, ["symbol", "day"], ["bar_ts"], "ret")


@query()
def ridge_baseline(spark, d):
    t = hourly(spark, d).withColumns({"y": BAR.lead("close"), "ma": BAR.rolling("avg", "close", 5), "sd": BAR.rolling("stddev_samp", "close", 5)}).dropna(subset=["y", "ma", "sd"])
    model = regimes.ridge(t, ["close", "ma", "sd"], "y", 0.1)
    return spark.createDataFrame([(float(model.summary.rootMeanSquaredError), float(model.summary.r2))], "rmse double, r2 double")


@query()
def autocorrelation_profile(spark, d):
    t = ticks(spark, d).withColumn("x", F.col("price") - TICK.lag("price"))
    out = t.select("symbol", "x", *[TICK.lag("x", k).alias(f"l{k}") for k in range(1, 6)])
    return out.groupBy("symbol").agg(*[r(F.corr("x", f"l{k}")).alias(f"acf_{k}") for k in range(1, 6)])
