"""Bars of instruments, spot with its fallback, validated merges, and the scalars of quoting and sizing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microtide.functions import scalar


def instrument_bars(ticks: DataFrame, keys: list[str], ts_sec: str, order: list[str], price: str, volume: str, seconds: int = 1) -> DataFrame:
    """Bars with the change of a cumulative ``volume`` within the bar and its last value, and the mean, largest and deviation of price.

    Futures take volume_delta (last - first), options volume_last.
    """
    at = F.struct(*order)
    bucket = (F.col(ts_sec) - F.pmod(F.col(ts_sec), F.lit(seconds))).alias("bar_ts")
    return ticks.where(F.col(price) > 0).groupBy(*keys, bucket).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        (F.max_by(volume, at) - F.min_by(volume, at)).alias("volume_delta"), F.max_by(volume, at).alias("volume_last"),
        F.count(F.lit(1)).alias("tick_count"), F.avg(price).alias("price_mean"), F.stddev_samp(price).alias("price_std"),
    )


def spot_prices(ticks: DataFrame, keys: list[str], ts_sec: str, order: list[str], price: str, rank: Column) -> DataFrame:
    """(keys, ts_sec, spot_price, rank): the last price per second of the source of the least ``rank`` that a key has at all.

    A key (underlying and day) whose first source has any price never takes the next one's: a
    second without one has no row. Null ranks are no source.
    """
    rows = ticks.withColumn("__rank", rank).where(F.col("__rank").isNotNull() & (F.col(price) > 0))
    best = F.min("__rank").over(Window.partitionBy(*keys))
    at = F.struct(*order)
    rows = rows.withColumn("__best", best).where("__rank = __best")
    return rows.groupBy(*keys, ts_sec).agg(F.max_by(price, at).alias("spot_price"), F.first("__rank").alias("rank"))


def fill_both_ways(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Nulls take the last value before them, those at a key's start the first after. The latter look ahead."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(before, after))


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose keys must be unique on both sides; ValueError names the side and how many keys repeat."""
    for name, side in (("left", left), ("right", right)):
        repeated = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        if repeated:
            raise ValueError(f"{name} side: {repeated} keys of {', '.join(keys)} repeat")
    return left.join(right, keys, how)


def aligned_columns(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly ``columns``, in that order, as doubles: missing ones and nulls are ``fill``."""
    there = set(df.columns)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) if c in there else F.lit(fill).alias(c) for c in columns])


def upcoming(events: DataFrame, symbols: DataFrame, key: str, date: str, today: Column, days: int) -> DataFrame:
    """Events of the symbols from today to ``days`` days ahead, with days_until; symbols meet events on the key alone."""
    ahead = F.datediff(F.col(date), today)
    return events.withColumn("days_until", ahead).where(F.col("days_until").between(0, days)).join(symbols.select(key).distinct(), key, "left_semi")


def implied_vol_newton(call: Column, price: Column, s: Column, k: Column, t: Column, r: float = 0.065, start: float = 0.10, tol: float = 1e-5, steps: int = 100) -> Column:
    """Newton's method in volatility: halved where a step leaves the positive numbers, ended by ``tol`` or a flat price.

    Null below intrinsic value, without time or price, and where the result isn't inside
    (0.001, 5). Each step is numpy's over a batch of rows.
    """
    intrinsic = F.greatest(F.lit(0.0), F.when(call, s - k).otherwise(k - s))

    @F.pandas_udf("double")
    def newton(sign: pd.Series, price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        sign, price, s, k, t = (x.to_numpy(float) for x in (sign, price, s, k, t))
        v, done = np.full(len(s), start), np.zeros(len(s), bool)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                if done.all():
                    break
                at, vega = scalar.price_and_vega(sign, s, k, t, r, v)
                still = done | (np.abs(vega) < 1e-10)
                new = v - (at - price) / np.where(still, 1.0, vega)
                done = still | ((new > 0) & (np.abs(new - v) < tol))
                v = np.where(still, v, np.where(new <= 0, v / 2, new))
        return pd.Series(v)

    found = newton(F.when(call, 1.0).otherwise(-1.0), price, s, k, t)
    live = (t > 0) & (price > 0) & (price >= intrinsic - 1e-6)
    found = F.when(live, found)
    return F.when((found > 0.001) & (found < 5.0), found)


def moneyness(s: Column, k: Column) -> Column:
    return (s - k) / F.nullif(s, F.lit(0.0))


def tradeable(half_life: Column, spread_std_bps: Column, daily_signals: Column, hedge_ratio: Column, fastest: float = 30, slowest: float = 1800, least_bps: float = 2.0) -> Column:
    """'ok' or the first rule that a pair fails: too fast, too slow, spread too small, few signals, negative hedge."""
    return (
        F.when(half_life < fastest, "half_life too fast").when(half_life > slowest, "half_life too slow").when(spread_std_bps < least_bps, "spread too small")
        .when(daily_signals < 5, "few signals").when(hedge_ratio <= 0, "negative hedge").otherwise("ok")
    )


def hit_rate(df: DataFrame, keys: list[str], signal: str, ret: str, threshold: float = 0.2, least: int = 50) -> DataFrame:
    """(keys, n_signals, pct_active, hit_rate_pct) of signals beyond +-threshold; keys under ``least`` active rows are left out."""
    side = F.when(F.col(signal) > threshold, 1).when(F.col(signal) < -threshold, -1).otherwise(0)
    rows = df.withColumn("__side", side)
    active = (F.col("__side") != 0) & F.col(ret).isNotNull()
    right = active & (F.signum(ret) == F.col("__side"))
    out = rows.groupBy(*keys).agg(F.count(F.when(active, 1)).alias("n_signals"), (100 * F.avg((F.col("__side") != 0).cast("double"))).alias("pct_active"), (100 * F.count(F.when(right, 1)) / F.nullif(F.count(F.when(active, 1)), F.lit(0))).alias("hit_rate_pct"))
    return out.where(F.col("n_signals") >= least)


def ic_decay(ics: DataFrame, keys: list[str], horizon: str, ic: str) -> DataFrame:
    """(keys, ic0, decay_rate, half_life, peak_ic): ln IC on horizon by least squares over positive ICs; null under three."""
    slope, at0 = F.regr_slope(F.log(ic), horizon), F.regr_intercept(F.log(ic), horizon)
    n = F.count(F.when(F.col(ic) > 0, 1))
    pos = ics.withColumn(ic, F.col(ic).cast("double"))
    fit = pos.where(F.col(ic) > 0).groupBy(*keys).agg(F.when(n >= 3, F.exp(at0)).alias("ic0"), F.when(n >= 3, -slope).alias("decay_rate"))
    peak = pos.groupBy(*keys).agg(F.max(ic).alias("peak_ic"))
    life = F.when(F.col("decay_rate").isNotNull(), F.lit(0.6931471805599453) / F.greatest(F.col("decay_rate"), F.lit(1e-8)))
    return peak.join(fit, keys, "left").select(*keys, "ic0", "decay_rate", life.alias("half_life"), "peak_ic")


def price_ratio(bars: DataFrame, key: str, order: list[str], price: str, pairs: DataFrame, old: str, new: str, rows: int = 100) -> DataFrame:
    """``pairs`` with price_ratio: median of the new contract's first over the old one's last ``rows`` prices, held within 0.7 and 1.3; 1 where either is missing."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    ranked = bars.select(key, price, up.alias("__up"), down.alias("__down"))
    ends = ranked.groupBy(key).agg(F.percentile(F.when(F.col("__up") <= rows, F.col(price)), 0.5).alias("__first"), F.percentile(F.when(F.col("__down") <= rows, F.col(price)), 0.5).alias("__last"))
    a = ends.select(F.col(key).alias(old), F.col("__last").alias("__o"))
    b = ends.select(F.col(key).alias(new), F.col("__first").alias("__n"))
    ratio = F.when((F.col("__o") >= 1e-8) & F.col("__n").isNotNull(), F.greatest(F.lit(0.7), F.least(F.lit(1.3), F.col("__n") / F.col("__o"))))
    return pairs.join(a, old, "left").join(b, new, "left").select(*pairs.columns, F.coalesce(ratio, F.lit(1.0)).alias("price_ratio"))


def equity_key(symbol: Column) -> Column:
    """A contract's equity: the name without its expiry; null for currencies and for what is nothing but a suffix."""
    base = F.regexp_replace(symbol, r"[0-9]{2}[A-Z]{3}FUT$", "")
    return F.when(~symbol.contains("USDINR") & (base != ""), base)


def option_jobs(files: DataFrame, processed: DataFrame, symbol: str = "symbol", date: str = "date", underlyings: Sequence[str] = ("BANKNIFTY", "NIFTY"), barred: Sequence[str] = ("NIFTYNXT",)) -> DataFrame:
    """(underlying, date) that raw option files have and ``processed`` (underlying, date) lacks: all strikes of a day are one job.

    A symbol's underlying is the first of ``underlyings`` that it starts with; ``barred`` starts have none.
    """
    name = F.col(symbol)
    out = F.lit(None).cast("string")
    for b in barred:
        out = F.when(name.startswith(b), F.lit(None).cast("string"))
    for u in underlyings:
        out = out.when(name.startswith(u), u)
    raw = files.where(name.endswith("CE") | name.endswith("PE")).select(out.alias("underlying"), F.col(date).alias("date")).where("underlying is not null").distinct()
    return raw.join(processed.select("underlying", "date"), ["underlying", "date"], "left_anti")


def best_contracts(files: DataFrame, symbol: str, date: str, start: str, end: str) -> DataFrame:
    """(base, symbol): per base name the greatest contract name with a file from ``start`` to ``end``."""
    live = files.where(F.col(date).between(start, end)).select(scalar.base_symbol(F.col(symbol)).alias("base"), F.col(symbol).alias("__s")).where("base != __s")
    return live.groupBy("base").agg(F.max("__s").alias("symbol"))


def recent_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key; a window that keeps n rows a task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def realized_variance(df: DataFrame, keys: list[str], order: list[str], price: str, n: int = 20, periods: int = 375 * 60) -> DataFrame:
    """``df`` with realized_var (population) of the log returns within the last n prices, annualized_vol from it, and rolling_var (sample) of the last n returns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ret = F.log(F.col(price)) - F.log(F.lag(price).over(w))
    df = df.withColumn("__r", ret)
    inside = w.rowsBetween(-(n - 2), 0)
    var = F.coalesce(F.var_pop("__r").over(inside), F.lit(0.0))
    full = F.when(F.count("__r").over(w.rowsBetween(-(n - 1), 0)) >= n, F.var_samp("__r").over(w.rowsBetween(-(n - 1), 0)))
    return df.withColumns({"realized_var": var, "annualized_vol": F.sqrt(var * periods), "rolling_var": full}).drop("__r")
