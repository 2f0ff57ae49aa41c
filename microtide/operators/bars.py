"""Ticks to bars, regular grids, coverage and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microtide.operators.windows import Series, islands


def flatten_depth(ticks: DataFrame, levels: int = 5) -> DataFrame:
    """Nested ``depth.buy`` and ``depth.sell`` to bid_p1.. ask_q5, missing levels as zeros."""
    cols = []
    for side, name in (("buy", "bid"), ("sell", "ask")):
        for i in range(levels):
            level = F.get(F.col(f"depth.{side}"), F.lit(i))
            cols.append(F.coalesce(level["price"], F.lit(0.0)).alias(f"{name}_p{i + 1}"))
            cols.append(F.coalesce(level["quantity"], F.lit(0)).cast("long").alias(f"{name}_q{i + 1}"))
    return ticks.select(*[c for c in ticks.columns if c != "depth"], *cols)


def time_bars(ticks: DataFrame, keys: list[str], ts_sec: str, order: list[str], price: str, qty: str, seconds: int = 1) -> DataFrame:
    """OHLC, volume, count, vwap and spread of price per key and bucket; first and last by ``order``, whose last column breaks ties."""
    at = F.struct(*order)
    bucket = (F.col(ts_sec) - F.pmod(F.col(ts_sec), F.lit(seconds))).alias("bar_ts")
    return ticks.where(F.col(price) > 0).groupBy(*keys, bucket).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(qty).alias("volume"), F.count(F.lit(1)).alias("tick_count"),
        (F.sum(F.col(price) * F.col(qty)) / F.nullif(F.sum(qty), F.lit(0))).alias("vwap"),
        F.stddev_samp(price).alias("price_std"),
    )


def last_snapshot(ticks: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """All ``columns`` of the last tick of each key in one aggregate."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("s")
    return ticks.groupBy(*keys).agg(last).select(*keys, *[F.col(f"s.{c}").alias(c) for c in columns])


def rolling_features(bars: DataFrame, keys: list[str], ts: str = "bar_ts", n: int = 10) -> DataFrame:
    """Rolling standard deviation, mean, z-score, momentum and volume ratio of a bar series."""
    s = Series(keys, ts)
    return bars.withColumns({
        f"close_std_{n}": s.rolling("stddev_samp", "close", n),
        f"close_ma_{n}": s.rolling("avg", "close", n),
        f"close_z_{n}": s.zscore("close", n),
        f"momentum_{n}": s.momentum("close", n),
        f"volume_ratio_{n}": F.col("volume") / F.nullif(s.rolling("avg", "volume", n), F.lit(0.0)),
    })


def regularize(bars: DataFrame, keys: list[str], ts: str, step: int, state: list[str], flow: list[str]) -> DataFrame:
    """Every ``step`` from a key's first to its last bar: state columns carried forward, flow columns zero where nothing was."""
    s = Series(keys, ts)
    # Each bar is repeated up to the next one: one shuffle by key, no grid to join.
    until = F.greatest(F.col(ts), F.coalesce(s.lead(ts) - step, F.col(ts)))
    long = bars.select(*keys, ts, *state, *flow).withColumn("__until", until)
    long = long.withColumn("__t", F.explode(F.sequence(F.col(ts), F.col("__until"), F.lit(step).cast("long"))))
    seen = F.col("__t") == F.col(ts)
    long = long.select(*keys, F.col("__t").alias(ts), *state, *[F.when(seen, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).alias(c) for c in flow], seen.cast("int").alias("is_observed"))
    return long.withColumns({c: s.ffill(c) for c in state})


def coverage(ticks: DataFrame, keys: list[str], bucket: Column, expected: int) -> DataFrame:
    """Distinct buckets present of those expected, and a status."""
    got = ticks.groupBy(*keys).agg(F.count_distinct(bucket).alias("present"))
    share = F.col("present") / F.lit(expected)
    status = F.when(share >= 0.95, "HEALTHY").when(share >= 0.80, "DEGRADED").otherwise("INCOMPLETE")
    return got.select(*keys, "present", F.lit(expected).alias("expected"), (share * 100).alias("coverage_pct"), status.alias("status"))


def longest_gap(present: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Missing buckets between a key's first and last, and the longest run of them."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    gaps = present.select(*keys, bucket).distinct().withColumn("gap", F.col(bucket) - F.lag(bucket).over(w) - 1)
    return gaps.groupBy(*keys).agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("missing"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.count(F.when(F.col("gap") > 0, 1)).alias("gaps"))


def run_lengths(df: DataFrame, s: Series, by: list[str], flag: str) -> DataFrame:
    """Number of closed runs of ``flag`` by ``by`` with their longest, median and upper-quartile length.

    Runs end with their session; the one still open at a session's end isn't counted.
    """
    closed = islands(df, s, flag).where("not run_open")
    return closed.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.max("run_length").alias("longest_run"), F.percentile("run_length", 0.5).alias("median_run"), F.percentile("run_length", 0.75).alias("p75_run"))


def dollar_bars(ticks: DataFrame, keys: list[str], order: list[str], price: str, qty: str, threshold: float) -> DataFrame:
    """Bars that close once their traded value reaches ``threshold``; the last, open one is dropped.

    The running value restarts at zero when a bar closes, which no window frame expresses: each
    key's ticks are one ordered group in a grouped map. A key is a session (symbol and date),
    which bounds the group.
    """
    kinds = dict(ticks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", bar_id long, open double, high double, low double, close double, volume double, value double, ticks long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        p, q = frame[price].to_numpy(float), frame[qty].to_numpy(float)
        value, ends, total = p * q, [], 0.0
        for i, v in enumerate(value):
            total += v
            if total >= threshold:
                ends.append(i + 1)
                total = 0.0
        starts = [0, *ends[:-1]]
        rows = [(b, p[i], p[i:j].max(), p[i:j].min(), p[j - 1], q[i:j].sum(), value[i:j].sum(), j - i) for b, (i, j) in enumerate(zip(starts, ends, strict=False))]
        out = pd.DataFrame(rows, columns=["bar_id", "open", "high", "low", "close", "volume", "value", "ticks"])
        for k in keys[::-1]:
            out.insert(0, k, frame[k].iloc[0])
        return out

    return ticks.select(*keys, *order, price, qty).groupBy(*keys).applyInPandas(run, schema)


def ewm(df: DataFrame, keys: list[str], order: list[str], x: str, span: int) -> DataFrame:
    """Exponentially weighted mean and standard deviation (adjusted weights, bias-corrected) of each ordered key."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *order, x]) + ", ewm_mean double, ewm_std double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        e = frame[x].astype(float).ewm(span=span)
        return frame.assign(ewm_mean=e.mean(), ewm_std=e.std())

    return df.select(*keys, *order, x).groupBy(*keys).applyInPandas(run, schema)


def fit_exponential(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Least squares of y = a exp(-k x): log-linear start, then Gauss-Newton."""
    ok = y > 0
    if ok.sum() < 2:
        return float("nan"), float("nan")
    slope, at0 = np.polyfit(x[ok], np.log(y[ok]), 1)
    a, k = float(np.exp(at0)), float(-slope)
    for _ in range(steps):
        e = np.exp(-k * x)
        jac = np.stack([e, -a * x * e], 1)
        step, *_ = np.linalg.lstsq(jac, y - a * e, rcond=None)
        a, k = a + step[0], k + step[1]
        if np.abs(step).max() < 1e-12:
            break
    return a, k


def decay_fit(binned: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, scale, rate) of an exponential decay through each key's bins, of which there are few."""
    kinds = dict(binned.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", scale double, rate double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=[x, y])
        a, k = fit_exponential(frame[x].to_numpy(float), frame[y].to_numpy(float))
        return pd.DataFrame([[*(frame[c].iloc[0] for c in keys), a, k]], columns=[*keys, "scale", "rate"]) if len(frame) else pd.DataFrame(columns=[*keys, "scale", "rate"])

    return binned.groupBy(*keys).applyInPandas(run, schema)


def micro_batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Re-cut a stream of frames into frames of ``size`` rows."""
    held: list[pd.DataFrame] = []
    count = 0
    for f in frames:
        held.append(f)
        count += len(f)
        while count >= size:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:size]
            held, count = [whole.iloc[size:]], len(whole) - size
    if count:
        yield pd.concat(held, ignore_index=True)
