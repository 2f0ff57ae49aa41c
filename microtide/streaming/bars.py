"""Streaming counterparts: bars by watermark, keyed rolling state, deduplication and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, key: str, ts: str, price: str, qty: str, width: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """OHLC bars in append mode: a bar closes when the watermark passes its end, so late ticks within ``late`` count.

    First and last are by event time, ties by the value itself.
    """
    at = F.struct(ts, price)
    return (
        ticks.withWatermark(ts, late)
        .groupBy(key, F.window(ts, width))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
            F.sum(qty).alias("volume"), F.count(F.lit(1)).alias("tick_count"), F.stddev_pop(price).alias("price_std"),
        )
        .select(key, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "tick_count", "price_std")
    )


def rolling_state(bars: DataFrame, key: str, key_type: str, ts: str, x: str, n: int) -> DataFrame:
    """Rolling mean, standard deviation and momentum of the last ``n`` values per key, kept as bounded keyed state.

    Rows of a micro-batch are taken in order of time; the state is the last n values, n at most.
    """
    out = f"{key} {key_type}, {ts} timestamp, {x} double, mean double, std double, momentum double"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(ts)
        rows = []
        for t, v in zip(frame[ts], frame[x].astype(float), strict=True):
            past = [*past, v][-n:]
            s = pd.Series(past)
            rows.append((k[0], t, v, s.mean(), s.std() if len(s) > 1 else None, v / past[0] - 1 if len(past) == n and past[0] else None))
        state.update((past,))
        yield pd.DataFrame(rows, columns=[key, ts, x, "mean", "std", "momentum"])

    return bars.groupBy(key).applyInPandasWithState(run, out, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def execution_state(signals: DataFrame, key: str, key_type: str, ts: str, enter: float, profit: float, stop: float, hold_s: int) -> DataFrame:
    """One open position per key: entry on |pred| >= enter, exit by profit, stop or time; closed trades are emitted."""
    out = f"{key} {key_type}, entry_ts timestamp, exit_ts timestamp, side int, gain double, reason string"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, entry, since = state.get if state.exists else (0, 0.0, None)
        rows = []
        for t, p, s in pd.concat(list(frames)).sort_values(ts)[[ts, "price", "pred"]].itertuples(index=False):
            if side:
                gain = side * (p / entry - 1)
                why = "TP" if gain >= profit else "SL" if gain <= -stop else "TIMEOUT" if (t - since).total_seconds() >= hold_s else ""
                if why:
                    rows.append((k[0], since, t, side, gain, why))
                    side = 0
            elif abs(s) >= enter:
                side, entry, since = (1 if s > 0 else -1), float(p), t
        state.update((side, entry, since))
        yield pd.DataFrame(rows, columns=[key, "entry_ts", "exit_ts", "side", "gain", "reason"])

    return signals.groupBy(key).applyInPandasWithState(run, out, "side int, entry double, since timestamp", "append", GroupStateTimeout.NoTimeout)


def dedupe(news: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """First arrival of each key; its state goes once the watermark has passed."""
    return news.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def flush_to(stream: DataFrame, path: str, checkpoint: str, by: list[str], every: str = "60 seconds"):
    """Partitioned Parquet sink on a fixed trigger, exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).trigger(processingTime=every).start()
