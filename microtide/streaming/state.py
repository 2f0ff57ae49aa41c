"""Stateful processors: per-symbol model features of constant cost per bar, and a signal cache whose entries go stale.

State lives in RocksDB, one small value per key, read and written once per key and micro-batch.
Both need Spark's RocksDB provider: ``with_rocksdb`` sets it for the streams started in its block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Weights of the five book levels. Fixed values.
LEVEL_WEIGHTS = (0.40, 0.25, 0.15, 0.12, 0.08)


@contextmanager
def with_rocksdb(spark: SparkSession):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Ring:
    """The last ``n`` values with their sum and sum of squares about the first value ever seen, each update in constant time."""

    def __init__(self, n: int, values: list[float] | None = None, base: float | None = None):
        self.n, self.values, self.base, self.at = n, list(values or []), base, 0
        self.one = math.fsum(v - base for v in self.values) if self.values else 0.0
        self.two = math.fsum((v - base) ** 2 for v in self.values) if self.values else 0.0

    def add(self, v: float) -> None:
        if self.base is None:
            self.base = v
        if len(self.values) < self.n:
            self.values.append(v)
        else:
            out = self.values[self.at] - self.base
            self.one, self.two = self.one - out, self.two - out * out
            self.values[self.at] = v
            self.at = (self.at + 1) % self.n
        x = v - self.base
        self.one, self.two = self.one + x, self.two + x * x

    def __len__(self) -> int:
        return len(self.values)

    def mean(self) -> float:
        return self.base + self.one / len(self.values) if self.values else 0.0

    def deviation(self) -> float:
        """Population deviation; 1 under five values, 1e-8 at least."""
        if len(self.values) < 5:
            return 1.0
        m = self.one / len(self.values)
        return max(math.sqrt(max(self.two / len(self.values) - m * m, 0.0)), 1e-8)

    def ordered(self) -> list[float]:
        return self.values[self.at :] + self.values[: self.at]


RINGS = {"ret": 60, "up_60": 60, "up_300": 300, "vol_60": 60, "vol_300": 300, "oi": 300}
FEATURES = ("book_imbalance_weighted", "ofi_weighted", "tick_direction_z", "price_autocorr_60", "vol_regime_ratio", "depth_ratio", "mid_vs_vwap", "vol_ratio_10_60", "oi_change_z")
#: Columns that a bar has; missing ones count as null.
INPUTS = ("mid", "vwap", "oi", "realized_vol_10s", "realized_vol_60s", "realized_vol_300s", "total_bid_qty", "total_ask_qty", *[f"{s}_q{k}" for s in ("bid", "ask") for k in range(1, 6)])


class Features:
    """The features of one symbol, bar by bar."""

    def __init__(self, saved: tuple | None = None):
        self.mid, self.oi, self.autocorr, self.bars, self.bid, self.ask, *rings = saved or (None, None, 0.0, 0, [0.0] * 5, [0.0] * 5)
        self.bid, self.ask = list(self.bid), list(self.ask)
        self.rings = {name: Ring(n, *rings[2 * i : 2 * i + 2]) for i, (name, n) in enumerate(RINGS.items())}

    def saved(self) -> tuple:
        rings = [x for r in self.rings.values() for x in (r.ordered(), r.base)]
        return (self.mid, self.oi, self.autocorr, self.bars, self.bid, self.ask, *rings)

    def update(self, bar: dict) -> tuple:
        def safe(name: str, default: float) -> float:
            v = bar.get(name)
            return default if v is None or not math.isfinite(v) else float(v)

        mid = safe("mid", 0.0)
        mid = mid if mid > 0 else self.mid or 1.0
        ret = (mid - self.mid) / self.mid if self.mid else 0.0
        r = self.rings
        v10, v60, v300 = (max(safe(f"realized_vol_{n}s", 2.0), 0.001) for n in (10, 60, 300))
        oi = safe("oi", 0.0)
        for name, v in (("ret", ret), ("up_60", float(ret > 0)), ("up_300", float(ret > 0)), ("vol_60", v60), ("vol_300", v300), ("oi", oi)):
            r[name].add(v)
        bids, asks = ([safe(f"{s}_q{k}", 0.0) for k in range(1, 6)] for s in ("bid", "ask"))
        wb, wa = (sum(w * q for w, q in zip(LEVEL_WEIGHTS, qs)) for qs in (bids, asks))
        ofi = sum(w * (b - pb - a + pa) for w, b, pb, a, pa in zip(LEVEL_WEIGHTS, bids, self.bid, asks, self.ask))
        if len(r["ret"]) >= 60 and self.bars % 10 == 0:
            past = np.array(r["ret"].ordered())
            if past[:-1].std() > 1e-10 and past[1:].std() > 1e-10:
                self.autocorr = float(np.corrcoef(past[:-1], past[1:])[0, 1])
        vwap = safe("vwap", mid)
        vwap = vwap if vwap > 0 else mid
        tb, ta = (max(safe(f"total_{s}_qty", 0.0), 1e-8) for s in ("bid", "ask"))
        out = (
            (wb - wa) / max(wb + wa, 1e-8),
            ofi,
            (r["up_60"].mean() - 0.5) / max(r["up_300"].deviation(), 0.01) if self.bars >= 29 else 0.0,
            self.autocorr,
            r["vol_60"].mean() / max(r["vol_300"].mean(), 0.01),
            math.log(tb / ta),
            (mid - vwap) / max(vwap, 1e-8),
            v10 / v60,
            (oi - self.oi) / max(r["oi"].deviation(), 1e-8) if self.bars else 0.0,
        )
        self.mid, self.oi, self.bid, self.ask, self.bars = mid, oi, bids, asks, self.bars + 1
        return out


_SAVED = "last_mid double, last_oi double, autocorr double, bars long, bid array<double>, ask array<double>, " + ", ".join(f"{n} array<double>, {n}_base double" for n in RINGS)


#: Rows that are turned into dicts and results at once.
CHUNK = 10_000


def _narrow(v: np.ndarray) -> np.ndarray:
    """The values in half the width, where that loses nothing."""
    small = v.astype(np.float32)
    return small if np.array_equal(small, v, equal_nan=True) else v


class FeatureProcessor(StatefulProcessor):
    """Bars of a key in order of ``order`` within a micro-batch; what is kept per key doesn't grow."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("features", _SAVED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # All of the micro-batch's rows are held for their order, as narrow columns; dicts and results only of CHUNK rows.
        orders, columns = [], {c: [] for c in INPUTS}
        for f in rows:
            orders.append(f[self.order])
            for c in columns:
                if c in f:
                    columns[c].append(_narrow(f[c].to_numpy(float)))
        frame = pd.concat(orders, ignore_index=True)
        for c in INPUTS:
            held = columns.pop(c)
            if held:
                columns[c] = np.concatenate(held)
        at = frame.sort_values(self.order).index.to_numpy()
        now = Features(self.state.get() if self.state.exists() else None)
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            made = [now.update(bar) for bar in pd.DataFrame({c: v[part].astype(float) for c, v in columns.items()}).to_dict("records")]
            if i + CHUNK >= len(at):
                self.state.update(now.saved())
            out = frame.iloc[part].reset_index(drop=True)
            out.insert(0, self.key, [key[0]] * len(part))
            yield pd.concat([out, pd.DataFrame(made, columns=list(FEATURES))], axis=1)

    def close(self) -> None:
        pass


def feature_stream(bars: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, order columns, FEATURES) of a stream of bars with the columns INPUTS, as rows arrive.

    The features are those of a symbol's whole history in arrival order: a restart from the
    checkpoint goes on where it was. Missing inputs take the defaults of the batch features.
    """
    kinds = dict(bars.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (key, *order)], *[f"{f} double" for f in FEATURES]])
    return bars.groupBy(key).transformWithStateInPandas(FeatureProcessor(key, order), schema, "append", "None")


class CacheProcessor(StatefulProcessor):
    """The last signal of a key; one row when it comes, one when it has stood for ``ttl`` seconds without another."""

    def __init__(self, key: str, ts: str, ttl: int):
        self.key, self.ts, self.ttl = key, ts, ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("signal", "action string, pause_ms long, cached_ms long")

    def _row(self, key, at: int, state: str, action: str) -> tuple:
        return (key[0], pd.Timestamp(at, unit="ms"), state, action)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "at", "state", "action"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.state.get() if self.state.exists() else None, []
        frame = pd.concat(list(rows)).sort_values([self.ts, "action"])
        for ts, action, pause in zip(frame[self.ts], frame["action"], frame["pause_until"], strict=True):
            at = ts.value // 1_000_000
            if held is not None:
                if at > held[2] + self.ttl:  # it went stale before this one came
                    out.append(self._row(key, held[2] + self.ttl, "stale", held[0]))
                elif at < held[2]:
                    continue  # an older signal doesn't replace a newer one
            held = (action, None if pause is None or pd.isna(pause) else pause.value // 1_000_000, at)
            paused = action in ("PAUSE", "AVOID") and (held[1] is None and action == "AVOID" or held[1] is not None and at < held[1])
            out.append(self._row(key, at, "paused" if paused else "widened" if action == "WIDEN" else "normal", action))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.state.update(held)
        self.handle.registerTimer(held[2] + self.ttl)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        action, _, cached = self.state.get()
        self.state.clear()
        yield self._frame([self._row(key, cached + self.ttl, "stale", action)])

    def close(self) -> None:
        pass


def cached_signals(signals: DataFrame, key: str, ts: str, ttl: int = 900, late: str = "0 seconds") -> DataFrame:
    """(key, at, state, action) of a stream of signals (key, ts, action, pause_until).

    A signal gives a row paused, widened or normal; ``ttl`` seconds of event time later, if no
    other came, a row stale, and its state goes. Older signals than the one held change nothing;
    such that come after the watermark are left out by Spark.
    """
    kinds = dict(signals.dtypes)
    schema = f"{key} {kinds[key]}, at timestamp, state string, action string"
    return signals.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(CacheProcessor(key, ts, ttl), schema, "append", "EventTime")
