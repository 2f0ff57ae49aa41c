"""Trading replays: state machines over ordered groups.

A quote depends on the inventory, and that on past fills, so no window expresses a replay. Each
(symbol, session, parameter set) is one ordered group of a grouped map. Sessions are days, which
bounds a group; parameter sets multiply groups, not their size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(spark, **axes) -> DataFrame:
    """All combinations of parameter values, numbered."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.withColumn("combo", F.concat_ws("/", *axes))


def replay(bars: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], list[tuple]], out: str) -> DataFrame:
    """Run ``step`` over each key's ordered bars; its rows are prefixed by the key."""
    kinds = dict(bars.dtypes)
    names = [p.split()[0] for p in out.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order).reset_index(drop=True)
        made = pd.DataFrame(step(frame), columns=names)
        for k in keys[::-1]:
            made.insert(0, k, frame[k].iloc[0])
        return made

    return bars.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + out)


@dataclass(frozen=True)
class Maker:
    """A two-sided quoter: half spread from gamma, sigma and kappa, skewed by inventory, flat at the end."""

    gamma: float = 0.1
    kappa: float = 1.5
    max_inventory: int = 5

    def __call__(self, frame: pd.DataFrame) -> list[tuple]:
        price, low, high = (frame[c].to_numpy(float) for c in ("close", "low", "high"))
        g = float(frame["gamma"].iloc[0]) if "gamma" in frame else self.gamma
        n, inventory, cash, fills, deepest, peak = len(price), 0, 0.0, 0, 0.0, 0.0
        for i in range(1, n):
            mid, sigma = price[i - 1], float(np.std(price[max(0, i - 20) : i])) if i > 1 else 0.0
            left = (n - i) / n
            reserve = mid - inventory * g * sigma * sigma * left
            half = (g * sigma * sigma * left + 2 / g * np.log1p(g / self.kappa)) / 2
            if low[i] <= reserve - half and inventory < self.max_inventory:
                inventory, cash, fills = inventory + 1, cash - (reserve - half), fills + 1
            if high[i] >= reserve + half and inventory > -self.max_inventory:
                inventory, cash, fills = inventory - 1, cash + reserve + half, fills + 1
            worth = cash + inventory * price[i]
            peak = max(peak, worth)
            deepest = max(deepest, peak - worth)
        if n and inventory:
            cash, fills, inventory = cash + inventory * price[-1], fills + 1, 0
        return [(fills, cash, deepest)]


@dataclass(frozen=True)
class Directional:
    """Enter on a signal, leave by take-profit, stop-loss or time, and at the session's end."""

    enter: float = 1.0
    profit: float = 0.01
    stop: float = 0.01
    hold: int = 10

    def __call__(self, frame: pd.DataFrame) -> list[tuple]:
        price, signal = frame["close"].to_numpy(float), frame["signal"].to_numpy(float)
        side, entry, since, out = 0, 0.0, 0, []
        for i, (p, s) in enumerate(zip(price, signal, strict=True)):
            if side:
                gain = side * (p / entry - 1)
                why = "TP" if gain >= self.profit else "SL" if gain <= -self.stop else "TIME" if i - since >= self.hold else "END" if i == len(price) - 1 else ""
                if why:
                    out.append((since, i, side, gain, why))
                    side = 0
            elif np.isfinite(s) and abs(s) >= self.enter and i < len(price) - 1:
                side, entry, since = (1 if s > 0 else -1), p, i
        return out


@dataclass(frozen=True)
class Pairs:
    """Trade a spread's z-score: in beyond ``enter``, out within ``leave``, stopped beyond ``stop`` or after ``hold``."""

    enter: float = 2.0
    leave: float = 0.5
    stop: float = 4.0
    hold: int = 50

    def __call__(self, frame: pd.DataFrame) -> list[tuple]:
        z, spread = frame["z"].to_numpy(float), frame["spread"].to_numpy(float)
        side, entry, since, out = 0, 0.0, 0, []
        for i, (v, s) in enumerate(zip(z, spread, strict=True)):
            if side:
                why = "STOP" if abs(v) >= self.stop else "MEAN" if abs(v) <= self.leave else "TIME" if i - since >= self.hold else "END" if i == len(z) - 1 else ""
                if why:
                    out.append((since, i, side, side * (s - entry), why))
                    side = 0
            elif np.isfinite(v) and self.enter <= abs(v) < self.stop and i < len(z) - 1:
                side, entry, since = (-1 if v > 0 else 1), s, i
        return out


def positions(frame: pd.DataFrame) -> list[tuple]:
    """Average-cost position keeping with flips: (fills, position, average, realised)."""
    pos, avg, gain = 0.0, 0.0, 0.0
    for side, qty, price in zip(frame["side"], frame["qty"].astype(float), frame["price"].astype(float), strict=True):
        signed = qty if str(side).upper() == "BUY" else -qty
        if pos * signed >= 0:
            avg = (avg * abs(pos) + price * qty) / (abs(pos) + qty) if qty else avg
        else:
            closed = min(abs(pos), qty)
            gain += closed * (price - avg) * (1 if pos > 0 else -1)
            avg = price if qty > abs(pos) else avg if qty < abs(pos) else 0.0
        pos += signed
    return [(len(frame), pos, avg if pos else 0.0, gain)]


@dataclass(frozen=True)
class RiskGate:
    """Orders let through: a loss limit stops the day, a cooldown follows each loss, size and position are bounded."""

    daily_loss: float = 10.0
    cooldown: int = 3
    max_qty: float = 100.0
    max_position: float = 300.0

    def __call__(self, frame: pd.DataFrame) -> list[tuple]:
        lost, wait, pos, out = 0.0, 0, 0.0, []
        for i, (qty, gain) in enumerate(zip(frame["qty"].astype(float), frame["gain"].astype(float), strict=True)):
            why = "LOSS_LIMIT" if lost <= -self.daily_loss else "COOLDOWN" if wait > 0 else "SIZE" if abs(qty) > self.max_qty else "POSITION" if abs(pos + qty) > self.max_position else ""
            wait = max(0, wait - 1)
            if not why:
                pos += qty
                lost += gain
                wait = self.cooldown if gain < 0 else wait
            out.append((i, why or "OK", pos, lost))
        return out


def hawkes(frame: pd.DataFrame, mu: float = 0.1, alpha: float = 0.5, beta: float = 1.0) -> list[tuple]:
    """Intensity before each event: mu + alpha * sum of exp(-beta * age), by its recursion."""
    t = frame["ts_sec"].to_numpy(float)
    excited, out = 0.0, []
    for i in range(len(t)):
        if i:
            excited = (excited + 1) * np.exp(-beta * (t[i] - t[i - 1]))
        out.append((int(t[i]), mu + alpha * excited))
    return out
