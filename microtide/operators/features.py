"""The model's feature block, in batch: native windows over a session's bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microtide.operators.regression import rolling_stats, rolling_sums
from microtide.operators.windows import Series

#: Weights of the five book levels. Fixed values.
LEVEL_WEIGHTS = (0.40, 0.25, 0.15, 0.12, 0.08)
#: Seconds of the day, Indian time: the offset from UTC, and the session's open and close. Fixed values.
IST, OPEN, CLOSE = 19_800, 33_300, 55_800


def clock_features(df: DataFrame, ts: str) -> DataFrame:
    """Adds ist_sin, ist_cos, mins_since_open and mins_to_close of a column of epoch seconds."""
    ist = F.pmod(F.col(ts) + IST, F.lit(86_400))
    turn = ist * (2 * math.pi / 86_400)
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(375.0), x))
    return df.withColumns({"ist_sin": F.sin(turn), "ist_cos": F.cos(turn), "mins_since_open": held((ist - OPEN) / 60), "mins_to_close": held((F.lit(CLOSE) - ist) / 60)})


def rolling_autocorrelation(df: DataFrame, s: Series, x: str, n: int, out: str, least: float = 1e-10) -> DataFrame:
    """Correlation of x with its previous value over the n - 1 pairs of the n rows before the current one.

    0 until n rows came before and where those n don't vary; running sums, so n costs nothing.
    """
    df = df.withColumns({"__y": s.lag(x), "__x": s.lag(x, 2), "__i": F.row_number().over(s.w)})
    y, p = F.col("__y"), F.col("__x")
    pair = p.isNotNull()
    on = lambda c: F.when(pair, c)
    df = rolling_sums(df, s, {"__sx": on(p), "__sy": on(y), "__xx": on(p * p), "__yy": on(y * y), "__xy": on(p * y)}, n - 1)
    df = rolling_sums(df, s, {"__s": y, "__ss": y * y}, n)
    m = F.lit(float(n - 1))
    vx, vy, cov = F.col("__xx") - F.col("__sx") * F.col("__sx") / m, F.col("__yy") - F.col("__sy") * F.col("__sy") / m, F.col("__xy") - F.col("__sx") * F.col("__sy") / m
    spread = F.col("__ss") / n - (F.col("__s") / n) * (F.col("__s") / n)
    live = (F.col("__i") > n) & (spread > least * least) & (vx > 1e-20) & (vy > 1e-20)
    return df.withColumn(out, F.when(live, cov / F.sqrt(vx * vy)).otherwise(0.0)).drop("__y", "__x", "__i", "__sx", "__sy", "__xx", "__yy", "__xy", "__s", "__ss")


def model_features(bars: DataFrame, s: Series, ts: str = "ts_sec") -> DataFrame:
    """``bars`` with the computed columns of the 29-column block; the others of it are the bars' own.

    Needs weighted_mid, close, bid_q1.. ask_q5, total_bid_qty, total_ask_qty, vwap, oi, spread_bps
    and realized_vol_10s, _60s, _300s. Windows have full frames, with the block's defaults before.
    """
    mid = F.coalesce("weighted_mid", "close")
    side = lambda name, f: sum((F.lit(w) * f(f"{name}_q{k}") for k, w in enumerate(LEVEL_WEIGHTS, 1)), F.lit(0.0))
    plain = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    change = lambda c: F.coalesce(F.col(c) - s.lag(c), F.lit(0.0))
    df = bars.withColumns({"__mid": mid, "__b": side("bid", plain), "__a": side("ask", plain), "ofi_weighted": side("bid", change) - side("ask", change)})
    both = F.col("__b") + F.col("__a")
    df = df.withColumn("book_imbalance_weighted", (F.col("__b") - F.col("__a")) / F.when(both == 0, 1.0).otherwise(both))
    before = s.lag("__mid")
    df = df.withColumns({"__up": F.when(F.col("__mid") > before, 1.0).otherwise(0.0), "__ret": F.coalesce(F.col("__mid") / F.nullif(before, F.lit(0.0)) - 1, F.lit(0.0)), "oi_change": F.coalesce((F.col("oi") - s.lag("oi")).cast("double"), F.lit(0.0))})
    df = df.withColumns({"__v60": F.coalesce("realized_vol_60s", F.lit(2.0)), "__v300": F.coalesce("realized_vol_300s", F.lit(2.0))})
    for c, n in (("__up", 60), ("__v60", 60), ("__v300", 300), ("oi_change", 300)):
        df = rolling_stats(df, s, c, (n,))
    whole = lambda what, c, n: F.when(F.col(f"{c}_n{n}") >= n, F.col(f"{c}_{what}{n}"))
    df = rolling_stats(df.withColumn("__td", F.coalesce(whole("mean", "__up", 60), F.lit(0.5))), s, "__td", (300,))
    deviation = lambda c: F.when(whole("std", c, 300) > 1e-9, whole("std", c, 300))
    sd = F.coalesce(deviation("__td"), F.lit(0.1))
    v = lambda n: F.coalesce(F.col(f"realized_vol_{n}s"), F.lit(2.0))
    safe = lambda x: F.when(x == 0, 2.0).otherwise(x)
    tb, ta = (F.nullif(F.col(f"total_{x}_qty").cast("double"), F.lit(0.0)) for x in ("bid", "ask"))
    vwap = F.coalesce(F.nullif(F.coalesce("vwap", "__mid"), F.lit(0.0)), F.col("__mid"))
    oi_sd = F.coalesce(deviation("oi_change"), F.lit(1.0))
    df = df.withColumns({
        "tick_direction_z": (F.col("__td") - 0.5) / sd,
        "vol_regime_ratio": F.coalesce(whole("mean", "__v60", 60) / safe(whole("mean", "__v300", 300)), F.lit(1.0)),
        "spread_rel": F.coalesce("spread_bps", F.lit(0.0)),
        "depth_ratio": F.log(F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.coalesce(tb / ta, F.lit(1.0))))),
        "mid_vs_vwap": (F.col("__mid") - vwap) / F.nullif(vwap, F.lit(0.0)),
        "vol_ratio_10_60": F.coalesce(v(10) / safe(v(60)), F.lit(1.0)),
        "oi_change_z": F.col("oi_change") / oi_sd,
    })
    df = rolling_autocorrelation(df, s, "__ret", 60, "price_autocorr_60")
    return clock_features(df, ts).drop(*[c for c in df.columns if c.startswith("__") or c.startswith("oi_change_") and c != "oi_change_z"])
