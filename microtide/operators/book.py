"""Features of a five-level order book on a regular grid of one session.

Columns are bp1..bp5, ap1..ap5 (prices), bq1..bq5, aq1..aq5 (quantities) and ``is_observed``. Windows
count grid rows; ``step`` is the grid's distance in seconds. Defaults are those of one-second grids.
Every lookback is guarded by the exact time it should reach, so nothing is read across holes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microtide.functions.scalar import signed_log
from microtide.operators.windows import Series, rolling_ols

LEVELS = range(1, 6)
BOOK = [f"{p}{i}" for p in ("bp", "ap", "bq", "aq") for i in LEVELS]
SIDES = {"bid": ("bp", "bq"), "ask": ("ap", "aq")}
#: Decay of the weights of gaps behind the best price. Fixed value.
GAP_DECAY = 0.7
EPS = 1e-9


def add(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def depth(prefix: str, levels=LEVELS) -> Column:
    return add(F.col(f"{prefix}{i}") for i in levels)


def mid() -> Column:
    return (F.col("bp1") + F.col("ap1")) / 2


def valid_book() -> Column:
    """All 20 values finite, prices above zero, quantities not below, and the best ask not under the best bid."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    tests = [finite(F.col(c).cast("double")) & (F.col(c) > 0 if c[1] == "p" else F.col(c) >= 0) for c in BOOK]
    return F.coalesce(reduce(lambda a, b: a & b, tests) & (F.col("ap1") >= F.col("bp1")), F.lit(False))


def exact(s: Series, x: Column, ts: str, n: int, step: int) -> Column:
    """x of n rows ago if that row lies exactly n steps back."""
    return F.when(F.col(ts) - s.lag(ts, n) == n * step, s.lag(x, n))


def controls(df: DataFrame, s: Series, ts: str, lookbacks: tuple[int, ...] = (30, 60), step: int = 1) -> DataFrame:
    """Instantaneous imbalance, depth, spread and concentration, and log returns over exact lookbacks in basis points."""
    b, a = depth("bq"), depth("aq")
    out = {
        "queue_imbalance_ctrl": (F.col("bq1") - F.col("aq1")) / (F.col("bq1") + F.col("aq1") + EPS), "depth_imbalance_ctrl": (b - a) / (b + a + EPS),
        "log_total_depth_ctrl": F.log1p(b + a), "spread_bps_ctrl": 1e4 * (F.col("ap1") - F.col("bp1")) / mid(),
        "bid_l1_concentration_ctrl": F.col("bq1") / (b + EPS), "ask_l1_concentration_ctrl": F.col("aq1") / (a + EPS),
    }
    out |= {f"momentum_{n}_ctrl": 1e4 * F.log(mid() / exact(s, mid(), ts, n, step)) for n in lookbacks}
    return df.withColumns(out)


def gap_asymmetry(df: DataFrame) -> DataFrame:
    """Bid minus ask of the price gaps behind the best, in basis points with decaying weights; fragility divides by root depth."""
    raw = [math.exp(-GAP_DECAY * k) for k in range(4)]
    weights = [w / sum(raw) for w in raw]
    gap = {"bid": lambda i: 1e4 * (F.col(f"bp{i}") - F.col(f"bp{i + 1}")) / mid(), "ask": lambda i: 1e4 * (F.col(f"ap{i + 1}") - F.col(f"ap{i}")) / mid()}
    thin = {side: lambda i, q=q: F.sqrt(1 + F.col(f"{q}{i}")) for side, (_, q) in SIDES.items()}
    wide = add(w * (gap["bid"](i) - gap["ask"](i)) for i, w in enumerate(weights, 1))
    frail = add(w * (gap["bid"](i) / thin["bid"](i) - gap["ask"](i) / thin["ask"](i)) for i, w in enumerate(weights, 1))
    return df.withColumns({"weighted_gap_asymmetry": F.when(valid_book(), wide), "fragility_asymmetry": F.when(valid_book(), frail)})


def relative_migration(df: DataFrame, s: Series, ts: str, n: int = 60, step: int = 1) -> DataFrame:
    """Change over n steps of each side's mean distance of depth from its best price: (bid - ask) / (|bid| + |ask|)."""
    for side, (p, q) in SIDES.items():
        away = add(1e4 * F.abs(F.col(f"{p}{i}") - F.col(f"{p}1")) / mid() * F.col(f"{q}{i}") for i in LEVELS)
        df = df.withColumn(f"__{side}", F.when(valid_book(), away / F.nullif(depth(q).cast("double"), F.lit(0.0))))
    moved = {side: F.col(f"__{side}") - exact(s, F.col(f"__{side}"), ts, n, step) for side in SIDES}
    out = (moved["bid"] - moved["ask"]) / (F.abs(moved["bid"]) + F.abs(moved["ask"]) + EPS)
    return df.withColumn("relative_migration", out).drop("__bid", "__ask")


def shock_recovery(df: DataFrame, s: Series, ts: str, lookback: int = 60, step: int = 1, loss: float = 0.2, cap: float = 2.0) -> DataFrame:
    """Depth losses of at least ``loss`` on observed changes, how much has come back since, and their age, while under ``lookback`` steps old."""
    now = F.struct(*BOOK)
    df = df.withColumn("__real", (F.col("is_observed") == 1) & (F.col(ts) - s.lag(ts) == step) & (now != s.lag(now)))
    names = []
    for side, (_, q) in SIDES.items():
        df = df.withColumn(f"__{side}_now", depth(q)).withColumn(f"__{side}_was", s.lag(f"__{side}_now"))
        fell = F.col(f"__{side}_was") - F.col(f"__{side}_now")
        shock = F.col("__real") & (F.col(f"__{side}_was") > 0) & (fell >= loss * F.col(f"__{side}_was"))
        df = df.withColumn(f"__{side}", s.ffill(F.when(shock, F.struct(F.col(ts).alias("ts"), F.col(f"__{side}_now").alias("left"), fell.alias("lost")))))
        age = F.col(ts) - F.col(f"__{side}.ts")
        active = age < lookback * step
        back = (F.col(f"__{side}_now") - F.col(f"__{side}.left")) / F.nullif(F.col(f"__{side}.lost").cast("double"), F.lit(0.0))
        df = df.withColumns({f"{side}_recovery": F.when(active, F.least(F.lit(cap), F.greatest(F.lit(0.0), back))), f"{side}_shock_age": F.when(active, age)})
        names += [f"__{side}", f"__{side}_now", f"__{side}_was"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn("recovery_pressure", zero("bid_recovery") - zero("ask_recovery")).drop("__real", *names)


def near_migration(df: DataFrame, s: Series, ts: str, window: int = 60, step: int = 1, gap: int = 10) -> DataFrame:
    """Change of the first two levels' share of depth at an unchanged best price, against the last observed valid row at most
    ``gap`` steps back, summed over the clock: signed and by size, bid minus ask; null before a session is ``window`` steps long."""
    seen = (F.col("is_observed") == 1) & valid_book() & (depth("bq") > 0) & (depth("aq") > 0)
    df = df.withColumns({"__seen": seen} | {f"__{x}": depth(q, (1, 2)) / F.nullif(depth(q).cast("double"), F.lit(0.0)) for x, (_, q) in SIDES.items()})
    row = F.struct(F.col(ts).alias("ts"), "bp1", "ap1", F.col("__bid").alias("bid"), F.col("__ask").alias("ask"))
    df = df.withColumn("__past", F.last(F.when(F.col("__seen"), row), ignorenulls=True).over(s.before()))
    recent = F.col("__seen") & (F.col(ts) - F.col("__past.ts") <= gap * step)
    moved = {x: F.when(recent & (F.col(f"{p}1") == F.col(f"__past.{p}1")), F.col(f"__{x}") - F.col(f"__past.{x}")).otherwise(0.0) for x, (p, _) in SIDES.items()}
    df = df.withColumns({"__signed": moved["bid"] - moved["ask"], "__size": F.abs(moved["bid"]) - F.abs(moved["ask"])})
    clock = s.clock(window * step)
    warm = valid_book() & (F.col(ts) >= F.first(ts).over(s.so_far()) + (window - 1) * step)
    out = {name: F.when(warm, F.sum(x).over(clock)) for name, x in (("near_migration_asym", "__signed"), ("migration_activity_asym", "__size"))}
    return df.withColumns(out).drop("__seen", "__bid", "__ask", "__past", "__signed", "__size")


def flow(df: DataFrame, s: Series, ts: str, step: int | None = None) -> DataFrame:
    """``ofi`` of the best level from adds and removes at moving prices, ``ret`` of the log mid; with ``step`` only between consecutive rows."""
    was = lambda c: s.lag(c)
    kept = lambda test, q: F.when(test, q).otherwise(0)
    bid = kept(F.col("bp1") >= was("bp1"), F.col("bq1")) - kept(F.col("bp1") <= was("bp1"), was("bq1"))
    ask = kept(F.col("ap1") >= was("ap1"), was("aq1")) - kept(F.col("ap1") <= was("ap1"), F.col("aq1"))
    near = s.lag(ts).isNotNull() if step is None else F.col(ts) - s.lag(ts) == step
    return df.withColumns({"ofi": F.when(near, (bid + ask).cast("double")), "ret": F.when(near, F.log(mid()) - F.log(s.lag(mid())))})


def flow_features(df: DataFrame, s: Series, ts: str, short: int = 30, middle: int = 60, long: int = 300, step: int = 1) -> DataFrame:
    """Signed-log order flow, its short against long rate, activity, update and move rates, imbalance changes and variance ratio."""
    df = flow(df, s, ts)
    queue, deep = (F.col("bq1") - F.col("aq1")) / (F.col("bq1") + F.col("aq1") + EPS), (depth("bq") - depth("aq")) / (depth("bq") + depth("aq") + EPS)
    share = lambda test, n, least: s.rolling("avg", test.cast("double"), n, least)
    df = df.withColumns({"__queue": queue, "__deep": deep, "__k": F.log(mid()) - s.lag(F.log(mid()), 5)})
    ratio = s.rolling("var_samp", "__k", long, long // 3) / (5 * s.rolling("var_samp", "ret", long, long // 3) + 1e-12)
    out = {
        "ofi_sum_signed_log": signed_log(s.rolling("sum", "ofi", middle, middle // 3)),
        "ofi_rate_diff": signed_log(s.rolling("sum", "ofi", short, short // 3) / short - s.rolling("sum", "ofi", long, long // 3) / long),
        "ofi_activity": share(F.col("ofi") != 0, middle, middle // 3), "update_rate": share(F.col("is_observed") == 1, long, long // 3),
        "price_move_rate": share(F.col("ret") != 0, short, short // 3), "queue_imbalance_delta": F.col("__queue") - s.lag("__queue"),
        "depth_imbalance_delta": F.col("__deep") - s.lag("__deep"), "log_variance_ratio_5": F.when(ratio.isNotNull(), F.log(F.greatest(ratio, F.lit(1e-6)))),
    }
    return df.withColumns(out).drop("__queue", "__deep", "__k")


def response_gap(df: DataFrame, s: Series, ts: str, n: int = 1800, least: int = 600) -> DataFrame:
    """How far the return falls short of what the flow's lagged regression expects, in deviations of past residuals; null where those don't vary."""
    df = rolling_ols(flow(df, s, ts), s, "ofi", "ret", n, least)
    df = df.withColumn("__e", F.col("ret") - F.col("ols_intercept") - F.col("ols_slope") * F.col("ofi"))
    df = df.withColumn("__p", s.lag("__e"))
    spread = s.rolling("stddev_samp", "__p", n, least)
    return df.withColumn("ofi_response_gap_z", F.when(spread > 1e-12, -F.signum("ofi") * F.col("__e") / F.nullif(spread, F.lit(0.0)))).drop("__e", "__p")


def ofi_disagreement(df: DataFrame, s: Series, ts: str, n: int = 60, least: int = 54, step: int = 1, floor: float = 0.1, cap: float = 3.0) -> DataFrame:
    """Net over gross flow where it points against the return of n steps, weighted by that return's size in units of volatility."""
    df = flow(df, s, ts, step)
    net, gross = s.rolling("sum", "ofi", n, least), s.rolling("sum", F.abs("ofi"), n, least)
    df = df.withColumns({"__p": F.when(gross > 0, net / F.nullif(gross, F.lit(0.0))).when(gross == 0, 0.0), "__m": 1e4 * F.log(mid() / exact(s, mid(), ts, n, step)),
                         "__v": 1e4 * F.sqrt(s.rolling("sum", F.col("ret") * F.col("ret"), n, least))})
    weight = F.least(F.abs("__m") / F.greatest(F.col("__v"), F.lit(floor)), F.lit(cap))
    known = F.col("__p").isNotNull() & F.col("__m").isNotNull() & F.col("__v").isNotNull()
    return df.withColumn("ofi_disagreement", F.when(known, F.when(F.col("__p") * F.col("__m") < 0, F.col("__p") * weight).otherwise(0.0))).drop("__p", "__m", "__v")


def spread_depth_stress(df: DataFrame, s: Series, n: int = 900, least: int = 810) -> DataFrame:
    """log1p of the spread in basis points over the root of the rolling median depth."""
    df = df.withColumn("__d", depth("bq") + depth("aq"))
    median = F.when(F.count("__d").over(s.rows(n)) >= least, s.quantile("__d", 0.5, n))
    spread = F.when((F.col("bp1") > 0) & (F.col("ap1") >= F.col("bp1")), 1e4 * (F.col("ap1") - F.col("bp1")) / mid())
    return df.withColumn("spread_depth_stress", F.log1p(spread / F.sqrt(median + 1))).drop("__d")


def recovery_available(df: DataFrame, s: Series, ts: str, n: int = 300, least: int = 270, events: int = 5, share: float = 0.75, step: int = 1) -> DataFrame:
    """1 where both sides had ``least`` valid pairs and ``events`` rows after a depth under ``share`` of its own past median, in n rows."""
    made = []
    for side, (_, q) in SIDES.items():
        df = df.withColumn(f"__{side}", depth(q).cast("double"))
        past = s.rows(n, 1)
        ref = F.when(F.count(f"__{side}").over(past) >= least, F.percentile(f"__{side}", F.lit(0.5)).over(past))
        df = df.withColumn(f"__{side}_rel", F.col(f"__{side}") / F.nullif(ref, F.lit(0.0))).withColumn(f"__{side}_was", exact(s, F.col(f"__{side}_rel"), ts, 1, step))
        pair = F.col(f"__{side}_rel").isNotNull() & F.col(f"__{side}_was").isNotNull()
        count = lambda test: F.count(F.when(test, 1)).over(s.rows(n))
        made.append((count(pair) >= least) & (count(pair & (F.col(f"__{side}_was") < share)) >= events))
    return df.withColumn("recovery_available", (made[0] & made[1]).cast("int")).drop(*[f"__{x}{e}" for x in SIDES for e in ("", "_rel", "_was")])


def checks(df: DataFrame, by: list[str], s: Series, ts: str, step: int) -> DataFrame:
    """Per ``by``: rows, repeated keys, rows off the grid, rows with a missing or negative value."""
    gap = F.col(ts) - s.lag(ts)
    seen = df.select(*by, gap.alias("gap"), reduce(lambda a, b: a | b, [F.col(c).isNull() for c in BOOK]).alias("null"), reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in BOOK]).alias("low"), valid_book().alias("ok"))
    n = lambda test: F.count(F.when(test, 1))
    return seen.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), n(F.col("gap") == 0).alias("repeated"), n((F.col("gap") != step) & (F.col("gap") != 0)).alias("off_grid"), n(F.col("null")).alias("missing"), n(F.col("low")).alias("negative"), n(F.col("ok")).alias("valid_books"))
