"""Labels, signal evaluation and portfolio reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_return(x: str, h: int, keys: list[str], order: str, log: bool = False) -> Column:
    ahead = F.lead(x, h).over(Window.partitionBy(*keys).orderBy(order))
    return F.log(ahead / F.col(x)) if log else ahead / F.nullif(F.col(x), F.lit(0.0)) - 1


def triple_barrier(bars: DataFrame, keys: list[str], ts: str, price: str, up: float, down: float, horizon: int, whole: bool = False) -> DataFrame:
    """First touch of +up or -down within ``horizon`` seconds: label 1, -1 or 0, and the time of the touch.

    ``keys`` name a session (symbol and day): no bar of another one counts. A row without a
    positive price has a null label and touch, and bars without one don't touch. With ``whole``,
    so has a row without a price ahead, or whose session has no bar exactly ``horizon`` seconds
    ahead; else such a row is labelled by what there is.

    Each bar meets the bars of its own and the following bin of ``horizon`` seconds, an equi-join
    that shuffles by (keys, bin), so a symbol of any length spreads over tasks; hits are reduced
    by two conditional minima.
    """
    b = bars.where(F.col(price) > 0).select(*keys, ts, F.col(price).alias("__p0")).withColumn("__bin", F.floor(F.col(ts) / horizon))
    ahead = bars.select(*keys, F.col(ts).alias("__t"), F.col(price).alias("__p1")).withColumn("__bin", F.explode(F.array(F.floor(F.col("__t") / horizon), F.floor(F.col("__t") / horizon) - 1)))
    near = (F.col("__t") > F.col(ts)) & (F.col("__t") <= F.col(ts) + horizon)
    met = b.join(ahead, [*keys, "__bin"]).where(near)
    ret = F.when(F.col("__p1") > 0, F.col("__p1") / F.col("__p0") - 1)
    hits = met.groupBy(*keys, ts).agg(F.min(F.when(ret >= up, F.col("__t"))).alias("__u"), F.min(F.when(ret <= -down, F.col("__t"))).alias("__d"), F.max(F.when(F.col("__p1") > 0, F.col("__t"))).alias("__any"), F.max("__t").alias("__last"))
    far = F.lit(1 << 62)
    u, d = F.coalesce("__u", far), F.coalesce("__d", far)
    label = F.when(u < d, 1).when(d < u, -1).otherwise(0)
    out = bars.select(*keys, ts, F.coalesce(F.col(price) > 0, F.lit(False)).alias("__ok")).join(hits, [*keys, ts], "left")
    known = F.col("__ok") & (F.col("__any").isNotNull() & (F.col("__last") == F.col(ts) + horizon) if whole else F.lit(True))
    return out.select(*keys, ts, F.when(known, label).alias("label"), F.when(known & (u != d), F.least(u, d)).alias("touch_ts"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over rows with both values; null where one of them doesn't vary."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(pair, F.col(x))) * F.stddev_pop(F.when(pair, F.col(y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def average_ranks(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Average ranks within keys: ties share the mean of their places."""
    w = Window.partitionBy(*keys).orderBy(x)
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return df.withColumn(out, F.rank().over(w) + (same - 1) / 2)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation, hit rate of signs and count per key, over rows with both values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = average_ranks(average_ranks(rows, keys, x, "__rx"), keys, y, "__ry")
    hit = (F.signum(x) == F.signum(y)).cast("double")
    return rows.groupBy(*keys).agg(correlation("__rx", "__ry").alias("ic"), F.avg(hit).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def chunked_ic(df: DataFrame, keys: list[str], order: str, x: str, y: str, rows: int = 300) -> DataFrame:
    """(keys, chunk, ic): rank correlation in blocks of ``rows`` rows that follow each other; a session's rest is left out."""
    s = Window.partitionBy(*keys)
    cut = df.withColumns({"chunk": F.floor((F.row_number().over(s.orderBy(order)) - 1) / rows), "__n": F.count(F.lit(1)).over(s)}).where((F.col("chunk") + 1) * rows <= F.col("__n"))
    return spearman(cut, [*keys, "chunk"], x, y).select(*keys, "chunk", "ic")


def walk_forward(daily: DataFrame, keys: list[str], day: str, score: str, value: str) -> DataFrame:
    """Per day the key with the best mean score over all earlier days, and its value that day."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    past = daily.withColumn("train_mean", F.avg(score).over(w)).where("train_mean is not null")
    best = F.max(F.struct("train_mean", *keys, F.col(value).alias("__v"))).alias("b")
    return past.groupBy(day).agg(best).select(day, *[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.train_mean").alias("train_mean"), F.col("b.__v").alias("test_value"))


def drawdown(pnl: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Total, wins, losses, deepest drawdown and Sharpe ratio (per step, times sqrt 252) of an ordered series of gains."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = pnl.withColumn("__cum", F.sum(x).over(w)).withColumn("__peak", F.greatest(F.max("__cum").over(w), F.lit(0.0)))
    return run.groupBy(*keys).agg(
        F.sum(x).alias("net"), F.count(F.when(F.col(x) > 0, 1)).alias("wins"), F.count(F.when(F.col(x) < 0, 1)).alias("losses"),
        F.max(F.col("__peak") - F.col("__cum")).alias("max_drawdown"),
        (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * (252**0.5)).alias("sharpe"),
    )


def fifo_match(fills: DataFrame, keys: list[str], order: list[str], side: str, qty: str, price: str) -> DataFrame:
    """Realised gain of matching each key's buys and sells first in, first out, whichever opened.

    Each fill covers an interval of its side's cumulative quantity; a buy and a sell match where
    their intervals overlap. Both sides' interval ends cut the quantity axis into pieces that
    belong to one buy and one sell each: a union and a window, no pair join.
    """
    w = Window.partitionBy(*keys, side).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cum = fills.select(*keys, F.upper(side).alias("__s"), F.col(qty).alias("__q"), F.col(price).alias("__p"), F.sum(qty).over(w).alias("__end"))
    back = Window.partitionBy(*keys).orderBy("__end").rangeBetween(0, Window.unboundedFollowing)
    ends = cum.groupBy(*keys, "__end").agg(F.min(F.when(F.col("__s") == "BUY", F.col("__p"))).alias("__b"), F.min(F.when(F.col("__s") == "SELL", F.col("__p"))).alias("__a"))
    pieces = ends.select(*keys, "__end", (F.col("__end") - F.coalesce(F.lag("__end").over(Window.partitionBy(*keys).orderBy("__end")), F.lit(0))).alias("__n"), F.first("__b", ignorenulls=True).over(back).alias("__b"), F.first("__a", ignorenulls=True).over(back).alias("__a"))
    matched = pieces.where(F.col("__b").isNotNull() & F.col("__a").isNotNull())
    return matched.groupBy(*keys).agg(F.sum("__n").alias("matched_qty"), F.sum(F.col("__n") * (F.col("__a") - F.col("__b"))).alias("realised"))


def jarque_bera(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """n, skewness, excess kurtosis (population moments) and the Jarque-Bera statistic."""
    got = df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess_kurtosis"))
    return got.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4))


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str, bins: str) -> DataFrame:
    """Median of pairwise slopes within each key and bin; a bin is a window of bounded size by construction."""
    rows = df.select(*keys, bins, F.col(x).alias("__x"), F.col(y).alias("__y")).groupBy(*keys, bins).agg(F.collect_list(F.struct("__x", "__y")).alias("__r"))
    slopes = F.flatten(F.transform("__r", lambda a, i: F.transform(F.filter(F.slice(F.col("__r"), i + 2, F.size("__r")), lambda b: b["__x"] != a["__x"]), lambda b: (b["__y"] - a["__y"]) / (b["__x"] - a["__x"]))))
    s = rows.select(*keys, bins, F.array_sort(slopes).alias("__s"))
    n = F.size("__s")
    mid = (F.get("__s", F.floor((n - 1) / 2).cast("int")) + F.get("__s", F.floor(n / 2).cast("int"))) / 2
    return s.select(*keys, bins, n.cast("long").alias("slopes"), mid.alias("theil_sen"))
