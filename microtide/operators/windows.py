"""Row- and clock-framed windows over ordered series.

Every function takes the partition (``keys``) and the order explicitly: a session is a key,
and nothing reads across sessions. Row frames end at the current row unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Series:
    """Windows of one partition and order, so that all of a plan's frames share one sort."""

    def __init__(self, keys: list[str], order: str | list[str]):
        self.keys = keys
        self.order = [order] if isinstance(order, str) else order

    @property
    def w(self) -> WindowSpec:
        """Made when used: a Series may be defined before there is a session."""
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, n: int, skip: int = 0) -> WindowSpec:
        """The last n rows, the current one included unless ``skip`` is 1."""
        return self.w.rowsBetween(-(n - 1) - skip, -skip)

    def clock(self, seconds: int) -> WindowSpec:
        """Rows of the last so many units of the (single, numeric) order column."""
        return self.w.rangeBetween(-(seconds - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    def clock_sum(self, x: Column, seconds: int) -> Column:
        """Sum of a whole number over the last so many units of the order column, 0 without any: the difference of two frames that only grow, so that a row costs the same for any length."""
        upto = lambda k: F.coalesce(F.sum(x).over(self.w.rangeBetween(Window.unboundedPreceding, -k)), F.lit(0))
        return upto(0) - upto(seconds)

    def lag(self, x: str | Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w)

    def lead(self, x: str | Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.w)

    def diff(self, x: str, n: int = 1) -> Column:
        return F.col(x) - self.lag(x, n)

    def ffill(self, x: str | Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far())

    def rolling(self, how: str, x: str | Column, n: int, min_periods: int = 1, skip: int = 0) -> Column:
        """sum, avg, stddev_samp, stddev_pop, var_samp, var_pop, min or max over n rows; null below min_periods values."""
        x = F.col(x) if isinstance(x, str) else x
        w = self.rows(n, skip)
        made = getattr(F, how)(x).over(w)
        return made if min_periods <= 1 else F.when(F.count(x).over(w) >= min_periods, made)

    def zscore(self, x: str, n: int) -> Column:
        w = self.rows(n)
        return (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0))

    def momentum(self, x: str, n: int) -> Column:
        past = self.lag(x, n)
        return (F.col(x) - past) / F.nullif(past, F.lit(0))

    def exact_lag(self, x: str, ts: str, n: int) -> Column:
        """The value n rows back if exactly n seconds lie between."""
        return F.when(F.col(ts) - self.lag(ts, n) == n, self.lag(x, n))

    def quantile(self, x: str | Column, q: float, n: int) -> Column:
        return F.percentile(x, F.lit(q)).over(self.rows(n))

    def rank_pct(self, x: str, n: int) -> Column:
        """Percentile rank of the current value among the last n, ties by their average rank."""
        seen = F.collect_list(x).over(self.rows(n))
        less = F.size(F.filter(seen, lambda v: v < F.col(x)))
        same = F.size(F.filter(seen, lambda v: v == F.col(x)))
        return F.when(F.col(x).isNotNull(), (less + (same + 1) / 2) / F.size(seen))

    def corr(self, x: str | Column, y: str | Column, n: int, min_periods: int) -> Column:
        """Pearson correlation over n rows; null below min_periods pairs or without spread."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        w, pair = self.rows(n), x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(pair, x)).over(w) * F.stddev_pop(F.when(pair, y)).over(w)
        return F.when((F.count(F.when(pair, 1)).over(w) >= min_periods) & (spread > 1e-12), F.covar_pop(x, y).over(w) / F.nullif(spread, F.lit(0.0)))


def robust_z(df: DataFrame, s: Series, x: str, n: int, out: str = "robust_z") -> DataFrame:
    """(x - median) / (1.4826 MAD) over n rows, each row by its own window's median."""
    seen = F.collect_list(x).over(s.rows(n))
    df = df.withColumn("__seen", F.array_sort(seen))
    mid = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    df = df.withColumn("__med", mid(F.col("__seen")))
    df = df.withColumn("__mad", mid(F.array_sort(F.transform("__seen", lambda v: F.abs(v - F.col("__med"))))))
    return df.withColumn(out, (F.col(x) - F.col("__med")) / F.nullif(1.4826 * F.col("__mad"), F.lit(0.0))).drop("__seen", "__med", "__mad")


def islands(df: DataFrame, s: Series, flag: str) -> DataFrame:
    """(keys, run_start, run_length, run_open) of the runs of rows where ``flag`` holds; open ones reach their session's last row."""
    numbered = df.withColumns({"__r": F.row_number().over(s.w), "__last": F.count(F.lit(1)).over(Window.partitionBy(*s.keys))}).where(flag)
    runs = numbered.withColumn("__run", F.col("__r") - F.row_number().over(s.w)).groupBy(*s.keys, "__run")
    return runs.agg(F.min(s.order[0]).alias("run_start"), F.count(F.lit(1)).alias("run_length"), (F.max("__r") == F.max("__last")).alias("run_open")).drop("__run")


def propagate(df: DataFrame, s: Series, ts: str, event: str, values: list[str], age: int) -> DataFrame:
    """The last event's time and values on every row of its session, null once ``age`` seconds have passed."""
    last = lambda c: F.last(F.when(F.col(event), F.col(c)), ignorenulls=True).over(s.so_far())
    df = df.withColumn("event_ts", last(ts))
    for c in values:
        df = df.withColumn(f"event_{c}", last(c))
    fresh = F.col(ts) - F.col("event_ts") < age
    df = df.withColumn("event_age", F.when(fresh, F.col(ts) - F.col("event_ts")))
    for c in values:
        df = df.withColumn(f"event_{c}", F.when(fresh, F.col(f"event_{c}")))
    return df


def concurrency(labels: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """For each label interval the number of intervals that hold its start: +1 at starts, -1 after ends, one running sum."""
    ups = labels.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d"))
    downs = labels.select(*keys, (F.col(end) + 1).alias("t"), F.lit(-1).alias("d"))
    steps = ups.unionByName(downs).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    live = steps.withColumn("live", F.sum("d").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).drop("d")
    return labels.join(live.withColumnRenamed("t", start), [*keys, start])


def rolling_ols(df: DataFrame, s: Series, x: str, y: str, n: int, min_periods: int, eps: float = 1e-12) -> DataFrame:
    """Slope, intercept and R2 of y on x from windowed moments, each lagged by one row."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    w = s.rows(n)
    mean = lambda c: F.avg(F.when(both, c)).over(w)
    cx, cy = F.col(x), F.col(y)
    df = df.withColumns({"__n": F.count(F.when(both, 1)).over(w), "__x": mean(cx), "__y": mean(cy), "__xx": mean(cx * cx), "__xy": mean(cx * cy), "__yy": mean(cy * cy)})
    var_x, var_y, cov = (F.col(a) - F.col(b) * F.col(c) for a, b, c in (("__xx", "__x", "__x"), ("__yy", "__y", "__y"), ("__xy", "__x", "__y")))
    ok = F.col("__n") >= min_periods
    df = df.withColumns({"__b": F.when(ok, cov / (var_x + eps)), "__r2": F.when(ok, cov * cov / (var_x * var_y + eps))})
    df = df.withColumn("__a", F.col("__y") - F.col("__b") * F.col("__x"))
    return df.withColumns({"ols_slope": s.lag("__b"), "ols_intercept": s.lag("__a"), "ols_r2": s.lag("__r2")}).drop("__n", "__x", "__y", "__xx", "__xy", "__yy", "__b", "__a", "__r2")


def fano(s: Series, event: Column, block: int = 10, blocks: int = 6) -> Column:
    """Variance over mean of event counts in consecutive clock blocks before the row; null without events."""
    one = event.cast("int")
    # Events up to each border: frames that only grow, which a row extends in constant time.
    upto = [F.coalesce(F.sum(one).over(s.w.rangeBetween(Window.unboundedPreceding, -block * k)), F.lit(0)) for k in range(blocks, -1, -1)]
    counts = [b - a for a, b in zip(upto, upto[1:])]
    mean = sum(counts[1:], counts[0]) / blocks
    var = sum(((c - mean) * (c - mean) for c in counts[1:]), (counts[0] - mean) * (counts[0] - mean)) / blocks
    return var / F.nullif(mean, F.lit(0.0))


def frac_diff(s: Series, x: str, weights: list[float]) -> Column:
    """Fixed-width fractional difference: null until the frame is full."""
    seen = F.collect_list(x).over(s.rows(len(weights)))
    taps = F.array(*[F.lit(float(w)) for w in weights[::-1]])
    dot = F.aggregate(F.zip_with(seen, taps, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(seen) == len(weights), dot)


def warm_mean(s: Series, x: str, n: int = 300) -> Column:
    """The value itself in a session's first n rows, its rolling mean over n rows after them."""
    return F.when(F.row_number().over(s.w) <= n, F.col(x)).otherwise(s.rolling("avg", x, n))


def variance_regime(df: DataFrame, s: Series, x: str, n: int = 300, lag: int = 10, vol: str | None = None, calm: str | None = None) -> DataFrame:
    """``regime`` by the ratio of lag-row to one-row return variance inside the n rows before the current one.

    VOLATILE goes first, where the columns are given: the mean of ``vol`` over those rows is above
    1.5 times ``calm``, which is one value per session (its 75th percentile of vol).
    """
    from microtide.operators.regression import rolling_sums

    # The row before the current one ends the frame: what is summed is lagged by one.
    one = s.lag(x)
    ret = lambda k: one / F.nullif(s.lag(x, k + 1), F.lit(0.0)) - 1
    df = df.withColumns({"__i": F.row_number().over(s.w), "__r1": ret(1), "__rk": ret(lag)})
    made = lambda c: {f"{c}n": F.when(F.col(c).isNotNull(), 1.0), f"{c}s": F.col(c), f"{c}q": F.col(c) * F.col(c)}
    df = rolling_sums(rolling_sums(df, s, made("__r1"), n - 1), s, made("__rk"), n - lag)
    var = lambda c: (F.col(f"{c}q") - F.col(f"{c}s") * F.col(f"{c}s") / F.nullif(F.col(f"{c}n"), F.lit(0.0))) / F.nullif(F.col(f"{c}n") - 1, F.lit(0.0))
    v1 = var("__r1")
    df = df.withColumn("__vr", var("__rk") / F.when(v1 > 1e-20, lag * v1))
    df = df.withColumn("__vol", s.lag(vol) if vol else F.lit(None).cast("double"))
    df = rolling_sums(df, s, {"__vols": F.col("__vol"), "__voln": F.when(F.col("__vol").isNotNull(), 1.0)}, n)
    df = df.withColumn("__wild", F.coalesce(F.col("__vols") / F.nullif(F.col("__voln"), F.lit(0.0)) > 1.5 * F.col(calm), F.lit(False)) if vol else F.lit(False))
    name = F.when(F.col("__i") <= n, "CHOPPY").when(F.col("__wild"), "VOLATILE").when(F.col("__vr") < 0.85, "MEAN_REVERTING").when(F.col("__vr") > 1.15, "TRENDING").otherwise("CHOPPY")
    return df.withColumn("regime", name).drop("__i", "__r1", "__rk", "__vr", "__wild", "__vol", "__vols", "__voln", *made("__r1"), *made("__rk"))


def slope(s: Series, x: str, y: str, n: int, min_periods: int) -> Column:
    """Slope of y on x over the pairs of the last n rows; null below min_periods pairs or without spread of x."""
    w, pair = s.rows(n), F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.var_pop(F.when(pair, F.col(x))).over(w)
    return F.when((F.count(F.when(pair, 1)).over(w) >= min_periods) & (spread > 1e-12), F.covar_pop(x, y).over(w) / F.nullif(spread, F.lit(0.0)))
