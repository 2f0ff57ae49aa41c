"""Least squares by aggregated or windowed cross moments: one pass, then a Cholesky solve in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microtide.operators.windows import Series

#: MacKinnon's (2010) response surface of the Dickey-Fuller t with a constant: level -> constant, 1/n, 1/n^2, 1/n^3. Fixed values.
CRITICAL = {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.040), 10: (-2.56677, -1.5384, -2.809, 0.0)}


def cholesky(df: DataFrame, c: list[list[Column]], b: list[Column], name: str = "__") -> DataFrame:
    """Adds L (name + l_i_j) of a symmetric positive matrix and z = L^-1 b (name + z_i), null where it is singular."""
    col = lambda kind, *at: F.col(name + kind + "_".join(map(str, at)))
    for j in range(len(b)):
        rest = c[j][j]
        for k in range(j):
            rest = rest - col("l", j, k) * col("l", j, k)
        # A pivot that is only rounding stands for a column that the others determine.
        df = df.withColumn(f"{name}l{j}_{j}", F.when(rest > 1e-12 * F.abs(c[j][j]), F.sqrt(rest)))
        made = {}
        for i in range(j + 1, len(b)):
            x = c[i][j]
            for k in range(j):
                x = x - col("l", i, k) * col("l", j, k)
            made[f"{name}l{i}_{j}"] = x / col("l", j, j)
        x = b[j]
        for k in range(j):
            x = x - col("l", j, k) * col("z", k)
        made[f"{name}z{j}"] = x / col("l", j, j)
        df = df.withColumns(made)
    return df


def back_substituted(df: DataFrame, k: int, out: Sequence[str], name: str = "__") -> DataFrame:
    """Adds the solution of L' x = z as the columns ``out`` and drops what ``cholesky`` added."""
    for i in reversed(range(k)):
        x = F.col(f"{name}z{i}")
        for j in range(i + 1, k):
            x = x - F.col(f"{name}l{j}_{i}") * F.col(out[j])
        df = df.withColumn(out[i], x / F.col(f"{name}l{i}_{i}"))
    return df.drop(*[f"{name}z{i}" for i in range(k)], *[f"{name}l{i}_{j}" for i in range(k) for j in range(i + 1)])


def adf(df: DataFrame, keys: list[str], order: list[str], x: str, lags: int = 1, by_aic: bool = False) -> DataFrame:
    """Augmented Dickey-Fuller t with a constant per key: (keys, n, lags, gamma, adf_stat, stationary).

    The change is regressed on the level before it and ``lags`` earlier changes. One aggregation
    of cross moments serves all numbers of lags up to ``lags``: eliminating the changes first
    leaves the level as the last regressor of each. ``by_aic`` takes the number of the least
    Akaike criterion over the same rows, else it is ``lags``. stationary holds where the statistic
    is below MacKinnon's asymptotic 5 % value. Null values are left out; a series too short or
    without variation has null statistics.
    """
    s = Series(keys, order)
    rows = df.select(*keys, *order, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    rows = rows.withColumn("__d", s.diff("__x"))
    rows = rows.withColumns({"__v": s.lag("__x")} | {f"__d{k}": s.lag("__d", k) for k in range(1, lags + 1)})
    names = [f"__d{k}" for k in range(1, lags + 1)] + ["__v"]
    whole = rows.dropna(subset=["__d", *names])
    k = len(names)
    pair = [F.covar_pop(names[i], names[j]).alias(f"__c{i}_{j}") for i in range(k) for j in range(i + 1)]
    made = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop("__d").alias("__y"), *pair, *[F.covar_pop(n, "__d").alias(f"__b{i}") for i, n in enumerate(names)])
    c = [[F.col(f"__c{max(i, j)}_{min(i, j)}") for j in range(k)] for i in range(k)]
    made = cholesky(made, c, [F.col(f"__b{i}") for i in range(k)])
    n, last, tried = F.col("n").cast("double"), k - 1, []
    for q in range(lags + 1) if by_aic else [lags]:
        rest, z, left = c[last][last], F.col(f"__b{last}"), F.col("__y")
        for j in range(q):
            rest, z = rest - F.col(f"__l{last}_{j}") * F.col(f"__l{last}_{j}"), z - F.col(f"__l{last}_{j}") * F.col(f"__z{j}")
            left = left - F.col(f"__z{j}") * F.col(f"__z{j}")
        pivot = F.sqrt(F.when(rest > 1e-12 * c[last][last], rest))
        z = z / pivot
        share = left - z * z  # residual sum of squares over n
        free = n - (q + 2)
        stat = F.when((free > 0) & (share > 0), z / F.sqrt(share / free))
        tried.append(F.struct(F.when(share > 0, n * F.log(share) + 2.0 * (q + 2)).alias("aic"), F.lit(q).alias("lags"), (z / pivot).alias("gamma"), stat.alias("adf_stat")))
    best = F.array_min(F.filter(F.array(*tried), lambda t: t["aic"].isNotNull())) if by_aic else tried[0]
    out = made.withColumn("__t", best)
    return out.select(*keys, "n", F.coalesce("__t.lags", F.lit(lags)).alias("lags"), "__t.gamma", "__t.adf_stat", (F.col("__t.adf_stat") < CRITICAL[5][0]).alias("stationary"))


def critical_value(n: Column, level: int = 5) -> Column:
    """The Dickey-Fuller critical value at ``level`` percent for n rows."""
    a, b, c, d = CRITICAL[level]
    return F.lit(a) + b / n + c / (n * n) + d / (n * n * n)


def engle_granger(pairs: DataFrame, keys: list[str], order: list[str], a: str, b: str, lags: int = 1) -> DataFrame:
    """Per pair the hedge ratio and intercept of a on b, and the Dickey-Fuller test of a - hedge_ratio * b."""
    fit = pairs.groupBy(*keys).agg(F.regr_slope(a, b).alias("hedge_ratio"), F.regr_intercept(a, b).alias("intercept"))
    spread = pairs.join(fit, keys).withColumn("__s", F.col(a) - F.col("hedge_ratio") * F.col(b))
    return fit.join(adf(spread, keys, order, "__s", lags), keys)


def rolling_sums(df: DataFrame, s: Series, sums: dict[str, Column], n: int) -> DataFrame:
    """Sums over the last n rows as differences of running sums: a row costs the same for any n. Nulls count as 0."""
    df = df.withColumns({f"__r_{k}": F.sum(F.coalesce(v, F.lit(0.0))).over(s.so_far()) for k, v in sums.items()})
    df = df.withColumns({k: F.col(f"__r_{k}") - F.coalesce(s.lag(f"__r_{k}", n), F.lit(0.0)) for k in sums})
    return df.drop(*[f"__r_{k}" for k in sums])


def rolling_stats(df: DataFrame, s: Series, x: str, ns: Sequence[int], ddof: int = 1) -> DataFrame:
    """Adds x_n<n>, x_mean<n> and x_std<n> of the last n rows for every n, all from one set of running sums.

    Sums are taken about the session's first value, so that little is lost to cancellation.
    Deviations need more than ``ddof`` values; nulls are left out.
    """
    base = F.first(x, ignorenulls=True).over(s.so_far())
    df = df.withColumn("__base", base).withColumn("__c", F.col(x) - F.col("__base"))
    one = {"n": F.when(F.col("__c").isNotNull(), 1.0).otherwise(0.0), "s": F.coalesce("__c", F.lit(0.0)), "q": F.coalesce(F.col("__c") * F.col("__c"), F.lit(0.0))}
    df = df.withColumns({f"__r{k}": F.sum(v).over(s.so_far()) for k, v in one.items()})
    for n in ns:
        df = df.withColumns({f"__{k}": F.col(f"__r{k}") - F.coalesce(s.lag(f"__r{k}", n), F.lit(0.0)) for k in one})
        count = F.nullif(F.col("__n"), F.lit(0.0))
        spread = F.greatest(F.lit(0.0), F.col("__q") - F.col("__s") * F.col("__s") / count)
        df = df.withColumns({f"{x}_n{n}": F.col("__n"), f"{x}_mean{n}": F.col("__base") + F.col("__s") / count, f"{x}_std{n}": F.when(F.col("__n") > ddof, F.sqrt(spread / (F.col("__n") - ddof)))})
    return df.drop("__base", "__c", "__rn", "__rs", "__rq", "__n", "__s", "__q")


def rolling_corr(df: DataFrame, s: Series, x: str, y: str, n: int, min_periods: int, out: str) -> DataFrame:
    """Adds the Pearson correlation of x and y over the last n rows from running sums; null below min_periods pairs or without spread."""
    at = lambda c: F.first(c, ignorenulls=True).over(s.so_far())
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    df = df.withColumns({"__a": F.when(pair, F.col(x) - at(x)), "__b": F.when(pair, F.col(y) - at(y))})
    a, b = F.col("__a"), F.col("__b")
    names = ["__n", "__sa", "__sb", "__aa", "__bb", "__ab"]
    df = rolling_sums(df, s, dict(zip(names, (F.when(pair, 1.0), a, b, a * a, b * b, a * b))), n)
    m, sa, sb, aa, bb, ab = map(F.col, names)
    m = F.nullif(m, F.lit(0.0))
    va, vb = aa / m - (sa / m) * (sa / m), bb / m - (sb / m) * (sb / m)
    spread = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    return df.withColumn(out, F.when((m >= min_periods) & (spread > 1e-12), (ab / m - (sa / m) * (sb / m)) / F.nullif(spread, F.lit(0.0)))).drop("__a", "__b", *names)


def rolling_ar(df: DataFrame, s: Series, x: str, n: int, p: int = 5, min_periods: int | None = None, out: str = "phi") -> DataFrame:
    """Coefficients out1..outp of x on a constant and its last p values over the last n rows of the session.

    Windowed cross moments, then a p x p solve per row. Null below ``min_periods`` whole rows
    (default n) and where values don't determine the coefficients.
    """
    lag = [f"__x{k}" for k in range(1, p + 1)]
    df = df.withColumns({c: s.lag(x, k) for k, c in enumerate(lag, 1)})
    ok = F.col(x).isNotNull()
    for c in lag:
        ok = ok & F.col(c).isNotNull()
    prod = lambda a, b: F.when(ok, F.col(a) * F.col(b))
    sums = {"__n": F.when(ok, 1.0), "__s": F.when(ok, F.col(x))} | {f"__s{i}": F.when(ok, F.col(c)) for i, c in enumerate(lag)}
    sums |= {f"__c{i}_{j}": prod(lag[i], lag[j]) for i in range(p) for j in range(i + 1)} | {f"__b{i}": prod(lag[i], x) for i in range(p)}
    df = rolling_sums(df, s, sums, n)
    rows = F.nullif(F.col("__n"), F.lit(0.0))
    c = [[F.col(f"__c{max(i, j)}_{min(i, j)}") - F.col(f"__s{i}") * F.col(f"__s{j}") / rows for j in range(p)] for i in range(p)]
    df = cholesky(df, c, [F.col(f"__b{i}") - F.col(f"__s{i}") * F.col("__s") / rows for i in range(p)])
    names = [f"{out}{k}" for k in range(1, p + 1)]
    df = back_substituted(df, p, names)
    enough = F.col("__n") >= (n if min_periods is None else min_periods)
    return df.withColumns({c: F.when(enough, F.col(c)) for c in names}).drop("__n", *lag, *[k for k in sums if k != "__n"])


def hurst(df: DataFrame, keys: list[str], order: list[str], x: str, min_lag: int = 2, max_lag: int = 100) -> DataFrame:
    """(keys, n, lags, hurst) by rescaled range: the slope of ln(R/S) on ln(lag) for lags in [min_lag, max_lag).

    A series is cut into blocks of each lag; R is the range of a block's summed deviations, S its
    deviation (divisor n), and R/S is averaged over blocks with S > 0. A row meets each lag once,
    and a group is one block. Series of under 2 * max_lag values, or with under five lags that
    count, have a null exponent.
    """
    rows = df.select(*keys, *order, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    rows = rows.withColumns({"__i": F.row_number().over(Series(keys, order).w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    sizes = rows.groupBy(*keys).agg(F.max("__n").alias("n"))
    long = rows.where(F.col("__n") >= 2 * max_lag).withColumn("__lag", F.explode(F.sequence(F.lit(min_lag), F.lit(max_lag - 1))))
    long = long.withColumn("__block", F.floor(F.col("__i") / F.col("__lag"))).where((F.col("__block") + 1) * F.col("__lag") <= F.col("__n"))
    blocks = long.groupBy(*keys, "__lag", "__block").agg(F.sort_array(F.collect_list(F.struct("__i", "__x"))).alias("__s"), F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__sd"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("at"), F.lit(float("-inf")).alias("high"), F.lit(float("inf")).alias("low"))

    def step(acc, v):
        at = acc["at"] + (v["__x"] - F.col("__m"))
        return F.struct(at.alias("at"), F.greatest(acc["high"], at).alias("high"), F.least(acc["low"], at).alias("low"))

    ranged = blocks.withColumn("__rs", F.when(F.col("__sd") > 1e-12, F.aggregate("__s", start, step, lambda a: a["high"] - a["low"]) / F.col("__sd")))
    by_lag = ranged.groupBy(*keys, "__lag").agg(F.avg("__rs").alias("__rs")).where("__rs > 0")
    fit = by_lag.groupBy(*keys).agg(F.count(F.lit(1)).alias("lags"), F.regr_slope(F.log("__rs"), F.log("__lag")).alias("__h"))
    both = sizes.join(fit, keys, "left")
    return both.select(*keys, "n", F.coalesce("lags", F.lit(0)).alias("lags"), F.when(F.col("lags") >= 5, F.col("__h")).alias("hurst"))


def exponential_ks(df: DataFrame, keys: list[str], x: str, cells: int = 256) -> DataFrame:
    """(keys, n, mean, ks): the largest distance of the distribution of positive x from the exponential one of its mean.

    Values are cut at quantiles of the fitted distribution; counts of whole cells come from one
    small aggregation, ranks from windows within a cell, so no key is sorted in one task.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("__x")).where("__x > 0")
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mean"))
    rows = rows.join(fit, keys).withColumn("__f", 1 - F.exp(-F.col("__x") / F.col("mean")))
    rows = rows.withColumn("__cell", F.least(F.lit(cells - 1), F.floor(F.col("__f") * cells)).cast("int"))
    counts = rows.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.select(*keys, "__cell", before.alias("__before")), [*keys, "__cell"])
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy("__x"))
    gap = F.greatest(rank / F.col("n") - F.col("__f"), F.col("__f") - (rank - 1) / F.col("n"))
    return rows.withColumn("__gap", gap).groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.max("__gap").alias("ks"))


def frac_weights(d: float, threshold: float, most: int = 10_000) -> list[float]:
    """Weights of (1 - B)^d until they fall below ``threshold``."""
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def minimum_d(df: DataFrame, keys: list[str], order: list[str], x: str, grid: Sequence[float] = tuple(i / 10 for i in range(11)), threshold: float = 1e-5, least: int = 20) -> DataFrame:
    """(keys, d, adf_stat, corr, n): the smallest d of ``grid`` whose fractional difference is stationary, else 1.

    All d are differenced and tested (no lagged changes) in one plan. A d with under ``least``
    differences isn't tested; where none passes, d is 1 and the other columns are null.
    """
    s = Series(keys, order)
    weights = {d: frac_weights(d, threshold) for d in grid}
    width = max(map(len, weights.values()))
    rows = df.select(*keys, *order, F.col(x).cast("double").alias("__x")).where("__x is not null")
    rows = rows.withColumn("__past", F.reverse(F.collect_list("__x").over(s.rows(width))))

    def differenced(w: list[float]) -> Column:
        dot = F.aggregate(F.zip_with(F.slice("__past", 1, len(w)), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size("__past") >= len(w), dot)

    each = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("d"), differenced(w).alias("__fd")) for d, w in weights.items()]))
    long = rows.select(*keys, *order, "__x", each.alias("e")).select(*keys, *order, "__x", "e.d", "e.__fd").where("__fd is not null")
    by = [*keys, "d"]
    spread = F.stddev_pop("__fd") * F.stddev_pop("__x")
    corr = long.groupBy(*by).agg((F.covar_pop("__fd", "__x") / F.nullif(spread, F.lit(0.0))).alias("corr"), F.count(F.lit(1)).alias("__m"))
    tested = adf(long, by, order, "__fd", 0).join(corr, by).where((F.col("__m") >= least) & F.col("stationary"))
    best = tested.groupBy(*keys).agg(F.min_by(F.struct("d", "adf_stat", "corr", F.col("__m").alias("n")), "d").alias("b"))
    out = df.select(*keys).distinct().join(best, keys, "left")
    return out.select(*keys, F.coalesce("b.d", F.lit(1.0)).alias("d"), "b.adf_stat", "b.corr", "b.n")


def depth_fit(prices: Column, quantities: Column, tick: float, default: tuple[float, float]) -> Column:
    """Struct (a, kappa) of the least-squares line ln q = ln a - kappa * delta over one side's levels.

    delta is the distance from the best price, a tick at the best; levels without price or
    quantity are left out. Under two levels give ``default``; kappa is 0.1 at least; where all
    distances are equal, the line is the one of least norm.
    """
    # One element, so that what the lambda reads is made once.
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def moments(side: Column) -> Column:
        best = F.get(side["p"], F.lit(0))
        point = lambda p, q: F.struct(F.when(p == best, F.lit(tick)).otherwise(F.abs(p - best)).alias("x"), F.when((p > 0) & (q > 0), F.log(q.cast("double"))).alias("y"))
        points = F.filter(F.zip_with(side["p"], side["q"], point), lambda t: t["y"].isNotNull())
        add = lambda m, x, y: F.struct((m["n"] + 1.0).alias("n"), (m["x"] + x).alias("x"), (m["y"] + y).alias("y"), (m["xx"] + x * x).alias("xx"), (m["xy"] + x * y).alias("xy"))
        return F.aggregate(points, F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")]), lambda m, t: add(m, t["x"], t["y"]))

    def line(m: Column) -> Column:
        n, sx, sy = m["n"], m["x"], m["y"]
        det = n * m["xx"] - sx * sx
        flat = sy / F.nullif(n * (1 + (sx / n) * (sx / n)), F.lit(0.0))  # ln a of least norm where all x are one value
        slope = F.when(det > 1e-12, (n * m["xy"] - sx * sy) / det).otherwise(flat * sx / n)
        at0 = lambda b: F.when(det > 1e-12, (sy - b * sx) / n).otherwise(flat)
        fit = once(slope, lambda b: F.struct(F.exp(at0(b)).alias("a"), F.greatest(F.lit(0.1), -b).alias("kappa")))
        return F.when(n >= 2, fit).otherwise(F.struct(F.lit(default[0]).alias("a"), F.lit(default[1]).alias("kappa")))

    return once(once(F.struct(prices.alias("p"), quantities.alias("q")), moments), line)
