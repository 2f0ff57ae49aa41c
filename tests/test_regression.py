"""Regressions by cross moments against numpy and plain loops."""

import numpy as np
import pytest

from microtide.operators import regression
from microtide.operators.windows import Series


def series(spark, groups, kind="double"):
    return spark.createDataFrame([(k, i, float(v) if v is not None else None, 0) for k, x in groups.items() for i, v in enumerate(x)], f"k string, t int, x {kind}, __x int".replace("__x", "other"))


def dickey_fuller(x, lags):
    x = np.array([v for v in x if v is not None], float)
    d = np.diff(x)
    y = d[lags:]
    z = np.column_stack([x[lags:-1]] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)] + [np.ones(len(y))])
    return regress(z, y)


def regress(z, y):
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    rss = ((y - z @ b) ** 2).sum()
    cov = rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)
    return len(y), b[0], b[0] / np.sqrt(cov[0, 0]), len(y) * np.log(rss / len(y)) + 2 * z.shape[1]


@pytest.fixture(scope="module")
def walks():
    r = np.random.default_rng(1)
    ar = np.zeros(300)
    for i in range(1, 300):
        ar[i] = 0.6 * ar[i - 1] + r.normal()
    return {"walk": np.cumsum(r.normal(0, 1, 300)) + 1e4, "ar": ar, "noise": [None, *r.normal(0, 1, 80), None], "flat": [5.0] * 50, "short": [1.0, 2.0], "none": [None, None]}


def test_adf_equals_lstsq(spark, walks):
    df = series(spark, walks)
    for lags in (0, 1, 3):
        got = {r.k: r for r in regression.adf(df, ["k"], ["t"], "x", lags).collect()}
        for k in ("walk", "ar", "noise"):
            n, gamma, stat, _ = dickey_fuller(walks[k], lags)
            assert got[k].n == n and np.isclose(got[k].gamma, gamma, rtol=1e-8) and np.isclose(got[k].adf_stat, stat, rtol=1e-8)
        assert got["flat"].adf_stat is None and got["flat"].stationary is None
        assert got.get("short") is None or got["short"].adf_stat is None
    assert got["ar"].stationary and not got["walk"].stationary
    chosen = {r.k: r for r in regression.adf(df, ["k"], ["t"], "x", 3, by_aic=True).collect()}
    for k in ("walk", "ar", "noise"):
        x = np.array([v for v in walks[k] if v is not None], float)
        d = np.diff(x)
        tried = []
        for q in range(4):  # all over the rows that three lags leave
            z = np.column_stack([x[3:-1]] + [d[3 - j : len(d) - j] for j in range(1, q + 1)] + [np.ones(len(d) - 3)])
            tried.append((*regress(z, d[3:])[::-1][:2], q))
        aic, stat, q = min(tried)
        assert chosen[k].lags == q and np.isclose(chosen[k].adf_stat, stat, rtol=1e-8)


def test_cointegrated_pairs_are_told_from_others(spark):
    r = np.random.default_rng(2)
    b = np.cumsum(r.normal(0, 1, 400)) + 100
    rows = [("p", i, float(2 * b[i] + 3 + r.normal()), float(b[i])) for i in range(400)]
    rows += [("q", i, float(v), float(b[i])) for i, v in enumerate(np.cumsum(r.normal(0, 1, 400)))]
    got = {x.k: x for x in regression.engle_granger(spark.createDataFrame(rows, "k string, t int, a double, b double"), ["k"], ["t"], "a", "b").collect()}
    assert got["p"].stationary and abs(got["p"].hedge_ratio - 2) < 0.05 and not got["q"].stationary


def test_rolling_ar_equals_lstsq(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, 120)
    x[40] = np.nan
    df = series(spark, {"a": [None if np.isnan(v) else v for v in x], "b": [1.0] * 70})
    got = {(g.k, g.t): g for g in regression.rolling_ar(df, Series(["k"], "t"), "x", 30, 5, 20).collect()}
    assert len(got) == 190 and set(df.columns) < set(next(iter(got.values())).asDict())
    lagged = np.column_stack([np.r_[[np.nan] * k, x[:-k]] for k in range(1, 6)])
    ok = np.isfinite(x) & np.isfinite(lagged).all(1)
    seen = 0
    for t in range(120):
        at = [i for i in range(max(0, t - 29), t + 1) if ok[i]]
        mine = [got["a", t][f"phi{k}"] for k in range(1, 6)]
        if len(at) < 20:
            assert mine == [None] * 5
            continue
        seen += 1
        want = np.linalg.lstsq(np.column_stack([np.ones(len(at)), lagged[at]]), x[at], rcond=None)[0][1:]
        assert np.allclose(mine, want, rtol=1e-6, atol=1e-8)
    assert seen > 60 and all(got["b", t].phi1 is None for t in range(70))


def test_hurst_equals_the_loop(spark):
    r = np.random.default_rng(4)
    groups = {"noise": r.normal(0, 1, 260), "walk": np.cumsum(r.normal(0, 1, 230)), "short": r.normal(0, 1, 50), "flat": [1.0] * 250}
    got = {g.k: g for g in regression.hurst(series(spark, groups), ["k"], ["t"], "x").collect()}
    for k in ("noise", "walk"):
        x, points = np.array(groups[k]), []
        for lag in range(2, 100):
            rs = []
            for w in range(len(x) // lag):
                b = x[w * lag : (w + 1) * lag]
                dev = np.cumsum(b - b.mean())
                if b.std() > 0:
                    rs.append((dev.max() - dev.min()) / b.std())
            if rs and np.mean(rs) > 0:
                points.append((np.log(lag), np.log(np.mean(rs))))
        assert np.isclose(got[k].hurst, np.polyfit(*zip(*points), 1)[0], rtol=1e-9) and got[k].lags == len(points)
    assert got["short"].hurst is None and got["short"].n == 50 and got["flat"].hurst is None


def test_ks_distance_equals_brute_force(spark):
    r = np.random.default_rng(5)
    groups = {"exp": r.exponential(3, 700), "ties": np.repeat([1.0, 2.0, 5.0], 30), "one": [2.0], "none": [-1.0, 0.0]}
    for cells in (256, 3):
        got = {g.k: g for g in regression.exponential_ks(series(spark, groups), ["k"], "x", cells).collect()}
        assert set(got) == {"exp", "ties", "one"}
        for k in got:
            x = np.sort(groups[k])
            f, n = 1 - np.exp(-x / x.mean()), len(x)
            i = np.arange(n)
            assert got[k].n == n and np.isclose(got[k].ks, np.maximum((i + 1) / n - f, f - i / n).max())


def test_smallest_d_equals_the_loop(spark):
    r = np.random.default_rng(6)
    groups = {"walk": np.cumsum(r.normal(0, 1, 200)) + 50, "noise": r.normal(0, 1, 100), "short": r.normal(0, 1, 10)}
    got = {g.k: g for g in regression.minimum_d(series(spark, groups), ["k"], ["t"], "x", threshold=1e-2).collect()}
    for k, x in groups.items():
        want = (1.0, None)
        for d in [i / 10 for i in range(11)]:
            w = np.array(regression.frac_weights(d, 1e-2))
            fd = np.array([w @ x[i - len(w) + 1 : i + 1][::-1] for i in range(len(w) - 1, len(x))])
            if len(fd) >= 20 and (stat := dickey_fuller(fd, 0)[2]) < -2.86154:
                want = (d, stat)
                break
        assert got[k].d == want[0] and (want[1] is None and got[k].adf_stat is None or np.isclose(got[k].adf_stat, want[1], rtol=1e-8))
    assert got["walk"].d > 0 and got["noise"].d == 0 and got["short"].n is None


def test_fractional_weights_follow_the_binomial_series():
    assert np.allclose(regression.frac_weights(1.0, 1e-9), [1, -1])
    assert np.allclose(regression.frac_weights(0.5, 0.03)[:4], [1, -0.5, -0.125, -0.0625])


def test_depth_fit_equals_lstsq(spark):
    from pyspark.sql import functions as F

    cases = [([10.0, 9.5, 9.0, 8.0, 7.0], [100, 80, 70, 20, 5]), ([10.0, 9.0, 0.0, 8.0, 7.0], [5, 0, 9, 20, 50]), ([10.0, 0.0], [5, 0]), ([10.0, 10.05], [5, 9]), ([], []), (None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<double>, q array<long>")
    got = {g.i: g.f for g in df.select("i", regression.depth_fit(F.col("p"), F.col("q"), 0.05, (140.0, 1.5)).alias("f")).collect()}
    for i, (p, q) in enumerate(cases):
        live = [(abs(a - p[0]) or 0.05, np.log(b)) for a, b in zip(p or [], q or []) if a > 0 and b > 0]
        if len(live) < 2:
            assert (got[i].a, got[i].kappa) == (140.0, 1.5)
            continue
        x, y = map(np.array, zip(*live))
        c = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        assert np.isclose(got[i].a, np.exp(c[0])) and np.isclose(got[i].kappa, max(0.1, -c[1]))
