"""Quantiles, grids, labels, regimes and as-of joins against plain loops."""

import datetime
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from microtide.operators import bars, evaluate, features, joins, quantiles, regression, windows
from microtide.operators.windows import Series


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    groups = {"smooth": r.normal(0, 1, 500), "skewed": np.exp(r.normal(0, 6, 300)), "ties": np.repeat([1.0, 2.0], [400, 3]), "one": [7.0], None: [1.0, 2.0, 4.0], "null": []}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("null", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for cells in (4096, 2):
        got = {g[0]: g[1:] for g in quantiles.exact_quantiles(df, ["k"], "x", qs, [f"q{i}" for i in range(6)], cells).collect()}
        assert set(got) == {"smooth", "skewed", "ties", "one", None}
        for k, v in got.items():
            assert np.allclose(v, np.quantile(groups[k], qs), rtol=1e-12)
    whole = quantiles.exact_quantiles(df, [], "x", [0.5], ["m"]).collect()
    assert np.isclose(whole[0].m, np.median([v for _, v in rows if v is not None]))


def test_bucketed_asof_is_the_plain_one(spark):
    r = random.Random(2)
    left = spark.createDataFrame([(r.choice(["a", "b", None]), r.randint(0, 500), i) for i in range(200)], "k string, t long, i int")
    right = spark.createDataFrame([(r.choice(["a", "b", None]), r.randint(100, 480), r.random()) for _ in range(30)], "k string, t long, v double")
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    for keys in (["k"], []):
        for tolerance in (None, 40):
            want = key(joins.asof_join(left, right, keys, "t", ["v"], tolerance))
            assert key(joins.asof_join(left, right, keys, "t", ["v"], tolerance, bucket=25)) == want


def test_grid_fills_gaps(spark):
    df = spark.createDataFrame([("a", 30, 1.0, 5), ("a", 120, None, 7), ("a", 150, 3.0, None), ("b", 60, 9.0, 1)], "k string, t long, p double, v long")
    got = [tuple(x) for x in bars.regularize(df, ["k"], "t", 30, ["p"], ["v"]).orderBy("k", "t").collect()]
    assert got == [("a", 30, 1.0, 5, 1), ("a", 60, 1.0, 0, 0), ("a", 90, 1.0, 0, 0), ("a", 120, 1.0, 7, 1), ("a", 150, 3.0, 0, 1), ("b", 60, 9.0, 1, 1)]


def test_barriers_end_with_the_session(spark):
    r = random.Random(3)
    rows = [(s, d, 100 * d + t, r.choice([None, 0.0] + [10 + r.random()] * 9)) for s in "ab" for d in (1, 2) for t in range(60) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "s string, d int, t long, p double")
    for whole in (True, False):
        got = {(x.s, x.t): (x.label, x.touch_ts) for x in evaluate.triple_barrier(df, ["s", "d"], "t", "p", 0.05, 0.05, 10, whole).collect()}
        assert len(got) == len(rows)
        for s, d, t, p in rows:
            ahead = sorted((u, q) for s2, d2, u, q in rows if (s2, d2) == (s, d) and t < u <= t + 10)
            live = [(u, q / p - 1) for u, q in ahead if q and q > 0] if p and p > 0 else []
            if not p or whole and (not live or ahead[-1][0] != t + 10):
                assert got[s, t] == (None, None)
                continue
            hit = next(((1 if x >= 0.05 else -1, u) for u, x in live if abs(x) >= 0.05), (0, None))
            assert got[s, t] == hit


def test_rolling_stats_equal_pandas(spark):
    r = np.random.default_rng(4)
    x = pd.Series(1e6 + r.normal(0, 1, 200))
    x[[5, 6, 7, 90]] = None
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    got = regression.rolling_stats(df, Series(["k"], "t"), "x", (4, 50)).orderBy("t").toPandas()
    for n in (4, 50):
        w = x.rolling(n, min_periods=1)
        assert np.allclose(got[f"x_mean{n}"].astype(float), w.mean(), rtol=1e-12, equal_nan=True)
        assert np.allclose(got[f"x_std{n}"].astype(float), w.std(), rtol=1e-6, equal_nan=True)


def test_regimes_equal_the_loop(spark):
    r = np.random.default_rng(5)
    step = np.concatenate([r.normal(0, 0.1, 150), np.repeat(r.normal(0, 0.1, 30), 5), r.normal(0, 1.5, 60)])
    price = 100 + np.cumsum(step)
    vol = np.abs(np.r_[np.full(250, 0.1), np.full(110, 2.0)]) + r.random(360) * 0.01
    calm = float(np.quantile(vol[:300], 0.75))
    df = spark.createDataFrame([("a", i, float(p), float(v), calm) for i, (p, v) in enumerate(zip(price, vol))], "k string, t int, p double, vol double, calm double")
    got = [x.regime for x in windows.variance_regime(df, Series(["k"], "t"), "p", 60, 10, "vol", "calm").orderBy("t").collect()]
    want = []
    for i in range(360):
        past = pd.Series(price[i - 60 : i]) if i >= 60 else None
        if past is None:
            want.append("CHOPPY")
        elif vol[i - 60 : i].mean() > 1.5 * calm:
            want.append("VOLATILE")
        else:
            vr = past.pct_change(10).dropna().var() / (10 * past.pct_change().dropna().var())
            want.append("MEAN_REVERTING" if vr < 0.85 else "TRENDING" if vr > 1.15 else "CHOPPY")
    assert got == want and set(want) == {"CHOPPY", "VOLATILE", "MEAN_REVERTING", "TRENDING"}


def test_blocks_of_rank_correlation(spark):
    r = np.random.default_rng(6)
    x, y = r.integers(0, 9, 70), r.normal(0, 1, 70)
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, t int, x double, y double")
    got = sorted(map(tuple, evaluate.chunked_ic(df, ["k"], "t", "x", "y", 30).collect()))
    assert [g[:2] for g in got] == [("a", 0), ("a", 1)]
    for (_, c, ic) in got:
        part = pd.DataFrame({"x": x[30 * c : 30 * c + 30], "y": y[30 * c : 30 * c + 30]})
        assert np.isclose(ic, part.rank().corr().iloc[0, 1])


def test_autocorrelation_of_the_rows_before(spark):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, 100)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    got = [g.ac for g in features.rolling_autocorrelation(df, Series(["k"], "t"), "x", 20, "ac").orderBy("t").collect()]
    want = [np.corrcoef(x[i - 20 : i][:-1], x[i - 20 : i][1:])[0, 1] if i >= 20 else 0.0 for i in range(100)]
    assert np.allclose(got, want, rtol=1e-9)


def test_rolling_correlation_equals_pandas(spark):
    r = np.random.default_rng(8)
    x, y = pd.Series(1e4 + r.normal(0, 1, 150)), pd.Series(r.normal(0, 1, 150))
    y[[3, 50, 51]] = None
    x[100:125] = 7.0
    df = spark.createDataFrame([("a", i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, t int, x double, y double")
    got = np.array([g.c for g in regression.rolling_corr(df, Series(["k"], "t"), "x", "y", 20, 10, "c").orderBy("t").collect()], float)
    for i in range(150):
        part = pd.DataFrame({"x": x, "y": y}).iloc[max(0, i - 19) : i + 1].dropna()
        if len(part) < 10 or part.x.std(ddof=0) < 1e-9:
            assert np.isnan(got[i]) or len(part) >= 10 and abs(got[i]) <= 1.01
        else:
            assert np.isclose(got[i], part.x.corr(part.y), atol=1e-5)


def test_clock_features(spark):
    at = int(datetime.datetime(2024, 1, 1, 3, 45, tzinfo=datetime.timezone.utc).timestamp())  # 09:15 in India
    got = features.clock_features(spark.createDataFrame([(at,), (at + 3600,), (at - 7200,), (at + 9 * 3600,)], "ts long"), "ts").orderBy("ts").collect()
    assert [round(x.mins_since_open, 6) for x in got] == [0, 0, 60, 375] and [round(x.mins_to_close, 6) for x in got] == [375, 375, 315, 0]
    assert all(abs(x.ist_sin**2 + x.ist_cos**2 - 1) < 1e-12 for x in got)
