"""Validated merges, spot choice, fills, Newton volatility and rules against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from microtide.operators import desk


def test_merge_refuses_repeated_keys(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0), (None, 1, 3.0)], "k string, t int, a double")
    b = spark.createDataFrame([("x", 1, 5.0)], "k string, t int, b double")
    got = {(r.k, r.a, r.b) for r in desk.merge_one_to_one(a, b, ["k", "t"]).collect()}
    assert got == {("x", 1.0, 5.0), ("y", 2.0, None), (None, 3.0, None)}
    with pytest.raises(ValueError, match="left side: 1 keys"):
        desk.merge_one_to_one(a.union(a.limit(1)), b, ["k", "t"])
    with pytest.raises(ValueError, match="right side: 1 keys"):
        desk.merge_one_to_one(a, b.union(b), ["k", "t"])


def test_spot_falls_back_by_day_not_by_second(spark):
    rows = [("N", 1, 10, 1, "SPOT", 5.0), ("N", 1, 10, 2, "SPOT", 6.0), ("N", 1, 11, 3, "FUT", 9.0), ("N", 2, 10, 4, "FUT", 7.0), ("N", 3, 10, 5, "SPOT", 0.0), ("N", 3, 10, 6, "FUT", 8.0), ("N", 4, 1, 7, "OTHER", 1.0)]
    df = spark.createDataFrame(rows, "u string, day int, ts int, o int, source string, price double")
    rank = F.when(F.col("source") == "SPOT", 0).when(F.col("source") == "FUT", 1)
    got = sorted(tuple(r) for r in desk.spot_prices(df, ["u", "day"], "ts", ["o"], "price", rank).collect())
    assert got == [("N", 1, 10, 6.0, 0), ("N", 2, 10, 7.0, 1), ("N", 3, 10, 8.0, 1)]


def test_fills_reach_both_ways(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([None, None, 3.0, None, 5.0, None])] + [("b", 0, None)], "k string, t int, x double")
    got = [(r.k, r.x) for r in desk.fill_both_ways(df, ["k"], "t", "x").orderBy("k", "t").collect()]
    assert got == [("a", v) for v in (3.0, 3.0, 3.0, 3.0, 5.0, 5.0)] + [("b", None)]


def test_bars_take_the_change_of_volume(spark):
    rows = [("a", 1, 1, 10.0, 100), ("a", 1, 2, 12.0, 130), ("a", 1, 3, -1.0, 999), ("a", 2, 4, 11.0, 150)]
    got = [tuple(r) for r in desk.instrument_bars(spark.createDataFrame(rows, "k string, ts int, o int, p double, v long"), ["k"], "ts", ["o"], "p", "v").orderBy("bar_ts").collect()]
    assert [g[:9] for g in got] == [("a", 1, 10.0, 12.0, 10.0, 12.0, 30, 130, 2), ("a", 2, 11.0, 11.0, 11.0, 11.0, 0, 150, 1)]


def plain_newton(call, price, s, k, t, r=0.065):
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    if t <= 0 or price <= 0 or price < max(s - k if call else k - s, 0) - 1e-6:
        return None
    v = 0.10
    for _ in range(100):
        d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
        d2, g = d1 - v * math.sqrt(t), 1 if call else -1
        f = g * (s * cdf(g * d1) - k * math.exp(-r * t) * cdf(g * d2)) - price
        vega = s * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * math.sqrt(t)
        if abs(vega) < 1e-10:
            break
        new = v - f / vega
        if new <= 0:
            v /= 2
            continue
        done, v = abs(new - v) < 1e-5, new
        if done:
            break
    return v if 0.001 < v < 5 else None


def test_newton_equals_the_loop(spark):
    cases = [(c, p, s, k, t) for c in (True, False) for s, k in ((100.0, 90.0), (100.0, 100.0), (100.0, 130.0)) for t in (0.02, 0.5, 0.0) for p in (0.0, 0.4, 3.0, 12.0, 35.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c boolean, p double, s double, k double, t double")
    got = {r.i: r.v for r in df.select("i", desk.implied_vol_newton(*[F.col(c) for c in "cpskt"]).alias("v")).collect()}
    found = 0
    for i, c in enumerate(cases):
        want = plain_newton(*c)
        # The distribution function is an approximation within 1e-7: prices far out of the money tell nothing finer.
        if want is None:
            assert got[i] is None, c
        else:
            found += 1
            assert got[i] == pytest.approx(want, abs=2e-4), c
    assert found > 30


def test_rules_columns_and_decay(spark):
    df = spark.createDataFrame([(20.0, 9.0, 9.0, 1.0), (2000.0, 9.0, 9.0, 1.0), (60.0, 1.0, 9.0, 1.0), (60.0, 9.0, 4.0, 1.0), (60.0, 9.0, 9.0, 0.0), (60.0, 9.0, 9.0, 1.0)], "h double, s double, n double, r double")
    got = [x.v for x in df.select(desk.tradeable(*[F.col(c) for c in "hsnr"]).alias("v")).collect()]
    assert got == ["half_life too fast", "half_life too slow", "spread too small", "few signals", "negative hedge", "ok"]
    assert [tuple(x) for x in desk.aligned_columns(df.limit(1), ["r", "missing", "h"]).collect()] == [(1.0, 0.0, 20.0)]
    ics = spark.createDataFrame([("a", h, 0.3 * math.exp(-0.2 * h)) for h in (1, 2, 5, 9)] + [("b", 1, 0.1), ("b", 2, -0.1)], "k string, h int, ic double")
    got = {x.k: x for x in desk.ic_decay(ics, ["k"], "h", "ic").collect()}
    assert got["a"].ic0 == pytest.approx(0.3) and got["a"].half_life == pytest.approx(math.log(2) / 0.2) and got["b"].half_life is None and got["b"].peak_ic == 0.1
    bars = spark.createDataFrame([("o", i, 100.0) for i in range(300)] + [("n", i, 120.0 if i < 100 else 900.0) for i in range(300)] + [("z", 0, 1e9)], "k string, t int, p double")
    pairs = spark.createDataFrame([("o", "n"), ("o", "z"), ("o", "none")], "old string, new string")
    got = {x.new: x.price_ratio for x in desk.price_ratio(bars, "k", ["t"], "p", pairs, "old", "new").collect()}
    assert got == {"n": pytest.approx(1.2), "z": 1.3, "none": 1.0}
