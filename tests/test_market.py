"""Market operators against small fixtures and DuckDB."""

import datetime
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from microtide.functions import scalar
from microtide.operators import bars, evaluate, joins, regimes, simulate, windows
from microtide.operators.windows import Series
from microtide.plans import registry
from microtide.sources import tables

DATA = "/root/testdata/sf0.001"


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["ohlc_rolling_bars", "grid_regularize", "rolling_median", "asof_join", "triple_barrier", "fifo_match", "forward_return_ic", "bs_greeks", "set_operations", "stream_replay_bars", "contract_calendar"])
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = sorted(x[0] for x in cur.description)
    assert names == sorted(df.columns)
    at = [[x[0] for x in cur.description].index(n) for n in names]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) >= 80


def test_flatten_pads_missing_levels(spark):
    row = {"symbol": "A", "depth": {"buy": [{"price": 10.0, "quantity": 5, "orders": 1}], "sell": []}}
    got = bars.flatten_depth(spark.createDataFrame([row], "symbol string, depth struct<buy: array<struct<price: double, quantity: long, orders: long>>, sell: array<struct<price: double, quantity: long, orders: long>>>")).first()
    assert (got.bid_p1, got.bid_q1, got.bid_p2, got.ask_p1, got.ask_q5) == (10.0, 5, 0.0, 0.0, 0)


def test_first_and_last_follow_the_order(spark):
    rows = [("A", 100, 3, 1.0, 1), ("A", 100, 1, 2.0, 1), ("A", 100, 2, 5.0, 2), ("A", 101, 4, -1.0, 1)]
    got = bars.time_bars(spark.createDataFrame(rows, "s string, t long, o long, p double, q long"), ["s"], "t", ["o"], "p", "q").collect()
    assert [(r.bar_ts, r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100, 2.0, 5.0, 1.0, 1.0, 4)]


def test_min_periods_count_values(spark):
    rows = [("A", i, None if i % 2 else float(i)) for i in range(6)]
    s = Series(["k"], "t")
    got = spark.createDataFrame(rows, "k string, t long, x double").select("t", s.rolling("sum", "x", 4, 2).alias("y")).orderBy("t").collect()
    want = pd.Series([r[2] for r in rows]).rolling(4, min_periods=2).sum()
    assert [r.y for r in got] == [None if np.isnan(v) else v for v in want]


def test_rank_pct_matches_pandas(spark):
    x = np.random.default_rng(1).integers(0, 5, 40).astype(float)
    s = Series(["k"], "t")
    got = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double").select("t", s.rank_pct("x", 10).alias("y")).orderBy("t").collect()
    assert np.allclose([r.y for r in got], pd.Series(x).rolling(10, min_periods=1).rank(pct=True))


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("k", 100, "c"), ("z", 5, "d")], "k string, t long, n string")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 5, 2.0), ("k", 3, 9.0)], "k string, t long, v double")
    got = {r.n: r.r_v for r in joins.asof_join(left, right, ["k"], "t", ["v"], tolerance=10).collect()}
    assert got == {"a": 2.0, "b": None, "c": None, "d": None}


def test_barrier_bins_see_the_whole_horizon(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(2000, 300, replace=False))
    p = 100 + rng.standard_normal(300).cumsum()
    got = {r.t: (r.label, r.touch_ts) for r in evaluate.triple_barrier(spark.createDataFrame(pd.DataFrame({"k": "A", "t": t, "p": p})), ["k"], "t", "p", 0.01, 0.01, 60).collect()}
    for i in range(300):
        ahead = [(int(t[j]), p[j] / p[i] - 1) for j in range(i + 1, 300) if t[j] <= t[i] + 60]
        hit = next(((1 if v >= 0.01 else -1, s) for s, v in ahead if abs(v) >= 0.01), (0, None))
        assert got[int(t[i])] == hit


def test_calendar(spark):
    one = spark.createDataFrame([(datetime.date(2026, 5, 3),)], "d date")
    r = one.select(scalar.last_business_day(F.col("d")).alias("b"), scalar.last_weekday(F.col("d")).alias("t"), scalar.contract_code(F.col("d")).alias("c")).first()
    assert (r.b, r.t, r.c) == (datetime.date(2026, 5, 29), datetime.date(2026, 5, 28), "26MAYFUT")


def test_costs_take_either_case(spark):
    got = spark.createDataFrame([("equity_futures", "sell", 1e6), ("equity_futures", "SELL", 1e6), ("equity_futures", "BUY", 1e6)], "k string, s string, v double").select(scalar.transaction_cost(F.col("k"), F.col("s"), F.col("v")).alias("c")).collect()
    assert got[0].c == got[1].c > got[2].c > 0


def test_fixed_values(spark):
    """Against written-out results, not against the library's own tables."""
    cost = lambda kind, side: spark.createDataFrame([(kind, side, 1e6)], "k string, s string, v double").select(scalar.transaction_cost(F.col("k"), F.col("s"), F.col("v")).alias("c")).first().c
    assert cost("equity_futures", "SELL") == pytest.approx((20 + 17.3 + 1) * 1.18 + 500)
    assert cost("equity_options", "BUY") == pytest.approx((20 + 35.3 + 1) * 1.18 + 30)
    assert cost("currency_options", "SELL") == pytest.approx((20 + 9 + 1) * 1.18)
    cases = [
        ("Q3 financial results", 0, "EARNINGS", "PAUSE", 3.0, 120), ("earnings", 7, "EARNINGS", "WIDEN", 1.2, 0), ("earnings", 8, "EARNINGS", "NORMAL", 1.0, 0), ("acquisition of X", 1, "MERGER_ACQUIRE", "AVOID", 5.0, 0),
        ("Takeover", 5, "MERGER_ACQUIRE", "WIDEN", 2.5, 0), ("board mtg", 2, "BOARD_MEETING", "WIDEN", 1.2, 0), ("EGM", 0, "AGM", "NORMAL", 1.0, 0), ("Bonus 1:1", 1, "BONUS_SPLIT", "WIDEN", 1.3, 0), ("rights", 0, "RIGHTS_ISSUE", "NORMAL", 1.0, 0), ("dividend", 0, "DIVIDEND", "WIDEN", 1.2, 0), (None, 0, "OTHER", "NORMAL", 1.0, 0),
    ]
    rows = spark.createDataFrame([(t, d) for t, d, *_ in cases], "t string, d int").withColumn("k", scalar.event_type(F.col("t"))).withColumn("i", scalar.event_impact(F.col("k"), F.col("d"))).collect()
    assert [(x.k, x.i.action, x.i.factor, x.i.pause) for x in rows] == [tuple(c[2:]) for c in cases]
    vix = spark.createDataFrame([(11.9,), (12.0,), (18.0,), (25.0,)], "v double").select(scalar.regime(F.col("v"), scalar.VIX_REGIMES, "EXTREME").alias("r")).collect()
    assert [x.r for x in vix] == ["LOW", "NORMAL", "HIGH", "EXTREME"]
    q = spark.createDataFrame([(9000.0, 50, 0.1, 2.0, 1.5, 0.25)], "m double, i int, g double, k double, s double, t double")
    got = q.select(scalar.reservation_price(F.col("m"), F.col("i"), F.col("g"), F.col("s"), F.col("t"), 100).alias("p"), scalar.optimal_spread(F.col("m"), F.col("g"), F.col("k"), F.col("s"), F.col("t"), 0.1, 50.0).alias("w")).first()
    assert got.p == pytest.approx(9000 - 50 * 0.1 * 2.25 * 0.25 * 1.375) and got.w == pytest.approx(4.5)
    one = spark.createDataFrame([(1.0, 0.4, 18.0, -500.0, 0.1)], "a double, b double, c double, e double, f double").select(scalar.currency_pressure(*[F.col(c) for c in "abcef"]).alias("x"))
    assert one.first().x == pytest.approx(0.6 + 0.1 + 0.04 + 0.075 - 0.02) and one.select(scalar.pressure_regime(F.col("x")).alias("r")).first().r == "STRONG_PRESSURE"
    at = lambda s: spark.range(1).select(scalar.session_label(F.lit(s - 19800 + 86400)).alias("l")).first().l
    assert [at(s) for s in (35099, 35100, 52199, 52200)] == ["open", "midday", "midday", "close"]


def test_positions_flip_and_gate():
    f = pd.DataFrame({"side": ["buy", "BUY", "sell", "buy"], "qty": [10, 10, 30, 10], "price": [100.0, 110.0, 120.0, 100.0]})
    assert simulate.positions(f) == [(4, 0.0, 0.0, 20 * 15.0 + 10 * 20.0)]
    out = simulate.RiskGate(daily_loss=1.0, cooldown=1)(pd.DataFrame({"qty": [1, 1, 1, 500, 1], "gain": [-0.6, 1.0, -0.6, 0.0, 0.0]}))
    assert [r[1] for r in out] == ["OK", "COOLDOWN", "OK", "LOSS_LIMIT", "LOSS_LIMIT"]


def test_directional_exits():
    f = pd.DataFrame({"close": [100.0, 100.0, 102.0, 100.0, 98.0, 98.0], "signal": [2.0, 0, 0, 2.0, 0, 0]})
    assert [(r[0], r[1], r[4]) for r in simulate.Directional()(f)] == [(0, 2, "TP"), (3, 4, "SL")]


def test_hmm_filter_uses_no_future_and_fit_orders_states(spark):
    m = regimes.Hmm([0.5, 0.5], [[0.95, 0.05], [0.05, 0.95]], [0.0, 0.0], [0.1, 2.0])
    x = np.concatenate([np.full(20, 0.01), np.full(20, 3.0)])
    p = regimes.filtered(m, x)
    assert (p[:20].argmax(1) == 0).all() and (p[22:].argmax(1) == 1).all() and np.allclose(regimes.filtered(m, x[:25]), p[:25])
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 200), "t": np.tile(np.arange(200), 2), "x": np.concatenate([rng.standard_normal(200) * np.repeat([0.1, 3.0], 100), rng.standard_normal(200) * np.repeat([3.0, 0.1], 100)])})
    fit = regimes.fit_hmm(spark.createDataFrame(pdf), ["k"], ["t"], "x", k=2, rounds=8)
    assert fit.sd[0] < 0.5 < 2 < fit.sd[1] and regimes.Hmm.load(fit.save()) == fit


def test_hmm_fit_runs_until_the_likelihood_stands(spark):
    r = np.random.default_rng(4)
    state = np.zeros(400, int)
    for t in range(1, 400):
        state[t] = state[t - 1] if r.random() < 0.95 else r.integers(0, 3)
    x = r.normal(0, np.array([0.5, 1.0, 2.0])[state])
    pdf = pd.DataFrame({"k": np.arange(400) // 200, "t": np.arange(400), "x": x})
    ll = lambda m: sum(regimes.smoothed_counts(m, part)["ll"][0] for part in (x[:200], x[200:]))
    frame = spark.createDataFrame(pdf)
    full, short = regimes.fit_hmm(frame, ["k"], ["t"], "x"), regimes.fit_hmm(frame, ["k"], ["t"], "x", rounds=3)
    assert ll(full) > ll(short) + 1
    one = regimes.Hmm([1.0], [[1.0]], [0.0], [2.0])
    assert regimes.smoothed_counts(one, x)["ll"][0] == pytest.approx((-0.5 * (x / 2) ** 2 - np.log(2)).sum())


def test_tree_dump():
    text = "Tree=0\nsplit_feature=0 1\nthreshold=0.5 2\nleft_child=1 -1\nright_child=-3 -2\nleaf_value=1 2 3\n"
    got = regimes.score_trees(regimes.parse_trees(text), np.array([[0.0, 1.0], [0.0, 3.0], [1.0, 0.0]]))
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([1.0, 2.0, 3.0]))))


def test_dollar_bars_drop_the_open_one(spark):
    df = spark.createDataFrame([("A", i, 10.0, 1) for i in range(25)], "k string, t long, p double, q long")
    assert [(r.bar_id, r.ticks) for r in bars.dollar_bars(df, ["k"], ["t"], "p", "q", 100.0).orderBy("bar_id").collect()] == [(0, 10), (1, 10)]


def test_decay_fit_recovers_rate():
    x = np.arange(10.0)
    a, k = bars.fit_exponential(x, 5 * np.exp(-0.4 * x))
    assert a == pytest.approx(5) and k == pytest.approx(0.4)


def test_save_load_sync_upsert(spark, tmp_path):
    df = spark.createDataFrame([("A", datetime.date(2024, 1, d), 1_700_000_000 + d, float(d)) for d in (1, 2)], "symbol string, date date, ts_sec long, close double")
    root = str(tmp_path / "bars")
    assert tables.sync(df, root) == 2 and tables.sync(df, root) == 0
    assert tables.load(spark, root, ["A"], first="2024-01-02").count() == 1
    up = tables.upsert(spark.createDataFrame([("A", 1.0, 2.0)], "symbol string, g double, k double"), spark.createDataFrame([("A", 5.0), ("B", 7.0)], "symbol string, g double"), "symbol")
    assert {tuple(r) for r in up.collect()} == {("A", 5.0, 2.0), ("B", 7.0, None)}


def test_land_texts(spark):
    xml = "<rss><channel><item><title>T</title><link>L</link><pubDate>2024-01-02 03:04:05</pubDate></item></channel></rss>"
    got = tables.parse_rss(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (got.title, got.published) == ("T", datetime.datetime(2024, 1, 2, 3, 4, 5))
    js = '{"symbol":"A","columns":["Mar 24"],"rows":[{"name":"Sales","cells":["1,234%"]}]}'
    assert tables.parse_fundamentals(spark.createDataFrame([(js,)], "json string")).first().value == 1234.0


def test_concurrency_counts_open_intervals(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 9), ("k", 6, 7)], "k string, a long, b long")
    assert {r.a: r.live for r in windows.concurrency(df, ["k"], "a", "b").collect()} == {0: 1, 3: 2, 5: 2, 6: 2}


def test_open_runs_are_not_counted(spark):
    rows = [("a", i, f) for i, f in enumerate([True, True, False, True, False, True, True, True])]
    got = bars.run_lengths(spark.createDataFrame(rows, "symbol string, ts long, up boolean"), Series(["symbol"], "ts"), ["symbol"], "up").collect()
    assert [(x.runs, x.longest_run, x.median_run) for x in got] == [(2, 2, 1.5)]


def test_shock_recovers_and_ages(spark):
    from microtide.operators import book

    depth = [100, 70, 70, 85, 100, 100]
    rows = [("a", t, 1, *[10.0 - i for i in range(5)], *[11.0 + i for i in range(5)], q, 0, 0, 0, 0, 50, 0, 0, 0, 0) for t, q in enumerate(depth)]
    df = spark.createDataFrame(rows, "symbol string, ts long, is_observed int, " + ", ".join(f"{c} {'double' if c[1] == 'p' else 'long'}" for c in book.BOOK))
    got = book.shock_recovery(df, Series(["symbol"], "ts"), "ts", lookback=4).orderBy("ts").collect()
    assert [x.bid_recovery for x in got] == [None, 0.0, 0.0, 0.5, 1.0, None]
    assert [x.bid_shock_age for x in got] == [None, 0, 1, 2, 3, None] and all(x.ask_recovery is None for x in got)
    assert df.where(book.valid_book()).count() == len(depth)
