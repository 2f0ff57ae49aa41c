"""Streams in several micro-batches, with restarts and late rows, against batch windows and plain loops."""

import datetime
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from microtide.streaming import bars, state


def write(spark, folder, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in-{n:03d}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def drain(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}-out")


BAR = "symbol string, i int, mid double, vwap double, oi double, realized_vol_10s double, realized_vol_60s double, realized_vol_300s double, total_bid_qty double, total_ask_qty double, " + ", ".join(f"{s}_q{k} double" for s in ("bid", "ask") for k in range(1, 6))


def some_bars(n, seed):
    r = random.Random(seed)
    mid, out = 100.0, []
    for i in range(n):
        mid = max(1.0, mid + r.choice([-0.5, 0, 0, 0.5]))
        odd = r.random()
        out.append((f"s{seed}", i, None if odd < 0.02 else mid, 0.0 if odd > 0.98 else mid - r.random(), float(r.randint(10**6, 10**6 + 500)), r.uniform(0, 3), r.uniform(0, 3), None if odd < 0.03 else r.uniform(0, 3), float(r.randint(0, 9)), float(r.randint(0, 9)), *[float(r.randint(0, 50)) for _ in range(10)]))
    return out


def plain(rows):
    """Each feature from the whole history of a symbol, by numpy over slices."""
    names = [c.split()[0] for c in BAR.split(", ")]
    out, mids = [], []
    bad = lambda v, d: d if v is None or not np.isfinite(v) else v
    rets, ups, v60, v300, oi = [], [], [], [], []
    ac, before = 0.0, ([0.0] * 5, [0.0] * 5)
    for i, row in enumerate(rows):
        b = dict(zip(names, row))
        mid = bad(b["mid"], 0) if bad(b["mid"], 0) > 0 else (mids[-1] if mids else 1.0)
        rets.append((mid - mids[-1]) / mids[-1] if mids else 0.0)
        mids.append(mid)
        ups.append(float(rets[-1] > 0))
        v60.append(max(bad(b["realized_vol_60s"], 2.0), 0.001))
        v300.append(max(bad(b["realized_vol_300s"], 2.0), 0.001))
        oi.append(b["oi"])
        sd = lambda x: 1.0 if len(x[-300:]) < 5 else max(np.std(x[-300:]), 1e-8)
        if i >= 59 and i % 10 == 0:
            x, y = np.array(rets[-60:-1]), np.array(rets[-59:])
            if x.std() > 1e-10 and y.std() > 1e-10:
                ac = np.corrcoef(x, y)[0, 1]
        bid, ask = ([b[f"{s}_q{k}"] for k in range(1, 6)] for s in ("bid", "ask"))
        w = np.array(state.LEVEL_WEIGHTS)
        wb, wa = w @ bid, w @ ask
        vwap = b["vwap"] if b["vwap"] > 0 else mid
        out.append((
            (wb - wa) / max(wb + wa, 1e-8), w @ (np.array(bid) - before[0] - ask + before[1]),
            (np.mean(ups[-60:]) - 0.5) / max(sd(ups), 0.01) if i >= 29 else 0.0, ac, np.mean(v60[-60:]) / max(np.mean(v300[-300:]), 0.01),
            np.log(max(b["total_bid_qty"], 1e-8) / max(b["total_ask_qty"], 1e-8)), (mid - vwap) / vwap, max(bad(b["realized_vol_10s"], 2.0), 0.001) / v60[-1],
            (oi[-1] - oi[-2]) / sd(oi) if i else 0.0,
        ))
        before = (np.array(bid), np.array(ask))
    return np.array(out)


def test_features_over_batches_and_a_restart(spark, tmp_path):
    folder = str(tmp_path / "bars")
    rows = {f"s{k}": some_bars(700, k) for k in (1, 2)}
    cuts = [0, 150, 430, 700]
    with state.with_rocksdb(spark):
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            write(spark, folder, [x for r in rows.values() for x in r[a:b]], BAR, n)
            # A new query from the same checkpoint takes up each file.
            got = drain(state.feature_stream(source(spark, folder, BAR), "symbol", ["i"]), folder)
    table = got.orderBy("symbol", "i").collect()
    assert len(table) == 1400
    for k in rows:
        mine = np.array([x[2:] for x in table if x.symbol == k], float)
        assert np.allclose(mine, plain(rows[k]), rtol=1e-9, atol=1e-9)


def test_feature_state_is_bounded():
    now = state.Features()
    names = [c.split()[0] for c in BAR.split(", ")]
    for row in some_bars(2000, 5):
        now.update(dict(zip(names, row)))
    assert [len(r) for r in now.rings.values()] == list(state.RINGS.values())
    again = state.Features(now.saved())
    nxt = dict(zip(names, some_bars(1, 6)[0]))
    assert np.allclose(again.update(nxt), now.update(nxt), rtol=1e-9)


SIGNAL = "symbol string, ts timestamp, action string, pause_until timestamp"
AT = lambda m, s=0: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m, seconds=s)


def test_signals_go_stale_after_their_time(spark, tmp_path):
    folder = str(tmp_path / "signals")
    batches = [
        [("A", AT(0), "WIDEN", None), ("B", AT(1), "PAUSE", AT(5)), ("C", AT(1), "AVOID", None), ("D", AT(0), "NORMAL", None)],
        [("A", AT(10), "NORMAL", None), ("D", AT(20), "PAUSE", AT(19))],  # A again in time; D's first has gone stale by then
        [("E", AT(40), "NORMAL", None)],  # moves time on: A, B, C, D go stale by their timers
        [("A", AT(41), "WIDEN", None)],
    ]
    got = []
    with state.with_rocksdb(spark):
        for n, b in enumerate(batches):
            write(spark, folder, b, SIGNAL, n)
            got = drain(state.cached_signals(source(spark, folder, SIGNAL), "symbol", "ts"), folder)
    seen = {(x.symbol, x["at"], x.state) for x in got.collect()}
    assert seen == {
        ("A", AT(0), "widened"), ("B", AT(1), "paused"), ("C", AT(1), "paused"), ("D", AT(0), "normal"),
        ("A", AT(10), "normal"), ("D", AT(15), "stale"), ("D", AT(20), "normal"),
        ("E", AT(40), "normal"), ("A", AT(25), "stale"), ("B", AT(16), "stale"), ("C", AT(16), "stale"), ("D", AT(35), "stale"), ("A", AT(41), "widened"),
    }
    assert got.count() == len(seen)


TICK = "symbol string, at timestamp, price double, qty long"


def test_bars_take_late_ticks_until_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "ticks")
    write(spark, folder, [("A", AT(0, 1), 10.0, 1), ("A", AT(0, 3), 12.0, 1)], TICK, 0)
    drain(bars.stream_bars(source(spark, folder, TICK), "symbol", "at", "price", "qty", "10 seconds", "30 seconds"), folder)
    write(spark, folder, [("A", AT(0, 25), 20.0, 1)], TICK, 1)
    drain(bars.stream_bars(source(spark, folder, TICK), "symbol", "at", "price", "qty", "10 seconds", "30 seconds"), folder)
    write(spark, folder, [("A", AT(0, 2), 7.0, 5)], TICK, 2)  # late, but within 30 seconds
    got = drain(bars.stream_bars(source(spark, folder, TICK), "symbol", "at", "price", "qty", "10 seconds", "30 seconds"), folder)
    assert got.count() == 0
    write(spark, folder, [("A", AT(2), 30.0, 1)], TICK, 3)  # closes both bars
    got = drain(bars.stream_bars(source(spark, folder, TICK), "symbol", "at", "price", "qty", "10 seconds", "30 seconds"), folder)
    write(spark, folder, [("A", AT(0, 4), 99.0, 9)], TICK, 4)  # too late
    got = drain(bars.stream_bars(source(spark, folder, TICK), "symbol", "at", "price", "qty", "10 seconds", "30 seconds"), folder).orderBy("bar_start").collect()
    assert [(x.open, x.high, x.low, x.close, x.volume, x.tick_count) for x in got] == [(10.0, 12.0, 7.0, 12.0, 7, 3), (20.0, 20.0, 20.0, 20.0, 1, 1)]


def test_rolling_state_is_the_window_of_the_whole(spark, tmp_path):
    folder, schema = str(tmp_path / "roll"), "k string, ts timestamp, x double"
    r = random.Random(1)
    rows = [("a", AT(0, i), r.uniform(1, 2)) for i in range(40)]
    for n in (0, 1):
        write(spark, folder, rows[20 * n : 20 * n + 20], schema, n)
        got = drain(bars.rolling_state(source(spark, folder, schema), "k", "string", "ts", "x", 8), folder)
    got = got.orderBy("ts").collect()
    for i, g in enumerate(got):
        x = [v for *_, v in rows[max(0, i - 7) : i + 1]]
        assert np.isclose(g.mean, np.mean(x)) and (i == 0 and g.std is None or np.isclose(g.std, np.std(x, ddof=1)))
        assert g.momentum is None if i < 7 else np.isclose(g.momentum, x[-1] / x[0] - 1)


def test_duplicates_and_files_of_a_stream(spark, tmp_path):
    folder, schema = str(tmp_path / "news"), "id string, ts timestamp, day string"
    write(spark, folder, [("a", AT(0), "d1"), ("a", AT(1), "d1"), ("b", AT(1), "d1")], schema, 0)
    write(spark, folder, [("a", AT(2), "d1"), ("c", AT(3), "d2")], schema, 1)
    stream = bars.dedupe(source(spark, folder, schema), "ts", ["id"])
    q = bars.flush_to(stream, f"{folder}-flush", f"{folder}-check", ["day"], "1 second")
    q.processAllAvailable()
    q.stop()
    assert sorted(x.id for x in spark.read.parquet(f"{folder}-flush").collect()) == ["a", "b", "c"]
    assert {d for d in os.listdir(f"{folder}-flush") if d.startswith("day=")} == {"day=d1", "day=d2"}


class Held:
    """A value state in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_features_are_given_in_chunks_and_in_order(monkeypatch):
    monkeypatch.setattr(state, "CHUNK", 100)
    names = [c.split()[0] for c in BAR.split(", ")]
    rows = pd.DataFrame(some_bars(450, 5), columns=names)
    mixed = rows.sample(frac=1, random_state=1)
    p = state.FeatureProcessor("symbol", ["i"])
    p.state = Held()
    got = list(p.handleInputRows(("s5",), iter([mixed[:200], mixed[200:]]), None))
    assert [len(f) for f in got] == [100, 100, 100, 100, 50]
    one = state.Features()
    want = [one.update(b) for b in rows[[c for c in state.INPUTS if c in names]].to_dict("records")]
    whole = pd.concat(got)
    assert whole["i"].tolist() == list(range(450)) and set(whole["symbol"]) == {"s5"}
    assert np.allclose(whole[list(state.FEATURES)].to_numpy(float), np.array(want), rtol=0, atol=0) and p.state.value[3] == 450
