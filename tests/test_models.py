"""Joint-emission regimes, label weights and feature importance against loops and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from microtide.operators import importance, joint_hmm


def planted(seed=1, n=1200):
    """Two regimes: a still one with few updates, and a busy one with large returns."""
    r = np.random.default_rng(seed)
    model = joint_hmm.JointHmm([0.5, 0.5], [[0.95, 0.05], [0.03, 0.97]], [[0.05, 0.15, 0.3, 0.5], [0.6, 0.3, 0.08, 0.02]], [[1, 0.3, 0.2, 0.1], [1, 0.9, 0.8, 0.7]], [2.0, 0.5])
    z, rows, states = 0, [], []
    for t in range(n):
        z = int(r.random() > model.transition[z][0]) if t else 0
        c = int(r.choice(4, p=model.q[z]))
        x = 0.0 if r.random() < model.zero[z][c] else float(r.normal(0, model.sigma[z]))
        rows.append((c, x))
        states.append(z)
    return model, rows, states


def test_fit_recovers_planted_regimes(spark):
    model, rows, states = planted()
    df = spark.createDataFrame([("a" if t < 600 else "b", t, c, x) for t, (c, x) in enumerate(rows)], "k string, t int, c int, x double")
    got = joint_hmm.fit(df, ["k"], ["t"], "c", "x", k=2, starts=2, rounds=25)
    assert np.allclose(got.q, model.q, atol=0.08) and np.allclose(got.sigma, model.sigma, rtol=0.2)
    assert np.allclose(got.transition, model.transition, atol=0.06) and got.zero[0][0] == got.zero[1][0] == 1
    assert joint_hmm.JointHmm.load(got.save()) == got
    out = joint_hmm.apply(df, got, ["k"], "t", "c", "x", 97).orderBy("t").collect()
    assert np.mean([o.state - 1 == z for o, z in zip(out, states)]) > 0.9


def test_segments_filter_like_the_loop(spark):
    model, rows, _ = planted(2, 300)
    data = [("a", t, c, None if t % 50 == 0 else x) for t, (c, x) in enumerate(rows)] + [("b", 5, 3, 1.0), ("b", 9, None, 1.0), ("c", 1, None, None)]
    df = spark.createDataFrame(data, "k string, t long, c int, x double")
    got = {(o.k, o.t): o for o in joint_hmm.apply(df, model, ["k"], "t", "c", "x", 40).collect()}
    assert len(got) == len(data) and got["b", 9].state is None and got["c", 1].state is None
    a, p = np.array(model.transition), None
    for t, (c, x) in enumerate(rows):
        prior = np.array(model.start) if p is None else p @ a
        e = np.array([model.q[j][c] for j in (0, 1)])
        if t % 50:
            e = e * [model.zero[j][c] if x == 0 else (1 - model.zero[j][c]) * np.exp(-0.5 * (x / model.sigma[j]) ** 2) / (model.sigma[j] * np.sqrt(2 * np.pi)) for j in (0, 1)]
        p = prior * e / (prior * e).sum()
        assert np.isclose(got["a", t].p_state, p.max(), rtol=1e-9) and got["a", t].state == p.argmax() + 1


def test_expected_statistics_are_those_of_all_paths():
    import itertools

    model, rows, _ = planted(3, 6)
    c, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    e = np.exp(model.log_emissions(c, x))
    weight = {}
    for path in itertools.product((0, 1), repeat=6):
        w = model.start[path[0]] * e[0, path[0]]
        for t in range(1, 6):
            w *= model.transition[path[t - 1]][path[t]] * e[t, path[t]]
        weight[path] = w
    total = sum(weight.values())
    got = joint_hmm.expected(model, c, x)
    assert np.isclose(got["ll"][0], np.log(total))
    for i, j in itertools.product((0, 1), repeat=2):
        assert np.isclose(got["xi"][i, j], sum(w * sum(p[t - 1] == i and p[t] == j for t in range(1, 6)) for p, w in weight.items()) / total)


def test_uniqueness_equals_the_loop(spark):
    r = np.random.default_rng(4)
    bars = [(k, t) for k in "ab" for t in range(0, 60, 2)]
    labels = [(k, i, int(s) * 2, int(min(58, s * 2 + 2 * d))) for k in "ab" for i, (s, d) in enumerate(zip(r.integers(0, 30, 25), r.integers(0, 6, 25)))]
    got = importance.uniqueness(spark.createDataFrame(labels, "k string, i int, s int, e int"), spark.createDataFrame(bars, "k string, t int"), ["k"], "t", "s", "e").collect()
    assert len(got) == len(labels)
    for g in got:
        inside = [t for k, t in bars if k == g.k and g.s <= t <= g.e]
        want = np.mean([1 / sum(k == g.k and s <= t <= e for k, _, s, e in labels) for t in inside])
        assert np.isclose(g.uniqueness, want)


def test_informative_column_is_first_in_all_three(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (400, 3))
    rows = [(i, *map(float, v), float(v[1] + 0.3 * r.normal() > 0), 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double, w double")
    folds = [(~F.col("i").between(lo - 10, lo + 209), F.col("i").between(lo, lo + 199)) for lo in (0, 200)]
    got = {g.feature: g for g in importance.importance(df, ["a", "b", "c"], "y", "i", folds, "w", trees=5, depth=3).collect()}
    for how in ("mdi", "mda", "sfi"):
        assert max(got, key=lambda f: got[f][how]) == "b", how
    assert got["b"].sfi > 0.8 and abs(sum(g.mdi for g in got.values()) - 1) < 1e-9


def test_permuted_column_has_the_same_values(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "i int, x double")
    got = importance.permuted(df, "x", "i", 3, rows_per_task=40).collect()
    assert sorted(g.x for g in got) == [float(i) for i in range(200)] and sum(g.x == g.i for g in got) < 10
    with pytest.raises(AssertionError):
        assert [g.x for g in sorted(got)] == [float(i) for i in range(200)]
