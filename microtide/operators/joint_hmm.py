"""Hidden Markov regimes of update counts and returns: categorical times zero-inflated Gaussian emissions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-300


@dataclass
class JointHmm:
    """start (K), transition (K, K), q (K, C): P(count category), zero (K, C): P(return 0 | category), sigma (K) of other returns.

    States are in order of activity, the one with most updates (least P(category 0)) first.
    """

    start: list
    transition: list
    q: list
    zero: list
    sigma: list

    def save(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> JointHmm:
        return cls(**json.loads(text))

    def log_emissions(self, counts: np.ndarray, returns: np.ndarray) -> np.ndarray:
        """Per row and state; a missing return says nothing beyond its count."""
        q, zero, sigma = np.array(self.q), np.array(self.zero), np.maximum(np.array(self.sigma), 1e-12)
        out = np.log(np.maximum(q[:, counts].T, TINY))
        still, moved = returns == 0, np.isfinite(returns) & (returns != 0)
        out[still] += np.log(np.maximum(zero[:, counts[still]].T, TINY))
        x = returns[moved, None] / sigma
        out[moved] += np.log(np.maximum(1 - zero[:, counts[moved]].T, TINY)) - np.log(sigma) - 0.5 * np.log(2 * np.pi) - 0.5 * x * x
        return out

    def scaled(self, counts: np.ndarray, returns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        log_b = self.log_emissions(counts, returns)
        top = log_b.max(1, keepdims=True)
        return np.exp(log_b - top), top[:, 0]


def filtered(model: JointHmm, counts: np.ndarray, returns: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """P(state | past and present) per row; ``prior`` is that of the first row, else the model's start."""
    b, _ = model.scaled(counts, returns)
    a, out = np.array(model.transition), np.empty((len(counts), len(model.start)))
    p = np.array(model.start) if prior is None else prior
    for t in range(len(b)):
        v = np.maximum(p, TINY) * b[t]
        out[t] = v / v.sum()
        p = out[t] @ a
    return out


def expected(model: JointHmm, counts: np.ndarray, returns: np.ndarray) -> dict[str, np.ndarray]:
    """Baum-Welch statistics of one sequence, additive over sequences."""
    (b, top), a, s = model.scaled(counts, returns), np.array(model.transition), np.array(model.start)
    n, k = b.shape
    f, r, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        f[t] = (s if t == 0 else f[t - 1] @ a) * b[t]
        c[t] = max(f[t].sum(), TINY)
        f[t] /= c[t]
    for t in range(n - 2, -1, -1):
        r[t] = a @ (b[t + 1] * r[t + 1]) / c[t + 1]
    g = f * r
    g /= np.maximum(g.sum(1, keepdims=True), TINY)
    xi = np.einsum("ti,tj->ij", f[:-1], b[1:] * r[1:] / c[1:, None]) * a if n > 1 else np.zeros((k, k))
    cats = len(model.q[0])
    still, moved = returns == 0, np.isfinite(returns) & (returns != 0)
    by = lambda rows: np.stack([np.bincount(counts[rows], g[rows, j], cats) for j in range(k)])
    return {"start": g[0], "xi": xi, "n": by(np.ones(n, bool)), "zero": by(still), "seen": by(still | moved), "moved": g[moved].sum(0), "xx": (g[moved] * returns[moved, None] ** 2).sum(0), "ll": np.array([np.log(c).sum() + top.sum()])}


def fit(df: DataFrame, keys: list[str], order: list[str], count: str, ret: str, k: int = 4, categories: int = 4, starts: int = 3, rounds: int = 60, tol: float = 1e-6, seed: int = 42) -> JointHmm:
    """The model of the greatest likelihood of several seeded starts; one grouped E-step per round serves all that still move.

    ``count`` is a category 0..categories-1, category 0 having only zero returns. Sequences are
    the keys' rows in order; rows without a count are left out.
    """
    rng = np.random.default_rng(seed)
    rows = df.where(F.col(count).isNotNull()).select(*keys, *order, F.col(count).cast("int").alias("__c"), F.col(ret).cast("double").alias("__r"))
    # Read again in every round; dealt by key once, so that a round shuffles nothing but its sums.
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys).persist()
    base = {r["__c"]: r for r in rows.groupBy("__c").agg(F.avg((F.col("__r") == 0).cast("double")).alias("z")).collect()}
    spread = rows.where("__r != 0 and not isnan(__r)").agg(F.stddev_pop("__r").alias("s")).first()["s"] or 1.0
    moving = {}
    for m in range(starts):
        q = rng.dirichlet(np.full(categories, 2.0), k)
        q[np.arange(k), np.linspace(0, categories - 1, k).astype(int)] += 2
        zero = np.clip([[base[c]["z"] if c in base and base[c]["z"] is not None else 0.5 for c in range(categories)]] + rng.normal(0, 0.09, (k, categories)), 0.01, 0.999)
        zero[:, 0] = 1.0
        stay = np.full((k, k), 0.12 / max(k - 1, 1)) + np.eye(k) * (0.88 - 0.12 / max(k - 1, 1))
        moving[m] = JointHmm([1 / k] * k, stay.tolist(), (q / q.sum(1, keepdims=True)).tolist(), zero.tolist(), (max(spread, 1e-6) * np.exp(rng.normal(0, 0.35, k))).tolist())

    def statistics(now: dict[int, JointHmm]):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(order)
            c, r = frame["__c"].to_numpy(int), frame["__r"].to_numpy(float)
            flat = [(m, name, i, float(v)) for m, model in now.items() for name, a in expected(model, c, r).items() for i, v in enumerate(np.ravel(a))]
            return pd.DataFrame(flat, columns=["m", "stat", "i", "v"])

        return run

    done: dict[int, tuple[float, JointHmm]] = {}
    for step in range(rounds + 1):
        if not moving:
            break
        sums = rows.groupBy(*keys).applyInPandas(statistics(dict(moving)), "m int, stat string, i int, v double").groupBy("m", "stat", "i").agg(F.sum("v").alias("v")).collect()
        for m, model in list(moving.items()):
            s: dict[str, np.ndarray] = {}
            for name in ("start", "xi", "n", "zero", "seen", "moved", "xx", "ll"):
                got = sorted((r["i"], r["v"]) for r in sums if r["m"] == m and r["stat"] == name)
                s[name] = np.array([v for _, v in got])
            ll, before = float(s["ll"][0]), done.get(m)
            if before is None or ll > before[0]:
                done[m] = (ll, model)
            if step == rounds or before is not None and abs(ll - before[0]) < tol * (1 + abs(ll)):
                del moving[m]
                continue
            n, zero, seen, xi = (s[x].reshape(k, -1) for x in ("n", "zero", "seen", "xi"))
            p = (zero + 0.1) / (seen + 0.2)
            p[:, 0] = 1.0
            moving[m] = JointHmm(
                list((s["start"] + 1e-3) / (s["start"].sum() + k * 1e-3)), ((xi + 1e-3) / (xi.sum(1, keepdims=True) + k * 1e-3)).tolist(),
                ((n + 0.01) / (n.sum(1, keepdims=True) + 0.01 * categories)).tolist(), p.tolist(), np.sqrt(np.maximum(s["xx"] / np.maximum(s["moved"], 1e-12), 1e-8)).tolist(),
            )
    rows.unpersist()
    best = max(done.values(), key=lambda d: d[0])[1]
    by = np.argsort(np.array(best.q)[:, 0], kind="stable")
    return JointHmm(list(np.array(best.start)[by]), np.array(best.transition)[np.ix_(by, by)].tolist(), np.array(best.q)[by].tolist(), np.array(best.zero)[by].tolist(), list(np.array(best.sigma)[by]))


def apply(df: DataFrame, model: JointHmm, keys: list[str], ts: str, count: str, ret: str, width: int) -> DataFrame:
    """(keys, ts, state from 1, p_state) by filtering, each key's rows in order of ``ts``.

    A key's sequence is cut into segments of ``width`` units of ts. What a segment makes of the
    state before it is a K x K matrix; these are multiplied along a key, which are few rows, and
    every segment is filtered on its own from the state that reaches it. No task reads a whole
    sequence. Rows without a count have a null state and are passed over.
    """
    kinds, k = dict(df.dtypes), len(model.start)
    key_schema = ", ".join(f"{c} {kinds[c]}" for c in keys)
    rows = df.select(*keys, ts, F.col(count).cast("int").alias("__c"), F.col(ret).cast("double").alias("__r")).withColumn("__seg", F.floor(F.col(ts) / width))
    live = rows.where("__c is not null")

    def matrix(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts)
        b, _ = model.scaled(frame["__c"].to_numpy(int), frame["__r"].to_numpy(float))
        a, m = np.array(model.transition), np.diag(b[0])
        for e in b[1:]:
            m = m @ a * e
            m = m / m.sum()
        return pd.DataFrame([[*(frame[c].iloc[0] for c in keys), frame["__seg"].iloc[0], m.ravel().tolist()]], columns=[*keys, "__seg", "m"])

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        a, prior, out = np.array(model.transition), np.array(model.start), []
        for row, m in zip(frame.sort_values("__seg").to_dict("records"), frame.sort_values("__seg")["m"], strict=True):
            out.append([*(row[c] for c in keys), row["__seg"], prior.tolist()])
            v = prior @ np.asarray(m, float).reshape(k, k)
            prior = v / v.sum() @ a
        return pd.DataFrame(out, columns=[*keys, "__seg", "prior"])

    def run(part: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ts)
        state, p = np.full(len(part), None, object), np.full(len(part), np.nan)
        ok = part["__c"].notna().to_numpy()
        if ok.any():
            f = filtered(model, part["__c"].to_numpy(float)[ok].astype(int), part["__r"].to_numpy(float)[ok], np.asarray(prior["prior"].iloc[0], float))
            state[ok], p[ok] = f.argmax(1) + 1, f.max(1)
        return part[[*keys, ts]].assign(state=pd.array(state, "Int32"), p_state=p)

    made = live.groupBy(*keys, "__seg").applyInPandas(matrix, f"{key_schema}, __seg long, m array<double>")
    priors = made.groupBy(*keys).applyInPandas(along, f"{key_schema}, __seg long, prior array<double>")
    by = [*keys, "__seg"]
    return rows.groupBy(*by).cogroup(priors.groupBy(*by)).applyInPandas(run, f"{key_schema}, {ts} {kinds[ts]}, state int, p_state double")
