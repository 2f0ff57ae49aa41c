"""Regimes and models: hidden Markov filter and fit, ridge, trees, principal components."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Hmm:
    """Gaussian emissions: start (K), transition (K, K), mean (K), sd (K); states in order of sd."""

    start: list
    transition: list
    mean: list
    sd: list

    def save(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Hmm:
        return cls(**json.loads(text))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Densities per row and state, up to a factor per row."""
        return self.scaled(x)[0]

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The emissions, and the logarithm of each row's factor without that of the root of 2 pi."""
        mean, sd = np.array(self.mean), np.maximum(np.array(self.sd), 1e-9)
        log_p = -0.5 * ((x[:, None] - mean) / sd) ** 2 - np.log(sd)
        log_p = np.where(np.isfinite(log_p), log_p, 0.0)  # a missing value says nothing
        top = log_p.max(1, keepdims=True)
        return np.maximum(np.exp(log_p - top), 1e-300), top[:, 0]


def filtered(model: Hmm, x: np.ndarray) -> np.ndarray:
    """P(state | past and present) per row: uses nothing ahead."""
    e, a = model.emissions(x), np.array(model.transition)
    out, p = np.empty_like(e), np.array(model.start)
    for t in range(len(x)):
        prior = p if t == 0 else p @ a
        p = prior * e[t]
        p = p / p.sum()
        out[t] = p
    return out


def smoothed_counts(model: Hmm, x: np.ndarray) -> dict[str, np.ndarray]:
    """Expected statistics of one sequence for Baum-Welch, additive over sequences."""
    (e, factor), a, s = model.scaled(x), np.array(model.transition), np.array(model.start)
    n, k = e.shape
    f, b, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        f[t] = (s if t == 0 else f[t - 1] @ a) * e[t]
        c[t] = f[t].sum()
        f[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = a @ (e[t + 1] * b[t + 1]) / c[t + 1]
    g = f * b
    xi = sum((np.outer(f[t], e[t + 1] * b[t + 1] / c[t + 1]) * a for t in range(n - 1)), np.zeros((k, k)))
    ok = np.isfinite(x)
    return {"start": g[0], "xi": xi, "n": g[ok].sum(0), "x": (g[ok] * x[ok, None]).sum(0), "xx": (g[ok] * x[ok, None] ** 2).sum(0), "ll": np.array([np.log(c).sum() + factor.sum()])}


def apply_hmm(df: DataFrame, model: Hmm, keys: list[str], order: list[str], x: str) -> DataFrame:
    """State and its probability on every row; each key (symbol, date) starts anew."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *order]) + ", state int, p_state double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        p = filtered(model, frame[x].to_numpy(float))
        return frame[[*keys, *order]].assign(state=p.argmax(1).astype(np.int32), p_state=p.max(1))

    return df.select(*keys, *order, x).groupBy(*keys).applyInPandas(run, schema)


def fit_hmm(df: DataFrame, keys: list[str], order: list[str], x: str, k: int = 3, rounds: int = 70, starts: int = 3, tol: float = 1e-6, seed: int = 42) -> Hmm:
    """Baum-Welch from several seeded starts: the model of the greatest log-likelihood.

    Each start ends when its log-likelihood, summed over all sequences, changes by less than
    ``tol`` of itself, or after ``rounds`` steps. One grouped E-step per round serves all starts
    that are still moving; Spark adds up its statistics (K + K * K numbers each).
    """
    rng = np.random.default_rng(seed)
    levels = [[(i + 0.5) / k for i in range(k)]] + [sorted(rng.uniform(0.02, 0.98, k).tolist()) for _ in range(starts - 1)]
    # Read again in every round; dealt by key once, so that a round shuffles nothing but its sums.
    rows = df.select(*keys, *order, x).repartition(df.sparkSession.sparkContext.defaultParallelism, *keys).persist()
    q = rows.select(F.percentile(x, F.array(*[F.lit(v) for at in levels for v in at])).alias("q"), F.stddev_pop(x).alias("s")).first()
    stay = (np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))).tolist()
    spread = [np.ones(k)] + [rng.uniform(0.3, 3.0, k) for _ in range(starts - 1)]
    moving = {m: Hmm([1 / k] * k, stay, list(q["q"][m * k : (m + 1) * k]), np.maximum(q["s"] / k * spread[m], 1e-6).tolist()) for m in range(starts)}

    def expect(now: dict[int, Hmm]):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            values = frame.sort_values(order)[x].to_numpy(float)
            flat = [(m, n, i, float(v)) for m, model in now.items() for n, a in smoothed_counts(model, values).items() for i, v in enumerate(np.ravel(a))]
            return pd.DataFrame(flat, columns=["m", "stat", "i", "v"])

        return run

    done: dict[int, tuple[float, Hmm]] = {}  # log-likelihood and the model that has it
    for step in range(rounds + 1):
        if not moving:
            break
        sums = rows.groupBy(*keys).applyInPandas(expect(dict(moving)), "m int, stat string, i int, v double").groupBy("m", "stat", "i").agg(F.sum("v").alias("v")).collect()
        sums.sort(key=lambda r: (r["m"], r["stat"], r["i"]))  # K + K * K numbers or so of each start
        for m, model in list(moving.items()):
            s = {n: np.array([r["v"] for r in sums if r["m"] == m and r["stat"] == n]) for n in ("start", "xi", "n", "x", "xx", "ll")}
            ll, before = float(s["ll"][0]), done.get(m)
            if before is None or ll > before[0]:
                done[m] = (ll, model)
            if step == rounds or before is not None and abs(ll - before[0]) < tol * (1 + abs(ll)):
                del moving[m]
                continue
            xi = s["xi"].reshape(k, k) + 1e-6
            mean = s["x"] / np.maximum(s["n"], 1e-9)
            var = np.maximum(s["xx"] / np.maximum(s["n"], 1e-9) - mean * mean, 1e-12)
            moving[m] = Hmm(list(s["start"] / s["start"].sum()), (xi / xi.sum(1, keepdims=True)).tolist(), list(mean), list(np.sqrt(var)))
    rows.unpersist()
    model = max(done.values(), key=lambda d: d[0])[1]
    by = np.argsort(model.sd, kind="stable")
    return Hmm(list(np.array(model.start)[by]), np.array(model.transition)[np.ix_(by, by)].tolist(), list(np.array(model.mean)[by]), list(np.array(model.sd)[by]))


def assemble(df: DataFrame, columns: list[str], out: str = "features", scale: bool = False) -> DataFrame:
    df = VectorAssembler(inputCols=columns, outputCol=out if not scale else f"{out}_raw", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=True).fit(df).transform(df).drop(f"{out}_raw") if scale else df


def ridge(df: DataFrame, columns: list[str], y: str, penalty: float = 1.0) -> LinearRegression:
    data = assemble(df, columns, scale=True)
    return LinearRegression(featuresCol="features", labelCol=y, regParam=penalty, elasticNetParam=0.0).fit(data)


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[list[list[float]], list[float]]:
    """Loadings and explained shares."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(assemble(df, columns, scale=True))
    return model.pc.toArray().tolist(), model.explainedVariance.toArray().tolist()


def denoised_correlation(df: DataFrame, columns: list[str], rows: int) -> tuple[np.ndarray, float]:
    """Correlation matrix with the eigenvalues under the Marchenko-Pastur edge set to their mean, and that edge."""
    c = Correlation.corr(assemble(df, columns), "features").first()[0].toArray()
    values, vectors = np.linalg.eigh(c)
    edge = (1 + np.sqrt(len(columns) / rows)) ** 2
    noise = values < edge
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    out = (vectors * values) @ vectors.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d), float(edge)


def parse_trees(text: str) -> list[dict]:
    """Trees of a gradient-boosting text dump: split features, thresholds, children and leaf values per block of ``key=value`` lines."""
    trees: list[dict] = []
    for line in text.splitlines():
        if line.startswith("Tree="):
            trees.append({})
        elif trees and "=" in line:
            name, value = line.split("=", 1)
            if name in ("split_feature", "left_child", "right_child"):
                trees[-1][name] = np.array(value.split(), int)
            elif name in ("threshold", "leaf_value"):
                trees[-1][name] = np.array(value.split(), float)
    return trees


def score_trees(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Sigmoid of the summed leaves; a negative child c is leaf -c - 1; values up to the threshold go left, missing ones right."""
    total = np.zeros(len(x))
    for t in trees:
        if not len(t.get("split_feature", ())):
            total += t["leaf_value"][0]
            continue
        node = np.zeros(len(x), int)
        while (node >= 0).any():
            live = np.flatnonzero(node >= 0)
            at = node[live]
            left = x[live, t["split_feature"][at]] <= t["threshold"][at]
            node[live] = np.where(left, t["left_child"][at], t["right_child"][at])
        total += t["leaf_value"][-node - 1]
    return 1 / (1 + np.exp(-total))


def score(df: DataFrame, trees: list[dict], columns: list[str], keep: list[str]) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(trees)
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[keep].assign(p=score_trees(model.value, f[columns].to_numpy(float)))

    return df.select(*keep, *[c for c in columns if c not in keep]).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", p double")
