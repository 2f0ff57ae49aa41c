"""Whitening on leading components, by Chebyshev-filtered subspace iteration.

The covariance V is never formed. A pass over the rows multiplies it with a block of a few columns:
every task centres its vectors, adds up X'(XQ) and returns one small matrix, and the matrices are
added up by Spark. A polynomial of degree DEGREE in V, by the three-term recurrence of Chebyshev
polynomials, takes as many passes; it stays below one on the unwanted part of the spectrum and
grows fast above it, so the block turns towards the leading eigenvectors. QR and Rayleigh-Ritz
follow, which need no further pass. A Lanczos vector rides along in the passes as one more
column: it bounds the spectrum from below. Rounds end when the residual of every wanted component
certifies it; where residuals stall, the block grows, in the end to the whole space.

What comes to the driver is a few columns per pass, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.llm.common import materialize, release, table
from microtide.llm.hard_negatives import _matrix, quantized, usable

COMPONENTS = 8
#: Columns of the block besides the wanted ones.
GUARD = 24
DEGREE = 8
ROUNDS = 40
#: A component is certified by a residual of at most this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Below this share a residual that no longer halves has met rounding.
ROUNDING = 1e-11
#: Eigenvalues below this share of the trace are rounding: such components don't exist.
NOTHING = 1e-13
LOW = 26


class _Centre:
    """n and the exact sums per dimension, with differences from the mean of integer rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles: the integer part is subtracted in integers."""
        return (x - self.whole).astype(float) - np.array(self.rest, float) / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)^2, in exact integers; beyond a long it saturates."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        y = (y if most * most * len(self.sums) < 2**62 else y.astype(object)) * self.n - np.array(self.rest, y.dtype if most < 2**62 else object)
        total = (y * y).sum(1)
        return total if total.dtype == np.int64 else np.array([min(int(t), 2**63 - 1) for t in total], np.int64)


def _added(rows: DataFrame, columns: int, part) -> np.ndarray:
    """The sum over all batches of ``part``, a function from integer vectors to a matrix of so many columns.

    A task returns its sum as one row per line of the matrix.
    """
    names = [f"c{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + part(_matrix(batch.column("x")))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T)], ["i", *names])

    sums = rows.select("x").mapInArrow(run, ", ".join(["i long", *[f"{c} double" for c in names]]))
    return np.array([r[1:] for r in sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()])


def _centre(rows: DataFrame) -> _Centre:
    """Exact sums: high and low bits apart, as integers below 2^53 in doubles per batch, as longs over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                high, low = x >> LOW, x & ((1 << LOW) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], len(x))), pa.array(high.sum(0)), pa.array(low.sum(0))], ["i", "n", "high", "low"])

    made = rows.select("x").mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    return _Centre(made[0]["n"], [(r["high"] << LOW) + r["low"] for r in made])


def _eigen(rows: DataFrame, centre: _Centre, wanted: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(eigenvalues, eigenvectors as columns, trace, largest residual) of the covariance's leading components."""
    n, d = centre.n, len(centre.sums)
    draw = np.random.default_rng(11)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = centre.centred(x)
            return c.T @ (c @ q)

        return _added(rows, q.shape[1], part) / n

    def ritz(q: np.ndarray, aq: np.ndarray):
        t = q.T @ aq
        e, u = np.linalg.eigh((t + t.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        v, av = q @ u, aq @ u
        return e, v, av, np.linalg.norm(av - v * e, axis=0)

    trace = float(_added(rows, 1, lambda x: (centre.centred(x) ** 2).sum(0)[:, None])[:, 0].sum() / n)
    k = min(d, wanted + GUARD)
    v = np.linalg.qr(draw.standard_normal((d, k)))[0]
    theta, v, av, residual = ritz(v, times(v))
    lanczos = _Lanczos(draw.standard_normal(d))
    before = np.inf
    for _ in range(ROUNDS):
        worst = residual[:wanted].max()
        if k == d or worst <= TOLERANCE * theta[0] or (worst <= ROUNDING * theta[0] and worst > before / 2):
            break
        if worst > before / 2:
            k = min(d, 2 * k)
            v = np.linalg.qr(np.hstack([v, draw.standard_normal((d, k - v.shape[1]))]))[0]
            theta, v, av, residual = ritz(v, times(v))
            before = np.inf
            continue
        before = worst
        # The recurrence for polynomials of V mapped so that [low, high] becomes [-1, 1], scaled to one at theta[0].
        low, high = lanczos.low, theta[-1]
        centre_, half = (high + low) / 2, max((high - low) / 2, 1e-300)
        sigma = first = half / (theta[0] - centre_)
        y0, y1 = v, (av - centre_ * v) * (first / half)
        for _ in range(DEGREE - 1):
            out = times(np.hstack([y1, lanczos.vector]))
            lanczos.step(out[:, -1:])
            following = 1 / (2 / first - sigma)
            y0, y1 = y1, (out[:, :-1] - centre_ * y1) * (2 * following / half) - y0 * (sigma * following)
            sigma = following
        q = np.linalg.qr(y1)[0]
        theta, v, av, residual = ritz(q, times(q))
    else:
        raise RuntimeError(f"components aren't certified after {ROUNDS} rounds: residual {residual[:wanted].max()} of {theta[0]}")
    v = v[:, :wanted]
    signs = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return theta[:wanted], v * signs, trace, float(residual[:wanted].max())


class _Lanczos:
    """Steps from one start vector, orthogonal to all before; ``low`` bounds the spectrum from below, 0 until steps tell more."""

    def __init__(self, start: np.ndarray):
        self.basis = (start / np.linalg.norm(start))[:, None]
        self.low, self.alpha, self.beta = 0.0, [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[:, -1:]

    def step(self, av: np.ndarray) -> None:
        if len(self.alpha) == self.basis.shape[1]:
            return  # The space of the start vector is exhausted.
        self.alpha.append(float(self.vector[:, 0] @ av[:, 0]))
        w = av
        for _ in range(2):
            w = w - self.basis @ (self.basis.T @ w)
        rest = float(np.linalg.norm(w))
        if len(self.alpha) >= 4:
            t = np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1)
            self.low = max(0.0, float(np.linalg.eigvalsh(t)[0]) - rest)
        if rest > 1e-10 * abs(self.alpha[0]) and self.basis.shape[1] < len(w):
            self.basis = np.hstack([self.basis, w / rest])
            self.beta.append(rest)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row of ``rows`` (vec_id, x array<long>) and component.

    Components are unit eigenvectors of the covariance (divisor n), numbered from 1 by falling
    eigenvalue, their largest entry positive; whitened is the centred vector's projection over the
    root of the eigenvalue. Repeated rows count and are returned each, a null vec_id is kept.
    All vectors must have one length: of several, the rows of the most frequent one (of ties, the
    longest) take part. Components without variance, and those beyond the number of dimensions,
    don't exist and have no rows; an empty table gives none.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col("vec_id").cast("long"), "x").where("size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    kept = materialize(rows.where(F.size("x") == sizes["d"]))
    centre = _centre(kept)
    e, v, trace, _ = _eigen(kept, centre, min(components, sizes["d"]))
    there = e > NOTHING * trace if trace > 0 else e > np.inf
    e, v = e[there], v[:, there]
    if not len(e):
        release(kept)
        return spark.createDataFrame([], schema)
    project = v / np.sqrt(e)

    def moments(x):
        z = np.hstack([np.ones((len(x), 1)), centre.centred(x) @ project])
        return z.T @ z

    m = _added(kept, len(e) + 1, moments) / centre.n
    error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(e))).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            z = centre.centred(x) @ project
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, centre.n)),
                pa.array(np.repeat(centre.deviation(x), k)), pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    return whiten(got.select("vec_id", F.transform(quantized(F.col("embedding"), 1024.0), lambda x: x + 100000).alias("x")))
