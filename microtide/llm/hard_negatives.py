"""Hard negatives: rows of another label that score close below an anchor's positives.

Vectors are cut into segments of LENGTHS[-1] components, whose means and deviations (roots of the
sums of squared differences from the mean) are stored beside the vector; those of longer segments
follow from them. For two vectors

    |<x, y> - sum_s L mean_s(x) mean_s(y)| <= sum_s dev_s(x) dev_s(y)

by Cauchy and Schwarz in each segment, so a pair's score is bounded by a few numbers. Bounds are
taken from the longest segments to the shortest, each time for the pairs that the one before left;
only what the last one leaves is scored, in exact integers.

All anchors are held against all rows in cells: both sides are dealt over a grid, each side
repeated along the other, and a cell holds about ANCHORS anchors and ROWS rows whatever the
table's size. Cells return their best only, which are merged per anchor. Labels, ids and copies
play no part in the dealing, so none of them makes a cell large.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.llm.common import materialize, release, table

#: Segment lengths from coarse to fine; each divides the one before. The finest is stored.
LENGTHS = (16, 4, 2)
ANCHORS, ROWS = 4096, 32768
#: Rows that are bounded and scored at once in a cell.
TILE = 2048
#: Bounds are widened by this share of the vectors' norms: it covers the stored numbers' 32 bits.
SLACK = 1e-6
#: Components are clipped to +-CLIP; scores beyond a long saturate.
CLIP = 1 << 52
NONE = np.iinfo(np.int64).min
SCHEMA = "row long, vec_id long, label long, vector array<long>, mean array<float>, dev array<float>"


def usable(vector: Column) -> Column:
    """A vector that is there, has components and none that is null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as double, clipped to +-CLIP, as longs."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(CLIP)), F.least(F.lit(float(CLIP)), x.cast("double") * scale))).cast("long"))


def _matrix(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds mean and dev of the finest segments; zeros fill the last segment. Batches hold one dimension."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        lengths = np.diff(t["vector"].combine_chunks().offsets.to_numpy())
        for d in np.unique(lengths):
            part = t.filter(pa.array(lengths == d))
            x = _padded(_matrix(part["vector"]).astype(float))
            seg = x.reshape(len(x), -1, LENGTHS[-1])
            mean = seg.mean(2)
            dev = np.sqrt(((seg - mean[:, :, None]) ** 2).sum(2))
            lists = [pa.array(list(m.astype(np.float32)), pa.list_(pa.float32())) for m in (mean, dev)]
            yield from part.append_column("mean", lists[0]).append_column("dev", lists[1]).to_batches()


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % LENGTHS[0])))


def _levels(mean: np.ndarray, dev: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, means, deviations) per segment length, the longest first, from those of the finest."""
    out, length = [(LENGTHS[-1], mean, dev)], LENGTHS[-1]
    for longer in LENGTHS[-2::-1]:
        k = longer // length
        m = mean.reshape(len(mean), -1, k)
        up = m.mean(2)
        dev = np.sqrt((dev.reshape(len(dev), -1, k) ** 2).sum(2) + length * ((m - up[:, :, None]) ** 2).sum(2))
        mean, length = up, longer
        out.append((length, mean, dev))
    return out[::-1]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows. In doubles where every partial sum is an exact integer there."""
    top = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
    if top < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class _Side:
    """One side of a cell: ids, labels, vectors and the levels of their summaries, in order of id."""

    def __init__(self, t: pa.Table, name: str):
        order = np.argsort(t[name].to_numpy(), kind="stable")
        self.table = t.take(pa.array(order))
        self.ids, self.labels = self.table[name].to_numpy(), self.table["label"].to_numpy()
        self.vectors = _matrix(self.table["vector"])
        norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        self.norms = norms
        self.levels = _levels(*[_matrix(self.table[c]).astype(float) for c in ("mean", "dev")])


def _scored(a: _Side, b: _Side, cols: slice, alive: np.ndarray, least: np.ndarray, most: np.ndarray | None):
    """(rows, columns, scores, alive) of the pairs whose bounds leave a score within least..most possible.

    Each level bounds the pairs of the rows and columns that the one before has left.
    """
    i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    alive = alive[np.ix_(i, j)]
    at = np.arange(cols.start, cols.stop)
    for (length, ma, da), (_, mb, db) in zip(a.levels, b.levels):
        if not alive.size:
            break
        middle, spread = length * (ma[i] @ mb[at[j]].T), da[i] @ db[at[j]].T + SLACK * np.outer(a.norms[i], b.norms[at[j]]) + 1
        alive &= middle + spread >= least[i, None]
        if most is not None:
            alive &= middle - spread <= most[i, None]
        r, c = alive.any(1), alive.any(0)
        i, j, alive = i[r], j[c], alive[np.ix_(r, c)]
    return i, j, _exact(a.vectors[i], b.vectors[at[j]]) if alive.size else np.zeros(alive.shape, np.int64), alive


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row and their ids; of equal ones those that come first."""
    scores = scores.copy()
    top, who, rows = np.full((len(scores), k), NONE), np.zeros((len(scores), k), np.int64), np.arange(len(scores))
    for n in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        top[:, n], who[:, n] = scores[rows, at], ids[rows, at]
        scores[rows, at] = NONE
    return top, who


def _merge(top: np.ndarray, who: np.ndarray, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Puts a tile's scores (NONE: none) of the rows i into their best, of which all ids are smaller or equal."""
    some = np.flatnonzero((scores > top[i, -1:]).any(1))
    i = i[some]
    both = np.hstack([top[i], scores[some]]), np.hstack([who[i], np.broadcast_to(ids, (len(i), len(ids)))])
    top[i], who[i] = _best(*both, top.shape[1])


def _tiles(b: _Side) -> Iterator[slice]:
    for start in range(0, len(b.ids), TILE):
        yield slice(start, min(start + TILE, len(b.ids)))


def _positives(k: int):
    schema = pa.schema([("anchor_row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        a, b = _Side(anchors, "anchor_id"), _Side(rows, "vec_id")
        top, who = np.full((len(a.ids), k), NONE), np.zeros((len(a.ids), k), np.int64)
        for cols in _tiles(b):
            alive = (a.labels[:, None] == b.labels[cols]) & (a.ids[:, None] != b.ids[cols])
            i, j, scores, alive = _scored(a, b, cols, alive, top[:, -1].astype(float), None)
            _merge(top, who, i, np.where(alive, scores, NONE), b.ids[cols][j])
        i, n = np.nonzero(top > NONE)
        return pa.table([a.table["anchor_row"].to_numpy()[i], who[i, n], top[i, n]], schema)

    return run, "anchor_row long, positive_id long, positive_score long"


def _negatives(k: int, low: Fraction, high: Fraction):
    """Per cell, anchor and positive the first k rows of another label with low * p <= score <= high * p."""
    schema = pa.schema([("anchor_row", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    floor = lambda p, f: (p * f.numerator) // f.denominator

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        a, b = _Side(anchors, "anchor_id"), _Side(rows, "vec_id")
        scores = [[int(p) for p in ps] for ps in a.table["scores"].to_pylist()]
        places = max(map(len, scores))
        # A place that an anchor lacks has an empty range.
        least, most = np.full((places, len(a.ids)), -(NONE + 1)), np.full((places, len(a.ids)), NONE + 1)
        for r, ps in enumerate(scores):
            for n, p in enumerate(ps):
                least[n, r], most[n, r] = -floor(-p, low), floor(p, high)
        top, who = np.full((places, len(a.ids), k), NONE), np.zeros((places, len(a.ids), k), np.int64)
        for cols in _tiles(b):
            alive = a.labels[:, None] != b.labels[cols]
            need = np.maximum(least, top[:, :, -1]).astype(float).min(0)
            i, j, found, alive = _scored(a, b, cols, alive, need, most.astype(float).max(0))
            for n in range(places):
                fits = alive & (found >= least[n, i, None]) & (found <= most[n, i, None])
                _merge(top[n], who[n], i, np.where(fits, found, NONE), b.ids[cols][j])
        n, i, m = np.nonzero(top > NONE)
        return pa.table([a.table["anchor_row"].to_numpy()[i], n.astype(np.int32), who[n, i, m], top[n, i, m]], schema)

    return run, "anchor_row long, place int, negative_id long, negative_score long"


def _searched(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, made) -> DataFrame:
    """``made`` over every cell of anchors and rows."""
    a, b = -(-n_anchors // ANCHORS) or 1, -(-n_rows // ROWS) or 1
    dealt = lambda df, key, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = dealt(anchors, "anchor_row", "cell_a", a, "cell_b", b).groupBy("cell_a", "cell_b")
    right = dealt(rows, "row", "cell_b", b, "cell_a", a).groupBy("cell_a", "cell_b")
    run, schema = made
    return left.cogroup(right).applyInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: Fraction = Fraction(1, 2), high: Fraction = Fraction(19, 20)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vector array<long>).

    A row's score is its inner product with the anchor, higher ones first, ties by smaller vec_id.
    An anchor's positives are its first ``positives`` rows of the same label and another vec_id;
    for each, the first ``negatives`` rows of other labels with low * p <= score <= high * p, p
    being the positive's score, are returned. Rows without vec_id, label or vector take no part.
    Equal anchor rows are one anchor; candidates count as often as they are there. Vectors of
    different lengths score as if zeros filled the shorter one. An empty table gives no rows.
    """
    valid = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector", is_anchor.alias("anchor")).where("vec_id is not null and label is not null and size(vector) > 0")
    # Row numbers are written with the rows, so that a later reading finds the same ones.
    size = valid.agg(F.max(F.size("vector")).alias("d")).first()["d"]
    full = F.concat(F.col("vector"), F.array_repeat(F.lit(0).cast("long"), F.lit(size or 0) - F.size("vector")))
    numbered = valid.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", full.alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = materialize(numbered.mapInArrow(_summaries, SCHEMA.replace("vector array<long>", "vector array<long>, anchor boolean")))
    equal = rows.where("anchor").groupBy("vec_id", "label", "vector").agg(F.min("row").alias("row"))
    anchors = materialize(rows.join(equal.select("row"), "row", "left_semi").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "vector", "mean", "dev"))
    rows_of = rows.drop("anchor")
    n_anchors, n_rows = anchors.count(), rows.count()

    best = lambda by, score, who: Window.partitionBy(*by).orderBy(F.desc(score), who)
    found = _searched(anchors, rows_of, n_anchors, n_rows, _positives(positives))
    place = F.row_number().over(best(["anchor_row"], "positive_score", "positive_id"))
    found = materialize(found.withColumn("place", place - 1).where(F.col("place") < positives))
    scores = found.groupBy("anchor_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = materialize(anchors.join(scores, "anchor_row"))
    under = _searched(asked, rows_of, n_anchors, n_rows, _negatives(negatives, low, high))
    rank = F.row_number().over(best(["anchor_row", "place"], "negative_score", "negative_id"))
    under = under.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = materialize(under.join(found, ["anchor_row", "place"]).join(anchors.select("anchor_row", "anchor_id"), "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    release(rows, anchors, found, asked)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = got.select("vec_id", label.alias("label"), quantized(F.col("embedding"), 256.0).alias("vector"))
    return mine(vectors, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
