"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.llm.common import WORD, lookup_join, materialize, n_words, table

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
CAP = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn. Together the targets are
    share[0]/share[1] of all sizes; each stops at ``cap`` times its source's size and what it
    can't take is reshared by weight, until none is above. With the sources in order of
    cap/weight, level i = (total - caps before i) / (weights from i on) is the share per weight
    if those before i are capped; the level that holds is the largest one, so one running sum
    over one row per source gives all targets. All sums are of integers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int")))
    by_room = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy()
    room = F.lit(share[0]) * F.sum("source_size").over(everyone) - F.lit(share[1]) * before
    per = per.withColumn("level", room.cast("double") / (F.lit(share[1]) * after).cast("double"))
    per = per.withColumn("level", F.max("level").over(everyone))
    target = F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.col("level") * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the document's id and the seed: the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies (long).

    mix_copies is floor(rate) plus one hash-seeded Bernoulli copy of probability rate - floor(rate),
    where rate = target / size of the document's source. Null text has size 0; a null source is
    a source; a source without words has target 0 and no copies; repeated rows are documents of
    their own with equal draws; an empty table gives no rows. Columns of these names are replaced.
    """
    made = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*made)
    per = materialize(source_targets(docs.select("source", n_words(F.col("text")).alias("size")), weights, share, cap))
    per = per.select("source", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    out = lookup_join(docs.withColumn("mix_size", n_words(F.col("text"))), per, ["source"], ["doc_id"])
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    extra = (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn("mix_copies", F.floor(rate).cast("long") + extra)


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: every document as often as mix_copies says, numbered by mix_copy from 1."""
    mixed = mix(docs, **settings).where("mix_copies > 0").drop("mix_copy")
    out = mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return out.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = F.col("mix_size")
    return mix(docs).select("doc_id", size.alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (size * F.col("mix_copies")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
l AS (
  SELECT *, CAST(3 * sum(source_size) OVER ()
      - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(2 * sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
