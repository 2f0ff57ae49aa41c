"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Native DataFrame functions only. A test item with n shingles is contained in a document if at
least ``threshold`` of them are found there, so any n - ceil(threshold * n) + 1 of its shingles
include one that such a document has. The item's sketch is that many of its least hash values:
its bottom-k MinHash, with k by its size. Items are partitioned by size, and a partition is
searched on its own: its largest sketch hash bounds the documents' hashes that are looked up in
it (for longer items this is a small part of all), whatever the documents' length. A sketch hit
is a candidate and is verified on all shingles, so no pair is lost and none is reported on
hashes of a sketch.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.llm.common import free, identity, materialize, table

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
NON_WORD = r"[^\p{L}\p{N}]+"


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda w: w != "")


def _hashes(w: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the k-word shingles of an array of words."""
    at = lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, k)])
    return F.array_distinct(F.slice(F.transform(w, at), F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))))


def items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, k, w): one row per item with words; repeated item_ids with equal texts are one."""
    rows = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    return rows.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("k"), "w")


def _shingled(w: Column, k: int) -> Column:
    """Array of (k, hash) of the k-word shingles."""
    return F.transform(_hashes(w, k), lambda x: F.struct(F.lit(k).alias("k"), x.alias("hash")))


def _looked_up(hashes: Column, k: int, tops: dict[int, int]) -> Column:
    """Array of (k, part, hash): per size partition the hashes up to its largest one."""
    def of(part: int, top: int) -> Column:
        return F.transform(F.filter(hashes, lambda x: x <= F.lit(top)), lambda x: F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"), x.alias("hash")))

    return F.concat(*[of(part, top) for part, top in sorted(tops.items())])


def find(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of the pairs where n_shared >= threshold * n_shingles.

    Words are lower-case runs of letters and digits. An item of fewer than ``shingle`` words has
    one shingle, all its words, and is found where they follow each other. Items and documents
    without words (null, empty) are in no pair; rows with an equal doc_id are one document, its
    shingles those of all its rows; equal item_ids with different texts are one item likewise;
    empty tables give no rows.
    """
    up, low = threshold.numerator, threshold.denominator
    rows = items(benchmark, shingle)
    per_item = rows.select("item_id", F.explode(F.array_distinct(F.when(F.col("k") == shingle, _shingled(F.col("w"), shingle)).otherwise(_short(F.col("w"), shingle)))).alias("s"))
    per_item = materialize(per_item.select("item_id", "s.k", "s.hash").distinct())
    ks = sorted(r[0] for r in per_item.select("k").distinct().collect())  # of 1..shingle
    if not ks:
        return docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(None).cast("long").alias(c) for c in ("n_shingles", "n_shared")]).limit(0)
    sized = per_item.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("hash", "k"))).alias("all"))
    take = F.col("n") - F.floor((F.col("n") * up + low - 1) / low).cast("long") + 1
    sketch = sized.select("item_id", "n", F.floor(F.log2("n")).cast("int").alias("part"), F.explode(F.slice("all", F.lit(1), take.cast("int"))).alias("s"))
    sketch = materialize(sketch.select("item_id", "n", "part", F.col("s.k").alias("k"), F.col("s.hash").alias("hash")))
    # At most 32 partitions of sizes: the largest hash of each, with the lengths of its shingles.
    tops: dict[int, dict[int, int]] = {}
    for r in sketch.groupBy("k", "part").agg(F.max("hash").alias("top")).collect():
        tops.setdefault(r["k"], {})[r["part"]] = r["top"]

    of = docs.select("doc_id", normal_words(F.col("text")).alias("__w"))
    hashed = of.select("doc_id", *[_hashes(F.col("__w"), k).alias(f"__h{k}") for k in sorted(tops)])
    seen = hashed.select("doc_id", F.explode(F.concat(*[_looked_up(F.col(f"__h{k}"), k, tops[k]) for k in sorted(tops)])).alias("s")).select("doc_id", "s.k", "s.part", "s.hash")
    candidates = materialize(seen.join(sketch.select("item_id", "k", "part", "hash"), ["k", "part", "hash"]).select("doc_id", "item_id").distinct())

    # The shingles of each candidate's item that its document has.
    same = lambda c, d: F.col(c).eqNullSafe(F.col(d))
    some = of.join(candidates.select(F.col("doc_id").alias("__d")).distinct(), same("doc_id", "__d"), "left_semi")
    have = some.select(F.col("doc_id").alias("__d"), F.explode(F.concat(*[_shingled(F.col("__w"), k) for k in ks])).alias("s")).select("__d", F.col("s.k").alias("__k"), F.col("s.hash").alias("__h"))
    asked = candidates.join(per_item.withColumnRenamed("item_id", "__i"), same("item_id", "__i")).drop("__i")
    shared = asked.join(have, same("doc_id", "__d") & (F.col("k") == F.col("__k")) & (F.col("hash") == F.col("__h")), "left_semi").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    n = sized.select(F.col("item_id").alias("__i"), F.col("n").alias("n_shingles"))
    out = shared.join(n, F.col("item_id").eqNullSafe(F.col("__i"))).where(F.col("n_shared") * low >= F.col("n_shingles") * up)
    return out.select("doc_id", "item_id", "n_shingles", "n_shared")


def _short(w: Column, shingle: int) -> Column:
    """The one shingle of fewer than ``shingle`` words, hashed as in a document."""
    made = F.lit(None)
    for k in range(1, shingle):
        one = F.array(F.struct(F.lit(k).alias("k"), F.xxhash64(*[F.get(w, F.lit(d)) for d in range(k)]).alias("hash")))
        made = F.when(F.size(w) == k, one) if k == 1 else made.when(F.size(w) == k, one)
    return made


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text contains no item.

    Rows are told apart by doc_id and text: a null or reused doc_id doesn't join or drop others.
    """
    (d,) = free(docs, "__d")
    gone = find(docs.select(identity().alias("doc_id"), "text"), benchmark, **settings).select(F.col("doc_id").alias(d)).distinct()
    return docs.join(gone, identity() == F.col(d), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH i0 AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i1 AS (SELECT item_id, w, least(len(w), 5) AS k FROM i0 WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[p:p + k - 1], ' ') for p in range(1, len(w) - k + 2)]) AS s FROM i1),
d0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM item),
doc AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[p:p + k - 1], ' ') for p in range(1, len(w) - k + 2)]) AS s FROM d0, ks WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_shingles FROM item GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM doc JOIN item USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 5 * count(*) >= 4 * n_shingles
"""
