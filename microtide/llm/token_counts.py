"""Token counts by source, language and tokenizer version, kept by signed deltas.

State is a folder of committed batches. A batch is a set of changes; only its additive totals
are written, as one Parquet folder per batch id that counts once Spark's success mark is there.
A batch that was committed is never applied again, and one that broke off is written anew, so
a replay changes nothing. Totals are the sum over committed batches and the last snapshot.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.llm.common import materialize, n_words, scratch_dir, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the public vocabulary's texts are split before merging; a fixed value that goes with the file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]

_ENCODINGS: dict[int, object] = {}


def _encoding(vocabulary):
    key = id(vocabulary)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def bpe_tokens(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """A function of a text column: its number of byte-level BPE tokens, null counting as empty.

    The driver reads the vocabulary (under 1 MB) from ``folder`` and broadcasts it. White space
    that starts a word belongs to its token, so each text is encoded whole.
    """
    with open(f"{folder}/{name}", "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")


def changes(rows: DataFrame, before: Column | None, after: Column | None) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) per row with KEYS: an insert has no ``before``, a delete no ``after``, a revision both."""
    there = lambda c: F.lit(0) if c is None else F.lit(1)
    value = lambda c: F.lit(0) if c is None else F.coalesce(c, F.lit(0))
    return rows.select(*KEYS, (there(after) - there(before)).cast("long").alias("docs"), (value(after) - value(before)).cast("long").alias("tokens"))


class Rollup:
    """Additive totals under a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._root = self._fs.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._files.exists(self._fs.Path(f"{self.path}/{name}/_SUCCESS"))

    def committed(self) -> list[str]:
        """Ids of the batches in force, in order of name."""
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted(n[6:] for n in names if n.startswith("batch=") and self._has(n))

    def _snapshots(self) -> list[str]:
        """Folders of finished snapshots in the order of their making, which is the number in their names."""
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted((n for n in names if n.startswith("snapshot=") and self._has(n)), key=lambda n: int(n[9:].split("-")[0]))

    def _folded(self, batches: list[str]) -> set[str]:
        """Those of ``batches`` that the last snapshot holds."""
        last = self._snapshots()[-1:]
        if not last or not batches:
            return set()
        asked = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        return {r["batch"] for r in asked.join(self.spark.read.parquet(f"{self.path}/{last[0]}/batches"), "batch", "left_semi").collect()}

    def apply(self, batch: str, delta: DataFrame) -> bool:
        """Commit a batch of change rows; False if that id was committed before."""
        if self._has(f"batch={batch}") or self._folded([batch]):
            return False
        sums = delta.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.repartition(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); groups that have no document left are gone."""
        live = self.committed()
        folded = self._folded(live)
        parts = [f"{self.path}/batch={b}" for b in live if b not in folded] + [f"{self.path}/{s}/totals" for s in self._snapshots()[-1:]]
        if not parts:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*parts).select(*KEYS, "docs", "tokens")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def compact(self, name: str) -> None:
        """Fold all committed batches into a snapshot, whose mark is written last.

        Snapshots are numbered; the name is only a label. A compaction that broke off left no mark
        and is made anew; one that broke off after its mark left folders that this one deletes.
        """
        ids, made = self.committed(), self._snapshots()
        number = int(made[-1][9:].split("-")[0]) + 1 if made else 1
        folder = f"{self.path}/snapshot={number:012d}-{name}"
        self.totals().repartition(1).write.mode("overwrite").parquet(f"{folder}/totals")
        names = self.spark.createDataFrame([(b,) for b in ids], "batch string")
        for s in made[-1:]:
            names = names.union(self.spark.read.parquet(f"{self.path}/{s}/batches")).distinct()
        names.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches")
        self._files.create(self._fs.Path(f"{folder}/_SUCCESS")).close()
        for old in [*(f"batch={b}" for b in ids), *made[:-1]]:
            self._files.delete(self._fs.Path(f"{self.path}/{old}"), True)


def counted(docs: DataFrame, tokenizers: dict) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): one row per document and tokenizer version."""
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"__t{i}").alias("tokens")) for i, name in enumerate(tokenizers)])
    rows = docs.select("doc_id", "source", "lang", *[count(F.col("text")).alias(f"__t{i}") for i, count in enumerate(tokenizers.values())])
    return rows.select("doc_id", "source", "lang", F.explode(each).alias("e")).select("doc_id", "source", "lang", "e.tokenizer", "e.tokens")


def history(docs: DataFrame, tokenizers: dict, path: str) -> Rollup:
    """A change log over all of ``docs``, applied to a rollup: inserts, revisions, deletes, and a replay.

    Every document is inserted; those whose doc_id is divisible by 5 are revised to the counts
    of their text in capitals; those whose doc_id is 3 modulo 7 are deleted with the counts they
    have then; then the first batch comes once more and changes nothing. Null text counts 0, a
    null source or language is a group, rows without doc_id stay as inserted, repeated rows
    count each, an empty table leaves no group.
    """
    revised, gone = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)), F.coalesce(F.col("doc_id") % 7 == 3, F.lit(False))
    docs = docs.select("doc_id", "source", "lang", "text")
    first = materialize(counted(docs, tokenizers))
    second = materialize(counted(docs.where(revised).withColumn("text", F.upper("text")), tokenizers))
    rollup = Rollup(docs.sparkSession, path)
    inserts = changes(first, None, F.col("tokens"))
    rollup.apply("1-insert", inserts)
    # The old count leaves and the new one enters: their sum is the revision.
    rollup.apply("2-revise", changes(first.where(revised), F.col("tokens"), None).union(changes(second, None, F.col("tokens"))))
    rollup.apply("3-delete", changes(first.where(gone & ~revised).union(second.where(gone)), F.col("tokens"), None))
    rollup.apply("1-insert", inserts)
    return rollup


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    tokenizers = {"words-1": n_words, "bpe-50k-1": bpe_tokens(spark)}
    path = f"{scratch_dir(spark).rstrip('/')}/microtide/rollup-{uuid.uuid4().hex}"
    return history(table(spark, sf_dir, "documents"), tokenizers, path).totals()
