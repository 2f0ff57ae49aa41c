"""A read-through store of bars: partitions that the cache lacks are filled from the remote root, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReadThrough:
    """Bars of (symbol, date) kept under ``cache`` as symbol=S/date=D, filled from ``remote`` when first asked for.

    Remote layouts, in order of choice: S/D/ (a folder of Parquet files), S_D.parquet, and the
    last by name of S*_D.parquet, for contracts named by a suffix. A partition is written beside
    the cache and renamed into it, so readers see all of it or nothing; what a broken fill left
    behind is never read.
    """

    def __init__(self, spark: SparkSession, remote: str, cache: str):
        self.spark, self.remote, self.cache = spark, remote.rstrip("/"), cache.rstrip("/")
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, text: str):
        return self._jvm.Path(text)

    def _files(self, text: str):
        return self._path(text).getFileSystem(self._conf)

    def _exists(self, text: str) -> bool:
        return self._files(text).exists(self._path(text))

    def is_cached(self, symbol: str, date: str) -> bool:
        return self._exists(f"{self.cache}/symbol={symbol}/date={date}")

    def resolve(self, symbol: str, date: str) -> str | None:
        """The remote path that holds a symbol's day, or None."""
        for path in (f"{self.remote}/{symbol}/{date}", f"{self.remote}/{symbol}_{date}.parquet"):
            if self._exists(path):
                return path
        found = self._files(self.remote).globStatus(self._path(f"{self.remote}/{symbol}*_{date}.parquet"))
        return max((s.getPath().toString() for s in found), default=None) if found else None

    def fill(self, symbol: str, date: str) -> bool:
        """Copy one partition into the cache; False if the remote root lacks it."""
        source = self.resolve(symbol, date)
        if source is None:
            return False
        rows = self.spark.read.parquet(source)
        target, made = f"{self.cache}/symbol={symbol}/date={date}", f"{self.cache}/_fill-{uuid.uuid4().hex}"
        rows.drop("symbol", "date").write.option("compression", "zstd").parquet(made)
        files = self._files(self.cache)
        files.mkdirs(self._path(target).getParent())
        if not files.rename(self._path(made), self._path(target)) or files.exists(self._path(f"{target}/{made.rsplit('/', 1)[1]}")):
            # Another writer was first: its partition stands.
            files.delete(self._path(f"{target}/{made.rsplit('/', 1)[1]}"), True)
            files.delete(self._path(made), True)
        return True

    def sync(self, wanted: Sequence[tuple[str, str]]) -> dict[str, int]:
        """Fill what the cache lacks of ``wanted`` (symbol, date); numbers of kept, filled and missing partitions."""
        out = {"kept": 0, "filled": 0, "missing": 0}
        for symbol, date in dict.fromkeys(wanted):
            out["kept" if self.is_cached(symbol, date) else "filled" if self.fill(symbol, date) else "missing"] += 1
        return out

    def load(self, wanted: Sequence[tuple[str, str]]) -> DataFrame | None:
        """The rows of ``wanted``, read from the cache alone, with symbol and date; None where no partition is there."""
        self.sync(wanted)
        there = sorted({(s, d) for s, d in wanted if self.is_cached(s, d)})
        if not there:
            return None
        paths = [f"{self.cache}/symbol={s}/date={d}" for s, d in there]
        rows = self.spark.read.option("basePath", self.cache).option("mergeSchema", "true").parquet(*paths)
        return rows.withColumns({"symbol": F.col("symbol").cast("string"), "date": F.col("date").cast("string")})

    def status(self) -> DataFrame:
        """(symbol, date) of every partition in the cache, from folder names alone."""
        found = self._files(self.cache).globStatus(self._path(f"{self.cache}/symbol=*/date=*"))
        rows = [tuple(part.split("=", 1)[1] for part in s.getPath().toString().rsplit("/", 2)[-2:]) for s in found or []]
        return self.spark.createDataFrame(sorted(rows), "symbol string, date string")
