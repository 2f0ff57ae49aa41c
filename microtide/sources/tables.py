"""Sources, sinks and the dataset catalog: Hive-partitioned Parquet in place of path building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microtide.functions import scalar


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


L, D, S = T.LongType(), T.DoubleType(), T.StringType()
LEVEL = _struct(price=D, quantity=L, orders=L)
RAW_TICK = _struct(ts_local_ns=L, ts_exchange=S, symbol=S, instrument_token=L, last_price=D, avg_price=D, last_qty=L, volume=L, oi=L, total_bid_qty=L, total_ask_qty=L, depth=_struct(buy=T.ArrayType(LEVEL), sell=T.ArrayType(LEVEL)))
NEWS = _struct(id=S, source=S, headline=S, body=S, url=S, published=S, symbols=T.ArrayType(S), fetched_at=S)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, root: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None, schema: T.StructType | None = None, session_only: bool = False) -> DataFrame:
    """A dataset partitioned by symbol and date; symbol and date filters prune partitions."""
    df = (spark.read.schema(schema) if schema else spark.read).option("mergeSchema", schema is None).parquet(root)
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("date") <= F.lit(last).cast("date"))
    return df.where(scalar.in_session(F.col("ts_sec"), F.col("symbol"))) if session_only else df


def save(df: DataFrame, root: str, by: tuple[str, ...] = ("symbol", "date"), mode: str = "append", files_per: int = 1) -> None:
    """zstd Parquet by partition; rows of a partition go to ``files_per`` tasks, so that a hot one can be split."""
    spread = df.repartition(*by, F.pmod(F.xxhash64(*df.columns[:4]), F.lit(files_per))) if files_per > 1 else df.repartition(*by)
    spread.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(root)


def active_symbols(df: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    return df.select(scalar.base_symbol(F.col("symbol")).alias("symbol")).distinct().where(~F.col("symbol").isin(*excluded) if excluded else F.lit(True)).orderBy("symbol")


def options_day(df: DataFrame, underlying: str | None = None, opt_type: str | None = None, strikes: tuple[float, float] | None = None, min_premium: float | None = None, max_tte: float | None = None) -> DataFrame:
    """Only the predicates that are given."""
    tests = []
    if underlying is not None:
        tests.append(F.col("underlying") == underlying)
    if opt_type is not None:
        tests.append(F.col("opt_type") == opt_type)
    if strikes is not None:
        tests.append(F.col("strike").between(*strikes))
    if min_premium is not None:
        tests.append(F.col("close") >= min_premium)
    if max_tte is not None:
        tests.append(F.col("tte") <= max_tte)
    for t in tests:
        df = df.where(t)
    return df


def options_chain(df: DataFrame, ts_sec: int, atm: float, step: float, n: int) -> DataFrame:
    middle = round(atm / step) * step
    return df.where((F.col("ts_sec") == ts_sec) & F.col("strike").between(middle - n * step, middle + n * step)).orderBy("strike", "opt_type")


def sync(new: DataFrame, root: str, keys: tuple[str, ...] = ("symbol", "date")) -> int:
    """Append only the partitions that the dataset doesn't have; how many there were."""
    spark = new.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    fresh = new.join(spark.read.parquet(root).select(*keys).distinct(), list(keys), "left_anti") if there else new
    n = fresh.select(*keys).distinct().count()
    if n:
        save(fresh, root, keys)
    return n


def catalog_status(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("dates"), F.count(F.lit(1)).alias("n_rows"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line with a symbol and its parameters."""
    return spark.read.json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values where given, else old ones."""
    values = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}") if c in new.columns else F.lit(None), F.col(f"o.{c}")).alias(c) for c in values])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per file, answered from Parquet footers where the scan allows."""
    return spark.read.parquet(root).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def parse_rss(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(title, link, published) of the items of RSS texts, by XPath expressions; dates in the four usual formats."""
    items = xml.select(F.explode(F.arrays_zip(*[F.xpath(column, F.lit(f"//item/{c}/text()")).alias(c) for c in ("title", "link", "pubDate")])).alias("i"))
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")
    date = F.regexp_replace("i.pubDate", r"^\s*[A-Za-z]{3},\s*", "")  # Spark doesn't parse the day's name
    return items.select("i.title", "i.link", F.coalesce(*[F.try_to_timestamp(date, F.lit(f)) for f in formats]).alias("published"))


def parse_fundamentals(raw: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, item, period, value) from nested rows of texts; thousands separators and percent signs stripped."""
    schema = "struct<symbol: string, columns: array<string>, rows: array<struct<name: string, cells: array<string>>>>"
    r = raw.select(F.from_json(column, schema).alias("j")).select("j.symbol", "j.columns", F.explode("j.rows").alias("r"))
    cells = r.select("symbol", F.col("r.name").alias("item"), F.explode(F.arrays_zip(F.col("columns").alias("period"), F.col("r.cells").alias("cell"))).alias("z"))
    return cells.select("symbol", "item", "z.period", F.expr("try_cast(regexp_replace(z.cell, '[,%]', '') AS double)").alias("value"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master, one beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext._jsc.sc().isLocal():
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/microtide-scratch"
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")
