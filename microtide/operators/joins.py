"""Time joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


FOLDS = 1000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tolerance: int | None = None, prefix: str = "r_", bucket: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it.

    One union and one window instead of a range join: rows of both sides are sorted together by
    key and time, right ones first at equal times, and the right values carried forward. Cost is
    one shuffle by key and one sort, whatever the number of matches. Equal right times: the
    greatest values win. With ``bucket`` (in units of ts) windows are over a key's bucket of time,
    and the last value of each bucket is carried into those after it: a hot key is as many tasks
    as it has buckets, and only one row per bucket is sorted by key alone.
    """
    payload = F.struct(F.col(ts).alias("t"), *values)
    rhs = right.groupBy(*keys, ts).agg(F.max(F.struct(*values)).alias("v")).select(*keys, ts, *[F.col(f"v.{c}").alias(c) for c in values])
    a = left.select(*keys, ts, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(rhs.select(payload.alias("p")).schema["p"].dataType).alias("__p"))
    b = rhs.select(*keys, ts, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), payload.alias("__p"))
    both, by = a.unionByName(b), list(keys)
    if bucket is not None:
        both, by = both.withColumn("__bucket", F.floor(F.col(ts) / bucket)), [*keys, "__bucket"]
    w = Window.partitionBy(*by).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("__last", F.last("__p", ignorenulls=True).over(w)).where("__side = 1")
    if bucket is not None:
        ends = both.groupBy(*by).agg(F.max("__p").alias("__p"))  # t comes first in it
        before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        names = [f"__k{i}" for i in range(len(by))]
        carried = ends.withColumn("__carry", F.last("__p", ignorenulls=True).over(before)).select(*[F.col(k).alias(n) for k, n in zip(by, names)], "__carry")
        last = last.join(carried, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names)], "left").withColumn("__last", F.coalesce("__last", "__carry"))
    ok = F.lit(True) if tolerance is None else F.col(ts) - F.col("__last.t") <= tolerance
    return last.select("__row.*", F.when(ok, F.col("__last.t")).alias(f"{prefix}{ts}"), *[F.when(ok, F.col(f"__last.{c}")).alias(f"{prefix}{c}") for c in values])


def exact_offset_join(df: DataFrame, keys: list[str], ts: str, value: str, offset: int, out: str) -> DataFrame:
    """The value at exactly ``ts + offset`` of the same key, or null."""
    other = df.select(*keys, (F.col(ts) - offset).alias(ts), F.col(value).alias(out))
    return df.join(other, [*keys, ts], "left")


def align_pairs(df: DataFrame, symbol: str, ts: str, value: str, within: list[str] | None = None) -> DataFrame:
    """(a, b, ts, value_a, value_b) of all pairs a < b at common times, within equal ``within`` columns."""
    on = [ts, *(within or [])]
    a = df.select(*on, F.col(symbol).alias("a"), F.col(value).alias("value_a"))
    b = df.select(*on, F.col(symbol).alias("b"), F.col(value).alias("value_b"))
    return a.join(b, on).where("a < b")


def priority_lookup(df: DataFrame, params: DataFrame, exact: str, fallback: str, key: str, values: list[str], defaults: dict) -> DataFrame:
    """values from the row of ``params`` whose key is ``exact``, else ``fallback``'s, else defaults; and which it was."""
    p = params.select(F.col(key).alias("__k"), F.struct(*values).alias("__v"))
    one = df.join(p.withColumnRenamed("__v", "__v1"), F.col(exact) == F.col("__k"), "left").drop("__k")
    two = one.join(p.withColumnRenamed("__v", "__v2"), F.col(fallback) == F.col("__k"), "left").drop("__k")
    got = F.coalesce("__v1", "__v2")
    level = F.when(F.col("__v1").isNotNull(), "exact").when(F.col("__v2").isNotNull(), "base").otherwise("default")
    return two.select(*df.columns, *[F.coalesce(got[c], F.lit(defaults[c])).alias(c) for c in values], level.alias("matched"))


def overlap_counts(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per interval the number of earlier-or-equal starting intervals that still run at its start: a sweep, not a join."""
    from microtide.operators.windows import concurrency

    return concurrency(intervals, keys, start, end).withColumnRenamed("live", "overlaps")


def purged_folds(rows: DataFrame, folds: DataFrame, start: str, end: str, embargo: int) -> DataFrame:
    """(fold, rows, role): test rows start in the fold; train rows neither reach into it nor start in the embargo after it.

    ``folds`` (fold, lo, hi) has one row per fold, FOLDS at most: they become one array of constants.
    """
    few = folds.select("fold", "lo", "hi").limit(FOLDS + 1).collect()
    if len(few) > FOLDS:
        raise ValueError(f"more than {FOLDS} folds")
    kinds = dict(folds.dtypes)
    each = F.array(*[F.struct(*[F.lit(f[c]).cast(kinds[c]).alias(c) for c in ("fold", "lo", "hi")]) for f in few])
    crossed = rows.withColumn("__f", F.explode(each)).select(*rows.columns, "__f.fold", "__f.lo", "__f.hi")
    test = F.col(start).between(F.col("lo"), F.col("hi"))
    clear = (F.col(end) < F.col("lo")) | (F.col(start) > F.col("hi") + embargo)
    return crossed.withColumn("role", F.when(test, "test").when(clear, "train").otherwise("purged"))


def next_listed(df: DataFrame, day: str, listed: DataFrame, listed_day: str) -> DataFrame:
    """Days to the next listed date (0 on it), null after the last one: an as-of join turned round."""
    l = listed.select(F.col(listed_day).alias(day)).distinct().withColumn("__listed", F.col(day))
    both = df.select(day).distinct().withColumn("__listed", F.lit(None).cast("date")).unionByName(l)
    nearest = both.groupBy(day).agg(F.max("__listed").alias("__listed"))
    w = Window.orderBy(day).rowsBetween(0, Window.unboundedFollowing)  # one row per calendar day
    ahead = nearest.select(day, F.first("__listed", ignorenulls=True).over(w).alias("__next"))
    return df.join(ahead, day, "left").withColumn("days_to_next", F.datediff("__next", day)).drop("__next")


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``; give a tie-breaker for a defined result."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
