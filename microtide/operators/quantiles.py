"""Exact quantiles per key without a map of all values: histogram counts first, then only the cells that hold a quantile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: Sequence[float], out: Sequence[str], cells: int = 4096) -> DataFrame:
    """(keys, out...): quantiles of x by linear interpolation between order statistics; nulls are left out.

    The first pass counts a key's values in ``cells`` cells of equal width, which tells the cell
    of each order statistic. The second counts the distinct values of those cells alone. A key
    of any number of rows is thus spread over the tasks that hold its rows.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(x).cast("double").alias("__v")).where("__v is not null")
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    span = rows.groupBy(*names).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    on = same("r", "s") or [F.lit(True)]
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    cell = F.least(F.lit(cells - 1), F.floor(F.coalesce((F.col("__v") - F.col("__lo")) / width, F.lit(0.0)) * cells)).cast("int")
    put = rows.alias("r").join(span.alias("s"), on).select(*[F.col(f"r.{n}") for n in names], "__v", cell.alias("__cell"))
    counts = put.groupBy(*names, "__cell").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*names)
    before = F.coalesce(F.sum("__c").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*names, "__cell", "__c", before.alias("__before"), F.sum("__c").over(w).alias("__n"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), (F.lit(float(q)) * (F.col("__n") - 1)).alias("at")) for i, q in enumerate(qs)]))
    # Order statistics floor(at) and floor(at) + 1, the last one twice at the end.
    wanted = counts.select("*", asked.alias("__a")).withColumn("__low", F.floor("__a.at")).withColumn("__up", F.least(F.col("__low") + 1, F.col("__n") - 1))
    ranks = wanted.select(*names, "__cell", "__before", "__c", F.col("__a.q").alias("__q"), F.col("__a.at").alias("__at"), F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("__low").alias("k")), F.struct(F.lit(1).alias("e"), F.col("__up").alias("k")))).alias("__r"))
    ranks = ranks.where((F.col("__r.k") >= F.col("__before")) & (F.col("__r.k") < F.col("__before") + F.col("__c"))).select(*names, "__cell", "__before", "__q", "__at", F.col("__r.e").alias("__e"), F.col("__r.k").alias("__k"))
    needed = ranks.select(*names, "__cell").distinct()
    at = [*same("p", "c"), F.col("p.__cell") == F.col("c.__cell")]
    values = put.alias("p").join(needed.alias("c"), at, "left_semi").groupBy(*names, "__cell", "__v").agg(F.count(F.lit(1)).alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*names, "__cell").orderBy("__v"))
    values = values.withColumn("__upto", upto)
    here = [*same("v", "a"), F.col("v.__cell") == F.col("a.__cell")]
    place = F.col("__k") - F.col("__before")
    met = values.alias("v").join(ranks.alias("a"), here).where((place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__m")))
    ends = met.groupBy(*[F.col(f"a.{n}").alias(n) for n in names], "__q").agg(F.max(F.when(F.col("__e") == 0, F.col("__v"))).alias("lo"), F.max(F.when(F.col("__e") == 1, F.col("__v"))).alias("hi"), F.max("__at").alias("at"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    made = ends.groupBy(*names).agg(*[F.max(F.when(F.col("__q") == i, value)).alias(o) for i, o in enumerate(out)])
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *out)
