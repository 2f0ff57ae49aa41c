"""Feature importance over purged folds, and the weights of overlapping labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniqueness(labels: DataFrame, bars: DataFrame, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """``labels`` with the average uniqueness of each: the mean of 1 / concurrency over the bars from start to end.

    ``bars`` (keys, ts) has a row for every start and end. Concurrency is a running sum of starts
    and ends, the mean a difference of two running sums: no label meets another.
    """
    ups = labels.groupBy(*keys, F.col(start).alias(ts)).agg(F.count(F.lit(1)).alias("__up"))
    downs = labels.groupBy(*keys, F.col(end).alias(ts)).agg(F.count(F.lit(1)).alias("__down"))
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    at = bars.select(*keys, ts).distinct().join(ups, [*keys, ts], "left").join(downs, [*keys, ts], "left").fillna(0, ["__up", "__down"])
    # A label that ends at a bar still runs there.
    at = at.withColumn("__live", F.sum("__up").over(w) - F.sum("__down").over(w) + F.col("__down"))
    at = at.withColumns({"__one": F.when(F.col("__live") > 0, 1 / F.col("__live")).otherwise(0.0)})
    at = at.withColumns({"__sum": F.sum("__one").over(w), "__row": F.row_number().over(Window.partitionBy(*keys).orderBy(ts))})
    first = at.select(*keys, F.col(ts).alias(start), (F.col("__sum") - F.col("__one")).alias("__a"), F.col("__row").alias("__ra"))
    last = at.select(*keys, F.col(ts).alias(end), F.col("__sum").alias("__b"), F.col("__row").alias("__rb"))
    both = labels.join(first, [*keys, start], "left").join(last, [*keys, end], "left")
    value = (F.col("__b") - F.col("__a")) / F.nullif(F.col("__rb") - F.col("__ra") + 1, F.lit(0))
    return both.select(*labels.columns, value.alias("uniqueness"))


def permuted(df: DataFrame, column: str, row: str, seed: int, rows_per_task: int = 100_000, n: int | None = None) -> DataFrame:
    """``df`` with ``column`` dealt anew among its rows: within blocks of random rows each takes the next one's value.

    A block is about ``rows_per_task`` rows of a table of ``n``, so nothing is sorted as a whole.
    """
    n = df.count() if n is None else n
    blocks = max(1, -(-n // rows_per_task))
    mixed = F.xxhash64(F.lit(seed), F.lit(column), F.col(row))
    w = Window.partitionBy(F.pmod(mixed, F.lit(blocks))).orderBy(F.xxhash64(F.lit(seed + 1), mixed), row)
    nxt = F.when(F.lead(row).over(w).isNotNull(), F.lead(column).over(w)).otherwise(F.first(column).over(w))
    return df.withColumn(column, nxt)


def _fitted(df: DataFrame, columns: Sequence[str], label: str, weight: str | None, trees: int, depth: int, seed: int):
    put = VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip")
    forest = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {}))
    model = forest.fit(put.transform(df))
    return lambda rows: model.transform(put.transform(rows)), model


def _accuracy(predicted: DataFrame, label: str) -> float:
    return predicted.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("a")).first()["a"] or 0.0


def importance(df: DataFrame, columns: Sequence[str], label: str, row: str, folds: Sequence[tuple[Column, Column]], weight: str | None = None, trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """(feature, mdi, mda, sfi) of a forest that predicts ``label`` (0.0, 1.0).

    mdi: mean decrease of impurity over all rows. mda: the share of the accuracy over ``folds``
    (train, test predicates, such as purged ones) that is lost when the column is permuted in the
    test rows. sfi: accuracy over the folds with this column alone. ``row`` tells rows apart;
    ``folds`` and ``columns`` are few, and each model is one Spark job over all rows.
    """
    df = df.persist()  # each model reads it several times
    _, whole = _fitted(df, columns, label, weight, trees, depth, seed)
    mdi = whole.featureImportances.toArray()
    lost, alone = dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 0.0)
    for train, test in folds:
        predict, _ = _fitted(df.where(train), columns, label, weight, trees, depth, seed)
        held = df.where(test)
        n = held.count()
        base = _accuracy(predict(held), label)
        for c in columns:
            less = _accuracy(predict(permuted(held, c, row, seed, n=n)), label)
            lost[c] += (base - less) / base / len(folds) if base else 0.0
            single, _ = _fitted(df.where(train), [c], label, weight, trees, depth, seed)
            alone[c] += _accuracy(single(held), label) / len(folds)
    df.unpersist()
    return df.sparkSession.createDataFrame([(c, float(mdi[i]), float(lost[c]), float(alone[c])) for i, c in enumerate(columns)], "feature string, mdi double, mda double, sfi double")
