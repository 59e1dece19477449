"""Keep-first and keep-last rules, digests and row-set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key in ``order``; null keys are equal. Partial limits run before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def digest(*cols: Column) -> Column:
    """SHA-256 over the columns, length-framed and null-marked, so that no two different tuples have the same bytes."""
    parts = []
    for c in cols:
        marked = F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), c.cast("string")))
        parts += [F.length(marked).cast("string"), F.lit(":"), marked]
    return F.sha2(F.concat(*parts), 256)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only with side and number of surplus copies; a true multiset comparison, one shuffle for each side."""
    cols = a.columns
    count = lambda d, n: d.select(cols).groupBy(*cols).agg(F.sum(F.lit(n)).alias("n"))
    both = count(a, 1).unionByName(count(b, -1)).groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0")
    return both.withColumn("side", F.when(F.col("n") > 0, "left").otherwise("right")).withColumn("surplus", F.abs("n")).drop("n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union of both with the row of the greatest ``order`` for each key; of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.col(order).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def remaining(jobs: DataFrame, done: DataFrame, keys: Sequence[str], complete: int | None = None) -> DataFrame:
    """Jobs whose key is not done; with ``complete`` a key counts as done from so many rows on."""
    finished = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if complete is not None:
        finished = finished.where(F.col("_n") >= complete)
    return jobs.join(finished.drop("_n"), list(keys), "left_anti")
