"""Neighbours in the sort order of a whole distributed column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut


def sorted_neighbours(df: DataFrame, key: str, mark: str) -> DataFrame:
    """Adds ``before`` and ``after``: the nearest smaller and larger ``key`` among the rows where ``mark`` holds.

    The rows are cut into ranges of the key. Within a range a window finds both; where a range has no further marked row,
    the answer is the end of another range. Which range that is follows from a list of range numbers alone, one integer for
    each; the keys at the ranges' ends are joined to it, so no task sees more than its range and two of these. Keys should be
    distinct, or equal ones fall into one range; a null key has no neighbours, null marks count as false, no rows give none.
    """
    placed = cut(df.where(F.col(key).isNotNull()).repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    marked = F.when(F.col(mark), F.col(key))
    one_before = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    one_after = Window.partitionBy("__range").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("before", F.last(marked, True).over(one_before)).withColumn("after", F.last(marked, True).over(one_after))
    ends = placed.groupBy("__range").agg(F.min(marked).alias("__low"), F.max(marked).alias("__high"))
    has = F.when(F.col("__low").isNotNull(), F.col("__range"))
    upwards = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    downwards = Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.select("__range", F.last(has, True).over(upwards).alias("__left"), F.last(has, True).over(downwards).alias("__right"))
    around = steps.join(ends.select(F.col("__range").alias("__left"), "__high"), "__left", "left").join(ends.select(F.col("__range").alias("__right"), "__low"), "__right", "left").select("__range", "__high", "__low")
    return inside.join(around, "__range", "left").select(*df.columns, F.coalesce("before", "__high").alias("before"), F.coalesce("after", "__low").alias("after"))
