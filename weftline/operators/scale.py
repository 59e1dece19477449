"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import cut

#: A hot-key list holds at most this many keys, so that broadcasting it is bounded.
MAX_HOT_KEYS = 1000
#: Largest table that ``sized_join`` broadcasts.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 1.0 / MAX_HOT_KEYS, least: int = 20_000) -> DataFrame:
    """Keys holding over ``share`` of all rows and over ``least`` rows, with a ``_salts`` count.

    The result has at most 1/share rows by counting, whatever the data. Null keys are left out.
    """
    counted = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n").alias("_total"))
    limit = F.greatest(F.lit(float(least)), F.col("_total") * share)
    return (
        counted.where(F.col("_n") > least)
        .join(F.broadcast(total), F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
    )


def salted_join(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", spread: Column | None = None, least: int = 20_000, hot: list[Row] | None = None) -> DataFrame:
    """Join ``many`` rows to ``one`` row per key without sending a hot key to a single task.

    Hot keys (see ``hot_keys``; a list bounded by MAX_HOT_KEYS, hence collected and broadcast) get several salts: rows of
    ``many`` are spread over them and the matching rows of ``one`` are repeated once per salt. Without hot keys it is a plain
    join. ``hot`` gives the list where it is known, if need be over some of the keys only. ``how`` is inner, left, left_semi or
    left_anti. ``spread`` is any column that varies within a key; the default hashes the whole row. Null keys match nothing.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, least=least).collect() if hot is None else hot
    if not hot:
        return many.join(one, keys, how)
    over = [c for c in hot[0].asDict() if c != "_salts"]
    known = F.broadcast(many.sparkSession.createDataFrame(hot, T.StructType([*[T.StructField(c, many.schema[c].dataType) for c in over], T.StructField("_salts", T.IntegerType())])))
    spread = spread if spread is not None else F.xxhash64(*[c for c in many.columns if not _unhashable(many, c)])
    left = many.join(known, over, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")).cast("int")).otherwise(0)).drop("_salts")
    right = one.join(known, over, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def is_small(df: DataFrame) -> bool:
    """Whether ``df``, measured, has at most BROADCAST_ROWS rows and BROADCAST_BYTES of text."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def sized_join(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", spread: Column | None = None, small: bool | None = None) -> DataFrame:
    """A broadcast of ``one`` if it ``is_small``, else salted_join; ``one`` is read twice, so it should be a table or cut."""
    if is_small(one) if small is None else small:
        return many.join(F.broadcast(one), list(keys), how)
    return salted_join(many, one, keys, how, spread)


def _unhashable(df: DataFrame, name: str) -> bool:
    return "map<" in dict(df.dtypes)[name] or "variant" in dict(df.dtypes)[name]


def distributed_row_number(df: DataFrame, part: Sequence[str], order: Sequence[Column], bucket: Column, buckets: int, out: str = "rn") -> DataFrame:
    """``row_number() over (partition by part order by bucket, order)`` without one task per partition key.

    ``bucket`` is an int expression in [0, buckets) that is the leading sort key (a hash range for random order, a
    value range otherwise). Rows are numbered inside (part, bucket) and shifted by the counts of the earlier
    buckets, which are |part| x buckets small rows, so a key with a third of all rows is spread over ``buckets`` tasks.
    """
    part = list(part)
    d = df.withColumn("__b", bucket.cast("int"))
    counts = d.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = counts.withColumn("__before", before)
    numbered = d.withColumn("__i", F.row_number().over(Window.partitionBy(*part, "__b").orderBy(*order)))
    condition = F.lit(True)
    for k in [*part, "__b"]:
        condition = condition & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return (
        numbered.alias("l")
        .join(shifted.drop("__n").alias("r"), condition)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r.__before") + F.col("l.__i")).alias(out))
    )


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "rn", part: Sequence[str] = ()) -> DataFrame:
    """``row_number() over (partition by part order by order)`` without a task that holds all rows of a part.

    Rows are cut into ranges of part and order by a sample, numbered inside them and shifted by the sizes of the earlier ranges:
    one number for each part in each range that holds it. The order should end with a unique column, so that ties do not fill a
    range. Null parts are one part. No rows give none.
    """
    return _over_ranges(df, order, part, out, None)


def global_running_sum(df: DataFrame, order: Sequence[Column], value: str, out: str = "running", part: Sequence[str] = ()) -> DataFrame:
    """``sum(value) over (partition by part order by order rows unbounded preceding)``, as in global_row_number; nulls add nothing."""
    return _over_ranges(df, order, part, out, value)


def _over_ranges(df: DataFrame, order: Sequence[Column], part: Sequence[str], out: str, value: str | None) -> DataFrame:
    part = list(part)
    placed = cut(df.repartitionByRange(*[F.col(p) for p in part], *order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy(*part, "__range").agg((F.count(F.lit(1)) if value is None else F.coalesce(F.sum(value), F.lit(0))).alias("__size"))
    earlier = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(p).alias(f"__part{n}") for n, p in enumerate(part)], F.col("__range").alias("__of"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*part, "__range").orderBy(*order)
    own = F.row_number().over(inside) if value is None else F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    condition = F.col("__range") == F.col("__of")
    for n, p in enumerate(part):
        condition = condition & F.col(p).eqNullSafe(F.col(f"__part{n}"))
    return placed.withColumn("__own", own).join(before, condition).select(*df.columns, (F.col("__before") + F.col("__own")).alias(out))


def hash_bucket(buckets: int, *cols: Column | str, seed: str = "") -> Column:
    """An even int bucket in [0, buckets) that follows the order of the row's 63-bit hash, for random order."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.floor((F.shiftrightunsigned(h, 1) / F.lit(float(2**63))) * buckets).cast("int")


def distributed_running_sum(df: DataFrame, part: Sequence[str], order: Sequence[Column], bucket: Column, buckets: int, value: str, out: str = "running") -> DataFrame:
    """``sum(value) over (partition by part order by bucket, order rows unbounded preceding)``, split as in distributed_row_number."""
    part = list(part)
    d = df.withColumn("__b", bucket.cast("int"))
    sums = d.groupBy(*part, "__b").agg(F.sum(value).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = sums.withColumn("__before", before).drop("__n")
    running = d.withColumn("__i", F.sum(value).over(Window.partitionBy(*part, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    condition = F.lit(True)
    for k in [*part, "__b"]:
        condition = condition & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return running.alias("l").join(shifted.alias("r"), condition).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r.__before") + F.col("l.__i")).alias(out))
