"""Closed-form statistics as column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / F.nullif(n, F.lit(0))
    center = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / d
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * n)) / d
    return F.coalesce(center - half, F.lit(0.0)), F.coalesce(center + half, F.lit(0.0))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference p2 - p1 with the interval built from the two Wilson intervals."""
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    p1, p2 = k1 / n1, k2 / n2
    low = F.sqrt((p2 - l2) * (p2 - l2) + (u1 - p1) * (u1 - p1))
    high = F.sqrt((u2 - p2) * (u2 - p2) + (p1 - l1) * (p1 - l1))
    return p2 - p1, p2 - p1 - low, p2 - p1 + high


def normal_difference(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    p1, p2 = k1 / n1, k2 / n2
    se = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return p2 - p1, p2 - p1 - z * se, p2 - p1 + z * se


def histogram_quantile(df, part: list[str], value: str, index, out: str):
    """For each part the value at a 0-based ``index(n)`` of its sorted values, through counts of distinct values.

    Exact, and no task ever holds a group's rows: only distinct values travel. Nulls are left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*part)
    seen = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = counted.withColumn("_upto", seen).withColumn("_at", index(F.sum("_c").over(w)))
    return at.where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c"))).select(*part, F.col(value).alias(out))


def upper_median(n: Column) -> Column:
    """Index n div 2: the upper of two middle values, never their mean."""
    return F.floor(n / 2)


def low_decile(n: Column) -> Column:
    return F.floor((n - 1) * 0.1)


def high_decile(n: Column) -> Column:
    return F.ceil((n - 1) * 0.9)


def welch_difference(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference of two means with unequal variances, with its normal interval; undefined variances count as 0, without values all is null."""
    se = F.sqrt(F.try_divide(F.coalesce(v1, F.lit(0.0)), n1) + F.try_divide(F.coalesce(v2, F.lit(0.0)), n2))
    return m2 - m1, m2 - m1 - z * se, m2 - m1 + z * se


def clustered_difference(df, cluster: str, side: Column, value: Column, z: float = Z):
    """(difference, low, high, clusters) of side 1 less side 0: one paired difference for each cluster that has both sides; nulls without any."""
    one = df.groupBy(cluster).agg(F.avg(F.when(side == 0, value)).alias("_a"), F.avg(F.when(side == 1, value)).alias("_b")).where("_a is not null and _b is not null")
    d = one.select((F.col("_b") - F.col("_a")).alias("d")).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count(F.lit(1)).alias("n"))
    half = F.try_divide(z * F.coalesce(F.col("s"), F.lit(0.0)), F.sqrt("n"))
    return d.select(F.col("m").alias("difference"), (F.col("m") - half).alias("low"), (F.col("m") + half).alias("high"), F.col("n").alias("clusters"))


def paired_bootstrap(df, key: str, value: str, draws: int = 2000, seed: str = "boot"):
    """(mean, low, high, n): percentile interval of the mean of ``value`` over records from ``draws`` resamples.

    A resample gives each record a Poisson(1) count by hash, the distributed form of drawing with replacement; counts have
    no upper end but the hash's 53 bits. Each task sums its own records into ``draws`` pairs of numbers, so what is shuffled does
    not grow with the records. Give paired differences as ``value`` for the paired form. Nulls are left out.
    """
    import math

    steps, p, total = [], math.exp(-1), 0.0
    for k in range(20):
        total += p
        steps.append(total)
        p /= k + 1
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), key).alias("h"))
    u = F.shiftrightunsigned(F.xxhash64("h", "b"), 11) / F.lit(float(2**53))
    copies = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col("u")))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", u).withColumn("w", copies)
    means = drawn.groupBy("b").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    told = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).join(told).select("mean", "low", "high", "n")
