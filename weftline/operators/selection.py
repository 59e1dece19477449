"""Deterministic sampling, quotas and draws, ordered by SHA-256 of seed and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.scale import global_row_number


def hash_order(seed: str, *keys: str) -> Column:
    """A random but reproducible order of rows."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def sample(df: DataFrame, key: str, n: int, seed: str, offset: int = 0) -> DataFrame:
    """n rows after ``offset`` in hash order; a distributed top-k, not a global sort."""
    return df.orderBy(hash_order(seed, key), key).offset(offset).limit(n)


def ranked(df: DataFrame, part: Sequence[str], key: str, seed: str, first: Sequence[Column] = (), out: str = "rn", most: int | None = None) -> DataFrame:
    """Rank within ``part`` by ``first`` and then hash order; with ``most`` only ranks up to it.

    With a limit each task keeps that many rows of a part before the shuffle; without one the ranks are numbered over ranges, so
    a part with a third of all rows is no single task's either way.
    """
    order = [*first, hash_order(seed, key), F.col(key)]
    if most is None:
        return global_row_number(df, order, out, part)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(out) <= F.lit(most))


def quota(df: DataFrame, plan: DataFrame, group: str, key: str, seed: str, first: Sequence[Column] = ()) -> DataFrame:
    """Rows of each group within the plan's quota (a null quota takes all); groups without a plan are left out."""
    unlimited, most = plan.agg(F.count_if(F.col("quota").isNull()), F.coalesce(F.max("quota"), F.lit(0))).first()
    return ranked(df.join(plan, group), [group], key, seed, first, most=None if unlimited else int(most)).where("quota is null or rn <= quota").drop("rn", "quota")


def shortfall(df: DataFrame, plan: DataFrame, group: str) -> DataFrame:
    """(group, available, quota, short) for each row of the plan."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    told = plan.join(n, group, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    return told.select(group, "available", "quota", F.greatest(F.lit(0).cast("bigint"), F.col("quota") - F.col("available")).alias("short"))


def round_robin(df: DataFrame, strata: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows, one of each stratum in turn while it has any."""
    r = ranked(df, [strata], key, seed, most=n)
    return r.orderBy("rn", hash_order(seed, strata), strata).limit(n).drop("rn")


def balanced(df: DataFrame, label: str, key: str, n: int, seed: str) -> DataFrame:
    """n/2 rows of either label value, filled up from what is left over."""
    r = ranked(df, [label], key, seed, most=n)
    return r.orderBy(F.col("rn") > n // 2, hash_order(seed, key), key).limit(n).drop("rn")


def one_per_group(df: DataFrame, group: Sequence[str], key: str, seed: str) -> DataFrame:
    """A uniform pick of each group."""
    return ranked(df, group, key, seed, most=1).drop("rn")


def proportional(df: DataFrame, group: str, key: str, size: int, seed: str) -> DataFrame:
    """About ``size`` rows, each group by its share but with one row at least."""
    whole = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    shares = whole.join(whole.agg(F.sum("_n").alias("_all"))).withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(float(size)) * F.col("_n") / F.col("_all") + 0.5)))
    return quota(df, shares.select(group, "quota"), group, key, seed)


def stride(df: DataFrame, part: Sequence[str], order: Sequence[str], start: int, step: int, most: int) -> DataFrame:
    """Every ``step``-th row of each part from ``start`` (0-based), at most ``most`` of them."""
    first = df.withColumn("_i", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_i") <= F.lit(start + step * most))
    r = first.withColumn("_i", F.col("_i") - 1)
    return r.where((F.col("_i") >= start) & (F.pmod(F.col("_i") - start, F.lit(step)) == 0) & (F.col("_i") < start + step * most)).drop("_i")


def weighted(df: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its integer weight says; none, negative or null give no row."""
    return df.where(F.col(weight) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))))


def epochs(df: DataFrame, key: str, n_epochs: int, seed: str) -> DataFrame:
    """Draws without replacement, reshuffled each epoch: (epoch, place, key)."""
    e = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    return global_row_number(e, [F.sha2(F.concat_ws("|", F.lit(seed), "epoch", F.col(key).cast("string")), 256), F.col(key)], "place", ["epoch"])


def draws(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """(draw, epoch, place, key): ``n`` draws without replacement that wrap around; each epoch is a new order of all rows.

    Draw j is place j mod size of epoch j div size. No rows give none; repeated keys are drawn as often as they occur.
    """
    size = df.count()
    if size == 0 or n <= 0:
        return df.select(F.lit(0).cast("bigint").alias("draw"), F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("place"), key).where("false")
    placed = epochs(df, key, -(-n // size), seed)
    return placed.select((F.col("epoch") * F.lit(size) + F.col("place") - 1).cast("bigint").alias("draw"), "epoch", F.col("place").cast("bigint").alias("place"), key).where(F.col("draw") < n)


def rarest_first(df: DataFrame, group: str, key: str, seed: str, out: str = "place") -> DataFrame:
    """An order of all rows in which each group's i-th row comes before any group's i+1-th, rarer groups first among equals."""
    counted = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
    turned = ranked(df, [group], key, seed, out="_turn")
    sized = turned.join(counted, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return global_row_number(sized, [F.col("_turn"), F.col("_size"), F.col(group), F.col(key)], out).drop("_turn", "_size")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``; no task sends more than k rows of a group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= F.lit(k))


def cascade(df: DataFrame, categories: Sequence[tuple[str, Column, int]], key: str, seed: str) -> DataFrame:
    """Categories in order, each up to its quota, none from rows that an earlier category took."""
    taken: DataFrame | None = None
    for name, condition, n in categories:
        left = df.where(condition) if taken is None else df.where(condition).join(taken.select(key), key, "left_anti")
        picked = sample(left.select(key), key, n, seed).withColumn("category", F.lit(name))
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def zip_pairs(left: DataFrame, right: DataFrame, part: Sequence[str], left_key: str, right_key: str, seed: str, most: int | None = None) -> DataFrame:
    """The i-th row of either side within a part, in hash order; rows without a partner are left out."""
    a = ranked(left.select(*part, left_key), part, left_key, seed, most=most)
    b = ranked(right.select(*part, right_key), part, right_key, seed, most=most)
    return a.join(b, [*part, "rn"]).withColumnRenamed("rn", "pair")


def cycle_pairs(left: DataFrame, right: DataFrame, part: Sequence[str], left_key: str, right_key: str, seed: str) -> DataFrame:
    """Every left row with a right one, the right ones taken in turn and again."""
    a = ranked(left.select(*part, left_key), part, left_key, seed)
    b = ranked(right.select(*part, right_key), part, right_key, seed)
    n = right.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    turned = a.join(n, list(part)).withColumn("rn", (F.pmod(F.col("rn") - 1, F.col("_n")) + 1).cast("int"))
    return turned.join(b, [*part, "rn"]).select(*part, left_key, right_key)
