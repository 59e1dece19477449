"""Rule checks over tables and ordered comparison with golden rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rules(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, passed, offenders, first_offender): all rules in one pass; a null condition offends."""
    bad = {name: ~F.coalesce(c, F.lit(False)) for name, c in rules.items()}
    aggs = [x for name, b in bad.items() for x in (F.count_if(b).alias(f"n_{name}"), F.min(F.when(b, F.col(key))).alias(f"k_{name}"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), (F.col(f"n_{n}") == 0).alias("passed"), F.col(f"n_{n}").alias("offenders"), F.col(f"k_{n}").alias("first_offender")) for n in rules])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def compare_ordered(actual: DataFrame, expected: DataFrame, order: str, case: str = "case") -> DataFrame:
    """(case, status, place): rows of each case compared place by place; place is the first difference, null if none.

    ``order`` numbers the rows of a case from 1; other columns are compared with nulls being equal.
    """
    fields = [c for c in expected.columns if c not in (case, order)]
    a = actual.select(case, order, F.struct(*fields).alias("_a"), F.lit(True).alias("_in_a"))
    e = expected.select(case, order, F.struct(*fields).alias("_e"), F.lit(True).alias("_in_e"))
    both = a.join(e, [case, order], "full")
    same = F.coalesce(F.col("_in_a") & F.col("_in_e") & F.col("_a").eqNullSafe(F.col("_e")), F.lit(False))
    out = both.groupBy(case).agg(F.min(F.when(~same, F.col(order))).alias("place"))
    return out.select(case, F.when(F.col("place").isNull(), "pass").otherwise("mismatch").alias("status"), "place")
