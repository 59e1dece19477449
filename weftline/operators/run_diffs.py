"""Golden rows of a bundle against the output rows of each run, over ``reconcile``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.reconcile import reconcile


def exploded(sets: DataFrame, set_id: str, records: str, key: str = "row_key") -> DataFrame:
    """(set_id, row_key, fields) of an ARRAY<MAP<STRING,STRING>> column; null records are skipped."""
    return (
        sets.select(F.col(set_id).alias("set_id"), F.explode(records).alias("r"))
        .where("r is not null")
        .select("set_id", F.try_element_at("r", F.lit(key)).alias("row_key"), F.map_filter("r", lambda k, _: k != key).alias("fields"))
    )


def run_differences(bundles: DataFrame, runs: DataFrame) -> DataFrame:
    """(exec_id, row_key, field_name, diff_kind) for finished runs with output whose bundle has golden records.

    Of rows delivered twice the one received last holds. Null exec_id, example_id, output or golden lists give
    nothing; an empty list is an empty set. See ``reconcile`` for what counts as a difference.
    """
    last = Window.partitionBy("exec_id").orderBy(F.col("received_at").desc_nulls_last())
    runs = (
        runs.select("exec_id", "example_id", "run_status", "output_records", "received_at")
        .where("exec_id is not null")
        .withColumn("_rn", F.row_number().over(last))
        .where("_rn = 1 and run_status = 'FINISHED_OK' and output_records is not null and example_id is not null")
    )
    bundles = bundles.select("example_id", "golden_records").where("example_id is not null and golden_records is not null")
    known = bundles.select(F.col("example_id").alias("left_id")).distinct()
    pairs = runs.select(F.col("exec_id").alias("pair_id"), F.col("example_id").alias("left_id"), F.col("exec_id").alias("right_id")).join(known, "left_id", "left_semi")
    found = reconcile(pairs, exploded(bundles, "example_id", "golden_records"), exploded(runs, "exec_id", "output_records"), ignored=("__meta",))
    kind = F.when(F.col("diff_kind") == "missing_in_right", "missing_in_output").when(F.col("diff_kind") == "missing_in_left", "missing_in_golden").otherwise(F.col("diff_kind"))
    return found.select(F.col("pair_id").alias("exec_id"), "row_key", "field_name", kind.alias("diff_kind"))
