"""Streaming forms of the batch operators: an extension, as the batch rules have no clock of their own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.identity import upsert
from weftline.session import scratch


def file_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 16) -> DataFrame:
    """New parquet files under ``path`` (a folder or glob) as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, keys: Sequence[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def window_counts(stream: DataFrame, ts: str, keys: Sequence[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, keys, n, total) of tumbling windows."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch, from state kept for each key."""
    kind = dict(stream.dtypes)[key]

    def update(key_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [key_[0]], "n": [n], "total": [total]})

    return stream.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def upsert_into(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str):
    """Merges each batch into versioned folders under ``path``; a batch that is repeated writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v{number}"
        rows = batch if number == 0 else upsert(spark.read.parquet(f"{path}/v{number - 1}"), batch, keys, order)
        upsert(rows.where("false"), rows, keys, order).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available now into a folder of the shared checkpoint directory and reads that."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
