"""Writers: JSON lines, preference and conversation records, delimited text, partitioned and capped output."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.identity import upsert
from weftline.sources.metadata import encode_cells


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines added through the commit protocol: a failed job leaves nothing behind."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_preferences(df: DataFrame, path: str) -> None:
    """Preference records; an empty system text is left out of its record."""
    df.withColumn("system", F.nullif("system", F.lit(""))).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_conversations(df: DataFrame, path: str, messages: str = "messages", extra: Sequence[str] = ()) -> None:
    df.select(F.to_json(F.struct(messages, *extra)).alias("value")).write.mode("overwrite").text(path)


def split_invalid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with ``reason``) for a dead-letter output."""
    d = df.withColumn("reason", reason)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def write_delimited(df: DataFrame, path: str, sep: str = "|", null: str = "__NULL__") -> None:
    """Quoted text with a header, nulls as a mark and empty text kept."""
    encode_cells(df, null).write.mode("overwrite").option("sep", sep).option("quoteAll", "true").option("escape", '"').option("header", "true").option("emptyValue", "").csv(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], per_file: int = 0, without: Sequence[str] = ()) -> None:
    """One folder for each key, files of at most ``per_file`` records."""
    df.drop(*without).write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", per_file).parquet(path)


def capped(df: DataFrame, expected: int) -> tuple[DataFrame, int]:
    """Output cut at max(1000, ten times what is expected), a guard against runaway writers, with the cap."""
    cap = max(1000, 10 * expected)
    return df.limit(cap), cap


def merge_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All inputs in one, columns by name, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_provenance(df: DataFrame, path: str, without: Sequence[str] = ("prompt", "system", "chosen", "rejected")) -> None:
    """The second projection of a pair table: all but its texts, one JSON line for each pair."""
    append_json(df.drop(*without), path)


def write_flat(df: DataFrame, path: str, keys: Sequence[str] = (), per_file: int = 0, without: Sequence[str] = (), skip: int = 0, most: int | None = None, append: bool = False, sep: str = "|", null: str = "__NULL__") -> None:
    """Delimited text with a header in each file: a folder for each key, files of at most ``per_file`` records, fields left out, the
    first ``skip`` rows passed over and at most ``most`` written, added to what is there or in its place."""
    rows = df.offset(skip) if skip else df
    rows = rows if most is None else rows.limit(most)
    cells = encode_cells(rows.drop(*without), null)
    writer = cells.write.mode("append" if append else "overwrite").option("sep", sep).option("quoteAll", "true").option("escape", '"').option("header", "true").option("emptyValue", "").option("maxRecordsPerFile", per_file)
    (writer.partitionBy(*keys) if keys else writer).csv(path)


def insert_missing(new: DataFrame, path: str, keys: Sequence[str], version: str) -> str:
    """The table at ``path`` with the new rows whose key it lacks, of repeated new keys one; written as ``path-version``."""
    old = new.sparkSession.read.parquet(path)
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns)
    target = f"{path}-{version}"
    old.unionByName(fresh).write.mode("errorifexists").parquet(target)
    return target


def rewrite(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``, which ``df`` may read; its first state is kept beside it as ``path.bak``, once."""
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    if system.exists(at(f"{path}.bak")):
        system.delete(at(path), True)
    else:
        system.rename(at(path), at(f"{path}.bak"))
    if not system.rename(at(f"{path}.new"), at(path)):
        raise OSError(f"cannot move the new state to {path}")


def register(spark: SparkSession, path: str, name: str, entry: dict) -> dict:
    """Adds or replaces an entry of a registry of datasets, one JSON object; other entries stay. The new file takes the old one's place whole."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    known = json.loads(spark.read.text(path, wholetext=True).first()[0]) if system.exists(at(path)) else {}
    known[name] = entry
    stream = system.create(at(f"{path}.new"), True)
    stream.write(bytearray(json.dumps(known, indent=1, sort_keys=True, ensure_ascii=False).encode()))
    stream.close()
    system.delete(at(path), False)
    system.rename(at(f"{path}.new"), at(path))
    return known


def markdown_table(df: DataFrame, order: Sequence[str]) -> list[str]:
    """Lines of a Markdown table; for summaries, whose rows are groups, as they come to the driver."""
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|")
    rows = df.orderBy(*order).collect()
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def upsert_table(new: DataFrame, path: str, keys: Sequence[str], order: str, version: str) -> str:
    """The table at ``path`` with new rows merged, written beside it as ``path-version``; never overwrites what it reads."""
    spark = new.sparkSession
    target = f"{path}-{version}"
    upsert(spark.read.parquet(path), new, keys, order).write.mode("errorifexists").parquet(target)
    return target
