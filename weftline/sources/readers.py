"""Readers of JSON, JSON lines and delimited text, with rejects beside the good rows, and configuration files."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.identity import keep_first

_CORRUPT = "_corrupt_record"


def list_inputs(patterns: Iterable[str], recursive: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Paths of glob patterns in order, each file once however it is named; patterns without a file raise.

    With a session the patterns may be on any file system it knows, else they are local.
    """
    out: dict[str, None] = {}
    for pattern in patterns:
        if spark is None:
            found = [os.path.realpath(p) for p in sorted(glob.glob(pattern, recursive=recursive))]
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            found = sorted(system.makeQualified(f.getPath()).toString() for f in system.globStatus(path) or [])
        if not found:
            raise FileNotFoundError(pattern)
        for path in found:
            out.setdefault(path)
    return list(out)


def _first_char(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return rows[0][0].lstrip()[:1] if rows else ""


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a file that is a JSON array, an object or JSON lines.

    Lines that do not parse, such as a torn last line, are rejects (or raise if ``strict``). Without a schema it is inferred.
    A pretty-printed array or object is read as a whole by one task, as its format demands.
    """
    head = _first_char(spark, path)
    multi = head == "[" or (head == "{" and not _parses(spark, path))
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", str(multi).lower()).option("columnNameOfCorruptRecord", _CORRUPT)
    if schema is not None:
        full = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        reader = reader.schema(full if strict else T.StructType([*full.fields, T.StructField(_CORRUPT, T.StringType())]))
    df = reader.json(path)
    if _CORRUPT not in df.columns:
        return df, df.where("false")
    df = df.persist()  # the reader refuses to give the torn lines alone
    return df.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT), df.where(F.col(_CORRUPT).isNotNull()).select(_CORRUPT)


def _parses(spark: SparkSession, path: str) -> bool:
    rows = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    try:
        json.loads(rows[0][0])
    except ValueError:
        return False
    return True


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that must be a JSON array of objects; anything else raises."""
    if _first_char(spark, path) != "[":
        raise ValueError(f"{path}: not a JSON array")
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)


def is_training_set(df: DataFrame) -> bool:
    """Whether the rows hold conversation turns under one of their usual names."""
    return any(isinstance(f.dataType, T.ArrayType) and f.name in ("messages", "conversations", "conversation") for f in df.schema.fields)


def training_sets(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Those of the JSON files that hold conversations; only schemas are looked at."""
    return [p for p in paths if is_training_set(read_records(spark, p)[0])]


def read_prompts(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A prompt set of JSON lines, all of it or the rows of one split."""
    rows = read_records(spark, path)[0]
    return rows if split is None else rows.where(F.col("split") == split)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can open, by ranges of row ids in parallel; read only, nothing is locked."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    wanted = ", ".join(f'"{n}"' for n in names)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
            step = max(1, -(-(high - low + 1) // parts))
            for batch in batches:
                for part in batch["id"]:
                    cursor = db.execute(f'SELECT {wanted} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (low + part * step, low + (part + 1) * step))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(read, schema)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a run log, a YAML list of maps; it is small by nature and read on the driver. An absent or empty log has none."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("run logs in YAML need the yaml package") from e
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if _exists(spark, path) else ""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in yaml.safe_load(text) or []], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def log_history(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """(place, fields of ``entry``) of the log history in a trainer's state file."""
    state = spark.read.schema(f"log_history array<struct<{entry}>>").option("multiLine", "true").json(path)
    return state.select(F.posexplode("log_history").alias("place", "e")).select("place", "e.*")


def read_revision(spark: SparkSession, repository: str, revision: str, path: str) -> DataFrame:
    """(line, value) of a text file as it was at a revision of a version-controlled folder on the driver."""
    import subprocess

    text = subprocess.run(["git", "-C", repository, "show", f"{revision}:{path}"], check=True, capture_output=True).stdout.decode("utf-8", "replace")
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, value string")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", null: str = "__NULL__", header: bool = True, policy: str = "controlled", skip: int = 0, most: int | None = None, most_errors: int | None = None, after: tuple[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of quoted text. Policies: strict raises at a bad cell, controlled puts the row among the rejects, lenient makes it null.

    Empty text stays empty, only the mark is null; ``skip`` and ``most`` cut the good rows in file order. More than ``most_errors``
    bad rows raise; ``after``, a column and a value, reads on from where an earlier reading ended.
    """
    from weftline.sources.metadata import typed

    if policy not in ("strict", "controlled", "lenient"):
        raise ValueError(policy)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("sep", sep).option("quote", '"').option("escape", '"').option("header", str(header).lower()).option("nullValue", null).option("emptyValue", "").option("multiLine", "true").csv(path)
    rows = typed(raw, schema)
    bad = F.size("_bad") > 0
    if policy == "strict":
        good = rows.where(F.when(bad, F.raise_error(F.concat(F.lit("bad cells: "), F.array_join("_bad", ",")))).otherwise(F.lit(True))).drop("_bad")
    else:
        good = (rows.where(~bad) if policy == "controlled" else rows).drop("_bad")
    if most_errors is not None and (errors := rows.where(bad).count()) > most_errors:
        raise ValueError(f"{path}: {errors} bad rows, at most {most_errors} allowed")
    good = good.where(F.col(after[0]) > F.lit(after[1])) if after else good
    good = good.offset(skip) if skip else good
    rejects = rows.where(bad) if policy == "controlled" else rows.where("false")
    return (good if most is None else good.limit(most)), rejects


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """JSON, JSON lines, TSV, semicolon or comma text by suffix, untyped columns for the last three."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".json", ".jsonl"):
        return read_records(spark, path)[0]
    sep = {".tsv": "\t", ".del": ";", ".csv": ","}.get(suffix)
    if sep is None:
        raise ValueError(f"unknown suffix {suffix!r}")
    return spark.read.option("sep", sep).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def read_shards(spark: SparkSession, paths: list[str] | str, keys: list[str], schema: str) -> DataFrame:
    """JSON lines of several shard files; of equal keys the last file's last line holds."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "_file", "_block", "_line").where("r is not null").select("r.*", "_file", "_block", "_line")
    kept = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    return keep_first(kept, keys, [F.col("_file").desc(), F.col("_block").desc(), F.col("_line").desc()]).drop("_file", "_block", "_line")


def harvest_prompts(df: DataFrame, column: str = "value") -> DataFrame:
    """User texts anywhere in JSON documents, under their usual keys; a table function of the engine walks the tree once."""
    names = '["user","prompt","instruction","question","human"]'
    texts = df.select(F.explode(_json_texts(F.col(column))).alias("t")).select("t.path", "t.text")
    return texts.where(F.array_contains(F.from_json(F.lit(names), "array<string>"), F.lower("path"))).select(F.col("text").alias("prompt"))


def _json_texts(column):
    @F.pandas_udf("array<struct<path:string,text:string>>")
    def walk(values: pd.Series) -> pd.Series:
        def visit(x, key):
            if isinstance(x, dict):
                role = x.get("role") or x.get("from")
                for k, v in x.items():
                    yield from visit(v, role if k in ("content", "value", "text") and isinstance(role, str) else k)
            elif isinstance(x, list):
                for v in x:
                    yield from visit(v, key)
            elif isinstance(x, str):
                yield {"path": key or "", "text": x}

        def one(text):
            try:
                return list(visit(json.loads(text), None)) if text else []
            except (ValueError, RecursionError):
                return []

        return values.map(one)

    return walk(column)


def deep_merge(base: dict, over: dict) -> dict:
    """Nested settings, the right side winning."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def expand_settings(value, env: dict[str, str] | None = None):
    """Settings with ${NAME} and $NAME replaced from the environment, at any depth; unknown names stay."""
    from string import Template

    env = os.environ if env is None else env
    if isinstance(value, str):
        return Template(value).safe_substitute(env)
    if isinstance(value, dict):
        return {k: expand_settings(v, env) for k, v in value.items()}
    return [expand_settings(v, env) for v in value] if isinstance(value, list) else value
