"""Session factory and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "weftline", **conf: str) -> SparkSession:
    """A UTC session with AQE; ``conf`` keys use double underscores for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where the setting may be absent.

    On a cluster a machine's own folder would lose data with its executor, so a missing setting raises there. Sessions of
    ``build_session`` remove checkpoints that nothing refers to any more.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="weftline-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage; survives the loss of executors.

    The origin's constraints are dropped as well: carried from round to round they make planning of iterative
    jobs exponential.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def widen(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions, as a small file has; larger inputs stay as they are read.

    For scans and projections before costly work per row in Python.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df._jdf.queryExecution().toRdd().getNumPartitions() < wanted else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed over two partitions for each core; adaptive execution does not merge them.

    For rows that are few in bytes but costly in Python, where many small tasks would each set up their own state.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


T = TypeVar("T")


def share(spark: SparkSession, value: T) -> Callable[[], T]:
    """Broadcast ``value`` by value, classes included; the result gives it back within a task. Only for bounded data."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
