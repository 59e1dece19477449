"""Elementwise sums of arrays over all tasks, in pieces, so that no task holds more than a fixed number of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a piece and pieces that one task adds up; the driver gets one for each FAN * FAN tasks.
PIECE, FAN = 8192, 256
SCHEMA = "part int, w binary"


def pieces(array: np.ndarray) -> pd.DataFrame:
    """The pieces of a task's array that are not all zero."""
    flat = array.ravel()
    rows = [(p, flat[p * PIECE : (p + 1) * PIECE].tobytes()) for p in range(-(-len(flat) // PIECE)) if flat[p * PIECE : (p + 1) * PIECE].any()]
    return pd.DataFrame(rows, columns=["part", "w"]).astype({"part": "int32"})


def total(table: DataFrame, kind: str, size: int) -> np.ndarray:
    """The sum of all arrays of ``size`` whose pieces are the rows of ``table`` (part, w), as tasks wrote them."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        acc = np.frombuffer(group["w"].iloc[0], kind).copy()
        for b in group["w"].iloc[1:]:
            acc += np.frombuffer(b, kind)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "at": [group["at"].iloc[0]], "w": [acc.tobytes()]})

    level = table.select("part", "w", F.spark_partition_id().alias("at"))
    for _ in range(2):
        level = level.withColumn("at", F.floor(F.col("at") / FAN).cast("int")).groupBy("part", "at").applyInPandas(add, "part int, at int, w binary")
    out = np.zeros(size, kind)
    for r in level.collect():
        piece = np.frombuffer(r["w"], kind)
        out[r["part"] * PIECE : r["part"] * PIECE + len(piece)] += piece
    return out
