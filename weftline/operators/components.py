"""Connected components by random-mate contraction.

Each round every vertex tosses a coin, tails with a head among their neighbours are merged into it, edges are renamed and
made distinct, until none is left. The merges form a forest of at most as many levels as there were rounds; unwinding
it by pointer doubling labels every vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.scale import is_small, sized_join
from weftline.session import cut


def contract(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex that random-mate contraction merged; ``edges`` has u and v.

    Each round costs one shuffle for the merges and one for the renamed edges; merges are broadcast while they are few, else
    joined in salted parts. Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    edges = cut(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    merges: DataFrame | None = None
    turn, small = 0, False
    while not edges.isEmpty():
        # Merges have no more vertices than the edges have ends; edges only become fewer, so they are measured until they are small.
        small = small or is_small(edges.unionByName(edges))
        heads = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 1  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        merged = cut(both.where(~heads("u") & heads("v")).groupBy("u").agg(F.min("v").alias("into")))
        merges = merged if merges is None else merges.unionByName(merged)
        renamed = edges
        for side in ("u", "v"):
            renamed = sized_join(renamed, merged.select(F.col("u").alias(side), F.col("into").alias("_into")), [side], "left", small=small)
            renamed = renamed.withColumn(side, F.coalesce("_into", side)).drop("_into")
        edges = cut(renamed.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        turn += 1
    if merges is None:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    forest = cut(merges.select(F.col("u").alias("vertex"), F.col("into").alias("root")))
    depth, small = 1, is_small(forest)
    while depth < turn:  # a path has one level for each round at most
        up = forest.select(F.col("vertex").alias("root"), F.col("root").alias("_up"))
        forest = cut(sized_join(forest, up, ["root"], "left", F.xxhash64("vertex"), small).select("vertex", F.coalesce("_up", "root").alias("root")))
        depth *= 2
    return forest
