from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators.components import contract
from weftline.operators.scale import distributed_row_number, distributed_running_sum, global_row_number, hash_bucket, hot_keys, is_small, salted_join, sized_join


def test_salted_join_equals_plain_join(spark):
    many = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 97 == 1, None).otherwise(F.col("id") % 50)).alias("k"), "id")
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(many, one, ["k"], how, least=100).fillna(-1)) == rows(many.join(one, "k", how).fillna(-1))
    assert hot_keys(many, ["k"], least=100).count() == 1


def test_sized_join_either_way(spark):
    many, one = spark.range(100).select((F.col("id") % 7).alias("k"), "id"), spark.range(5).select(F.col("id").alias("k"), F.lit("t").alias("v"))
    assert is_small(one) and is_small(one.where("false")) and not is_small(one.withColumn("v", F.repeat(F.lit("x"), 3 << 20)))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(sized_join(many, one, ["k"], how, small=True).fillna("")) == rows(sized_join(many, one, ["k"], how, small=False).fillna(""))


def test_global_row_number(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 11).alias("v"), "id", F.lit(1).alias("_p0")).repartition(5)
    got = rows(global_row_number(df, [F.col("v").desc(), F.col("id")]), "id", "rn")
    assert got == rows(df.select("id", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).alias("rn")))
    assert rows(global_row_number(df.where("false"), [F.col("id")])) == []


def test_distributed_ranks_equal_windows(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 4).alias("p"), (F.col("id") * 37 % 101).alias("v"))
    got = distributed_row_number(df, ["p"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 10).cast("int"), 11)
    assert rows(got.select("id", "rn")) == rows(df.select("id", F.row_number().over(Window.partitionBy("p").orderBy("v", "id")).cast("bigint").alias("rn")))
    run = distributed_running_sum(df, ["p"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 10).cast("int"), 11, "v")
    want = df.select("id", F.sum("v").over(Window.partitionBy("p").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(run.select("id", "running")) == rows(want)
    assert df.select(hash_bucket(16, "id").alias("b")).where("b < 0 or b > 15").count() == 0


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            parent[find(u)] = find(v)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_contraction(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(200)]
    edges = [*chain, *star, ("x", "x"), (None, "y"), ("p", "q"), ("p", "q"), ("q", "p")]
    forest = contract(spark.createDataFrame(edges, "u string, v string"))
    groups = {}
    for vertex, root in rows(forest):
        groups.setdefault(root, {root}).add(vertex)
    assert {frozenset(g) for g in groups.values()} == _components(edges)
    assert contract(spark.createDataFrame([], "u string, v string")).count() == 0
