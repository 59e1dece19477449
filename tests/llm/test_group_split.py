import pytest
from helpers import rows, table
from pyspark.sql import functions as F

from weftline.llm import group_split as G

SCHEMA = "rec_id bigint, id string, source_file string, meta map<string,string>, root string, vertex int"


def _df(spark, data):
    return spark.createDataFrame([(i, None if i is None else f"E{i}", f, None if a is None else {"author": a}, "clash", 1) for i, f, a in data], SCHEMA)


def test_related_rows(spark):
    data = [
        (1, "d/B.jsonl", "Ann "), (2, r"x\b.JSONL ", None), (3, "c.jsonl", "ann"), (4, None, "ANN"), (5, None, "unknown"), (6, "", "n/a"), (7, "z", ""), (8, "y/", "solo"),
        (9, None, None), (None, "c.jsonl", "ann"), (10, "c.jsonl", "ann"), (10, "c.jsonl", "ann"),
    ]
    assert rows(G.group_files(_df(spark, data))) == [(1, "b.jsonl"), (2, "b.jsonl"), (3, "b.jsonl"), (4, "b.jsonl"), (7, "z"), (10, "b.jsonl")]
    assert rows(G.group_files(_df(spark, []))) == []
    whole = G.related_rows(_df(spark, data)).select("rec_id", "root").distinct()
    assert whole.count() == 10 and whole.select("root").distinct().count() == 6


def test_salted_rounds_give_the_same(spark, monkeypatch):
    from weftline.operators import scale

    df = table(spark, "source_examples")
    want = rows(G.group_files(df))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", -1)
    assert rows(G.group_files(df)) == want


def test_splits_keep_groups_and_meet_shares(spark):
    src, bundles, targets = (table(spark, t) for t in ("source_examples", "setup_bundles", "split_targets"))
    # many small groups beside one that holds a third of all rows
    data = [(i, "hot.jsonl" if i % 3 == 0 else f"f{i // 5}.jsonl", None) for i in range(3000)]
    b = spark.createDataFrame([(f"e{i}", ["Roll-Up", "ROLL UP", "map"][i % 3]) for i in range(0, 3000, 2)], "example_id string, component_type string")
    out = G.assign_splits(_df(spark, data), b, targets).cache()
    assert out.count() == 3000
    assert out.groupBy("root").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    report = {(r.component_type, r.split_name): r.share_pm for r in G.split_report(out, targets).collect()}
    for kind in ("*", "ROLLUP", "MAP", ""):
        for name, want in (("train", 800), ("validation", 100), ("test", 100)):
            assert abs(report[kind, name] - want) <= 40, (kind, name, report)
    assert G.assign_splits(src, bundles, targets).count() == src.count()
    assert G.assign_splits(_df(spark, []), b, targets).count() == 0
    with pytest.raises(ValueError):
        G.assign_splits(src, bundles, targets.where("false"))
