"""Similar texts without stored shingle sets: what is kept on disk, and the gate against all pairs."""

import pathlib
import random

from pyspark.sql import functions as F

from weftline.operators import pipelines, similarity


def _set(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_gate_against_all_pairs_and_what_is_stored(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(10**6))
    lead = [word() for _ in range(40)]
    texts = [" ".join(lead[: rng.randrange(0, 40)] + [word() for _ in range(300)]) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").cache()
    a, b = rows.where("doc_id % 10 = 0"), rows.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("o"), F.col("text").alias("u"))
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = stored()
    got = tuple(similarity.gate(a, b, "doc_id", "o", "text", "u", 0.8).first())
    classes = similarity.near_duplicate_classes(rows).collect()
    assert stored() - before < sum(map(len, texts)) / 2
    sets = [_set(t) for t in texts]
    best = [max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(200) if j % 10) for i in range(0, 200, 10)]
    assert got == (20, sum(x > 0 for x in best), max(best), 0, True)
    assert all(r.class_id == r.doc_id and r.links == 0 for r in classes)


def test_pool_and_what_is_stored(spark):
    rng = random.Random(4)
    texts = [" ".join("w" + str(rng.randrange(10**6)) for _ in range(300)) for _ in range(120)]
    texts[11] = texts[10][:-3] + "end"  # a close text on the other side
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").cache()
    tests = spark.createDataFrame([("x", texts[7])], "item_id string, prompt string")
    classes, held = rows.select("doc_id", F.col("doc_id").alias("class_id")), rows.select("doc_id", (F.col("doc_id") % 10 == 0).alias("held"))
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = stored()
    pool, report = pipelines.executable_pool(rows, tests, classes, held, "doc_id", "text", "item_id", "prompt")
    assert sorted(tuple(r) for r in pool.collect()) == [(i, i, i % 10 == 0) for i in range(120) if i != 7]
    a, b = _set(texts[10]), _set(texts[11])
    assert tuple(report.first()) == (12, 1, len(a & b) / len(a | b), 1, False)
    assert stored() - before < sum(map(len, texts)) / 2
