import random

from weftline.operators.neighbours import sorted_neighbours


def test_against_brute_force(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(200)})
    rows = [(k, None if i % 7 == 0 else i % 5 == 0 and not 60 < i < 120, i) for i, k in enumerate(keys)]
    got = {r["k"]: (r["before"], r["after"]) for r in sorted_neighbours(spark.createDataFrame([*rows, (None, True, 0)], "k string, m boolean, _x int").repartition(7), "k", "m").collect()}
    marked = [k for k, m, _ in rows if m]
    assert got == {k: (max((x for x in marked if x < k), default=None), min((x for x in marked if x > k), default=None)) for k in keys}


def test_empty(spark):
    assert sorted_neighbours(spark.createDataFrame([], "k string, m boolean"), "k", "m").count() == 0
