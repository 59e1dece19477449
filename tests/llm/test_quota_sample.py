import numpy as np
from helpers import rows, table

from weftline.llm import quota_sample as Q

PROV = "pair_id bigint, example_id string, rejected_exec_level string, rejected_failure_modes array<string>, logged_at timestamp, cell string, rn int"
BUNDLES = "example_id string, component_type string"
TARGETS = "category_kind string, category_value string, target_pm int, min_rows int"


def _inputs(spark):
    from datetime import datetime

    t = datetime(2030, 1, 1)
    prov = []
    for i in range(1, 1001):
        prov.append((i, "hot" if i % 3 == 0 else f"e{i % 50}", ["L1_fail", "l2 FAIL", None, "l2-fail"][i * 7 // 11 % 4] if i % 50 else "rare", [["a-b", "A B", "c"], [], None, ["c"]][i % 4], t, "clash", 1))
    prov += [prov[0], (1, "e1", "other", None, datetime(2029, 1, 1), "clash", 1), (None, "e1", "L1_fail", ["c"], t, "", 0)]
    bundles = [("hot", "Map")] + [(f"e{i}", "roll_up" if i % 2 else " ROLL-UP") for i in range(49)]
    targets = [("component_type", "MAP", 500, 5), ("component_type", "ROLLUP", 500, 5), ("rejected_exec_level", "L1_fail", 300, 3), ("rejected_exec_level", "L2_fail", 400, 3), ("rejected_exec_level", "Rare", 200, 7), ("failure_mode", "a_b", 400, 2), ("failure_mode", "none such", 10, 4), (None, "x", 1, 1)]
    return spark.createDataFrame(prov, PROV), spark.createDataFrame(bundles, BUNDLES), spark.createDataFrame(targets, TARGETS)


def test_unmet(spark):
    assert rows(Q.unmet_targets(*_inputs(spark))) == [("failure_mode", "none such"), ("rejected_exec_level", "Rare")]


def test_sample_size_shares_and_floors(spark):
    prov, bundles, targets = _inputs(spark)
    drawn = Q.draw_sample(prov, bundles, targets).cache()
    assert drawn.count() == 200 == drawn.select("pair_id").distinct().count()
    assert rows(drawn, "seat") == [(i,) for i in range(1, 201)]
    report = {(r.category_kind, r.category_value): r for r in Q.sample_report(prov, bundles, targets).collect()}
    assert report["rejected_exec_level", "Rare"].drawn == report["rejected_exec_level", "Rare"].available == 20
    for key, want in ((("component_type", "MAP"), 100), (("component_type", "ROLLUP"), 100), (("rejected_exec_level", "L1_fail"), 60), (("rejected_exec_level", "L2_fail"), 80), (("failure_mode", "a_b"), 80)):
        assert abs(report[key].drawn - want) <= 12, report[key]
    assert rows(Q.draw_sample(prov.repartition(7), bundles, targets), "pair_id") == rows(drawn, "pair_id")


def test_floor_records_come_first(spark):
    prov, bundles, targets = _inputs(spark)
    floors = spark.createDataFrame([("rejected_exec_level", "Rare", 0, 15)], TARGETS)
    drawn = Q.draw_sample(prov, bundles, floors)
    assert drawn.where("floor").count() == 15 and drawn.where("array_contains(cats, 'rejected_exec_level=RARE')").count() >= 15


def test_rake_follows_counts():
    inside = np.array([[1, 0], [0, 1], [0, 0]], bool)
    seats = Q.rake(inside, np.array([100.0, 4.0, 50.0]), np.array([20.0, 10.0]), 40)
    assert abs(seats[0] - 20) < 2 and seats[1] == 4.0


def test_seats_meet_what_can_be_met():
    rng = np.random.default_rng(5)
    for _ in range(30):
        inside = np.unique(rng.random((40, 7)) < 0.4, axis=0)
        counts = rng.integers(1, 9, len(inside)).astype(float)
        size = int(counts.sum()) // 3
        possible = np.floor(counts * rng.random(len(counts)))  # some allotment shows that goals below can be met
        while possible.sum() > size:
            possible[rng.choice(np.flatnonzero(possible))] -= 1
        goals = np.floor(possible @ inside * 0.9)
        whole = Q.allot(inside, counts, goals, size)
        assert whole.sum() == size and (whole >= 0).all() and (whole <= counts).all() and (whole == np.floor(whole)).all()
        assert (goals - whole @ inside).clip(0).sum() <= 1


def test_nothing_reported_as_met_is_missed(spark):
    for r in Q.sample_report(*_inputs(spark)).collect():
        assert r.missed == (r.drawn < r.required) and (r.missed or not r.short)
        assert r.missed == r.short, r


def test_empty_inputs(spark):
    prov, bundles, targets = _inputs(spark)
    assert Q.draw_sample(prov.where("false"), bundles, targets).count() == 0
    assert Q.draw_sample(prov, bundles.where("false"), targets.where("false")).count() == 200
    assert rows(Q.unmet_targets(prov, bundles, targets.where("false"))) == []


def test_test_tables(spark):
    args = [table(spark, t) for t in ("forged_provenance", "setup_bundles", "sample_targets")]
    assert Q.draw_sample(*args).count() == args[0].select("pair_id").distinct().count() // 5
