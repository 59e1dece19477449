import random
from decimal import Decimal

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.values import canonical_value
from weftline.operators import reconcile as R
from weftline.operators.run_diffs import run_differences

BUNDLES = "example_id string, golden_records array<map<string,string>>, run_status string"
RUNS = "exec_id bigint, example_id string, run_status string, output_records array<map<string,string>>, received_at timestamp, golden_records string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, R.P - R.RESERVED), max_size=9), st.sets(st.integers(0, R.P - R.RESERVED), max_size=9), st.sets(st.integers(0, R.P - R.RESERVED), max_size=9))
def test_decode_recovers_every_difference(common, left, right):
    left, right = left - right - common, right - left - common
    value = lambda s, x: __import__("functools").reduce(lambda a, h: a * (x - h) % R.P, s, 1)
    bound = 2
    while True:
        xs = [R.P - 1 - i for i in range(bound + R.CHECKS)]
        ratios = [value(common | left, x) * pow(value(common | right, x), -1, R.P) % R.P for x in xs]
        found = R.decode(ratios, len(left) - len(right), bound)
        if found is not None:
            break
        bound *= 2
        assert bound <= 64
    assert found == (sorted(left), sorted(right))


def test_roots_of_repeated_and_unsplit_polynomials():
    assert R.roots([9, -6 % R.P, 1]) == [3]
    assert R.roots([1, 0, 1]) is None  # -1 is no square modulo this prime
    cubic = [-125 % R.P, 75, -15 % R.P, 1]
    assert R.roots(cubic) == [5]


@pytest.mark.parametrize(("a", "b", "same"), [("1.50", " 15e-1 ", True), ("-0", "0", True), ("007", "7", True), ("1e3", "1000", True), ("  ", "", True), (" ", "", True), ("a", "A", False), ("1,5", "1.5", False), ("a ", "a", False), ("1e", "1", False), ("#1E0", "1", False), ("123456789012345678901234567890.10", "123456789012345678901234567890.1", True), ("+.5", "0.5", True), ("5.", "5", True), ("12", "12.0", True), ("120", "12e1", True), ("12\n", "12", True)])
def test_values(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_value(F.col("a")) == canonical_value(F.col("b"))).first()[0]
    assert r is same


def test_null_value_stays_null(spark):
    assert spark.createDataFrame([(None,)], "a string").select(canonical_value(F.col("a"))).first()[0] is None


def _truth(golden, output):
    def norm(v):
        if v is None:
            return None
        if not v.strip():
            return ""
        try:
            return Decimal(v.strip())
        except ArithmeticError:
            return v

    fields = lambda r: {k: norm(v) for k, v in r.items() if k not in ("row_key", "__meta")}
    g, o = ({r["row_key"]: fields(r) for r in x} for x in (golden, output))
    out = {(k, "", "missing_in_output") for k in g.keys() - o.keys()} | {(k, "", "missing_in_golden") for k in o.keys() - g.keys()}
    for k in g.keys() & o.keys():
        out |= {(k, f, "value_differs") for f in g[k].keys() | o[k].keys() if g[k].get(f) != o[k].get(f) or (g[k].get(f) is None) != (o[k].get(f) is None)}
    return out


def test_random_runs_against_brute_force(spark):
    rng = random.Random(3)
    bundles, runs, expected = [], [], set()
    for b in range(6):
        n = [0, 1, 5, 40, 200, 3][b]
        golden = [{"row_key": f"K{i}", "a": str(rng.randrange(50)), "b": rng.choice(["x", "", " ", None, "1.0"])} for i in range(n)]
        bundles.append((f"e{b}", golden, None))
        for r in range(3):
            output = [dict(x) for x in golden if rng.random() < [1, 0.9, 0.2][r]]
            for x in output:
                x["__meta"] = str(rng.random())
                if rng.random() < 0.2:
                    x["b"] = rng.choice(["y", "1", None, ""])
            output += [{"row_key": f"N{i}", "a": "1", "b": None} for i in range(rng.randrange(3))]
            rng.shuffle(output)
            runs.append((b * 10 + r, f"e{b}", "FINISHED_OK", output, None, "clash"))
            expected |= {(b * 10 + r, *d) for d in _truth(golden, output)}
    got = run_differences(spark.createDataFrame(bundles, BUNDLES), spark.createDataFrame(runs, RUNS))
    assert set(rows(got)) == expected


def test_edge_runs(spark):
    from datetime import datetime

    row = {"row_key": "k", "a": "1"}
    bundles = [("e", [row], None), ("none", None, None), (None, [row], None), ("empty", [], None), ("nullrow", [None, {"row_key": None, "a": "1"}], None)]
    t = datetime(2030, 1, 1)
    runs = [
        (1, "e", "FINISHED_OK", [], t, ""), (2, "e", "ERROR", [], t, ""), (3, "e", "FINISHED_OK", None, t, ""), (4, "none", "FINISHED_OK", [row], t, ""),
        (5, "gone", "FINISHED_OK", [row], t, ""), (6, None, "FINISHED_OK", [row], t, ""), (None, "e", "FINISHED_OK", [], t, ""), (7, "empty", "FINISHED_OK", [row], t, ""),
        (8, "e", "FINISHED_OK", [row], t, ""), (8, "e", "FINISHED_OK", [], datetime(2029, 1, 1), ""), (9, "empty", "FINISHED_OK", [], t, ""), (10, "nullrow", "FINISHED_OK", [{"a": "2"}], t, ""),
    ]
    got = rows(run_differences(spark.createDataFrame(bundles, BUNDLES), spark.createDataFrame(runs, RUNS)))
    assert got == [(1, "k", "", "missing_in_output"), (7, "k", "", "missing_in_golden"), (10, "", "a", "value_differs")]


def test_empty_tables(spark):
    got = run_differences(spark.createDataFrame([], BUNDLES), spark.createDataFrame([], RUNS))
    assert got.columns == ["exec_id", "row_key", "field_name", "diff_kind"] and got.count() == 0


def test_shared_left_set_and_collision_fallback(spark, monkeypatch):
    """Two rows with one field hash but different contents: the checksum notices, the bucket is fetched whole."""
    real = R.hashed_rows
    monkeypatch.setattr(R, "hashed_rows", lambda rows, ignored=(): real(rows, ignored).withColumn("h", F.lit(7).cast("bigint")))
    left = spark.createDataFrame([("s", "a", {"f": "1"}), ("s", "b", {"f": "2"})], "set_id string, row_key string, fields map<string,string>")
    right = spark.createDataFrame([(1, "a", {"f": "1"}), (1, "b", {"f": "3"})], "set_id bigint, row_key string, fields map<string,string>")
    pairs = spark.createDataFrame([(1, "s", 1)], "pair_id bigint, left_id string, right_id bigint")
    assert rows(R.reconcile(pairs, left, right)) == [(1, "b", "f", "value_differs")]
