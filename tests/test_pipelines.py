"""Pipelines and selections on edge cases: empty tables, nulls, ties, repeated rows."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from weftline.operators import chat, pairs, pipelines, records, selection
from weftline.operators.similarity import gate, take_fitting

SAMPLES = "prompt_id string, sample bigint, status string, text string"


def test_take_fitting_against_a_loop(spark):
    rng = random.Random(8)
    items = [(i, rng.choice("ab"), rng.randrange(1, 9), rng.random()) for i in range(120)]
    budget = {"a": 60, "b": 7}
    want = []
    for part, left in budget.items():
        for i, p, n, _ in sorted(items, key=lambda x: (x[3], x[0])):
            if p == part and n <= left:
                want.append((i, part, n))
                left -= n
    df = spark.createDataFrame(items, "i int, p string, n int, o double")
    got = take_fitting(df, spark.createDataFrame(list(budget.items()), "p string, left int"), "p", "i", "n", F.col("o"))
    assert rows(got) == sorted(want)
    assert take_fitting(df.where("false"), spark.createDataFrame([("a", 5)], "p string, left int"), "p", "i", "n", F.col("o")).count() == 0


def test_draws_wrap_around(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    got = sorted(selection.draws(df, "k", 17, "s").collect())
    assert [r.draw for r in got] == list(range(17)) and [sorted(r.k for r in got[a : a + 7]) for a in (0, 7)] == [list(range(7))] * 2
    assert selection.draws(df.where("false"), "k", 5, "s").count() == 0 and selection.draws(df, "k", 0, "s").count() == 0


def test_rarest_first_and_top(spark):
    df = spark.createDataFrame([(i, "often" if i < 8 else "rare" if i < 10 else None) for i in range(11)], "k int, g string")
    placed = [r.g for r in selection.rarest_first(df, "g", "k", "s").orderBy("place").collect()]
    assert placed == [None, "rare", "often", "rare", "often", *["often"] * 6]
    assert rows(selection.top_per_group(df, ["g"], [F.col("k").desc()], 1).fillna("-"), "k") == [(7,), (9,), (10,)]


def test_execution_rows(spark):
    data = [("p", 1, "pass", "a"), ("p", 2, None, "b"), ("p", 3, "late", "c"), ("all", 4, "pass", ""), ("none", 5, "late", ""), ("p", 6, "early", "d")]
    got = pipelines.execution_rows(spark.createDataFrame(data, SAMPLES), "s", 2, 0, ["late", "early"])
    assert rows(got.fillna(0)) == [("p", "dpo", 1, 3, "late"), ("p", "sft", 1, 0, "pass")]
    assert pipelines.execution_rows(spark.createDataFrame(data, SAMPLES), "s", 2, 2, ["late"]).where("kind = 'dpo'").count() == 0
    assert pipelines.execution_rows(spark.createDataFrame([], SAMPLES), "s").count() == 0


def test_prompt_sets(spark):
    make = lambda keys: spark.createDataFrame([(k, "t" if k[0] < "m" else "u") for k in keys], "prompt_id string, task string")
    got = pipelines.prompt_sets([("one", make(["a", "b", "x"]), 1), ("two", make(["b", "c"]), 3)], make(["x"]), make([*"abcdefgx", *"nopqrs"]), 0.5, {"t": 0.5, "u": 0.5}, "s")
    assert [(r.prompt_id, r["set"], r.weight) for r in got.where("set <> 'replay'").orderBy("prompt_id").collect()] == [("a", "one", 1), ("b", "one", 1), ("c", "two", 3)]
    replay = rows(got.where("set = 'replay'"), "prompt_id", "task")
    assert len(replay) == 4 and {t for _, t in replay} == {"t", "u"} and not {k for k, _ in replay} & set("abcx")


def test_retry_and_repair(spark):
    data = [("t", 1, "fail", "x"), ("t", 2, "pass", "As you said it failed. The row is kept as it came in."), ("u", 1, "pass", "y"), ("v", 1, None, "z"), ("v", 2, "pass", None), ("w", 1, "fail", ""), ("w", 2, "pass", "You said so. ok")]
    got = pipelines.retry_rows(spark.createDataFrame(data, "task_id string, round int, status string, text string"), "(?i)you said")
    assert rows(got, "task_id", "text", "outcome") == [("t", "The row is kept as it came in.", "kept"), ("v", "", "shrunk"), ("w", "ok", "shrunk")]
    queue = spark.createDataFrame([("k", "b", "a long enough text"), ("k", "b", "A long  enough text"), ("k", "a", "another long text"), ("k", "c", "not wanted at all"), ("l", "a", "short"), ("m", "a", None)], "key string, level string, text string")
    assert [(r.level, r.variants) for r in pipelines.repair_candidates(queue, "key", "level", "text", ["a", "b"], 10).orderBy("place").collect()] == [("a", 2), ("b", 2)]


def test_small_pipelines(spark):
    s = spark.createDataFrame([("p", 1, "a", "E"), ("p", 2, "a", "E"), ("p", 3, "a", "ok"), ("q", 4, "a", "E"), ("r", 5, None, "E")], SAMPLES)
    assert rows(pipelines.false_alarm_pairs(s, F.col("status") == "a", F.col("text") == "E", "s"), "chosen") == [(3,), (3,)]
    attempts = spark.createDataFrame([("a", 1, "pass", "self"), ("b", 1, "fail", "self"), ("b", 2, "pass", "self"), ("c", 1, "fail", "self"), ("c", 2, "pass", "judge"), ("d", 1, None, "self")], "task_id string, round int, status string, author string")
    assert rows(pipelines.self_corrections(attempts), "task_id", "outcome") == [("a", "first_pass"), ("b", "self_corrected"), ("c", "judge_fixed"), ("d", "failed")]
    a, b = spark.createDataFrame([(1, 1), (3, 2)], "k int, o int"), spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, o int")
    assert rows(pipelines.ordered_subset(a, b, "k", "o")) == [(True, True)] and rows(pipelines.ordered_subset(b, a, "k", "o"))[0][0] is False
    assert rows(pipelines.ordered_subset(a.where("false"), b, "k", "o")) == [(True, True)]
    assert rows(pipelines.lost_prompts(b, a, "k")) == [(2,)]
    empty = spark.createDataFrame([], "k int, t string")
    assert tuple(gate(empty, empty.withColumnRenamed("k", "r").withColumnRenamed("t", "u"), "k", "r", "t", "u", 0.3).first()) == (0, 0, 0.0, 0, True)


def test_shapes_and_mappings(spark):
    df = spark.createDataFrame([(1, None, "do", "x", "y"), (2, [("human", "q"), ("gpt", "a")], None, None, None), (3, None, " ", None, "z")], "id int, conversations array<struct<from:string,value:string>>, instruction string, input string, output string")
    got = {r.id: (r["shape"], None if r.messages is None else [m.content for m in r.messages]) for r in chat.one_shape(df).collect()}
    assert got == {1: ("instruction", ["do\n\nx", "y"]), 2: ("conversations", ["q", "a"]), 3: ("unknown", None)}
    assert records.key_mapping("$a=$b;$c#$x = $y") == [[("a", "b"), ("c", "c")], [("x", "y")]]
    with pytest.raises(ValueError):
        records.key_mapping("$a=;=")
    assert rows(pairs.mutants(spark.createDataFrame([(1, "aa")], "k int, c string"), "c", [("x", "a", "b"), ("none", "z", "b")])) == [(1, "aa", "x", "bb")]


def test_calls_out_are_repeated(spark):
    def flaky(batch, seen=[]):  # noqa: B006
        seen.append(1)
        if len(seen) == 1:
            raise OSError("not now")
        return batch

    assert records.call_out(spark.range(5).coalesce(1), flaky, "id bigint").count() == 5
    with pytest.raises(Exception, match="never"):
        records.call_out(spark.range(1), lambda b: (_ for _ in ()).throw(OSError("never")), "id bigint").count()
