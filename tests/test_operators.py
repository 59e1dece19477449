import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from weftline.functions import strict as C
from weftline.functions import text as T
from weftline.operators import chat, identity, pairs, records, rules, selection, similarity


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, "  a b\n\tc ", T.normal_space) == "a b c"
    assert one(spark, None, T.normal_space) == ""
    assert one(spark, "a  b", T.content_id) == one(spark, " a b ", T.content_id)
    assert one(spark, "one two three four five six", lambda c: F.array_sort(T.shingles(T.word_list(c)))) == ["one two three four five", "two three four five six"]
    assert one(spark, "one two", lambda c: T.shingles(T.word_list(c))) == []
    text = "x\n```ctl\n//#A\nfunction f() {}\n```\ny\n```py\nz\n```"
    assert one(spark, text, T.main_block) == "//#A\nfunction f() {}"
    assert one(spark, 'a = f("g(1)"); // h(2)\nfunction integer k() { m(); k(); }', T.called_functions) == ["f", "m"]
    split = lambda v, on=True: tuple(one(spark, v, lambda c: T.split_thinking(c, on)))
    assert split("<think>a</think>b</think> c ") == ("a</think>b", "c")
    assert split("cut off") == ("cut off", "") and split("plain", False) == ("", "plain")
    r = one(spark, "ISSUES:\n- ERROR: a\n- WARNING: b\nVERDICT: PASS\nVERDICT: FAIL", T.parse_review)
    assert (r.errors, r.warnings, r.verdict, r.verdicts, r.consistent) == (1, 1, "FAIL", 2, True)
    assert one(spark, "no review", T.parse_review) is None
    assert one(spark, "a\nERROR x \nb", T.first_error) == "ERROR x"
    assert one(spark, 'see {"a": 1} end', lambda c: F.variant_get(T.salvage_json(c), "$.a", "int")) == 1
    assert one(spark, "no json", T.salvage_json) is None
    assert tuple(one(spark, "Keep this. Drop loss now. End.", lambda c: T.redact(c, "loss"))) == ("Keep this. End.", 1)


def test_strict_functions(spark):
    assert one(spark, "A😀", C.utf16_length) == 3
    assert one(spark, None, lambda c: C.plus_text(F.lit("a"), c)) == "anull"
    assert one(spark, "banana", lambda c: C.last_index_of(c, "an")) == 3 and one(spark, "x", lambda c: C.last_index_of(c, "y")) == -1
    assert one(spark, -7, lambda c: C.divide(c, F.lit(2), True), "int") == -3
    assert one(spark, 1.0, lambda c: C.divide(c, F.lit(0.0), False), "double") == float("inf")
    assert one(spark, 2**31, C.wrap_int, "bigint") == -(2**31)
    assert one(spark, "hello", C.java_hash) == 99162322
    assert one(spark, "Příliš", C.without_diacritics) == "Prilis" and one(spark, None, C.without_diacritics) is None
    assert one(spark, "2025-02-30", C.is_date) is False
    assert one(spark, "kitten", lambda c: C.edit_distance(c, F.lit("sitting"), 1)) == 2
    with pytest.raises(Exception, match="null operand"):
        one(spark, None, lambda c: C.less(c, F.lit("a")))
    with pytest.raises(ValueError):
        C.sub_text(F.col("x"), -1, 2)


def test_chat(spark):
    turns = [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]
    df = spark.createDataFrame([(turns,)], "t array<struct<from:string,value:string>>").select(chat.from_share_form(F.col("t")).alias("m"))
    x = df.select(chat.single_exchange(F.col("m")).alias("x")).first().x
    assert (x.user, x.assistant, x.skip) == ("hi", "yo", None)
    m = [("assistant", "body", "why"), ("assistant", "<think>\nold\n</think>\n\nrest", None), ("user", "u", None)]
    df = spark.createDataFrame([(m,)], f"m {chat.MESSAGE}")
    once = df.select(chat.wrap_reasoning(F.col("m")).alias("m"))
    assert [t.content for t in once.first().m] == ["<think>\nwhy\n</think>\n\nbody", "<think>\nold\n</think>\n\nrest", "u"]
    assert once.select(chat.wrap_reasoning(F.col("m")).alias("m")).first() == once.first()
    assert spark.createDataFrame([(None,)], f"m {chat.MESSAGE}").select(chat.single_exchange(F.col("m")).alias("x")).first().x.skip == "no_messages"
    f = chat.from_instruction_form(F.lit(" do "), F.lit(""), F.lit("done"))
    assert spark.range(1).select(f.alias("m")).first().m[0].content == "do"


def test_identity(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 1), (4, None, 2)], "id int, k string, o int")
    assert rows(identity.keep_first(df, ["k"], ["o"]), "id") == [(2,), (3,)]
    a, b = df.select("k"), df.where("id <> 4").select("k")
    assert [tuple(r) for r in identity.multiset_difference(a, b).collect()] == [(None, "left", 1)]
    d = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c")], "x string, y string").select(identity.digest(F.col("x"), F.col("y")).alias("d"))
    assert d.distinct().count() == 4
    done = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert rows(identity.remaining(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), done, ["k"], 2)) == [("b",), ("c",)]


def _shingle_sets(texts):
    import re

    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [" ".join(rng.choice(["red", "green", "blue", "cyan", "pink"]) + str(rng.randrange(30)) for _ in range(60)) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(60)] = "new"
            texts.append(" ".join(v))
    texts += [base[0]] * 3 + [None, "", "too short", "Too  SHORT!", "another one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = _shingle_sets(texts)
    import re

    key = [(tuple(sorted(s)), " ".join(re.findall(r"\w+", (t or "").lower())) if len(re.findall(r"\w+", t or "")) < 5 else "") for s, t in zip(sets, texts)]
    n = len(texts)
    link = lambda i, j: key[i] == key[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    links = [sum(1 for j in range(n) if j != i and link(i, j)) for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link(i, j):
                    root[i] = root[j] = min(root[i], root[j])
    got = rows(similarity.near_duplicate_classes(df))
    assert got == [(i, root[i], links[i]) for i in range(n)]
    assert similarity.near_duplicate_classes(df.where("false")).count() == 0


def test_edit_similarity(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for a, b in [("Größe", "Grüsse"), ("", ""), ("abc", ""), ("same", "same")]:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.edit_similarity(F.col("a"), F.col("b"))).first()[0]
        assert got == pytest.approx(1 - distance(a, b) / max(len(a), len(b)) if max(len(a), len(b)) else 1.0)


def test_selection(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"))
    first = rows(selection.sample(df, "id", 10, "s"))
    assert first == rows(selection.sample(df.repartition(7), "id", 10, "s")) and len(first) == 10
    plan = spark.createDataFrame([("0", 5), ("1", None), ("9", 3)], "g string, quota bigint")
    got = selection.quota(df, plan, "g", "id", "s").groupBy("g").count()
    assert rows(got) == [("0", 5), ("1", 33)]
    assert rows(selection.shortfall(df, plan, "g"), "g", "short") == [("0", 0), ("1", 0), ("9", 3)]
    rr = selection.round_robin(df, "g", "id", 10, "s").groupBy("g").count()
    assert sorted(r[1] for r in rr.collect()) == [3, 3, 4]


def test_pairs_and_rules(spark):
    c = [("e", 1, "a wrong answer of some length", "L1_fail", 0.9, True, False), ("e", 2, "another wrong answer, longer", "L3_mismatch", None, True, False), ("e", 3, "short", "L3_mismatch", 1.0, True, False), ("f", 1, "The Chosen text  of this one", "L2_fail", None, True, False)]
    cand = spark.createDataFrame(c, "example_id string, idx int, text string, level string, confidence double, rejected boolean, correct boolean")
    chosen = spark.createDataFrame([("e", "right"), ("f", "the chosen text of this one")], "example_id string, chosen string")
    assert rows(pairs.build_pairs(cand, chosen), "example_id", "level") == [("e", "L3_mismatch")]
    assert pairs.build_pairs(cand, chosen, "all_pairs").count() == 2
    calls = spark.createDataFrame([("f", 2), ("f", 9), ("g", 1)], "name string, arity int")
    over = spark.createDataFrame([("f", 1, 2), ("f", 2, None)], "name string, least int, most int")
    assert rows(pairs.resolve_arity(calls, over)) == [("f", 2, 2, 2), ("f", 9, 1, 2), ("g", 1, 0, 0)]
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert rows(rules.check_rules(t, {"x": F.col("x").isNotNull(), "id": F.col("id") > 0}, "id")) == [("id", True, 0, None), ("x", False, 1, 2)]
    a = spark.createDataFrame([("t", 1, "a"), ("t", 2, None), ("u", 1, "z")], "case string, n int, v string")
    e = spark.createDataFrame([("t", 1, "a"), ("t", 2, None), ("u", 1, "z"), ("u", 2, "y")], "case string, n int, v string")
    assert rows(rules.compare_ordered(a, e, "n")) == [("t", "pass", None), ("u", "mismatch", 2)]


def test_records(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, v int")
    assert rows(records.route(df, [(F.col("v") > 10, 1), (F.col("v") > 1, 2)], 9), "id", "port") == [(1, 9), (2, 2), (3, 1)]
    good, bad = records.split_filter(df, F.col("v") > 10)
    assert (good.count(), bad.count()) == (1, 2)
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, l array<string>")
    assert sorted(map(str, records.expand(lists, F.col("l"), ["id"], placeholder=True).collect())) == sorted(map(str, [__import__("pyspark").sql.Row(id=1, item="a", ordinal=1, total=2), __import__("pyspark").sql.Row(id=1, item="b", ordinal=2, total=2), __import__("pyspark").sql.Row(id=2, item=None, ordinal=None, total=0), __import__("pyspark").sql.Row(id=3, item=None, ordinal=None, total=0)]))
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate("aabba")], "k string, o int, x string")
    assert [r[0] for r in records.islands(s, ["k"], ["o"], "x").orderBy("o").select("island").collect()] == [1, 1, 2, 2, 3]
    a = spark.createDataFrame([("1", "x", None), (None, "n", "m"), ("3", "c", "d")], "id string, p string, q string")
    b = spark.createDataFrame([("1", "x", None), (None, "n", "z"), ("4", "c", "d")], "id string, p string, q string")
    got = {(r[0], r[1], r[2]) for r in records.changes(a, b, ["id"], ["p", "q"]).collect()}
    assert got == {("1", "UNCHANGED", ""), (None, "UPDATE", "q"), ("3", "ONLY_A", ""), ("4", "ONLY_B", "")}
    h = records.hash_join(spark.createDataFrame([("A",), ("b",), (None,)], "k string"), spark.createDataFrame([("a", 2), ("a", 1), (None, 9)], "s string, v int"), [("k", "s")], ["v"], ignore_case=True)
    assert {(r[0], r[2]) for r in h.collect()} == {("A", 1), ("b", None), (None, 9)}


def test_clipped_level_in_blocks(spark):
    import random

    rng = random.Random(2)
    data = [("a" if i % 3 else "b", i, float(rng.randrange(10)), float(rng.randrange(10)) if rng.random() < 0.9 else None) for i in range(300)]
    want, level = [], {"a": 0.0, "b": 0.0}
    for k, i, x, y in data:
        raw = level[k] + x - (y or 0.0)
        level[k] = min(max(raw, 0.0), 10.0)
        want.append((k, i, level[k], max(0.0, raw - 10.0)))
    df = spark.createDataFrame(data, "k string, i int, x double, y double")
    for n in (1, 5):  # ranges over which a key goes on
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(n == 1).lower())
        assert rows(records.clipped_level(df.repartition(n), "k", ["i"], "x", "y", 10.0)) == sorted(want)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbered = df.select(F.when(F.col("k") == "a", 7).cast("bigint").alias("k"), "i", "x", "y")
    got = records.clipped_level(numbered, "k", ["i"], "x", "y", 10.0)
    assert rows(got.select(F.when(F.col("k") == 7, "a").otherwise("b"), "i", "level", "spill")) == sorted(want)


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("g"), (F.col("id") * 13 % 31).alias("v"))
    seen = {json.dumps(rows(selection.proportional(df.repartition(n), "g", "id", 40, "s"))) for n in (1, 3, 8)}
    assert len(seen) == 1
