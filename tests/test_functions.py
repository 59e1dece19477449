"""Functions over answers, signatures and strict scalars on cases that the tables do not hold."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import answers as A
from weftline.functions import signatures as S
from weftline.functions import stats
from weftline.functions import strict as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("f(a, g(b, c), \"x,)\")", [("f", 3), ("g", 2)]), ("function integer f(string s) { return h(); }", [("h", 0)]), ("f(a /* , b */, // c)\n d)", [("f", 2)]),
        ("if (isnull(x)) { y(1, {2, 3}, [4, 5]); }", [("isnull", 1), ("y", 3)]), ("open(1, 2", []), ("a.b(1)", []), (None, []), ("", []), ('f("a\\"(", 1)', [("f", 2)]),
    ],
)
def test_calls(code, want):
    assert S.calls(code) == want


def test_calls_against_a_stack_machine(spark):
    rows = [("f(g(1,2),h(i(),3,4))",), (None,), ("x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(S.call_arities(F.col("c"))).collect()]
    assert [[(c.name, c.arity) for c in r] for r in got] == [[("f", 2), ("g", 2), ("h", 3), ("i", 0)], [], []]


def test_types_and_overloads():
    assert S.split_top("a, map<k, v>, f(x, y)", ",", "(<") == ["a", "map<k, v>", "f(x, y)"] and S.split_top("  ") == []
    assert S.parse_type("map<string, list<T>>") == ("map", ("string",), ("list", ("T",))) and S.parse_type("string[]") == ("list", ("string",))
    assert S.accepts(["T", "T"], ["integer", "number"]) == {"T": ("number",)}
    assert S.accepts(["T", "T"], ["string", "integer"]) is None and S.accepts(["T", "T"], ["string", "null"]) is not None
    assert S.accepts(["decimal"], ["integer"]) == {} and S.accepts(["integer"], ["decimal"]) is None
    assert S.accepts(["string", "any..."], ["string"]) == {} and S.accepts(["string", "integer..."], ["string", "long"]) is None
    assert S.accepts(["string|date"], ["date"]) == {} and S.accepts([], []) == {} and S.accepts([], ["string"]) is None
    assert S.shown(S.parse_type("map<K,list<V>>"), {"K": ("string",), "V": ("long",)}) == "map<string,list<long>>"


def test_runnable_code(spark):
    text = "<think>```ctl\nfunction integer no() {}\n```</think>\n```ctl\nfunction integer a() {}\n```\n```\nfunction integer b() {}\n```\n```json\n{}\n```"
    assert one(spark, text, A.runnable_code) == "//#CTL2\nfunction integer b() {}"
    assert one(spark, "no code", A.runnable_code) is None and one(spark, None, A.runnable_code) is None


def test_reviews(spark):
    assert tuple(one(spark, "- [ERROR] a\nVERDICT: PASS\nverdict : fail", A.loose_verdict)) == ("FAIL", "stated")
    assert tuple(one(spark, "- [INFO] a\n** pass **", A.loose_verdict)) == ("PASS", "alone")
    assert tuple(one(spark, "2) [Warning] a", A.loose_verdict)) == ("FAIL", "findings") and tuple(one(spark, None, A.loose_verdict)) == ("PASS", "findings")
    kept = one(spark, "- [ERROR] x, on a second look fine\n- [ERROR] y\nSUGGESTIONS\n- [ERROR] z", lambda t: A.standing_issues(t, "second look"))
    assert [i.text for i in kept.kept] == ["y"] and kept.dropped == 1 and kept.verdict == "FAIL"


def test_text_rules(spark):
    assert one(spark, "Write this. Keep each row.\n\n\n\nReturn the file. done", lambda t: A.without_instructions(t, ["Write", "Return"])) == "Keep each row.\n\n done".replace("\n\n done", "\n\n done")
    assert one(spark, None, lambda t: A.without_instructions(t, ["x"])) == ""
    assert tuple(one(spark, "", lambda t: A.length_to_stop(F.array(*map(F.lit, (5, 9, 2, 9))), [2, 9], 4))) == (1, False)
    assert tuple(one(spark, "", lambda t: A.length_to_stop(F.array(F.lit(5), F.lit(6)), [2], 2))) == (2, True)
    assert one(spark, "", lambda t: A.alternatives(F.array(F.lit("a"), F.lit("b")))) == "1) a  OR  2) b" and one(spark, "", lambda t: A.alternatives(F.array().cast("array<string>"))) == ""
    near = lambda text: one(spark, text, lambda t: A.nearby(t, {"n": r"\bnull\b"}, r"\bnot\b", r"\bjava\b"))
    assert near("It is null.") == ["n"] and near("It is not null.") == [] and near("null it is not") == [] and near("In Java it is null. Here null too.") == ["n"]


def test_strict_scalars(spark):
    url = "http://a.b:81/p?q=1#r"
    assert [one(spark, url, lambda t, w=w: C.url_part(t, w)) for w in ("host", "port", "path", "query", "ref", "userinfo")] == ["a.b", 81, "/p", "q=1", "r", None]
    assert one(spark, "no address", lambda t: C.url_part(t, "host")) is None and one(spark, "http://a.b/", lambda t: C.url_part(t, "port")) is None
    assert one(spark, "a😀", lambda t: C.code_point_at(t, 1)) == 128512 and one(spark, "a", lambda t: C.code_point_at(t, 1)) is None
    for number in (0, 7, -7, 12345, -(2**62)):
        assert one(spark, str(number), lambda t: C.unpack_decimal(C.pack_decimal(t.cast("bigint")))) == number
    for text, want in (("007.50", "7.5"), ("-0.00", "0"), (".5", "0.5"), ("5.", "5"), ("1e3", None), ("-00.10", "-0.1"), ("100", "100")):
        assert one(spark, text, C.normalize_decimal) == want, text
    ints = F.array(*map(F.lit, (1, 3, 3, 7)))
    assert [one(spark, "", lambda t, v=v: C.binary_search(ints, F.lit(v))) for v in (0, 1, 3, 5, 9)] == [-1, 0, 1, -4, -5]
    assert one(spark, "", lambda t: C.insert_at(ints, 4, F.lit(9))) == [1, 3, 3, 7, 9]
    with pytest.raises(Exception, match="index beyond"):
        one(spark, "", lambda t: C.insert_at(ints, 5, F.lit(9)))
    assert one(spark, '{"a": 1, "b": [{"a": "x"}, {"a": {"a": null}}]}', lambda t: C.find_all_values(t, "a")) == ["1", "x", '{"a": null}', "null"] and one(spark, "{", lambda t: C.find_all_values(t, "a")) == []
    assert [one(spark, t, C.is_email) for t in ("a@b.cz", "a@b", "a b@c.d", None)] == [True, False, False, False]
    assert [one(spark, t, C.is_phone) for t in ("+420 123-456-789", "12", None)] == [True, False, False]
    assert [one(spark, t, C.is_card) for t in ("4111 1111 1111 1111", "4111 1111 1111 1112", "1", None)] == [True, False, False, False]
    assert one(spark, "a=1\n# c=2\nb = x=y\n\na=3", C.parse_properties) == {"a": "3", "b": "x=y"}
    assert one(spark, "ab", lambda t: C.char_at(t, 1)) == "b" and one(spark, "abcdef", lambda t: C.cut_text(t, [(0, 2), (4, 1)])) == ["ab", "e"] and one(spark, "é", C.normal_form) == "é"
    assert one(spark, "2.5", lambda t: C.round_half_even(t.cast("double"), 0)) == 2.0 and one(spark, "two WORDS", C.proper_case) == "Two Words"
    assert [str(one(spark, "1.5", lambda t, i=i: C.decimal_first(t, F.lit(2))[i])) for i in (0, 1)] == ["1.50", "2.00"]


def test_bootstrap_and_differences(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    r = stats.paired_bootstrap(df, "k", "v").first()
    se = (8.25 / 400) ** 0.5
    assert r.n == 400 and r["mean"] == 4.5 and abs(r.low - (4.5 - 1.96 * se)) < 0.05 and abs(r.high - (4.5 + 1.96 * se)) < 0.05
    assert stats.paired_bootstrap(df.where("false"), "k", "v").first().n == 0
    assert stats.clustered_difference(df.withColumn("s", F.lit(1)), "k", F.col("s"), F.col("v")).first().clusters == 0


def test_matching_ratio(spark):
    from difflib import SequenceMatcher

    from weftline.operators.similarity import matching_ratio

    pairs = [("abcd", "bcde"), ("", ""), ("a", None), ("the row is kept", "the row was kept")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(matching_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [None if b is None else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    assert re.match("0.7", str(got[0]))
