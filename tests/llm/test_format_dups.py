import json

import pytest
from helpers import rows, table

from weftline.llm import format_dups as D
from weftline.llm.canonical import canonical


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Spec 1: do  it!", "spec 1 do it", True),
        ("STRASSE", "straße", True),
        ('<Record name="A"><Field name="x" type="long"/><Field name="y"/></Record>', "<RECORD NAME='A'>\n <FIELD NAME = 'Y' />\n<FIELD TYPE='LONG' NAME='X'/></RECORD>", True),
        ('<Record name="A"><Field name="x"/></Record><Record name="B"><Field name="y"/></Record>', '<Record name="A"><Field name="y"/></Record><Record name="B"><Field name="x"/></Record>', False),
        ('{"a": 1, "b": {"c": [1, 2], "d": "x"}}', '{"B":{"D":"X","C":[1,2]},"A":1}', True),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
        ("field_name", "fieldname", False),
        ("first second", "second first", False),
        ('say {"a": 1} and {broken', 'SAY {"a":1} and { broken', True),
        ("", " .,!\n", True),
    ],
)
def test_canonical(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_deep_and_long_texts():
    assert canonical("{" * 5000) == ""
    assert canonical(json.dumps({"k": "v " * 200_000})) == "k" + "v" * 200_000


def test_trie_counts_terminals():
    t = D.RadixTrie()
    for key, i in ((b"abc", 5), (b"abd", 2), (b"ab", 9), (b"", 4), (b"abc", 3), (b"abcdef", 8)):
        t.add(key, 1, i)
    got = {}

    def walk(node, prefix):
        if node.count:
            got[prefix + node.label] = (node.count, node.least)
        for child in node.children.values():
            walk(child, prefix + node.label)

    walk(t.root, b"")
    assert got == {b"abc": (2, 3), b"abd": (1, 2), b"ab": (1, 9), b"": (1, 4), b"abcdef": (1, 8)}


def _brute(pairs):
    first = {}
    for i, text in pairs:
        if i is not None and text is not None:
            first.setdefault(canonical(text), []).append(i)
    return sorted({(min(g), i) for g in first.values() for i in g if i > min(g)}), sorted((min(g), len(g)) for g in first.values())


@pytest.mark.parametrize("capacity", [2, 50, 20_000])
def test_hot_group_and_edges_at_any_bucket_size(spark, capacity):
    data = [(i, f"Task {i % 40}: do IT" if i % 3 else " the SAME,\ttext") for i in range(1, 400)] + [(500, None), (None, "x"), (501, ""), (502, "!"), (503, "long " * 5000), (504, "LONG" * 5000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "rec_id bigint, prompt string, bucket string, copies int").repartition(5)
    found, counts = _brute(data)
    assert rows(D.format_duplicates(df, capacity=capacity)) == found
    assert rows(D.collapse_formats(df, capacity=capacity)) == counts


def test_small_task_tries(spark, monkeypatch):
    monkeypatch.setattr(D, "TRIE_BYTES", 30)
    data = [(i, f"some text {i % 7}") for i in range(100)]
    assert rows(D.format_duplicates(spark.createDataFrame(data, "rec_id bigint, prompt string"))) == _brute(data)[0]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "A")], "rec_id bigint, prompt string")
    assert rows(D.format_duplicates(df)) == [(1, 2)]
    assert rows(D.collapse_formats(df)) == [(1, 3)]
    assert rows(D.format_duplicates(df.where("false"))) == []


def test_test_table(spark):
    df = table(spark, "source_examples")
    assert rows(D.format_duplicates(df)) == _brute([(r.rec_id, r.prompt) for r in df.collect()])[0]


def test_one_text_in_descending_ids_stays_within_the_limit(monkeypatch):
    import tracemalloc

    import pandas as pd

    monkeypatch.setattr(D, "TRIE_BYTES", 1 << 20)
    n, text = 40_000, "word " * 1000
    batches = (pd.DataFrame({"rec_id": range(at, at - 1000, -1), "text": [text] * 1000}) for at in range(n, 0, -1000))
    tracemalloc.start()
    frames = [(len(f), int(f["canon"].notna().sum()), int(f["copies"].sum())) for f in D._partial(batches)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(frames) > 1 and peak < 12 << 20
    assert sum(f[0] for f in frames) == n == sum(f[2] for f in frames) and all(f[1] <= 1 for f in frames)


@pytest.mark.parametrize(("capacity", "most"), [(3, 10**6), (10**6, 400), (10**6, 10)])
def test_buckets_fit_by_keys_and_by_bytes(spark, capacity, most):
    stem = b"the same long preamble of every prompt " * 3
    keys = [(i, stem + f"{i % 60:03}".encode() * 3, 1) for i in range(150)] + [(1000 + i, b"hot", 1) for i in range(30)]
    fitting, alone = D.radix_buckets(spark.createDataFrame(keys, "rep_id bigint, canon binary, copies bigint"), capacity, most)
    groups = {}
    for r in fitting.collect():
        groups.setdefault(r.bucket, []).append(bytes(r.canon))
    assert all(len(g) == 1 or (len(g) <= capacity and sum(map(len, g)) <= most) for g in groups.values())
    single = {}
    for r in alone.collect():
        single.setdefault(r.bucket, set()).add(bytes(r.canon))
    assert all(len(g) == 1 for g in single.values())
    assert sorted(k for g in groups.values() for k in g) + sorted(bytes(r.canon) for r in alone.collect()) != []
    assert sum(map(len, groups.values())) + alone.count() == 180
