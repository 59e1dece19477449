import json
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from weftline.sources import metadata, readers, writers
from weftline.streaming import streams

XML = '<Record name="r" type="delimited"><Field name="id" type="integer" nullable="false"/><Field name="amt" type="decimal" length="10" scale="3"/><Field name="day" type="date" format="yyyy-MM-dd"/><Field name="note" type="string" nullValue="-"/></Record>'


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n{"x": ')
    (tmp_path / "c.json").write_text('{\n "x": 5\n}')
    for name, good, bad in (("a.json", 2, 0), ("b.jsonl", 2, 1), ("c.json", 1, 0)):
        records, rejects = readers.read_records(spark, str(tmp_path / name), "x int")
        assert (records.count(), rejects.count()) == (good, bad), name
    with pytest.raises(Exception):
        readers.read_records(spark, str(tmp_path / "b.jsonl"), "x int", strict=True)[0].collect()
    assert readers.read_array(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_array(spark, str(tmp_path / "b.jsonl"))


def test_metadata_round_trip(spark):
    schema = metadata.parse_record(XML)
    assert metadata.parse_record(metadata.to_xml(schema, "r")) == schema
    with pytest.raises(ValueError):
        metadata.parse_record('<Record><Field name="a" type="odd"/></Record>')


def test_delimited(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id|amt|day|note\n1|2.5|2030-01-02|""\n2|x|2030-02-30|"a|b"\n__NULL__|__NULL__|__NULL__|__NULL__\n')
    schema = metadata.parse_record(XML)
    good, bad = readers.read_delimited(spark, str(tmp_path / "in.csv"), schema)
    assert [(r.id, r.amt, r.note) for r in good.orderBy("id").collect()] == [(0, None, None), (1, Decimal("2.500"), "")]
    assert [r._bad for r in bad.collect()] == [["amt", "day"]]
    assert readers.read_delimited(spark, str(tmp_path / "in.csv"), schema, policy="lenient")[0].count() == 3
    with pytest.raises(Exception, match="bad cells"):
        readers.read_delimited(spark, str(tmp_path / "in.csv"), schema, policy="strict")[0].collect()
    writers.write_delimited(good.select("id", "amt", "note"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"1"|"2.500"|""' in text and '"0"|"__NULL__"|"__NULL__"' in text


def test_shards_last_write_wins(spark, tmp_path):
    (tmp_path / "s0.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 1}\n{"k": "a", "v": 2}\ntorn')
    (tmp_path / "s1.jsonl").write_text('{"k": "b", "v": 9}\n')
    got = readers.read_shards(spark, [str(tmp_path / "s0.jsonl"), str(tmp_path / "s1.jsonl")], ["k"], "k string, v int")
    assert rows(got) == [("a", 2), ("b", 9)]
    assert [p.rsplit("/", 1)[1] for p in readers.list_inputs([str(tmp_path / "s*.jsonl"), str(tmp_path / "s0.jsonl")])] == ["s0.jsonl", "s1.jsonl"]
    with pytest.raises(FileNotFoundError):
        readers.list_inputs([str(tmp_path / "nothing*")])


def test_harvest_and_settings(spark):
    doc = json.dumps({"a": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "no"}], "prompt": "p"})
    got = readers.harvest_prompts(spark.createDataFrame([(doc,), (None,), ("torn {",)], "value string"))
    assert rows(got) == [("ask",), ("p",)]
    assert readers.deep_merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert readers.expand_settings({"p": ["$HOME_X", "${A}/b"]}, {"A": "q"}) == {"p": ["$HOME_X", "q/b"]}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("p", "", "c"), ("p2", "s", "c2")], "prompt string, system string, chosen string")
    writers.write_preferences(df, str(tmp_path / "pref"))
    lines = [json.loads(x) for p in (tmp_path / "pref").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(len(x) for x in lines) == [2, 3]
    valid, invalid = writers.split_invalid(df, F.when(F.col("system") == "", "no_system"))
    assert (valid.count(), invalid.first().reason) == (1, "no_system")
    assert writers.capped(spark.range(5), 1)[1] == 1000
    df.write.parquet(str(tmp_path / "t"))
    new = writers.upsert_table(spark.createDataFrame([("p", "z", "new")], df.schema), str(tmp_path / "t"), ["prompt"], "system", "1")
    assert rows(spark.read.parquet(new), "prompt", "chosen") == [("p", "new"), ("p2", "c2")]
    assert rows(writers.merge_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")]).fillna(0)) == [(0, 2), (1, 0)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(f"k{j % 2}", i * 10 + j, float(j)) for j in range(4)], "k string, o int, value double").coalesce(1).write.mode("append").parquet(str(src))
    stream = streams.file_stream(spark, str(src), spark.read.parquet(str(src)), files=1)
    streams.upsert_into(stream, str(tmp_path / "out"), ["k"], "o", str(tmp_path / "ck")).awaitTermination()
    last = max((tmp_path / "out").glob("v*"), key=lambda p: int(p.name[1:]))
    assert rows(spark.read.parquet(str(last)), "k", "o") == [("k0", 22), ("k1", 23)]
    totals = streams.running_totals(stream, "k", "value")
    q = totals.writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("totals").groupBy("k").agg(F.max("n"), F.max("total"))) == [("k0", 6, 6.0), ("k1", 6, 12.0)]


def test_error_limits_and_reading_on(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id|amt|day|note\n1|2|2030-01-02|a\n2|x|2030-01-02|b\n3|4|2030-01-03|c\n")
    schema = metadata.parse_record(XML)
    read = lambda **more: readers.read_delimited(spark, str(tmp_path / "in.csv"), schema, **more)
    assert read(most_errors=1)[0].count() == 2
    with pytest.raises(ValueError, match="1 bad rows"):
        read(most_errors=0)
    assert [r.id for r in read(after=("id", 1))[0].collect()] == [3]


def test_kinds_of_files(spark, tmp_path):
    (tmp_path / "talk.json").write_text('[{"id": "a", "messages": [{"role": "user", "content": "u"}]}]')
    (tmp_path / "rows.json").write_text('[{"id": "a", "text": "t"}]')
    paths = [str(tmp_path / "talk.json"), str(tmp_path / "rows.json")]
    assert readers.training_sets(spark, paths) == paths[:1]
    assert [p.rsplit("/", 1)[1] for p in readers.list_inputs([str(tmp_path / "*.json"), paths[0]], spark=spark)] == ["rows.json", "talk.json"]
    with pytest.raises(FileNotFoundError):
        readers.list_inputs([str(tmp_path / "none*")], spark=spark)
    (tmp_path / "p.jsonl").write_text('{"prompt": "a", "split": "x"}\n{"prompt": "b", "split": "y"}\n')
    assert rows(readers.read_prompts(spark, str(tmp_path / "p.jsonl"), "y"), "prompt") == [("b",)]
    assert readers.read_prompts(spark, str(tmp_path / "p.jsonl")).count() == 2
    for suffix, text in ((".csv", "a,b\n1,x\n"), (".tsv", "a\tb\n1\tx\n"), (".del", "a;b\n1;x\n")):
        (tmp_path / f"f{suffix}").write_text(text)
        assert rows(readers.read_any(spark, str(tmp_path / f"f{suffix}"))) == [("1", "x")]
    with pytest.raises(ValueError):
        readers.read_any(spark, "f.xyz")


def test_logs_sqlite_and_revisions(spark, tmp_path):
    import sqlite3
    import subprocess

    pytest.importorskip("yaml")
    (tmp_path / "log.yaml").write_text("- run: 1\n  score: 0.5\n- run: 2\n")
    assert rows(readers.read_log(spark, str(tmp_path / "log.yaml"), "run int, score double").fillna(0)) == [(1, 0.5), (2, 0.0)]
    assert readers.read_log(spark, str(tmp_path / "absent.yaml"), "run int").count() == 0
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE t (k TEXT, v INTEGER)")
        db.execute("CREATE TABLE empty (k TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(f"k{i}", i) for i in range(25)])
    assert rows(readers.read_sqlite(spark, str(tmp_path / "t.db"), "t", "k string, v bigint", 4)) == sorted((f"k{i}", i) for i in range(25))
    assert readers.read_sqlite(spark, str(tmp_path / "t.db"), "empty", "k string").count() == 0
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("one\n", "one\ntwo\n"):
        (tmp_path / "f.txt").write_text(text)
        git("add", "f.txt")
        git("commit", "-qm", "state")
    assert readers.read_revision(spark, str(tmp_path), "HEAD~1", "f.txt").count() == 1
    assert rows(readers.read_revision(spark, str(tmp_path), "HEAD", "f.txt")) == [(1, "one"), (2, "two")]


def test_ports_and_filling(spark):
    text = 'Port 0 reads:\n<Record name="A">\n <Field name="x" type="long"/><Field name="y"/></Record>\nPort 1 writes: <Record name="B"></Record>'
    got = spark.createDataFrame([(text,), (None,)], "t string").select(metadata.port_records(F.col("t"))).collect()
    assert [(p.port, p.role, p.record, p.fields) for p in got[0][0]] == [(0, "reads", "A", ["x", "y"]), (1, "writes", "B", [])] and got[1][0] == []
    schema = metadata.parse_record(XML)
    assert rows(metadata.filled(spark.createDataFrame([("1", "1893456000000")], "id string, day string"), schema).fillna("-")) == [("1", "-", "2030-01-01 00:00:00.000", "-")]
    assert metadata.parse_record(metadata.described(spark.range(1), "r")).fieldNames() == ["id"]


def test_more_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, None, "p")], "k int, v string, part string")
    writers.write_flat(df.orderBy("k").coalesce(1), str(tmp_path / "flat"), ["part"], 1, ["v"], skip=1, most=2)
    assert rows(spark.read.option("sep", "|").option("header", "true").csv(str(tmp_path / "flat"))) == [("2", "q"), ("3", "p")]
    df.write.parquet(str(tmp_path / "t"))
    more = spark.createDataFrame([(3, "x", "z"), (4, "y", "z"), (4, "y", "z")], df.schema)
    assert rows(spark.read.parquet(writers.insert_missing(more, str(tmp_path / "t"), ["k"], "2")), "k", "part") == [(1, "p"), (2, "q"), (3, "p"), (4, "z")]
    for _ in range(2):
        writers.rewrite(spark.read.parquet(str(tmp_path / "t")).where("k > 1").withColumn("k", F.col("k") - 1), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "k") == [(1,)] and spark.read.parquet(str(tmp_path / "t.bak")).count() == 3
    assert writers.register(spark, str(tmp_path / "reg.json"), "a", {"n": 1}) == {"a": {"n": 1}}
    assert set(writers.register(spark, str(tmp_path / "reg.json"), "b", {})) == {"a", "b"}
    assert writers.markdown_table(df.select("k", "v"), ["k"]) == ["| k | v |", "| --- | --- |", "| 1 | a |", "| 2 | b |", "| 3 | — |"]
    writers.write_provenance(df.withColumn("prompt", F.lit("long")), str(tmp_path / "prov"))
    assert spark.read.json(str(tmp_path / "prov")).columns == ["k", "part", "v"]
