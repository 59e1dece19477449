"""Readers and writers on whole tables: each query writes a table in some form below the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import chat
from weftline.plans.pipeline_queries import _messages
from weftline.plans.tables import on
from weftline.session import scratch
from weftline.sources import metadata, readers, writers


def _lines(df: DataFrame, *more: str) -> str:
    """The rows as JSON lines in a new folder, followed by other lines; nulls are written."""
    path = scratch(df.sparkSession, "lines")
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    text.write.text(path)
    if more:
        df.sparkSession.createDataFrame([(m,) for m in more], "value string").coalesce(1).write.mode("append").text(path)
    return path


@on("source_examples")
def json_lines(s: DataFrame) -> DataFrame:
    """JSON lines with a torn last one come back whole, the torn line among the rejects."""
    path = _lines(s.select("rec_id", "prompt", "source_index"), '{"rec_id": 1, "pro')
    good, bad = readers.read_records(s.sparkSession, path, "rec_id bigint, prompt string, source_index int")
    return good.select("rec_id", F.md5("prompt").alias("prompt"), "source_index").join(bad.agg(F.count(F.lit(1)).alias("rejects")))


@on("suite_tests")
def json_array(t: DataFrame) -> DataFrame:
    """One JSON array of a table of fixed size, read strictly."""
    path = scratch(t.sparkSession, "array")
    t.select("item_id", "rubric", "test_type").agg(F.to_json(F.collect_list(F.struct("item_id", "rubric", "test_type"))).alias("value")).write.text(path)
    return readers.read_array(t.sparkSession, path).select("item_id", F.md5("rubric").alias("rubric"), "test_type")


@on("orders")
def delimited_orders(o: DataFrame) -> DataFrame:
    """Quoted text with marks for nulls and typed fields, there and back."""
    spark, path = o.sparkSession, scratch(o.sparkSession, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(12,2)")).alias("amount"), "o_orderdate", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("note"))
    writers.write_delimited(rows, path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("amount", T.DecimalType(12, 2)), T.StructField("o_orderdate", T.TimestampType()), T.StructField("note", T.StringType())])
    return readers.read_delimited(spark, path, schema, most_errors=0)[0].withColumns({"amount": F.col("amount").cast("double"), "o_orderdate": F.col("o_orderdate").cast("timestamp_ntz")})


@on("orders")
def delimited_errors(o: DataFrame) -> DataFrame:
    """Bad cells put their rows among the rejects, with the names of these cells."""
    spark, path = o.sparkSession, scratch(o.sparkSession, "bad")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount"), F.when(F.col("o_orderpriority") == "5-LOW", "2030-02-31 00:00:00.000").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS")).alias("day"))
    writers.write_flat(rows, path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("day", T.TimestampType())])
    good, bad = readers.read_delimited(spark, path, schema)
    told = bad.select(F.array_join("_bad", ",").alias("cells")).unionByName(good.select(F.lit("").alias("cells")))
    return told.groupBy("cells").agg(F.count(F.lit(1)).alias("n"))


@on("part")
def any_format(p: DataFrame) -> DataFrame:
    """The same rows as comma, tab and semicolon text and as JSON lines, told apart by suffix."""
    rows, out = p.select("p_partkey", "p_name"), None
    for suffix, sep in ((".csv", ","), (".tsv", "\t"), (".del", ";"), (".jsonl", None)):
        path = scratch(p.sparkSession, "any") + suffix
        if sep is None:
            rows.write.json(path)
        else:
            writers.write_delimited(rows, path, sep)
        one = readers.read_any(p.sparkSession, path).select(F.lit(suffix).alias("suffix"), F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name")
        out = one if out is None else out.unionByName(one)
    return out


@on("customer")
def listed_inputs(c: DataFrame) -> DataFrame:
    """Folders named by overlapping patterns are read once."""
    spark, path = c.sparkSession, scratch(c.sparkSession, "segments")
    writers.write_partitioned(c, path, ["c_mktsegment"])
    found = readers.list_inputs([f"{path}/c_mktsegment=*", f"{path}/c_mktsegment=A*"], spark=spark)
    rows = spark.read.option("basePath", path).parquet(*found)
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@on("forged", "documents")
def training_files(f: DataFrame, d: DataFrame) -> DataFrame:
    """Of several files those that hold conversations, by their schemas; their user texts by id."""
    spark = f.sparkSession
    talks = f.select(F.col("pair_id").alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.coalesce("chosen", F.lit("")).alias("content"))).alias("messages"))
    paths = [_lines(talks), _lines(d.select("doc_id", "text"))]
    kept = readers.training_sets(spark, paths)
    rows = readers.read_records(spark, kept[0])[0]
    return chat.user_texts(rows).select("id", F.md5("user").alias("user"), F.lit(len(kept)).cast("bigint").alias("files"))


@on("forged")
def harvested_prompts(f: DataFrame) -> DataFrame:
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("chosen").alias("content"))).alias("messages"), F.struct(F.col("system").alias("question")).alias("extra")))
    return readers.harvest_prompts(f.select(doc.alias("value"))).groupBy(F.md5("prompt").alias("prompt")).agg(F.count(F.lit(1)).alias("n"))


@on("exec_results")
def sharded_rows(e: DataFrame) -> DataFrame:
    """Two shard files; what the later one says of an id holds."""
    spark, path = e.sparkSession, scratch(e.sparkSession, "shards")
    e.select("exec_id", F.lit("first").alias("said")).write.json(f"{path}/s0")
    e.where("run_status = 'FINISHED_OK'").select("exec_id", F.lit("second").alias("said")).write.json(f"{path}/s1")
    return readers.read_shards(spark, [f"{path}/s0", f"{path}/s1"], ["exec_id"], "exec_id bigint, said string")


@on("documents")
def prompts_of_split(d: DataFrame) -> DataFrame:
    path = _lines(d.select("doc_id", F.col("text").alias("prompt"), F.col("doc_kind").alias("split")))
    return readers.read_prompts(d.sparkSession, path, "spec").select("doc_id", F.md5("prompt").alias("prompt"))


@on("nation", "customer")
def sqlite_lookup(n: DataFrame, c: DataFrame) -> DataFrame:
    """Keys looked up in a small SQLite file, read by ranges of row ids."""
    import os
    import sqlite3

    spark = n.sparkSession
    path = scratch(spark, "nation").removeprefix("file:") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT)")
        db.executemany("INSERT INTO nation VALUES (?, ?)", [tuple(r) for r in n.select("n_nationkey", "n_name").collect()])
    stored = readers.read_sqlite(spark, path, "nation", "n_nationkey int, n_name string")
    return c.join(F.broadcast(stored), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@on("split_targets")
def run_log(t: DataFrame) -> DataFrame:
    """Entries of a YAML run log."""
    spark, path = t.sparkSession, scratch(t.sparkSession, "log")
    t.orderBy("split_name").select(F.concat(F.lit("- split: "), "split_name", F.lit("\n  share: "), F.col("share_pm").cast("string"), F.lit("\n  note: null")).alias("value")).coalesce(1).write.text(path)
    return readers.read_log(spark, path, "split string, share int, note string")


@on("sample_targets")
def trainer_history(t: DataFrame) -> DataFrame:
    """Logged steps of a trainer's state file, in their order."""
    spark, path = t.sparkSession, scratch(t.sparkSession, "state")
    entry = F.sort_array(F.collect_list(F.struct("category_kind", "category_value", "target_pm")))
    t.agg(F.to_json(F.struct(F.lit(3).alias("epoch"), entry.alias("log_history"))).alias("value")).write.text(path)
    return readers.log_history(spark, path, "category_kind string, category_value string, target_pm int")


@on("source_examples")
def port_records(s: DataFrame) -> DataFrame:
    """The records that prompts describe, by port and direction."""
    r = s.select("rec_id", F.posexplode(metadata.port_records(F.col("prompt"))).alias("place", "r"))
    return r.select("rec_id", "place", "r.port", "r.role", "r.record", F.array_join("r.fields", ",").alias("fields"))


@on("forged")
def preference_files(f: DataFrame) -> DataFrame:
    """Preference records; one without a system text has no such key."""
    path = scratch(f.sparkSession, "pairs")
    writers.write_preferences(f.select("pair_id", "prompt", "system", "chosen", "rejected"), path)
    lines = f.sparkSession.read.text(path)
    keys = F.json_object_keys("value")
    return lines.select(F.get_json_object("value", "$.pair_id").cast("bigint").alias("pair_id"), F.array_contains(keys, "system").alias("has_system"), F.md5(F.coalesce(F.get_json_object("value", "$.chosen"), F.lit(""))).alias("chosen"))


@on("source_examples")
def conversation_files(s: DataFrame) -> DataFrame:
    path = scratch(s.sparkSession, "talks")
    writers.write_conversations(_messages(s), path, "messages", ["rec_id"])
    rows = s.sparkSession.read.text(path).select(F.from_json("value", f"messages {chat.MESSAGE}, rec_id bigint").alias("r")).select("r.*")
    return rows.select("rec_id", F.size("messages").cast("bigint").alias("turns"), F.md5(F.element_at("messages", -1).content).alias("last"))


@on("forged")
def dead_letters(f: DataFrame) -> DataFrame:
    """Invalid examples go to a file of their own with the reason."""
    spark, path = f.sparkSession, scratch(f.sparkSession, "dead")
    reason = F.when(F.col("chosen").isNull(), "no_chosen").when(F.trim("chosen") == "", "blank_chosen").when(F.col("rejected").isNull(), "no_rejected").when(F.col("chosen") == F.col("rejected"), "equal")
    valid, invalid = writers.split_invalid(f.select("pair_id", "chosen", "rejected"), reason)
    writers.append_json(valid, f"{path}/valid")
    writers.append_json(invalid, f"{path}/invalid")
    read = lambda part: spark.read.schema("pair_id bigint, reason string").json(f"{path}/{part}")
    return read("valid").unionByName(read("invalid")).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@on("forged_provenance")
def provenance_files(p: DataFrame) -> DataFrame:
    path = scratch(p.sparkSession, "provenance")
    writers.write_provenance(p, path)
    rows = p.sparkSession.read.schema("pair_id bigint, pairing_strategy string, provenance struct<exec_level: string, verdict: struct<confidence: double>>").json(path)
    return rows.groupBy("pairing_strategy", "provenance.exec_level").agg(F.count(F.lit(1)).alias("n"), F.max("provenance.verdict.confidence").alias("surest"))


@on("sample_targets")
def dataset_registry(t: DataFrame) -> DataFrame:
    """A registry to which the kinds of targets are added and one is replaced."""
    spark, path = t.sparkSession, scratch(t.sparkSession, "registry") + ".json"
    counts = t.groupBy("category_kind").agg(F.count(F.lit(1)).alias("n")).orderBy("category_kind").collect()
    for r in counts:
        writers.register(spark, path, r[0], {"rows": 0, "version": 1})
    for r in counts:
        known = writers.register(spark, path, r[0], {"rows": r[1], "version": 2})
    return spark.createDataFrame([(k, v["rows"], v["version"]) for k, v in known.items()], "name string, rows bigint, version int")


@on("setup_bundles", "exec_results")
def upserted_bundles(b: DataFrame, e: DataFrame) -> DataFrame:
    """A table that gets newer states of its keys, then keys that it lacks, each time as a new version."""
    spark, path = b.sparkSession, scratch(b.sparkSession, "bundles")
    b.select("example_id", F.lit(0).cast("bigint").alias("seen"), F.lit("bundle").alias("kind")).write.parquet(path)
    runs = e.groupBy("example_id").agg(F.max("exec_id").alias("seen")).withColumn("kind", F.lit("run"))
    known = runs.join(b.select("example_id"), "example_id", "left_semi")
    second = writers.upsert_table(known, path, ["example_id"], "seen", "2")
    return spark.read.parquet(writers.insert_missing(runs.withColumn("kind", F.lit("added")), second, ["example_id"], "3"))


@on("setup_bundles")
def rewritten_table(b: DataFrame) -> DataFrame:
    """A table rewritten twice from itself; the backup keeps the first state."""
    spark, path = b.sparkSession, scratch(b.sparkSession, "rewrite")
    b.select("example_id", F.lit(0).alias("version")).write.parquet(path)
    for _ in range(2):
        writers.rewrite(spark.read.parquet(path).withColumn("version", F.col("version") + 1), path)
    state = lambda p: spark.read.parquet(p).groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    return state(path).select(F.lit("now").alias("state"), "version", "n").unionByName(state(f"{path}.bak").select(F.lit("backup").alias("state"), "version", "n"))


@on("exec_results")
def result_tables(e: DataFrame) -> DataFrame:
    """Results as JSON and a summary of them as a Markdown table."""
    spark, path = e.sparkSession, scratch(e.sparkSession, "results")
    writers.replace_json(e.select("exec_id", "exec_level", "run_status"), f"{path}/json")
    rows = spark.read.schema("exec_id bigint, exec_level string, run_status string").json(f"{path}/json")
    summary = rows.groupBy("run_status").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("exec_level") == "L3_pass").alias("passed"))
    lines = writers.markdown_table(summary, ["run_status"])
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, text string")


@on("lineitem")
def guarded_output(i: DataFrame) -> DataFrame:
    """A writer that expected 150 records stops at ten times as many; the guard against runaway output is the feature."""
    kept, cap = writers.capped(i.select("l_orderkey"), 150)
    return kept.agg(F.count(F.lit(1)).alias("written")).withColumn("cap", F.lit(cap).cast("bigint"))


@on("orders")
def flat_files(o: DataFrame) -> DataFrame:
    """Delimited files by key with some fields left out, written in two steps."""
    spark, path = o.sparkSession, scratch(o.sparkSession, "flat")
    for status in ("F", "O", "P"):
        writers.write_flat(o.where(F.col("o_orderstatus") == status), path, ["o_orderpriority"], 5000, ["o_orderdate", "o_custkey"], append=True)
    rows = spark.read.option("sep", "|").option("header", "true").option("nullValue", "__NULL__").csv(path)
    return rows.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"), F.lit(",".join(sorted(rows.columns))).alias("columns"))


@on("nation", "region")
def merged_output(n: DataFrame, r: DataFrame) -> DataFrame:
    return writers.merge_all([n.select("n_nationkey", "n_name"), r.select("r_regionkey", "r_name")])


QUERIES = {
    f.__name__: f
    for f in (
        json_lines, json_array, delimited_orders, delimited_errors, any_format, listed_inputs, training_files, harvested_prompts, sharded_rows, prompts_of_split, sqlite_lookup, run_log, trainer_history, port_records,
        preference_files, conversation_files, dead_letters, provenance_files, dataset_registry, upserted_bundles, rewritten_table, result_tables, guarded_output, flat_files, merged_output,
    )
}
try:
    import yaml  # noqa: F401
except ImportError:  # run logs are in YAML
    del QUERIES["run_log"]

_PORT = metadata.PORT
ORACLES = {
    "json_lines": "SELECT rec_id, md5(prompt) AS prompt, source_index, CAST(1 AS BIGINT) AS rejects FROM source_examples",
    "json_array": "SELECT item_id, md5(rubric) AS rubric, test_type FROM suite_tests",
    "delimited_orders": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS amount, date_trunc('millisecond', o_orderdate) AS o_orderdate, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS note FROM orders",
    "delimited_errors": "SELECT array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'amount' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'day' END], lambda x: x IS NOT NULL), ',') AS cells, count(*) AS n FROM orders GROUP BY 1",
    "any_format": "SELECT suffix, p_partkey, p_name FROM part, (SELECT unnest(['.csv', '.tsv', '.del', '.jsonl']) AS suffix)",
    "listed_inputs": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1",
    "training_files": "SELECT pair_id AS id, md5(prompt) AS user, CAST(1 AS BIGINT) AS files FROM forged",
    "harvested_prompts": "SELECT md5(t) AS prompt, count(*) AS n FROM (SELECT prompt AS t FROM forged UNION ALL SELECT system FROM forged) WHERE t IS NOT NULL GROUP BY 1",
    "sharded_rows": "SELECT exec_id, CASE WHEN bool_or(run_status = 'FINISHED_OK') THEN 'second' ELSE 'first' END AS said FROM exec_results GROUP BY 1",
    "prompts_of_split": "SELECT doc_id, md5(text) AS prompt FROM documents WHERE doc_kind = 'spec'",
    "sqlite_lookup": "SELECT n_name, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "run_log": "SELECT split_name AS split, share_pm AS share, CAST(NULL AS VARCHAR) AS note FROM split_targets",
    "trainer_history": "SELECT CAST(row_number() OVER (ORDER BY category_kind, category_value, target_pm) - 1 AS INT) AS place, category_kind, category_value, target_pm FROM sample_targets",
    "port_records": rf"""
        WITH p AS (SELECT rec_id, regexp_extract_all(prompt, '{_PORT}', 1) AS n, regexp_extract_all(prompt, '{_PORT}', 2) AS r, regexp_extract_all(prompt, '{_PORT}', 3) AS x FROM source_examples),
        u AS (SELECT rec_id, CAST(generate_subscripts(n, 1) - 1 AS INT) AS place, unnest(n) AS port, unnest(r) AS role, unnest(x) AS xml FROM p)
        SELECT rec_id, place, CAST(port AS INT) AS port, role, regexp_extract(xml, '<Record[^>]*name="([^"]*)"', 1) AS record, array_to_string(regexp_extract_all(xml, '<Field[^>]*name="([^"]*)"', 1), ',') AS fields FROM u""",
    "preference_files": "SELECT pair_id, coalesce(system, '') <> '' AS has_system, md5(coalesce(chosen, '')) AS chosen FROM forged",
    "conversation_files": "SELECT rec_id, CAST(1 + (system IS NOT NULL)::INT + (reference IS NOT NULL)::INT AS BIGINT) AS turns, md5(coalesce(reference, prompt)) AS last FROM source_examples",
    "dead_letters": "SELECT CASE WHEN chosen IS NULL THEN 'no_chosen' WHEN trim(chosen, ' ') = '' THEN 'blank_chosen' WHEN rejected IS NULL THEN 'no_rejected' WHEN chosen = rejected THEN 'equal' ELSE 'valid' END AS reason, count(*) AS n FROM forged GROUP BY 1",
    "provenance_files": "SELECT pairing_strategy, provenance.exec_level AS exec_level, count(*) AS n, max(provenance.verdict.confidence) AS surest FROM forged_provenance GROUP BY 1, 2",
    "dataset_registry": "SELECT category_kind AS name, count(*) AS rows, 2 AS version FROM sample_targets GROUP BY 1",
    "upserted_bundles": "WITH r AS (SELECT example_id, max(exec_id) AS seen FROM exec_results GROUP BY 1) SELECT coalesce(b.example_id, r.example_id) AS example_id, coalesce(r.seen, 0) AS seen, CASE WHEN r.example_id IS NULL THEN 'bundle' WHEN b.example_id IS NULL THEN 'added' ELSE 'run' END AS kind FROM setup_bundles b FULL JOIN r ON b.example_id = r.example_id",
    "rewritten_table": "SELECT state, version, n FROM (SELECT count(*) AS n FROM setup_bundles), (SELECT unnest(['now', 'backup']) AS state, unnest([2, 0]) AS version)",
    "result_tables": "WITH s AS (SELECT run_status, count(*) AS runs, count(*) FILTER (exec_level = 'L3_pass') AS passed FROM exec_results GROUP BY 1) SELECT 0 AS line, '| run_status | runs | passed |' AS text UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY run_status), '| ' || run_status || ' | ' || runs || ' | ' || passed || ' |' FROM s",
    "guarded_output": "SELECT least(count(*), 1500) AS written, CAST(1500 AS BIGINT) AS cap FROM lineitem",
    "flat_files": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, 'o_orderkey,o_orderpriority,o_orderstatus,o_totalprice' AS columns FROM orders GROUP BY 1, 2",
    "merged_output": "SELECT n_nationkey, n_name, NULL AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region",
}
if "run_log" not in QUERIES:
    del ORACLES["run_log"]
