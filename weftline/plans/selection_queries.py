"""Sampling, quotas, draws and ordinal pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import selection as L
from weftline.plans.tables import on

_PLAN = [("note", 40), ("spec", 1000), ("review", 25), ("log", None)]


def _plan(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(_PLAN, "doc_kind string, quota bigint")


@on("documents")
def hash_sample(d: DataFrame) -> DataFrame:
    return L.sample(d.select("doc_id", "doc_kind"), "doc_id", 50, "s1", 10)


@on("documents")
def quota_plan(d: DataFrame) -> DataFrame:
    return L.quota(d.select("doc_id", "doc_kind", "n_chars"), _plan(d), "doc_kind", "doc_id", "s2", [F.col("n_chars").desc()]).select("doc_id", "doc_kind")


@on("documents")
def quota_shortfall(d: DataFrame) -> DataFrame:
    return L.shortfall(d, _plan(d), "doc_kind")


@on("source_examples")
def round_robin(s: DataFrame) -> DataFrame:
    return L.round_robin(s.select("rec_id", F.coalesce("source_file", F.lit("")).alias("source_file")), "source_file", "rec_id", 300, "s3")


@on("exec_results")
def balanced_audit(e: DataFrame) -> DataFrame:
    return L.balanced(e.select("exec_id", (F.col("exec_level") == "L3_pass").alias("ok")).distinct(), "ok", "exec_id", 60, "s4")


@on("exec_results")
def pick_accepted(e: DataFrame) -> DataFrame:
    ok = e.where("exec_level = 'L3_pass'").select("example_id", "exec_id").distinct()
    return L.one_per_group(ok, ["example_id"], "exec_id", "s5")


@on("documents")
def proportional_sample(d: DataFrame) -> DataFrame:
    return L.proportional(d.select("doc_id", "doc_kind"), "doc_kind", "doc_id", 30, "s6")


@on("suite_tests")
def stride_holdout(t: DataFrame) -> DataFrame:
    return L.stride(t.select("item_id", "test_type"), ["test_type"], ["item_id"], 2, 5, 3)


@on("customer")
def weighted_rows(c: DataFrame) -> DataFrame:
    return L.weighted(c.select("c_custkey", (F.col("c_custkey") % 4 - 1).alias("w")), "w").select("c_custkey", "copy")


@on("suite_tests")
def epoch_draws(t: DataFrame) -> DataFrame:
    return L.epochs(t, "item_id", 3, "s7").select("epoch", "place", "item_id")


@on("documents")
def category_cascade(d: DataFrame) -> DataFrame:
    return L.cascade(d, [("long", F.col("n_chars") > 2000, 20), ("spec", F.col("doc_kind") == "spec", 15), ("any", F.lit(True), 10)], "doc_id", "s8")


def _sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = e.select("example_id", "exec_id", "exec_level").distinct()
    return rows.where("exec_level = 'L3_pass'").select("example_id", F.col("exec_id").alias("good")), rows.where("exec_level <> 'L3_pass'").select("example_id", F.col("exec_id").alias("bad"))


@on("exec_results")
def zip_pairs(e: DataFrame) -> DataFrame:
    good, bad = _sides(e)
    return L.zip_pairs(good, bad, ["example_id"], "good", "bad", "s9", 4).select("example_id", "good", "bad")


@on("exec_results")
def cycle_pairs(e: DataFrame) -> DataFrame:
    good, bad = _sides(e)
    return L.cycle_pairs(bad, good, ["example_id"], "bad", "good", "s10")


@on("source_examples")
def shards(s: DataFrame) -> DataFrame:
    """Shard of each record and the size of shards."""
    return s.groupBy(F.pmod("rec_id", F.lit(7)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (hash_sample, quota_plan, quota_shortfall, round_robin, balanced_audit, pick_accepted, proportional_sample, stride_holdout, weighted_rows, epoch_draws, category_cascade, zip_pairs, cycle_pairs, shards)}

_PLAN_SQL = "(VALUES ('note', 40), ('spec', 1000), ('review', 25), ('log', NULL)) AS p(doc_kind, quota)"
_H = "sha256('{0}|' || {1})".format
_SIDES = "x AS (SELECT DISTINCT example_id, exec_id, exec_level FROM exec_results), g AS (SELECT example_id, exec_id AS good, row_number() OVER (PARTITION BY example_id ORDER BY {g}, exec_id) AS rn FROM x WHERE exec_level = 'L3_pass'), b AS (SELECT example_id, exec_id AS bad, row_number() OVER (PARTITION BY example_id ORDER BY {g}, exec_id) AS rn FROM x WHERE exec_level <> 'L3_pass')".format

ORACLES = {
    "hash_sample": f"SELECT doc_id, doc_kind FROM documents ORDER BY {_H('s1', 'doc_id')}, doc_id LIMIT 50 OFFSET 10",
    "quota_plan": f"SELECT doc_id, doc_kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY n_chars DESC, {_H('s2', 'doc_id')}, doc_id) AS rn FROM documents JOIN {_PLAN_SQL} USING (doc_kind)) WHERE quota IS NULL OR rn <= quota",
    "quota_shortfall": f"SELECT p.doc_kind, (SELECT count(*) FROM documents d WHERE d.doc_kind = p.doc_kind) AS available, CAST(quota AS BIGINT) AS quota, greatest(0, quota - (SELECT count(*) FROM documents d WHERE d.doc_kind = p.doc_kind)) AS short FROM {_PLAN_SQL}",
    "round_robin": f"SELECT rec_id, source_file FROM (SELECT rec_id, coalesce(source_file, '') AS source_file, row_number() OVER (PARTITION BY coalesce(source_file, '') ORDER BY {_H('s3', 'rec_id')}, rec_id) AS rn FROM source_examples) ORDER BY rn, {_H('s3', 'source_file')}, source_file LIMIT 300",
    "balanced_audit": f"SELECT exec_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY {_H('s4', 'exec_id')}, exec_id) AS rn FROM (SELECT DISTINCT exec_id, exec_level = 'L3_pass' AS ok FROM exec_results)) ORDER BY rn > 30, {_H('s4', 'exec_id')}, exec_id LIMIT 60",
    "pick_accepted": f"SELECT example_id, exec_id FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {_H('s5', 'exec_id')}, exec_id) AS rn FROM (SELECT DISTINCT example_id, exec_id FROM exec_results WHERE exec_level = 'L3_pass')) WHERE rn = 1",
    "proportional_sample": f"SELECT doc_id, doc_kind FROM (SELECT doc_id, doc_kind, row_number() OVER (PARTITION BY doc_kind ORDER BY {_H('s6', 'doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY doc_kind) AS n, count(*) OVER () AS a FROM documents) WHERE rn <= greatest(1, floor(30.0 * n / a + 0.5))",
    "stride_holdout": "SELECT item_id, test_type FROM (SELECT *, row_number() OVER (PARTITION BY test_type ORDER BY item_id) - 1 AS i FROM suite_tests) WHERE i >= 2 AND (i - 2) % 5 = 0 AND i < 17",
    "weighted_rows": "SELECT c_custkey, CAST(unnest(range(1, c_custkey % 4)) AS INTEGER) AS copy FROM customer WHERE c_custkey % 4 > 1",
    "epoch_draws": "SELECT CAST(epoch AS INTEGER) AS epoch, place, item_id FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY sha256('s7|' || epoch || '|' || item_id), item_id) AS place FROM (SELECT item_id, unnest(range(0, 3)) AS epoch FROM suite_tests))",
    "category_cascade": f"""WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 2000 ORDER BY {_H('s8', 'doc_id')}, doc_id LIMIT 20),
        b AS (SELECT doc_id FROM documents WHERE doc_kind = 'spec' AND doc_id NOT IN (FROM a) ORDER BY {_H('s8', 'doc_id')}, doc_id LIMIT 15),
        c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (FROM a) AND doc_id NOT IN (FROM b) ORDER BY {_H('s8', 'doc_id')}, doc_id LIMIT 10)
        SELECT doc_id, 'long' AS category FROM a UNION ALL SELECT doc_id, 'spec' FROM b UNION ALL SELECT doc_id, 'any' FROM c""",
    "zip_pairs": f"WITH {_SIDES(g=_H('s9', 'exec_id'))} SELECT example_id, good, bad FROM g JOIN b USING (example_id, rn) WHERE rn <= 4",
    "cycle_pairs": f"WITH {_SIDES(g=_H('s10', 'exec_id'))}, n AS (SELECT example_id, count(*) AS n FROM g GROUP BY example_id) SELECT b.example_id, bad, good FROM b JOIN n USING (example_id) JOIN g ON g.example_id = b.example_id AND g.rn = (b.rn - 1) % n + 1",
    "shards": "SELECT rec_id % 7 AS shard, count(*) AS n FROM source_examples GROUP BY ALL",
}
