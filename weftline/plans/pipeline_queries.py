"""Composed pipelines: supersede and dedup a corpus, forge pairs, contrast samples, mutate, check rules, compare rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_id
from weftline.operators import chat, pairs, rules
from weftline.plans.score_queries import _R, _runs
from weftline.plans.tables import on
from weftline.plans.text_queries import _norm


def _messages(s: DataFrame) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))
    m = F.array_compact(F.array(F.when(F.col("system").isNotNull(), turn("system", F.col("system"))), turn("user", F.col("prompt")), F.when(F.col("reference").isNotNull(), turn("assistant", F.col("reference")))))
    return s.withColumn("messages", m)


@on("source_examples")
def chat_exchanges(s: DataFrame) -> DataFrame:
    x = _messages(s).select("rec_id", chat.single_exchange(F.col("messages")).alias("x"))
    return x.select("rec_id", F.coalesce("x.skip", F.lit("ok")).alias("state"), F.coalesce(F.length("x.system"), F.lit(0)).cast("bigint").alias("system_len"))


@on("source_examples")
def superseded_rows(s: DataFrame) -> DataFrame:
    """Rows of the corpus that a reasoning set (every fifth record) supersedes or that repeat an earlier one."""
    d = _messages(s).select("rec_id", F.coalesce("source_file", F.lit("")).alias("file"), F.col("rec_id").alias("line"), F.array_join(chat.prompt_key(F.col("messages")), "|").alias("key"), chat.answer_text(F.col("messages")).alias("answer"))
    return chat.superseded(d.where("rec_id % 5 <> 0"), d.where("rec_id % 5 = 0")).select("rec_id", "verdict")


@on("exec_results", "source_examples")
def forged_pairs(e: DataFrame, s: DataFrame) -> DataFrame:
    """One preference pair for each example from its runs: the reference against the most telling failure."""
    c = _runs(e).select("example_id", F.col("exec_id").alias("idx"), F.concat_ws(" ", F.lit("candidate output of the run"), F.coalesce("output_diff", F.lit("")), F.col("exec_level")).alias("text"), F.col("exec_level").alias("level"), F.lit(None).cast("double").alias("confidence"))
    c = c.withColumn("x", pairs.label(F.col("level"), F.lit(None).cast("string"), F.col("confidence"))).select("*", "x.rejected", "x.correct")
    chosen = s.where("reference is not null and id is not null").groupBy(F.lower("id").alias("example_id")).agg(F.min("reference").alias("chosen"))
    return pairs.build_pairs(c, chosen).select("example_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "level")


@on("exec_results")
def contrast_pairs(e: DataFrame) -> DataFrame:
    d = _runs(e).select("example_id", "exec_id", (F.col("exec_level") == "L3_pass").alias("passed"))
    return pairs.contrasting(d, "passed", "example_id", "exec_id", "c1").select("example_id", "good", "bad")


@on("exec_results")
def outcomes(e: DataFrame) -> DataFrame:
    """First pass, self-corrected or failed by the order of attempts; two aggregates, whatever their number."""
    ok, order = F.col("exec_level") == "L3_pass", F.struct("candidate_index", "exec_id")
    a = _runs(e).groupBy("example_id").agg(F.min_by(ok, order).alias("first"), F.bool_or(ok).alias("some"))
    return a.groupBy(pairs.outcome(F.array("first", "some")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@on("forged")
def mutated_code(f: DataFrame) -> DataFrame:
    edits = [("inverted", r"if \(!isnull", "if (isnull"), ("wrong_return", r"return (OK|ALL);", "return SKIP;"), ("dropped_header", r"^//#[A-Z0-9]+[^\n]*\n", "")]
    return pairs.mutants(f.select("pair_id", "chosen").where("chosen is not null"), "chosen", edits).select("pair_id", "kind", F.md5("mutant").alias("mutant"))


@on("source_examples")
def rule_report(s: DataFrame) -> DataFrame:
    checks = {"has_file": F.col("source_file").isNotNull(), "has_id": F.col("id").isNotNull(), "lower_id": F.col("id") == F.lower("id"), "long_prompt": F.length("prompt") >= 300, "index": F.col("source_index") >= 0}
    return rules.check_rules(s, checks, "rec_id")


@on("lineitem")
def golden_order(i: DataFrame) -> DataFrame:
    """Lines of each order compared place by place with a copy in which every 97th part is another."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = i.select(F.col("l_orderkey").alias("case"), F.row_number().over(w).alias("place_no"), "l_partkey")
    other = rows.withColumn("l_partkey", F.when(F.col("l_partkey") % 97 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")))
    out = rules.compare_ordered(rows, other, "place_no")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("cases"), F.sum("place").alias("places"))


@on("forged", "source_examples")
def merged_pools(f: DataFrame, s: DataFrame) -> DataFrame:
    """Records of two pools kept once, with the reason for each drop."""
    both = s.select(F.lit("a").alias("pool"), F.col("rec_id").alias("row_id"), "prompt", F.col("reference").alias("answer")).unionByName(f.select(F.lit("b").alias("pool"), F.col("pair_id").alias("row_id"), "prompt", F.col("chosen").alias("answer")))
    both = both.withColumn("pid", content_id(F.col("prompt")))
    w = Window.partitionBy("pid").orderBy("pool", "row_id")
    d = both.withColumn("rn", F.row_number().over(w))
    reason = F.when(F.col("answer").isNull(), "no_answer").when(F.length(F.trim("answer")) < 20, "short").when(F.col("rn") > 1, "repeated").otherwise("kept")
    return d.groupBy("pool", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (chat_exchanges, superseded_rows, forged_pairs, contrast_pairs, outcomes, mutated_code, rule_report, golden_order, merged_pools)}

_H = "sha256('c1|' || exec_id)"
ORACLES = {
    "merged_pools": f"WITH b AS (SELECT 'a' AS pool, rec_id AS i, {_norm('prompt')} AS p, reference AS a FROM source_examples UNION ALL SELECT 'b', pair_id, {_norm('prompt')}, chosen FROM forged), d AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY pool, i) AS rn FROM b) SELECT pool, CASE WHEN a IS NULL THEN 'no_answer' WHEN length(trim(a, ' ')) < 20 THEN 'short' WHEN rn > 1 THEN 'repeated' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1, 2",
    "chat_exchanges": "SELECT rec_id, CASE WHEN reference IS NULL THEN 'assistant_turns' WHEN trim(prompt) = '' THEN 'empty_user' ELSE 'ok' END AS state, coalesce(length(system), 0) AS system_len FROM source_examples",
    "superseded_rows": "WITH d AS (SELECT rec_id, coalesce(source_file, '') AS f, regexp_replace(prompt, '^\\s+|\\s+$', '', 'g') AS k, coalesce(reference, '') AS a FROM source_examples), c AS (SELECT *, row_number() OVER (PARTITION BY k, a ORDER BY f, rec_id) AS rn FROM d WHERE rec_id % 5 <> 0) SELECT rec_id, CASE WHEN k IN (SELECT k FROM d WHERE rec_id % 5 = 0) THEN 'superseded' WHEN rn > 1 THEN 'duplicate' ELSE 'keep' END AS verdict FROM c",
    "forged_pairs": f"""WITH {_R}, c AS (SELECT example_id, exec_id, exec_level AS level, 'candidate output of the run ' || coalesce(output_diff, '') || ' ' || exec_level AS text, lower(trim(regexp_replace('candidate output of the run ' || coalesce(output_diff, '') || ' ' || exec_level, '\\s+', ' ', 'g'))) AS k FROM r WHERE exec_level <> 'L3_pass'),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, k ORDER BY exec_id) AS rn FROM c) WHERE rn = 1),
        g AS (SELECT lower(id) AS example_id, min(reference) AS chosen FROM source_examples WHERE reference IS NOT NULL AND id IS NOT NULL GROUP BY 1),
        p AS (SELECT example_id, chosen, text, level, row_number() OVER (PARTITION BY example_id ORDER BY list_position(['L1_fail', 'L2_fail', 'L3_mismatch'], level) DESC, exec_id) AS n FROM f JOIN g USING (example_id))
        SELECT example_id, md5(chosen) AS chosen, md5(text) AS rejected, level FROM p WHERE n = 1""",
    "contrast_pairs": f"WITH {_R}, x AS (SELECT example_id, exec_id, exec_level = 'L3_pass' AS ok, row_number() OVER (PARTITION BY example_id, exec_level = 'L3_pass' ORDER BY {_H}, exec_id) AS k FROM r) SELECT a.example_id, a.exec_id AS good, b.exec_id AS bad FROM x a JOIN x b ON a.example_id = b.example_id AND a.k = b.k AND a.ok AND NOT b.ok",
    "outcomes": f"WITH {_R}, a AS (SELECT list(exec_level = 'L3_pass' ORDER BY candidate_index, exec_id) AS o FROM r GROUP BY example_id) SELECT CASE WHEN o[1] THEN 'first_pass' WHEN list_contains(o, true) THEN 'self_corrected' ELSE 'failed' END AS outcome, count(*) AS n FROM a GROUP BY 1",
    "mutated_code": r"""WITH m AS (SELECT pair_id, chosen, unnest([{'kind': 'inverted', 'm': regexp_replace(chosen, 'if \(!isnull', 'if (isnull', 'g')}, {'kind': 'wrong_return', 'm': regexp_replace(chosen, 'return (OK|ALL);', 'return SKIP;', 'g')}, {'kind': 'dropped_header', 'm': regexp_replace(chosen, '^//#[A-Z0-9]+[^\n]*\n', '', 'g')}]) AS x FROM forged WHERE chosen IS NOT NULL)
        SELECT pair_id, x.kind AS kind, md5(x.m) AS mutant FROM m WHERE x.m <> chosen""",
    "rule_report": "SELECT rule, n = 0 AS passed, n AS offenders, k AS first_offender FROM (SELECT unnest([{'rule': 'has_file', 'n': count(*) FILTER (source_file IS NULL), 'k': min(rec_id) FILTER (source_file IS NULL)}, {'rule': 'has_id', 'n': count(*) FILTER (id IS NULL), 'k': min(rec_id) FILTER (id IS NULL)}, {'rule': 'lower_id', 'n': count(*) FILTER (coalesce(id <> lower(id), true)), 'k': min(rec_id) FILTER (coalesce(id <> lower(id), true))}, {'rule': 'long_prompt', 'n': count(*) FILTER (length(prompt) < 300), 'k': min(rec_id) FILTER (length(prompt) < 300)}, {'rule': 'index', 'n': count(*) FILTER (coalesce(source_index < 0, true)), 'k': min(rec_id) FILTER (coalesce(source_index < 0, true))}], recursive := true) FROM source_examples)",
    "golden_order": "WITH x AS (SELECT l_orderkey, l_partkey % 97 = 0 AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem), p AS (SELECT l_orderkey, min(k) FILTER (bad) AS place FROM x GROUP BY 1) SELECT CASE WHEN place IS NULL THEN 'pass' ELSE 'mismatch' END AS status, count(*) AS cases, CAST(sum(place) AS BIGINT) AS places FROM p GROUP BY 1",
}
