"""Answers read and classified, and whole pipelines from samples to training rows, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import answers as A
from weftline.functions import signatures, stats
from weftline.functions.text import FENCE, content_id, word_list
from weftline.operators import chat, pipelines, selection
from weftline.operators import similarity as S
from weftline.operators.identity import keep_first
from weftline.plans.pipeline_queries import _messages
from weftline.plans.score_queries import _R, _runs
from weftline.plans.tables import on
from weftline.plans.text_queries import _SPACE_SQL, _WORDS, _norm
from weftline.session import cut

_TYPES = (("(?i)\\brollup\\b", "ROLLUP"), ("(?i)\\bpartition\\b", "PARTITION"), ("(?i)\\breformat\\b", "REFORMAT"))
_ALIASES = {"ROLL_UP": "ROLLUP", "HASH_JOIN": "EXT_HASH_JOIN"}
_VERBS, _THINGS = ("convert", "keep", "divide", "copy", "reject"), ("row", "rows", "field", "case", "group")
_INSTRUCTIONS = ("Component: ", "Send the row", "Round ")
_DETECTORS = {"null": r"\bnull\b", "order": r"\border\b", "scale": r"\bscale\b"}
_NEGATION, _EXEMPT = r"\b(?:not|never|no|cannot)\b", r"\b(?:java|python|sql)\b"
_DOMAINS = ("retail", "energy", "health", "travel", "mail")
_PREFER = ("L1_fail", "L2_fail", "L3_mismatch")
_EDITS = [("inverted", r"if \(!isnull", "if (isnull"), ("wrong_return", r"return (OK|ALL);", "return SKIP;")]


@on("forged")
def runnable_codes(f: DataFrame) -> DataFrame:
    return f.select("pair_id", F.md5(F.coalesce(A.runnable_code(F.col("chosen")), F.lit(""))).alias("code"))


@on("exec_results")
def loose_reviews(e: DataFrame) -> DataFrame:
    """Reviews in four forms written from runs: stated, bare, by findings, and with an issue that takes itself back."""
    text = F.when(F.col("exec_level") == "L1_fail", "1. [ERROR] does not compile\nSUGGESTIONS:\n- [ERROR] no finding\nVERDICT: fail").when(F.col("exec_level") == "L2_fail", "- [WARNING]** stops early\n- [INFO] slow").when(F.col("exec_level") == "L3_mismatch", "- [ERROR] rows differ, but this is no issue\n**PASS**").otherwise("- [INFO] fine")
    r = e.select("exec_id", text.alias("t")).select("exec_id", A.loose_verdict(F.col("t")).alias("v"), A.standing_issues(F.col("t"), "(?i)no issue").alias("s"))
    return r.select("exec_id", "v.verdict", "v.source", F.size("s.kept").cast("bigint").alias("kept"), F.col("s.dropped").cast("bigint").alias("dropped"), F.col("s.verdict").alias("standing")).distinct()


@on("documents")
def component_sources(d: DataFrame) -> DataFrame:
    return d.select("doc_id", A.resolved(F.col("component"), _ALIASES, F.col("text"), _TYPES).alias("x")).select("doc_id", "x.value", "x.source")


@on("source_examples")
def code_requests(s: DataFrame) -> DataFrame:
    return s.select("rec_id", A.asks_for_code(F.col("prompt"), _VERBS, _THINGS).alias("asked"), A.asks_for_code(F.col("prompt"), _VERBS, _THINGS, needs="<Record").alias("with_record"))


@on("documents")
def stop_lengths(d: DataFrame) -> DataFrame:
    """Word lengths as tokens, 13 and 17 as stops, a cap of 40."""
    tokens = F.slice(F.transform(word_list(F.col("text")), lambda w: F.length(w)), 1, 40)
    return d.select("doc_id", A.length_to_stop(tokens, [13, 17], 40).alias("x")).select("doc_id", "x.length", "x.hit_cap")


@on("source_examples")
def bare_tasks(s: DataFrame) -> DataFrame:
    return s.select("rec_id", F.md5(A.without_instructions(F.col("prompt"), _INSTRUCTIONS)).alias("task"))


@on("forged_provenance")
def listed_modes(p: DataFrame) -> DataFrame:
    return p.select("pair_id", A.alternatives(F.array_sort(F.coalesce("rejected_failure_modes", F.array().cast("array<string>")))).alias("modes")).distinct()


@on("setup_bundles")
def picked_domains(b: DataFrame) -> DataFrame:
    return b.select("example_id", A.pick_of(_DOMAINS, F.col("example_id"), "domain").alias("domain"))


@on("documents")
def nearby_claims(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.array_join(A.nearby(F.col("text"), _DETECTORS, _NEGATION, _EXEMPT), ",").alias("claims"))


@on("forged")
def call_counts(f: DataFrame) -> DataFrame:
    """How often codes call a function with so many arguments."""
    calls = f.select(F.explode(signatures.call_arities(F.col("chosen"))).alias("c"))
    return calls.groupBy("c.name", "c.arity").agg(F.count(F.lit(1)).alias("codes"))


@on("orders")
def overload_types(o: DataFrame) -> DataFrame:
    """Return types of calls by their argument types, over a small catalogue."""
    catalogue = {"nvl": [(["T", "T"], "T")], "append": [(["list<T>", "T"], "list<T>"), (["map<K,V>", "K", "V"], "map<K,V>")], "concat": [(["string", "any..."], "string")], "abs": [(["integer|long"], "long"), (["number|decimal"], "number")]}
    name = F.when(F.col("o_orderstatus") == "F", "nvl").when(F.col("o_orderstatus") == "O", "append").when(F.col("o_orderpriority") == "5-LOW", "abs").otherwise("concat")
    arguments = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("integer"), F.lit("long"))).otherwise(F.array(F.lit("string"), F.lit("long")))).when(F.col("o_orderstatus") == "O", F.array(F.lit("list<string>"), F.lit("string"))).when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("integer"))).otherwise(F.array(F.lit("string"), F.lit("date"), F.lit("integer")))
    calls = o.select(name.alias("name"), arguments.alias("arguments")).groupBy("name", "arguments").agg(F.count(F.lit(1)).alias("n"))
    return calls.select("name", F.array_join("arguments", ",").alias("arguments"), "n", signatures.resolver(catalogue)(F.col("name"), F.col("arguments")).alias("returns"))


@on("forged")
def shape_counts(f: DataFrame) -> DataFrame:
    """Records in three spellings and one in none, brought into one shape, with counts of those skipped."""
    kind = F.when(F.col("system").isNotNull(), "messages").when(F.col("chosen").isNull(), "none").when(F.length("prompt") > 300, "share").otherwise("instruction")
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))
    said = lambda r, c: F.struct(F.lit(r).alias("from"), c.alias("value"))
    rows = f.select(
        "pair_id", kind.alias("kind"), F.when(kind == "messages", F.array(turn("system", F.col("system")), turn("user", F.col("prompt")), turn("assistant", F.coalesce("chosen", F.lit(""))))).alias("messages"),
        F.when(kind == "share", F.array(said("human", F.col("prompt")), said("gpt", F.col("chosen")))).alias("conversations"),
        F.when(kind == "instruction", F.col("prompt")).alias("instruction"), F.lit(None).cast("string").alias("input"), F.when(kind == "instruction", F.col("chosen")).alias("output"),
    )
    x = chat.one_shape(rows).select("shape", chat.single_exchange(F.col("messages")).alias("x"))
    return x.groupBy("shape", F.coalesce("x.skip", F.lit("ok")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x.user")).alias("chars"))


@on("source_examples")
def merged_reasoning(s: DataFrame) -> DataFrame:
    """Reasoning moved into answers; records without any are left out."""
    m = _messages(s).withColumn("messages", F.transform("messages", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"), F.when(m.role == "assistant", F.col("system")).alias("reasoning_content"))))
    kept = chat.with_reasoning_only(m).select("rec_id", chat.wrap_reasoning(F.col("messages")).alias("messages"))
    return kept.select("rec_id", F.md5(F.element_at("messages", -1).content).alias("answer"))


@on("exec_results")
def repair_queue(e: DataFrame) -> DataFrame:
    return pipelines.repair_candidates(_runs(e), "example_id", "exec_level", "log_excerpt", _PREFER[::-1], 10).select("example_id", "exec_level", "place", "variants", F.md5("log_excerpt").alias("log"))


def _prompt_rows(s: DataFrame) -> DataFrame:
    rows = s.select(content_id(F.col("prompt")).alias("prompt_id"), F.when(F.col("reference").isNull(), "open").when(F.col("reference").contains("return ALL"), "all").otherwise("ok").alias("task"), "rec_id", "source_file", F.try_element_at("meta", F.lit("failure_mode")).alias("mode"))
    return keep_first(rows, ["prompt_id"], ["rec_id"])


@on("source_examples", "suite_tests")
def prompt_set(s: DataFrame, t: DataFrame) -> DataFrame:
    """A target set, a harder one of double weight, and a replay of a third of the result from the rest."""
    rows = _prompt_rows(s)
    sets = [("target", rows.where("mode = 'null_handling'"), 1), ("hard", rows.where("mode is not null and task = 'all'"), 2)]
    held = t.select(content_id(F.col("prompt")).alias("prompt_id")).unionByName(rows.where("task = 'open'").select("prompt_id"))
    return pipelines.prompt_sets(sets, held, rows, 1 / 3, {"ok": 0.75, "all": 0.25}, "p1")


def _samples(e: DataFrame) -> DataFrame:
    return _runs(e).select(F.col("example_id").alias("prompt_id"), F.col("exec_id").alias("sample"), F.when(F.col("exec_level") == "L3_pass", "pass").otherwise(F.col("exec_level")).alias("status"), "run_status", "output_diff", "candidate_index", F.col("log_excerpt").alias("text"))


@on("exec_results")
def execution_rows(e: DataFrame) -> DataFrame:
    return pipelines.execution_rows(_samples(e), "x1", 2, 5, _PREFER)


@on("exec_results")
def false_alarms(e: DataFrame) -> DataFrame:
    return pipelines.false_alarm_pairs(_samples(e), F.col("run_status") == "FINISHED_OK", F.length("output_diff") > 0, "g1")


@on("exec_results")
def retry_rows(e: DataFrame) -> DataFrame:
    text = F.when(F.col("status") == "pass", F.concat(F.lit("The feedback was right. Now every row is kept as it came. Done ```x```. "), "text")).otherwise(F.lit("The feedback was read. ok"))
    attempts = _samples(e).select(F.col("prompt_id").alias("task_id"), F.struct("candidate_index", "sample").alias("round"), "status", text.alias("text"))
    return pipelines.retry_rows(attempts, "(?i)feedback").select("task_id", "first", "outcome", F.length("text").cast("bigint").alias("n"))


@on("source_examples", "forged", "suite_tests")
def rebuilt_rows(s: DataFrame, f: DataFrame, t: DataFrame) -> DataFrame:
    one = lambda d, w: d.select(content_id(F.col("prompt")).alias("pid"), F.length("prompt").alias("len"), w.alias("weight"))
    rows = pipelines.rebuilt_set([one(s, F.lit(1)), one(f, F.when(F.col("system").isNull(), 3).otherwise(0))], t.select(content_id(F.col("prompt")).alias("pid")), 700, "pid", "len", "weight")
    return rows.groupBy("pid", "copy").agg(F.count(F.lit(1)).alias("n"))


@on("documents")
def context_rows(d: DataFrame) -> DataFrame:
    return pipelines.context_set(d.withColumn("kind", F.coalesce("doc_kind", F.lit(""))), "kind", "doc_id", 60, ["on", "off"], ["plain", "review"], {"spec": 3}, "c1")


@on("forged")
def mutant_draw(f: DataFrame) -> DataFrame:
    rows = f.where("chosen is not null").withColumn("grp", F.coalesce("source_file", F.lit("")))
    return pipelines.mutant_sample(rows, "pair_id", "chosen", "grp", _EDITS, 40, "m1").select("pair_id", "kind", "place", F.md5("mutant").alias("mutant"))


def _results(e: DataFrame) -> DataFrame:
    level = F.array_position(F.array(*map(F.lit, ("L1_fail", "L2_fail", "L3_mismatch", "L3_pass"))), F.col("exec_level"))
    return _runs(e).select(F.concat(F.lit("m"), F.least("candidate_index", F.lit(2)).cast("string")).alias("model"), F.col("example_id").alias("test_id"), ((level - 1) / 3).alias("score"), F.when(F.col("run_status") == "TIMEOUT", "timeout").alias("critical"), "exec_level", "exec_id")


@on("exec_results")
def suite_means(e: DataFrame) -> DataFrame:
    return pipelines.suite_scores(_results(e), F.col("exec_level") == "L1_fail")


@on("exec_results")
def model_table(e: DataFrame) -> DataFrame:
    return pipelines.compared(_results(e), ["m0", "m1", "m2"])


@on("exec_results")
def score_deltas(e: DataFrame) -> DataFrame:
    return pipelines.against_previous(_results(e).select("test_id", "exec_id", "score"), ["test_id"], ["exec_id"], "score").select("exec_id", F.round("delta", 6).alias("delta"), "sign")


@on("exec_results")
def critical_tests(e: DataFrame) -> DataFrame:
    found = _runs(e).select(F.col("example_id").alias("test_id"), F.col("exec_level").alias("item"), F.when(F.col("run_status") == "FINISHED_OK", "claimed").otherwise("missed").alias("status"), F.col("run_status").alias("verdict"), F.when(F.col("exec_level") == "L1_fail", F.lit(None)).otherwise(F.col("run_status")).alias("expected"))
    return pipelines.critical_failure(found, ["L3_pass"], ["L1_fail", "L2_fail"], found.where("item = 'L3_mismatch'"))


@on("exec_results", "source_examples")
def forge_audit(e: DataFrame, s: DataFrame) -> DataFrame:
    """A forge run over the first candidates, merged with the others as a later run; shares of levels against their caps."""
    c = _runs(e).select("example_id", F.col("exec_id").alias("idx"), F.concat_ws(" ", F.lit("candidate output of the run"), "exec_level", F.col("exec_id").cast("string")).alias("text"), F.col("exec_level").alias("level"), F.lit(None).cast("double").alias("confidence"), F.col("candidate_index").alias("run"))
    chosen = s.where("reference is not null and id is not null").groupBy(F.lower("id").alias("example_id")).agg(F.min("reference").alias("chosen"))
    return pipelines.forge_stages(c.where("run > 0"), chosen, c.where("run = 0"), {"L1_fail": 0.3, "L2_fail": 0.3})[2]


@on("exec_results", "setup_bundles")
def distilled_set(e: DataFrame, b: DataFrame) -> DataFrame:
    kinds = b.select(F.col("example_id").alias("prompt_id"), F.upper(F.regexp_replace("component_type", r"[\s_-]+", "")).alias("group"))
    rows = _samples(e).join(kinds, "prompt_id").withColumn("accepted", F.col("status").isin("pass", "L3_mismatch"))
    plan = kinds.groupBy("group").agg(F.floor(F.count(F.lit(1)) / 4).cast("int").alias("quota"))
    return pipelines.distilled(rows, plan, 100_000, "d1").select("prompt_id", "group", "sample")


@on("documents", "suite_tests")
def pool_report(d: DataFrame, t: DataFrame) -> DataFrame:
    """Size of a pool away from held-out tests and how close its held side comes to the rest."""
    classes = cut(S.near_duplicate_classes(d))
    pool, report = pipelines.executable_pool(d, t, classes, S.holdout(classes, d), "doc_id", "text", "item_id", "prompt")
    return pool.agg(F.count(F.lit(1)).alias("texts"), F.count_if("held").alias("held")).join(report.select("over", "passed"))


@on("exec_results")
def correction_outcomes(e: DataFrame) -> DataFrame:
    rows = _samples(e).select(F.col("prompt_id").alias("task_id"), F.struct("candidate_index", "sample").alias("round"), "status", F.when(F.col("candidate_index") > 1, "judge").otherwise("self").alias("author"))
    return pipelines.self_corrections(rows)


@on("exec_results")
def port_scores(e: DataFrame) -> DataFrame:
    return pipelines.worst_of_ports(_runs(e).select(F.col("example_id").alias("case"), F.col("exec_level").alias("status")), ["L2_fail", "L3_mismatch", "L3_pass"])


@on("source_examples", "suite_tests")
def trace_modes(s: DataFrame, t: DataFrame) -> DataFrame:
    pid = content_id(F.col("prompt")).alias("pid")
    return pipelines.doubled_modes(s.select(pid), t.select(pid), "pid", ["on", "off"])


@on("exec_results", "setup_bundles")
def reusable_samples(e: DataFrame, b: DataFrame) -> DataFrame:
    """Examples whose runs are all of one status and have candidates 0 and 1."""
    state = _runs(e).select("example_id", F.col("candidate_index").alias("i"), "run_status")
    return pipelines.matching_reuse(state, b.select("example_id", F.lit("FINISHED_OK").alias("run_status")), "example_id", ["run_status"], "i", 2)


@on("source_examples")
def removal_invariant(s: DataFrame) -> DataFrame:
    """After removing repeats every prompt must still be there, in the old order."""
    rows = s.select("rec_id", content_id(F.col("prompt")).alias("pid"))
    kept = cut(keep_first(rows, ["pid"], ["rec_id"]))
    lost = pipelines.lost_prompts(rows, kept, "pid").agg(F.count(F.lit(1)).alias("lost"))
    return lost.join(pipelines.ordered_subset(kept, rows, "rec_id", "rec_id"))


@on("exec_results")
def difference_forms(e: DataFrame) -> DataFrame:
    """Second against first candidates: Welch's interval and that of differences within examples."""
    r = _results(e).where("model in ('m0', 'm1')")
    v, side = F.col("score"), F.when(F.col("model") == "m1", 1).otherwise(0)
    m = r.agg(*[x.alias(n) for k in (0, 1) for x, n in ((F.avg(F.when(side == k, v)), f"m{k}"), (F.var_samp(F.when(side == k, v)), f"v{k}"), (F.count(F.when(side == k, v)), f"n{k}"))])
    d, low, high = stats.welch_difference(*map(F.col, ("m0", "v0", "n0", "m1", "v1", "n1")))
    c = stats.clustered_difference(r, "test_id", side, v)
    cut_off = lambda d: d.select([F.round(x, 6).alias(x) if k == "double" else F.col(x) for x, k in d.dtypes])
    return cut_off(m.select(d.alias("difference"), low.alias("low"), high.alias("high")).withColumn("form", F.lit("welch"))).unionByName(cut_off(c.drop("clusters")).withColumn("form", F.lit("clustered")))


@on("exec_results")
def paired_bootstrap(e: DataFrame) -> DataFrame:
    """2000 resamples of the examples' differences between second and first candidates."""
    r = _results(e).groupBy("test_id").agg(F.avg(F.when(F.col("model") == "m0", F.col("score"))).alias("a"), F.avg(F.when(F.col("model") == "m1", F.col("score"))).alias("b"))
    told = stats.paired_bootstrap(r.select("test_id", (F.col("b") - F.col("a")).alias("d")), "test_id", "d")
    return told.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "n")


@on("forged_provenance")
def usage_accounts(p: DataFrame) -> DataFrame:
    """Tokens allowed by level, and the share of generations that a cache of equal settings and prompts would have served."""
    g = F.col("provenance.gen_meta")
    rows = p.select("rejected_exec_level", g.max_new_tokens.alias("tokens"), F.struct("example_id", g.temperature, g.top_p, g.max_new_tokens).alias("asked"))
    first = rows.groupBy("rejected_exec_level", "asked").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return first.groupBy("rejected_exec_level").agg(F.sum("n").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.try_divide(F.sum(F.col("n") - 1), F.sum("n")), 6).alias("hit_rate"))


@on("forged_provenance")
def top_modes_by_level(p: DataFrame) -> DataFrame:
    n = p.select("rejected_exec_level", F.explode("rejected_failure_modes").alias("mode")).groupBy("rejected_exec_level", "mode").agg(F.count(F.lit(1)).alias("n"))
    return selection.top_per_group(n, ["rejected_exec_level"], [F.col("n").desc(), F.col("mode")], 3)


@on("setup_bundles")
def rarest_components(b: DataFrame) -> DataFrame:
    return selection.rarest_first(b.select("example_id", "component_type"), "component_type", "example_id", "r1")


@on("suite_tests")
def drawn_positions(t: DataFrame) -> DataFrame:
    """Six hundred draws, two and a half times through the tests."""
    return selection.draws(t, "item_id", 600, "e2")


@on("exec_results")
def custom_order(e: DataFrame) -> DataFrame:
    """A place for each run: by level in a given order, longer logs first, runs with a difference before others."""
    rank = F.array_position(F.array(*map(F.lit, ("L3_mismatch", "L3_pass", "L2_fail", "L1_fail"))), F.col("exec_level"))
    order = [rank, (-F.length("log_excerpt")), F.coalesce(F.length("output_diff") > 0, F.lit(False)).desc(), F.col("exec_id")]
    from weftline.operators.scale import global_row_number

    return global_row_number(_runs(e), order, "place").select("exec_id", F.col("place").cast("bigint").alias("place"))


@on("source_examples", "suite_tests")
def masked_nearest(s: DataFrame, t: DataFrame) -> DataFrame:
    """The test that a prompt is most like when names are masked."""
    near = S.nearest(s, t, "rec_id", "item_id", "prompt", "prompt", 0.1, masked=True)
    return near.select("rec_id", "item_id", "shared", F.round("jaccard", 6).alias("jaccard"))


@on("forged")
def matching_ratios(f: DataFrame) -> DataFrame:
    """Twice the matching characters over the length of both sides, for pairs of similar length."""
    rows = f.where("length(rejected) between 0.7 * length(chosen) and 1.4 * length(chosen)")
    return rows.select("pair_id", F.round(S.matching_ratio(F.col("chosen"), F.col("rejected")), 6).alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (
        runnable_codes, loose_reviews, component_sources, code_requests, stop_lengths, bare_tasks, listed_modes, picked_domains, nearby_claims, call_counts, overload_types, shape_counts, merged_reasoning, repair_queue, prompt_set,
        execution_rows, false_alarms, retry_rows, rebuilt_rows, context_rows, mutant_draw, suite_means, model_table, score_deltas, critical_tests, forge_audit, distilled_set, pool_report, correction_outcomes, port_scores, trace_modes,
        reusable_samples, removal_invariant, difference_forms, paired_bootstrap, usage_accounts, top_modes_by_level, rarest_components, drawn_positions, custom_order, masked_nearest, matching_ratios,
    )
}

_PID = f"substr(sha256({_norm('prompt')}), 1, 16)"
_TRIM = lambda x: f"regexp_replace({x}, '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g')"
_SAMPLES = f"{_R}, s AS (SELECT example_id AS prompt_id, exec_id AS sample, CASE WHEN exec_level = 'L3_pass' THEN 'pass' ELSE exec_level END AS status, run_status, output_diff, candidate_index, log_excerpt AS text FROM r)"
_RESULTS = f"{_R}, t AS (SELECT 'm' || least(candidate_index, 2) AS model, example_id AS test_id, (list_position(['L1_fail', 'L2_fail', 'L3_mismatch', 'L3_pass'], exec_level) - 1) / 3 AS score, CASE WHEN run_status = 'TIMEOUT' THEN 1 END AS critical, exec_level, exec_id FROM r)"
_SENTENCES = "string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"


def _rule_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{v}'" for p, v in _TYPES) + " ELSE '' END"


def _claim_sql(name: str, pattern: str) -> str:
    tests = f"regexp_matches(s, '(?i){pattern}') AND NOT regexp_matches(s, '(?i)(?:{_NEGATION})[^.!?\\n]{{0,40}}(?:{pattern})') AND NOT regexp_matches(s, '(?i)(?:{pattern})[^.!?\\n]{{0,40}}(?:{_NEGATION})') AND NOT regexp_matches(s, '(?i){_EXEMPT}')"
    return f"CASE WHEN len(list_filter({_SENTENCES}, lambda s: {tests})) > 0 THEN '{name}' END"


def _asked_sql() -> str:
    return f"regexp_matches(prompt, '(?i)\\b({'|'.join(_VERBS)})\\b[^.\\n]{{0,80}}\\b({'|'.join(_THINGS)})\\b')"


def _bare_sql() -> str:
    t = f"regexp_replace(replace(coalesce(prompt, ''), chr(13), ''), '{FENCE}', '', 'g')"
    for p in _INSTRUCTIONS:
        t = f"regexp_replace({t}, '(?im)(^|[.:] +){p}[^.\\n]*(\\.|$)', '\\1', 'g')"
    t = f"trim(regexp_replace(regexp_replace({t}, '[ \\t]+\\n', '\\n', 'g'), '\\n{{3,}}', '\\n\\n', 'g'), ' ')".replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)")
    return t


_HASH = lambda seed, key: f"sha256('{seed}|' || {key})"
_PROMPTS = f"p AS (SELECT * FROM (SELECT {_PID} AS prompt_id, CASE WHEN reference IS NULL THEN 'open' WHEN contains(reference, 'return ALL') THEN 'all' ELSE 'ok' END AS task, rec_id, meta['failure_mode'] AS mode, row_number() OVER (PARTITION BY {_PID} ORDER BY rec_id) AS rn FROM source_examples) WHERE rn = 1)"
_MUTANTS = r"""m AS (SELECT pair_id, coalesce(source_file, '') AS grp, x.kind AS kind, x.m AS mutant FROM (SELECT pair_id, source_file, chosen, unnest([{'kind': 'inverted', 'm': regexp_replace(chosen, 'if \(!isnull', 'if (isnull', 'g')}, {'kind': 'wrong_return', 'm': regexp_replace(chosen, 'return (OK|ALL);', 'return SKIP;', 'g')}]) AS x FROM forged WHERE chosen IS NOT NULL) WHERE x.m <> chosen)"""

# call_counts follows nested brackets, paired_bootstrap draws by a hash, matching_ratios finds matching blocks: no SQL states them.
# They are tested against brute force.
ORACLES = {
    "runnable_codes": rf"""
        WITH b AS (SELECT pair_id, regexp_replace(list_extract(list_filter(regexp_extract_all(list_extract(string_split(coalesce(chosen, ''), '</think>'), -1), '{FENCE}', 2), lambda x: regexp_matches(x, '\bfunction[ \t\n]+[A-Za-z_]')), -1), '^\s+|\s+$', '', 'g') AS c FROM forged)
        SELECT pair_id, md5(coalesce(CASE WHEN starts_with(c, '//#CTL2') THEN c ELSE '//#CTL2' || chr(10) || c END, '')) AS code FROM b""",
    "loose_reviews": """SELECT DISTINCT exec_id, CASE exec_level WHEN 'L1_fail' THEN 'FAIL' WHEN 'L2_fail' THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE exec_level WHEN 'L1_fail' THEN 'stated' WHEN 'L3_mismatch' THEN 'alone' ELSE 'findings' END AS source,
        CAST(CASE exec_level WHEN 'L2_fail' THEN 2 WHEN 'L3_mismatch' THEN 0 ELSE 1 END AS BIGINT) AS kept, CAST(CASE exec_level WHEN 'L3_mismatch' THEN 1 ELSE 0 END AS BIGINT) AS dropped, CASE WHEN exec_level IN ('L1_fail', 'L2_fail') THEN 'FAIL' ELSE 'PASS' END AS standing FROM exec_results""",
    "component_sources": f"""
        WITH l AS (SELECT doc_id, nullif(regexp_replace(upper(trim(component, ' ')), '[\\s-]+', '_', 'g'), '') AS k, {_rule_sql("coalesce(text, '')")} AS i FROM documents)
        SELECT doc_id, coalesce(CASE k WHEN 'ROLL_UP' THEN 'ROLLUP' WHEN 'HASH_JOIN' THEN 'EXT_HASH_JOIN' ELSE k END, i) AS value, CASE WHEN k IS NOT NULL THEN 'declared' WHEN i <> '' THEN 'text' ELSE 'none' END AS source FROM l""",
    "code_requests": f"SELECT rec_id, {_asked_sql()} AS asked, {_asked_sql()} AND contains(prompt, '<Record') AS with_record FROM source_examples",
    "stop_lengths": f"""
        WITH t AS (SELECT doc_id, list_transform({_WORDS.format('text')}, lambda w: length(w))[:40] AS t FROM documents), a AS (SELECT *, nullif(least(coalesce(nullif(list_position(t, 13), 0), 999), coalesce(nullif(list_position(t, 17), 0), 999)), 999) AS p FROM t)
        SELECT doc_id, CAST(coalesce(p - 1, len(t)) AS INT) AS length, p IS NULL AND len(t) >= 40 AS hit_cap FROM a""",
    "bare_tasks": f"SELECT rec_id, md5(upper(left(t, 1)) || substr(t, 2)) AS task FROM (SELECT rec_id, {_bare_sql()} AS t FROM source_examples)",
    "listed_modes": "SELECT DISTINCT pair_id, CASE WHEN len(m) > 1 THEN array_to_string(list_transform(m, lambda c, i: i || ') ' || c), '  OR  ') ELSE coalesce(m[1], '') END AS modes FROM (SELECT pair_id, list_sort(coalesce(rejected_failure_modes, [])) AS m FROM forged_provenance)",
    "picked_domains": f"SELECT example_id, {list(_DOMAINS)}[1 + CAST('0x' || left(sha256('domain|' || example_id), 8) AS BIGINT) % 5] AS domain FROM setup_bundles",
    "nearby_claims": f"SELECT doc_id, array_to_string(list_filter([{', '.join(_claim_sql(n, p) for n, p in sorted(_DETECTORS.items()))}], lambda x: x IS NOT NULL), ',') AS claims FROM documents",
    "overload_types": """
        SELECT name, arguments, count(*) AS n, any_value(result) AS returns FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'nvl' WHEN 'O' THEN 'append' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'abs' ELSE 'concat' END END AS name,
            CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'integer,long' ELSE 'string,long' END WHEN 'O' THEN 'list<string>,string' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'integer' ELSE 'string,date,integer' END END AS arguments,
            CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'long' END WHEN 'O' THEN 'list<string>' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'long/number' ELSE 'string' END END AS result FROM orders) GROUP BY 1, 2""",
    "shape_counts": """
        WITH k AS (SELECT prompt, CASE WHEN system IS NOT NULL THEN 'messages' WHEN chosen IS NULL THEN 'unknown' WHEN length(prompt) > 300 THEN 'conversations' ELSE 'instruction' END AS shape FROM forged)
        SELECT shape, CASE WHEN shape = 'unknown' THEN 'no_messages' WHEN trim(prompt) = '' THEN 'empty_user' ELSE 'ok' END AS state, count(*) AS n, CAST(sum(CASE WHEN shape <> 'unknown' THEN length(prompt) END) AS BIGINT) AS chars FROM k GROUP BY 1, 2""",
    "merged_reasoning": "SELECT rec_id, md5('<think>' || chr(10) || regexp_replace(system, '^\\s+|\\s+$', '', 'g') || chr(10) || '</think>' || chr(10) || chr(10) || regexp_replace(reference, '(?s)^\\s*<think>.*?</think>\n*', '')) AS answer FROM source_examples WHERE reference IS NOT NULL AND trim(coalesce(system, '')) <> ''",
    "repair_queue": f"""
        WITH {_R}, g AS (SELECT example_id, exec_level, log_excerpt, list_position(['L3_mismatch', 'L2_fail', 'L1_fail'], exec_level) AS k, lower({_norm('log_excerpt')}) AS form FROM r WHERE exec_level <> 'L3_pass' AND length(trim(log_excerpt, ' ')) >= 10),
        o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, form ORDER BY k, log_excerpt) AS rn FROM g) WHERE rn = 1)
        SELECT example_id, exec_level, row_number() OVER (ORDER BY k, example_id, log_excerpt) AS place, count(*) OVER (PARTITION BY example_id) AS variants, md5(log_excerpt) AS log FROM o""",
    "prompt_set": f"""
        WITH {_PROMPTS}, h AS (SELECT {_PID} AS prompt_id FROM suite_tests UNION SELECT prompt_id FROM p WHERE task = 'open'),
        f AS (SELECT prompt_id, task, CASE WHEN mode = 'null_handling' THEN 'target' WHEN mode IS NOT NULL AND task = 'all' THEN 'hard' END AS "set" FROM p WHERE prompt_id NOT IN (SELECT prompt_id FROM h)),
        n AS (SELECT ceil(count(*) * (1 / 3.0) / (1 - 1 / 3.0) - 1e-9) AS wanted FROM f WHERE "set" IS NOT NULL),
        d AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {_HASH('p1', 'prompt_id')}, prompt_id) AS rn FROM f WHERE "set" IS NULL)
        SELECT prompt_id, task, "set", CASE WHEN "set" = 'hard' THEN 2 ELSE 1 END AS weight FROM f WHERE "set" IS NOT NULL
        UNION ALL SELECT prompt_id, task, 'replay', 1 FROM d CROSS JOIN n WHERE rn <= floor(wanted * CASE task WHEN 'ok' THEN 0.75 WHEN 'all' THEN 0.25 ELSE 0 END + 0.5)""",
    "execution_rows": f"""
        WITH {_SAMPLES}, g AS (SELECT prompt_id FROM s GROUP BY 1 HAVING bool_or(status = 'pass') AND NOT bool_and(status = 'pass')),
        c AS (SELECT prompt_id, sample, row_number() OVER (PARTITION BY prompt_id ORDER BY {_HASH('x1', 'sample')}, sample) AS rn FROM s JOIN g USING (prompt_id) WHERE status = 'pass'),
        w AS (SELECT prompt_id, sample, status, row_number() OVER (PARTITION BY prompt_id ORDER BY list_position(['L1_fail', 'L2_fail', 'L3_mismatch'], status), sample) AS rn FROM s JOIN g USING (prompt_id) WHERE status <> 'pass')
        SELECT prompt_id, 'sft' AS kind, sample, NULL AS rejected, 'pass' AS status FROM c WHERE rn <= 2
        UNION ALL SELECT c.prompt_id, 'dpo', c.sample, w.sample, w.status FROM c JOIN w ON c.prompt_id = w.prompt_id AND c.rn = w.rn WHERE c.rn <= 2""",
    "false_alarms": f"""
        WITH {_SAMPLES}, k AS (SELECT *, coalesce(length(output_diff) > 0, false) AS alarm FROM s WHERE run_status = 'FINISHED_OK'),
        b AS (SELECT prompt_id, sample, row_number() OVER (PARTITION BY prompt_id ORDER BY {_HASH('g1', 'sample')}, sample) AS rn FROM k WHERE alarm),
        g AS (SELECT prompt_id, sample, row_number() OVER (PARTITION BY prompt_id ORDER BY {_HASH('g1', 'sample')}, sample) AS rn, count(*) OVER (PARTITION BY prompt_id) AS n FROM k WHERE NOT alarm)
        SELECT b.prompt_id, g.sample AS chosen, b.sample AS rejected FROM b JOIN g ON b.prompt_id = g.prompt_id AND (b.rn - 1) % g.n + 1 = g.rn""",
    "retry_rows": f"""
        WITH {_SAMPLES}, e AS (SELECT prompt_id AS task_id, arg_min(status, (candidate_index, sample)) AS first, arg_max(status, (candidate_index, sample)) AS final, arg_max(text, (candidate_index, sample)) AS text FROM s GROUP BY 1),
        w AS (SELECT *, 'The feedback was right. Now every row is kept as it came. Done ```x```. ' || text AS whole FROM e WHERE final = 'pass' AND first <> 'pass'),
        c AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(whole, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT (regexp_matches(x, '(?i)feedback') AND NOT contains(x, '```'))), ' ') AS t FROM w)
        SELECT task_id, first, CASE WHEN NOT contains(t, '```') THEN 'lost_code' WHEN length(t) < 20 OR length(t) * 3 < length(whole) THEN 'shrunk' ELSE 'kept' END AS outcome, length(t) AS n FROM c""",
    "rebuilt_rows": f"""
        WITH u AS (SELECT {_PID} AS pid, length(prompt) AS len, 1 AS weight FROM source_examples UNION ALL SELECT {_PID}, length(prompt), CASE WHEN system IS NULL THEN 3 ELSE 0 END FROM forged)
        SELECT pid, CAST(copy AS INT) AS copy, count(*) AS n FROM (SELECT pid, unnest(range(1, weight + 1)) AS copy FROM u WHERE len <= 700 AND pid NOT IN (SELECT {_PID} FROM suite_tests)) GROUP BY 1, 2""",
    "context_rows": f"""
        WITH k AS (SELECT doc_id, coalesce(doc_kind, '') AS kind, count(*) OVER (PARTITION BY coalesce(doc_kind, '')) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY coalesce(doc_kind, '') ORDER BY {_HASH('c1', 'doc_id')}, doc_id) AS rn FROM documents)
        SELECT doc_id, kind, mode, form, CASE WHEN kind = 'spec' THEN 3 ELSE 1 END AS weight FROM k, (SELECT unnest(['on', 'off']) AS mode), (SELECT unnest(['plain', 'review']) AS form) WHERE rn <= greatest(1, floor(60.0 * n / total + 0.5))""",
    "mutant_draw": f"""
        WITH {_MUTANTS}, t AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY {_HASH('m1', "(kind || '|' || pair_id)")}, kind || '|' || pair_id) AS turn, count(*) OVER (PARTITION BY kind, grp) AS size FROM m)
        SELECT pair_id, kind, CAST(place AS INT) AS place, md5(mutant) AS mutant FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY turn, size, grp, pair_id) AS place FROM t) WHERE place <= 40""",
    "suite_means": f"WITH {_RESULTS} SELECT model, count(*) AS tests, round(avg(CAST(score AS DECIMAL(18,6))), 6) AS mean, round(avg(CAST(score AS DECIMAL(18,6))) FILTER (exec_level <> 'L1_fail'), 6) AS mean_inside, count(critical) AS critical FROM t GROUP BY 1",
    "model_table": f"WITH {_RESULTS}, a AS (SELECT test_id, model, format('{{:.3f}}', avg(CAST(score AS DECIMAL(18,6)))) AS s FROM t GROUP BY 1, 2) SELECT test_id, coalesce(max(s) FILTER (model = 'm0'), '—') AS m0, coalesce(max(s) FILTER (model = 'm1'), '—') AS m1, coalesce(max(s) FILTER (model = 'm2'), '—') AS m2 FROM a GROUP BY 1",
    "score_deltas": f"WITH {_RESULTS}, d AS (SELECT exec_id, score - lag(score) OVER (PARTITION BY test_id ORDER BY exec_id) AS d FROM t) SELECT exec_id, round(d, 6) AS delta, CASE WHEN abs(d) < 5e-4 THEN '=' WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' END AS sign FROM d",
    "critical_tests": f"""
        WITH {_R}, f AS (SELECT example_id AS test_id, exec_level AS item, run_status <> 'FINISHED_OK' AS missed FROM r),
        a AS (SELECT test_id, bool_or(missed AND item = 'L3_pass') AS one, count(DISTINCT CASE WHEN missed AND item IN ('L1_fail', 'L2_fail') THEN item END) = 2 AS every, bool_or(NOT missed AND item = 'L3_mismatch') AS trap, bool_or(item = 'L1_fail') AS verdict FROM f GROUP BY 1)
        SELECT test_id, CASE WHEN one THEN 'missed_item' WHEN every THEN 'missed_all' WHEN trap THEN 'trap' ELSE 'verdict' END AS failure FROM a WHERE one OR every OR trap OR verdict""",
    "forge_audit": f"""
        WITH {_R}, g AS (SELECT DISTINCT lower(id) AS example_id FROM source_examples WHERE reference IS NOT NULL AND id IS NOT NULL),
        c AS (SELECT example_id, exec_level AS level, row_number() OVER (PARTITION BY example_id ORDER BY list_position(['L1_fail', 'L2_fail', 'L3_mismatch'], exec_level) DESC, exec_id) AS rn FROM r JOIN g USING (example_id) WHERE exec_level <> 'L3_pass')
        SELECT level, count(*) AS n, round(count(*) / (SELECT count(*) FROM c WHERE rn = 1), 6) AS share, count(*) > (SELECT count(*) FROM c WHERE rn = 1) * CASE WHEN level IN ('L1_fail', 'L2_fail') THEN 0.3 ELSE 1 END AS over FROM c WHERE rn = 1 GROUP BY level""",
    "distilled_set": f"""
        WITH {_SAMPLES}, k AS (SELECT example_id AS prompt_id, upper(regexp_replace(component_type, '[\\s_-]+', '', 'g')) AS "group" FROM setup_bundles), q AS (SELECT "group", count(*) // 4 AS quota FROM k GROUP BY 1),
        o AS (SELECT * FROM (SELECT prompt_id, "group", sample, row_number() OVER (PARTITION BY prompt_id ORDER BY {_HASH('d1', 'sample')}, sample) AS rn FROM s JOIN k USING (prompt_id) WHERE status IN ('pass', 'L3_mismatch') AND length(text) <= 100000) WHERE rn = 1)
        SELECT prompt_id, "group", sample FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY {_HASH('d1', 'prompt_id')}, prompt_id) AS n FROM o) JOIN q USING ("group") WHERE n <= quota""",
    "correction_outcomes": f"""
        WITH {_SAMPLES}, a AS (SELECT prompt_id AS task_id, arg_min(status = 'pass' AND candidate_index <= 1, (candidate_index, sample)) AS f, bool_or(status = 'pass' AND candidate_index <= 1) AS own, bool_or(status = 'pass') AS anyone, count(*) AS rounds FROM s GROUP BY 1)
        SELECT task_id, CASE WHEN f THEN 'first_pass' WHEN own THEN 'self_corrected' WHEN anyone THEN 'judge_fixed' ELSE 'failed' END AS outcome, rounds FROM a""",
    "port_scores": f"WITH {_R} SELECT example_id AS case, CASE WHEN bool_or(exec_level = 'L1_fail') THEN 'L1_fail' WHEN bool_or(exec_level = 'L2_fail') THEN 'L2_fail' WHEN bool_or(exec_level = 'L3_mismatch') THEN 'L3_mismatch' ELSE 'L3_pass' END AS status, count(*) AS ports FROM r GROUP BY 1",
    "trace_modes": f"SELECT pid, mode FROM (SELECT DISTINCT {_PID} AS pid FROM source_examples) CROSS JOIN (SELECT unnest(['on', 'off']) AS mode) WHERE pid NOT IN (SELECT {_PID} FROM suite_tests)",
    "reusable_samples": f"WITH {_R} SELECT example_id FROM r JOIN setup_bundles USING (example_id) GROUP BY 1 HAVING bool_and(run_status = 'FINISHED_OK') AND count(DISTINCT CASE WHEN candidate_index IN (0, 1) THEN candidate_index END) = 2",
    "removal_invariant": "SELECT CAST(0 AS BIGINT) AS lost, true AS subset, true AS ordered",
    "difference_forms": f"""
        WITH {_RESULTS}, x AS (SELECT * FROM t WHERE model IN ('m0', 'm1')),
        w AS (SELECT avg(score) FILTER (model = 'm1') - avg(score) FILTER (model = 'm0') AS d, 1.96 * sqrt(var_samp(score) FILTER (model = 'm0') / count(*) FILTER (model = 'm0') + var_samp(score) FILTER (model = 'm1') / count(*) FILTER (model = 'm1')) AS h FROM x),
        p AS (SELECT avg(score) FILTER (model = 'm1') - avg(score) FILTER (model = 'm0') AS d FROM x GROUP BY test_id), c AS (SELECT avg(d) AS d, 1.96 * stddev_samp(d) / sqrt(count(d)) AS h FROM p)
        SELECT round(d, 6) AS difference, round(d - h, 6) AS low, round(d + h, 6) AS high, 'welch' AS form FROM w UNION ALL SELECT round(d, 6), round(d - h, 6), round(d + h, 6), 'clustered' FROM c""",
    "usage_accounts": """
        WITH u AS (SELECT rejected_exec_level, example_id, provenance.gen_meta AS g, count(*) AS n, sum(provenance.gen_meta.max_new_tokens) AS tokens FROM forged_provenance GROUP BY 1, 2, 3)
        SELECT rejected_exec_level, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(n - 1) / sum(n), 6) AS hit_rate FROM u GROUP BY 1""",
    "top_modes_by_level": "SELECT rejected_exec_level, mode, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rejected_exec_level ORDER BY n DESC, mode) AS rank FROM (SELECT rejected_exec_level, unnest(rejected_failure_modes) AS mode, count(*) AS n FROM forged_provenance GROUP BY 1, 2)) WHERE rank <= 3",
    "rarest_components": f"""
        WITH t AS (SELECT example_id, component_type, row_number() OVER (PARTITION BY component_type ORDER BY {_HASH('r1', 'example_id')}, example_id) AS turn, count(*) OVER (PARTITION BY component_type) AS size FROM setup_bundles)
        SELECT example_id, component_type, row_number() OVER (ORDER BY turn, size, component_type, example_id) AS place FROM t""",
    "drawn_positions": """
        WITH e AS (SELECT item_id, CAST(epoch AS INT) AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('e2|' || epoch || '|' || item_id), item_id) AS place, count(*) OVER (PARTITION BY epoch) AS n FROM suite_tests CROSS JOIN (SELECT unnest(range(3)) AS epoch))
        SELECT epoch * n + place - 1 AS draw, epoch, place, item_id FROM e WHERE epoch * n + place - 1 < 600""",
    "custom_order": f"WITH {_R} SELECT exec_id, row_number() OVER (ORDER BY list_position(['L3_mismatch', 'L3_pass', 'L2_fail', 'L1_fail'], exec_level), length(log_excerpt) DESC, coalesce(length(output_diff) > 0, false) DESC, exec_id) AS place FROM r",
}
