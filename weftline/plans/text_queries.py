"""Normalisation, identity, extraction and classification of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.tables import on

#: Words of the test tables' remarks that speak of data, and words that only speak of the feed.
_ABOUT_DATA = r"(?i)\b(comparison|scale|missing|compared|default)\b"
_ABOUT_FEED = r"(?i)\b(guard|graph|feed)\b"
_SPACE_SQL = T.SPACE.replace("'", "''")


def _norm(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{_SPACE_SQL}+', ' ', 'g'))"


_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_FENCE_SQL = T.FENCE


@on("source_examples")
def norm_ids(s: DataFrame) -> DataFrame:
    return s.select("rec_id", T.content_id(F.col("prompt")).alias("prompt_id"), F.length(T.normal_space(F.col("prompt"))).cast("bigint").alias("norm_len"))


@on("documents")
def word_forms(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.size(T.word_list(F.col("text"))).cast("bigint").alias("n_words"), F.md5(T.word_form(F.col("text"))).alias("form"))


@on("forged")
def code_extract(f: DataFrame) -> DataFrame:
    c = F.col("chosen")
    return f.select("pair_id", F.size(T.code_blocks(c)).cast("bigint").alias("n_blocks"), F.md5(T.main_block(c)).alias("main_md5"), F.length(T.without_fences(c)).cast("bigint").alias("prose_len"))


@on("forged")
def called_functions(f: DataFrame) -> DataFrame:
    return f.select("pair_id", F.array_join(T.called_functions(F.col("chosen")), ",").alias("calls"))


@on("source_examples")
def task_classes(s: DataFrame) -> DataFrame:
    """validate, fix, generate or other by ordered rules; the component as the prompt names it; a lexicon score."""
    p, r = F.col("prompt"), F.coalesce("reference", F.lit(""))
    task = F.when(r.rlike(r"(?im)^\s*VERDICT\s*:"), "validate").when(~r.contains("function "), "other").when(p.contains("$out."), "fix").otherwise("generate")
    named = F.upper(F.regexp_extract(p, r"(?i)(?:component: |for |\"component\": \")([a-z_]+)", 1))
    return s.select("rec_id", task.alias("task"), F.nullif(named, F.lit("")).alias("component"), T.lexicon_score(r, _ABOUT_DATA, _ABOUT_FEED).cast("bigint").alias("score"))


@on("source_examples")
def think_split(s: DataFrame) -> DataFrame:
    raw = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("<think>a</think> b "), F.coalesce("reference", F.lit("")))).when(F.col("rec_id") % 3 == 1, F.concat(F.lit("<think>"), F.col("prompt"), F.lit("</think>\n\n"), F.coalesce("reference", F.lit("")))).otherwise(F.col("reference"))
    return s.select("rec_id", T.split_thinking(raw).alias("x")).select("rec_id", F.md5("x.thinking").alias("thinking"), F.md5("x.answer").alias("answer"))


@on("exec_results")
def review_verdicts(e: DataFrame) -> DataFrame:
    """Parses review answers written from the results of runs."""
    text = F.concat(
        F.lit("ISSUES:\n"), F.when(F.col("exec_level") == "L1_fail", "- ERROR: does not compile\n- WARNING: unused\n").when(F.col("exec_level") == "L2_fail", "- ERROR: stops\n").when(F.col("exec_level") == "L3_mismatch", "- WARNING: other rows\n").otherwise("none\n"),
        F.lit("SUGGESTIONS:\nnone\nVERDICT: "), F.when(F.col("run_status") == "FINISHED_OK", "PASS").otherwise("FAIL"),
    )
    return e.select("exec_id", T.parse_review(text).alias("r")).select("exec_id", F.col("r.errors").cast("bigint").alias("errors"), F.col("r.warnings").cast("bigint").alias("warnings"), "r.verdict", "r.consistent").distinct()


@on("exec_results")
def first_errors(e: DataFrame) -> DataFrame:
    line = T.first_error(F.col("log_excerpt"))
    return e.groupBy(F.coalesce(F.regexp_replace(line, "[0-9]+", "9"), F.lit("none")).alias("line"), "run_status").agg(F.count(F.lit(1)).alias("n"))


@on("events")
def json_salvage(e: DataFrame) -> DataFrame:
    wrapped = F.concat(F.lit("<think>maybe {</think> Result: "), F.col("props"), F.lit(" -- end"))
    return e.select("event_id", T.salvage_json(wrapped).isNotNull().alias("parsed"), F.json_object_keys("props").isNotNull().alias("direct")).groupBy("parsed", "direct").agg(F.count(F.lit(1)).alias("n"))


@on("documents")
def sentence_counts(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


@on("documents")
def redactions(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.redact(F.col("text"), "(?i)checkpoint|loss").alias("r")).select("doc_id", F.length("r.kept").cast("bigint").alias("kept_len"), F.col("r.removed").cast("bigint").alias("removed"))


@on("source_examples")
def masked_forms(s: DataFrame) -> DataFrame:
    return s.select("rec_id", F.md5(F.array_join(T.masked_words(F.col("prompt")), " ")).alias("masked"))


@on("source_examples")
def meta_without_author(s: DataFrame) -> DataFrame:
    kept = F.map_filter("meta", lambda k, _: ~k.isin("author", "comment"))
    return s.select("rec_id", F.try_element_at(kept, F.lit("failure_mode")).alias("failure_mode"), F.size(F.map_keys(kept)).cast("bigint").alias("n_keys")).where("n_keys is not null")


@on("forged")
def format_gates(f: DataFrame) -> DataFrame:
    """The first failing check of an answer's form, cheapest first."""
    c = F.col("rejected")
    reason = F.when(F.coalesce(T.normal_space(c), F.lit("")) == "", "empty_answer").when(~c.contains("function "), "no_code").when(~T.normal_space(c).contains("//#"), "missing_header").when(T.missing_parts(c, {"transform": r"function +integer +transform", "return": r"\breturn\b"}).isNotNull(), "missing_part")
    return f.select("pair_id", reason.alias("reason"))


@on("forged_provenance")
def clamped_modes(p: DataFrame) -> DataFrame:
    known = ["null_handling", "wrong_port", "group_state", "date_math"]
    return p.select(F.explode(T.clamp_labels(F.col("rejected_failure_modes"), known)).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@on("setup_bundles")
def row_seeds(b: DataFrame) -> DataFrame:
    return b.select("example_id", T.row_seed(7, F.col("example_id")).alias("seed"))


@on("documents")
def text_filter(d: DataFrame) -> DataFrame:
    """Case-insensitive substring and kind filters."""
    return d.where(F.lower("text").contains("null") & F.lower("doc_kind").isin("spec", "review")).select("doc_id", "doc_kind")


@on("documents")
def detected_claims(d: DataFrame) -> DataFrame:
    """Named claims that a text makes without negating them."""
    names = T.detect(F.col("text"), {"drop": r"\bdropped\b", "fixed": r"\bfixed\b", "score": r"\bscore\b"}, r"(?:not|never)\s+")
    return d.select("doc_id", F.array_join(names, ",").alias("claims"))


@on("exec_results")
def failure_causes(e: DataFrame) -> DataFrame:
    cause = T.first_cause(F.coalesce("log_excerpt", F.lit("")), [("parse", "cannot parse"), ("retry", "retry"), ("start", "started"), ("written", "written")])
    return e.groupBy(cause.alias("cause"), "run_status").agg(F.count(F.lit(1)).alias("n"))


@on("documents")
def anchor_names(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.array_join(T.anchors(F.col("text")), ",").alias("anchors"))


@on("source_examples")
def instructed_prompts(s: DataFrame) -> DataFrame:
    x = T.with_instruction(F.col("prompt"), "Answer with ISSUES and VERDICT.", r"\bComponent\b", r"\bport 0\b")
    return s.select("rec_id", x.alias("x")).select("rec_id", "x.added", F.length("x.text").cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (norm_ids, word_forms, code_extract, called_functions, task_classes, think_split, review_verdicts, first_errors, json_salvage, sentence_counts, redactions, masked_forms, meta_without_author, format_gates, clamped_modes, row_seeds, text_filter, detected_claims, failure_causes, anchor_names, instructed_prompts)}

_BARE = r"""regexp_replace(regexp_replace(coalesce(chosen, ''), '"(?:\\.|[^"\\\n])*"', '""', 'g'), '//[^\n]*|/\*[\s\S]*?\*/', ' ', 'g')"""
_NO_CALLS = ", ".join(f"'{w}'" for w in T.NO_CALLS)

ORACLES = {
    "norm_ids": f"SELECT rec_id, substr(sha256({_norm('prompt')}), 1, 16) AS prompt_id, length({_norm('prompt')}) AS norm_len FROM source_examples",
    "word_forms": f"SELECT doc_id, len({_WORDS.format('text')}) AS n_words, md5(array_to_string({_WORDS.format('text')}, ' ')) AS form FROM documents",
    "code_extract": rf"""
        WITH b AS (SELECT pair_id, chosen, list_zip(regexp_extract_all(coalesce(chosen, ''), '{_FENCE_SQL}', 1), regexp_extract_all(coalesce(chosen, ''), '{_FENCE_SQL}', 2)) AS z FROM forged),
        c AS (SELECT pair_id, chosen, list_transform(list_filter(z, lambda x: lower(x[1]) IN ('ctl', 'ctl2') OR (x[1] = '' AND (contains(x[2], '//#') OR contains(x[2], 'function ') OR contains(x[2], '$in.')))), lambda x: regexp_replace(x[2], '^\n+|\n+$', '', 'g')) AS b FROM b)
        SELECT pair_id, len(b) AS n_blocks, md5(coalesce(list_extract(list_sort(list_transform(b, lambda x: {{'h': starts_with(x, '//#'), 'n': length(x), 'b': x}}), 'DESC'), 1).b, '')) AS main_md5,
               length(regexp_replace(coalesce(chosen, ''), '{_FENCE_SQL}', ' ', 'g')) AS prose_len FROM c""",
    "called_functions": rf"""
        WITH b AS (SELECT pair_id, {_BARE} AS t FROM forged),
        c AS (SELECT pair_id, list_distinct(regexp_extract_all(t, '([A-Za-z_][A-Za-z0-9_]*)[ \t\n]*\(', 1)) AS calls, list_transform(regexp_extract_all(t, '{T.HEADER}', 1), lambda h: list_extract(regexp_split_to_array(trim(h), '[^A-Za-z0-9_]+'), -1)) AS own FROM b)
        SELECT pair_id, array_to_string(list_sort(list_filter(calls, lambda x: NOT list_contains(own, x) AND x NOT IN ({_NO_CALLS}))), ',') AS calls FROM c""",
    "task_classes": rf"""
        SELECT rec_id, CASE WHEN regexp_matches(coalesce(reference, ''), '(?im)^\s*VERDICT\s*:') THEN 'validate' WHEN NOT contains(coalesce(reference, ''), 'function ') THEN 'other'
               WHEN contains(prompt, '$out.') THEN 'fix' ELSE 'generate' END AS task,
               nullif(upper(regexp_extract(prompt, '(?i)(?:component: |for |"component": ")([a-z_]+)', 1)), '') AS component,
               len(regexp_extract_all(t, '{_ABOUT_DATA}')) - 2 * len(regexp_extract_all(t, '{_ABOUT_FEED}')) AS score
        FROM (SELECT *, regexp_replace(coalesce(reference, ''), '{_FENCE_SQL}', ' ', 'g') AS t FROM source_examples)""",
    "think_split": rf"""
        WITH r AS (SELECT rec_id, coalesce(CASE WHEN rec_id % 3 = 0 THEN '<think>a</think> b ' || coalesce(reference, '') WHEN rec_id % 3 = 1 THEN '<think>' || prompt || '</think>' || chr(10) || chr(10) || coalesce(reference, '') ELSE reference END, '') AS t FROM source_examples),
        x AS (SELECT rec_id, t, regexp_matches(t, '(?is)</think\s*>') AS has, regexp_replace(regexp_extract(t, '(?is)^(.*)</think\s*>(.*)$', 1), '(?i)^\s*<think\s*>', '') AS h, regexp_extract(t, '(?is)^(.*)</think\s*>(.*)$', 2) AS a FROM r)
        SELECT rec_id, md5(CASE WHEN has THEN regexp_replace(h, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') ELSE regexp_replace(t, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') END) AS thinking,
               md5(CASE WHEN has THEN regexp_replace(a, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') ELSE '' END) AS answer FROM x""",
    "review_verdicts": """
        SELECT DISTINCT exec_id, CAST(CASE WHEN exec_level IN ('L1_fail', 'L2_fail') THEN 1 ELSE 0 END AS BIGINT) AS errors, CAST(CASE WHEN exec_level IN ('L1_fail', 'L3_mismatch') THEN 1 ELSE 0 END AS BIGINT) AS warnings,
               CASE WHEN run_status = 'FINISHED_OK' THEN 'PASS' ELSE 'FAIL' END AS verdict, (run_status <> 'FINISHED_OK') = (exec_level IN ('L1_fail', 'L2_fail')) AS consistent FROM exec_results""",
    "first_errors": r"""
        SELECT coalesce(regexp_replace(left(trim(list_extract(list_filter(string_split(log_excerpt, chr(10)), lambda x: regexp_matches(x, '(?i)error|fail|exception')), 1)), 200), '[0-9]+', '9', 'g'), 'none') AS line, run_status, count(*) AS n
        FROM exec_results GROUP BY ALL""",
    "json_salvage": "SELECT json_valid(props) AS parsed, json_valid(props) AS direct, count(*) AS n FROM events GROUP BY ALL",
    "sentence_counts": r"""
        SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[ \n]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '[\p{L}\p{N}_]+')) >= 4)) AS n_sentences FROM documents""",
    "redactions": r"""
        WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
        SELECT doc_id, length(array_to_string(list_filter(s, lambda x: NOT (regexp_matches(x, '(?i)checkpoint|loss') AND NOT contains(x, '```'))), ' ')) AS kept_len,
               len(list_filter(s, lambda x: regexp_matches(x, '(?i)checkpoint|loss') AND NOT contains(x, '```'))) AS removed FROM p""",
    "masked_forms": f"SELECT rec_id, md5(array_to_string(list_transform({_WORDS.format('prompt')}, lambda w: CASE WHEN contains(w, '_') THEN 'F' ELSE w END), ' ')) AS masked FROM source_examples",
    "meta_without_author": "SELECT rec_id, meta['failure_mode'] AS failure_mode, len(list_filter(map_keys(meta), lambda k: k NOT IN ('author', 'comment'))) AS n_keys FROM source_examples WHERE meta IS NOT NULL",
    "format_gates": rf"""
        WITH b AS (SELECT pair_id, rejected AS c, {_norm('rejected')} AS n, {_BARE.replace('chosen', 'rejected')} AS t FROM forged)
        SELECT pair_id, CASE WHEN n = '' THEN 'empty_answer' WHEN NOT contains(c, 'function ') THEN 'no_code' WHEN NOT contains(n, '//#') THEN 'missing_header'
               WHEN NOT regexp_matches(t, 'function +integer +transform') OR NOT regexp_matches(t, '\breturn\b') THEN 'missing_part' END AS reason FROM b""",
    "clamped_modes": "SELECT CASE WHEN m IN ('null_handling', 'wrong_port', 'group_state', 'date_math') THEN m ELSE 'other' END AS mode, count(*) AS n FROM (SELECT unnest(rejected_failure_modes) AS m FROM forged_provenance) GROUP BY ALL",
    "row_seeds": "SELECT example_id, 7 + CAST('0x' || left(example_id, 8) AS BIGINT) % 1000000 AS seed FROM setup_bundles",
    "detected_claims": r"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '(?i)(?:not|never)\s+(?:\bdropped\b)', ' ', 'g') AS a, regexp_replace(text, '(?i)(?:not|never)\s+(?:\bfixed\b)', ' ', 'g') AS b, regexp_replace(text, '(?i)(?:not|never)\s+(?:\bscore\b)', ' ', 'g') AS c FROM documents)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(a, '(?i)\bdropped\b') THEN 'drop' END, CASE WHEN regexp_matches(b, '(?i)\bfixed\b') THEN 'fixed' END, CASE WHEN regexp_matches(c, '(?i)\bscore\b') THEN 'score' END], lambda x: x IS NOT NULL), ',') AS claims FROM c""",
    "failure_causes": "SELECT CASE WHEN contains(l, 'cannot parse') THEN 'parse' WHEN contains(l, 'retry') THEN 'retry' WHEN contains(l, 'started') THEN 'start' WHEN contains(l, 'written') THEN 'written' ELSE 'other' END AS cause, run_status, count(*) AS n FROM (SELECT *, coalesce(log_excerpt, '') AS l FROM exec_results) GROUP BY 1, 2",
    "anchor_names": r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\b([A-Za-z]+(?:_[A-Za-z0-9]+)+)\b', 1), regexp_extract_all(text, '`([^`\n]+)`', 1)))), ',') AS anchors FROM documents",
    "instructed_prompts": r"SELECT rec_id, NOT h AS added, CASE WHEN h THEN length(prompt) ELSE length(rtrim(prompt, ' ')) + 33 END AS n FROM (SELECT *, regexp_matches(prompt, '\bComponent\b') AND regexp_matches(prompt, '\bport 0\b') AS h FROM source_examples)",
    "text_filter": "SELECT doc_id, doc_kind FROM documents WHERE contains(lower(text), 'null') AND lower(doc_kind) IN ('spec', 'review')",
}
