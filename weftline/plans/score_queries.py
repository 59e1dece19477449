"""Joins of candidates with results and verdicts, pair construction, scores and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.operators import pairs
from weftline.operators.identity import keep_first, remaining
from weftline.plans.tables import on

_LEVELS = ["L1_fail", "L2_fail", "L3_mismatch", "L3_pass"]


def _runs(e: DataFrame) -> DataFrame:
    """One row for each run, the last received."""
    return keep_first(e, ["exec_id"], [F.col("received_at").desc()])


@on("source_examples", "suite_tests")
def anti_exclusion(s: DataFrame, t: DataFrame) -> DataFrame:
    words = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9_]+", " "))
    return s.select("rec_id", words(F.col("prompt")).alias("k")).join(t.select(words(F.col("prompt")).alias("k")), "k", "left_anti").select("rec_id")


@on("setup_bundles", "exec_results")
def semi_executed(b: DataFrame, e: DataFrame) -> DataFrame:
    return b.select("example_id").join(e.where("exec_level = 'L3_pass'"), "example_id", "left_semi")


@on("setup_bundles", "exec_results")
def resume_todo(b: DataFrame, e: DataFrame) -> DataFrame:
    """Examples with fewer than two finished runs."""
    return remaining(b.select("example_id"), _runs(e).where("run_status = 'FINISHED_OK'"), ["example_id"], 2)


@on("source_examples", "setup_bundles", "exec_results")
def three_way(s: DataFrame, b: DataFrame, e: DataFrame) -> DataFrame:
    """Example, bundle and runs; examples whose bundle is missing are incomplete."""
    ids = s.select(F.lower("id").alias("example_id")).where("example_id is not null").distinct()
    n = _runs(e).groupBy("example_id").agg(F.count(F.lit(1)).alias("runs"), F.max("candidate_index").alias("last_candidate"))
    joined = ids.join(n, "example_id").join(b.select("example_id", "sandbox"), "example_id", "left")
    return joined.select("example_id", "runs", "last_candidate", F.col("sandbox").isNull().alias("incomplete"))


@on("forged", "source_examples")
def fallback_link(f: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs linked to a record by equal prompt, else by file and index; the smallest rec_id of a level counts."""
    by_prompt = s.groupBy("prompt").agg(F.min("rec_id").alias("r1"))
    by_place = s.where("source_file is not null").groupBy("source_file", "source_index").agg(F.min("rec_id").alias("r2"))
    joined = f.select("pair_id", "prompt", "source_file", "source_index").join(by_prompt, "prompt", "left").join(by_place, ["source_file", "source_index"], "left")
    return joined.select("pair_id", F.coalesce("r1", "r2").alias("rec_id"), F.when(F.col("r1").isNotNull(), "prompt").when(F.col("r2").isNotNull(), "place").alias("how"))


@on("exec_results")
def level_pivot(e: DataFrame) -> DataFrame:
    """Runs by candidate and level with the share that passed."""
    p = _runs(e).groupBy("candidate_index").pivot("exec_level", _LEVELS).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(x) for x in _LEVELS), F.lit(0))
    return p.select("candidate_index", *_LEVELS, F.round(F.col("L3_pass") / total, 6).alias("pass_rate"))


@on("forged_provenance")
def labelled(p: DataFrame) -> DataFrame:
    """Truth table of level, verdict and confidence."""
    told = pairs.label(F.col("provenance.exec_level"), F.col("provenance.verdict.verdict"), F.col("provenance.verdict.confidence"))
    return p.select("pair_id", "logged_at", F.coalesce(told.rejected, F.lit(False)).alias("rejected"), F.coalesce(told.correct, F.lit(False)).alias("correct"))


@on("exec_results")
def informative_pick(e: DataFrame) -> DataFrame:
    """For each example the most telling failure: mismatch before stop before compile error, then the later candidate."""
    rank = F.array_position(F.array(*map(F.lit, _LEVELS[:3])), F.col("exec_level"))
    w = _runs(e).where(F.col("exec_level") != "L3_pass").withColumn("r", rank)
    return w.groupBy("example_id").agg(F.max_by("exec_id", F.struct("r", "candidate_index", "exec_id")).alias("exec_id"))


@on("forged_provenance")
def composition_caps(p: DataFrame) -> DataFrame:
    """Failure modes and levels over their share caps."""
    rows = keep_first(p, ["pair_id"], [F.col("logged_at").desc()])
    kinds = rows.select(F.explode(F.concat(F.transform(F.coalesce("rejected_failure_modes", F.array().cast("array<string>")), lambda m: F.struct(F.lit("mode").alias("kind"), m.alias("value"))), F.array(F.struct(F.lit("level").alias("kind"), F.col("rejected_exec_level").alias("value"))))).alias("x")).select("x.*")
    n = kinds.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    capped = n.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).withColumn("share", F.round(F.col("n") / F.col("total"), 6))
    return capped.where("share > case kind when 'mode' then 0.25 else 0.2 end and value is not null").select("kind", "value", "n", "share")


@on("forged_provenance")
def top_modes(p: DataFrame) -> DataFrame:
    return p.select(F.explode("rejected_failure_modes").alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "mode").limit(10)


@on("forged_provenance")
def temperature_levels(p: DataFrame) -> DataFrame:
    return p.groupBy(F.col("provenance.gen_meta.temperature").alias("temperature")).pivot("rejected_exec_level", _LEVELS).agg(F.count(F.lit(1))).na.fill(0, _LEVELS)


@on("exec_results")
def wilson_levels(e: DataFrame) -> DataFrame:
    n = _runs(e).groupBy("run_status").agg(F.count_if(F.col("exec_level") == "L3_pass").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return n.select("run_status", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@on("exec_results")
def candidate_difference(e: DataFrame) -> DataFrame:
    """First against second candidates: Newcombe and normal intervals of the difference of pass rates."""
    c, ok = F.col("candidate_index"), F.col("exec_level") == "L3_pass"
    n = _runs(e).agg(F.count_if(ok & (c == 0)).alias("k1"), F.count_if(c == 0).alias("n1"), F.count_if(ok & (c == 1)).alias("k2"), F.count_if(c == 1).alias("n2"))
    args = [F.col(x) for x in ("k1", "n1", "k2", "n2")]
    d, low, high = stats.newcombe(*args)
    _, nlow, nhigh = stats.normal_difference(*args)
    return n.select(*[F.round(x, 6).alias(a) for x, a in ((d, "difference"), (low, "low"), (high, "high"), (nlow, "normal_low"), (nhigh, "normal_high"))])


@on("exec_results")
def paired_difference(e: DataFrame) -> DataFrame:
    """Mean difference over examples that both candidates ran, with the interval from the paired differences."""
    rate = _runs(e).where("candidate_index in (0, 1)").groupBy("example_id").pivot("candidate_index", [0, 1]).agg(F.avg((F.col("exec_level") == "L3_pass").cast("double")))
    d = rate.where("`0` is not null and `1` is not null").select((F.col("1") - F.col("0")).alias("d")).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    se = F.coalesce(F.col("sd"), F.lit(0.0)) / F.sqrt("n")
    return d.select(F.round("m", 6).alias("mean"), F.round(F.col("m") - 1.96 * se, 6).alias("low"), F.round(F.col("m") + 1.96 * se, 6).alias("high"), "n")


@on("exec_results")
def pass_histogram(e: DataFrame) -> DataFrame:
    per = _runs(e).groupBy("example_id").agg(F.count_if(F.col("exec_level") == "L3_pass").alias("passes"), F.count(F.lit(1)).alias("k"))
    label = F.when(F.col("passes") == 0, "none").when(F.col("passes") == F.col("k"), "all").otherwise("some")
    return per.groupBy("passes", label.alias("label")).agg(F.count(F.lit(1)).alias("examples"))


@on("exec_results")
def worst_status(e: DataFrame) -> DataFrame:
    return _runs(e).groupBy("example_id").agg(F.min_by("exec_level", F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("exec_level"))).alias("worst"))


@on("exec_results")
def transitions(e: DataFrame) -> DataFrame:
    """First to final level of each example, and whether it had passed by its second run."""
    r = _runs(e).groupBy("example_id").agg(F.min_by("exec_level", F.struct("candidate_index", "exec_id")).alias("first"), F.max_by("exec_level", F.struct("candidate_index", "exec_id")).alias("final"), F.max(((F.col("exec_level") == "L3_pass") & (F.col("candidate_index") <= 1)).cast("int")).alias("by_two"))
    return r.groupBy("first", "final", "by_two").agg(F.count(F.lit(1)).alias("n"))


@on("documents")
def length_percentiles(d: DataFrame) -> DataFrame:
    """Exact low, middle and high ranks of text lengths by kind."""
    parts = [stats.histogram_quantile(d, ["doc_kind"], "n_chars", index, name) for index, name in ((stats.low_decile, "p10"), (stats.upper_median, "median"), (stats.high_decile, "p90"))]
    return parts[0].join(parts[1], "doc_kind").join(parts[2], "doc_kind")


@on("lineitem")
def weighted_means(i: DataFrame) -> DataFrame:
    q, p = F.col("l_quantity").cast("decimal(18,4)"), F.col("l_extendedprice").cast("decimal(18,4)")
    return i.groupBy("l_returnflag").agg(F.round((F.sum(q * p) / F.sum(q)).cast("double"), 2).alias("weighted_price"), F.round(F.sum(p).cast("double"), 2).alias("total"))


@on("orders")
def nested_segments(o: DataFrame) -> DataFrame:
    """Overlapping segments: every order is in all, some also in large and in urgent."""
    inside = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")))
    return o.select(F.explode(inside).alias("segment"), "o_custkey").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


@on("orders")
def status_cube(o: DataFrame) -> DataFrame:
    g = F.grouping_id().cast("bigint")
    return o.cube("o_orderstatus", "o_orderpriority").agg(g.alias("level"), F.count(F.lit(1)).alias("n"))


@on("orders")
def status_rollup(o: DataFrame) -> DataFrame:
    return o.rollup("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


@on("events")
def round_averages(e: DataFrame) -> DataFrame:
    """Averages of the first ten and last ten events of each user."""
    w = Window.partitionBy("user_id")
    r = e.withColumn("i", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    v = F.col("value").cast("decimal(18,6)")
    return r.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("i") <= 10, v)).cast("double"), 4).alias("first_ten"), F.round(F.avg(F.when(F.col("i") > F.col("n") - 10, v)).cast("double"), 4).alias("last_ten"))


@on("events")
def series_summary(e: DataFrame) -> DataFrame:
    return e.groupBy("event_type").agg(F.min("value").alias("least"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))


@on("exec_results")
def agreement(e: DataFrame) -> DataFrame:
    """How often status and level agree on success, with the confusion counts."""
    a, b = F.col("run_status") == "FINISHED_OK", F.col("exec_level").isin("L3_pass", "L3_mismatch")
    return _runs(e).agg(F.round(F.avg((a == b).cast("double")), 6).alias("agreement"), F.count_if(a & ~b).alias("only_status"), F.count_if(b & ~a).alias("only_level"))


@on("lineitem")
def shard_throughput(i: DataFrame) -> DataFrame:
    """Ratio of sums over shards, not mean of ratios."""
    part = i.groupBy(F.pmod("l_orderkey", F.lit(8)).alias("shard")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("units"), F.count(F.lit(1)).alias("rows"))
    return part.agg(F.round((F.sum("units") / F.sum("rows")).cast("double"), 6).alias("units_per_row"), F.count(F.lit(1)).alias("shards"))


@on("exec_results", "setup_bundles")
def recall_by_kind(e: DataFrame, b: DataFrame) -> DataFrame:
    rows = _runs(e).join(b.select("example_id", F.upper(F.trim("component_type")).alias("component")), "example_id")
    bad, flagged = F.col("exec_level") != "L3_pass", F.coalesce(F.length("output_diff") > 0, F.lit(False))
    return rows.groupBy("component").agg(F.count_if(bad).alias("bad"), F.count_if(bad & flagged).alias("caught"), F.count_if(~bad & flagged).alias("false_alarms"))


@on("forged_provenance")
def scores_with_penalties(p: DataFrame) -> DataFrame:
    """1 less a fifth for each distinct mode, by verdict where there is none, clamped to 0..1."""
    n = F.size(F.array_distinct(F.coalesce("rejected_failure_modes", F.array().cast("array<string>"))))
    base = F.when(n > 0, 1 - 0.2 * n).otherwise(F.when(F.col("provenance.verdict.verdict") == "correct", 1.0).when(F.col("provenance.verdict.verdict") == "partially_correct", 0.5).otherwise(0.0))
    return p.select("pair_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 4).alias("score")).distinct()


@on("forged_provenance")
def all_of_set(p: DataFrame) -> DataFrame:
    """Relational division: pairs that have every mode of a set."""
    return p.where(F.size(F.array_except(F.array(F.lit("null_handling"), F.lit("wrong_port")), F.coalesce("rejected_failure_modes", F.array().cast("array<string>")))) == 0).select("pair_id").distinct()


@on("exec_results", "setup_bundles")
def staged_filter(e: DataFrame, b: DataFrame) -> DataFrame:
    """The first failing stage of each run, cheapest first."""
    known = b.select("example_id", F.lit(True).alias("known"), F.col("golden_records").isNotNull().alias("golden"))
    r = _runs(e).join(known, "example_id", "left")
    stage = F.when(F.col("run_status") == "TIMEOUT", "cap").when(F.col("known").isNull(), "bundle").when(F.col("exec_level").isin("L1_fail", "L2_fail"), "compile").when(~F.col("golden"), "golden").when(F.col("exec_level") == "L3_mismatch", "compare")
    return r.select("exec_id", stage.isNull().alias("accepted"), stage.alias("rejected_at"))


@on("exec_results")
def task_mean_error(e: DataFrame) -> DataFrame:
    """Mean of the examples' pass rates with its standard error."""
    per = _runs(e).groupBy("example_id").agg(F.avg((F.col("exec_level") == "L3_pass").cast("double")).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r") / F.sqrt(F.count("r")), 6).alias("error"), F.count(F.lit(1)).alias("tasks"))


@on("forged", "source_examples")
def best_versions(f: DataFrame, s: DataFrame) -> DataFrame:
    """The first pool's answer if it is at least 0.7 as long as the second's, else the second's; either where one is missing."""
    a = s.where("reference is not null").groupBy("prompt").agg(F.min("reference").alias("v1"))
    b = f.where("chosen is not null").groupBy("prompt").agg(F.min("chosen").alias("v2"))
    j = a.join(b, "prompt", "full")
    pick = F.when(F.col("v2").isNull(), "first").when(F.col("v1").isNull(), "second").when(F.length("v1") >= 0.7 * F.length("v2"), "first").otherwise("second")
    return j.groupBy(pick.alias("pick")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.when(pick == "first", F.col("v1")).otherwise(F.col("v2")))).alias("chars"))


@on("exec_results")
def complete_groups(e: DataFrame) -> DataFrame:
    """Examples whose candidates are 0..k-1 without a gap and all finished."""
    g = _runs(e).groupBy("example_id").agg(F.countDistinct("candidate_index").alias("k"), F.min("candidate_index").alias("low"), F.max("candidate_index").alias("high"), F.every(F.col("run_status") == "FINISHED_OK").alias("ok"))
    return g.where("ok and low = 0 and high = k - 1").select("example_id", "k")


@on("source_examples", "exec_results")
def replay_share(s: DataFrame, e: DataFrame) -> DataFrame:
    """Rows of a replay set that make a fifth of the mix, by source of the training rows' share."""
    n = s.groupBy(F.coalesce(F.try_element_at("meta", F.lit("failure_mode")), F.lit("none")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    total = _runs(e).agg(F.ceil(F.count(F.lit(1)) * 0.2 / 0.8).alias("replay"))
    whole = n.agg(F.sum("n").alias("all"))
    return n.join(F.broadcast(total)).join(F.broadcast(whole)).select("mode", F.floor(F.col("replay") * F.col("n") / F.col("all") + 0.5).alias("quota"))


QUERIES = {
    f.__name__: f
    for f in (
        anti_exclusion, semi_executed, resume_todo, three_way, fallback_link, level_pivot, labelled, informative_pick, composition_caps, top_modes, temperature_levels, wilson_levels,
        candidate_difference, paired_difference, pass_histogram, worst_status, transitions, length_percentiles, weighted_means, nested_segments, status_cube, status_rollup, round_averages,
        series_summary, agreement, shard_throughput, recall_by_kind, scores_with_penalties, all_of_set, staged_filter, task_mean_error, best_versions, complete_groups, replay_share,
    )
}

_R = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY received_at DESC) AS rn FROM exec_results) WHERE rn = 1)"
_RANK = "list_position(['L1_fail', 'L2_fail', 'L3_mismatch', 'L3_pass'], exec_level)"


def _wilson(k: str, n: str, sign: str) -> str:
    return f"(({k} / {n} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n}))"


_SQL_WORDS = "lower(regexp_replace(prompt, '[^A-Za-z0-9_]+', ' ', 'g'))"
_MODES = "coalesce(rejected_failure_modes, [])"

ORACLES = {
    "best_versions": "WITH a AS (SELECT prompt, min(reference) AS v1 FROM source_examples WHERE reference IS NOT NULL GROUP BY 1), b AS (SELECT prompt, min(chosen) AS v2 FROM forged WHERE chosen IS NOT NULL GROUP BY 1), j AS (SELECT *, CASE WHEN v2 IS NULL THEN 'first' WHEN v1 IS NULL THEN 'second' WHEN length(v1) >= 0.7 * length(v2) THEN 'first' ELSE 'second' END AS pick FROM a FULL JOIN b USING (prompt)) SELECT pick, count(*) AS n, CAST(sum(length(CASE WHEN pick = 'first' THEN v1 ELSE v2 END)) AS BIGINT) AS chars FROM j GROUP BY 1",
    "complete_groups": f"WITH {_R} SELECT example_id, count(DISTINCT candidate_index) AS k FROM r GROUP BY 1 HAVING bool_and(run_status = 'FINISHED_OK') AND min(candidate_index) = 0 AND max(candidate_index) = count(DISTINCT candidate_index) - 1",
    "replay_share": f"WITH {_R}, n AS (SELECT coalesce(meta['failure_mode'], 'none') AS mode, count(*) AS n FROM source_examples GROUP BY 1) SELECT mode, CAST(floor((SELECT ceil(count(*) * 0.2 / 0.8) FROM r) * n / (SELECT count(*) FROM source_examples) + 0.5) AS BIGINT) AS quota FROM n",
    "anti_exclusion": f"SELECT rec_id FROM source_examples WHERE {_SQL_WORDS} NOT IN (SELECT {_SQL_WORDS} FROM suite_tests)",
    "semi_executed": "SELECT example_id FROM setup_bundles WHERE example_id IN (SELECT example_id FROM exec_results WHERE exec_level = 'L3_pass')",
    "resume_todo": f"WITH {_R} SELECT example_id FROM setup_bundles WHERE example_id NOT IN (SELECT example_id FROM r WHERE run_status = 'FINISHED_OK' GROUP BY 1 HAVING count(*) >= 2)",
    "three_way": f"WITH {_R}, n AS (SELECT example_id, count(*) AS runs, max(candidate_index) AS last_candidate FROM r GROUP BY 1) SELECT n.example_id, runs, last_candidate, sandbox IS NULL AS incomplete FROM (SELECT DISTINCT lower(id) AS example_id FROM source_examples WHERE id IS NOT NULL) s JOIN n USING (example_id) LEFT JOIN setup_bundles USING (example_id)",
    "fallback_link": "WITH a AS (SELECT prompt, min(rec_id) AS r1 FROM source_examples GROUP BY 1), b AS (SELECT source_file, source_index, min(rec_id) AS r2 FROM source_examples WHERE source_file IS NOT NULL GROUP BY 1, 2) SELECT pair_id, coalesce(r1, r2) AS rec_id, CASE WHEN r1 IS NOT NULL THEN 'prompt' WHEN r2 IS NOT NULL THEN 'place' END AS how FROM forged LEFT JOIN a USING (prompt) LEFT JOIN b USING (source_file, source_index)",
    "level_pivot": f"WITH {_R} SELECT candidate_index, count(*) FILTER (exec_level = 'L1_fail') AS L1_fail, count(*) FILTER (exec_level = 'L2_fail') AS L2_fail, count(*) FILTER (exec_level = 'L3_mismatch') AS L3_mismatch, count(*) FILTER (exec_level = 'L3_pass') AS L3_pass, round(count(*) FILTER (exec_level = 'L3_pass') / count(*), 6) AS pass_rate FROM r GROUP BY 1",
    "labelled": """WITH x AS (SELECT pair_id, logged_at, provenance.exec_level AS l, provenance.verdict.verdict AS v, coalesce(provenance.verdict.confidence >= 0.6, false) AS s FROM forged_provenance)
        SELECT pair_id, logged_at, coalesce(CASE WHEN l IN ('L1_fail', 'L2_fail') THEN true WHEN l = 'L3_mismatch' THEN NOT (s AND v IN ('correct', 'partially_correct')) ELSE s AND v = 'incorrect' END, false) AS rejected,
               coalesce(CASE WHEN l IN ('L1_fail', 'L2_fail') THEN false WHEN l = 'L3_mismatch' THEN s AND v = 'correct' ELSE NOT (s AND v = 'incorrect') END, false) AS correct FROM x""",
    "informative_pick": f"WITH {_R} SELECT example_id, exec_id FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {_RANK} DESC, candidate_index DESC, exec_id DESC) AS k FROM r WHERE exec_level <> 'L3_pass') WHERE k = 1",
    "composition_caps": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY logged_at DESC) AS rn FROM forged_provenance) WHERE rn = 1),
        k AS (SELECT 'mode' AS kind, unnest(rejected_failure_modes) AS value FROM p UNION ALL SELECT 'level', rejected_exec_level FROM p),
        n AS (SELECT kind, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM k WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM n WHERE share > CASE kind WHEN 'mode' THEN 0.25 ELSE 0.2 END""",
    "top_modes": "SELECT mode, count(*) AS n FROM (SELECT unnest(rejected_failure_modes) AS mode FROM forged_provenance) GROUP BY 1 ORDER BY n DESC, mode LIMIT 10",
    "temperature_levels": "SELECT provenance.gen_meta.temperature AS temperature, count(*) FILTER (rejected_exec_level = 'L1_fail') AS L1_fail, count(*) FILTER (rejected_exec_level = 'L2_fail') AS L2_fail, count(*) FILTER (rejected_exec_level = 'L3_mismatch') AS L3_mismatch, count(*) FILTER (rejected_exec_level = 'L3_pass') AS L3_pass FROM forged_provenance GROUP BY 1",
    "wilson_levels": f"WITH {_R}, n AS (SELECT run_status, count(*) FILTER (exec_level = 'L3_pass') AS k, count(*) AS n FROM r GROUP BY 1) SELECT run_status, k, n, round({_wilson('k', 'n', '-')}, 6) AS low, round({_wilson('k', 'n', '+')}, 6) AS high FROM n",
    "candidate_difference": f"""WITH {_R}, n AS (SELECT count(*) FILTER (exec_level = 'L3_pass' AND candidate_index = 0) AS k1, count(*) FILTER (candidate_index = 0) AS n1, count(*) FILTER (exec_level = 'L3_pass' AND candidate_index = 1) AS k2, count(*) FILTER (candidate_index = 1) AS n2 FROM r),
        w AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, {_wilson('k1', 'n1', '-')} AS l1, {_wilson('k1', 'n1', '+')} AS u1, {_wilson('k2', 'n2', '-')} AS l2, {_wilson('k2', 'n2', '+')} AS u2 FROM n)
        SELECT round(p2 - p1, 6) AS difference, round(p2 - p1 - sqrt((p2 - l2) ** 2 + (u1 - p1) ** 2), 6) AS low, round(p2 - p1 + sqrt((u2 - p2) ** 2 + (p1 - l1) ** 2), 6) AS high,
               round(p2 - p1 - 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 6) AS normal_low, round(p2 - p1 + 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 6) AS normal_high FROM w""",
    "paired_difference": f"""WITH {_R}, d AS (SELECT avg(CASE WHEN candidate_index = 1 THEN (exec_level = 'L3_pass')::INT END) - avg(CASE WHEN candidate_index = 0 THEN (exec_level = 'L3_pass')::INT END) AS d FROM r GROUP BY example_id),
        m AS (SELECT avg(d) AS m, coalesce(stddev_samp(d), 0) / sqrt(count(d)) AS se, count(d) AS n FROM d) SELECT round(m, 6) AS mean, round(m - 1.96 * se, 6) AS low, round(m + 1.96 * se, 6) AS high, n FROM m""",
    "pass_histogram": f"WITH {_R}, p AS (SELECT count(*) FILTER (exec_level = 'L3_pass') AS passes, count(*) AS k FROM r GROUP BY example_id) SELECT passes, CASE WHEN passes = 0 THEN 'none' WHEN passes = k THEN 'all' ELSE 'some' END AS label, count(*) AS examples FROM p GROUP BY 1, 2",
    "worst_status": f"WITH {_R} SELECT example_id, arg_min(exec_level, {_RANK}) AS worst FROM r GROUP BY 1",
    "transitions": f"WITH {_R}, t AS (SELECT arg_min(exec_level, candidate_index::BIGINT * 1000000000 + exec_id) AS first, arg_max(exec_level, candidate_index::BIGINT * 1000000000 + exec_id) AS final, max((exec_level = 'L3_pass' AND candidate_index <= 1)::INT) AS by_two FROM r GROUP BY example_id) SELECT first, final, by_two, count(*) AS n FROM t GROUP BY ALL",
    "length_percentiles": "WITH s AS (SELECT doc_kind, list_sort(list(n_chars)) AS v FROM documents GROUP BY 1) SELECT doc_kind, v[CAST(floor(0.1 * (len(v) - 1)) AS INT) + 1] AS p10, v[len(v) // 2 + 1] AS median, v[CAST(ceil(0.9 * (len(v) - 1)) AS INT) + 1] AS p90 FROM s",
    "weighted_means": "SELECT l_returnflag, round(sum(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE / sum(CAST(l_quantity AS DECIMAL(18,4)))::DOUBLE, 2) AS weighted_price, round(sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE, 2) AS total FROM lineitem GROUP BY 1",
    "nested_segments": "SELECT segment, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM (SELECT 'all' AS segment, o_custkey FROM orders UNION ALL SELECT 'large', o_custkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'urgent', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    "status_cube": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "status_rollup": "SELECT o_orderstatus, CAST(y AS INT) AS y, grouping(o_orderstatus, y) AS level, count(*) AS n FROM (SELECT o_orderstatus, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (o_orderstatus, y)",
    "round_averages": "WITH r AS (SELECT user_id, CAST(value AS DECIMAL(18,6))::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(avg(CASE WHEN i <= 10 THEN v END), 4) AS first_ten, round(avg(CASE WHEN i > n - 10 THEN v END), 4) AS last_ten FROM r GROUP BY 1",
    "series_summary": "SELECT event_type, min(value) AS least, (SELECT value FROM events x WHERE x.event_type = e.event_type ORDER BY ts DESC, event_id DESC LIMIT 1) AS last, count(*) AS n FROM events e GROUP BY 1",
    "agreement": f"WITH {_R}, x AS (SELECT run_status = 'FINISHED_OK' AS a, exec_level IN ('L3_pass', 'L3_mismatch') AS b FROM r) SELECT round(avg((a = b)::INT), 6) AS agreement, count(*) FILTER (a AND NOT b) AS only_status, count(*) FILTER (b AND NOT a) AS only_level FROM x",
    "shard_throughput": "SELECT round(sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE / count(*), 6) AS units_per_row, count(DISTINCT l_orderkey % 8) AS shards FROM lineitem",
    "recall_by_kind": f"WITH {_R}, x AS (SELECT upper(trim(component_type)) AS component, exec_level <> 'L3_pass' AS bad, coalesce(length(output_diff) > 0, false) AS f FROM r JOIN setup_bundles USING (example_id)) SELECT component, count(*) FILTER (bad) AS bad, count(*) FILTER (bad AND f) AS caught, count(*) FILTER (NOT bad AND f) AS false_alarms FROM x GROUP BY 1",
    "scores_with_penalties": f"SELECT DISTINCT pair_id, round(greatest(0.0, least(1.0, CASE WHEN len(list_distinct({_MODES})) > 0 THEN 1 - 0.2 * len(list_distinct({_MODES})) ELSE CASE provenance.verdict.verdict WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END END))::DOUBLE, 4) AS score FROM forged_provenance",
    "all_of_set": f"SELECT DISTINCT pair_id FROM forged_provenance WHERE list_contains({_MODES}, 'null_handling') AND list_contains({_MODES}, 'wrong_port')",
    "staged_filter": f"WITH {_R}, x AS (SELECT exec_id, CASE WHEN run_status = 'TIMEOUT' THEN 'cap' WHEN b.example_id IS NULL THEN 'bundle' WHEN exec_level IN ('L1_fail', 'L2_fail') THEN 'compile' WHEN golden_records IS NULL THEN 'golden' WHEN exec_level = 'L3_mismatch' THEN 'compare' END AS rejected_at FROM r LEFT JOIN setup_bundles b USING (example_id)) SELECT exec_id, rejected_at IS NULL AS accepted, rejected_at FROM x",
    "task_mean_error": f"WITH {_R}, p AS (SELECT avg((exec_level = 'L3_pass')::INT) AS x FROM r GROUP BY example_id) SELECT round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS error, count(*) AS tasks FROM p",
}
