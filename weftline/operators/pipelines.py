"""Whole pipelines over tables of prompts, samples and scores, composed of the other operators.

Samples have prompt_id, sample, mode, status, text and further columns as each pipeline says. Null keys and null statuses count as
absent or failed as stated; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import folded
from weftline.operators import pairs, selection
from weftline.operators.identity import keep_first, upsert
from weftline.operators.scale import global_row_number, sized_join
from weftline.operators.similarity import gate, nearest
from weftline.session import cut


def repair_candidates(rows: DataFrame, key: str, level: str, text: str, wanted: Sequence[str], least: int = 20) -> DataFrame:
    """(key, level, text, place, variants): failed answers worth repairing, in the order of ``wanted`` levels and keys.

    Texts shorter than ``least`` and repeats of a key's text, but for space and case, are left out; variants is the number of
    different texts of the key.
    """
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col(level))
    good = rows.where((rank > 0) & (F.length(F.trim(text)) >= least)).withColumn("_form", folded(F.col(text)))
    once = keep_first(good, [key, "_form"], [rank, text])
    counted = once.groupBy(key).agg(F.count(F.lit(1)).alias("variants"))
    placed = global_row_number(once.select(key, level, text, rank.alias("_rank")), [F.col("_rank"), F.col(key), F.col(text)], "place")
    return placed.join(counted, key).select(key, level, text, "place", "variants")


def prompt_sets(sets: Sequence[tuple[str, DataFrame, int]], held_out: DataFrame, pool: DataFrame, replay_share: float, mix: dict[str, float], seed: str, key: str = "prompt_id", task: str = "task") -> DataFrame:
    """(prompt_id, task, set, weight): training prompts of several sets and a replay of the pool, each prompt once.

    ``sets`` gives name, rows and weight in order; a prompt in two of them stays with the first. Held-out prompts are left out of all.
    The replay is replay_share of the result, drawn from pool prompts in no set by the shares of ``mix``, as far as they go.
    """
    named = None
    for place, (name, rows, weight) in enumerate(sets):
        one = rows.select(key, task, F.lit(name).alias("set"), F.lit(weight).alias("weight"), F.lit(place).alias("_place"))
        named = one if named is None else named.unionByName(one)
    kept = keep_first(named.join(held_out.select(key), key, "left_anti"), [key], ["_place", task]).drop("_place")
    free = pool.select(key, task).join(held_out.select(key), key, "left_anti").join(kept.select(key), key, "left_anti").distinct()
    wanted = -(-kept.count() * replay_share // (1 - replay_share))
    plan = pool.sparkSession.createDataFrame([(t, int(wanted * s + 0.5)) for t, s in mix.items()], f"{task} string, quota int")
    drawn = selection.quota(keep_first(free, [key], [task]), plan, task, key, seed).select(key, task, F.lit("replay").alias("set"), F.lit(1).alias("weight"))
    return kept.unionByName(drawn)


def execution_rows(samples: DataFrame, seed: str, per_prompt: int = 2, least_pairs: int = 0, prefer: Sequence[str] = (), passed: str = "pass") -> DataFrame:
    """(prompt_id, kind, sample, rejected, status): rows to train on from scored samples, for prompts that pass sometimes only.

    kind is sft for up to ``per_prompt`` passing samples in hash order, and dpo where the i-th of these meets the i-th failing one by
    the order of ``prefer``, other statuses last; without least_pairs pairs in all there are none. Null statuses count as failed.
    """
    ok = F.coalesce(F.col("status") == passed, F.lit(False))
    state = samples.groupBy("prompt_id").agg(F.count_if(ok).alias("_k"), F.count(F.lit(1)).alias("_n")).where("_k > 0 and _k < _n").select("prompt_id")
    mixed = samples.join(state, "prompt_id")
    chosen = selection.ranked(mixed.where(ok), ["prompt_id"], "sample", seed, most=per_prompt)
    rank = F.array_position(F.array(*map(F.lit, prefer)).cast("array<string>"), F.coalesce("status", F.lit("")))
    order = [F.when(rank > 0, rank).otherwise(len(prefer) + 1), F.col("sample")]
    worst = selection.top_per_group(mixed.where(~ok), ["prompt_id"], order, per_prompt, "rn").select("prompt_id", "rn", F.col("sample").alias("rejected"), F.col("status").alias("_why"))
    sft = chosen.select("prompt_id", F.lit("sft").alias("kind"), "sample", F.lit(None).cast(dict(samples.dtypes)["sample"]).alias("rejected"), F.lit(passed).alias("status"))
    dpo = chosen.join(worst, ["prompt_id", "rn"]).select("prompt_id", F.lit("dpo").alias("kind"), "sample", "rejected", F.col("_why").alias("status"))
    number = dpo.agg(F.count(F.lit(1)).alias("_pairs"))
    return sft.unionByName(dpo.join(F.broadcast(number), F.col("_pairs") >= least_pairs).drop("_pairs"))


def false_alarm_pairs(samples: DataFrame, clean: Column, alarm: Column, seed: str) -> DataFrame:
    """(prompt_id, chosen, rejected): on clean records each answer that raises an alarm against one that does not, these taken in turn."""
    rows = samples.where(F.coalesce(clean, F.lit(False))).withColumn("_alarm", F.coalesce(alarm, F.lit(False)))
    bad, good = rows.where("_alarm").select("prompt_id", F.col("sample").alias("rejected")), rows.where("not _alarm").select("prompt_id", F.col("sample").alias("chosen"))
    return selection.cycle_pairs(bad, good, ["prompt_id"], "rejected", "chosen", seed).select("prompt_id", "chosen", "rejected")


def retry_rows(attempts: DataFrame, redacted: str, least: int = 20, passed: str = "pass") -> DataFrame:
    """(task_id, first, final, text, outcome): tasks that failed at first and passed at last, the corrected text without feedback.

    ``attempts`` has task_id, round, status, text. Sentences that match ``redacted`` are taken out of the last text; outcome is kept,
    or why the row is dropped: lost_code if a code fence went with them, shrunk if less than ``least`` characters or a third is left.
    """
    from weftline.functions.text import redact

    order = F.struct("round", F.coalesce("text", F.lit("")))
    ends = attempts.groupBy("task_id").agg(F.min_by(F.struct("status", "text"), order).alias("a"), F.max_by(F.struct("status", "text"), order).alias("z"))
    fixed = ends.where((F.col("z.status") == passed) & ~F.col("a.status").eqNullSafe(F.lit(passed)))
    rows = fixed.select("task_id", F.col("a.status").alias("first"), F.col("z.status").alias("final"), F.coalesce("z.text", F.lit("")).alias("_whole"))
    cut = rows.withColumn("text", redact(F.col("_whole"), redacted).kept)
    why = F.when(F.col("_whole").contains("```") & ~F.col("text").contains("```"), "lost_code").when((F.length("text") < least) | (F.length("text") * 3 < F.length("_whole")), "shrunk").otherwise("kept")
    return cut.select("task_id", "first", "final", "text", why.alias("outcome"))


def rebuilt_set(sources: Sequence[DataFrame], excluded: DataFrame, longest: int, key: str, length: str, weight: str) -> DataFrame:
    """All columns of the sources with ``copy``: their union without excluded keys and rows over ``longest``, each as often as its weight says."""
    whole = sources[0]
    for more in sources[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    kept = whole.join(excluded.select(key).distinct(), key, "left_anti").where(F.col(length) <= longest)
    return selection.weighted(kept, weight)


def context_set(rows: DataFrame, group: str, key: str, size: int, modes: Sequence[str], forms: Sequence[str], weights: dict[str, int], seed: str) -> DataFrame:
    """(key, group, mode, form, weight): a proportional draw of rows, each once for every mode and form, weighted by group."""
    drawn = selection.proportional(rows, group, key, size, seed).select(key, group)
    weight = F.coalesce(*[F.when(F.col(group) == g, F.lit(w)) for g, w in weights.items()], F.lit(1))
    each = drawn.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumn("form", F.explode(F.array(*map(F.lit, forms))))
    return each.withColumn("weight", weight)


def mutant_sample(rows: DataFrame, key: str, code: str, group: str, edits: list[tuple[str, str, str]], per_kind: int, seed: str) -> DataFrame:
    """(key, group, kind, mutant, place): mutants of codes, ``per_kind`` for each kind, rarer groups first among them."""
    made = pairs.mutants(rows.select(key, group, code), code, edits).select(key, group, "kind", "mutant").withColumn("_id", F.concat_ws("|", "kind", F.col(key).cast("string")))
    turned = selection.ranked(made, ["kind", group], "_id", seed, out="_turn")
    size = made.groupBy("kind", group).agg(F.count(F.lit(1)).alias("_size"))
    condition = (F.col("t.kind") == F.col("s.kind")) & F.col(f"t.{group}").eqNullSafe(F.col(f"s.{group}"))
    sized = turned.alias("t").join(size.alias("s"), condition).select("t.*", "s._size")
    return selection.top_per_group(sized, ["kind"], [F.col("_turn"), F.col("_size"), F.col(group), F.col(key)], per_kind, "place").drop("_turn", "_size", "_id")


def suite_scores(results: DataFrame, outside: Column) -> DataFrame:
    """(model, tests, mean, mean_inside, critical): a model's mean over its tests, the same without those that ``outside`` names, and failures."""
    score = F.col("score").cast("decimal(18,6)")
    inside = F.when(~F.coalesce(outside, F.lit(False)), score)
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("tests"), F.round(F.avg(score).cast("double"), 6).alias("mean"), F.round(F.avg(inside).cast("double"), 6).alias("mean_inside"), F.count("critical").alias("critical"))


def compared(results: DataFrame, models: Sequence[str], test: str = "test_id", absent: str = "—") -> DataFrame:
    """(test_id, one text column for each model): mean scores side by side, a mark where a model has no result."""
    score = F.when(F.count("score") > 0, F.format_string("%.3f", F.avg(F.col("score").cast("decimal(18,6)")).cast("double")))
    wide = results.groupBy(test).pivot("model", list(models)).agg(score)
    return wide.select(test, *[F.coalesce(m, F.lit(absent)).alias(m) for m in models])


def against_previous(scores: DataFrame, part: Sequence[str], order: Sequence[str], value: str, epsilon: float = 5e-4) -> DataFrame:
    """All columns with ``delta`` and ``sign`` (+, -, = within epsilon, null for the first): the score less the previous one of its part."""
    delta = F.col(value) - F.lag(value).over(Window.partitionBy(*part).orderBy(*order))
    return scores.withColumn("delta", delta).withColumn("sign", F.when(F.abs("delta") < epsilon, "=").when(F.col("delta") > 0, "+").when(F.col("delta") < 0, "-"))


def critical_failure(findings: DataFrame, any_of: Sequence[str], all_of: Sequence[str], traps: DataFrame, test: str = "test_id") -> DataFrame:
    """(test_id, failure): the first reason why a test fails outright: a missed item of ``any_of``, all of ``all_of``, a sprung trap, a wrong verdict.

    ``findings`` has test_id, item, status, verdict, expected; ``traps`` has test_id and item.
    """
    missed = F.coalesce(F.col("status") == "missed", F.lit(False))
    sprung = findings.join(traps.select(test, "item").distinct().withColumn("_trap", F.lit(True)), [test, "item"], "left")
    told = sprung.groupBy(test).agg(
        F.bool_or(missed & F.col("item").isin(*any_of)).alias("one"), (F.count_distinct(F.when(missed & F.col("item").isin(*all_of), F.col("item"))) == len(set(all_of))).alias("every"),
        F.bool_or(F.coalesce(F.col("_trap"), F.lit(False)) & (F.col("status") == "claimed")).alias("trap"), F.bool_or(~F.col("verdict").eqNullSafe(F.col("expected"))).alias("verdict"),
    )
    why = F.when(F.col("one"), "missed_item").when(F.col("every"), "missed_all").when(F.col("trap"), "trap").when(F.col("verdict"), "verdict")
    return told.select(test, why.alias("failure")).where("failure is not null")


def forge_stages(candidates: DataFrame, chosen: DataFrame, known: DataFrame, caps: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cache, pairs, audit) of a forge run: the candidates of this run merged with what is known, the pairs built from all of them, and
    the share of each level among the pairs with whether it is over its cap."""
    cache = upsert(known, candidates, ["example_id", "idx"], "run")
    built = pairs.build_pairs(cache.withColumn("_x", pairs.label(F.col("level"), F.lit(None).cast("string"), F.col("confidence"))).select("*", "_x.rejected", "_x.correct"), chosen)
    counted = built.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    whole = built.agg(F.count(F.lit(1)).alias("_all"))
    cap = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in caps.items()], F.lit(1.0))
    audit = counted.join(F.broadcast(whole)).select("level", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"), (F.col("n") > F.col("_all") * cap).alias("over"))
    return cache, built, audit


def distilled(samples: DataFrame, plan: DataFrame, longest: int, seed: str) -> DataFrame:
    """(prompt_id, group, sample, text): prompts within the quota of their group that have an accepted sample, one of these by hash order.

    ``samples`` has prompt_id, group, sample, accepted, text. Samples over ``longest`` characters are not accepted; a group takes
    prompts in hash order, those without an accepted sample do not use up its quota.
    """
    good = samples.where(F.coalesce("accepted", F.lit(False)) & (F.length("text") <= longest))
    return selection.quota(selection.one_per_group(good.select("prompt_id", "group", "sample", "text"), ["prompt_id"], "sample", seed), plan, "group", "prompt_id", seed)


def executable_pool(rows: DataFrame, protected: DataFrame, classes: DataFrame, held: DataFrame, key: str, text: str, ref_key: str, ref_text: str, limit: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(pool, report): rows away from protected texts by masked similarity, with their class and side, and the closeness of the held side to the rest."""
    near = nearest(rows, protected, key, ref_key, text, ref_text, limit, masked=True)
    keys = rows.select(key).join(near.select(key), key, "left_anti")
    pool = cut(keys.join(classes.select(key, "class_id"), key).join(held.select(key, "held"), key).select(key, "class_id", "held"))
    inside, texts = cut(pool.where("held").select(key)), rows.where(F.col(key).isNotNull()).select(key, text)
    # The other side is most of the rows; what it lacks is the smaller list, so texts are met by that.
    outside = cut(rows.select(key).join(pool.where("not held").select(key), key, "left_anti").distinct())
    rest = sized_join(texts, outside, [key], "left_anti").select(F.col(key).alias("_other"), F.col(text).alias("_other_text"))
    return pool, gate(sized_join(texts, inside, [key], "left_semi"), rest, key, "_other", text, "_other_text", 0.8)


def self_corrections(attempts: DataFrame, passed: str = "pass") -> DataFrame:
    """(task_id, outcome, rounds): first_pass, self_corrected by the same model, judge_fixed where only a judge's attempt passes, or failed.

    ``attempts`` has task_id, round, status and author (self or judge).
    """
    ok = F.coalesce(F.col("status") == passed, F.lit(False))
    own = F.col("author") == "self"
    told = attempts.groupBy("task_id").agg(F.min_by(ok & own, F.struct("round", "author")).alias("first"), F.bool_or(ok & own).alias("own"), F.bool_or(ok).alias("some"), F.count(F.lit(1)).alias("rounds"))
    return told.select("task_id", F.when(F.col("first"), "first_pass").when(F.col("own"), "self_corrected").when(F.col("some"), "judge_fixed").otherwise("failed").alias("outcome"), "rounds")


def worst_of_ports(ports: DataFrame, order: Sequence[str], case: str = "case") -> DataFrame:
    """(case, status, ports): the worst status of a case's ports, by ``order`` from worst to best; statuses not in it are the worst of all."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return ports.groupBy(case).agg(F.min_by("status", F.struct(rank, "status")).alias("status"), F.count(F.lit(1)).alias("ports"))


def doubled_modes(rows: DataFrame, done: DataFrame, key: str, modes: Sequence[str]) -> DataFrame:
    """(key, mode): first-seen rows that are not done, once for each mode."""
    todo = rows.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")
    return todo.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def matching_reuse(samples: DataFrame, pool: DataFrame, key: str, settings: Sequence[str], index: str, k: int) -> DataFrame:
    """(key): prompts whose stored samples may be used again: all settings equal the pool's, nulls being equal, and indices 0 to k-1 are there."""
    met = samples.alias("s").join(pool.alias("p"), F.col(f"s.{key}") == F.col(f"p.{key}"))
    same = F.lit(True)
    for c in settings:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}"))
    told = met.select(F.col(f"s.{key}").alias(key), same.alias("_same"), F.col(f"s.{index}").alias("_i")).groupBy(key)
    return told.agg(F.every("_same").alias("_all"), F.count_distinct(F.when(F.col("_i").between(0, k - 1), F.col("_i"))).alias("_k")).where(F.col("_all") & (F.col("_k") == k)).select(key)


def lost_prompts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key): keys of ``before`` that ``after`` lacks; an empty result is the invariant of a removal list."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def ordered_subset(small: DataFrame, large: DataFrame, key: str, order: str) -> DataFrame:
    """(subset, ordered): whether all keys of ``small`` are in ``large``, and come in the same order there; keys are unique."""
    a = global_row_number(small.select(key, F.col(order).alias("_o")), [F.col("_o"), F.col(key)], "_i").select(key, "_i")
    met = a.join(large.select(key, F.col(order).alias("_there")), key, "left")
    ranked = global_row_number(met, [F.col("_there"), F.col(key)], "_j")
    return ranked.agg(F.coalesce(F.every(F.col("_there").isNotNull()), F.lit(True)).alias("subset"), F.coalesce(F.every(F.col("_i") == F.col("_j")), F.lit(True)).alias("ordered"))
