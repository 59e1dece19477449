"""Preference pairs from labelled candidates, and answers that contrast within a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import folded
from weftline.operators.selection import zip_pairs

#: Levels from least to most telling. Fixed values.
LEVELS = ("L1_fail", "L2_fail", "L3_mismatch", "L3_pass")


def label(level: Column, verdict: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """struct(rejected, correct): execution decides unless a confident verdict overrides it."""
    sure = F.coalesce(confidence >= threshold, F.lit(False))
    says = lambda *v: sure & F.coalesce(verdict.isin(*v), F.lit(False))
    early = level.isin("L1_fail", "L2_fail")
    rejected = F.when(early, True).when(level == "L3_mismatch", ~says("correct", "partially_correct")).otherwise(says("incorrect"))
    correct = F.when(early, False).when(level == "L3_mismatch", says("correct")).otherwise(~says("incorrect"))
    return F.struct(rejected.alias("rejected"), correct.alias("correct"))


def build_pairs(candidates: DataFrame, chosen: DataFrame, strategy: str = "best_vs_worst", most: int = 3, least_length: int = 20) -> DataFrame:
    """(example_id, chosen, rejected, level): rejected candidates against the chosen text of their example.

    ``candidates`` has example_id, idx, text, level, confidence, rejected, correct; ``chosen`` has example_id and chosen. Examples with
    only correct candidates, short texts, repeats and texts equal to the chosen one but for space and case give no
    pair. best_vs_worst takes the most telling level, then confidence, then the first; all_pairs the first ``most``.
    """
    if strategy not in ("best_vs_worst", "all_pairs"):
        raise ValueError(strategy)
    bad = candidates.where("rejected").where(F.length(F.trim("text")) > least_length).withColumn("_key", folded(F.col("text")))
    first = Window.partitionBy("example_id", "_key").orderBy("idx")
    bad = bad.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").join(chosen, "example_id").where(F.col("_key") != folded(F.col("chosen")))
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    order = [rank.desc(), F.coalesce("confidence", F.lit(0.0)).desc(), "idx"] if strategy == "best_vs_worst" else ["idx"]
    n = 1 if strategy == "best_vs_worst" else most
    picked = bad.withColumn("_rn", F.row_number().over(Window.partitionBy("example_id").orderBy(*order))).where(F.col("_rn") <= n)
    return picked.select("example_id", "chosen", F.col("text").alias("rejected"), "level")


def contrasting(samples: DataFrame, passed: str = "passed", key: str = "prompt_id", sample: str = "sample", seed: str = "pairs", most: int | None = None) -> DataFrame:
    """Passing and failing samples of the same prompt paired by hash order; prompts without both give none."""
    good = samples.where(F.col(passed)).select(key, F.col(sample).alias("good"))
    bad = samples.where(~F.col(passed)).select(key, F.col(sample).alias("bad"))
    return zip_pairs(good, bad, [key], "good", "bad", seed, most)


def outcome(attempts: Column) -> Column:
    """first_pass, self_corrected or failed of an array of booleans; null or empty gives none."""
    return F.when(F.size(attempts) < 1, "none").when(F.get(attempts, 0), "first_pass").when(F.exists(attempts, lambda a: a), "self_corrected").when(attempts.isNull(), "none").otherwise("failed")


def mutants(df: DataFrame, code: str, edits: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each edit (kind, pattern, replacement) that changes the code."""
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_replace(code, pattern, new).alias("mutant")) for kind, pattern, new in edits])
    return df.withColumn("_m", F.explode(made)).where(F.col("_m.mutant") != F.col(code)).select(*df.columns, "_m.kind", "_m.mutant")


def resolve_arity(calls: DataFrame, overloads: DataFrame) -> DataFrame:
    """Calls (name, arity) with the number of overloads (name, least, most; null most is unbounded) that accept them."""
    joined = calls.join(overloads, "name", "left")
    fits = (F.col("arity") >= F.col("least")) & (F.col("arity") <= F.coalesce("most", F.lit(2**31 - 1)))
    return joined.groupBy("name", "arity").agg(F.count_if(fits).alias("accepting"), F.count("least").alias("known"))
