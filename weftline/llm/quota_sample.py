"""Problem 5: a sample that matches target category proportions, by divisor-method priorities.

Pairs fall into cells of equal targeted categories. Raking over the cells' counts gives each cell its expected seats, rounded by the
divisor method and shifted between cells until each target that can be met is met. A pair at random rank r of its cell has
the priority (r - 0.5) / seats. Records that secure a category's minimum come first, then the globally smallest
priorities; a cell that runs out has no further priorities, so its seats go to others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.group_split import type_label
from weftline.operators.scale import distributed_row_number, global_row_number, hash_bucket, salted_join
from weftline.session import cut

#: Share of the pairs that is drawn, as 1 / DRAW. Fixed by the task.
DRAW = 5
#: Raking stops after so many rounds over all categories.
ROUNDS = 60
#: Cells that are tried at once as takers of a seat.
TAKERS = 64
BUCKETS = 256


def categories(provenance: DataFrame, bundles: DataFrame) -> DataFrame:
    """(pair_id, cats ARRAY<STRING>) for each distinct pair_id; cats holds sorted ``kind=LABEL`` strings.

    Of rows delivered twice the last logged holds. Labels are compared by type_label; a null label, an example without a bundle
    and null or empty modes give no category; a mode named twice counts once. Null pair_ids are left out.
    """
    last = Window.partitionBy("pair_id").orderBy(F.col("logged_at").desc_nulls_last())
    pairs = provenance.select("pair_id", "example_id", "rejected_exec_level", "rejected_failure_modes", "logged_at").where("pair_id is not null")
    pairs = cut(pairs.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "logged_at"))
    kinds = bundles.where("example_id is not null").groupBy(F.lower("example_id").alias("key")).agg(F.min(type_label(F.col("component_type"))).alias("component"))
    typed = salted_join(pairs.withColumn("key", F.lower("example_id")), kinds, ["key"], "left", F.xxhash64("pair_id"))
    one = lambda kind, c: F.when(F.length(c) > 0, F.concat(F.lit(kind + "="), c))
    modes = F.transform(F.coalesce("rejected_failure_modes", F.array().cast("array<string>")), lambda m: one("failure_mode", type_label(m)))
    cats = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(one("component_type", F.col("component")), one("rejected_exec_level", type_label(F.col("rejected_exec_level")))), modes))))
    return typed.select("pair_id", cats.alias("cats"))


def _targets(sample_targets: DataFrame) -> dict[str, tuple[str, str, int, int]]:
    """Category to (kind, value as spelled, per mille, minimum); the table has some dozens of rows at any scale."""
    rows = sample_targets.where("category_kind is not null and category_value is not null").select("category_kind", "category_value", type_label(F.col("category_value")), F.coalesce("target_pm", F.lit(0)), F.coalesce("min_rows", F.lit(0))).collect()
    return {f"{kind}={label}": (kind, value, int(pm), int(least)) for kind, value, label, pm, least in rows}


def shortfalls(sample_targets: DataFrame, available: DataFrame, pairs: int) -> DataFrame:
    """Targets with (available, required, short); required is greatest(min_rows, sample size * target_pm div 1000)."""
    size = pairs // DRAW
    wanted = sample_targets.where("category_kind is not null and category_value is not null").select(
        "category_kind", "category_value", F.concat_ws("=", "category_kind", type_label(F.col("category_value"))).alias("cat"), F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.floor(F.lit(size).cast("bigint") * F.coalesce("target_pm", F.lit(0)) / 1000)).alias("required")
    )
    return wanted.join(available, "cat", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("short", F.col("available") < F.col("required"))


def _available(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode("cats").alias("cat")).groupBy("cat").agg(F.count(F.lit(1)).alias("available"))


def unmet_targets(provenance: DataFrame, bundles: DataFrame, sample_targets: DataFrame) -> DataFrame:
    """(category_kind, category_value) of the targets that the pairs at hand cannot meet; nulls as in categories.

    The drawn sample shows the targets it misses; the exact counts then tell those that no sample could meet.
    """
    return sample_report(provenance, bundles, sample_targets).where("drawn < required and short").select("category_kind", "category_value").distinct()


def rake(inside: np.ndarray, counts: np.ndarray, goals: np.ndarray, size: int) -> np.ndarray:
    """Expected seats for each cell such that the targets' sums follow ``goals`` as far as the counts allow.

    ``inside`` is cells x targets. A group's sum is brought to its goal by one factor, cells that would exceed their
    count are filled and the others share the rest.
    """
    seats = counts * size / max(1.0, counts.sum())
    groups = [(np.arange(len(counts)), float(size)), *((np.flatnonzero(inside[:, t]), float(g)) for t, g in enumerate(goals))]
    for _ in range(ROUNDS):
        for members, goal in groups:
            free, rest = members, goal
            while len(free):
                now = seats[free].sum()
                factor = rest / now if now > 0 else 0.0
                over = seats[free] * factor > counts[free]
                if not over.any():
                    seats[free] *= factor
                    break
                seats[free[over]] = counts[free[over]]
                rest = max(0.0, rest - counts[free[over]].sum())
                free = free[~over]
    return seats


def _rounded(seats: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Whole seats by the divisor method: the threshold is moved until they sum to ``size``."""
    low, high = 0.0, 2.0
    at = lambda t: np.minimum(counts, np.floor(seats * t + 0.5))
    while at(high).sum() < size and high < 1e12:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() < size else (low, middle)
    whole = at(high)
    spare = int(whole.sum() - size)
    if spare > 0:  # cells that reach a seat at the same threshold: the last ones give it back
        gone = np.flatnonzero(whole > at(low))[-spare:]
        whole[gone] -= 1
    return whole


def allot(inside: np.ndarray, counts: np.ndarray, goals: np.ndarray, size: int) -> np.ndarray:
    """Whole seats for each cell: raked, rounded, then moved between cells as long as that lessens what targets lack.

    A seat that moves helps the targets of the taker that lack some, and harms those of the giver that have no more than
    their goal; targets of both stay as they are. The TAKERS cells that would help most are tried against all others.
    """
    whole = _rounded(np.maximum(rake(inside, counts, goals, size), 1e-9), counts, size)
    member = inside.astype(float)
    while True:
        lacking = goals - whole @ member
        short, tight = lacking > 0, lacking >= 0
        helps = np.where(whole < counts, member @ short, 0.0)
        takers = np.argsort(-helps, kind="stable")[:TAKERS]
        net = helps[takers][:, None] - (member @ tight)[None, :] + (member[takers] * (tight & ~short)) @ member.T
        net[:, whole <= 0] = -np.inf
        net[helps[takers] <= 0] = -np.inf
        at = int(np.argmax(net)) if net.size else 0
        if not net.size or net.flat[at] <= 0:
            return whole
        to, giver = int(takers[at // net.shape[1]]), at % net.shape[1]
        gained, lost = inside[to] & ~inside[giver], inside[giver] & ~inside[to]
        n = min(counts[to] - whole[to], whole[giver], *lacking[gained & short], *-lacking[lost & ~tight])
        whole[to] += n
        whole[giver] -= n


def draw_sample(provenance: DataFrame, bundles: DataFrame, sample_targets: DataFrame, seed: str = "sample") -> DataFrame:
    """(pair_id, cats, floor, priority, seat): as many pairs as a fifth of all, seats numbered from 1.

    Cells are the combinations of targeted categories in use; the targets are some dozens at any scale, so the number of cells
    does not grow with the pairs, and seats are worked out on the driver; pairs never go there. Ties are broken by pair_id.
    Without pairs or without targets the result is empty or a plain random sample. Nulls as in categories.
    """
    return _drawn(cut(categories(provenance, bundles)), sample_targets, seed)


def _drawn(pairs: DataFrame, sample_targets: DataFrame, seed: str) -> DataFrame:
    goals = _targets(sample_targets)
    names = sorted(goals)
    known = F.array(*map(F.lit, names)).cast("array<string>")
    pairs = pairs.withColumn("cell", F.array_join(F.array_intersect("cats", known), "|"))
    counted = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    counts = np.array([r["n"] for r in counted], float)
    size = int(counts.sum()) // DRAW
    inside = np.array([[n in cats for n in names] for cats in (set(r["cell"].split("|")) for r in counted)], bool).reshape(len(counted), len(names))
    wanted = np.array([max(goals[n][3], size * goals[n][2] // 1000) for n in names], float)
    whole = allot(inside, counts, np.minimum(wanted, counts @ inside), size) if size else np.zeros(len(counted))
    spark = pairs.sparkSession
    shares = spark.createDataFrame([(r["cell"], float(w)) for r, w in zip(counted, whole)] or [("", 0.0)], "cell string, seats double")
    random = F.xxhash64(F.lit(seed), "pair_id")
    # One row for each combination of targeted labels.
    open_cells = pairs.join(F.broadcast(shares.where("seats > 0")), "cell")
    ranked = distributed_row_number(open_cells, ["cell"], [F.shiftrightunsigned(random, 1), F.col("pair_id")], hash_bucket(BUCKETS, "pair_id", seed=seed), BUCKETS)
    # Seats sum to the sample's size, so the globally smallest priorities are those below 1.
    chosen = cut(ranked.withColumn("priority", (F.col("rn") - 0.5) / F.col("seats")).where("priority < 1").select("pair_id", "cats", "priority"))
    most = max([goals[n][3] for n in names], default=0)
    floors = spark.createDataFrame([(n, goals[n][3]) for n in names] or [("", 0)], "cat string, least int")
    first = Window.partitionBy("cat").orderBy("priority", "pair_id")
    # The limit on the rank goes into the scan of each task, so a category sends no more than its minimum from anywhere.
    kept = chosen.select("pair_id", "priority", F.explode("cats").alias("cat")).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= F.lit(most))
    kept = kept.join(F.broadcast(floors), "cat").where("_rn <= least").select("pair_id").distinct().withColumn("floor", F.lit(True))
    marked = chosen.join(kept, "pair_id", "left").withColumn("floor", F.coalesce("floor", F.lit(False))).select("pair_id", "cats", "floor", "priority")
    return global_row_number(marked, [F.col("floor").desc(), F.col("priority"), F.xxhash64(F.lit(seed), "pair_id"), F.col("pair_id")], "seat")


def sample_report(provenance: DataFrame, bundles: DataFrame, sample_targets: DataFrame) -> DataFrame:
    """(category_kind, category_value, available, required, drawn, short, missed): each target with what the sample gives it.

    short tells that too few pairs belong to the category, missed that the sample holds fewer than required, for that or
    because other targets stand against it.
    """
    pairs = cut(categories(provenance, bundles))
    got = _drawn(pairs, sample_targets, "sample").select(F.explode("cats").alias("cat")).groupBy("cat").agg(F.count(F.lit(1)).alias("drawn"))
    told = shortfalls(sample_targets, _available(pairs), pairs.count()).join(got, "cat", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return told.select("category_kind", "category_value", "available", "required", "drawn", "short", (F.col("drawn") < F.col("required")).alias("missed"))
