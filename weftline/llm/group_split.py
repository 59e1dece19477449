"""Problem 3: splits that keep related records together.

Files and authors are vertices, rows that name both are edges. Random-mate contraction: each round every vertex tosses a
coin, tails with a head among their neighbours are merged into it, edges are renamed and made distinct, until none is left.
The merges form a forest of at most as many levels as there were rounds; unwinding it by pointer doubling labels
every vertex. Components then go to splits by cumulative weight within strata of their commonest component type.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import contract
from weftline.operators.scale import distributed_running_sum, hash_bucket, salted_join, sized_join
from weftline.session import cut

#: A component is heavy from this share of all rows on; hence there are at most 1 / HEAVY of them.
HEAVY = 0.002
#: Author labels that join nothing. Fixed values.
NO_AUTHOR = ("", "unknown", "n/a")


def file_name(path: Column) -> Column:
    """The part after the last slash or backslash, lower case, without surrounding blanks; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(path, r"(?s)^.*[/\\]", ""), r"(?U)^\s+|\s+$", "")), F.lit(""))


def author_name(meta: Column) -> Column:
    name = F.lower(F.regexp_replace(F.try_element_at(meta, F.lit("author")), r"(?U)^\s+|\s+$", ""))
    return F.when(~name.isin(*NO_AUTHOR), name)


def type_label(label: Column) -> Column:
    """Labels are equal without regard to letter case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.upper(label), r"(?U)[\s_\-]+", "")


def related_rows(rows: DataFrame) -> DataFrame:
    """(rec_id, id, vertex, root, group_file) for every row of ``rows`` (rec_id, id, source_file, meta).

    root names the group: the same file name or author, also through other rows. A row with neither is a group of its
    own, with a null group_file. group_file is null too in groups without a file. Rows with a null rec_id are left out;
    a null file, a null meta and a null author join nothing.
    """
    named = rows.select("rec_id", "id", F.concat(F.lit("f:"), file_name(F.col("source_file"))).alias("f"), F.concat(F.lit("a:"), author_name(F.col("meta"))).alias("a")).where("rec_id is not null")
    named = cut(named.withColumn("vertex", F.coalesce("f", "a", F.concat(F.lit("r:"), F.col("rec_id").cast("string")))))
    forest = contract(named.select(F.col("f").alias("u"), F.col("a").alias("v")))
    vertices = named.select(F.explode(F.array_compact(F.array("f", "a"))).alias("vertex")).distinct()
    vertices = cut(sized_join(vertices, forest, ["vertex"], "left").withColumn("root", F.coalesce("root", "vertex")))
    files = cut(vertices.where("startswith(vertex, 'f:')").groupBy("root").agg(F.min(F.expr("substring(vertex, 3)")).alias("group_file")))
    labels = cut(sized_join(vertices, files, ["root"], "left", F.xxhash64("vertex")))
    joined = sized_join(named.select("rec_id", "id", "vertex"), labels, ["vertex"], "left", F.xxhash64("rec_id"))
    return joined.select("rec_id", "id", "vertex", F.coalesce("root", "vertex").alias("root"), "group_file")


def group_files(rows: DataFrame) -> DataFrame:
    """(rec_id, group_file) for each row whose group holds a file name; see related_rows."""
    return related_rows(rows).where("group_file is not null").select("rec_id", "group_file").distinct()


def _place_heavy(targets: list[tuple[str, float]], totals: dict[str, int]):
    """Largest first, each into the split where the types' deviations from their shares stay least."""

    def place(group: pd.DataFrame) -> pd.DataFrame:
        got = {name: dict.fromkeys(totals, 0) for name, _ in targets}
        out = []
        for _, r in group.sort_values(["weight", "root"], ascending=[False, True]).iterrows():
            kinds = dict(zip(r["kinds"], map(int, r["counts"])))

            def cost(name: str, share: float) -> float:
                return sum(max(0.0, got[name][k] + n - share * totals[k]) ** 2 / max(1.0, share * totals[k]) - max(0.0, got[name][k] - share * totals[k]) ** 2 / max(1.0, share * totals[k]) for k, n in kinds.items())  # noqa: B023

            name = min(targets, key=lambda t: (cost(*t), -t[1], t[0]))[0]
            for k, n in kinds.items():
                got[name][k] += n
            out.append((r["root"], name))
        return pd.DataFrame(out, columns=["root", "split_name"])

    return place


def _stratum() -> Column:
    """The types of a component if they are one or two, else its commonest one and a mark; so there are few strata."""
    kinds = F.array_sort(F.collect_set("component_type"))
    return F.when(F.size(kinds) <= 2, F.array_join(kinds, "+")).otherwise(F.concat(F.max_by("component_type", F.struct("n", "component_type")), F.lit("+*")))


def _cuts(names: list[str], shares: list[float], totals: dict[str, int], taken: dict[tuple[str, str], int], mixed: dict[tuple[str, str], int]) -> list[tuple[str, str, float, float]]:
    """(stratum, split, low, high): the parts of each stratum that bring all types closest to their shares.

    Least squares over parts that are not negative and sum to 1 in a stratum, by projected gradient.
    """
    strata, kinds = sorted({s for s, _ in mixed}), sorted(totals)
    if not strata:
        return []
    content = np.array([[mixed.get((s, k), 0) for k in kinds] for s in strata], float)
    want = np.array([[share * totals[k] for share in shares] for k in kinds])
    have = np.array([[taken.get((n, k), 0) for n in names] for k in kinds], float)
    scale = 1.0 / np.maximum(1.0, want)
    parts = np.tile(np.array(shares), (len(strata), 1))
    rate = 0.5 / max(1e-9, float(np.linalg.norm(content.T * np.sqrt(scale.max(axis=1))[:, None], 2) ** 2))
    for _ in range(5000):
        gradient = content @ (scale * (have + content.T @ parts - want))
        parts = _simplex(parts - rate * 2 * gradient)
    out = []
    for s, row in zip(strata, parts):
        edges = np.concatenate([[0.0], np.cumsum(row)])
        edges[-1] = 2.0
        out += [(s, n, float(edges[j]), float(edges[j + 1])) for j, n in enumerate(names)]
    return out


def _simplex(rows: np.ndarray) -> np.ndarray:
    """Each row's nearest point with parts that are not negative and sum to 1."""
    ordered = -np.sort(-rows, axis=1)
    over = np.cumsum(ordered, axis=1) - 1
    n = (ordered - over / np.arange(1, rows.shape[1] + 1) > 0).sum(axis=1)
    return np.maximum(0.0, rows - (over[np.arange(len(rows)), n - 1] / n)[:, None])


def assign_splits(rows: DataFrame, bundles: DataFrame, split_targets: DataFrame) -> DataFrame:
    """(rec_id, root, component_type, split_name): every row gets a split, related rows the same one.

    Shares come from split_targets (split_name, share_pm; a handful of rows), overall and for each component type of
    ``bundles`` (example_id = lower-case id; rows without a bundle form the type ''). Heavy components, of which there are
    at most 1/HEAVY, are placed greedily; the others are laid end to end in random order within the stratum of their
    types and cut by cumulative weight, at parts chosen so that all types come closest to their shares beside the heavy
    ones. No rows give no rows; targets that sum to nothing raise.
    """
    targets = sorted(((r[0], int(r[1])) for r in split_targets.where("split_name is not null and share_pm > 0").select("split_name", "share_pm").collect()), key=lambda t: (-t[1], t[0]))
    if not targets:
        raise ValueError("split_targets has no positive share")
    shares = [(name, pm / sum(p for _, p in targets)) for name, pm in targets]
    kinds = bundles.where("example_id is not null").groupBy(F.lower("example_id").alias("key")).agg(F.min(type_label(F.col("component_type"))).alias("component_type"))
    related = related_rows(rows).withColumn("key", F.lower("id"))
    typed = cut(salted_join(related, kinds, ["key"], "left", F.xxhash64("rec_id")).select("rec_id", "root", F.coalesce("component_type", F.lit("")).alias("component_type")))
    counted = typed.groupBy("root", "component_type").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(
        counted.groupBy("root").agg(
            F.sum("n").alias("weight"), _stratum().alias("stratum"), F.map_from_entries(F.collect_list(F.struct("component_type", "n"))).alias("kinds")
        )
    )
    totals = {r[0]: r[1] for r in counted.groupBy("component_type").agg(F.sum("n")).collect()}  # one row per type
    heavy = groups.where(F.col("weight") >= F.lit(max(1.0, HEAVY * sum(totals.values()))))
    light = groups.join(heavy.select("root"), "root", "left_anti")
    placed = cut(heavy.select("root", "weight", F.map_keys("kinds").alias("kinds"), F.map_values("kinds").alias("counts"), F.lit(1).alias("all")).groupBy("all").applyInPandas(_place_heavy(shares, totals), "root string, split_name string"))
    taken = {(r[0], r[1]): r[2] for r in placed.join(heavy, "root").select("split_name", F.explode("kinds").alias("k", "n")).groupBy("split_name", "k").agg(F.sum("n")).collect()}
    mixed = {(r[0], r[1]): r[2] for r in light.select("stratum", F.explode("kinds").alias("k", "n")).groupBy("stratum", "k").agg(F.sum("n")).collect()}  # types x strata, some hundreds at most
    cuts = _cuts([n for n, _ in shares], [s for _, s in shares], totals, taken, mixed)
    bounds = typed.sparkSession.createDataFrame(cuts, "stratum string, split_name string, low double, high double")
    strata = light.groupBy("stratum").agg(F.sum("weight").alias("whole"))
    running = distributed_running_sum(light.select("root", "weight", "stratum"), ["stratum"], [F.xxhash64("root"), F.col("root")], hash_bucket(256, "root"), 256, "weight")
    middle = (F.col("running") - F.col("weight") / 2) / F.col("whole")
    # Types are a handful of labels, and so are the splits: both tables are bounded by types x splits.
    spread = running.join(F.broadcast(strata), "stratum").withColumn("at", middle).join(F.broadcast(bounds), "stratum").where("at >= low and at < high").select("root", "split_name")
    return salted_join(typed, placed.unionByName(spread), ["root"], "inner", F.xxhash64("rec_id")).select("rec_id", "root", "component_type", "split_name")


def split_report(assigned: DataFrame, split_targets: DataFrame) -> DataFrame:
    """(component_type, split_name, rows, share_pm, target_pm) with '*' for all types together."""
    counted = assigned.groupBy(F.col("component_type"), "split_name").agg(F.count(F.lit(1)).alias("rows"))
    counted = counted.unionByName(counted.groupBy("split_name").agg(F.sum("rows").alias("rows")).withColumn("component_type", F.lit("*")))
    whole = counted.groupBy("component_type").agg(F.sum("rows").alias("whole"))
    return (
        counted.join(whole, "component_type")
        .join(split_targets.select("split_name", F.col("share_pm").alias("target_pm")), "split_name", "left")
        .select("component_type", "split_name", "rows", F.round(F.col("rows") * 1000 / F.col("whole"), 1).alias("share_pm"), "target_pm")
    )
