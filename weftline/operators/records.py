"""Record operators: routing to ports, expansion, grouped state, changes between snapshots, effective lookups, versions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.scale import global_row_number
from weftline.session import cut, share

def route(df: DataFrame, rules: Sequence[tuple[Column, int]], otherwise: int, out: str = "port") -> DataFrame:
    """The port of the first rule that holds; a null condition does not hold. Later rules are not looked at."""
    port = F.lit(None).cast("int")
    for condition, number in reversed(rules):
        port = F.when(condition, F.lit(number)).otherwise(port)
    return df.withColumn(out, F.coalesce(port, F.lit(otherwise)))


def to_ports(df: DataFrame, ports: Sequence[int], out: str = "port") -> DataFrame:
    """Every row once for each port."""
    return df.withColumn(out, F.explode(F.array(*map(F.lit, ports))))


def split_filter(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); null counts as rejected."""
    return df.where(condition), df.where(~F.coalesce(condition, F.lit(False)))


def hash_partition(df: DataFrame, keys: Sequence[str], n: int, out: str = "port") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def all_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules that fail, in order, joined with a comma; null if none does. A null condition fails no rule."""
    failed = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))
    return F.when(F.size(failed) > 0, F.array_join(failed, ","))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(code)) for code, c in rules])


def expand(df: DataFrame, items: Column, keep: Sequence[str], item: str = "item", placeholder: bool = False) -> DataFrame:
    """One row for each element with ordinal (from 1) and total; with ``placeholder`` an empty or null list gives one null row."""
    d = df.withColumn("_items", items)
    burst = F.posexplode_outer("_items") if placeholder else F.posexplode("_items")
    rows = d.select(*keep, F.greatest(F.size("_items"), F.lit(0)).alias("total"), burst.alias("_i", item))
    return rows.select(*keep, item, (F.col("_i") + 1).alias("ordinal"), "total")


def fixed_groups(df: DataFrame, part: Sequence[str], order: Sequence[Column | str], size: int, out: str = "grp") -> DataFrame:
    """Groups of ``size`` consecutive rows; the last may be smaller."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1) / size))


def islands(df: DataFrame, part: Sequence[str], order: Sequence[Column | str], key: str, out: str = "island") -> DataFrame:
    """Contiguous runs of an equal key; coming back to a key begins a new run. Null keys are equal."""
    w = Window.partitionBy(*part).orderBy(*order)
    starts = F.when(F.row_number().over(w) == 1, 1).when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn("_start", starts).withColumn(out, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def balance_with_resets(df: DataFrame, part: Sequence[str], order: Sequence[Column | str], kind: Column, opening: Column, amount: Column, out: str = "balance") -> DataFrame:
    """Carried balance: OPEN replaces it (null as 0), MOVE adds a non-null amount, CLOSE makes it 0, anything else keeps it."""
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_set", F.when(kind == "OPEN", F.coalesce(opening, F.lit(0))).when(kind == "CLOSE", F.lit(0)))
    d = d.withColumn("_segment", F.count("_set").over(upto)).withColumn("_step", F.coalesce(F.col("_set"), F.when(kind == "MOVE", F.coalesce(amount, F.lit(0))), F.lit(0)))
    inner = Window.partitionBy(*part, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.sum("_step").over(inner)).drop("_set", "_segment", "_step")


def changes(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, status, changed): ONLY_A, ONLY_B, UPDATE or UNCHANGED with the fields that differ, nulls being equal.

    Null keys are equal too; of repeated keys every pair is compared.
    """
    left = a.select(*keys, F.struct(*fields).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*fields).alias("_b"), F.lit(True).alias("_in_b"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = left.join(right, condition, "full")
    differing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields])), ",")
    status = F.when(F.col("_in_b").isNull(), "ONLY_A").when(F.col("_in_a").isNull(), "ONLY_B").when(differing == "", "UNCHANGED").otherwise("UPDATE")
    out = both.withColumn("status", status).withColumn("changed", F.when(F.col("status") == "UPDATE", differing).otherwise(""))
    return out.select(*[F.when(F.col("_in_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], "status", "changed")


def hash_join(driver: DataFrame, slave: DataFrame, keys: Sequence[tuple[str, str]], order: Sequence[Column | str], how: str = "left", ignore_case: bool = False, duplicates: bool = False) -> DataFrame:
    """Driver rows with the first slave row of their key, or all of them with ``duplicates``; null keys are equal."""
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    one = slave.withColumns({f"_s{i}": fold(F.col(s)) for i, (_, s) in enumerate(keys)})
    if not duplicates:
        w = Window.partitionBy(*[f"_s{i}" for i in range(len(keys))]).orderBy(*order)
        one = one.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    condition = F.lit(True)
    for i, (d, _) in enumerate(keys):
        condition = condition & fold(driver[d]).eqNullSafe(one[f"_s{i}"])
    return driver.join(one, condition, how).drop(*[f"_s{i}" for i in range(len(keys))])


def key_mapping(text: str) -> list[list[tuple[str, str]]]:
    """For each port the (driver, slave) columns of a rule such as ``$a=$b;$c=$d#$x=$y``; a column alone stands on both sides."""
    ports = []
    for part in text.split("#"):
        pairs = []
        for one in filter(None, (p.strip() for p in part.split(";"))):
            left, _, right = one.partition("=")
            names = [n.strip().removeprefix("$") for n in (left, right or left)]
            if not all(names):
                raise ValueError(f"no columns in {one!r}")
            pairs.append((names[0], names[1]))
        ports.append(pairs)
    return ports


def call_out(df: DataFrame, send, schema: str, tries: int = 3) -> DataFrame:
    """Rows passed in batches to ``send`` (a pandas frame in, one out, as ``schema`` says), such as a client of an outside service.

    A call that raises is repeated ``tries`` times, then its task fails. Connections are the function's own matter.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left in range(tries, 0, -1):
                try:
                    out = send(batch)
                    break
                except Exception:
                    if left == 1:
                        raise
            yield out

    return df.mapInPandas(work, schema)


def combine(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """The i-th rows of two flows side by side; the longer one goes on with nulls. Numbers are given over ranges."""
    numbered = lambda df, order: global_row_number(df, [F.col(o) for o in order], "_rn")
    return numbered(a, order_a).join(numbered(b, order_b), "_rn", "full").drop("_rn")


def cascade_lookup(df: DataFrame, rules: DataFrame, levels: Sequence[Sequence[tuple[str, str]]], when: str, value: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """``value`` of the first level (pairs of row and rule column, '*' in the rule for columns left out) with a rule valid at ``when``.

    Both bounds are inclusive, a null valid_to is open; of several rules at a level the latest valid_from holds. Adds
    ``level`` (1 for the most exact) with it; rows without any rule keep nulls.
    """
    named = sorted({r for level in levels for _, r in level})
    out = cut(df.withColumn("_row", F.monotonically_increasing_id()))  # written, so that a row keeps its number however often it is read
    found: DataFrame | None = None
    for number, level in enumerate(levels, 1):
        exact = dict((r, d) for d, r in level)
        eligible = rules.where(" and ".join(f"`{r}` {'<>' if r in exact else '='} '*'" for r in named)) if named else rules
        condition = (F.col(f"d.{when}") >= F.col(f"r.{valid_from}")) & (F.col(f"r.{valid_to}").isNull() | (F.col(f"d.{when}") <= F.col(f"r.{valid_to}")))
        for r, d in exact.items():
            condition = condition & (F.col(f"d.{d}") == F.col(f"r.{r}"))
        met = out.alias("d").join(eligible.alias("r"), condition).select("d._row", F.lit(number).alias("level"), F.col(f"r.{valid_from}").alias("_from"), F.col(f"r.{value}").alias(value))
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("_row").agg(F.min_by(F.struct("level", value), F.struct("level", -F.unix_micros(F.col("_from").cast("timestamp")))).alias("_best"))
    return out.join(best, "_row", "left").select(*df.columns, F.col("_best.level").alias("level"), F.col(f"_best.{value}").alias(value))


def versions(df: DataFrame, key: Sequence[str], order: Sequence[str], tracked: Sequence[str], since: str) -> DataFrame:
    """Slowly changing versions: (key, tracked, valid_from, valid_to, version); consecutive equal rows are one version."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for t in tracked:
        same = same & F.lag(t).over(w).eqNullSafe(F.col(t))
    changed = df.withColumn("_new", (F.row_number().over(w) == 1) | ~same).where("_new")
    return changed.select(*key, *tracked, F.col(since).alias("valid_from"), F.lead(since).over(w).alias("valid_to"), F.row_number().over(w).alias("version"))


def survivors(df: DataFrame, key: Sequence[str], slot: str, order: str, removal: Column) -> DataFrame:
    """Entries after which no removal of the same slot comes; removals themselves are left out."""
    w = Window.partitionBy(*key, slot)
    return df.withColumn("_removed", F.max(F.when(removal, F.col(order))).over(w)).where(~removal & (F.col("_removed").isNull() | (F.col("_removed") < F.col(order)))).drop("_removed")


def _clip_chain(steps: Sequence[float], cap: float, after: tuple[float, float, float] = (0.0, float("-inf"), float("inf"))) -> tuple[float, float, float]:
    """The composite of x -> min(max(x + d, 0), cap) ``after`` another, as (shift, low, high): x -> min(max(x + shift, low), high)."""
    shift, low, high = after
    for d in steps:
        shift, low, high = shift + d, min(max(low + d, 0.0), cap), min(max(high + d, 0.0), cap)
    return shift, low, high


def clipped_level(df: DataFrame, key: str, order: Sequence[str], inflow: str, outflow: str, cap: float) -> DataFrame:
    """(key, order..., level, spill): level = clip(previous + inflow - outflow, 0, cap) from 0, spill what exceeds the cap.

    Clipping is not a sum, yet its composites have three numbers. Rows are cut into ranges of key and order, a key with many rows
    over several of them. Each range gives the composites of its first and last key, from which follows the level that its
    first key begins with; then every range is replayed on its own. Nulls count 0, rows with a null key are one key.
    """
    rows = df.select(key, *order, F.coalesce(F.col(inflow), F.lit(0.0)).cast("double").alias("_in"), F.coalesce(F.col(outflow), F.lit(0.0)).cast("double").alias("_out"))
    rows = cut(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_p", F.spark_partition_id()))
    kinds = dict(df.dtypes)

    def runs(batch: pd.DataFrame) -> list[tuple[object, int, int]]:
        """(key, start, end) of the runs of equal keys; all nulls are equal."""
        codes = pd.factorize(batch[key], use_na_sentinel=True)[0]
        at = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        return [(None if codes[a] < 0 else batch[key].iloc[a], a, b) for a, b in zip(at, at[1:]) if b > a]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, found = None, []  # the composites of the first and of the latest key
        for batch in batches:
            steps = (batch["_in"] - batch["_out"]).tolist()
            for k, a, b in runs(batch):
                part = int(batch["_p"].iloc[a])
                if found and found[-1][0] == k:
                    found[-1] = (k, _clip_chain(steps[a:b], cap, found[-1][1]))
                else:
                    found = [*found[:1], (k, _clip_chain(steps[a:b], cap))]
        for n, (k, (shift, low, high)) in enumerate(found):
            yield pd.DataFrame({"p": [part], "n": [n], key: pd.Series([k], dtype=object), "shift": [shift], "low": [low], "high": [high]})

    told = rows.mapInPandas(ends, f"p int, n int, {key} {kinds[key]}, shift double, low double, high double").orderBy("p", "n").collect()  # two rows for each range
    begin: dict[int, float] = {}
    last, level = None, 0.0
    for r in told:
        start = level if last is not None and r[key] == last[0] else 0.0
        if r["n"] == 0:
            begin[r["p"]] = start
        last, level = (r[key],), min(max(start + r["shift"], r["low"]), r["high"])
    known = share(df.sparkSession, begin)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        level = 0.0
        for batch in batches:
            steps, levels, spills = (batch["_in"] - batch["_out"]).tolist(), [], []
            for k, a, b in runs(batch):
                if current is None:
                    level = known().get(int(batch["_p"].iloc[a]), 0.0)
                elif current[0] != k:
                    level = 0.0
                current = (k,)
                for d in steps[a:b]:
                    raw = level + d
                    level = min(max(raw, 0.0), cap)
                    levels.append(level)
                    spills.append(max(0.0, raw - cap))
            yield batch[[key, *order]].assign(level=levels, spill=spills)

    return rows.mapInPandas(replay, ", ".join(f"{c} {kinds[c]}" for c in (key, *order)) + ", level double, spill double")
