"""Problem 6: containers of fixed capacity filled with little unused space, by minimum bin slack.

Items are hashed into windows. A window knows its items as a multiset of lengths; each container takes the longest length
left and the multiset of lengths that fills the remainder best, found by subset-sum dynamic programming on bitsets
and recovered by walking the bitsets back. A filling found once is repeated while its lengths last. Containers
that a window could not fill well are opened again and their items packed in windows of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, token_counts
from weftline.session import cut

#: Items that a window has on average.
WINDOW = 8192
#: Containers with a larger unused share are opened for the second round.
LOOSE = 0.005


def best_fill(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``sizes`` (descending, each at most counts[size] times) whose sum comes closest to ``room``."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for size in sizes:
        if size > room:
            continue
        left, part = min(counts[size], room // size), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            steps.append((size, take, reach))
            reach |= reach << size * take & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths used, times) for containers that hold the whole multiset ``counts`` of lengths in 1..capacity."""
    counts, out = dict(counts), []
    sizes = sorted(counts, reverse=True)
    while sizes:
        longest = sizes[0]
        counts[longest] -= 1
        used = best_fill(sizes, counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[s] // n for s, n in used.items())
        for s, n in used.items():
            counts[s] -= n * times
        out.append((used, times))
        sizes = [s for s in sizes if counts[s]]
    return out


def _pack_window(group: pd.DataFrame) -> pd.DataFrame:
    capacity = int(group["capacity"].iloc[0])
    rows = group.sort_values(["doc_id", "piece"])
    items: dict[int, list] = {}
    for at, size in enumerate(rows["tokens"].tolist()):
        items.setdefault(size, []).append(at)
    place, fill, number = [0] * len(rows), [], 0
    for used, times in pack_lengths({s: len(v) for s, v in items.items()}, capacity):
        for _ in range(times):
            for size, n in used.items():
                for _ in range(n):
                    place[items[size].pop()] = number
            fill.append(sum(s * n for s, n in used.items()))
            number += 1
    prefix = f"{rows['round'].iloc[0]}-{rows['window'].iloc[0]}-"
    return pd.DataFrame({"pack_name": rows["pack_name"], "container": [prefix + str(p) for p in place], "capacity": capacity, "used": [fill[p] for p in place], "doc_id": rows["doc_id"], "piece": rows["piece"], "start_token": rows["start_token"], "tokens": rows["tokens"]})


_SCHEMA = "pack_name string, container string, capacity int, used bigint, doc_id bigint, piece int, start_token bigint, tokens bigint"


def _windows(items: DataFrame, turn: int, window: int) -> DataFrame:
    counted = items.groupBy("pack_name").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(window)))).cast("int").alias("windows"))
    spread = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece"), F.col("windows")).cast("int")
    # One row for each pack size.
    return items.join(F.broadcast(counted), "pack_name").select(*items.columns, F.lit(turn).alias("round"), spread.alias("window")).groupBy("pack_name", "window").applyInPandas(_pack_window, _SCHEMA)


def pack_items(lengths: DataFrame, pack_sizes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pack_name, container, capacity, used, doc_id, piece, start_token, tokens): every item of ``lengths`` in each pack.

    ``lengths`` has doc_id and tokens; ``pack_sizes`` has pack_name and capacity_tokens (some rows at any scale). An item is cut
    only if it is longer than the capacity: its whole pieces fill a container each, the rest is an item. Items
    without tokens, null ids or lengths and packs of null or no capacity need no container. A repeated doc_id is an item of
    its own as often as it occurs.
    """
    packs = pack_sizes.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").alias("capacity")).distinct()
    items = lengths.where("doc_id is not null and tokens > 0").select("doc_id", F.col("tokens").alias("length"))
    pieces = (
        items.join(F.broadcast(packs))  # a few pack sizes beside every item is the result's own size
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor((F.col("length") - 1) / F.col("capacity"))).cast("int"))))
        .withColumn("start_token", F.col("piece").cast("bigint") * F.col("capacity"))
        .select("pack_name", "capacity", "doc_id", "piece", "start_token", F.least(F.col("capacity").cast("bigint"), F.col("length") - F.col("start_token")).alias("tokens"))
    )
    whole = pieces.where("tokens = capacity").select("pack_name", F.concat_ws("-", F.lit("w"), "doc_id", "piece", F.monotonically_increasing_id()).alias("container"), "capacity", F.col("tokens").alias("used"), "doc_id", "piece", "start_token", "tokens")
    first = cut(_windows(pieces.where("tokens < capacity"), 1, window))
    loose = F.col("used") < F.col("capacity") * (1 - LOOSE)
    again = _windows(first.where(loose).drop("container", "used"), 2, window)
    return whole.unionByName(first.where(~loose)).unionByName(again)


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_items over the token counts of ``documents`` (doc_id, text); null texts are left out."""
    return pack_items(cut(token_counts(documents, tokenizer=tokenizer)), pack_sizes)


def pack_report(packed: DataFrame) -> DataFrame:
    """(pack_name, containers, fewest, tokens, fill_pm): containers used, the least number possible by volume, and the fill."""
    return packed.groupBy("pack_name").agg(
        F.countDistinct("container").alias("containers"),
        F.ceil(F.sum("tokens") / F.max("capacity")).alias("fewest"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") * 1000 / (F.countDistinct("container") * F.max("capacity")), 2).alias("fill_pm"),
    )
