"""Problem 1: records that are equal but for their formatting, counted in tries below a radix partitioning.

Every task first counts its own rows in a trie over canonical bytes, so a text held by a third of all rows leaves each
task a few times at most. The distinct keys of the tasks are then split by leading bytes: a bucket over capacity, in keys or
in bytes, is split at the end of its keys' common prefix plus STEP bytes, again and again, until each bucket fits; the
tries of the buckets give the totals. Rows that are no task's representative never travel with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.canonical import canonical
from weftline.operators.scale import salted_join
from weftline.session import cut, widen

#: Keys and bytes of a bucket that one trie takes.
CAPACITY, BUCKET_BYTES = 20_000, 32 << 20
#: A list of so many buckets to split is broadcast, at 12 bytes each; a longer one is joined in salted parts.
BROADCAST_BUCKETS = 100_000
#: Bytes added to a bucket's common prefix when it is split.
STEP = 3
#: Bytes that a task's trie and the list of its rows hold before it passes on what it has; a node and a row take about so much.
TRIE_BYTES, NODE_BYTES, ROW_BYTES = 48 << 20, 300, 64


class Node:
    __slots__ = ("label", "parent", "children", "count", "least", "told")

    def __init__(self, label: bytes, parent: Node | None) -> None:
        self.label, self.parent, self.children, self.count, self.least, self.told = label, parent, {}, 0, None, False

    def key(self) -> bytes:
        parts, node = [], self
        while node is not None:
            parts.append(node.label)
            node = node.parent
        return b"".join(reversed(parts))


class RadixTrie:
    """A path-compressed trie over bytes; terminal nodes count their keys and keep the smallest id."""

    def __init__(self) -> None:
        self.root, self.size = Node(b"", None), NODE_BYTES

    def add(self, key: bytes, count: int, least: int) -> Node:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:], node)
                node.children[key[at]] = child
                self.size += end - at + NODE_BYTES
                node, at = child, end
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = 1
            most = min(len(label), end - at)
            while shared < most and label[shared] == key[at + shared]:
                shared += 1
            middle = Node(label[:shared], node)
            self.size += NODE_BYTES
            child.label, child.parent = label[shared:], middle
            middle.children[child.label[0]] = child
            node.children[label[0]] = middle
            node, at = middle, at + shared
        node.count += count
        node.least = least if node.least is None else min(node.least, least)
        return node


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie, ids, nodes = RadixTrie(), [], []

    def flush() -> pd.DataFrame:
        out = []
        for i, node in zip(ids, nodes):
            first = i == node.least and not node.told
            node.told |= first
            out.append((i, node.least, node.key() if first else None, node.count if first else None))
        return pd.DataFrame(out, columns=["rec_id", "rep_id", "canon", "copies"]).astype({"copies": "Int64"})

    for batch in batches:
        for i, text in zip(batch["rec_id"], batch["text"]):
            nodes.append(trie.add(canonical(text).encode("utf-8", "surrogatepass"), 1, i))
            ids.append(i)
            if trie.size + len(ids) * ROW_BYTES > TRIE_BYTES:
                yield flush()
                trie, ids, nodes = RadixTrie(), [], []
    yield flush()


def _common(low: bytes, high: bytes) -> int:
    n = min(len(low), len(high))
    return next((i for i in range(n) if low[i] != high[i]), n)


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where to split a bucket, by its smallest and largest key; -1 if it holds one key only."""
    for batch in batches:
        upto = [-1 if low == high else _common(low, high) + STEP for low, high in zip(batch["low"], batch["high"])]
        yield pd.DataFrame({"bucket": batch["bucket"], "upto": pd.array(upto, "int32")})


def radix_buckets(keys: DataFrame, capacity: int = CAPACITY, most: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(fitting, alone): ``keys`` with ``bucket``, a number for the bytes that its keys begin with.

    No bucket of ``fitting`` has over ``capacity`` keys or ``most`` bytes; those of ``alone`` are larger but hold one key, repeated.
    Different beginnings with the same number share a bucket, which does no harm: tries compare whole keys.
    """
    fitting, alone, level = None, None, 0
    pending = keys.withColumn("bucket", F.lit(0).cast("bigint"))
    while True:
        sizes = pending.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("canon")).alias("bytes"), F.min("canon").alias("low"), F.max("canon").alias("high"))
        splits = cut(sizes.where((F.col("n") > 1) & ((F.col("n") > capacity) | (F.col("bytes") > most))).mapInPandas(_splits, "bucket bigint, upto int"))
        number = splits.count()
        if number == 0:
            fitting = pending if fitting is None else fitting.unionByName(pending)
            return fitting, (pending.where("false") if alone is None else alone)
        met = pending.join(F.broadcast(splits), "bucket", "left") if number <= BROADCAST_BUCKETS else salted_join(pending, splits, ["bucket"], "left", F.xxhash64("rep_id"))
        met = cut(met) if level else met  # the first level reads the tasks' keys, which are written already
        here = met.where("upto is null").drop("upto")
        one = met.where("upto < 0").drop("upto")
        fitting = here if fitting is None else fitting.unionByName(here)
        alone = one if alone is None else alone.unionByName(one)
        pending = met.where("upto >= 0").withColumn("bucket", F.xxhash64("bucket", F.expr("substring(canon, 1, upto)"))).drop("upto")
        level += 1


def _count(group: pd.DataFrame) -> pd.DataFrame:
    trie = RadixTrie()
    nodes = [trie.add(bytes(k), int(c), int(i)) for k, c, i in zip(group["canon"], group["copies"], group["rep_id"])]
    return pd.DataFrame({"rep_id": group["rep_id"], "keep_rec_id": [n.least for n in nodes], "copies": [n.count for n in nodes]})


def _members(rows: DataFrame, rec_id: str, text: str, capacity: int) -> DataFrame:
    source = rows.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(text).cast("string").alias("text")).where("rec_id is not null and text is not null")
    local = cut(widen(source).mapInPandas(_partial, "rec_id bigint, rep_id bigint, canon binary, copies bigint"))
    fitting, alone = radix_buckets(local.where("canon is not null").select("rep_id", "canon", "copies"), capacity)
    totals = fitting.groupBy("bucket").applyInPandas(_count, "rep_id bigint, keep_rec_id bigint, copies bigint")
    whole = alone.groupBy("bucket").agg(F.min("rep_id").alias("keep_rec_id"), F.sum("copies").alias("copies"))
    totals = totals.unionByName(alone.select("bucket", "rep_id").join(whole, "bucket").select("rep_id", "keep_rec_id", "copies"))
    return local.select("rec_id", "rep_id").join(totals, "rep_id")  # a representative stands for the rows of one pass at most


def format_duplicates(rows: DataFrame, rec_id: str = "rec_id", text: str = "prompt", capacity: int = CAPACITY) -> DataFrame:
    """(keep_rec_id, rec_id) for each row that repeats another in other dress; keep_rec_id is the group's smallest id.

    Rows with a null text or id join no group; empty texts are equal to each other and to texts of punctuation only.
    A row repeated with the same id counts as a copy but is no pair with itself. Other columns of ``rows`` are ignored,
    whatever their names. No rows give no rows.
    """
    return _members(rows, rec_id, text, capacity).where("keep_rec_id < rec_id").select("keep_rec_id", "rec_id").distinct()


def collapse_formats(rows: DataFrame, rec_id: str = "rec_id", text: str = "prompt", capacity: int = CAPACITY) -> DataFrame:
    """(keep_rec_id, copies): one row for each distinct text with its number of rows; nulls as in format_duplicates."""
    return _members(rows, rec_id, text, capacity).where("keep_rec_id = rec_id").select("keep_rec_id", "copies").distinct()
