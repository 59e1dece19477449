"""Pairs of texts that share many word shingles, found and measured without storing or sending the sets of shingles.

A set has eight bytes for each word of its text, several times what the text takes on disk. So every pass reads the texts and makes
the sets anew in Arrow batches; only the beginnings of the sets in a common order (prefix filter) and the texts of candidates are sent.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import WORD
from weftline.operators.scale import sized_join
from weftline.session import cut, share

#: Frequent shingles that come last in the common order, and how often one must occur among CHUNK shingles to be counted at all.
FREQUENT, LEAST, CHUNK = 100_000, 8, 2_000_000
#: Shingles that the prefixes of a pair must share, if it shares as many at all; texts of a frequent shingle for each of its blocks.
SHARED, BLOCK = 4, 20_000
#: Bits of a map of shingles and partners that one task measures for one text.
BITS, PARTNERS = 1 << 24, 500

Hot = tuple[np.ndarray, np.ndarray]


def plain(text: Column) -> Column:
    """The words of ``word_list`` with a blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD.replace("[", "[^", 1), " "))


class Words(dict):
    """64-bit hashes of words; emptied when it has grown large."""

    def __init__(self, masked: bool):
        self.masked = masked

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        form = "F" if self.masked and "_" in word else word
        self[word] = h = int.from_bytes(blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def sets_of(texts: pd.Series, n: int, masked: bool) -> tuple[list[list[str]], list[np.ndarray]]:
    """The words and the sorted distinct hashes of the n-word shingles of plain texts."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    known = sys.__dict__.setdefault("_weftline_words", {}).setdefault(masked, Words(masked))
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    starts = np.concatenate([[0], np.cumsum(counts)])
    size = max(0, len(flat) - n + 1)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + size]
        h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(32))
    h = h.view(np.int64)
    return words, [np.unique(h[s : max(s, e - n + 1)]) for s, e in zip(starts[:-1], starts[1:])]


def counted(arrays: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """(g, c) of the shingles that are frequent within a chunk; empty frames while a chunk is filled."""
    kept: list[np.ndarray] = []
    size = 0
    for a in chain(arrays, [None]):
        if a is not None:
            kept.append(a)
            size += len(a)
        if kept and (a is None or size >= CHUNK):
            g, c = np.unique(np.concatenate(kept), return_counts=True)
            kept, size = [], 0
            yield pd.DataFrame({"g": g[c >= LEAST], "c": c[c >= LEAST]})


def frequent(rows: DataFrame) -> Hot:
    """Sorted shingles and their counts, the FREQUENT most frequent of ``rows`` (g, c)."""
    top = rows.groupBy("g").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "g").limit(FREQUENT).collect()
    g, c = np.array([r.g for r in top], np.int64), np.array([r.c for r in top], np.int64)
    order = np.argsort(g)
    return g[order], c[order]


def frequent_of(docs: DataFrame, n: int, masked: bool) -> Hot:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return counted(chain.from_iterable(sets_of(b["t"], n, masked)[1] for b in batches))

    return frequent(docs.select("t").mapInPandas(count, "g bigint, c bigint"))


def digests(docs: DataFrame, n: int) -> tuple[DataFrame, Hot]:
    """(id, same), equal for equal sets and, below n words, equal words; and the frequent shingles of all texts."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []

        def sets() -> Iterator[np.ndarray]:
            for b in batches:
                words, arrays = sets_of(b["t"], n, False)
                same = [blake2b((" ".join(w) if len(w) < n else "").encode("utf-8", "surrogatepass") + b"|" + a.tobytes(), digest_size=16).digest() for w, a in zip(words, arrays)]
                out.append(pd.DataFrame({"id": b["id"], "same": same, "g": None, "c": None}))
                yield from arrays

        for found in counted(sets()):
            yield from out
            out.clear()
            yield pd.DataFrame({"id": None, "same": None, "g": found["g"], "c": found["c"]})
        yield from out

    told = cut(docs.mapInPandas(digest, f"id {dict(docs.dtypes)['id']}, same binary, g bigint, c bigint"))
    return told.where("same is not null").select("id", "same"), frequent(told.where("g is not null").select("g", "c"))


def _found(sorted_: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places of g in a sorted array, -1 where it is not there."""
    if not len(sorted_) or not len(g):
        return np.full(len(g), -1)
    at = np.minimum(np.searchsorted(sorted_, g), len(sorted_) - 1)
    return np.where(sorted_[at] == g, at, -1)


def _has(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    return (bits[(g & (BITS - 1)) >> 6] >> (g & 63).astype(np.uint64)) & np.uint64(1) == 1


def bit_map(rows: DataFrame) -> np.ndarray:
    """A map of fixed size in which the shingles of ``rows`` (g) are marked."""
    marked = rows.groupBy(F.expr(f"cast((g & {BITS - 1}) >> 6 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(g & 63 as int)))").alias("w")).collect()
    bits = np.zeros(BITS // 64, np.int64)
    bits[[r["at"] for r in marked]] = [r["w"] for r in marked]
    return bits.view(np.uint64)


def prefixes(docs: DataFrame, hot: Hot, least: float, n: int, masked: bool, side: int = 0, only: np.ndarray | None = None) -> DataFrame:
    """(g, cell, id, side, n, p, block): the first shingles of each set, rare ones by hash, frequent ones last by their counts.

    Two sets of similarity ``least`` share SHARED of these, or all that they share. p is the place in the set, n its size. A very
    frequent shingle has its texts in blocks, and one cell for each two of these, so that no task gets all its pairs.
    """
    shared = share(docs.sparkSession, (*hot, only))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, counts, marks = shared()
        near = np.zeros(1 << 22, bool)
        near[common & ((1 << 22) - 1)] = True
        for b in batches:
            arrays = sets_of(b["t"], n, masked)[1]
            whole = np.concatenate([*arrays, np.zeros(0, np.int64)])
            rank = np.full(len(whole), -1)
            maybe = np.flatnonzero(near[whole & ((1 << 22) - 1)])
            rank[maybe] = _found(common, whole[maybe])
            gs, ns, ps, rs, rows, start = [], [], [], [], [], 0
            for i, a in enumerate(arrays):
                r = rank[start : start + len(a)]
                start += len(a)
                size = min(len(a), len(a) - math.ceil(len(a) * least - 1e-9) + SHARED)
                cold = np.flatnonzero(r < 0)[:size]
                if len(cold) < size:
                    late = np.flatnonzero(r >= 0)
                    cold = np.concatenate([cold, late[np.lexsort((a[late], counts[r[late]]))][: size - len(cold)]])
                gs.append(a[cold])
                rs.append(r[cold])
                ps.append(np.arange(len(cold)))
                ns.append(np.full(len(cold), len(a)))
                rows.append(np.full(len(cold), i))
            if not gs:
                continue
            g, r, p, size, row = (np.concatenate(x) for x in (gs, rs, ps, ns, rows))
            if marks is not None:
                keep = _has(marks, g)
                g, r, p, size, row = g[keep], r[keep], p[keep], size[keep], row[keep]
            ids = b["id"].to_numpy()
            blocks = np.where(r < 0, 1, np.minimum(64, -(-counts[r] // BLOCK))) if len(counts) else np.ones(len(g), np.int64)
            one = blocks == 1
            yield pd.DataFrame({"g": g[one], "cell": 0, "id": ids[row[one]], "side": side, "n": size[one], "p": p[one], "block": -1})
            many = []
            for x in np.flatnonzero(~one):
                own = int(pd.util.hash_array(ids[row[x] : row[x] + 1])[0] % np.uint64(blocks[x]))
                many += [(g[x], min(own, j) * 64 + max(own, j), ids[row[x]], side, size[x], p[x], -1 if j == own else own) for j in range(blocks[x])]
            if many:
                yield pd.DataFrame(many, columns=["g", "cell", "id", "side", "n", "p", "block"])

    return docs.select("id", "t").mapInPandas(first, f"g bigint, cell int, id {dict(docs.dtypes)['id']}, side int, n int, p int, block int")


def candidates(firsts: DataFrame, least: float, cross: bool) -> DataFrame:
    """(a, b): pairs whose prefixes share enough and whose sizes and places do not rule ``least`` out; a < b, or across sides a of side 0."""

    def pairs(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, side, n, p, block = (x[c].to_numpy() for c in ("id", "side", "n", "p", "block"))
        run = np.cumsum(np.concatenate([[0], (np.diff(x["g"].to_numpy()) != 0) | (np.diff(x["cell"].to_numpy()) != 0)]))
        i, d, out, rows = np.arange(len(x)), 0, [], 0
        while True:
            d += 1
            i = i[i + d < len(x)]
            i = i[(run[i + d] == run[i]) & (n[i] >= n[i + d] * least - 1e-9)]  # sizes ascend within a run
            if out and (not len(i) or rows > 200_000):
                a, b, need = (np.concatenate(c) for c in zip(*out))
                yield pd.DataFrame({"a": a, "b": b, "need": need})
                out, rows = [], 0
            if not len(i):
                return
            u, v = i, i + d
            bound = np.minimum(p[u], p[v]) + 1 + np.minimum(n[u] - p[u], n[v] - p[v]) - 1
            ok = (bound >= least / (1 + least) * (n[u] + n[v]) - 1e-6) & ((block[u] < 0) | (block[u] != block[v]))
            ok &= (side[u] != side[v]) if cross else (ids[u] != ids[v])
            u, v = u[ok], v[ok]
            if len(u):
                turn = side[u] > side[v] if cross else ids[u] > ids[v]
                out.append((ids[np.where(turn, v, u)], ids[np.where(turn, u, v)], np.maximum(1, np.minimum(SHARED, np.ceil(n[v] * least - 1e-9))).astype("int32")))
                rows += len(u)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            kept.append(b)
            rows += len(b)
            g, cell = b["g"].to_numpy(), b["cell"].to_numpy()
            if rows < 100_000 or (g[0] == g[-1] and cell[0] == cell[-1]):
                continue
            last = int(np.flatnonzero((g == g[-1]) & (cell == cell[-1]))[0])  # the last run may go on
            yield from pairs(pd.concat([*kept[:-1], b.iloc[:last]], ignore_index=True))
            kept, rows = [b.iloc[last:]], len(b) - last
        if kept:
            yield from pairs(pd.concat(kept, ignore_index=True))

    kind = dict(firsts.dtypes)["id"]
    met = firsts.repartition("g", "cell").sortWithinPartitions("g", "cell", "n").mapInPandas(meet, f"a {kind}, b {kind}, need int")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c"), F.max("need").alias("_need")).where("_c >= _need").select("a", "b")


def measured(docs: DataFrame, pairs: DataFrame, n: int, masked: bool) -> DataFrame:
    """(a, b, jaccard) of pairs of ``docs`` (id, t); each text goes once to every text that it is compared with. ``pairs`` should be cut."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("_parts"))
    others = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("part"), F.lit(1).alias("turn"))
    own = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("turn"))
    wanted = cut(others.unionByName(own))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(0, np.int64)
        for b in batches:
            out = []
            for a, other, turn, s in zip(b["a"], b["id"], b["turn"], sets_of(b["t"], n, masked)[1]):
                if turn == 0:
                    mine = s
                else:
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    out.append((a, other, both / max(1, len(mine) + len(s) - both)))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "jaccard"])

    kind = dict(docs.dtypes)["id"]
    met = sized_join(docs.select("id", "t"), wanted, ["id"]).repartition("a", "part").sortWithinPartitions("a", "part", "turn")
    return met.mapInPandas(compare, f"a {kind}, b {kind}, jaccard double")


def with_shared(texts: DataFrame, references: DataFrame, hot: Hot, n: int, masked: bool) -> int:
    """How many texts share a shingle with any reference: most by a frequent one, the rest by looking their shingles up."""
    shared = share(texts.sparkSession, hot[0])
    kind = dict(texts.dtypes)["id"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared()
        for b in batches:
            arrays = sets_of(b["t"], n, masked)[1]
            known = np.array([(_found(common, a) >= 0).any() for a in arrays], bool)
            yield pd.DataFrame({"id": b["id"][known], "g": None})
            for i, a, sure in zip(b["id"], arrays, known):
                if not sure and len(a):
                    yield pd.DataFrame({"id": i, "g": a})

    told = cut(texts.select("id", "t").mapInPandas(look, f"id {kind}, g bigint"))
    open_ = told.where("g is not null")
    sure = told.where("g is null").select("id").distinct().count()
    if open_.isEmpty():
        return sure
    marks = share(texts.sparkSession, bit_map(open_))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = marks()
        for b in batches:
            g = np.concatenate([*sets_of(b["t"], n, masked)[1], np.zeros(0, np.int64)])
            yield pd.DataFrame({"g": np.unique(g[_has(bits, g)])})

    there = references.select("t").mapInPandas(marked, "g bigint").distinct()
    return sure + open_.join(there, "g", "left_semi").select("id").distinct().count()
