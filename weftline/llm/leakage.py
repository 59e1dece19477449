"""Problem 7: evaluation texts leaking into training text, by latent semantic retrieval.

The held-out items are the stated query set; they come in blocks of bounded size. Documents are cut into overlapping
passages of LENGTH words. A passage with too few words known to any item of the block cannot hold a leak and is left out;
frequencies are counted over all documents all the same. A randomised SVD of the TF-IDF passages, summed over all tasks,
gives the latent space; item passages within a cosine of COSINE are candidates, of which exact comparison keeps runs of
equal words, and the longest common subsequence keeps paraphrases. Runs between passages of a lesser cosine are looked up
by their hashes, so that the threshold loses none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import array_sums
from weftline.session import cut, share, widen

#: Words that a document and an item must have in common, one after the other. Fixed by the task.
RUN = 12
#: Words of a passage and step between passages: LENGTH - STEP + 1 >= RUN, so each run lies within some passage.
LENGTH, STEP = 16, 4
#: Latent dimensions, further columns of the random sketch, and the least cosine of a candidate.
RANK, OVERSAMPLE, COSINE = 64, 16, 0.5
#: Least cosine and least share of a passage's words in common order for a paraphrase.
PARAPHRASE_COSINE, PARAPHRASE_SHARE = 0.8, 0.8
#: Characters of item text in a block; it bounds the vocabulary and so what is broadcast, some dozens of megabytes.
BLOCK_CHARS = 1_000_000
#: Document passages and item passages that are compared at once.
ROWS, TILE = 512, 4096
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passages(ids: np.ndarray) -> np.ndarray:
    """Windows of LENGTH ids, STEP apart, the last one flush with the end; a shorter text is one window padded with -1."""
    n = len(ids)
    if n < LENGTH:
        return np.concatenate([ids, np.full(LENGTH - n, -1, np.int32)])[None, :].astype(np.int32)
    starts = np.arange(0, n - LENGTH + 1, STEP)
    if starts[-1] != n - LENGTH:
        starts = np.append(starts, n - LENGTH)
    return np.lib.stride_tricks.sliding_window_view(ids, LENGTH)[starts]


def run_hashes(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of RUN ids in each window; runs with an unknown word get distinct odd values."""
    mixed = (windows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros((len(windows), LENGTH - RUN + 1), np.uint64)
    for k in range(LENGTH - RUN + 1):
        for i in range(k, k + RUN):
            out[:, k] = out[:, k] * np.uint64(0x100000001B3) + mixed[:, i]
    return out


class Block:
    """The passages of some items with their vocabulary; plain arrays, so that it can be shipped to tasks."""

    def __init__(self, items: list[tuple[int, int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        windows, owners, parts = [], [], []
        for item, part, text in items:
            found = words(text)
            if len(found) < RUN:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int32)
            windows.append(passages(ids))
            owners += [item] * len(windows[-1])
            parts += [part] * len(windows[-1])
        self.windows = np.concatenate(windows) if windows else np.zeros((0, LENGTH), np.int32)
        self.owners, self.parts = np.array(owners, np.int64), np.array(parts, np.int8)
        self.idf = np.ones(len(self.vocabulary), np.float32)
        self.unknown = 1.0
        self.basis = np.zeros((len(self.vocabulary), 0), np.float32)

    def weigh(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, unit TF-IDF rows over these words); unknown words count in the length only.

        The words are those of ``windows``, so the rows stay small whatever the vocabulary.
        """
        used, at = np.unique(np.where(windows >= 0, windows, 0), return_inverse=True)
        rows = np.zeros((len(windows), len(used)), np.float32)
        r, c = np.nonzero(windows >= 0)
        np.add.at(rows, (r, at.reshape(windows.shape)[r, c]), 1)
        rows *= self.idf[used]
        lengths = np.sqrt((rows**2).sum(1) + (windows < 0).sum(1) * self.unknown**2)
        return used, rows / np.maximum(lengths, 1e-9)[:, None]

    def latent(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), self.basis.shape[1]), np.float32)
        for n in range(0, len(windows), ROWS):
            used, rows = self.weigh(windows[n : n + ROWS])
            out[n : n + ROWS] = rows @ self.basis[used]
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def _read(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["w"]), np.int32).reshape(-1, LENGTH)


def _passage_table(documents: DataFrame, block: Block) -> DataFrame:
    """(doc_id, w) of passages with RUN known words or more; rows with a null doc_id carry pieces of a task's document frequencies."""
    vocabulary = block.vocabulary

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(vocabulary) + 1, np.int64)  # the last is the number of documents
        for batch in batches:
            ids_out, w_out = [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([vocabulary.get(w, -1) for w in words(text)], np.int32)
                counts[-1] += 1
                known = ids >= 0
                if not known.any():
                    continue
                counts[np.unique(ids[known])] += 1
                windows = passages(ids)
                for w in windows[(windows >= 0).sum(1) >= RUN]:
                    ids_out.append(doc)
                    w_out.append(w.tobytes())
            yield pd.DataFrame({"doc_id": pd.array(ids_out, "Int64"), "w": w_out, "part": pd.array([None] * len(w_out), "Int32")})
        told = array_sums.pieces(counts)
        yield pd.DataFrame({"doc_id": pd.array([None] * len(told), "Int64"), "w": told["w"], "part": told["part"].astype("Int32")})

    return cut(widen(documents).mapInPandas(cut_up, "doc_id bigint, w binary, part int"))


def _fit(block: Block, table: DataFrame) -> Block:
    """Latent basis of the passages of all documents and items: two passes of a randomised SVD with one power step."""
    size, width = len(block.vocabulary), min(RANK + OVERSAMPLE, len(block.vocabulary))
    spark = table.sparkSession

    def through(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = share(spark, (block, q))

        def add(own: Block, side: np.ndarray, windows: np.ndarray, acc: np.ndarray) -> None:
            for at in range(0, len(windows), ROWS):
                used, rows = own.weigh(windows[at : at + ROWS])
                seen = rows @ side[used]
                if gram:
                    acc += seen.T @ seen
                else:
                    acc[used] += rows.T @ seen

        def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, side = shared()
            acc = np.zeros((width, width) if gram else (size, width), np.float64)
            for batch in batches:
                add(own, side, _read(batch), acc)
            yield array_sums.pieces(acc)

        acc = array_sums.total(table.select("w").mapInPandas(accumulate, array_sums.SCHEMA), "float64", width * (width if gram else size)).reshape(-1, width)
        add(block, q, block.windows, acc)
        return acc

    q = np.random.default_rng(0).standard_normal((size, width)).astype(np.float32)
    for _ in range(2):
        q = np.linalg.qr(through(q, False))[0].astype(np.float32)
    _, vectors = np.linalg.eigh(through(q, True))
    block.basis = (q @ vectors[:, ::-1][:, :RANK]).astype(np.float32)
    return block


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; negative ids match nothing."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for y in b:
        if y >= 0 and (m := where.get(y)):
            x = m | row
            row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def _search(table: DataFrame, block: Block, paraphrases: bool, cosine: float, rest: bool) -> DataFrame:
    shared = share(table.sparkSession, block)
    least = math.ceil(PARAPHRASE_SHARE * LENGTH)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared()
        queries, hashes = own.latent(own.windows), run_hashes(own.windows)
        order = np.argsort(hashes.ravel(), kind="stable")
        ordered = hashes.ravel()[order]

        def by_hash(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of passages, without regard to their cosine, that have the hash of a run in common."""
            low, high = np.searchsorted(ordered, mine.ravel(), "left"), np.searchsorted(ordered, mine.ravel(), "right")
            hit = np.flatnonzero(high > low)
            i = np.repeat(hit // mine.shape[1], high[hit] - low[hit])
            j = np.concatenate([order[low[h] : high[h]] // hashes.shape[1] for h in hit]) if len(hit) else np.zeros(0, np.int64)
            return i, j

        for batch in batches:
            windows, docs, out = _read(batch), batch["doc_id"].to_numpy(np.int64), {}
            for at in range(0, len(windows), ROWS):
                some = windows[at : at + ROWS]
                seen, mine = own.latent(some), run_hashes(some)

                def keep(i: np.ndarray, j: np.ndarray) -> None:
                    for x, y in zip(i, j):
                        key = (int(docs[at + x]), int(own.owners[y]), int(own.parts[y]))  # noqa: B023
                        if key not in out and _share_run(some[x], own.windows[y]):  # noqa: B023
                            out[key] = RUN  # noqa: B023

                for n in range(0, len(queries), TILE):
                    i, j = np.nonzero(seen @ queries[n : n + TILE].T >= cosine)
                    j = j + n
                    if not paraphrases:
                        hit = np.zeros(len(i), bool)
                        for a in range(mine.shape[1]):
                            left = mine[i, a]
                            for b in range(hashes.shape[1]):
                                hit |= left == hashes[j, b]
                        keep(i[hit], j[hit])
                        continue
                    common = np.zeros(len(i), np.int16)
                    for a in range(LENGTH):
                        one = some[i, a]
                        common += ((own.windows[j] == one[:, None]).any(1) & (one >= 0)).astype(np.int16)
                    for x, y in zip(i[common >= least], j[common >= least]):
                        other = own.windows[y]
                        k = common_subsequence(some[x].tolist(), other.tolist())
                        known = own.idf[other[other >= 0]]
                        if k >= least and own.idf[other[(other >= 0) & np.isin(other, some[x])]].sum() >= PARAPHRASE_SHARE * known.sum():
                            key = (int(docs[at + x]), int(own.owners[y]), int(own.parts[y]))
                            out[key] = max(k, out.get(key, 0))
                if rest and not paraphrases:
                    keep(*by_hash(mine))
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["doc_id", "item_id", "part", "common"])

    return table.mapInPandas(look, "doc_id bigint, item_id bigint, part int, common int")


def _share_run(a: np.ndarray, b: np.ndarray) -> bool:
    runs = {tuple(b[k : k + RUN]) for k in range(LENGTH - RUN + 1) if (b[k : k + RUN] >= 0).all()}
    return any(tuple(a[k : k + RUN]) in runs for k in range(LENGTH - RUN + 1))


def _matches(documents: DataFrame, suite: DataFrame, paraphrases: bool, cosine: float, rest: bool = False) -> DataFrame:
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = suite.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("prompt").alias("text")), F.struct(F.lit(1).alias("part"), F.col("rubric").alias("text")))).alias("p")).select("item_id", "p.part", "p.text").where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    found: DataFrame | None = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == b).collect()
        block = Block([(r["item_id"], r["part"], r["text"]) for r in mine])
        if not len(block.windows):
            continue
        table = _passage_table(documents, block)
        counts = array_sums.total(table.where("doc_id is null").select("part", "w"), "int64", len(block.vocabulary) + 1)
        block.idf = (np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1).astype(np.float32)
        block.unknown = float(block.idf.mean())
        hits = _search(table.where("doc_id is not null"), _fit(block, table.where("doc_id is not null")), paraphrases, cosine, rest)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, part int, common int")
    return found


def leaked_tests(documents: DataFrame, suite: DataFrame, cosine: float = COSINE, rest: bool = True) -> DataFrame:
    """(doc_id, item_id): the document has RUN consecutive words in common with the item's prompt or rubric.

    Passages within ``cosine`` in the latent space are compared; with ``rest`` runs between other passages are looked up too, so
    that the result is exact. A word is a run of letters, digits and underscores in lower case. Null texts, null ids and texts of
    fewer than RUN words match nothing; repeated rows give the same pair once; empty tables give no rows. Other columns
    are ignored.
    """
    return _matches(documents, suite, False, cosine, rest).select("doc_id", "item_id").distinct()


def paraphrased_tests(documents: DataFrame, suite: DataFrame, cosine: float = PARAPHRASE_COSINE) -> DataFrame:
    """(doc_id, item_id, common_words, answer_leaked): passages that keep most words of an item's passage in their order.

    common_words is the longest common subsequence of two passages of LENGTH words, PARAPHRASE_SHARE of them at least; so is
    their share by inverse document frequency, so that passages which only follow the same pattern do not count. Passages below
    ``cosine`` in the latent space are not compared; -1 compares all. answer_leaked tells whether a passage of the rubric is
    among them. Items of fewer than RUN words have no passage that could keep enough words, and give nothing. Nulls as in
    leaked_tests.
    """
    return _matches(documents, suite, True, cosine).groupBy("doc_id", "item_id").agg(F.max("common").alias("common_words"), F.max("part").cast("boolean").alias("answer_leaked"))
