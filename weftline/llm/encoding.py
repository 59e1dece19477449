"""Problem 8: text decoded with the wrong character encoding, found and repaired by expectation-maximization.

A latent chain of encodings stands behind every segment (a sentence or line with characters beyond ASCII): none, text of
one encoding read as another, the same twice, or a reading that lost characters. Undoing a chain gives the text
it would have come from, whose likelihood is that of a character trigram model. The E-step weighs chains by likelihood and
by the share each has in the segment's source and field; the M-step re-estimates these shares, drawn towards those of
all sources, and the trigram counts, in which garbled segments count with their repaired text. Evidence too weak in one record
so gains from other records of its source. The first counts leave out what UTF-8 can have given and
damp copies, so that those of a garbled text do not pass for language; each round looks at all segments anew.

A verdict depends only on a segment's words beyond ASCII with two characters on either side, its core. Segments are grouped by
core, so each different core is judged once a round, and weighted by the numbers of its segments in each source.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import array_sums
from weftline.operators.scale import salted_join, sized_join
from weftline.session import cut, share, spread, widen

#: Encodings that texts were written in and encodings that they were wrongly read with. Fixed values.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "cp852", "cp437")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859-2", "iso8859-15", "cp1254")
#: Chain numbers: 0 is none, 1 is lost characters, then the pairs, then the pairs of UTF-8 applied twice.
CHAINS = ("none", "lost", *(f"{a}>{b}" for b in READ for a in WRITTEN if a != b), *(f"utf-8>{b}>utf-8>{b}" for b in READ))
#: Rounds of expectation-maximization, strength of the pull towards all sources' shares, share of 'none' at the start.
ROUNDS, PULL, CLEAN = 3, 20.0, 0.5
#: Hashed counts of the trigram model: sizes are fixed whatever the corpus.
SIZES = (1 << 17, 1 << 16, 1 << 16, 1 << 14, 1 << 14)
#: Weight of the shorter context, as a share of all places counted and at the least. The large share at first keeps
#: garbled wordings that recur from passing for language; later rounds have moved them to their repaired text.
BACKOFF, LEAST_BACKOFF, COOLING = 2e-4, 1.5, 10.0
#: A segment stays under suspicion if some chain's log-likelihood comes within this of the text's own.
MARGIN = 1.0
#: A chain between one-byte encodings is tried unless its characters are rarer than the text's own by this, in logarithms.
RARER = 3.0
#: Chains less likely than the best by this, in logarithms, at the first look are not followed in later rounds.
KEEP = 25.0
#: What a run of words must gain, in logarithms, to be undone without the rest of its segment.
PART = 6.0
_SPLIT = re.compile(r"\n+|(?<=[.!?]) +")
_SPLIT_KEPT = re.compile(r"(\n+|(?<=[.!?]) +)")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_LONE = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")
_RUNS = re.compile(r"[^\x00-\x7f]+")
_WORDS = re.compile(r"\w+")
_DIGITS = re.compile("[0-9]")
_QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "„": "“", "«": "»", "‘": "’"}
LOST = "�"


def _tables() -> dict[str, tuple[dict[int, int], frozenset[str]]]:
    """For each reading: characters to bytes, undefined bytes standing for themselves, and the characters beyond ASCII."""
    kept = sys.__dict__.setdefault("_weftline_readings", {})
    if not kept:
        for name in READ:
            back: dict[str, int] = {}
            for i in range(128, 256):
                try:
                    c = bytes([i]).decode(name)
                except UnicodeDecodeError:
                    c = chr(i)
                back.setdefault(c, i)
            kept[name] = ({ord(c): i for c, i in back.items()}, frozenset(back))
    return kept


def undo(text: str, written: str, read: str) -> str | None:
    """The text that, written in one encoding and read in the other, gives ``text``; None if there is none."""
    table, chars = _tables()[read]
    if not chars.issuperset(_BEYOND.findall(text)):
        return None
    try:
        return text.translate(table).encode("latin-1").decode(written)
    except UnicodeDecodeError:
        return None


def _plausible(text: str) -> bool:
    return not any("\x7f" <= c <= "\x9f" for c in text)


def _letterwise(chars: str, model: Trigrams | None) -> list[tuple[int, dict[int, str]]]:
    """Chains between one-byte encodings that could have given ``chars``, each with what it makes of them.

    With a model, chains that would turn common characters into much rarer ones are left out.
    """
    out = []
    own = model.commonness(chars) if model else 0.0
    number = 1
    for read in READ:
        table, possible = _tables()[read]
        for written in WRITTEN:
            if written == read:
                continue
            number += 1
            if written == "utf-8" or not possible.issuperset(chars):
                continue
            try:
                back = bytes(table[ord(c)] for c in chars).decode(written)
            except UnicodeDecodeError:
                continue
            if back != chars and _plausible(back) and (model is None or model.commonness(back) >= own - RARER):
                out.append((number, dict(zip(map(ord, chars), back))))
    return out


def candidates(text: str, model: Trigrams | None = None) -> dict[str, list[int]]:
    """Texts that ``text`` may have come from, each with its chains; the text itself with 'none' is always among them."""
    if LOST in text:
        return {text: [1]}
    out = {text: [0]}
    chars = "".join(sorted(set(_BEYOND.findall(text))))
    if model is None:
        maps = _letterwise(chars, None)
    elif (maps := model.maps.get(chars)) is None:
        maps = _letterwise(chars, model)
        if len(model.maps) < 100_000:  # a memory, not a limit
            model.maps[chars] = maps
    for number, table in maps:
        out.setdefault(text.translate(table), []).append(number)
    if not _LONE.search(text):  # each character that UTF-8 writes beyond ASCII takes two bytes or more
        for i, read in enumerate(READ):
            back = undo(text, "utf-8", read)
            if back is None or back == text:
                continue
            if _plausible(back):
                out.setdefault(back, []).append(CHAINS.index(f"utf-8>{read}"))
            if not _LONE.search(back) and (again := undo(back, "utf-8", read)) and again != back and _plausible(again):
                out.setdefault(again, []).append(len(CHAINS) - len(READ) + i)
    return out


def quoted_only(text: str) -> bool:
    """Each run of characters beyond ASCII is itself put between quotes, as an example of such characters."""
    runs = list(_RUNS.finditer(text))
    for m in runs:
        run, before, after = m.group(), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        inner = len(run) > 2 and _QUOTES.get(run[0]) == run[-1]
        if not inner and not (before and _QUOTES.get(before) == after):
            return False
    return bool(runs)


class Trigrams:
    """Hashed counts of characters in context, over the places where one of three characters is beyond ASCII."""

    def __init__(self, counts: np.ndarray, turn: int, corpus: float = 0.0) -> None:
        """``corpus`` is the number of places that the weight of the shorter context goes by, if not that of ``counts``."""
        self.parts = np.split(counts, np.cumsum(SIZES)[:-1])
        self.places = max(1.0, float(self.parts[4].sum()))
        self.backoff = max(LEAST_BACKOFF, BACKOFF * max(corpus, self.places) / COOLING**turn)
        self.maps: dict[str, list[tuple[int, dict[int, str]]]] = {}
        self.words: dict[str, dict[int, tuple[str, float]]] = {}
        self.passing: dict[tuple[str, int], tuple[str, float]] = {}

    def commonness(self, chars: str) -> float:
        slots = (_fold((np.fromiter(map(ord, chars), np.uint64, len(chars)),)) % np.uint64(SIZES[4])).astype(np.int64)
        return float(np.log((self.parts[4][slots] + 0.05) / self.places).mean()) if len(slots) else 0.0

    def knows(self, text: str) -> bool:
        chars = _BEYOND.findall(text)
        return bool((self.parts[4][(_fold((np.fromiter(map(ord, chars), np.uint64, len(chars)),)) % np.uint64(SIZES[4])).astype(np.int64)] >= 1).all())

    @staticmethod
    def slots(texts: list[str]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The slots of all places of several texts, and the number of the text that each place belongs to."""
        codes = np.frombuffer(("\n\n" + "\n\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes = np.where((codes >= 48) & (codes <= 57), 48, codes).astype(np.uint64)
        beyond = codes > 127
        at = np.flatnonzero(beyond[:-2] | beyond[1:-1] | beyond[2:])
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])[:-1]])
        owner = np.searchsorted(starts, at, "right") - 1
        a, b, c = codes[at], codes[at + 1], codes[at + 2]
        ab = _fold((a, b))
        return tuple((h % np.uint64(n)).astype(np.int64) for h, n in zip((_fold_on(ab, c), ab, _fold((b, c)), _fold((b,)), _fold((c,))), SIZES)), owner

    def logliks(self, texts: list[str]) -> np.ndarray:
        slots, owner = self.slots(texts)
        t3, c3, t2, c2, t1 = (part[slot] for part, slot in zip(self.parts, slots))
        # A place counts in all five tables, so a count above that of a part of it comes from another one in its slot.
        t2 = np.minimum(t2, np.minimum(c2, t1))
        t3 = np.minimum(t3, np.minimum(c3, t2))
        p1 = (t1 + 0.05) / (self.places + 0.05 * 65536)
        p2 = (t2 + self.backoff * p1) / (c2 + self.backoff)
        return np.bincount(owner, np.log((t3 + self.backoff * p2) / (c3 + self.backoff)), len(texts))

    def loglik(self, text: str) -> float:
        return float(self.logliks([text])[0])


def _fold_on(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _fold(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    for x in columns:
        h = _fold_on(h, x)
    return h


_OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])


def _tally(counts: np.ndarray, texts: list[str], weights: list[float]) -> None:
    """Adds each text's places with its weight."""
    for n in range(0, len(texts), 256):
        slots, owner = Trigrams.slots(texts[n : n + 256])
        weight = np.asarray(weights[n : n + 256], float)[owner]
        for offset, slot, size in zip(_OFFSETS, slots, SIZES):
            counts[offset : offset + size] += np.bincount(slot, weight, size) if len(slot) > size // 8 else _scattered(slot, weight, size)


def _scattered(slot: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size)
    np.add.at(out, slot, weight)
    return out


def segments(text: str) -> list[str]:
    """Sentences and lines in order; splitting the text by them loses no character but line ends and blanks between."""
    return [s for s in _SPLIT.split(text) if s]


def core(segment: str) -> str:
    """All that a verdict on the segment depends on: its words beyond ASCII, neighbouring ones together, with two characters on either side.

    The n-th word beyond ASCII of the core is that of the segment; digits are equal.
    """
    text = _DIGITS.sub("0", segment)
    pieces, at, start, end = [], 0, -1, 0
    for word in text.split(" "):
        if not word.isascii():
            start, end = (at if start < 0 else start), at + len(word)
        elif start >= 0:
            pieces.append(text[max(0, start - 2) : end + 2])
            start = -1
        at += len(word) + 1
    if start >= 0:
        pieces.append(text[max(0, start - 2) : end + 2])
    return " \n ".join(pieces)


def _gains(word: str, model: Trigrams) -> dict[int, tuple[str, float]]:
    """For each chain that can be undone in the word alone: the word it came from and what that gains in log-likelihood."""
    known = model.words.get(word)
    if known is None:
        known = {}
        if not quoted_only(word):
            found = [(t, chains) for t, chains in candidates(word, model).items() if t != word]
            if found:
                own, *logs = model.logliks([f" {word} ", *(f" {t} " for t, _ in found)])
                for (text, chains), log in zip(found, logs):
                    known.update((c, (text, float(log - own))) for c in chains)
        if len(model.words) < 200_000:  # a memory, not a limit
            model.words[word] = known
    return known


def _passing(word: str, chain: int, model: Trigrams) -> tuple[str, float]:
    """What a chain between one-byte encodings that no one would try on the word alone, as it may leave it as it is, makes of it."""
    if (known := model.passing.get((word, chain))) is None:
        known = _passed(word, chain, model)
        if len(model.passing) < 500_000:  # a memory, not a limit
            model.passing[(word, chain)] = known
    return known


def _passed(word: str, chain: int, model: Trigrams) -> tuple[str, float]:
    written, read, *more = CHAINS[chain].split(">")
    text = None if more or written == "utf-8" else undo(word, written, read)
    if text is None or not _plausible(text):
        return word, -np.inf
    if text == word:
        return text, 0.0
    own, log = model.logliks([f" {word} ", f" {text} "])
    return text, float(log - own)


def _in_part(segment: str, model: Trigrams) -> dict[str, tuple[list[int], list[int]]]:
    """The segment with its best run of words undone, with the chains that give it and the numbers of these words among
    those beyond ASCII, for each chain that gains by some of its words but not by all."""
    words = segment.split(" ")
    beyond = [i for i, w in enumerate(words) if not w.isascii()]
    if len(beyond) < 2 or LOST in segment or quoted_only(segment):
        return {}
    options = {i: dict(_gains(words[i], model)) for i in beyond}
    around, examples = set(_WORDS.findall(segment)), {i for i in beyond if quoted_only(words[i])}
    for i, o in options.items():
        if any(CHAINS[c].startswith("utf-8") and sum(map(str.isalpha, t)) < 3 and around.issuperset(_WORDS.findall(t) or [""]) for c, (t, _) in o.items()):
            options[i] = {}
            examples.add(i)  # "Ã© instead of é" tells of such characters
    out: dict[str, tuple[list[int], list[int]]] = {}
    for chain in sorted({c for o in options.values() for c, (_, gain) in o.items() if gain > 0}):
        total, run = 0.0, []
        best: tuple[float, list[int]] = (0.0, [])
        for i in beyond:
            if i not in examples and chain not in options[i]:
                options[i][chain] = _passing(words[i], chain, model)
            gain = options[i].get(chain, (words[i], -np.inf))[1]
            total, run = (total + gain, [*run, i]) if total > 0 else (gain, [i])
            if total > best[0]:
                best = (total, run)
            if total <= 0:
                total, run = 0.0, []
        chosen = {i: options[i][chain][0] for i in best[1]}
        if best[0] > PART and len(chosen) < len(beyond):
            text = " ".join(chosen.get(i, w) for i, w in enumerate(words))
            out.setdefault(text, ([], [beyond.index(i) for i in best[1]]))[0].append(chain)
    return out


def repaired(segment: str, chain: str, numbers: list[int]) -> str | None:
    """The segment with a chain undone, in all of it or only in its words beyond ASCII of these numbers; None if characters are lost."""
    if chain in ("none", "lost"):
        return segment if chain == "none" else None
    written, read, *more = chain.split(">")

    def back(text: str) -> str:
        for _ in range(2 if more else 1):
            text = undo(text, written, read) or text
        return text

    if not numbers:
        return back(segment)
    words, beyond = segment.split(" "), -1
    for i, word in enumerate(words):
        if not word.isascii():
            beyond += 1
            words[i] = back(word) if beyond in numbers else word
    return " ".join(words)


def _posterior(logs: np.ndarray, kinds: list[list[int]], shares: np.ndarray) -> np.ndarray:
    at = np.asarray(logs, float) + np.log([shares[k].sum() for k in kinds])
    p = np.exp(at - at.max())
    return p / p.sum()


def _start() -> np.ndarray:
    shares = np.full(len(CHAINS), (1 - CLEAN) / (len(CHAINS) - 1))
    shares[0] = CLEAN
    return shares


def _shares(row_chains: list[int] | None, row_masses: list[float] | None, everywhere: np.ndarray) -> np.ndarray:
    out = PULL * everywhere
    if row_chains is not None and len(row_chains):
        np.add.at(out, np.asarray(row_chains, np.int64), np.asarray(row_masses, np.float64))
    return out / out.sum()


def _cores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, seg, core, h) of all segments beyond ASCII; h tells different segments of one core apart."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
                if not text.isascii():
                    out += [(doc, source, n, core(s), _DIGITS.sub("0", s)) for n, s in enumerate(segments(text)) if not s.isascii()]
            yield pd.DataFrame(out, columns=["doc_id", "source", "seg", "core", "text"])

    found = documents.mapInPandas(split, "doc_id bigint, source string, seg bigint, core string, text string")
    return cut(found.withColumn("h", F.xxhash64("text")).drop("text"))


def _counted(cores: DataFrame, column: str, keep=None) -> np.ndarray:
    """Trigram counts of different cores, each with the weight in ``column``; ``keep`` makes a test for the cores that count."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, wanted = np.zeros(sum(SIZES)), keep() if keep else None
        for batch in batches:
            rows = [(t, w) for t, w in zip(batch["core"], batch["w"]) if wanted is None or wanted(t)]
            _tally(counts, [t for t, _ in rows], [w for _, w in rows])
        yield array_sums.pieces(counts)

    return array_sums.total(cores.select("core", F.col(column).cast("double").alias("w")).mapInPandas(tally, array_sums.SCHEMA), "float64", sum(SIZES))


def _undoable(segment: str, model: Trigrams, known: dict[str, bool]) -> bool:
    """Some run of characters beyond ASCII can have come from characters of the corpus by UTF-8; ``known`` remembers runs."""
    for run in _RUNS.findall(segment):
        if len(run) > 1 and run not in known:
            if len(known) >= 100_000:  # a memory, not a limit
                known.clear()
            known[run] = any((back := undo(run, "utf-8", read)) and _plausible(back) and model.knows(back) for read in READ)
        if len(run) > 1 and known[run]:
            return True
    return False


def _doubtful(text: str, model: Trigrams) -> tuple[list[str], list[list[int]], list[list[int]], list[float]] | None:
    """Candidates worth following with their chains, word numbers and log-likelihoods; None if no chain comes near the text as it is."""
    if quoted_only(text):
        return None
    if LOST in text:
        return [text], [[1]], [[]], [0.0]
    found = {t: (chains, []) for t, chains in candidates(text, model).items()}
    for t, told in _in_part(text, model).items():
        found.setdefault(t, told)
    if len(found) == 1:
        return None
    texts = list(found)  # the text itself comes first
    logs = model.logliks(texts)
    best = logs[1:].max()
    if best < logs[0] - MARGIN:
        return None
    kept = [n for n in range(len(texts)) if n == 0 or logs[n] >= best - KEEP]
    return [texts[n] for n in kept], [found[texts[n]][0] for n in kept], [found[texts[n]][1] for n in kept], [float(logs[n]) for n in kept]


_SUSPECT = "core string, texts array<string>, kinds array<array<int>>, numbers array<array<int>>, logs array<double>"


def _suspects(cores: DataFrame, counts: np.ndarray, turn: int, corpus: float) -> DataFrame:
    """Candidates of the different cores that are in doubt."""
    shared = share(cores.sparkSession, counts)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Trigrams(shared(), turn, corpus)
        for batch in batches:
            out = [(t, *v) for t in batch["core"] if (v := _doubtful(t, model)) is not None]
            yield pd.DataFrame(out, columns=["core", "texts", "kinds", "numbers", "logs"])

    return cut(cores.select("core").mapInPandas(look, _SUSPECT))


def _in_sources(suspects: DataFrame, places: DataFrame, masses: DataFrame | None) -> DataFrame:
    """Suspects in each source that has them, with the number of segments and what is known of the source's chains."""
    met = sized_join(places, suspects, ["core"], "inner", F.xxhash64("source"), small=False)
    if masses is None:
        return met.withColumns({"chains": F.array().cast("array<int>"), "masses": F.array().cast("array<double>")})
    told = masses.groupBy("source").agg(F.collect_list(F.struct("chain", "mass")).alias("m")).select("source", F.col("m.chain").alias("chains"), F.col("m.mass").alias("masses"))
    return salted_join(met, told, ["source"], "left", F.xxhash64("core"))


def _round(met: DataFrame, everywhere: np.ndarray) -> DataFrame:
    """Expected chain masses by source (chain >= 0) and pieces of the changes of the trigram counts of one E-step."""
    shared = share(met.sparkSession, everywhere)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        overall, change, sums, moved = shared(), np.zeros(sum(SIZES)), {}, {}
        for batch in batches:
            for source, n, texts, kinds, logs, chains, masses in zip(*(batch[c] for c in ("source", "n", "texts", "kinds", "logs", "chains", "masses"))):
                kinds = [list(k) for k in kinds]
                for t, kind, weight in zip(texts, kinds, _posterior(logs, kinds, _shares(chains, masses, overall))):
                    if weight < 1e-3:
                        continue
                    sums[(source, kind[0])] = sums.get((source, kind[0]), 0.0) + float(weight) * n
                    if kind == [1] or t != texts[0]:
                        moved[texts[0]] = moved.get(texts[0], 0.0) - float(weight) * n
                        if t != texts[0]:
                            moved[t] = moved.get(t, 0.0) + float(weight) * n
            if len(moved) > 10_000:
                _tally(change, list(moved), list(moved.values()))
                moved = {}
        _tally(change, list(moved), list(moved.values()))
        told = array_sums.pieces(change)
        rows = [(*k, m, None, None) for k, m in sums.items()] + [(None, -1, 0.0, p, w) for p, w in zip(told["part"], told["w"])]
        yield pd.DataFrame(rows, columns=["source", "chain", "mass", "part", "w"]).astype({"part": "Int32"})

    return cut(spread(met, "core", "source").mapInPandas(expect, "source string, chain int, mass double, part int, w binary"))


def _learn(found: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Suspects in each source with the source's chains, and shares over all sources, after the last round."""
    places = cut(found.groupBy("core", "source").agg(F.count(F.lit(1)).alias("n")))
    # n copies of a segment count as the root of n at the start.
    cores = cut(spread(found.groupBy("core", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("core").agg(F.sum("n").alias("n"), F.sum(F.sqrt("n")).alias("w")), "core"))
    whole = cut(places.groupBy("source").agg(F.sum("n").alias("n")))
    first = _counted(cores, "n")
    corpus = float(first[_OFFSETS[4] :].sum())
    shared = share(found.sparkSession, first)

    def told_clean():
        model, known = Trigrams(shared(), 0), {}
        return lambda text: LOST not in text and not _undoable(text, model, known)

    counts, everywhere, masses = _counted(cores, "w", told_clean), _start(), None
    for turn in range(ROUNDS):
        suspects = _suspects(cores, counts, turn, corpus)
        expected = _round(_in_sources(suspects, places, masses), everywhere)
        doubted = places.join(suspects.select("core"), "core", "left_semi").groupBy("source").agg(F.sum("n").alias("_doubted"))
        clean = whole.join(doubted, "source", "left").select("source", F.lit(0).alias("chain"), (F.col("n") - F.coalesce("_doubted", F.lit(0))).cast("double").alias("mass"))
        masses = cut(expected.where("chain >= 0").select("source", "chain", "mass").unionByName(clean).groupBy("source", "chain").agg(F.sum("mass").alias("mass")))
        totals = dict(masses.groupBy("chain").agg(F.sum("mass")).collect())  # one row for each chain
        everywhere = _start()
        for chain, mass in totals.items():
            everywhere[chain] += mass
        everywhere /= everywhere.sum()
        counts = np.maximum(first + array_sums.total(expected.where("chain < 0").select("part", "w"), "float64", sum(SIZES)), 0.0)
    return _in_sources(_suspects(cores, counts, ROUNDS, corpus), places, masses), everywhere


def _usable(documents: DataFrame) -> DataFrame:
    return widen(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), "text").where("doc_id is not null and text is not null"))


def garbled_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, seg, chain, numbers, probability) for each stretch whose chain is more likely than none.

    ``seg`` numbers the sentences and lines of the text; ``numbers`` are those of the words concerned among its words beyond ASCII, none
    if it is all of it. A run of such characters that is itself put in quotes is an example, not a case. Null texts and null ids
    give nothing, a null source is one of its own, texts in ASCII are clean; repeated rows are looked at one by one, empty
    tables give no rows.
    """
    found = _cores(_usable(documents))
    met, everywhere = _learn(found)
    shared = share(found.sparkSession, everywhere)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        overall = shared()
        for batch in batches:
            out = []
            for text, source, kinds, numbers, logs, chains, mass in zip(*(batch[c] for c in ("core", "source", "kinds", "numbers", "logs", "chains", "masses"))):
                kinds = [list(k) for k in kinds]
                p = _posterior(logs, kinds, _shares(chains, mass, overall))
                own = sum(float(x) for k, x in zip(kinds, p) if k == [0])
                if own < 0.5:
                    best = max(range(len(p)), key=lambda i: p[i] if kinds[i] != [0] else -1.0)
                    out.append((text, source, CHAINS[kinds[best][0]], list(numbers[best]), 1.0 - own))
            yield pd.DataFrame(out, columns=["core", "source", "chain", "numbers", "probability"])

    told = cut(spread(met, "core", "source").mapInPandas(decide, "core string, source string, chain string, numbers array<int>, probability double"))
    return sized_join(found, told, ["core", "source"], "inner", F.xxhash64("doc_id", "seg")).select("doc_id", "seg", "chain", "numbers", "probability")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a garbled stretch; see garbled_segments."""
    return garbled_segments(documents).select("doc_id").distinct()


def _put_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, text, fixes in zip(batch["doc_id"], batch["text"], batch["fixes"]):
            wanted = {int(f["seg"]): f for f in fixes}
            parts, recovered, number = _SPLIT_KEPT.split(text), True, -1
            for i in range(0, len(parts), 2):  # segments and what stands between them take turns
                if not parts[i]:
                    continue
                number += 1
                if number in wanted:
                    new = repaired(parts[i], wanted[number]["chain"], list(wanted[number]["numbers"]))
                    recovered = recovered and new is not None
                    parts[i] = parts[i] if new is None else new
            out.append((doc, "".join(parts), recovered))
        yield pd.DataFrame(out, columns=["doc_id", "repaired_text", "recovered"])


def repair_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, repaired_text, recovered): garbled documents with each recoverable stretch replaced where it stands.

    recovered is false if some stretch lost characters; that stretch is left as it is. An equal stretch elsewhere in the text that
    is no case, such as a quoted one, stays. Of several texts with one id each is repaired by the stretches found under the id.
    """
    fixes = garbled_segments(documents).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("seg", "chain", "numbers"))).alias("fixes"))
    met = _usable(documents).select("doc_id", "text").join(fixes, "doc_id")
    return met.mapInPandas(_put_back, "doc_id bigint, repaired_text string, recovered boolean").distinct()
