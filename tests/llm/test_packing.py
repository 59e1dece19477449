import itertools
import random

from helpers import rows, table
from pyspark.sql import functions as F

from weftline.llm import packing as P
from weftline.llm.tokens import TOKENIZER, token_counts


def test_best_fill_is_the_best():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 8))]
        room = rng.randrange(0, 30)
        counts = {s: items.count(s) for s in items}
        used = P.best_fill(sorted(counts, reverse=True), counts, room)
        assert all(n <= counts[s] for s, n in used.items())
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room)
        assert sum(s * n for s, n in used.items()) == best


def test_pack_lengths_holds_every_item():
    counts = {7: 5, 3: 9, 1: 4, 10: 2}
    packed = P.pack_lengths(counts, 10)
    held = {}
    for used, times in packed:
        assert sum(s * n for s, n in used.items()) <= 10
        for s, n in used.items():
            held[s] = held.get(s, 0) + n * times
    assert held == counts and sum(t for _, t in packed) == 9


def _check(out, lengths, capacities):
    pieces = {}
    fill = {}
    for r in out.collect():
        fill.setdefault((r.pack_name, r.container), []).append(r.tokens)
        pieces.setdefault((r.pack_name, r.doc_id), []).append((r.piece, r.start_token, r.tokens))
        assert r.capacity == capacities[r.pack_name]
    for (pack, _), sizes in fill.items():
        assert sum(sizes) <= capacities[pack]
    for pack, cap in capacities.items():
        for doc, n in lengths.items():
            got = sorted(pieces[pack, doc])
            assert [s for _, s, _ in got] == list(range(0, n, cap)) and sum(t for *_, t in got) == n


def test_pack_items(spark):
    rng = random.Random(4)
    lengths = {i: rng.choice([3, 50, 99, 100, 101, 250, rng.randrange(1, 400)]) for i in range(500)}
    df = spark.createDataFrame([(i, n, "clash", 1) for i, n in lengths.items()] + [(900, 0, "", 1), (901, None, "", 1), (None, 5, "", 1)], "doc_id bigint, tokens bigint, container string, window int")
    packs = spark.createDataFrame([("s", 100), ("l", 300), ("bad", None), (None, 5), ("zero", 0)], "pack_name string, capacity_tokens int")
    out = P.pack_items(df, packs, window=64).cache()
    _check(out, lengths, {"s": 100, "l": 300})
    assert all(r.containers <= r.fewest * 1.03 + 1 for r in P.pack_report(out).collect())
    assert P.pack_items(df.where("false"), packs).count() == 0 and P.pack_items(df, packs.where("false")).count() == 0


def test_repeated_ids_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 100)], "doc_id bigint, tokens bigint")
    out = P.pack_items(df, spark.createDataFrame([("s", 100)], "pack_name string, capacity_tokens int"))
    assert out.count() == 3 and rows(out.groupBy("container").agg(F.sum("tokens")).select("sum(tokens)")) == [(20,), (100,)]


def test_token_counts_against_the_library(spark):
    import base64

    import tiktoken

    from weftline.llm.tokens import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, "documents").select("doc_id", "text")
    want = sorted((r.doc_id, len(own.encode_ordinary(r.text))) for r in docs.collect())
    assert rows(token_counts(docs)) == want
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "<|endoftext|> x")], "doc_id bigint, text string")
    assert [r[0] for r in rows(token_counts(odd))] == [1, 3]
