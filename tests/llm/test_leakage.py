import random

from helpers import rows, table

from weftline.llm import leakage as L


def _brute(docs, items):
    grams = {}
    for item, *texts in items:
        for t in texts:
            w = L.words(t or "")
            for i in range(len(w) - L.RUN + 1):
                grams.setdefault(tuple(w[i : i + L.RUN]), set()).add(item)
    out = set()
    for doc, text in docs:
        w = L.words(text or "")
        for i in range(len(w) - L.RUN + 1):
            out |= {(doc, item) for item in grams.get(tuple(w[i : i + L.RUN]), ())}
    return sorted(out)


SUITE = "item_id bigint, prompt string, rubric string, w string"


def test_planted_runs_of_every_length(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(60), text(rng.choice([5, 12, 30]))) for i in range(12)] + [(50, None, ""), (None, text(30), None)]
    docs = []
    for d in range(150):
        body = text(rng.randrange(0, 80)).split()
        if d % 2:
            source = items[rng.randrange(12)][1].split()
            n = rng.randrange(8, 20)
            at = rng.randrange(len(source) - n)
            body[len(body) // 2 : len(body) // 2] = [x.upper() + "," for x in source[at : at + n]]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, items[1][2])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id bigint, text string, w string").repartition(3)
    suite = spark.createDataFrame([(*x, "clash") for x in items], SUITE)
    want = _brute(docs, [x for x in items if x[0] is not None])
    assert rows(L.leaked_tests(df, suite)) == want
    by_cosine = rows(L.leaked_tests(df, suite, rest=False))
    assert set(by_cosine) <= set(want) and len(by_cosine) >= 0.9 * len(want)
    monkeypatch.setattr(L, "BLOCK_CHARS", 1500)  # several blocks of the query set
    assert rows(L.leaked_tests(df, suite)) == want


def test_edges(spark):
    docs, suite = table(spark, "documents"), table(spark, "suite_tests")
    assert L.leaked_tests(docs.where("false"), suite).count() == 0
    assert L.leaked_tests(docs, suite.where("false")).count() == 0
    assert rows(L.leaked_tests(docs, suite)) == _brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.prompt, r.rubric) for r in suite.collect()])


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y and y >= 0 else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(-1, 6) for _ in range(rng.randrange(12))] for _ in range(2))
        assert L.common_subsequence(a, b) == slow(a, b)


def test_paraphrases(spark):
    words = [f"term{i}" for i in range(300)]
    item = " ".join(words[:40])
    swapped = words[:40]
    for i in range(5, 40, 9):
        swapped[i] = "other"
    docs = [(1, " ".join(swapped)), (2, " ".join(words[100:160])), (3, item)]
    got = rows(L.paraphrased_tests(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item, " ".join(words[200:220]), "")], SUITE)))
    assert [(d, i, a) for d, i, _, a in got] == [(1, 7, False), (3, 7, False)] and got[1][2] == L.LENGTH


def test_common_words_do_not_hide_runs(spark):
    """Passages of twelve everyday words among rare ones are far apart in the latent space; hashes find them all the same."""
    common = [f"the{i}" for i in range(12)]
    docs = [(d, " ".join([*(f"rare{d}x{i}" for i in range(8)), *common, *(f"rare{d}y{i}" for i in range(8))])) for d in range(80)]
    items = [(1, " ".join(["odd1", "odd2", *common, "odd3", "odd4"]), None, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(L.leaked_tests(df, spark.createDataFrame(items, SUITE), cosine=0.99)) == [(d, 1) for d in range(80)]


def test_paraphrases_against_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40)), None, "") for i in range(20)]
    docs = []
    for d in range(200):
        own = items[rng.randrange(20)][1].split()
        docs.append((d, " ".join(rng.choice(vocabulary) if rng.random() < rng.choice([0.0, 0.05, 0.1, 0.6]) else w for w in own)))
    df, suite = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, SUITE)
    every, found = {(r.doc_id, r.item_id) for r in L.paraphrased_tests(df, suite, cosine=-1.0).collect()}, {(r.doc_id, r.item_id) for r in L.paraphrased_tests(df, suite).collect()}
    assert found <= every and len(found) >= 0.9 * len(every) > 0


def test_sums_of_pieces(spark):
    import numpy as np

    from weftline.llm import array_sums

    def write(batches):
        for b in batches:
            for i in b["id"]:
                a = np.zeros(3 * array_sums.PIECE + 5, np.int64)
                a[i], a[-1] = i, 1
                yield array_sums.pieces(a)

    got = array_sums.total(spark.range(0, 60, 1, 7).mapInPandas(write, array_sums.SCHEMA), "int64", 3 * array_sums.PIECE + 5)
    assert got[:60].tolist() == list(range(60)) and got[-1] == 60 and got[60:-1].sum() == 0
