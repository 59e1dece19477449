import numpy as np
import pytest
from helpers import rows, table

from weftline.llm import encoding as E

LINES = [
    "Für das Feld gibt es zwei Lieferungen mit unterschiedlichen Größen.", "Die Prüfung läuft zuerst, weil ein Vergleich mit null den Lauf anhält.", "Le champ est déjà présent à côté de la clé, où il était.",
    "Hodnotitel označil odpovědi za částečně správné, protože se čtou příliš brzy.", "Судья признал ответы частично верными, разброс не изменился.", "The reviewer’s note says “not before noon” – we agreed.", "El año pasado las respuestas salieron vacías por el mismo motivo.",
]


def _corpus():
    docs = []
    for i in range(400):
        docs.append((i, f"s{i % 5}", " ".join(LINES[(i + k) % 7] for k in range(3)) + f" Lauf {i}."))
    return docs


def _garble(text, *steps):
    for written, read in steps:
        out = []
        for b in text.encode(written):
            try:
                out.append(bytes([b]).decode(read))
            except UnicodeDecodeError:
                out.append(chr(b))
        text = "".join(out)
    return text


PLANTED = {
    1000: (LINES[0], [("utf-8", "cp1252")]), 1001: (LINES[2], [("utf-8", "latin-1")]), 1002: (LINES[4], [("utf-8", "cp1251")]), 1003: (LINES[4], [("koi8-r", "cp1251")]), 1004: (LINES[3], [("cp1250", "cp1252")]),
    1005: (LINES[5], [("utf-8", "cp1252"), ("utf-8", "cp1252")]), 1006: (LINES[0], [("cp1252", "cp850")]), 1007: (LINES[3], [("utf-8", "cp852")]), 1008: (LINES[1], [("cp1252", "mac_roman")]), 1009: (LINES[4], [("cp1251", "latin-1")]),
}


def test_planted_chains_are_found_and_undone(spark):
    docs = _corpus()
    for i, (text, steps) in PLANTED.items():
        docs.append((i, "s1", "Plain first. " + _garble(text, *steps) + "\nPlain last."))
    docs += [
        (2000, "s1", "F�r das Feld gibt es zwei Gr��en."), (2001, "s1", 'Example of a bad preview: "â€œ" in place of an opening quote.'), (2002, "s1", "A reader shows “Ã¼” where the file holds ü."),
        (2003, "s1", "The viewer prints “�” for bytes it cannot read."), (2004, None, LINES[0]), (2005, "s1", None), (None, "s1", "FÃ¼r"), (2006, "s1", ""), (2007, "s1", "ASCII only. " * 20_000), (2008, "s1", LINES[4] * 2000),
    ]
    df = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id bigint, source string, text string, chain string, seg int").repartition(4).cache()
    assert rows(E.garbled_documents(df)) == [(i,) for i in [*PLANTED, 2000]]
    fixed = {r.doc_id: r for r in E.repair_documents(df).collect()}
    for i, (text, _) in PLANTED.items():
        assert fixed[i].repaired_text == f"Plain first. {text}\nPlain last." and fixed[i].recovered, i
    assert not fixed[2000].recovered


@pytest.mark.parametrize("steps", [[("utf-8", "cp1252")], [("utf-8", "cp437")], [("koi8-r", "cp866")], [("utf-8", "latin-1"), ("utf-8", "latin-1")]])
def test_undo_is_the_inverse(steps):
    text = LINES[4]
    bad = _garble(text, *steps)
    for written, read in reversed(steps):
        bad = E.undo(bad, written, read)
    assert bad == text
    assert text in E.candidates(_garble(text, *steps))


def test_quoted_only():
    assert E.quoted_only('see "â€œ" here') and E.quoted_only("see “Ã¼” here") and E.quoted_only("`Ã©`")
    assert not E.quoted_only("FÃ¼r") and not E.quoted_only("plain") and not E.quoted_only('"â€œ" and FÃ¼r')


def test_empty_and_clean(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert E.garbled_documents(empty).count() == 0 and E.repair_documents(empty).count() == 0
    clean = spark.createDataFrame(_corpus(), "doc_id bigint, source string, text string")
    assert E.garbled_documents(clean).count() == 0


def test_test_table_has_cases(spark):
    assert E.garbled_documents(table(spark, "documents")).count() >= 1


def test_copies_of_a_garbled_text_are_found(spark):
    clean = "Der Schlüssel wird während der Prüfung zweimal gelesen."
    for steps in ([("utf-8", "cp1252")], [("utf-8", "mac_roman")]):
        docs = _corpus() + [(5000 + i, f"s{i % 5}", _garble(clean, *steps)) for i in range(300)]
        fixed = E.repair_documents(spark.createDataFrame(docs, "doc_id bigint, source string, text string")).collect()
        assert sorted(r.doc_id for r in fixed) == list(range(5000, 5300)), steps
        assert {r.repaired_text for r in fixed} == {clean}


def test_garbled_parts_of_a_sentence_are_found(spark):
    head, tail = "Судья признал ответы частично верными, ", "разброс не изменился."
    parts = {
        3000: head.replace("ответы", _garble("ответы", ("utf-8", "cp1251"))) + tail,
        3001: head + _garble(tail, ("cp1251", "cp1252")),
        3002: _garble(LINES[3][:-1], ("cp1250", "cp1252")) + ", " + tail,
    }
    docs = [*_corpus(), *((i, "s1", t) for i, t in parts.items()), (3010, "s1", "Seeing Ã© instead of é in the preview tells of a wrong reading.")]
    fixed = {r.doc_id: r.repaired_text for r in E.repair_documents(spark.createDataFrame(docs, "doc_id bigint, source string, text string")).collect()}
    assert fixed == {3000: head + tail, 3001: head + tail, 3002: LINES[3][:-1] + ", " + tail}


def test_cores():
    assert E.core("xéaéyz") != E.core("xéaévw") and E.core("é 12 abc") == E.core("é 34 xyz".replace("xyz", "abc"))
    assert E.core("The Größe of a Prüfung über all") == "e Größe o \n a Prüfung über a"
    model = E.Trigrams(np.ones(sum(E.SIZES)), 0)
    for text in ("The Größe of a Prüfung über all", "é", "a é b è c", "été", "x  é  y", "Er läuft."):
        assert abs(model.loglik(text) - model.loglik(E.core(text))) < 1e-9
    texts = ["été", "", "plain", "Größe über", "é"]
    assert np.allclose(model.logliks(texts), [model.loglik(t) for t in texts])


def test_repair_keeps_a_quoted_twin(spark):
    bad = _garble("ü", ("utf-8", "cp1252"))
    text = f'The file once showed "{bad}" here.\n' + _garble(LINES[0], ("utf-8", "cp1252")) + "\n" + _garble("Das Wort über steht da.", ("utf-8", "cp1252"))
    docs = [*_corpus(), (4000, "s1", text)]
    fixed = E.repair_documents(spark.createDataFrame(docs, "doc_id bigint, source string, text string")).collect()
    assert [(r.doc_id, r.repaired_text) for r in fixed] == [(4000, f'The file once showed "{bad}" here.\n{LINES[0]}\nDas Wort über steht da.')]
