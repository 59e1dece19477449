import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from weftline.llm import answer_defects as A
from weftline.llm.language import language_of

PROMPT = "Port 0 reads the record.\nComponent: REFORMAT\nSend the row to port 1 if tram_no is missing, or else to port 0. Count how many rows had an empty value in each group."
CODE = '//#CTL2\nfunction integer transform() {\n    // a lone { or " in the feed is fine\n    $out.0.a = concat("x {", $in.0.b);\n    return OK;\n}'


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("```ctl\n//#CTL2\n```", "empty"), ("<think>\n\n</think>\n", "empty"), ("{}", "empty"),
        (CODE, None), (CODE + "\n// end of Thing", None), (CODE + "\n\nThe row is left as it is.", None), ("```\n" + CODE + "\n```", None), (CODE + "\n\nRemarks:\n- a is tested\n- b keeps its format", None),
        (CODE[:-2], "truncated"), ("```\n" + CODE, "truncated"), (CODE + "\n\nThe order of the two tests on", "truncated"), (CODE + "\n\nfunction boolean has(string s", "truncated"), ("```ctl\n" + CODE[:60] + "\n```", "truncated"),
        ("I'm sorry, but I can't help with this transformation.", "refusal"), ("Bohužel nejsem schopen kód připravit.", "refusal"), ("Извините, но я не могу помочь с этой задачей.", "refusal"), ("I cannot write this ROLLUP for you.", "refusal"),
        ("Lo siento, pero no puedo ayudar con esta petición.", "refusal"), ("Désolé, je ne peux pas vous aider.", "refusal"), ("Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"), ("Desculpe, mas não posso ajudar.", "refusal"),
        (CODE.replace("// a lone", "// I can't see a default, a lone"), None), (CODE.replace("return OK;", 'raiseError("unable to write value"); return OK;'), None),
        (PROMPT, "copies_prompt"), ("> " + PROMPT.upper().replace("\n", "\n> "), "copies_prompt"), ("Here it is again.\n" + PROMPT[24:], "copies_prompt"), (CODE.replace("a lone", PROMPT[50:120].replace("\n", " ") + " a lone"), None),
        (CODE + "\n\nDer Rückgabewert bestimmt, über welchen Ausgang die Zeile läuft.", "other_language"), (CODE.replace('"x {"', '"Der Wert ist nicht gültig und wird nicht übernommen {"'), None),
    ],
)
def test_rules(answer, defect):
    rule, closing, _, foreign = A.rules_of(answer, PROMPT, "en")
    assert (rule or {"open": "truncated"}.get(closing) or ("other_language" if foreign else None)) == defect


@pytest.mark.parametrize(("text", "language"), [("The row is left as it is.", "en"), ("Die Zeile bleibt, wie sie ist.", "de"), ("La ligne reste comme elle est.", "fr"), ("La fila se queda como está, porque el valor no se puede comparar.", "es"), ("A linha não muda e fica como está.", "pt"), ("Řádek zůstává, jak je, a už se nemění.", "cs"), ("Строка остаётся как есть.", "ru"), ("tram_no kiln_amt 12", None), ("", None)])
def test_language(text, language):
    assert language_of(text) == language


FORGED = "pair_id bigint, prompt string, chosen string, rejected string, defect string, pid int"
EXAMPLES = "rec_id bigint, prompt string, reference string"


def test_sorted_neighbours_and_hot_answers(spark):
    stem = CODE + "\n\nRemarks:\n- first item of it\n- second item"
    full = stem + " and more\n- third item"
    forged = spark.createDataFrame([(i, PROMPT, stem if i == 7 else CODE if i % 2 else full, None, "clash", 3) for i in range(60)] + [(None, PROMPT, None, None, None, None)], FORGED).repartition(6)
    examples = spark.createDataFrame([(1, None, CODE), (2, None, stem), (3, PROMPT, "x" * 300_000), (3, PROMPT, "x" * 300_000)], EXAMPLES)
    got = rows(A.defective_answers(forged, examples))
    assert [r for r in got if r[2] == "rejected"] == [("forged", i, "rejected", "empty") for i in range(60)]
    assert [r for r in got if r[2] != "rejected"] == [("forged", 7, "chosen", "truncated"), ("source_examples", 2, "reference", "truncated"), ("source_examples", 3, "reference", "truncated")]


def test_units_against_brute_force(spark):
    texts = ["The check on a_b runs first. Then 12 rows go", "The check on c_d runs first. Then 7 rows go on.", "$in.0.x = 1;\n$in.0", "$out.1.y = 22;\nend", "Hope", "Hope so", "It is so. Done", "It is", "Then 3 rows gather.\nok.", "Then 4 rows g", "The check on harv", "- done", "- e_f goes.\nok.", ""]
    forged = spark.createDataFrame([(i, PROMPT, t, None, None, 0) for i, t in enumerate(texts)], FORGED)
    got = {r[0] for r in A.shortened_units(A.answers(forged, spark.createDataFrame([], EXAMPLES))).collect()}
    cut_up = [r[0] for r in forged.select(A.units(F.col("chosen"))).collect()]
    assert [r[0] for r in forged.select(A.last_unit(F.concat("chosen", F.lit("\n\n\n```\n")))).collect()] == [us[-1] if us else "" for us in cut_up]
    complete = {u for us in cut_up for u in us[:-1]}
    last = {us[-1] for us in cut_up if us} - complete
    head = lambda u: re.sub(r"\w+$", "", u)
    named = lambda u, c: head(u) != u and len(re.findall(r"[\w¤]+", head(u))) > 1 and c.startswith(head(u) + "¤")
    want = {u for u in last if u[-1] not in ".;}" and any(c.startswith(u) or named(u, c) for c in complete)}
    assert got == want == {"Then ¤ rows g", "¤", "It is", "The check on harv"}


def test_steps_are_told_apart(spark):
    whole = CODE + "\n\nRemarks:\n- the first is kept\n- the second is kept too\n- done"
    forged = spark.createDataFrame([(1, PROMPT, whole, whole[: whole.index(" kept too")], None, 0), (2, PROMPT, CODE[:-2], None, None, 0)], FORGED)
    got = {(r["row_id"], r["field_name"]): (r["defect"], r["found_by"]) for r in A.judged_answers(forged, spark.createDataFrame([], EXAMPLES)).collect()}
    assert got == {(1, "rejected"): ("truncated", "neighbour"), (2, "chosen"): ("truncated", "neighbour"), (2, "rejected"): ("empty", "rule")}


def test_length_limits(spark):
    ends = spark.createDataFrame([(i, PROMPT, CODE + f"\n- {i:04} item" + "z" * (i % 90 if i % 4 == 0 else 95)) for i in range(800)], EXAMPLES)
    limits = A.length_limits(A.answers(spark.createDataFrame([], FORGED), ends))
    assert rows(limits) == [("source_examples", "reference", len(CODE) + 12 + 95)]
    got = A.defective_answers(spark.createDataFrame([], FORGED), ends)
    assert got.where("defect = 'truncated'").count() >= 200


def test_empty_tables(spark):
    assert A.defective_answers(spark.createDataFrame([], FORGED), spark.createDataFrame([], EXAMPLES)).count() == 0


def test_long_placeholders_are_empty():
    for answer in ("null" + " " * 500, "TODO" + "\n" * 500, "none" + "\u200b" * 500, "<answer>\n```\nTODO\n```\n</answer>\n" * 40):
        assert A.is_empty(answer)
    assert not A.is_empty("TODO " * 200 + "return the sum")
