"""Problem 4: broken prompt and response pairs.

Responses are sorted by text and each is compared with its neighbours, whole and in units (lines and sentences, names and
numbers masked). A response whose text another one carries on, or whose last unit is the beginning of a unit that other
responses have in full and that never stands complete itself, is a shortened version. Spikes in the histogram of lengths show
length limits. Rules decide the rest: nothing but placeholders, the task's own words, words of refusal, structure left
open, and prose in another language than the prompt's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.language import FUNCTION_WORDS, language_of
from weftline.operators.neighbours import sorted_neighbours
from weftline.operators.scale import salted_join
from weftline.session import cut, widen

#: Words of a shingle and the share of an answer's shingles that must be the prompt's for a copy.
SHINGLE, COPIED = 5, 0.6
#: A length is a limit if it has this share of a field's answers and so many times its neighbours' mean.
SPIKE_SHARE, SPIKE_TIMES, SPIKE_REACH = 0.005, 6.0, 16
#: Shortest text that counts as the beginning of another, and the share of it that a longer neighbour must have in common.
LEAST_PREFIX, SIBLING = 20, 0.9
#: Words that stand for a missing answer. Fixed values.
PLACEHOLDERS = {"null", "none", "nil", "na", "n", "a", "todo", "tbd", "undefined", "empty", "nan", "placeholder", "answer", "ctl", "ctl2", "code", "think"}

_INVISIBLE = re.compile("[​‌‍⁠﻿\xad]")
_FENCE = re.compile(r"```[^\n`]*\n?(.*?)(?:```|\Z)", re.S)
_MARK = re.compile(r"</?\w+[^>\n]*>|^\s*```.*$|^\s*//\s*#.*$", re.M)
_WORD = re.compile(r"\w+")
_SOLUTION = re.compile(r"\bfunction\s+\w+(?:\[\])?\s+\w+\s*\(|\$(?:in|out)\.\d|\breturn\s+(?:OK|ALL|SKIP|STOP|-?\d+)\s*;")
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|/\*.*?\*/', re.S)
_COMMENT = re.compile(r"//[^\n]*")
_STRING_OR_COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_JOINING = {w for words in FUNCTION_WORDS.values() for w in words}
_CLOSERS = ".!?…。"
#: Refusals: someone declines to act, in seven languages. Fixed values.
_ACT = r"(?:help|assist|write|produce|create|answer|fulfil\w*|provide|do|generate|comply|support|complete|solve|give|offer|implement|carry|deliver|handle|share|process|finish|translate|code)"
_REFUSAL = re.compile(
    rf"\bI(?:['’]m| am)? (?:can(?:not|['’]t| not)|won['’]t|will not|could not|couldn['’]t) (?:\w+ )?{_ACT}\b"
    rf"|\b(?:unable|not able|not allowed|not permitted|not willing|not in a position) to (?:\w+ )?{_ACT}\b"
    rf"|\bI (?:won['’]t|will not|am not going to|must not|may not|shall not|cannot|can['’]t) (?:be able to )?(?:\w+ )?{_ACT}\b|\bno (?:code|solution|answer) (?:is|will be|can be) (?:given|provided|written)"
    r"|\bI (?:must|have to|need to) (?:decline|refuse)|\bI (?:decline|refuse) to\b|\brather not (?:answer|write|do|help)"
    r"|not (?:be )?(?:possible|something)(?: for me| that)? (?:to|I can|I am able)|outside (?:of )?what I (?:am able|can)|beyond what I (?:am able|can)"
    r"|(?:guidelines|policy|policies|rules) (?:prevent|prohibit|forbid|do not allow|don['’]t allow)|don['’]t have the (?:means|ability)|do not have the (?:means|ability)"
    r"|\bdabei kann ich\b|kann ich (?:\w+ )*(?:nicht|keine\w*)|ich kann (?:\w+ )*(?:nicht|keine\w*)|darf ich (?:\w+ )*(?:nicht|keine\w*)|mir (?:leider )?nicht möglich|nicht in der Lage|muss ich (?:leider )?ablehnen|bin (?:leider )?nicht imstande"
    r"|no puedo (?:ayudar|escribir|crear|responder|hacer|generar|proporcionar|cumplir|producir)|no me es posible|no (?:estoy|soy) (?:capaz|en condiciones)|no podré|debo rechazar|me es imposible"
    r"|je ne (?:peux|suis|saurais|pourrai|puis) (?:\w+ )*pas|je ne peux|je ne saurais|il m['’]est impossible|je regrette|je dois (?:décliner|refuser)|pas en mesure|ne m['’]est pas possible"
    r"|não (?:posso|consigo|sou capaz|estou autorizad\w|me é possível|poderei)|é-me impossível|devo recusar|tenho de recusar"
    r"|nemohu (?:\w+ )*(?:pomoci|napsat|vytvořit|připravit|odpovědět|splnit)|nejsem schop\w+|nemám možnost|nelze mi|musím odmítnout|nedokážu|nesmím"
    r"|не могу (?:\w+ )*(?:помочь|написать|создать|ответить|выполнить|подготовить|составить|предоставить)|не в состоянии|не имею возможности|не получится|вынужден\w* отказать|не смогу|мне нельзя",
    re.I,
)


def _words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def is_empty(answer: str | None) -> bool:
    """Null, blank or only placeholders and markup."""
    if answer is None:
        return True
    return all(m.group() in PLACEHOLDERS for m in _WORD.finditer(_MARK.sub(" ", _INVISIBLE.sub("", answer)).casefold()))


def copies_prompt(answer: str, prompt: str) -> bool:
    """Most of the answer's shingles are the prompt's; a shorter answer must stand in the prompt as a whole."""
    own, task = _words(answer), _words(prompt)
    if len(own) < SHINGLE:
        return len(own) > 1 and f" {' '.join(own)} " in f" {' '.join(task)} "
    known = {tuple(task[i : i + SHINGLE]) for i in range(len(task) - SHINGLE + 1)}
    shingles = [tuple(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)]
    return sum(s in known for s in shingles) >= COPIED * len(shingles)


def split_answer(answer: str) -> tuple[str, str, str, bool]:
    """(code, prose, comments in code, whether a fence is left open); lines outside fences are code inside braces or if they look so."""
    if "```" in answer:
        open_fence = answer.count("```") % 2 == 1
        code = "\n".join(_FENCE.findall(answer))
        prose = _FENCE.sub("\n", answer)
    else:
        open_fence, code_lines, prose_lines, depth = False, [], [], 0
        for line in answer.split("\n"):
            text = line.strip()
            bare = _STRING_OR_COMMENT.sub("", text)
            if depth > 0 or text.startswith(("//", "/*", "function ")) or bare.endswith((";", "{", "}")) or "$out." in bare or "$in." in bare:
                code_lines.append(line)
                depth = max(0, depth + bare.count("{") - bare.count("}"))
            else:
                prose_lines.append(line)
        code, prose = "\n".join(code_lines), "\n".join(prose_lines)
    comments = " \n".join(c[2:] for c in _COMMENT.findall(_STRING.sub('""', code)) if not c.startswith("//#"))
    return code, prose, comments, open_fence


def ending(answer: str) -> str:
    """'open' if the structure or a sentence breaks off, 'vague' if only a comparison could tell, else 'closed'."""
    code, _, _, open_fence = split_answer(answer)
    bare = _STRING_OR_COMMENT.sub("", code)
    if open_fence or bare.count("{") > bare.count("}") or bare.count("(") > bare.count(")") or bare.count("[") > bare.count("]"):
        return "open"
    last = answer.rstrip().rsplit("\n", 1)[-1].strip()
    if not last or last.startswith("```"):
        return "closed"
    if last.startswith("//"):
        words = _WORD.findall(last)
        if last[-1] in _CLOSERS or last.startswith("//#"):
            return "closed"
        return "vague" if len(words) < 5 and (not words or words[-1].lower() not in _JOINING) else "open"
    if _STRING_OR_COMMENT.sub("", last).rstrip().endswith((";", "{", "}", ",")) or "$out." in last or last.startswith(("function ", "$")):
        tail = _STRING_OR_COMMENT.sub("", last).rstrip()
        return "closed" if tail.endswith((";", "}")) else "open"
    if last.rstrip("\"'”’»)*_`")[-1:] and last.rstrip("\"'”’»)*_`")[-1] in _CLOSERS:
        return "closed"
    if re.match(r"[-*•+] |\d+[.)] |#|\||>", last):
        return "vague"
    return "open"


def rules_of(answer: str | None, prompt: str | None, prompt_language: str | None) -> tuple[str | None, str, bool, bool]:
    """(empty, copies_prompt, refusal or None; how the text ends; whether it holds a solution; whether its language is another)."""
    if is_empty(answer):
        return "empty", "closed", False, False
    code, prose, comments, _ = split_answer(answer)
    solved = bool(_SOLUTION.search(code)) or bool(_SOLUTION.search(answer))
    if not solved and prompt and copies_prompt(answer, prompt):
        return "copies_prompt", "closed", solved, False
    if not solved and _REFUSAL.search(prose + "\n" + comments):
        return "refusal", "closed", solved, False
    own = (language_of(prose) or language_of(prose + "\n" + comments)) if prompt_language else None
    return None, ending(answer), solved, own is not None and own != prompt_language


_TAG = re.compile(r"<[^>\n]*>")
_KEPT = ["table_name", "row_id", "field_name", "h", "n", "unit"]


def _apply_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, language = None, None
    for batch in batches:
        out = []
        for prompt, answer in zip(batch["prompt"], batch["answer"]):
            if prompt != seen:
                seen, language = prompt, language_of(_TAG.sub(" ", prompt)) if prompt else None
            out.append(rules_of(answer, prompt, language))
        told = pd.DataFrame(out, columns=["rule", "closing", "solved", "foreign"], index=batch.index)
        yield pd.concat([batch[_KEPT], told], axis=1)


#: What is masked in units: places of records, names of several words, numbers. ASCII, as names in code are.
_MASKED, _MASK = r"\$[\w.]*|\b[A-Za-z][A-Za-z0-9]*_\w*|\b[A-Za-z]?[a-z0-9]+[A-Z][A-Za-z0-9]*|[0-9]+", "¤"
#: Ends of a unit after which nothing is missing.
_COMPLETE = r"[.!?…。;}][\"'”’»)\]*_`]*$"


def units(answer: Column) -> Column:
    """Lines and sentences of a text in masked form, without blank ones and fences."""
    text = F.regexp_replace(F.rtrim(answer), _MASKED, _MASK)
    return F.filter(F.split(text, r"\n+|(?<=[.!?…。]) +"), lambda u: (F.trim(u) != "") & ~u.startswith("```"))


def last_unit(answer: Column) -> Column:
    """The last of ``units``, from the last lines if they hold one; an empty text if there is none."""
    tail = F.substring_index(F.rtrim(answer), "\n", -3)
    return F.coalesce(F.try_element_at(units(tail), F.lit(-1)), F.try_element_at(units(answer), F.lit(-1)), F.lit(""))


def shortened_units(rows: DataFrame) -> DataFrame:
    """(unit): last units that break off where other answers go on.

    A unit is complete if it stands somewhere with another one behind it. A last unit that is never complete is shortened
    if a neighbour among the complete ones begins with it, or has a name where it breaks off in a word, after two equal words.
    """
    cut_up = rows.where("answer is not null").select(units(F.col("answer")).alias("u"))
    told = cut_up.select(F.explode(F.transform("u", lambda u, i: F.struct(u.alias("unit"), (i < F.size("u") - 1).alias("inner")))).alias("x")).groupBy("x.unit").agg(F.bool_or("x.inner").alias("complete"))
    last = sorted_neighbours(told, "unit", "complete").where(~F.col("complete") & ~F.col("unit").rlike(_COMPLETE))
    head = F.regexp_replace("unit", r"(?U)\w+$", "")
    goes_on = F.startswith(F.coalesce("after", F.lit("")), F.col("unit"))
    name = F.concat(head, F.lit("¤"))
    shares = head.rlike(r"(?U)[\w¤]+\W+[\w¤]+\W+$") & (head != F.col("unit")) & (F.startswith(F.coalesce("after", F.lit("")), name) | F.startswith(F.coalesce("before", F.lit("")), name))
    return last.where(goes_on | shares).select("unit")


def shortened_answers(rows: DataFrame) -> DataFrame:
    """(h, n): hash and length of the different answers of which a longer neighbour in the order of texts has SIBLING of the length in common."""
    texts = rows.where("answer is not null").select("answer").distinct().withColumn("mark", F.lit(True))
    common = F.ceil(F.length("answer") * SIBLING).cast("int")
    beside = lambda c: (F.length(c) > F.length("answer")) & (F.left(F.col(c), common) == F.left("answer", common))
    longer = sorted_neighbours(texts, "answer", "mark").where((F.length("answer") >= LEAST_PREFIX) & (F.coalesce(beside("after"), F.lit(False)) | F.coalesce(beside("before"), F.lit(False))))
    return longer.select(F.xxhash64("answer").alias("h"), F.length("answer").alias("n")).distinct()


def answers(forged: DataFrame, examples: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, prompt, answer) of all answers in both tables; rows without an id are left out."""
    two = F.explode(F.array(F.struct(F.lit("chosen").alias("f"), F.col("chosen").alias("a")), F.struct(F.lit("rejected").alias("f"), F.col("rejected").alias("a")))).alias("x")
    pairs = forged.select(F.col("pair_id").cast("bigint").alias("row_id"), "prompt", two).select(F.lit("forged").alias("table_name"), "row_id", F.col("x.f").alias("field_name"), "prompt", F.col("x.a").alias("answer"))
    own = examples.select(F.lit("source_examples").alias("table_name"), F.col("rec_id").cast("bigint").alias("row_id"), F.lit("reference").alias("field_name"), "prompt", F.col("reference").alias("answer"))
    return pairs.unionByName(own).where("row_id is not null")


def length_limits(rows: DataFrame) -> DataFrame:
    """(table_name, field_name, n): lengths that far more different answers have than the lengths around them.

    At most 1 / SPIKE_SHARE for each field, whatever the number of answers.
    """
    counted = rows.where("answer is not null").groupBy("table_name", "field_name", F.length("answer").alias("n")).agg(F.countDistinct(F.xxhash64("answer")).alias("c"))
    field = Window.partitionBy("table_name", "field_name")
    near = field.orderBy("n").rangeBetween(-SPIKE_REACH, SPIKE_REACH)
    marked = counted.withColumn("all", F.sum("c").over(field)).withColumn("mean", (F.sum("c").over(near) - F.col("c")) / (2 * SPIKE_REACH))
    return marked.where((F.col("c") >= F.greatest(F.lit(20.0), F.col("all") * SPIKE_SHARE)) & (F.col("c") > F.col("mean") * SPIKE_TIMES)).select("table_name", "field_name", "n")


def judged_answers(forged: DataFrame, examples: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, defect, found_by): each broken answer with the step that decides.

    found_by is 'neighbour' for shortened versions found by comparing whole texts or units in sort order, 'limit' for
    lengths at a spike, else 'rule'. Cases and order as in defective_answers.
    """
    rows = answers(forged, examples)
    facts = widen(rows).withColumns({"h": F.xxhash64("answer"), "n": F.length("answer"), "unit": last_unit(F.col("answer"))})
    facts = cut(facts.mapInPandas(_apply_rules, "table_name string, row_id bigint, field_name string, h bigint, n int, unit string, rule string, closing string, solved boolean, foreign boolean"))
    limits = length_limits(rows).withColumn("limit", F.lit(True))
    own = F.xxhash64("table_name", "row_id", "field_name")
    open_ones = facts.where("rule is null")
    met = salted_join(open_ones, cut(shortened_units(rows)).withColumn("cut", F.lit(True)), ["unit"], "left", own)
    met = salted_join(met, cut(shortened_answers(rows)).withColumn("sibling", F.lit(True)), ["h", "n"], "left", own)
    # Spikes are bounded by 1 / SPIKE_SHARE for each of three fields.
    met = met.join(F.broadcast(limits), ["table_name", "field_name", "n"], "left")
    unclear = (F.col("closing") != "closed") | ~F.col("solved")
    step = (
        F.when(F.col("cut") | (F.col("sibling") & unclear), F.struct(F.lit("truncated").alias("defect"), F.lit("neighbour").alias("found_by")))
        .when(F.col("closing") == "open", F.struct(F.lit("truncated").alias("defect"), F.lit("rule").alias("found_by")))
        .when(F.col("foreign"), F.struct(F.lit("other_language").alias("defect"), F.lit("rule").alias("found_by")))
        .when(F.col("limit") & unclear, F.struct(F.lit("truncated").alias("defect"), F.lit("limit").alias("found_by")))
    )
    late = met.withColumn("d", step).where("d is not null").select("table_name", "row_id", "field_name", "d.defect", "d.found_by")
    return facts.where("rule is not null").select("table_name", "row_id", "field_name", F.col("rule").alias("defect"), F.lit("rule").alias("found_by")).unionByName(late).distinct()


def defective_answers(forged: DataFrame, examples: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, defect): each broken answer with its one defect.

    What is empty, a copy or a refusal stays so even where it breaks off; then come shortened versions, open structure, other
    languages and lengths at a limit. A null answer is empty; with a null prompt an answer can neither copy it nor be in another
    language. A complete answer that is the beginning of another is no defect. Texts are compared once for all their copies, a text
    or unit that a third of all answers share is joined in salted parts. Very short and very long texts are judged whole.
    Empty tables give no rows, repeated rows one result, other columns are ignored.
    """
    return judged_answers(forged, examples).drop("found_by").distinct()


def defect_report(forged: DataFrame, examples: DataFrame) -> DataFrame:
    """(table_name, field_name, defect, found_by, answers): number of answers for each defect and step."""
    return judged_answers(forged, examples).groupBy("table_name", "field_name", "defect", "found_by").agg(F.count(F.lit(1)).alias("answers"))
