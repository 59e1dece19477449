"""Reading answers of models: code to run, reviews in looser forms, ordered classification, instructions taken out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import FENCE, verdict_lines

#: Severities of review issues, worst first. Fixed values.
SEVERITIES = ("ERROR", "WARNING", "INFO")


def runnable_code(text: Column, header: str = "//#CTL2") -> Column:
    """The last fenced block that defines a function, behind any thinking, with ``header`` put before it if it has none; null without one."""
    answer = F.element_at(F.split(F.coalesce(text, F.lit("")), "</think>"), -1)
    blocks = F.filter(F.regexp_extract_all(answer, F.lit(FENCE), 2), lambda b: b.rlike(r"\bfunction[ \t\n]+[A-Za-z_]"))
    code = F.regexp_replace(F.try_element_at(blocks, F.lit(-1)), r"^\s+|\s+$", "")
    return F.when(code.startswith(header), code).otherwise(F.concat(F.lit(header + "\n"), code))


def issues(text: Column) -> Column:
    """array(struct(severity, text)) of lines like ``- [ERROR] what``, up to a heading of suggestions."""
    before = F.element_at(F.split(F.coalesce(text, F.lit("")), r"(?im)^[\s*]*suggestions[\s*:]*$", 2), 1)
    lines = F.transform(F.split(before, "\n"), lambda line: F.regexp_replace(line, r"^[\s\-*.)0-9]+", ""))
    read = F.transform(lines, lambda line: F.struct(F.upper(F.regexp_extract(line, r"^\[([A-Za-z]+)\]", 1)).alias("severity"), F.trim(F.regexp_replace(line, r"^\[[A-Za-z]+\]\**", "")).alias("text")))
    return F.filter(read, lambda i: i.severity.isin(*SEVERITIES))


def loose_verdict(text: Column) -> Column:
    """struct(verdict, source): the last stated verdict, else the last line that is PASS or FAIL alone, else FAIL if there is a finding."""
    stated = F.try_element_at(verdict_lines(F.coalesce(text, F.lit(""))), F.lit(-1))
    alone = F.transform(F.split(F.upper(F.coalesce(text, F.lit(""))), "\n"), lambda line: F.regexp_replace(line, "[^A-Z]", ""))
    bare = F.try_element_at(F.filter(alone, lambda w: w.isin("PASS", "FAIL")), F.lit(-1))
    found = F.exists(issues(text), lambda i: i.severity != "INFO")
    return F.struct(
        F.coalesce(stated, bare, F.when(found, "FAIL").otherwise("PASS")).alias("verdict"),
        F.when(stated.isNotNull(), "stated").when(bare.isNotNull(), "alone").otherwise("findings").alias("source"),
    )


def standing_issues(text: Column, retracted: str) -> Column:
    """struct(kept, dropped, verdict): issues whose own text takes them back are dropped; an error left forces FAIL."""
    every = issues(text)
    kept = F.filter(every, lambda i: ~i.text.rlike(retracted))
    return F.struct(
        kept.alias("kept"),
        (F.size(every) - F.size(kept)).alias("dropped"),
        F.when(F.exists(kept, lambda i: i.severity == "ERROR"), "FAIL").when(F.size(kept) < F.size(every), "PASS").otherwise(loose_verdict(text).verdict).alias("verdict"),
    )


def by_rules(text: Column, rules: Sequence[tuple[str, str]], otherwise: str = "") -> Column:
    """The value of the first (pattern, value) that occurs."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in rules], F.lit(otherwise))


def resolved(declared: Column, aliases: dict[str, str], text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(value, source): a declared label by its alias or as it is, else the first rule that the text meets, else empty."""
    label = F.regexp_replace(F.upper(F.trim(declared)), r"[\s-]+", "_")
    known = F.coalesce(*[F.when(label == a, F.lit(v)) for a, v in aliases.items()], F.nullif(label, F.lit("")))
    inferred = F.nullif(by_rules(F.coalesce(text, F.lit("")), rules), F.lit(""))
    return F.struct(F.coalesce(known, inferred, F.lit("")).alias("value"), F.when(known.isNotNull(), "declared").when(inferred.isNotNull(), "text").otherwise("none").alias("source"))


def asks_for_code(text: Column, verbs: Sequence[str], things: Sequence[str], reach: int = 80, needs: str | None = None) -> Column:
    """Whether one of ``verbs`` stands before one of ``things`` in the same sentence, and ``needs`` occurs if it is given."""
    near = rf"(?i)\b({'|'.join(verbs)})\b[^.\n]{{0,{reach}}}\b({'|'.join(things)})\b"
    asked = F.coalesce(text.rlike(near), F.lit(False))
    return asked if needs is None else asked & text.rlike(needs)


def length_to_stop(tokens: Column, stops: Sequence[int], most: int) -> Column:
    """struct(length, hit_cap): tokens up to the first stop; without one all of them, capped if there are ``most``."""
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(tokens, F.lit(s)), F.lit(0)) for s in stops])))
    return F.struct(F.coalesce(at - 1, F.size(tokens)).cast("int").alias("length"), (at.isNull() & (F.size(tokens) >= most)).alias("hit_cap"))


def without_instructions(text: Column, patterns: Sequence[str]) -> Column:
    """The task alone: sentences that begin with a pattern and code blocks are taken out, empty lines closed, the first letter raised."""
    t = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), FENCE, "")
    for p in patterns:
        t = F.regexp_replace(t, rf"(?im)(^|[.:] +){p}[^.\n]*(\.|$)", "$1")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))


def alternatives(choices: Column) -> Column:
    """``1) a  OR  2) b`` of a list; a single one stands alone, none gives an empty text."""
    numbered = F.transform(choices, lambda c, i: F.concat((i + 1).cast("string"), F.lit(") "), c))
    return F.when(F.size(choices) > 1, F.array_join(numbered, "  OR  ")).otherwise(F.coalesce(F.get(choices, 0), F.lit("")))


def pick_of(values: Sequence[str], key: Column, seed: str = "") -> Column:
    """One of ``values``, the same for the same key on any engine: by the first 8 hex digits of SHA-256 of seed and key."""
    number = F.conv(F.left(F.sha2(F.concat(F.lit(seed + "|"), key), 256), F.lit(8)), 16, 10).cast("bigint")
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def nearby(text: Column, detectors: dict[str, str], negation: str, exempt: str, reach: int = 40) -> Column:
    """Sorted names of patterns that occur without a negation within ``reach`` characters on either side, and with nothing of
    ``exempt``, such as the name of another language that the text contrasts with, in the same sentence."""
    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")

    def holds(pattern: str) -> Column:
        before, after = rf"(?i)(?:{negation})[^.!?\n]{{0,{reach}}}(?:{pattern})", rf"(?i)(?:{pattern})[^.!?\n]{{0,{reach}}}(?:{negation})"
        return F.exists(sentences, lambda s: s.rlike(f"(?i){pattern}") & ~s.rlike(before) & ~s.rlike(after) & ~s.rlike(f"(?i){exempt}"))

    return F.array_compact(F.array(*[F.when(holds(p), F.lit(name)) for name, p in sorted(detectors.items())]))
