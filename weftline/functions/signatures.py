"""Calls in code and the overloads that accept them: arities, argument types, type variables."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*.*?\*/', re.S)
_OPEN, _CLOSE = "([{<", ")]}>"


def split_top(text: str, sep: str = ",", brackets: str = "([{") -> list[str]:
    """Parts of ``text`` between separators that no bracket encloses; a blank text has none."""
    closing = {_OPEN[_OPEN.index(b)]: _CLOSE[_OPEN.index(b)] for b in brackets}
    ends, parts, depth, start = set(closing.values()), [], 0, 0
    for i, c in enumerate(text):
        if c in closing:
            depth += 1
        elif c in ends:
            depth = max(0, depth - 1)
        elif c == sep and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*parts, last] if parts or last else []


def calls(code: str | None) -> list[tuple[str, int]]:
    """(name, arity) of every call in order; strings count as one token, comments as none, definitions are no calls."""
    if not code:
        return []
    bare = _TOKEN.sub(lambda m: '""' if m.group()[0] == '"' else " ", code)
    stack: list[int] = []
    ends: dict[int, int] = {}
    for i, c in enumerate(bare):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            ends[stack.pop()] = i
    out = []
    for m in _CALL.finditer(bare):
        head = bare[: m.start()].rstrip()
        defined = re.search(r"\bfunction\s+[\w\[\]]+$", head[-80:])
        if not defined and m.group(1) not in ("if", "while", "for", "foreach", "switch", "function", "return") and (end := ends.get(m.end() - 1)) is not None:
            out.append((m.group(1), len(split_top(bare[m.end() : end]))))
    return out


def call_arities(code: Column) -> Column:
    """array(struct(name, arity)) of the distinct calls of a code, sorted. Brackets nest, which no regular expression follows."""

    @F.pandas_udf("array<struct<name:string,arity:int>>")
    def read(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: [{"name": n, "arity": a} for n, a in sorted(set(calls(c)))])

    return read(code)


def parse_type(text: str):
    """A type as nested tuples: ``list<T>`` is ('list', ('T',)), a union ``a|b`` is ('|', ...), ``any...`` marks the rest."""
    text = text.strip()
    alternatives = split_top(text, "|", "(<[{")
    if len(alternatives) > 1:
        return ("|", *map(parse_type, alternatives))
    if text.endswith("..."):
        return ("...", parse_type(text[:-3]))
    if m := re.fullmatch(r"(\w+)\s*<(.*)>", text, re.S):
        return (m.group(1).lower(), *map(parse_type, split_top(m.group(2), ",", "(<[{")))
    if m := re.fullmatch(r"(\w+)\[\]", text):
        return ("list", parse_type(m.group(1)))
    return (text if len(text) == 1 and text.isupper() else text.lower(),)


#: Numbers from narrow to wide; a value may stand where a wider one is wanted. Fixed values.
WIDER = ("integer", "long", "number", "decimal")


def matches(want, have, bound: dict[str, tuple]) -> bool:
    """Whether a value of type ``have`` may stand for ``want``; ``bound`` collects what type variables stand for."""
    if want[0] == "|":
        return any(matches(w, have, bound) for w in want[1:])
    if want[0] == "any" or have[0] in ("null", "any"):
        return True
    if len(want) == 1 and len(want[0]) == 1 and want[0].isupper():
        known = bound.setdefault(want[0], have)
        return known == have or _joined(known, have, want[0], bound)
    if want[0] in WIDER and have[0] in WIDER:
        return WIDER.index(have[0]) <= WIDER.index(want[0])
    return want[0] == have[0] and len(want) == len(have) and all(matches(w, h, bound) for w, h in zip(want[1:], have[1:]))


def _joined(known, have, name: str, bound: dict[str, tuple]) -> bool:
    """A type variable met by two number types stands for the wider one."""
    if known[0] in WIDER and have[0] in WIDER:
        bound[name] = max(known, have, key=lambda t: WIDER.index(t[0]))
        return True
    return False


def accepts(parameters: Iterable[str], arguments: Iterable[str]) -> dict[str, tuple] | None:
    """What the type variables stand for if the overload takes the arguments, else None; ``T...`` takes any number of them."""
    wanted, given, bound = [parse_type(p) for p in parameters], [parse_type(a) for a in arguments], {}
    rest = wanted[-1][1] if wanted and wanted[-1][0] == "..." else None
    fixed = wanted[:-1] if rest else wanted
    if len(given) < len(fixed) or (rest is None and len(given) > len(fixed)):
        return None
    pairs = [*zip(fixed, given), *((rest, g) for g in given[len(fixed) :])]
    return bound if all(matches(w, g, bound) for w, g in pairs) else None


def shown(kind, bound: dict[str, tuple]) -> str:
    """A parsed type as text, type variables replaced."""
    kind = bound.get(kind[0], kind) if len(kind) == 1 else kind
    if kind[0] == "|":
        return "|".join(shown(k, bound) for k in kind[1:])
    return kind[0] + (f"<{','.join(shown(k, bound) for k in kind[1:])}>" if len(kind) > 1 else "")


def resolver(overloads: dict[str, list[tuple[list[str], str]]]):
    """A column function (name, argument types) -> return types of the overloads that accept the call, joined with a slash; a bounded catalogue."""

    @F.pandas_udf("string")
    def resolve(name: pd.Series, arguments: pd.Series) -> pd.Series:
        def one(n, args):
            found = [shown(parse_type(result), bound) for parameters, result in overloads.get(n, []) if (bound := accepts(parameters, args if args is not None else [])) is not None]
            return "/".join(dict.fromkeys(found)) if found else None

        return pd.Series([one(n, a) for n, a in zip(name, arguments)], dtype=object)

    return resolve
