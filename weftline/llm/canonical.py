"""Canonical form of a prompt: whitespace, letter case, punctuation and unordered structure are disregarded."""

from __future__ import annotations

import json
import re

_NOISE = re.compile(r"[\W​]+")
_RECORD = re.compile(r"(<\s*record\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)(.*?)(<\s*/\s*record\s*>)", re.I | re.S)
_FIELD = re.compile(r"<\s*field\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:/\s*>|>(?:\s*<\s*/\s*field\s*>)?)", re.I)
_TAG_HEAD = re.compile(r"<\s*(\w+)")
_ATTRIBUTE = re.compile(r"([\w:.\-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>/]+)")


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=lambda pairs: ("object", pairs), parse_int=str, parse_float=str, parse_constant=str)


def squash(text: str) -> str:
    """Letters, digits and underscores of ``text`` in case-folded form."""
    return _NOISE.sub("", text.casefold())


def _element(head: str, body: str) -> str:
    """An element with its attributes in order of their own canonical text; anything else in the tag follows."""
    attributes = sorted(squash(k) + squash(v) for k, v in _ATTRIBUTE.findall(body))
    return head + "".join(attributes) + squash(_ATTRIBUTE.sub(" ", body))


def _record(match: re.Match[str]) -> str:
    start, inner, _ = match.groups()
    head = _TAG_HEAD.match(start)
    fields = sorted(_element("field", f) for f in _FIELD.findall(inner))
    return _element("record", start[head.end() : -1]) + squash(_FIELD.sub(" ", inner)) + "".join(fields) + "record"


def _json(value: object) -> str:
    if isinstance(value, tuple):
        return "".join(k + v for k, v in sorted((squash(k), _json(v)) for k, v in value[1]))
    if isinstance(value, list):
        return "".join(map(_json, value))
    if isinstance(value, str):
        return canonical(value)
    return squash(json.dumps(value))


def canonical(text: str) -> str:
    """Equal for two texts exactly if they differ in nothing but dress.

    Field elements of a Record are sorted, as are attributes of an element and keys of a JSON object, at any depth;
    JSON is recognised wherever an object parses. A brace or tag that parses as neither is plain text.
    """
    parts: list[str] = []
    at = 0
    for match in _RECORD.finditer(text):
        parts.append(_with_json(text[at : match.start()]))
        parts.append(_record(match))
        at = match.end()
    parts.append(_with_json(text[at:] if at else text))
    return "".join(parts)


def _with_json(text: str) -> str:
    if "{" not in text:
        return squash(text)
    parts: list[str] = []
    decoder = _decoder()
    at = 0
    brace = text.find("{")
    while brace >= 0:
        try:
            value, end = decoder.raw_decode(text, brace)
        except (ValueError, RecursionError):
            brace = text.find("{", brace + 1)
            continue
        parts += [squash(text[at:brace]), _json(value)]
        at = end
        brace = text.find("{", end)
    parts.append(squash(text[at:]))
    return "".join(parts)
