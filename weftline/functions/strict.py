"""Scalar functions with the record language's semantics where they differ from Spark's.

Positions count from 0, null concatenates as "null", division of integers truncates, lengths are UTF-16 units, equality is
null-safe, and a decimal operand makes the result decimal. ``strict`` forms raise where null is not allowed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def not_null(c: Column, name: str) -> Column:
    """The value, or an error that names it; for operators that refuse null."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"null operand: {name}"))).otherwise(c)


def less(a: Column, b: Column) -> Column:
    return not_null(a, "left") < not_null(b, "right")


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def plus_text(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def divide(a: Column, b: Column, integers: bool) -> Column:
    """Truncating for integers, where 0 raises; IEEE for doubles, where 0 gives infinity or NaN."""
    if integers:
        return F.call_function("div", a, b)
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(x.isNull() | y.isNull(), F.lit(None)).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def wrap_int(c: Column) -> Column:
    """A 64-bit value as a silently overflowing 32-bit integer."""
    return (F.pmod(c.cast("bigint") + 2**31, F.lit(2**32)) - 2**31).cast("int")


def decimal_first(a: Column, b: Column, precision: int = 12, scale: int = 2) -> tuple[Column, Column]:
    """Both operands as decimals, so that the decimal type wins over double."""
    kind = f"decimal({precision},{scale})"
    return a.cast(kind), b.cast(kind)


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.regexp_count(c, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def sub_text(c: Column, start: int, length: int) -> Column:
    """From 0, clamped at the end; a negative start is an error."""
    if start < 0 or length < 0:
        raise ValueError("negative position or length")
    return F.substring(c, start + 1, length)


def index_of(c: Column, part: Column | str) -> Column:
    return F.position(part if isinstance(part, Column) else F.lit(part), c) - 1


def last_index_of(c: Column, part: str) -> Column:
    at = F.position(F.reverse(F.lit(part)), F.reverse(c))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at - len(part) + 1)


def char_at(c: Column, index: int) -> Column:
    return F.nullif(F.substring(c, index + 1, 1), F.lit(""))


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def cut_text(c: Column, pairs: list[tuple[int, int]]) -> Column:
    """The pieces at (start, length), start from 0."""
    return F.array(*[F.substring(c, start + 1, length) for start, length in pairs])


def proper_case(c: Column) -> Column:
    return F.initcap(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def is_integer(c: Column) -> Column:
    return c.rlike("^[+-]?[0-9]+$") & c.try_cast("int").isNotNull()


def is_number(c: Column) -> Column:
    return c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def is_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).isNotNull()


def file_part(path: Column, what: str) -> Column:
    """name, extension, path or stem of a file path with either slash."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    if what == "name":
        return name
    if what == "extension":
        return F.regexp_extract(name, r"\.([^.]*)$", 1)
    if what == "path":
        return F.regexp_extract(path, r"^(.*[/\\])", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def date_add(c: Column, n: Column | int, unit: str) -> Column:
    return F.timestamp_add(unit, n if isinstance(n, Column) else F.lit(n), c)


def date_diff(later: Column, earlier: Column, unit: str) -> Column:
    """Whole units between, truncated."""
    return F.timestamp_diff(unit, earlier, later)


def day_of_week(c: Column) -> Column:
    """1 is Monday."""
    return F.weekday(c) + 1


def poll(c: Column) -> Column:
    """The list without its first element."""
    return F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))


def pop(c: Column) -> Column:
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def contains_all(c: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, c)) == 0


def append_all(base: Column, more: Column) -> Column:
    """Maps merged, the left value kept."""
    return F.map_concat(base, F.map_filter(more, lambda k, _: ~F.map_contains_key(base, k)))


def copy_map(base: Column, more: Column) -> Column:
    """Maps merged, the right value kept."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def first_valid(*attempts: tuple[Column, Column]) -> Column:
    """The value of the first attempt that is ok; attempts are (ok, value), so a rightful null can win."""
    out = F.lit(None)
    for ok, value in reversed(attempts):
        out = F.when(ok, value).otherwise(out)
    return out


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; beyond ``most`` it is most + 1."""
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def java_hash(c: Column) -> Column:
    """The 31-polynomial string hash over UTF-16 units of the basic plane, as a 32-bit integer."""
    codes = F.transform(F.split(c, ""), lambda ch: F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("bigint"))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(wrap_int(F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: F.pmod(acc * 31 + x, F.lit(2**32)))))


@F.pandas_udf(StringType())
def without_diacritics(c: pd.Series) -> pd.Series:
    """Letters without their marks; the one text function here that Spark has no expression for."""
    return c.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFD", t) if not unicodedata.combining(x)))


@F.pandas_udf(StringType())
def normal_form(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


# --- addresses, escapes, code points, bits


def url_part(c: Column, part: str) -> Column:
    """host, port, protocol, path, query, ref or userinfo of an address; null where it has none or is no address."""
    if part == "port":
        return F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1), F.lit("")).cast("int")
    return F.try_parse_url(c, F.lit(part.upper()))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+\S*$"), F.lit(False))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*\z")


#: Characters with a name in XML. Fixed values.
_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_xml(c: Column) -> Column:
    for char, name in _XML:
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def unescape_xml(c: Column) -> Column:
    for char, name in reversed(_XML):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def code_point_at(c: Column, index: int) -> Column:
    """The code point at a place from 0; null beyond the end."""
    return F.when(F.length(c) > index, F.conv(F.hex(F.encode(F.substring(c, index + 1, 1), "UTF-32")), 16, 10).cast("bigint"))


def from_code_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p.cast("bigint")), 8, "0")), "UTF-32")), "")


def bit_set(c: Column, bit: int, on: bool = True) -> Column:
    mask = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("bigint")
    return c.cast("bigint").bitwiseOR(mask) if on else c.cast("bigint").bitwiseAND(F.bitwise_not(mask))


def add_noise(c: Column, width: float, key: Column, seed: str = "") -> Column:
    """The value moved by up to ``width`` to either side, evenly, the same for the same key and seed."""
    unit = F.conv(F.left(F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256), F.lit(8)), 16, 10).cast("double") / F.lit(float(2**32))
    return c.cast("double") + (unit * 2 - 1) * width


def format_message(pattern: str, *values: Column) -> Column:
    """Marks {0}, {1} ... replaced; null as "null", marks without a value stay."""
    out = F.lit(pattern)
    for n, v in enumerate(values):
        out = F.replace(out, F.lit(f"{{{n}}}"), F.coalesce(v.cast("string"), F.lit("null")))
    return out


def normalize_decimal(c: Column) -> Column:
    """A decimal text without zeros that carry nothing and without a plus sign; null if it is no number without an exponent."""
    sign, whole, part = (F.regexp_extract(c, r"^\s*([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?\s*$", i) for i in (1, 2, 3))
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    ok = c.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$")
    return F.when(ok, F.concat(F.when((sign == "-") & (digits != "0"), "-").otherwise(""), digits))


# --- lists, trees and packed numbers


def insert_at(c: Column, index: int, *values: Column) -> Column:
    """Values put before the place ``index`` (from 0); beyond the end is an error."""
    ok = F.size(c) >= index
    return F.when(ok, F.concat(F.slice(c, 1, index), F.array(*values), F.slice(c, index + 1, F.size(c)))).otherwise(F.raise_error(F.lit("index beyond the list")))


def binary_search(c: Column, value: Column) -> Column:
    """The place (from 0) of a value in a sorted list, the first of equals; else -(where it would stand) - 1."""
    at = F.array_position(c, value)
    return F.when(at > 0, at - 1).otherwise(-F.size(F.filter(c, lambda x: x < value)).cast("bigint") - 1)


def find_all_values(json: Column, key: str) -> Column:
    """Texts of all values of a key anywhere in a JSON document, in order; a text that does not parse has none."""
    import json as J

    @F.pandas_udf("array<string>")
    def walk(values: pd.Series) -> pd.Series:
        def visit(x):
            if isinstance(x, dict):
                for k, v in x.items():
                    if k == key:
                        yield v if isinstance(v, str) else J.dumps(v)
                    yield from visit(v)
            elif isinstance(x, list):
                for v in x:
                    yield from visit(v)

        def one(text):
            try:
                return list(visit(J.loads(text))) if text else []
            except (ValueError, RecursionError):
                return []

        return values.map(one)

    return walk(json)


def pack_decimal(c: Column) -> Column:
    """A whole number in packed decimal form: two digits a byte, the last half byte C for plus and D for minus."""
    digits = F.regexp_replace(c.cast("bigint").cast("string"), "^-", "")
    nibbles = F.concat(digits, F.when(c.cast("bigint") < 0, "D").otherwise("C"))
    return F.unhex(F.when(F.length(nibbles) % 2 == 1, F.concat(F.lit("0"), nibbles)).otherwise(nibbles))


def unpack_decimal(c: Column) -> Column:
    h = F.hex(c)
    value = F.left(h, F.length(h) - 1).try_cast("bigint")
    return F.when(F.right(h, F.lit(1)) == "D", -value).when(F.right(h, F.lit(1)).isin("C", "F"), value)


# --- records


def copy_by_name(source: list[str], target: list[str]) -> list[Column]:
    """The target's columns taken from those of the same name, without regard to case; others are null."""
    known = {c.lower(): c for c in source}
    return [(F.col(known[t.lower()]) if t.lower() in known else F.lit(None)).alias(t) for t in target]


def copy_by_position(source: list[str], target: list[str]) -> list[Column]:
    """The target's columns taken from those at the same places; others are null."""
    return [(F.col(source[i]) if i < len(source) else F.lit(None)).alias(t) for i, t in enumerate(target)]


def compare_fields(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null comes before everything and equals null."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def on_error(value: Column, bad: Column, message: Column, fallback: Column) -> Column:
    """struct(value, error): the fallback and a message where ``bad`` holds, so that rows with an error can be routed away."""
    failed = F.coalesce(bad, F.lit(False))
    return F.struct(F.when(failed, fallback).otherwise(value).alias("value"), F.when(failed, message).alias("error"))


# --- validation


def is_email(c: Column) -> Column:
    """One @ between a local part and a domain with a dot, no blanks."""
    return F.coalesce(c.rlike(r"^[^@\s<>()]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+\z"), F.lit(False))


def is_phone(c: Column) -> Column:
    """7 to 15 digits with an optional plus, blanks, hyphens and brackets between them."""
    digits = F.regexp_replace(c, r"[\s()/.-]", "")
    return F.coalesce(digits.rlike(r"^\+?[0-9]{7,15}\z"), F.lit(False))


def is_card(c: Column) -> Column:
    """12 to 19 digits, blanks and hyphens aside, whose check digit is right."""
    digits = F.regexp_replace(c, "[ -]", "")
    return F.coalesce(digits.rlike(r"^[0-9]{12,19}\z") & F.call_function("luhn_check", digits), F.lit(False))


def parse_properties(c: Column) -> Column:
    """map of ``key=value`` lines; lines without a sign, blank ones and those after # or ! are left out, the last of a key holds."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^\s*[^#!\s=][^=]*="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
    return F.map_from_entries(last)
