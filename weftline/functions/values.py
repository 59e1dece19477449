"""Value equality across systems: numbers by value, blank text as empty, everything else exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(?U)^\s*([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]{1,18}))?\s*$"
#: A whole number without a sign and without zeros at either end.
_PLAIN = r"^[1-9](?:[0-9]*[1-9])?\z"


def canonical_value(value: Column) -> Column:
    """Equal strings for equal values: exact decimal form of a number, '' for blank text, the text itself otherwise.

    Works on digits as text, so no precision or range is lost; null stays null. A number becomes ``#digitsEexponent``.
    A text that begins with ``#`` gets a second ``#``, so that it cannot be taken for a number.
    """
    part = lambda i: F.regexp_extract(value, _NUMBER, i)
    whole, fraction = part(2), F.concat(part(3), part(4))
    exponent = F.when(part(5) == "", F.lit(0)).otherwise(part(5).try_cast("bigint")) - F.length(fraction)
    digits = F.ltrim(F.concat(whole, fraction), F.lit("0"))
    kept = F.rtrim(digits, F.lit("0"))
    number = F.when(digits == "", F.lit("#0")).otherwise(
        F.concat(F.lit("#"), F.when(part(1) == "-", "-").otherwise(""), kept, F.lit("E"), (exponent + F.length(digits) - F.length(kept)).cast("string"))
    )
    return (
        F.when(value.rlike(_PLAIN), F.concat(F.lit("#"), value, F.lit("E0")))  # the commonest numbers, already in that form
        .when(value.rlike(_NUMBER), number)
        .when(value.rlike(r"(?U)^\s*$"), F.lit(""))
        .when(value.startswith("#"), F.concat(F.lit("#"), value))
        .otherwise(value)
    )
