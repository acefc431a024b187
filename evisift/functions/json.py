"""Strict JSON checks as column expressions; Spark's own JSON functions accept text after a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "end"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used; a plain expression is copied to each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sole_value(text: Column) -> Column:
    """The text of the one JSON value that ``text`` consists of, else null.

    The text is read as the first of two elements of an array, the second being a marker: a second value, a stray
    bracket or anything else after the value leaves other than these two elements.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))
    found = F.from_json(wrapped, "array<string>", _STRICT)

    def first(both: Column) -> Column:
        whole = (F.size(both) == 2) & F.get(both, F.lit(1)).eqNullSafe(F.lit(_END)) & ~F.contains(text, F.lit(_END))
        return F.when(whole, F.get(both, F.lit(0)))

    return once(found, first)


def is_object(text: Column) -> Column:
    """True for exactly one JSON object with nothing but white space around it."""
    return F.coalesce(sole_value(text).isNotNull() & F.ltrim(text).startswith("{"), F.lit(False))


def kind(record: Column, name: str) -> Column:
    """JSON type of a field of a variant: its name up to any bracket; null where the field is absent."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
