"""Column rules with readable messages: NULL means the rule is satisfied."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.formats import matches
from quern.functions.text import utf16_length
from quern.operators.schema_rules import plain

Check = Callable[[Column, str], Column]


def first_of(*messages: Column) -> Column:
    """Rules in order; the first violated one speaks."""
    return F.coalesce(*messages)


def required(fields: Mapping[str, Column], name: str = "Object") -> Column:
    """All fields that are missing: NULL, empty text, 0 or false."""
    def lacks(value: Column) -> Column:
        text = value.cast("string")
        number = text.try_cast("double")
        return value.isNull() | (text == "") | (text == "false") | F.coalesce(number == 0, F.lit(False))

    missing = F.array_compact(F.array(*[F.when(lacks(v), F.lit(k)) for k, v in fields.items()]))
    return F.when(
        F.size(missing) > 0, F.concat(F.lit(f"{name} is missing required fields: "), F.array_join(missing, ", "))
    )


def of_type(kind: Column, expected: str, name: str) -> Column:
    """``kind`` is the value's kind; JSON null counts as an object."""
    actual = F.when(kind == "null", "object").when(kind.isNull(), "undefined").otherwise(kind)
    return F.when(
        actual != expected, F.concat(F.lit(f"Invalid type for {name}: expected {expected}, got "), actual)
    )


def one_of(value: Column, allowed: Sequence[Any], name: str) -> Column:
    text = f"Invalid value for {name}: must be one of {', '.join(plain(v) for v in allowed)}"
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), text)


def in_range(value: Column, name: str, low: float | None = None, high: float | None = None) -> Column:
    out = F.lit(None).cast("string")
    if high is not None:
        out = F.when(value > high, f"{name} must be at most {plain(high)}")
    if low is not None:
        out = F.coalesce(F.when(value < low, f"{name} must be at least {plain(low)}"), out)
    return out


def text_rule(
    value: Column, name: str, low: int | None = None, high: int | None = None, pattern: str | None = None
) -> Column:
    rules = [F.when(value.isNull(), f"{name} must be a string")]
    if low is not None:
        rules.append(F.when(utf16_length(value) < low, f"{name} must be at least {low} characters"))
    if high is not None:
        rules.append(F.when(utf16_length(value) > high, f"{name} must be at most {high} characters"))
    if pattern:
        rules.append(F.when(~matches(value, pattern), f"{name} has invalid format"))
    return first_of(*rules)


def list_rule(
    value: Column, name: str, low: int | None = None, high: int | None = None, item: Callable[[Column], Column] | None = None
) -> Column:
    """Size limits, then the first element that violates ``item``."""
    rules = [F.when(value.isNull(), f"{name} must be an array")]
    if low is not None:
        rules.append(F.when(F.size(value) < low, f"{name} must have at least {low} items"))
    if high is not None:
        rules.append(F.when(F.size(value) > high, f"{name} must have at most {high} items"))
    if item is not None:
        found = F.transform(value, lambda e, i: F.when(
            item(e).isNotNull(), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "), item(e))
        ))
        rules.append(F.get(F.array_compact(found), F.lit(0)))
    return first_of(*rules)


def object_messages(checks: Mapping[str, tuple[Column, Check]]) -> Column:
    """Messages of all violated member rules, in the order stated."""
    return F.array_compact(F.array(*[check(value, name) for name, (value, check) in checks.items()]))


def outside_range(value: Column, low: float, high: float) -> Column:
    """Inclusive numeric range used as an extra rule."""
    return ~value.between(low, high)
