"""Placeholders ``{name}`` in texts.

A placeholder that is not a known name may carry one rule behind its first
underscore: ``{x_minus_2}``, ``{x_plus_1}``, ``{x_translit}``.  Anything that
cannot be resolved stays in the text as written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import number_text, translit

_PLACEHOLDER = re.compile(r"\{([^}]+)\}")
_DOUBLE = re.compile(r"\{\{(\w+)\}\}", re.ASCII)

Lookup = Callable[[str], "Column | None"]


def _steps(part: str | None) -> int:
    """Step of a minus/plus rule: its leading integer, 1 when absent or 0."""
    found = re.match(r"\s*([+-]?\d+)", part or "")
    return (int(found.group(1)) if found else 0) or 1


def map_lookup(ctx: Column) -> Lookup:
    """Names resolved in a ``map<string,string>`` column, per row."""
    return lambda name: F.try_element_at(ctx, F.lit(name))


def column_lookup(values: Mapping[str, Column]) -> Lookup:
    """Names resolved in a fixed set of columns."""
    return lambda name: values.get(name)


def _suffix_rule(name: str, lookup: Lookup, numeric: Column | None) -> Column | None:
    parts = name.split("_")
    if len(parts) < 2:
        return None
    base = lookup(parts[0])
    if base is None or parts[1] not in ("minus", "plus", "translit"):
        return None
    if parts[1] == "translit":
        slug = translit(base)
        if numeric is not None:
            slug = F.when(F.array_contains(numeric, parts[0]), F.lit("")).otherwise(slug)
        return F.when(base.isNotNull(), slug)
    number = base.cast("string").try_cast("double")
    step = _steps(parts[2] if len(parts) > 2 else None)
    if parts[1] == "plus":
        return F.when(number.isNotNull(), number_text(number + F.lit(float(step))))
    changed = F.coalesce(number_text(number - F.lit(float(step))), F.lit("NaN"))
    return F.when(base.isNotNull(), changed)


def render(template: str, lookup: Lookup, numeric: Column | None = None) -> Column:
    """Render a template known on the driver; it is split once, not per row.

    ``numeric`` optionally names the keys whose values are numbers: their
    ``_translit`` form is empty.
    """
    pieces: list[Column] = []
    at = 0
    for found in _PLACEHOLDER.finditer(template):
        if found.start() > at:
            pieces.append(F.lit(template[at:found.start()]))
        name = found.group(1)
        options = [lookup(name), _suffix_rule(name, lookup, numeric), F.lit(found.group(0))]
        pieces.append(F.coalesce(*[o.cast("string") for o in options if o is not None]))
        at = found.end()
    if at < len(template) or not pieces:
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)


def render_column(template: Column, ctx: Column, numeric: Column | None = None) -> Column:
    """Render a template that differs from row to row, over a map context."""
    tokens = F.regexp_extract_all(template, F.lit(r"\{[^}]+\}|[^{]+|\{"), F.lit(0))

    def resolve(token: Column) -> Column:
        name = F.substring(token, F.lit(2), F.char_length(token) - 2)
        parts = F.split(name, "_")
        rule = F.get(parts, F.lit(1))
        base = F.try_element_at(ctx, F.get(parts, F.lit(0)))
        lead = F.regexp_extract(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("double")
        step = F.when(lead.isNull() | (lead == 0), F.lit(1.0)).otherwise(lead)
        number = base.try_cast("double")
        slug = translit(base)
        if numeric is not None:
            slug = F.when(F.array_contains(numeric, F.get(parts, F.lit(0))), F.lit("")).otherwise(slug)
        ruled = (
            F.when(base.isNull(), F.lit(None).cast("string"))
            .when(rule == "minus", F.coalesce(number_text(number - step), F.lit("NaN")))
            .when(rule == "plus", number_text(number + step))
            .when(rule == "translit", slug)
        )
        known = F.coalesce(F.try_element_at(ctx, name), ruled, token)
        return F.when(F.startswith(token, F.lit("{")) & (F.char_length(token) > 2), known).otherwise(token)

    return F.array_join(F.transform(tokens, resolve), "")


def render_double(template: str, lookup: Lookup) -> Column:
    """Render ``{{name}}`` placeholders; no suffix rules."""
    pieces: list[Column] = []
    at = 0
    for found in _DOUBLE.finditer(template):
        if found.start() > at:
            pieces.append(F.lit(template[at:found.start()]))
        value = lookup(found.group(1))
        literal = F.lit(found.group(0))
        pieces.append(literal if value is None else F.coalesce(value.cast("string"), literal))
        at = found.end()
    if at < len(template) or not pieces:
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)


def render_double_column(template: Column, ctx: Column) -> Column:
    tokens = F.regexp_extract_all(template, F.lit(r"\{\{\w+\}\}|[^{]+|\{"), F.lit(0))

    def resolve(token: Column) -> Column:
        name = F.substring(token, F.lit(3), F.char_length(token) - 4)
        known = F.coalesce(F.try_element_at(ctx, name), token)
        return F.when(F.startswith(token, F.lit("{{")), known).otherwise(token)

    return F.array_join(F.transform(tokens, resolve), "")
