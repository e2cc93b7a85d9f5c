"""Rewriting documents by their schema: filling templates, coercing types."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.template import render
from quern.functions.variants import as_array, as_object, on_value, parse_exact, text_of
from quern.operators.schema_rules import GENERATE, plain, resolve_ref


def _constant(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def _is_container(schema: dict) -> bool:
    return (schema.get("type") == "object" and "properties" in schema) or (
        schema.get("type") == "array" and bool(schema.get("items"))
    )


def _typed(text: Column, declared: Any) -> Column:
    """A rendered text as the declared type; stays text when it does not fit."""
    as_text = text.cast("variant")
    if declared in ("integer", "number"):
        return F.coalesce(text.try_cast("bigint").cast("variant"), text.try_cast("double").cast("variant"), as_text)
    if declared == "boolean":
        return F.when(text.isin("true", "false"), (text == "true").cast("variant")).otherwise(as_text)
    return as_text


def fill_fields(schema: dict, doc: Column, ctx: Column, compat: bool = False) -> Column:
    """Overwrite fields that carry a template, a value or a mapping.

    Only members present in the document change.  A template sees the context
    and the members next to it, which win, except for ``index``.  ``compat``
    leaves array elements alone and keeps rendered values as text.
    """
    def visit(node: Any, value: Column) -> Column:
        node = resolve_ref(node, schema)
        if not isinstance(node, dict):
            return value
        declared = node.get("properties") if node.get("type", "object") == "object" else None
        if declared and any(_touches(s, compat) for s in declared.values()):
            return _with(value, as_object, lambda m: _members(declared, m), value)
        if node.get("type") == "array" and node.get("items") and not compat and _touches(node["items"], compat):
            return _with(value, as_array, lambda a: F.transform(a, lambda e: visit(node["items"], e)), value)
        return value

    def _members(declared: dict, members: Column) -> Column:
        def beside(name: str) -> Column:
            own = F.try_element_at(ctx, F.lit(name))
            if name == "index":
                return own
            return F.coalesce(text_of(F.try_element_at(members, F.lit(name))), own)

        def change(key: Column, value: Column) -> Column:
            out = None
            for name, sub in declared.items():
                if not _touches(sub, compat):
                    continue
                new = _filled(sub, value, beside)
                out = F.when(key == name, new) if out is None else out.when(key == name, new)
            return out.otherwise(value)

        return F.transform_values(members, change)

    def _filled(sub: dict, value: Column, beside) -> Column:
        settings = (sub.get(GENERATE) or {}) if not _is_container(sub) else {}
        declared = None if compat else sub.get("type")
        if settings.get("template"):
            return _typed(render(plain(settings["template"]), beside), declared)
        if settings.get("value"):
            return _typed(render(plain(settings["value"]), lambda n: F.try_element_at(ctx, F.lit(n))), declared)
        if settings.get("mapping"):
            def swap(d: Column) -> Column:
                out = d["v"]
                for source, target in settings["mapping"].items():
                    if target or not compat:
                        out = F.when(d["text"] == source, _constant(target)).otherwise(out)
                return out

            return on_value(value, swap)
        return visit(sub, value)

    return F.get(F.transform(F.array(doc), lambda d: visit(schema, d)), F.lit(0))


def _with(value: Column, read, rebuild, otherwise: Column) -> Column:
    """Rebuild a value of the kind ``read`` gives, read once; other kinds pass through."""
    made = F.transform(F.array_compact(F.array(read(value))), lambda part: F.to_variant_object(rebuild(part)))
    return F.coalesce(F.get(made, F.lit(0)), otherwise)


def _touches(schema: Any, compat: bool) -> bool:
    """Whether anything at or below this node can be overwritten."""
    if not isinstance(schema, dict):
        return False
    settings = schema.get(GENERATE) or {}
    if not _is_container(schema) and any(settings.get(k) for k in ("template", "value", "mapping")):
        return True
    if any(_touches(s, compat) for s in (schema.get("properties") or {}).values()):
        return True
    return not compat and _touches(schema.get("items"), compat)


def coerce(schema: dict, doc: Column) -> Column:
    """Cast scalars to their declared type, add defaults, drop undeclared members.

    Members are dropped only where ``additionalProperties`` is false.  What
    cannot be cast stays as it is and fails the check afterwards.
    """
    def visit(node: Any, value: Column) -> Column:
        node = resolve_ref(node, schema)
        if not isinstance(node, dict):
            return value
        if node.get("properties") or node.get("additionalProperties") is False:
            return _with(value, as_object, lambda m: _members(node, m), _scalar(node.get("type"), value))
        if isinstance(node.get("items"), dict):
            return _with(value, as_array, lambda a: F.transform(a, lambda e: visit(node["items"], e)), value)
        return _scalar(node.get("type"), value)

    def _members(node: dict, members: Column) -> Column:
        declared = node.get("properties") or {}
        names = F.array(*[F.lit(k) for k in declared]) if declared else F.array().cast("array<string>")
        closed = node.get("additionalProperties") is False
        kept = F.map_filter(members, lambda k, _: F.lit(not closed) & ~F.array_contains(names, k))
        if not declared:
            return kept
        values = []
        for name, sub in declared.items():
            member = F.try_element_at(members, F.lit(name))
            if isinstance(sub, dict) and "default" in sub:
                member = F.coalesce(member, _constant(sub["default"]))
            values.append(F.when(member.isNotNull(), visit(sub, member)))
        given = F.map_filter(F.map_from_arrays(names, F.array(*values)), lambda _, v: v.isNotNull())
        return F.map_concat(kept, given)

    return F.get(F.transform(F.array(doc), lambda d: visit(schema, d)), F.lit(0))


def _scalar(declared: Any, value: Column) -> Column:
    names = declared if isinstance(declared, list) else [declared]
    if len(names) != 1 or names[0] not in ("string", "number", "integer", "boolean", "null"):
        return value
    name = names[0]

    def cast(d: Column) -> Column:
        kind, text, n = d["kind"], d["text"], d["n"]
        if name == "string":
            new = F.when(kind.isin("number", "boolean"), text.cast("variant")).when(kind == "null", F.lit("").cast("variant"))
        elif name in ("number", "integer"):
            parsed = on_value(parse_exact(F.trim(text)), lambda p: F.when(
                p["n"].isNotNull() & (F.lit(name == "number") | (p["n"] == F.rint(p["n"]))), p["v"]
            ))
            new = (
                F.when(kind == "boolean", F.when(text == "true", 1).otherwise(0).cast("variant"))
                .when(kind == "null", F.lit(0).cast("variant"))
                .when(kind == "string", parsed)
            )
        elif name == "boolean":
            yes = ((kind == "string") & (text == "true")) | (n == 1)
            no = ((kind == "string") & (text == "false")) | (n == 0) | (kind == "null")
            new = F.when(yes, F.lit(True).cast("variant")).when(no, F.lit(False).cast("variant"))
        else:
            nothing = ((kind == "string") & (text == "")) | (n == 0) | ((kind == "boolean") & (text == "false"))
            new = F.when(nothing, _constant(None))
        return F.coalesce(new, d["v"])

    return on_value(value, cast)
