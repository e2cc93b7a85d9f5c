"""Example documents from a schema: an offline source of answers."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.schema_rules import GENERATE


# What a node without a fixed value becomes, by its type; other types give null.
PRODUCERS: dict[str, Callable[[dict], Any]] = {
    "array": lambda node: [example_value(item) for item in [node.get("items")] if item],
    "boolean": lambda node: True,
    "integer": lambda node: node.get("minimum") or 0,
    "number": lambda node: node.get("minimum") or 0,
    "object": lambda node: {name: example_value(member) for name, member in (node.get("properties") or {}).items()},
    "string": lambda node: (node.get(GENERATE) or {}).get("description") or "example string",
}


def example_value(node: dict) -> Any:
    """One example: the first that is set of value, template and first choice, else what the type produces."""
    own = node.get(GENERATE) or {}
    fixed = [own.get("value"), own.get("template")]
    told = next((v for v in fixed if v), None)
    if told is not None:
        return told
    choices = node.get("enum") or ()
    return choices[0] if choices else PRODUCERS.get(node.get("type"), lambda _: None)(node)


def example_document(schema: dict) -> Any:
    """Example of a whole schema; settings of its root do not count, and a root without members is an empty object."""
    inside = {"object": "properties", "array": "items"}.get(schema.get("type"))
    return PRODUCERS[schema["type"]](schema) if inside and schema.get(inside) else {}


def example_json(schema: dict) -> Column:
    return F.lit(json.dumps(example_document(schema), ensure_ascii=False))


def varied_json(schema: dict, seed: Column) -> Column:
    """A document per ``seed`` that varies within the declared limits.

    Choices rotate through the enum, numbers move between minimum and maximum,
    texts carry the seed; fixed values and templates stay.  The same seed gives
    the same document.
    """
    def value(node: dict, name: str) -> Column:
        settings = node.get(GENERATE) or {}
        turn = F.pmod(F.xxhash64(seed, F.lit(name)), F.lit(1 << 30))
        for key in ("value", "template"):
            if settings.get(key):
                return F.lit(json.dumps(settings[key], ensure_ascii=False))
        if node.get("enum"):
            choices = F.array(*[F.lit(json.dumps(v, ensure_ascii=False)) for v in node["enum"]])
            return F.get(choices, F.pmod(turn, F.lit(len(node["enum"]))).cast("int"))
        kind = node.get("type")
        if kind in ("number", "integer"):
            low = int(node.get("minimum") or 0)
            high = int(node.get("maximum", low + 100))
            return (F.lit(low) + F.pmod(turn, F.lit(max(high - low + 1, 1)))).cast("string")
        if kind == "boolean":
            return F.when(turn % 2 == 0, "true").otherwise("false")
        if kind == "array":
            inner = [value(node["items"], f"{name}[]")] if node.get("items") else []
            return F.concat(F.lit("["), *inner, F.lit("]"))
        if kind == "object":
            parts: list[Column] = [F.lit("{")]
            for i, (key, sub) in enumerate((node.get("properties") or {}).items()):
                parts += [F.lit(("," if i else "") + json.dumps(key, ensure_ascii=False) + ":"), value(sub, f"{name}.{key}")]
            return F.concat(*parts, F.lit("}"))
        if kind == "string":
            text = F.concat(F.lit((settings.get("description") or "example string") + " "), seed.cast("string"))
            quoted = F.to_json(F.array(text))
            return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
        return F.lit("null")

    return value(schema, "$")
