"""Schemas as data: their fields, references, lint findings and overview."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.variants import as_object, child
from quern.operators.schema_rules import GENERATE, lint_types, plain

# Keywords listed as constraints of a field.
CONSTRAINTS = (
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems",
    "maxItems", "uniqueItems", "minProperties", "maxProperties", "required", "const", "multipleOf",
)
UNIONS = ("oneOf", "anyOf", "allOf")
#: What the lint reports for a schema that cannot be parsed.
UNREADABLE = "(unreadable)"


def flatten_schema(schema: Any) -> list[dict]:
    """The leaf fields of one schema.

    Objects with properties and arrays with items are walked through (``[]`` for
    an element); any other node with a type or generation settings is a field.
    """
    fields: list[dict] = []
    open_nodes: list[tuple[Any, tuple[str, ...]]] = [(schema, ())]
    while open_nodes:  # the next node is the last one, so nesting has no limit
        node, path = open_nodes.pop()
        if not isinstance(node, dict):
            continue
        below: list[tuple[Any, str]] = []
        if node.get("type") == "object" and isinstance(node.get("properties"), dict):
            below += [(sub, key) for key, sub in node["properties"].items()]
        elif node.get("type") == "array" and node.get("items"):
            below.append((node["items"], "[]"))
        elif node.get(GENERATE) or node.get("type"):
            fields.append({
                "path": ".".join(path),
                "type": node.get("type"),
                "enum": node.get("enum"),
                "format": node.get("format"),
                "constraints": {k: node[k] for k in CONSTRAINTS if k in node},
                "settings": node.get(GENERATE) or None,
            })
        for keyword in UNIONS:
            below += [(sub, f"{keyword}[{i}]") for i, sub in enumerate(node.get(keyword) or [])]
        open_nodes += [(sub, path + (step,)) for sub, step in reversed(below)]
    return fields


def _references(schema: Any) -> list[tuple[str, str, str]]:
    """(place, reference, state) with state ok, dangling or cyclic."""
    found: list[tuple[str, str, str]] = []

    def target_of(ref: str) -> Any:
        target = schema
        for part in ref.removeprefix("#/").split("/"):
            target = target.get(part) if isinstance(target, dict) else None
        return target

    def state_of(ref: str) -> str:
        seen, target = {ref}, target_of(ref)
        while isinstance(target, dict) and isinstance(target.get("$ref"), str):
            if target["$ref"] in seen:
                return "cyclic"
            seen.add(target["$ref"])
            target = target_of(target["$ref"])
        return "ok" if target else "dangling"

    def visit(node: Any, at: str) -> None:
        if isinstance(node, list):
            for i, sub in enumerate(node):
                visit(sub, f"{at}/{i}")
        elif isinstance(node, dict):
            if isinstance(node.get("$ref"), str):
                found.append((at or "/", node["$ref"], state_of(node["$ref"])))
            for key, sub in node.items():
                visit(sub, f"{at}/{key}")

    visit(schema, "")
    return found


#: Rows that a task holds before it hands them on.
ROWS_AT_ONCE = 20_000


def _per_schema(df: DataFrame, doc: str, keep: list[str], rows_of, schema: str, unreadable: Sequence[tuple] = ()) -> DataFrame:
    """Run a small function on every schema text, in Arrow batches; ``unreadable`` are the rows of a text that is no JSON."""
    names = [part.split(" ")[0] for part in schema.split(", ")]
    types = dict(df.select(*keep).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.itertuples(index=False, name=None):
                *ids, text = record
                try:
                    parsed = json.loads(text)
                except (TypeError, ValueError):
                    out += [(*ids, *row) for row in unreadable]
                    continue
                out += [(*ids, *row) for row in rows_of(parsed)]
                if len(out) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(out, columns=[*keep, *names])
                    out = []
            yield pd.DataFrame(out, columns=[*keep, *names])

    head = ", ".join(f"{k} {types[k]}" for k in keep)
    return df.select(*keep, doc).mapInPandas(run, f"{head}, {schema}")


def corpus_fields(df: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """One row per field of every schema in the column ``doc``."""
    def rows(schema: Any) -> list[tuple]:
        out = []
        for no, f in enumerate(flatten_schema(schema)):
            out.append((
                no, f["path"], None if f["type"] is None else plain(f["type"]),
                None if f["enum"] is None else [plain(v) for v in f["enum"]], f["format"],
                [(k, json.dumps(v, ensure_ascii=False)) for k, v in f["constraints"].items()],
                None if f["settings"] is None else json.dumps(f["settings"], ensure_ascii=False),
            ))
        return out

    table = _per_schema(
        df, doc, keep, rows,
        "field_no int, path string, type string, enum array<string>, format string, "
        "pairs array<struct<key:string,value:string>>, settings string",
    )
    return table.withColumn("constraints", F.map_from_entries("pairs")).drop("pairs")


def corpus_references(df: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """Every ``$ref`` with its state: ok, dangling or cyclic."""
    return _per_schema(df, doc, keep, _references, "place string, ref string, state string")


def corpus_lint(df: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """Places of unknown type names; the place of a schema that is null or no JSON is ``UNREADABLE``."""
    return _per_schema(df, doc, keep, lambda s: [(p,) for p in lint_types(s)], "place string", [(UNREADABLE,)])


def fields_by_path(fields: DataFrame, pattern: str) -> DataFrame:
    """Unanchored match; ``*`` stands for any text."""
    return fields.filter(F.rlike("path", F.lit(pattern.replace("*", ".*"))))


def fields_of_type(fields: DataFrame, name: str) -> DataFrame:
    return fields.filter(F.col("type") == name)


def generatable_fields(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("settings").isNotNull())


def schema_overview(df: DataFrame, keep: list[str], schema: str = "schema") -> DataFrame:
    """Top-level properties of VARIANT schemas: type, required, description."""
    doc = F.col(schema)
    opened = df.select(
        *keep,
        F.try_variant_get(doc, "$.type", "string").alias("schema_type"),
        F.coalesce(F.try_variant_get(doc, "$.required", "array<string>"), F.array().cast("array<string>")).alias("_need"),
        F.explode(as_object(child(doc, "properties"))).alias("name", "_p"),
    )

    def text(path: str) -> Column:
        return F.nullif(F.try_variant_get("_p", path, "string"), F.lit(""))

    return opened.select(
        *keep, "schema_type", "name",
        F.try_variant_get("_p", "$.type", "string").alias("type"),
        F.array_contains("_need", F.col("name")).alias("required"),
        F.coalesce(text("$.description"), text(f"$['{GENERATE}'].description"), F.lit("")).alias("description"),
    )
