"""Configurations as data: overview, checks, merging, option overrides."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.variants import as_array, as_object, on_value, set_text

MERGE_DEPTH = 24


def at(doc: Column, *keys: str) -> Column:
    """Member at a path of names; NULL when missing."""
    return F.try_variant_get(doc, "$" + "".join(f"['{k}']" for k in keys), "variant")


def _set_text(doc: Column, *keys: str) -> Column:
    """Text of a member, NULL when it is missing, empty, null, false or 0."""
    return set_text(at(doc, *keys))


def overview(doc: Column) -> dict[str, Column]:
    """Summary columns of a configuration with their defaults."""
    properties = as_object(at(doc, "schema", "properties"))
    return {
        "name": F.coalesce(_set_text(doc, "meta", "name"), F.lit("Unnamed")),
        "version": F.coalesce(_set_text(doc, "meta", "version"), F.lit("1.0")),
        "model": F.coalesce(_set_text(doc, "api", "model"), F.lit("default")),
        "schema_type": F.coalesce(_set_text(doc, "schema", "type"), F.lit("unknown")),
        "properties_count": F.coalesce(F.size(F.map_keys(properties)), F.lit(0)),
        "tasks_count": F.coalesce(F.array_size(as_array(at(doc, "generation", "tasks"))), F.lit(0)),
        "output_path": F.coalesce(_set_text(doc, "output", "outputPath"), F.lit("none")),
        "max_tokens": F.coalesce(_set_text(doc, "api", "maxTokens").try_cast("double"), F.lit(4000.0)),
        "temperature": F.coalesce(_set_text(doc, "api", "temperature").try_cast("double"), F.lit(0.7)),
    }


def field_count(doc: Column) -> Column:
    """Properties of the list items when the schema wraps a list, else of the schema."""
    inner = as_object(at(doc, "schema", "properties", "items", "items", "properties"))
    outer = as_object(at(doc, "schema", "properties"))
    return F.coalesce(F.size(F.map_keys(inner)), F.size(F.map_keys(outer)), F.lit(0))


def is_runnable(doc: Column) -> Column:
    """Names a model and holds something to generate from."""
    model = F.coalesce(_set_text(doc, "api", "model"), _set_text(doc, "model"))
    source = F.coalesce(
        _set_text(doc, "schema"), _set_text(doc, "prompts"), _set_text(doc, "tasks"), _set_text(doc, "generation", "tasks")
    )
    return model.isNotNull() & source.isNotNull()


def problems(doc: Column) -> Column:
    """All rules a parsed configuration breaks."""
    json_format = F.coalesce(_set_text(doc, "output", "format"), F.lit("json")) == "json"
    schema = _set_text(doc, "schema")
    heat, limit = at(doc, "api", "temperature"), at(doc, "api", "maxTokens")
    # Values of any kind but a number are out of range.
    heat_ok = F.coalesce(on_value(heat, lambda d: d["n"].between(0, 2)), F.lit(False))
    limit_ok = F.coalesce(on_value(limit, lambda d: d["n"] >= 1), F.lit(False))
    return F.array_compact(F.array(
        F.when(json_format & schema.isNull(), "Config is missing required fields: schema"),
        F.when(json_format & schema.isNotNull() & _set_text(doc, "schema", "type").isNull(), "Schema must have a type property"),
        F.when(heat.isNotNull() & ~heat_ok, "Temperature must be a number between 0 and 2"),
        F.when(limit.isNotNull() & ~limit_ok, "maxTokens must be a positive number"),
    ))


def merge(base: Column, override: Column, depth: int = MERGE_DEPTH) -> Column:
    """Deep merge of two documents: objects join, anything else is replaced.

    Documents nested deeper than ``depth`` objects on both sides stop the job
    instead of being merged wrongly.
    """
    def pick(_: Column, a: Column, b: Column) -> Column:
        return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(merge(a, b, depth - 1))

    def joined(p: Column) -> Column:
        if depth == 0:
            value = F.raise_error(F.lit(f"documents are nested deeper than {MERGE_DEPTH} levels")).cast("variant")
        else:
            value = F.to_variant_object(F.map_zip_with(p["left"], p["right"], pick))
        return F.when(p["left"].isNotNull() & p["right"].isNotNull(), value)

    # Both objects are read once.
    both = _bound(F.struct(as_object(base).alias("left"), as_object(override).alias("right")), joined)
    return F.when(override.isNull(), base).otherwise(F.coalesce(both, override))


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def with_options(doc: Column, options: Mapping[str, Any]) -> Column:
    """Run options on top of a configuration.

    model, temperature, max_tokens, output, and count for the first task.
    """
    api = {}
    if options.get("model"):
        api["model"] = F.lit(options["model"]).cast("variant")
    if options.get("temperature") is not None:
        api["temperature"] = F.lit(float(options["temperature"])).cast("variant")
    if options.get("max_tokens"):
        api["maxTokens"] = F.lit(int(options["max_tokens"])).cast("variant")
    sections = []
    if api:
        sections.append(F.struct(*[v.alias(k) for k, v in api.items()]).alias("api"))
    if options.get("output"):
        sections.append(F.struct(F.lit(options["output"]).alias("outputPath")).alias("output"))
    out = merge(doc, F.to_variant_object(F.struct(*sections)), 3) if sections else doc
    if options.get("count"):
        wanted = F.to_variant_object(F.struct(F.lit(int(options["count"])).alias("count")))

        def counted(p: Column) -> Column:
            changed = F.transform(p["tasks"], lambda t, i: F.when(i == 0, merge(t, wanted, 2)).otherwise(t))
            section = F.to_variant_object(F.struct(F.struct(F.to_variant_object(changed).alias("tasks")).alias("generation")))
            return F.when(F.size(p["tasks"]) > 0, _bound(F.struct(p["doc"].alias("doc"), section.alias("section")), lambda q: merge(q["doc"], q["section"], 3))).otherwise(p["doc"])

        out = _bound(out, lambda d: _bound(F.struct(d.alias("doc"), as_array(at(d, "generation", "tasks")).alias("tasks")), counted))
    return out
