"""Helpers over VARIANT values: kinds, JSON text, parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import number_text


def parse_exact(text: Column) -> Column:
    """Parse JSON text; NULL unless the whole text is exactly one JSON value.

    ``try_parse_json`` stops after the first value and ignores what follows, so
    the text is parsed as the first element of a two-element array whose second
    element is a hash of the text: trailing content moves or breaks that element.
    """
    parsed = F.transform(F.array(text), lambda t: F.struct(
        F.xxhash64(t).alias("mark"),
        F.try_parse_json(F.concat(F.lit("["), t, F.lit(","), F.xxhash64(t).cast("string"), F.lit("]"))).alias("pair"),
    ))

    def whole(p: Column) -> Column:
        one = F.try_variant_get(p["pair"], "$[1]", "bigint") == p["mark"]
        return F.when(one & F.try_variant_get(p["pair"], "$[2]", "variant").isNull(), F.try_variant_get(p["pair"], "$[0]", "variant"))

    return F.get(F.transform(parsed, whole), F.lit(0))


def path_of(*keys: str) -> str:
    """A variant path for a chain of object keys."""
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


def child(value: Column, key: str) -> Column:
    """The value under ``key``; SQL NULL when the key is missing."""
    return F.try_variant_get(value, path_of(key), "variant")


def as_object(value: Column) -> Column:
    """The object as a map, NULL for any other kind."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_number(name: Column) -> Column:
    return name.isin("BIGINT", "DOUBLE") | name.startswith("DECIMAL")


def _kind(name: Column) -> Column:
    return (
        F.when(name == "STRING", "string")
        .when(is_number(name), "number")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
    )


def flat_text(json_text: Column) -> Column:
    """How a JSON list reads inside a sentence, lists in lists at any depth run together.

    Its tokens are read once: commas outside objects stay, brackets go, an object is
    ``[object Object]``, null is empty, strings lose their quotes.
    """
    tokens = F.regexp_extract_all(json_text, F.lit(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"]+'), F.lit(0))

    def read(state: Column, token: Column) -> Column:
        depth = state["depth"]
        inside = F.when(token == "{", depth + 1).when(token == "}", depth - 1).otherwise(depth)
        word = (
            F.when(token == "}", F.when(depth == 1, "[object Object]").otherwise("")).when((depth > 0) | token.isin("{", "[", "]", ":", "null"), "")
            .when(token.startswith('"'), F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]"))
            .when(token.isin(",", "true", "false"), token).otherwise(number_text(token.try_cast("double")))
        )
        return F.struct(F.concat(state["text"], F.coalesce(word, F.lit(""))).alias("text"), inside.alias("depth"))

    return F.aggregate(tokens, F.struct(F.lit("").alias("text"), F.lit(0).alias("depth")), read, lambda s: s["text"])


def _described(pairs: Column, nested: bool) -> Column:
    """Describe an array of ``struct(key, v)``.

    Each step is its own ``transform`` so that every part is computed once; inside
    the next lambda it is a plain reference.
    """
    named = F.transform(pairs, lambda p: F.struct(
        p["key"].alias("key"), p["v"].alias("v"), F.schema_of_variant(p["v"]).alias("name")
    ))

    def read(p: Column) -> Column:
        name, value = p["name"], p["v"]
        text = F.when(name.isin("STRING", "BOOLEAN"), as_string(value)).when(name == "VOID", "null")
        text = text.when(name.startswith("OBJECT"), "[object Object]")
        if nested:
            elements = F.transform(as_array(value), lambda e: F.struct(F.lit("").alias("key"), e.alias("v")))
            texts = F.transform(
                _described(elements, False),
                lambda d: F.when(d["kind"] == "null", "").when(d["kind"] == "array", flat_text(d["text"])).otherwise(d["text"]),
            )
            text = text.when(name.startswith("ARRAY"), F.array_join(texts, ",", ""))
        else:
            text = text.when(name.startswith("ARRAY"), F.to_json(value))
        return F.struct(
            p["key"].alias("key"), value.alias("v"), _kind(name).alias("kind"),
            F.when(is_number(name), as_double(value)).alias("n"), text.alias("text"),
        )

    return F.transform(F.transform(named, read), lambda p: F.struct(
        p["key"].alias("key"), p["v"].alias("v"), p["kind"].alias("kind"), p["n"].alias("n"),
        F.coalesce(p["text"], number_text(p["n"])).alias("text"),
    ))


def describe(pairs: Column) -> Column:
    """``array<struct<key,v>>`` to ``array<struct<key,v,kind,n,text>>``.

    ``kind`` is string, number, boolean, null, object or array and NULL for a
    missing value; ``n`` the double of a number; ``text`` the value as it reads
    inside a sentence: whole numbers without a fraction, lists comma-joined, an
    object as ``[object Object]``.
    """
    return _described(pairs, True)


def on_value(value: Column, fn: Callable[[Column], Column], lists: bool = False) -> Column:
    """``fn`` of the described value, computed once.

    Without ``lists`` the text of a list is its JSON, which costs nothing unless
    it is asked for.
    """
    one = F.array(F.struct(F.lit("").alias("key"), value.alias("v")))
    return F.get(F.transform(_described(one, lists), fn), F.lit(0))


def is_set(d: Column) -> Column:
    """Present and not null, empty text, 0 or false."""
    empty = (
        (d["kind"] == "null") | ((d["kind"] == "string") & (d["text"] == "")) | F.coalesce(d["n"] == 0, F.lit(False))
        | ((d["kind"] == "boolean") & (d["text"] == "false"))
    )
    return d["kind"].isNotNull() & ~empty


def scalar_kind(value: Column) -> Column:
    """Kind of a value; NULL when missing."""
    return F.get(F.transform(F.transform(F.array(value), lambda v: F.schema_of_variant(v)), _kind), F.lit(0))


def text_of(value: Column) -> Column:
    return on_value(value, lambda d: d["text"], lists=True)


def set_text(value: Column) -> Column:
    """Text of a value that counts as set, else NULL."""
    return on_value(value, lambda d: F.when(is_set(d), d["text"]))
