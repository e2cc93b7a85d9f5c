"""A JSON Schema as one Spark column: the list of errors of a document.

The schema is read once on the driver and becomes column expressions over a
VARIANT document, so checking a document needs no Python and no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.formats import NUMBER_FORMATS, has_format, matches
from quern.functions.pinned import pin
from quern.functions.text import number_text, utf16_length
from quern.functions.variants import as_double, is_number, path_of
from quern.session import materialize, scratch_path

ERROR_TYPE = "struct<path:string,keyword:string,message:string>"
ERRORS_TYPE = f"array<{ERROR_TYPE}>"

# The vendor keyword with generation settings, and the phrase that
# starts a "must not contain" requirement.
GENERATE = "x-llm-generate"
FORBIDDEN_PHRASE = "НЕ содержать "

#: Sub-schemas that the columns of one recursion step may be made of, and how often a reference is written out in it.
STEP_SIZE, STEP_DEPTH = 60, 8
TYPES = ("string", "number", "integer", "boolean", "object", "array", "null")


#: A rule still to be applied to a value of the document.
CALLS_TYPE = "array<struct<rule:int,path:string,value:variant>>"


def no_errors() -> Column:
    return F.array().cast(ERRORS_TYPE)


def no_calls() -> Column:
    return F.array().cast(CALLS_TYPE)


def plain(value: Any) -> str:
    """A schema constant as it reads inside a message."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, list):
        return ",".join("" if v is None else plain(v) for v in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def target_of(ref: str, root: Any) -> Any:
    """What a reference inside the document points at."""
    target: Any = root
    for part in ref.removeprefix("#").split("/")[1:] if ref.startswith("#") else [ref]:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        if isinstance(target, list):
            target = target[int(part)] if part.isdigit() and int(part) < len(target) else None
        else:
            target = target.get(part) if isinstance(target, dict) else None
        if target is None:
            raise ValueError(f"Cannot resolve reference: {ref}")
    return target


def resolve_ref(schema: Any, root: Any, seen: tuple[str, ...] = ()) -> Any:
    """Follow ``$ref`` inside the same document; keywords next to it win."""
    if not isinstance(schema, dict) or "$ref" not in schema:
        return schema
    ref = schema["$ref"]
    if ref in seen:
        raise ValueError(f"cyclic reference: {ref}")
    return _merged(resolve_ref(target_of(ref, root), root, (*seen, ref)), schema)


def _merged(target: Any, schema: dict) -> Any:
    beside = {k: v for k, v in schema.items() if k != "$ref"}
    return {**target, **beside} if isinstance(target, dict) else target


class Reads:
    """The values one document, or one list element, is read for.

    Rules refer to them by name; the struct of all of them is built once per
    document before any rule runs, so nothing is read or parsed per rule.
    """

    def __init__(self, base: Column | dict[str, Column] | None):
        self.base = base            # what was read, by name; None while only collecting
        self.wanted: dict[tuple, Callable[[Column], Column]] = {}

    def get(self, kind: str, keys: tuple[str, ...], read: Callable[[Column], Column]) -> Column:
        found = list(self.wanted)
        if (kind, keys) not in self.wanted:
            self.wanted[(kind, keys)] = read
            found.append((kind, keys))
        name = f"r{found.index((kind, keys))}"
        return F.lit(None) if self.base is None else self.base[name]

    def columns(self, doc: Column) -> list[Column]:
        return [read(doc).alias(f"r{i}") for i, read in enumerate(self.wanted.values())]


@dataclass(frozen=True)
class Node:
    """One value of the document while its rules are put together."""

    reads: Reads
    keys: tuple[str, ...]   # place below the document or list element
    path: tuple             # parts of its JSON pointer
    where: str              # place of its rules in the schema
    schema: dict
    chain: tuple[str, ...] = ()  # references followed on the way here

    def _get(self, kind: str, cast: str) -> Column:
        return self.reads.get(kind, self.keys, lambda doc: F.try_variant_get(doc, path_of(*self.keys), cast))

    @staticmethod
    def _name(doc: Column, keys: tuple[str, ...]) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, path_of(*keys), "variant"))

    @property
    def value(self) -> Column:
        return self._get("v", "variant")

    @property
    def name(self) -> Column:
        """Spark type name of the value; NULL when it is missing."""
        return self.reads.get("n", self.keys, lambda doc: self._name(doc, self.keys))

    @property
    def number(self) -> Column:
        """Double of a number, NULL for any other kind."""
        return self.reads.get("d", self.keys, lambda doc: F.when(
            is_number(self._name(doc, self.keys)), F.try_variant_get(doc, path_of(*self.keys), "double")
        ))

    @property
    def string(self) -> Column:
        return self.reads.get("s", self.keys, lambda doc: F.when(
            self._name(doc, self.keys) == "STRING", F.try_variant_get(doc, path_of(*self.keys), "string")
        ))

    @property
    def boolean(self) -> Column:
        return self.reads.get("b", self.keys, lambda doc: F.when(
            self._name(doc, self.keys) == "BOOLEAN", F.try_variant_get(doc, path_of(*self.keys), "boolean")
        ))

    @property
    def fields(self) -> Column:
        return self._get("m", "map<string,variant>")

    @property
    def items(self) -> Column:
        return self._get("a", "array<variant>")

    def _members_seen(self) -> list[tuple[str, ...]]:
        """Places of a few declared scalars below: each is cheap proof of the objects above it."""
        found: list[tuple[str, ...]] = []

        def visit(schema: dict, keys: tuple[str, ...]) -> None:
            for key, sub in schema.get("properties", {}).items():
                if not _looks_inside(sub):
                    found.append((*keys, key))
                elif isinstance(sub, dict):
                    visit(sub, (*keys, key))

        visit(self.schema, self.keys)
        return found[:3]

    @property
    def is_object(self) -> Column:
        """An object; only one without a known member has to be looked at as a whole."""
        def read(doc: Column) -> Column:
            known = F.coalesce(self._name(doc, self.keys).startswith("OBJECT"), F.lit(False))
            for keys in reversed(self._members_seen()):
                known = self._name(doc, keys).isNotNull() | known
            return known

        return self.reads.get("o", self.keys, read)

    @property
    def present(self) -> Column:
        if not _looks_inside(self.schema):
            return self.name.isNotNull()

        def read(doc: Column) -> Column:
            there = F.try_variant_get(doc, path_of(*self.keys), "variant").isNotNull()
            for keys in reversed(self._members_seen()):
                there = self._name(doc, keys).isNotNull() | there
            return there

        return self.reads.get("p", self.keys, read)

    def member(self, key: str, schema: dict, path: tuple, where: str) -> "Node":
        return Node(self.reads, (*self.keys, key), path, where, schema, self.chain)

    def lacks(self, key: str) -> Column:
        sub = self.schema.get("properties", {}).get(key)
        return ~self.member(key, sub if isinstance(sub, dict) else {}, (), "").present & self.is_object

    def has(self, key: str) -> Column:
        sub = self.schema.get("properties", {}).get(key)
        return self.member(key, sub if isinstance(sub, dict) else {}, (), "").present

    def is_type(self, name: str) -> Column:
        if name == "object":
            return self.is_object
        if name == "array" and (self.schema.get("items") is not None or _looks_inside(self.schema)):
            return self.items.isNotNull()
        if name == "number":
            return is_number(self.name)
        if name == "integer":
            return (self.name == "BIGINT") | F.coalesce(self.number == F.rint(self.number), F.lit(False))
        if name == "array":
            return self.name.startswith("ARRAY")
        return self.name == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]

    def error(self, keyword: str, message: str | Column) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.struct(
            pointer(self.path).alias("path"), F.lit(keyword).alias("keyword"), text.alias("message")
        )

    def fail(self, bad: Column, keyword: str, message: str | Column) -> Column:
        """A list with one error, or an empty one."""
        return F.when(bad, F.array(self.error(keyword, message)).cast(ERRORS_TYPE)).otherwise(no_errors())


def pointer(parts: tuple) -> Column:
    if not parts:
        return F.lit("/")
    if all(isinstance(p, str) for p in parts):
        return F.lit("".join(parts))
    if len(parts) == 1:
        return F.when(parts[0] == "", F.lit("/")).otherwise(parts[0])
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def step(key: str) -> str:
    return "/" + key.replace("~", "~0").replace("/", "~1")


Rule = Callable[[Node, Any], "Column | None"]
_RULES: dict[str, Rule] = {}


def register_rule(keyword: str, rule: Rule) -> None:
    """Add a keyword: ``rule(node, parameter)`` gives a list of errors (see ``Node.fail``)."""
    _RULES[keyword] = rule


def _rule(keyword: str):
    def keep(fn: Rule) -> Rule:
        register_rule(keyword, fn)
        return fn

    return keep


@_rule("type")
def _type(node: Node, param: Any) -> Column:
    names = param if isinstance(param, list) else [param]
    fits = node.is_type(names[0])
    for name in names[1:]:
        fits = fits | node.is_type(name)
    if node.schema.get("nullable") is True:
        fits = fits | node.is_type("null")
    of = "array of " if "items" in node.where else ""
    return node.fail(~F.coalesce(fits, F.lit(False)), "type", f"should be {of}{','.join(names)}")


def _equals(node: Node, constant: Any) -> Column:
    if isinstance(constant, bool):
        same = node.boolean == F.lit(constant)
    elif constant is None:
        same = node.name == "VOID"
    elif isinstance(constant, (int, float)):
        same = node.number == F.lit(float(constant))
    elif isinstance(constant, str):
        same = node.string == F.lit(constant)
    else:
        text = json.dumps(constant, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        whole = node.name.startswith("OBJECT") | node.name.startswith("ARRAY")
        same = whole & (F.to_json(node.value.cast("variant")) == F.lit(text))
    return F.coalesce(same, F.lit(False))


@_rule("enum")
def _enum(node: Node, param: list) -> Column:
    fits = F.lit(False)
    for constant in param:
        fits = fits | _equals(node, constant)
    return node.fail(~fits, "enum", f"should be one of: {', '.join('' if v is None else plain(v) for v in param)}")


@_rule("const")
def _const(node: Node, param: Any) -> Column:
    return node.fail(~_equals(node, param), "const", "must be equal to constant")


@_rule("minLength")
def _min_length(node: Node, n: int) -> Column:
    return node.fail(F.char_length(node.string) < n, "minLength", f"should have minimum length of {plain(n)}")


@_rule("maxLength")
def _max_length(node: Node, n: int) -> Column:
    return node.fail(F.char_length(node.string) > n, "maxLength", f"should have maximum length of {plain(n)}")


@_rule("pattern")
def _pattern(node: Node, pattern: str) -> Column:
    return node.fail(~matches(node.string, pattern), "pattern", f'should match pattern "{pattern}"')


@_rule("format")
def _format(node: Node, name: str) -> Column | None:
    message = f'must match format "{name}"'
    if name in NUMBER_FORMATS:
        return node.fail(node.number.isNotNull() & ~NUMBER_FORMATS[name](node.number), "format", message)
    fits = has_format(node.string, name)
    return None if fits is None else node.fail(node.string.isNotNull() & ~fits, "format", message)


@_rule("minimum")
def _minimum(node: Node, n: float) -> Column:
    return node.fail(node.number < float(n), "minimum", f"should be >= {plain(n)}")


@_rule("maximum")
def _maximum(node: Node, n: float) -> Column:
    return node.fail(node.number > float(n), "maximum", f"should be <= {plain(n)}")


@_rule("exclusiveMinimum")
def _above(node: Node, n: float) -> Column:
    return node.fail(node.number <= float(n), "exclusiveMinimum", f"must be > {plain(n)}")


@_rule("exclusiveMaximum")
def _below(node: Node, n: float) -> Column:
    return node.fail(node.number >= float(n), "exclusiveMaximum", f"must be < {plain(n)}")


@_rule("multipleOf")
def _multiple(node: Node, n: float) -> Column:
    ratio = node.number / F.lit(float(n))
    return node.fail(ratio != F.rint(ratio), "multipleOf", f"must be multiple of {plain(n)}")


@_rule("minItems")
def _min_items(node: Node, n: int) -> Column:
    few = node.items.isNotNull() & (F.size(node.items) < n)
    return node.fail(few, "minItems", f"should have at least {plain(n)} items")


@_rule("maxItems")
def _max_items(node: Node, n: int) -> Column:
    return node.fail(node.items.isNotNull() & (F.size(node.items) > n), "maxItems", f"should have at most {plain(n)} items")


@_rule("uniqueItems")
def _unique(node: Node, wanted: bool) -> Column | None:
    if not wanted:
        return None
    # Numbers compare by value, everything else by its JSON text.
    keys = F.transform(node.items.cast("array<variant>"), lambda e: F.coalesce(_number_key(e), F.to_json(e)))
    twice = node.items.isNotNull() & (F.size(F.array_distinct(keys)) < F.size(keys))
    return node.fail(twice, "uniqueItems", "must NOT have duplicate items")


def _number_key(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return F.when(is_number(name), number_text(as_double(value)))


@_rule("minProperties")
def _min_properties(node: Node, n: int) -> Column:
    few = node.fields.isNotNull() & (F.size(node.fields) < n)
    return node.fail(few, "minProperties", f"must NOT have fewer than {plain(n)} properties")


@_rule("maxProperties")
def _max_properties(node: Node, n: int) -> Column:
    many = node.fields.isNotNull() & (F.size(node.fields) > n)
    return node.fail(many, "maxProperties", f"must NOT have more than {plain(n)} properties")


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda name: matches(name, pattern)


def _not(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda value: ~test(value)


def _joined(lists: list[Column]) -> Column:
    if not lists:
        return no_errors()
    return lists[0] if len(lists) == 1 else F.concat(*lists)


_INSIDE = (
    "properties", "required", "additionalProperties", "minProperties", "maxProperties", "patternProperties", "propertyNames", "dependencies",
)
_ELEMENTS = ("items", "minItems", "maxItems", "uniqueItems", "contains", "additionalItems")


def _looks_inside(schema: Any) -> bool:
    """Whether the rules of a value look at it as an object or a list."""
    if not isinstance(schema, dict):
        return False
    named = schema.get("type")
    names = named if isinstance(named, list) else [named]
    return "object" in names or "array" in names or any(k in schema for k in _INSIDE + _ELEMENTS)


class SchemaRules:
    """A schema ready to be applied to VARIANT columns.

    References that lead back to themselves are written out a few levels deep; what
    lies below is left as a *cut*, a rule that is applied to a value further down.
    ``add_errors`` then checks documents in steps, see ``_add_by_steps``; documents
    may be of any depth.
    """

    def __init__(self, schema: dict | bool):
        self.root = schema
        problem = next(iter(lint_types(schema)), None)
        if problem:
            raise ValueError(f"Invalid JSON Schema at field '{problem}'")
        self.recursive = _recursive_refs(schema)
        self.depth = STEP_DEPTH
        while True:
            #: Rules that a step applies, by number; the schema itself is the first.
            self.cuts: list[Any] = [schema]
            sizes = [self._find_cuts(cut) for cut in self.cuts]  # the list grows while it is read
            if max(sizes) <= STEP_SIZE or self.depth <= 1 or not self.recursive:
                break
            self.depth -= 1

    def _find_cuts(self, schema: Any, chain: tuple[str, ...] = ()) -> int:
        """Note the cuts of one rule; the number of sub-schemas that it is made of."""
        whole, chain, _ = self._followed(schema, chain, "")
        if whole is None:
            if schema not in self.cuts:
                self.cuts.append(schema)
            return 1
        size = 1
        for sub in _subschemas(whole):
            if size <= STEP_SIZE or self.depth <= 1:
                size += self._find_cuts(sub, chain)
        return size

    def _followed(self, schema: Any, chain: tuple[str, ...], where: str) -> tuple[Any, tuple[str, ...], str]:
        """The schema behind references, and its place; None for a cut."""
        if not isinstance(schema, dict) or "$ref" not in schema:
            return schema, chain, where
        ref = schema["$ref"]
        if ref in self.recursive:
            if chain.count(ref) >= self.depth:
                return None, chain, where
            chain = (*chain, ref)
        whole, chain, where = self._followed(target_of(ref, self.root), chain, ref)
        return (None, chain, where) if whole is None else (_merged(whole, schema), chain, where)

    # -- schema errors ---------------------------------------------------

    def schema_errors(self, doc: Column) -> Column:
        """Unsorted errors of the JSON Schema keywords; NULL documents have none."""
        if len(self.cuts) > 1:
            raise ValueError("a recursive schema is checked by add_errors, not by one column")
        return self._let(doc, lambda reads: self._errors(self.root, Node(reads, (), (), "#", {})))

    def custom_errors(self, doc: Column) -> Column:
        """Errors of the generation settings: lengths and forbidden words.

        Paths are dotted (``items[0].title``); the document itself has no rule.
        """
        return self._let(doc, lambda reads: self._custom(self.root, Node(reads, (), (), "#", {})))

    @staticmethod
    def _let(doc: Column, build: Callable[[Reads], Column]) -> Column:
        """Read a document once, then build on what was read.

        Inside a lambda the reads are plain references; a one-element array is
        the "let" of column expressions.
        """
        reads = Reads(None)
        build(reads)
        if not reads.wanted:
            return no_errors()
        boxed = F.transform(F.array(doc), lambda d: F.struct(*reads.columns(d)))
        return F.flatten(F.transform(boxed, lambda r: build(Reads(r))))

    @staticmethod
    def _each(values: Column, reads: Reads, build: Callable[[Reads, Column], Column], none: Callable[[], Column] = no_errors, flat: bool = True) -> Column:
        """Errors of every value of an array of ``struct(v, at)``; ``at`` names it in paths.

        One list of all values together, or with ``flat`` off one for each.
        """
        if reads.base is None:
            return none() if flat else F.array(none())
        inner = Reads(None)
        build(inner, F.lit(""))
        if inner.wanted:
            boxed = F.transform(values, lambda p: F.struct(*inner.columns(p["v"]), p["at"].alias("at")))
        else:
            boxed = F.transform(values, lambda p: F.struct(p["at"].alias("at")))
        lists = F.transform(boxed, lambda r: build(Reads(r), r["at"]))
        return F.flatten(lists) if flat else lists

    def _errors(self, schema: Any, at: Node) -> Column:
        """Errors of a value and everything below it."""
        whole, chain, where = self._followed(schema, at.chain, at.where)
        node = replace(at, where=where, schema=whole if isinstance(whole, dict) else {}, chain=chain)
        if whole is None:  # what the step below has found
            key = F.concat(F.lit(f"{self.cuts.index(schema)}|"), pointer(node.path))
            return F.coalesce(F.try_element_at(F.col("_below"), key), no_errors())
        if whole is True or whole == {}:
            return no_errors()
        if whole is False:
            return node.fail(node.present, "false schema", "boolean schema is false")
        lists = [*self._own_rules(node), *self._members(node), *self._elements(node), *self._combined(node)]
        return F.when(node.present, _joined(lists)).otherwise(no_errors())

    def _calls(self, schema: Any, at: Node) -> Column | None:
        """The cuts met below a value, each as rule (its number), path and value; None where there can be none."""
        whole, chain, where = self._followed(schema, at.chain, at.where)
        node = replace(at, where=where, schema=whole if isinstance(whole, dict) else {}, chain=chain)
        if whole is None:
            call = F.struct(F.lit(self.cuts.index(schema)).alias("rule"), pointer(node.path).alias("path"), node.value.cast("variant").alias("value"))
            return F.when(node.value.isNotNull(), F.array(call).cast(CALLS_TYPE)).otherwise(no_calls())
        lists = [self._calls(sub, replace(node, where=f"{node.where}/{place}", schema={})) for place, sub in _same_value(node.schema)]
        for key, sub in node.schema.get("properties", {}).items():
            lists.append(self._calls(sub, node.member(key, {}, node.path + (step(key),), "")))
        for sub, values, _ in [*self._named_values(node), *self._numbered_values(node), *self._contained(node)]:
            if self._has_cut(sub, chain):
                lists.append(self._each(values, node.reads, lambda reads, name, sub=sub: self._calls(sub, Node(reads, (), node.path + (name,), "", {}, chain)), no_calls))
        lists = [x for x in lists if x is not None]
        if not lists:
            return None
        return lists[0] if len(lists) == 1 else F.concat(*lists)

    def _has_cut(self, schema: Any, chain: tuple[str, ...]) -> bool:
        whole, chain, _ = self._followed(schema, chain, "")
        return whole is None or any(self._has_cut(sub, chain) for sub in _subschemas(whole))

    def _own_rules(self, node: Node) -> list[Column]:
        rules = [_RULES[k](node, param) for k, param in node.schema.items() if k in _RULES]
        for name in node.schema.get("required", []):
            rules.append(node.fail(node.lacks(name), "required", f"missing required property '{name}'"))
        for name, wanted in node.schema.get("dependencies", {}).items():
            if isinstance(wanted, list):
                noun = "property" if len(wanted) == 1 else "properties"
                message = f"must have {noun} {', '.join(wanted)} when property {name} is present"
                rules += [node.fail(node.has(name) & node.lacks(other), "dependencies", message) for other in wanted]
        return [rule for rule in rules if rule is not None]

    def _members(self, node: Node) -> list[Column]:
        lists = []
        for key, sub in node.schema.get("properties", {}).items():
            place = node.member(key, {}, node.path + (step(key),), f"{node.where}/properties/{key}")
            lists.append(self._errors(sub, place))
        if node.schema.get("additionalProperties", True) is False:
            lists.append(F.transform(self._extra_names(node), lambda k: node.error(
                "additionalProperties", F.concat(F.lit("has unknown property '"), k, F.lit("'"))
            )))
        lists += [self._errors_of(node, *values) for values in self._named_values(node)]
        if node.schema.get("propertyNames", True) is not True:
            names = F.transform(self._names(node), lambda k: F.struct(k.cast("variant").alias("v"), F.lit("").alias("at")))
            found = self._each(
                names, node.reads, lambda reads, _: self._errors(node.schema["propertyNames"], Node(reads, (), node.path, f"{node.where}/propertyNames", {}, node.chain)), flat=False,
            )
            own = F.array(node.error("propertyNames", "property name must be valid")).cast(ERRORS_TYPE)
            lists.append(F.flatten(F.transform(found, lambda e: F.when(F.size(e) > 0, F.concat(e, own)).otherwise(no_errors()))))
        return lists

    def _errors_of(self, node: Node, sub: Any, values: Column, where: str) -> Column:
        return self._each(values, node.reads, lambda reads, at: self._errors(sub, Node(reads, (), node.path + (at,), f"{node.where}/{where}", {}, node.chain)))

    @staticmethod
    def _names(node: Node) -> Column:
        names = F.map_keys(node.fields.cast("map<string,variant>"))
        return F.coalesce(names, F.array().cast("array<string>"))

    def _extra_names(self, node: Node) -> Column:
        """Names that neither ``properties`` nor ``patternProperties`` speak of."""
        declared, patterns = node.schema.get("properties", {}), node.schema.get("patternProperties", {})
        names = F.array_except(self._names(node), F.array(*[F.lit(k) for k in declared])) if declared else self._names(node)
        for pattern in patterns:
            names = F.filter(names, _not(_like(pattern)))
        return names

    def _named_values(self, node: Node) -> list[tuple[Any, Column, str]]:
        """Sub-schemas of members found by pattern or left over, with those members as ``struct(v, at)``."""
        def of(names: Column) -> Column:
            return F.transform(names, lambda k: F.struct(
                F.try_element_at(node.fields.cast("map<string,variant>"), k).alias("v"),
                F.concat(F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("at"),
            ))

        found = [
            (sub, of(F.filter(self._names(node), _like(pattern))), f"patternProperties/{pattern}")
            for pattern, sub in node.schema.get("patternProperties", {}).items()
        ]
        extra = node.schema.get("additionalProperties", True)
        if isinstance(extra, dict) and extra:
            found.append((extra, of(self._extra_names(node)), "additionalProperties"))
        return found

    def _numbered_values(self, node: Node) -> list[tuple[Any, Column, str]]:
        """Sub-schemas of list elements, with those elements as ``struct(v, at)``."""
        sub = node.schema.get("items")
        if sub is None or sub is True or sub == {}:
            return []
        elements = F.coalesce(node.items.cast("array<variant>"), F.array().cast("array<variant>"))
        numbered = F.transform(elements, lambda e, i: F.struct(e.alias("v"), F.concat(F.lit("/"), i.cast("string")).alias("at")))
        if not isinstance(sub, list):
            return [(sub, numbered, "items")]
        found = [(one, F.slice(numbered, F.lit(n + 1), F.lit(1)), f"items/{n}") for n, one in enumerate(sub)]
        rest = node.schema.get("additionalItems", True)
        if isinstance(rest, dict) and rest:
            found.append((rest, F.slice(numbered, F.lit(len(sub) + 1), F.greatest(F.size(numbered), F.lit(0))), "additionalItems"))
        return found

    def _contained(self, node: Node) -> list[tuple[Any, Column, str]]:
        if "contains" not in node.schema:
            return []
        alone = replace(node, schema={**node.schema, "items": node.schema["contains"]})
        values = self._numbered_values(alone) if node.schema["contains"] not in (True, {}) else self._numbered_values(replace(node, schema={**node.schema, "items": {"allOf": []}}))
        return [(node.schema["contains"], values[0][1], "contains")]

    def _elements(self, node: Node) -> list[Column]:
        lists = [self._errors_of(node, *values) for values in self._numbered_values(node)]
        sub = node.schema.get("items")
        if isinstance(sub, list) and node.schema.get("additionalItems") is False:
            many = node.items.isNotNull() & (F.size(node.items) > len(sub))
            lists.append(node.fail(many, "additionalItems", f"must NOT have more than {len(sub)} items"))
        for one, values, where in self._contained(node):
            found = self._each(
                values, node.reads, lambda reads, at: self._errors(one, Node(reads, (), node.path + (at,), f"{node.where}/{where}", {}, node.chain)), flat=False,
            )
            own = F.array(node.error("contains", "must contain at least 1 valid item(s)")).cast(ERRORS_TYPE)
            some = F.exists(found, lambda e: F.size(e) == 0)
            lists.append(F.when(node.items.isNotNull() & ~some, F.concat(F.flatten(found), own)).otherwise(no_errors()))
        return lists

    def _combined(self, node: Node) -> list[Column]:
        lists = []

        def below(schema: Any, where: str) -> Column:
            return self._errors(schema, replace(node, where=f"{node.where}/{where}", schema={}))

        def branches(keyword: str) -> list[Column]:
            return [below(s, f"{keyword}/{i}") for i, s in enumerate(node.schema[keyword])]

        def judged(options: list[Column], good: Callable[[Column], Column], keyword: str, message: str) -> Column:
            """All branch errors plus one own error, unless the count of passing branches is good."""
            passing = sum((F.when(F.size(e) == 0, 1).otherwise(0) for e in options), F.lit(0))
            own = F.array(node.error(keyword, message)).cast(ERRORS_TYPE)
            return F.when(good(passing), no_errors()).otherwise(F.concat(*options, own))

        if node.schema.get("allOf"):
            lists += branches("allOf")
        if node.schema.get("anyOf"):
            lists.append(judged(branches("anyOf"), lambda n: n >= 1, "anyOf", "must match a schema in anyOf"))
        if node.schema.get("oneOf"):
            lists.append(judged(branches("oneOf"), lambda n: n == 1, "oneOf", "must match exactly one schema in oneOf"))
        if "not" in node.schema:
            inner = below(node.schema["not"], "not")
            lists.append(node.fail(F.size(inner) == 0, "not", "must NOT be valid"))
        if "if" in node.schema and ("then" in node.schema or "else" in node.schema):
            def chosen(branch: str) -> Column:
                if branch not in node.schema:
                    return no_errors()
                found = below(node.schema[branch], branch)
                own = F.array(node.error("if", f'must match "{branch}" schema')).cast(ERRORS_TYPE)
                return F.when(F.size(found) > 0, F.concat(found, own)).otherwise(no_errors())

            lists.append(F.when(F.size(below(node.schema["if"], "if")) == 0, chosen("then")).otherwise(chosen("else")))
        for name, wanted in node.schema.get("dependencies", {}).items():
            if not isinstance(wanted, list):
                lists.append(F.when(node.has(name), below(wanted, f"dependencies/{name}")).otherwise(no_errors()))
        return lists

    # -- generation rules --------------------------------------------------

    def _custom(self, schema: Any, at: Node) -> Column:
        """Errors of the settings below a value; its own settings are the caller's."""
        schema = schema if isinstance(schema, dict) else {}
        lists: list[Column] = []
        for key, sub in schema.get("properties", {}).items():
            if isinstance(sub, dict) and _has_settings(sub, own=True):
                label = at.path + ((f".{key}" if at.path else key),)
                lists.append(self._custom_at(sub, at.member(key, sub, label, "")))
        sub = schema.get("items")
        if isinstance(sub, dict) and _has_settings(sub, own=True):
            node = Node(at.reads, at.keys, at.path, "", schema)
            elements = F.coalesce(node.items.cast("array<variant>"), F.array().cast("array<variant>"))
            numbered = F.transform(elements, lambda e, i: F.struct(
                e.alias("v"), F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("at")
            ))
            lists.append(self._each(
                numbered, at.reads, lambda reads, name: self._custom_at(sub, Node(reads, (), at.path + (name,), "", sub))
            ))
        return _joined(lists)

    def _custom_at(self, schema: dict, node: Node) -> Column:
        settings = schema.get(GENERATE) or {}
        rules = []
        for keyword, word, broken in (
            ("minLength", "minimum", lambda length, n: length < n), ("maxLength", "maximum", lambda length, n: length > n),
        ):
            if settings.get(keyword):
                n = settings[keyword]
                message = f"custom rule - {word} length should be {plain(n)}"
                rules.append(node.fail(broken(utf16_length(node.string.cast("string")), n), keyword, message))
        for text in settings["requirements"] if isinstance(settings.get("requirements"), list) else []:
            word = forbidden_word(text)
            if word:
                has = F.contains(F.lower(node.string.cast("string")), F.lower(F.lit(word)))
                rules.append(node.fail(has, "requirements", f'should not contain "{word}"'))
        return _joined([*rules, self._custom(schema, node)])

    # -- both ----------------------------------------------------------------

    def errors(self, doc: Column) -> Column:
        """Sorted errors; the generation rules speak only when the schema is satisfied."""
        return self._first_of(self.schema_errors(doc), lambda: self.custom_errors(doc))

    def _first_of(self, schema_list: Column, custom_list: Callable[[], Column]) -> Column:
        first = F.sort_array(schema_list)
        if not _has_settings(self.root if isinstance(self.root, dict) else {}):
            return first
        both = F.filter(F.array(first, F.sort_array(custom_list())), lambda e: F.size(e) > 0)
        return F.coalesce(F.get(both, F.lit(0)), no_errors())

    def add_errors(self, df: DataFrame, doc: str, name: str = "errors") -> DataFrame:
        """Add the column of ``errors`` in two compiled steps: read the document, then judge."""
        if len(self.cuts) > 1:
            return self._add_by_steps(df, doc, name)

        def build(reads: Reads) -> Column:
            return self._first_of(
                self._errors(self.root, Node(reads, (), (), "#", {})),
                lambda: self._custom(self.root, Node(reads, (), (), "#", {})),
            )

        reads = Reads(None)
        build(reads)
        if not reads.wanted:
            return df.withColumn(name, no_errors())
        return _pinned(df, doc, reads, build, name)

    def _add_by_steps(self, df: DataFrame, doc: str, name: str) -> DataFrame:
        """``add_errors`` for a recursive schema: down to the last cut, then up with the errors.

        A call is a rule applied to a value of a document.  Every step down takes the
        calls of all documents at once to the calls that they leave open, until none is
        left.  Where the errors of a cut simply join those around it, all calls are then
        judged in one pass.  Where ``anyOf`` or its like judges them, every step up
        joins the errors of the calls below first.  Calls are rows, spread by document
        and path; the steps grow with the depth of the documents, not with their number.
        """
        if df.isStreaming:
            raise ValueError("check a stream against a recursive schema batch by batch, in foreachBatch")
        rows = materialize(df, "documents").withColumn("_row", F.monotonically_increasing_id())
        base, links = scratch_path(df.sparkSession, "calls"), F.array().cast("array<struct<rule:int,path:string>>").alias("links")
        levels = [_kept(rows.where(F.col(doc).isNotNull()).select("_row", F.lit(0).alias("rule"), F.lit("").alias("path"), F.col(doc).alias("value"), links), f"{base}/step=0")]
        while True:
            made = [m for rule in range(len(self.cuts)) if (m := self._open_calls(levels[-1], rule)) is not None]
            # A value may be asked for on several ways; it is judged once.
            found = _union(made).groupBy("_row", "rule", "path").agg(F.any_value("value").alias("value"), F.collect_set("link").alias("links"))
            found = _kept(found, f"{base}/step={len(levels)}")
            if found.isEmpty():
                break
            levels.append(found)
        if self._joins_plainly():
            whole = df.sparkSession.read.schema(levels[0].schema).parquet(base)
            errors = _union([self._judged_calls(whole, rule, None, None) for rule in range(len(self.cuts))])
            errors = errors.groupBy("_row").agg(F.flatten(F.collect_list("errors")).alias("errors"))
        else:
            errors = below = None
            for calls in reversed(levels):
                errors = materialize(_union([self._judged_calls(calls, rule, errors, below) for rule in range(len(self.cuts))]), "call-errors")
                below = calls.select("_row", "rule", "path", F.explode("links").alias("link"))
        first = errors.select(F.col("_row").alias("_of"), F.col("errors").alias("_found"))
        whole = rows.join(first, F.col("_row") == F.col("_of"), "left").withColumn("_found", F.coalesce("_found", no_errors()))
        if _has_settings(self.root if isinstance(self.root, dict) else {}):
            whole = pin(whole, _said=self.custom_errors(F.col(doc)))
            both = self._first_of(F.col("_found"), lambda: F.col("_said"))
            return whole.withColumn(name, both).drop("_row", "_of", "_found", "_said")
        return whole.withColumn(name, F.sort_array("_found")).drop("_row", "_of", "_found")

    def _joins_plainly(self) -> bool:
        """Whether no cut stands where its errors are counted: below ``anyOf``, ``oneOf``, ``not``, ``if``, ``contains`` or property names."""
        def judged(schema: Any, chain: tuple[str, ...]) -> bool:
            whole, chain, _ = self._followed(schema, chain, "")
            for place, sub in [*_same_value(whole), *_below_value(whole)]:
                counted = place.partition("/")[0] in ("anyOf", "oneOf", "not", "if", "then", "else", "contains", "propertyNames")
                if (self._has_cut(sub, chain) if counted else judged(sub, chain)):
                    return True
            return False

        return not any(judged(cut, ()) for cut in self.cuts)

    def _open_calls(self, calls: DataFrame, rule: int) -> DataFrame | None:
        if not self._has_cut(self.cuts[rule] if rule else self.root, ()):
            return None

        def build(reads: Reads) -> Column:
            return self._calls(self.cuts[rule], Node(reads, (), (F.col("path"),), "#", {}))

        reads = Reads(None)
        build(reads)
        opened = _pinned(calls.where(F.col("rule") == rule), "value", reads, build, "_calls")
        return opened.select("_row", F.struct("rule", "path").alias("link"), F.explode("_calls").alias("c")).select("_row", "c.*", "link")

    def _judged_calls(self, calls: DataFrame, rule: int, errors: DataFrame | None, below: DataFrame | None) -> DataFrame:
        """Calls of one rule that have errors: _row, rule, path, errors.  ``errors`` are those of the calls ``below``."""
        calls = calls.where(F.col("rule") == rule)
        keys = ["_row", "rule", "path"]
        if errors is None:
            calls = calls.withColumn("_below", F.lit(None).cast(f"map<string,{ERRORS_TYPE}>"))
        else:
            named = below.where(F.col("link.rule") == rule).join(errors, keys).select(
                "_row", "link", F.struct(F.concat_ws("|", "rule", "path").alias("key"), "errors").alias("e"),
            )
            # One group is what lies below one value.
            found = named.groupBy("_row", F.col("link.rule").alias("rule"), F.col("link.path").alias("path"))
            calls = calls.join(found.agg(F.map_from_entries(F.collect_list("e")).alias("_below")), keys, "left")

        def build(reads: Reads) -> Column:
            return self._errors(self.cuts[rule], Node(reads, (), (F.col("path"),), "#", {}))

        reads = Reads(None)
        build(reads)
        return _pinned(calls, "value", reads, build, "errors").select(*keys, "errors").where(F.size("errors") > 0)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole


def _pinned(df: DataFrame, doc: str, reads: Reads, build: Callable[[Reads], Column], name: str) -> DataFrame:
    """Read what ``build`` wants of a document, then add what it makes of that."""
    columns = {f"_read_r{i}": read(F.col(doc)) for i, read in enumerate(reads.wanted.values())}
    judged = build(Reads({f"r{i}": F.col(f"_read_r{i}") for i in range(len(columns))}))
    return pin(pin(df, **columns) if columns else df, **{name: judged}).drop(*columns)


def forbidden_word(requirement: Any) -> str | None:
    """The words after the fixed phrase, up to the end of their line."""
    if not isinstance(requirement, str) or FORBIDDEN_PHRASE not in requirement:
        return None
    return requirement.split(FORBIDDEN_PHRASE, 1)[1].splitlines()[0] or None


def _same_value(schema: Any) -> list[tuple[str, Any]]:
    """Sub-schemas that speak of the same value, with their places."""
    if not isinstance(schema, dict):
        return []
    found = [(f"{k}/{i}", sub) for k in ("allOf", "anyOf", "oneOf") for i, sub in enumerate(schema.get(k) or [])]
    found += [(k, schema[k]) for k in ("not", "if", "then", "else") if k in schema]
    return found + [(f"dependencies/{k}", sub) for k, sub in schema.get("dependencies", {}).items() if not isinstance(sub, list)]


def _below_value(schema: Any) -> list[tuple[str, Any]]:
    """Sub-schemas that speak of values inside, with their places."""
    if not isinstance(schema, dict):
        return []
    found = [(f"{k}/{name}", sub) for k in ("properties", "patternProperties") if isinstance(schema.get(k), dict) for name, sub in schema[k].items()]
    items = schema.get("items")
    found += [(f"items/{i}", sub) for i, sub in enumerate(items)] if isinstance(items, list) else [("items", items)] if items is not None else []
    return found + [(k, schema[k]) for k in ("additionalProperties", "additionalItems", "contains", "propertyNames") if isinstance(schema.get(k), dict)]


def _subschemas(schema: Any) -> list:
    return [sub for _, sub in [*_same_value(schema), *_below_value(schema)]]


def _refs_within(schema: Any, inside: Callable[[Any], list[tuple[str, Any]]]) -> set[str]:
    """References that a schema holds, followed through sub-schemas but not through references."""
    if not isinstance(schema, dict):
        return set()
    found = {schema["$ref"]} if isinstance(schema.get("$ref"), str) else set()
    return found.union(*[_refs_within(sub, inside) for _, sub in inside(schema)])


def _recursive_refs(root: Any) -> set[str]:
    """References that lead back to themselves.  Dangling ones, and those that do so on the same value, are errors."""
    every, todo = {}, sorted(_refs_within(root, lambda s: [*_same_value(s), *_below_value(s)]))
    same = {}
    while todo:
        ref = todo.pop()
        if ref not in every:
            target = target_of(ref, root)
            every[ref] = _refs_within(target, lambda s: [*_same_value(s), *_below_value(s)])
            same[ref] = _refs_within(target, _same_value)
            todo += sorted(every[ref])

    def reached(ref: str, graph: dict[str, set[str]]) -> set[str]:
        found: set[str] = set()
        todo = list(graph[ref])
        while todo:
            one = todo.pop()
            if one not in found:
                found.add(one)
                todo += graph[one]
        return found

    for ref in sorted(same):
        if ref in reached(ref, same):
            raise ValueError(f"cyclic reference: {ref}")
    return {ref for ref in every if ref in reached(ref, every)}


def _has_settings(schema: dict, own: bool = False) -> bool:
    if own and schema.get(GENERATE):
        return True
    inner = list(schema.get("properties", {}).values())
    inner.append(schema.get("items"))
    return any(isinstance(s, dict) and _has_settings(s, own=True) for s in inner)


def lint_types(schema: Any, at: str = "") -> list[str]:
    """Dotted places of ``type`` values that JSON Schema does not know, in all sub-schemas and definitions."""
    found = []
    if isinstance(schema, dict):
        named = schema.get("type")
        names = named if isinstance(named, list) else [] if named is None else [named]
        if any(n not in TYPES for n in names):
            found.append(f"{at}.type".lstrip("."))
        kept = [(f"{k}/{name}", sub) for k in ("definitions", "$defs") if isinstance(schema.get(k), dict) for name, sub in schema[k].items()]
        for place, sub in [*_below_value(schema), *_same_value(schema), *kept]:
            keyword, _, rest = place.partition("/")
            found += lint_types(sub, ".".join(filter(None, (at, keyword, rest))))
    return found
