"""JSON Schema (2020-12) on payloads: for one value in Python, and compiled to a Column over VARIANT.

Both tell all violations, each as `path: what`.  A Column's expression follows the schema:
every subschema stands in a lambda over the value that it checks, so it is worked out once,
and no payload leaves the JVM.  References are written out as deep as `DEPTH` times each on
one way down; a payload that nests deeper than that is told as such, and so never passes unseen.

Not checked: references to other documents, dynamic references, and the unevaluated keywords.
Patterns are regular expressions of Java in a Column and of Python for one value.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import GraphError

#: How often one reference is followed on the way down to a value.
DEPTH = 6

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_BOUNDS: dict[str, tuple[str, Callable]] = {
    "minimum": ("breaks minimum", lambda x, b: x < b),
    "maximum": ("breaks maximum", lambda x, b: x > b),
    "exclusiveMinimum": ("breaks exclusiveMinimum", lambda x, b: x <= b),
    "exclusiveMaximum": ("breaks exclusiveMaximum", lambda x, b: x >= b),
    "multipleOf": ("breaks multipleOf", lambda x, b: x % b != 0),
}
_TIME = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([zZ]|[+-]([01]\d|2[0-3]):[0-5]\d)"
_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_H = "[0-9A-Fa-f]{1,4}"
_IPV6 = "|".join([f"({_H}:){{7}}{_H}", f"({_H}:){{1,7}}:", *[f"({_H}:){{1,{7 - k}}}(:{_H}){{1,{k}}}" for k in range(1, 7)], f":((:{_H}){{1,7}}|:)", f"({_H}:){{6}}{_BYTE}(\\.{_BYTE}){{3}}", f"::(ffff:)?{_BYTE}(\\.{_BYTE}){{3}}"])
#: Formats that are checked; others always hold.
FORMATS = {
    "date": r"\d{4}-\d\d-\d\d",
    "time": _TIME,
    "date-time": rf"\d{{4}}-\d\d-\d\d[tT ]{_TIME}",
    "duration": r"P(?=.)(\d+W|(\d+Y)?(\d+M)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+S)?)?)",
    "email": rf"[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*@{_LABEL}(\.{_LABEL})*",
    "hostname": rf"{_LABEL}(\.{_LABEL})*",
    "ipv4": rf"{_BYTE}(\.{_BYTE}){{3}}",
    "ipv6": _IPV6,
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*",
    "uri-reference": r"[^\s<>\"{}|\\^`]*",
    "uuid": r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "json-pointer": r"(/([^~/]|~[01])*)*",
}
_DATED = ("date", "date-time")


def _kinds(schema: dict) -> list[str] | None:
    kinds = schema.get("type")
    return [kinds] if isinstance(kinds, str) else kinds


def _told(kinds: list[str]) -> str:
    return f"must be {kinds[0] if len(kinds) == 1 else kinds}"


def _referred(root: dict | bool, ref: str) -> dict | bool:
    """The subschema that a reference within the document names: `#`, a pointer, or an anchor."""
    if not ref.startswith("#"):
        raise GraphError("INVALID_SCHEMA", f"{ref!r} isn't in the schema")
    if ref == "#":
        return root
    if not ref.startswith("#/"):
        found = [s for s in _subschemas(root) if isinstance(s, dict) and s.get("$anchor") == ref[1:]]
        if not found:
            raise GraphError("INVALID_SCHEMA", f"{ref!r} isn't in the schema")
        return found[0]
    at: object = root
    for part in ref[2:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise GraphError("INVALID_SCHEMA", f"{ref!r} isn't in the schema") from e
    return at


def _subschemas(node: object):
    yield node
    for v in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _subschemas(v)


# one value


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def _same(value: object) -> object:
    """A form in which JSON values are equal just if they are the same: true isn't 1, and 1.0 is."""
    if isinstance(value, bool) or value is None:
        return (type(value).__name__, value)
    if isinstance(value, int | float):
        return ("number", float(value))
    if isinstance(value, str):
        return ("string", value)
    return ("array", *map(_same, value)) if isinstance(value, list) else ("object", *sorted((k, _same(v)) for k, v in value.items()))


def _formatted(name: str, value: str) -> bool:
    if name == "regex":
        try:
            re.compile(value)
        except re.error:
            return False
        return True
    if name not in FORMATS:
        return True
    if not re.fullmatch(FORMATS[name], value, re.ASCII):
        return False
    if name in _DATED:
        try:
            datetime.date.fromisoformat(value[:10])
        except ValueError:
            return False
    return True


def schema_errors(schema: dict | bool, value: object, at: str = "", root: dict | bool | None = None) -> list[str]:
    """All violations of a schema by one value."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at or '/'}: nothing is allowed here"]
    out: list[str] = []
    say = lambda what: out.append(f"{at or '/'}: {what}")
    own = lambda s, v=value, p=at: schema_errors(s, v, p, root)
    kinds = _kinds(schema)
    if kinds is not None and not any(_is(value, k) for k in kinds):
        say(_told(kinds))
        return out
    if "$ref" in schema:
        out += own(_referred(root, schema["$ref"]))
    if "enum" in schema and _same(value) not in map(_same, schema["enum"]):
        say("must be one of the listed values")
    if "const" in schema and _same(value) != _same(schema["const"]):
        say("must be the constant")
    if isinstance(value, str):
        size, names = len(value), ("minLength", "maxLength")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            say(f"must match {schema['pattern']}")
        if "format" in schema and not _formatted(schema["format"], value):
            say(f"must be of format {schema['format']}")
    elif isinstance(value, list):
        size, names = len(value), ("minItems", "maxItems")
    elif isinstance(value, dict):
        size, names = len(value), ("minProperties", "maxProperties")
    else:
        size, names = 0, ()
    if names and (size < schema.get(names[0], 0) or size > schema.get(names[1], size)):
        say("has a size out of bounds")
    if _is(value, "number"):
        for name, (told, bad) in _BOUNDS.items():
            if name in schema and bad(value, schema[name]):
                say(f"{told} {schema[name]}")
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for name in schema.get("required", []):
            if name not in value:
                say(f"lacks {name}")
        for name, needed in schema.get("dependentRequired", {}).items():
            if name in value:
                for other in needed:
                    if other not in value:
                        say(f"has {name} and lacks {other}")
        for name, part in schema.get("dependentSchemas", {}).items():
            if name in value:
                out += own(part)
        for name, v in value.items():
            here = [s for p, s in patterns.items() if re.search(p, name)] + ([known[name]] if name in known else [])
            for part in here or [schema.get("additionalProperties", True)]:
                out += own(part, v, f"{at}/{name}")
            if "propertyNames" in schema and own(schema["propertyNames"], name):
                say(f"must not have the name {name}")
    if isinstance(value, list):
        first = schema.get("prefixItems", [])
        for k, v in enumerate(value):
            out += own(first[k] if k < len(first) else schema.get("items", True), v, f"{at}/{k}")
        if schema.get("uniqueItems") and len({_same(v) for v in value}) < len(value):
            say("repeats an item")
        if "contains" in schema:
            n = sum(not own(schema["contains"], v, "") for v in value)
            if n < schema.get("minContains", 1) or n > schema.get("maxContains", n):
                say("contains too few or too many")
    for part in schema.get("allOf", []):
        out += own(part)
    fits = [not own(part) for part in schema.get("anyOf", [])]
    if fits and not any(fits):
        say("fits none of anyOf")
    fits = [not own(part) for part in schema.get("oneOf", [])]
    if fits and sum(fits) != 1:
        say("must fit one of oneOf")
    if "not" in schema and not own(schema["not"]):
        say("fits what it must not")
    if "if" in schema:
        out += own(schema.get("else" if own(schema["if"]) else "then", True))
    return out


# a column

_NONE = "cast(array() as array<string>)"


def violations(schema: dict | bool, value: Column, depth: int = DEPTH) -> Column:
    """All violations of a schema by a VARIANT column, as an array of strings; none for a null column."""
    compiled = _Compiled(schema, depth)
    return F.when(value.isNull(), F.expr(_NONE)).otherwise(_bound(value, lambda v: compiled.check(schema, v, F.lit(""), {})))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _when(bad: Column, message: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(message)).otherwise(F.expr(_NONE))


class _Compiled:
    """One schema document on the way to a column."""

    def __init__(self, root: dict | bool, depth: int) -> None:
        self.root, self.depth = root, depth

    def check(self, schema: dict | bool, v: Column, at: Column, seen: dict[str, int]) -> Column:
        where = F.when(at == "", F.lit("/")).otherwise(at)
        say = lambda what: F.concat(where, F.lit(": "), what if isinstance(what, Column) else F.lit(what))
        if isinstance(schema, bool):
            return F.expr(_NONE) if schema else F.array(say("nothing is allowed here"))
        # the value's kind and its number, worked out once
        return _bound(F.struct(_kind(v).alias("kind"), F.try_variant_get(v, "$", "double").alias("number"), v.alias("v")), lambda s: self._checked(schema, s["v"], s["kind"], s["number"], at, say, seen))

    def _checked(self, schema: dict, v: Column, kind: Column, number: Column, at: Column, say: Callable, seen: dict[str, int]) -> Column:
        own = lambda s, x=v, p=at: self.check(s, x, p, seen)
        fits = lambda s, x=v: F.size(self.check(s, x, F.lit(""), seen)) == 0
        parts: list[Column] = []
        bad = lambda condition, what: parts.append(_when(condition, say(what)))
        is_text, is_number, is_list, is_map = (kind == k for k in ("string", "number", "array", "object"))
        text = F.try_variant_get(v, "$", "string")
        items, entries = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")

        if "$ref" in schema:
            ref = schema["$ref"]
            target = _referred(self.root, ref)
            if seen.get(ref, 0) < self.depth:
                parts.append(self.check(target, v, at, seen | {ref: seen.get(ref, 0) + 1}))
            else:
                parts.append(F.array(say(f"nests deeper than {self.depth} times {ref}, which isn't checked")))
        if "enum" in schema:
            bad(~reduce(Column.__or__, [_equals(v, kind, number, x) for x in schema["enum"]], F.lit(False)), "must be one of the listed values")
        if "const" in schema:
            bad(~_equals(v, kind, number, schema["const"]), "must be the constant")
        if "pattern" in schema:
            bad(is_text & ~text.rlike(schema["pattern"]), f"must match {schema['pattern']}")
        if schema.get("format") in FORMATS:
            name = schema["format"]
            held = text.rlike(f"^(?:{FORMATS[name]})$") & ~text.endswith("\n")
            if name in _DATED:
                held = held & F.substring(text, 1, 10).try_cast("date").isNotNull() & ~text.startswith("0000")
            bad(is_text & ~held, f"must be of format {name}")
        for low, high, ours, size in (("minLength", "maxLength", is_text, F.length(text)), ("minItems", "maxItems", is_list, F.size(items)), ("minProperties", "maxProperties", is_map, F.size(entries))):
            limits = [size < schema[k] if k == low else size > schema[k] for k in (low, high) if k in schema]
            if limits:
                bad(ours & reduce(Column.__or__, limits), "has a size out of bounds")
        for name, (told, breaks) in _BOUNDS.items():
            if name in schema:
                bad(is_number & breaks(number, F.lit(float(schema[name]))), f"{told} {schema[name]}")
        parts += self._of_object(schema, is_map, entries, at, own, bad, say)
        parts += self._of_array(schema, is_list, items, at, own, fits, bad)
        parts += [own(part) for part in schema.get("allOf", [])]
        if schema.get("anyOf"):
            bad(~reduce(Column.__or__, map(fits, schema["anyOf"])), "fits none of anyOf")
        if schema.get("oneOf"):
            bad(reduce(Column.__add__, [fits(s).cast("int") for s in schema["oneOf"]]) != 1, "must fit one of oneOf")
        if "not" in schema:
            bad(fits(schema["not"]), "fits what it must not")
        if "if" in schema and ("then" in schema or "else" in schema):
            parts.append(F.when(fits(schema["if"]), own(schema.get("then", True))).otherwise(own(schema.get("else", True))))
        told = F.concat(*parts) if parts else F.expr(_NONE)
        kinds = _kinds(schema)
        if kinds is None:
            return told
        right = [is_number & (number == F.floor(number)) if k == "integer" else kind == k for k in kinds]
        return F.when(reduce(Column.__or__, right), told).otherwise(F.array(say(_told(kinds))))

    def _of_object(self, schema: dict, is_map: Column, entries: Column, at: Column, own: Callable, bad: Callable, say: Callable) -> list[Column]:
        known, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        below = lambda part, name: lambda x: own(part, x, F.concat(at, F.lit(f"/{name}")))
        has = lambda name: F.coalesce(F.map_contains_key(entries, name), F.lit(False))
        for name in schema.get("required", []):
            bad(is_map & ~has(name), f"lacks {name}")
        for name, needed in schema.get("dependentRequired", {}).items():
            for other in needed:
                bad(is_map & has(name) & ~has(other), f"has {name} and lacks {other}")
        out = [F.when(is_map & has(name), own(part)).otherwise(F.expr(_NONE)) for name, part in schema.get("dependentSchemas", {}).items()]
        for name, part in known.items():
            if part is not True and part != {}:
                out.append(F.when(is_map & has(name), _bound(F.element_at(entries, F.lit(name)), below(part, name))).otherwise(F.expr(_NONE)))
        each = lambda body: F.when(is_map, F.flatten(F.transform(F.map_entries(entries), body))).otherwise(F.expr(_NONE))
        if rest is not True and rest != {} or patterns:

            def others(e: Column) -> Column:
                found = [F.when(e["key"].rlike(p), own(s, e["value"], F.concat(at, F.lit("/"), e["key"]))).otherwise(F.expr(_NONE)) for p, s in patterns.items()]
                free = ~e["key"].isin(*known) if known else F.lit(True)
                for p in patterns:
                    free = free & ~e["key"].rlike(p)
                found.append(F.when(free, own(rest, e["value"], F.concat(at, F.lit("/"), e["key"]))).otherwise(F.expr(_NONE)))
                return F.concat(*found)

            out.append(each(others))
        if "propertyNames" in schema:
            named = lambda e: _when(F.size(own(schema["propertyNames"], F.to_variant_object(F.array(e["key"])).cast("array<variant>")[0], F.lit(""))) > 0, say(F.concat(F.lit("must not have the name "), e["key"])))
            out.append(each(named))
        return out

    def _of_array(self, schema: dict, is_list: Column, items: Column, at: Column, own: Callable, fits: Callable, bad: Callable) -> list[Column]:
        first, rest = schema.get("prefixItems", []), schema.get("items", True)
        below = lambda part, k: lambda x: own(part, x, F.concat(at, F.lit(f"/{k}")))
        place = lambda i: F.concat(at, F.lit("/"), i.cast("string"))
        out = []
        for k, part in enumerate(first):
            out.append(F.when(is_list & (F.size(items) > k), _bound(F.get(items, F.lit(k)), below(part, k))).otherwise(F.expr(_NONE)))
        if rest is not True and rest != {}:
            tail = F.transform(items, lambda x, i: F.when(i >= len(first), own(rest, x, place(i))).otherwise(F.expr(_NONE)))
            out.append(F.when(is_list, F.flatten(tail)).otherwise(F.expr(_NONE)))
        if schema.get("uniqueItems"):
            bad(is_list & (F.size(F.array_distinct(F.transform(items, _canonical))) < F.size(items)), "repeats an item")
        if "contains" in schema:
            n = F.size(F.filter(items, lambda x: fits(schema["contains"], x)))
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            bad(is_list & ((n < least) | (n > most) if most is not None else n < least), "contains too few or too many")
        return out


def _kind(v: Column) -> Column:
    """object, array, string, number, boolean, null or another name."""
    shape = F.schema_of_variant(v)
    numbers = reduce(Column.__or__, [shape.startswith(c) for c in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")])
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(numbers, "number").when(shape == "VOID", "null").otherwise(F.lower(shape))


def _canonical(v: Column) -> Column:
    """A text that is one for the same JSON values; numbers within arrays and objects as they are written."""
    return F.when(_kind(v) == "number", F.concat(F.lit("n"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(F.to_json(v))


def _equals(v: Column, kind: Column, number: Column, value: object) -> Column:
    if isinstance(value, bool):
        return (kind == "boolean") & F.coalesce(F.try_variant_get(v, "$", "boolean") == value, F.lit(False))
    if value is None:
        return kind == "null"
    if isinstance(value, int | float):
        return (kind == "number") & F.coalesce(number == float(value), F.lit(False))
    if isinstance(value, str):
        return (kind == "string") & F.coalesce(F.try_variant_get(v, "$", "string") == value, F.lit(False))
    same = F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return (kind == ("array" if isinstance(value, list) else "object")) & F.coalesce(F.to_json(v) == same, F.lit(False))
