"""JSON Schema as expressions over VARIANT values, and as a plain check of small values on the driver.

Understood: type, enum, const, required, properties, additionalProperties,
propertyNames, minProperties, items, minItems, maxItems, pattern, minLength, maxLength,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, anyOf, allOf, if with then, and
$ref to #/$defs; a reference within itself is refused, as an expression has an end. A
schema is a dict or True.
Numbers without a fraction are integers. Patterns are Java's and Python's alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<path:array<string>,keyword:string,message:string>"
KEYWORDS = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "propertyNames", "minProperties", "items", "minItems", "maxItems", "pattern", "minLength", "maxLength",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "anyOf", "allOf", "if", "then", "$ref",
    "$defs", "$schema", "$id", "title", "description", "default",
}
LIMITS = {
    "minimum": (lambda x, n: x < n, "is less than the minimum of"), "maximum": (lambda x, n: x > n, "is greater than the maximum of"),
    "exclusiveMinimum": (lambda x, n: x <= n, "is less than or equal to the minimum of"), "exclusiveMaximum": (lambda x, n: x >= n, "is greater than or equal to the maximum of"),
}
SIZES = {"minLength": ("string", "too short"), "maxLength": ("string", "too long"), "minItems": ("array", "too short"), "maxItems": ("array", "too long"), "minProperties": ("object", "too small")}


class SchemaError(ValueError):
    """A schema that is not understood."""


def _schema(schema: dict | bool, root: dict, above: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    """The schema behind references, and the references on the way to it."""
    if schema is True:
        return {}, above
    if not isinstance(schema, dict) or (unknown := set(schema) - KEYWORDS):
        raise SchemaError(f"not understood: {schema if not isinstance(schema, dict) else sorted(unknown)}")
    if "$ref" not in schema:
        return schema, above
    ref = schema["$ref"]
    if ref in above:
        raise SchemaError(f"{ref} refers to itself")
    if not ref.startswith("#/$defs/") or ref[8:] not in root.get("$defs", {}):
        raise SchemaError(f"no {ref}")
    found, above = _schema(root["$defs"][ref[8:]], root, (*above, ref))
    return {**found, **{k: v for k, v in schema.items() if k != "$ref"}}, above


def _listed(types: str | list[str]) -> list[str]:
    return [types] if isinstance(types, str) else list(types)


def _repr(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value) if value is None or isinstance(value, (bool, int, float)) else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


# As expressions.


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind(v: Column) -> Column:
    """null, boolean, integer, number, string, array or object; SQL null for no value."""
    name = F.schema_of_variant(v)
    decimal = F.try_variant_get(v, "$", "decimal(38,18)")
    whole = F.coalesce(decimal == F.floor(decimal), F.lit(False))
    return (
        F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "object").when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(whole, "integer").otherwise("number")
    )


def _shown(v: Column, of: Column) -> Column:
    return F.when(of == "string", F.concat(F.lit("'"), F.try_variant_get(v, "$", "string"), F.lit("'"))).when(of == "null", "None").when(of == "boolean", F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))


def _no_errors() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _error(keyword: str, message: Column) -> Column:
    return F.struct(F.array().cast("array<string>").alias("path"), F.lit(keyword).alias("keyword"), message.alias("message"))


def _below(errors: Column, part: Column) -> Column:
    return F.transform(errors, lambda e: F.struct(F.concat(F.array(part), e["path"]).alias("path"), e["keyword"].alias("keyword"), e["message"].alias("message")))


def _same(v: Column, of: Column, constant: object) -> Column:
    """Whether a value equals a scalar; 1 and 1.0 are one, 1 and true are not."""
    if constant is None:
        return of == "null"
    if isinstance(constant, bool):
        return (of == "boolean") & (F.try_variant_get(v, "$", "boolean") == constant)
    if isinstance(constant, (int, float)):
        return of.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(constant))
    if isinstance(constant, str):
        return (of == "string") & (F.try_variant_get(v, "$", "string") == constant)
    raise SchemaError(f"only scalars are compared: {constant!r}")


def _typed(of: Column, types: str | list[str]) -> Column:
    names = {x for t in _listed(types) for x in (("integer", "number") if t == "number" else (t,))}
    return of.isin(*names)


def errors(schema: dict | bool, value: Column, root: dict | None = None, above: tuple[str, ...] = ()) -> Column:
    """array<ERROR> of a VARIANT: where, which keyword, and what is wrong; empty for null columns.

    path lists property names and numbers of items from the value down.
    """
    root = root if root is not None else schema if isinstance(schema, dict) else {}
    s, above = _schema(schema, root, above)
    if not set(s) - {"$defs", "$schema", "$id", "title", "description", "default"}:
        return _no_errors()
    return _let(value, lambda v: _let(kind(v), lambda of: F.when(v.isNull(), _no_errors()).otherwise(_of_value(s, v, of, root, above))))


def _of_value(s: dict, v: Column, of: Column, root: dict, above: tuple[str, ...]) -> Column:
    shown, own, parts = _shown(v, of), [], []
    told = lambda keyword, wrong, message: own.append(F.when(F.coalesce(wrong, F.lit(False)), _error(keyword, message)))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    if "type" in s:
        told("type", ~_typed(of, s["type"]), F.concat(shown, F.lit(f" is not of type {', '.join(map(_repr, _listed(s['type'])))}")))
    if "enum" in s:
        any_of = F.lit(False)
        for c in s["enum"]:
            any_of = any_of | F.coalesce(_same(v, of, c), F.lit(False))
        told("enum", ~any_of, F.concat(shown, F.lit(f" is not one of [{', '.join(map(_repr, s['enum']))}]")))
    if "const" in s:
        told("const", ~F.coalesce(_same(v, of, s["const"]), F.lit(False)), F.lit(f"{_repr(s['const'])} was expected"))
    if "pattern" in s:
        told("pattern", (of == "string") & ~text.rlike(s["pattern"]), F.concat(shown, F.lit(f" does not match {_repr(s['pattern'])}")))
    for keyword, (test, words) in LIMITS.items():
        if keyword in s:
            told(keyword, of.isin("integer", "number") & test(number, float(s[keyword])), F.concat(shown, F.lit(f" {words} {s[keyword]}")))
    items, members = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    for keyword, (own_kind, words) in SIZES.items():
        if keyword in s:
            size = F.length(text) if own_kind == "string" else F.size(items) if own_kind == "array" else F.size(members)
            wrong = size > s[keyword] if keyword.startswith("max") else size < s[keyword]
            told(keyword, (of == own_kind) & wrong, F.concat(shown, F.lit(" should be non-empty" if keyword.startswith("min") and s[keyword] == 1 else f" is {words}")))
    for keyword in ("anyOf", "allOf"):
        if keyword in s:
            broken = [errors(x, v, root, above) for x in s[keyword]]
            if keyword == "allOf":
                parts += broken
            else:
                none = F.lit(True)
                for b in broken:
                    none = none & (F.size(b) > 0)
                told("anyOf", none, F.concat(shown, F.lit(" is not valid under any of the given schemas")))
    if "if" in s and "then" in s:
        parts.append(F.when(F.size(errors(s["if"], v, root, above)) == 0, errors(s["then"], v, root, above)).otherwise(_no_errors()))
    if "items" in s:
        inner = lambda x, i: _below(errors(s["items"], x, root, above), i.cast("string"))
        parts.append(F.when(of == "array", F.flatten(F.transform(items, inner))).otherwise(_no_errors()))
    if {"required", "properties", "additionalProperties", "propertyNames"} & set(s):
        parts.append(F.when(of == "object", _let(members, lambda m: _of_members(s, m, root, above))).otherwise(_no_errors()))
    return F.concat(F.array_compact(F.array(*own)) if own else _no_errors(), *parts)


def _of_members(s: dict, members: Column, root: dict, above: tuple[str, ...]) -> Column:
    known, parts = list(s.get("properties", {})), []
    missing = F.filter(F.array(*map(F.lit, s.get("required", []))).cast("array<string>"), lambda name: ~F.map_contains_key(members, name))
    parts.append(F.transform(missing, lambda name: _error("required", F.concat(F.lit("'"), name, F.lit("' is a required property")))))
    extra = F.filter(F.array_sort(F.map_keys(members)), lambda name: ~name.isin(*known) if known else F.lit(True))
    more = s.get("additionalProperties", True)
    if more is False:
        names = F.array_join(F.transform(extra, lambda name: F.concat(F.lit("'"), name, F.lit("'"))), ", ")
        message = F.concat(F.lit("Additional properties are not allowed ("), names, F.when(F.size(extra) == 1, " was unexpected)").otherwise(" were unexpected)"))
        parts.append(F.when(F.size(extra) > 0, F.array(_error("additionalProperties", message))).otherwise(_no_errors()))
    elif more is not True:
        parts.append(F.flatten(F.transform(extra, lambda name: _below(errors(more, F.try_element_at(members, name), root, above), name))))
    if "propertyNames" in s:
        pattern, _ = _schema(s["propertyNames"], root, above)
        bad = F.filter(F.array_sort(F.map_keys(members)), lambda name: ~name.rlike(pattern["pattern"]))
        parts.append(F.transform(bad, lambda name: _error("propertyNames", F.concat(F.lit("'"), name, F.lit(f"' does not match {_repr(pattern['pattern'])}")))))
    for name, child in s.get("properties", {}).items():
        parts.append(_below(errors(child, F.try_element_at(members, F.lit(name)), root, above), F.lit(name)))
    return F.concat(*parts)


# On the driver.


def violations(schema: dict | bool, value: object, root: dict | None = None, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(path, keyword, message) of each broken keyword of a small value, such as a template."""
    root = root if root is not None else schema if isinstance(schema, dict) else {}
    s, _ = _schema(schema, root, ())
    shown, of = _repr(value), _kind(value)
    typed = lambda types: of in {x for t in _listed(types) for x in (("integer", "number") if t == "number" else (t,))}
    same = lambda c: c == value and isinstance(c, bool) == isinstance(value, bool)
    valid = lambda x: next(violations(x, value, root), None) is None
    if "type" in s and not typed(s["type"]):
        yield at, "type", f"{shown} is not of type {', '.join(map(_repr, _listed(s['type'])))}"
    if "enum" in s and not any(same(c) for c in s["enum"]):
        yield at, "enum", f"{shown} is not one of [{', '.join(map(_repr, s['enum']))}]"
    if "const" in s and not same(s["const"]):
        yield at, "const", f"{_repr(s['const'])} was expected"
    if "pattern" in s and of == "string" and not re.search(s["pattern"], value):
        yield at, "pattern", f"{shown} does not match {_repr(s['pattern'])}"
    for keyword, (test, words) in LIMITS.items():
        if keyword in s and of in ("integer", "number") and test(value, s[keyword]):
            yield at, keyword, f"{shown} {words} {s[keyword]}"
    for keyword, (own_kind, words) in SIZES.items():
        if keyword in s and of == own_kind and (len(value) > s[keyword] if keyword.startswith("max") else len(value) < s[keyword]):
            yield at, keyword, f"{shown} should be non-empty" if keyword.startswith("min") and s[keyword] == 1 else f"{shown} is {words}"
    if "anyOf" in s and not any(map(valid, s["anyOf"])):
        yield at, "anyOf", f"{shown} is not valid under any of the given schemas"
    for x in s.get("allOf", []):
        yield from violations(x, value, root, at)
    if "if" in s and "then" in s and valid(s["if"]):
        yield from violations(s["then"], value, root, at)
    if of == "array" and "items" in s:
        for i, x in enumerate(value):
            yield from violations(s["items"], x, root, (*at, str(i)))
    if of == "object":
        yield from _member_violations(s, value, root, at)


def _member_violations(s: dict, value: dict, root: dict, at: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str, str]]:
    for name in s.get("required", []):
        if name not in value:
            yield at, "required", f"'{name}' is a required property"
    extra, more = sorted(set(value) - set(s.get("properties", {}))), s.get("additionalProperties", True)
    if more is False and extra:
        yield at, "additionalProperties", f"Additional properties are not allowed ({', '.join(map(_repr, extra))} {'was' if len(extra) == 1 else 'were'} unexpected)"
    elif more is not False and more is not True:
        for name in extra:
            yield from violations(more, value[name], root, (*at, name))
    if "propertyNames" in s:
        pattern = _schema(s["propertyNames"], root, ())[0]["pattern"]
        for name in sorted(value):
            if not re.search(pattern, name):
                yield at, "propertyNames", f"'{name}' does not match {_repr(pattern)}"
    for name, child in s.get("properties", {}).items():
        if name in value:
            yield from violations(child, value[name], root, (*at, name))


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "integer" if value == int(value) else "number"
    return {str: "string", list: "array", dict: "object"}.get(type(value), type(value).__name__)
