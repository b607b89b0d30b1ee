"""A small checker for JSON Schema documents: the keywords that the published schema uses."""

from __future__ import annotations

import re
from typing import Any

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def problems(value: Any, schema: dict, root: dict | None = None, at: str = "$") -> list[str]:
    """What breaks the schema; empty if nothing does."""
    root, out = root or schema, []
    inner = lambda s, v=value, p=at: problems(v, s, root, p)
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        out += inner(target)
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(value, k) for k in kinds):
            return [*out, f"{at}: not of type {' or '.join(kinds)}"]
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not {schema['const']!r}")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: {value!r} is not allowed")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: doesn't match {schema['pattern']}")
    if _is(value, "number") and value < schema.get("minimum", value):
        out.append(f"{at}: below {schema['minimum']}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: fewer than {schema['minItems']} items")
        if schema.get("uniqueItems") and len({repr(x) for x in value}) < len(value):
            out.append(f"{at}: repeated items")
        if "items" in schema:
            out += [p for i, x in enumerate(value) for p in inner(schema["items"], x, f"{at}[{i}]")]
    if isinstance(value, dict):
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            out += [f"{at}: {k} is unknown" for k in value if k not in known]
        out += [p for k, s in known.items() if k in value for p in inner(s, value[k], f"{at}.{k}")]
    for s in schema.get("allOf", []):
        out += inner(s)
    if "anyOf" in schema and all(inner(s) for s in schema["anyOf"]):
        out.append(f"{at}: no alternative fits")
    if "oneOf" in schema and sum(not inner(s) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: not exactly one alternative fits")
    if "not" in schema and not inner(schema["not"]):
        out.append(f"{at}: fits what it must not")
    if "if" in schema:
        out += inner(schema.get("then" if not inner(schema["if"]) else "else", {}))
    return out
