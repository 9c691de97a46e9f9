"""Scanners that need a state from character to character; they run in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced(text: str) -> list[str]:
    """Outermost {...} of a text, braces inside strings not counted; an open one at the end is left out."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if depth and quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif depth and c == '"':
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def inline(schema, definitions: dict | None = None):
    """The schema with each local $ref replaced by what it names."""
    if isinstance(schema, list):
        return [inline(x, definitions) for x in schema]
    if not isinstance(schema, dict):
        return schema
    definitions = schema.get("$defs", schema.get("definitions", {})) if definitions is None else definitions
    if "$ref" in schema:
        return inline(definitions[schema["$ref"].rsplit("/", 1)[1]], definitions)
    return {k: inline(v, definitions) for k, v in schema.items() if k not in ("$defs", "definitions")}


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Where a decoded value departs from a schema: type, enum, const, pattern, minimum, required, properties, additionalProperties, items, anyOf."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not any(number and (k == "number" or k == "integer" and float(value).is_integer()) if k in ("number", "integer") else isinstance(value, KINDS[k]) for k in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: value not allowed")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value < schema.get("minimum", value):
        out.append(f"{at}: too small")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        more = schema.get("additionalProperties", True)
        for k, v in value.items():
            rule = known.get(k, more)
            if rule is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(rule, dict):
                out += schema_errors(v, rule, f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        out += [e for i, v in enumerate(value) for e in schema_errors(v, schema["items"], f"{at}[{i}]")]
    if "anyOf" in schema and all(schema_errors(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: no alternative fits")
    return out


def braces(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: balanced(t or ""))

    return run(text)


def apply_script(names: list[str], script: list[tuple[str, str, str]]) -> tuple[list[str], str]:
    """Edits in order on a list of names: rename, remove, add, move_first, upper, suffix, require; it stops at the first missing target."""
    out = list(names)
    for op, target, arg in script:
        if op == "add":
            out.append(target)
        elif target not in out:
            return out, f"{op}: {target} not found"
        elif op == "remove":
            out.remove(target)
        elif op != "require":
            i = out.index(target)
            new = {"rename": arg, "upper": target.upper(), "suffix": target + arg}.get(op, target)
            if op == "move_first":
                out.insert(0, out.pop(i))
            else:
                out[i] = new
    return out, ""
