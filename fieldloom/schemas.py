"""Validity against a JSON Schema (the usual keywords of draft 7) or a pydantic model.

``validate`` judges a parsed document and sorts what is wrong into wrong types, missing and extra
fields; ``column`` compiles the part of a schema that a variant column can be tested for.
"""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {
    "null": lambda x: x is None, "boolean": lambda x: isinstance(x, bool), "string": lambda x: isinstance(x, str), "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict), "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()),
}


_WORDS = frozenset(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems items additionalItems contains required minProperties maxProperties "
    "properties patternProperties additionalProperties propertyNames dependencies allOf anyOf oneOf not if then else $ref $id $schema $comment definitions $defs title description default examples format readOnly writeOnly "
    "contentMediaType contentEncoding".split()
)


def _same(a: Any, b: Any) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def referred(root: Any, ref: str) -> Any:
    """What ``#``, ``#/a/b`` or ``#name`` stands for within a schema."""
    if not ref.startswith("#"):
        raise ValueError(f"{ref} is outside the schema")
    if ref == "#":
        return root
    if not ref.startswith("#/"):
        stack = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if x.get("$id") == ref:
                    return x
                stack += x.values()
            elif isinstance(x, list):
                stack += x
        raise ValueError(f"the schema has no {ref}")
    x = root
    for part in ref[2:].split("/"):
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        try:
            x = x[int(part)] if isinstance(x, list) else x[part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"the schema has no {ref}") from None
    return x


def errors(x: Any, schema: Any, at: tuple = (), root: Any = None, seen: tuple = ()) -> list[tuple[str, tuple, str]]:
    """(keyword, place, name) of each violation. As draft 7 has it, words beside a ``$ref`` don't count, nor do formats; a word that the draft doesn't know is an error."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [("false", at, "")]
    if "$ref" in schema:
        if schema["$ref"] in seen:
            raise ValueError(f"{schema['$ref']} refers to itself")
        return errors(x, referred(root, schema["$ref"]), at, root, (*seen, schema["$ref"]))
    if unknown := set(schema) - _WORDS:
        raise ValueError(f"draft 7 has no {', '.join(sorted(unknown))}")
    found: list[tuple[str, tuple, str]] = []
    bad = lambda word, name="": found.append((word, at, name))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_TYPES[k](x) for k in kinds):
            bad("type")
    if "enum" in schema and not any(_same(x, v) for v in schema["enum"]):
        bad("enum")
    if "const" in schema and not _same(x, schema["const"]):
        bad("const")
    if _TYPES["number"](x):
        for word, broken in (("minimum", lambda m: x < m), ("maximum", lambda m: x > m), ("exclusiveMinimum", lambda m: x <= m), ("exclusiveMaximum", lambda m: x >= m), ("multipleOf", lambda m: abs(x / m - round(x / m)) > 1e-9)):
            if word in schema and broken(schema[word]):
                bad(word)
    if isinstance(x, str):
        if len(x) < schema.get("minLength", 0):
            bad("minLength")
        if len(x) > schema.get("maxLength", len(x)):
            bad("maxLength")
        if "pattern" in schema and not re.search(schema["pattern"], x):
            bad("pattern")
    if isinstance(x, list):
        if len(x) < schema.get("minItems", 0):
            bad("minItems")
        if len(x) > schema.get("maxItems", len(x)):
            bad("maxItems")
        if schema.get("uniqueItems") and any(_same(a, b) for i, a in enumerate(x) for b in x[:i]):
            bad("uniqueItems")
        items = schema.get("items", True)
        for i, v in enumerate(x):
            own = items if not isinstance(items, list) else items[i] if i < len(items) else schema.get("additionalItems", True)
            found += errors(v, own, (*at, i), root)
        if "contains" in schema and not any(not errors(v, schema["contains"], (), root) for v in x):
            bad("contains")
    if isinstance(x, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for name in schema.get("required", ()):
            if name not in x:
                bad("required", name)
        if len(x) < schema.get("minProperties", 0):
            bad("minProperties")
        if len(x) > schema.get("maxProperties", len(x)):
            bad("maxProperties")
        for name, v in x.items():
            own = [known[name]] if name in known else []
            own += [s for p, s in patterns.items() if re.search(p, name)]
            for s in own:
                found += errors(v, s, (*at, name), root)
            if "propertyNames" in schema and errors(name, schema["propertyNames"], (), root):
                bad("propertyNames")
        rest = [k for k in x if k not in known and not any(re.search(p, k) for p in patterns)]
        more = schema.get("additionalProperties", True)
        if more is False and rest:
            bad("additionalProperties", ", ".join(sorted(rest)))
        elif isinstance(more, dict):
            for k in rest:
                found += errors(x[k], more, (*at, k), root)
        for name, needs in schema.get("dependencies", {}).items():
            if name in x and (any(n not in x for n in needs) if isinstance(needs, list) else errors(x, needs, (), root, seen)):
                bad("dependencies")
    for s in schema.get("allOf", ()):
        found += errors(x, s, at, root, seen)
    if "anyOf" in schema and all(errors(x, s, (), root, seen) for s in schema["anyOf"]):
        bad("anyOf")
    if "oneOf" in schema and sum(not errors(x, s, (), root, seen) for s in schema["oneOf"]) != 1:
        bad("oneOf")
    if "not" in schema and not errors(x, schema["not"], (), root, seen):
        bad("not")
    if "if" in schema:
        branch = "else" if errors(x, schema["if"], (), root, seen) else "then"
        found += errors(x, schema.get(branch, True), at, root, seen)
    return found


def validate(x: Any, schema: Any) -> dict:
    """valid, type_errors, missing_required, extra_fields, total_fields and type_error_rate (None without fields)."""
    out: dict[str, Any] = {"type_errors": [], "missing_required": [], "extra_fields": []}
    if isinstance(schema, dict):
        out["total_fields"] = len(schema.get("properties", {}))
        for word, at, name in errors(x, schema):
            where = ".".join(map(str, at)) or "$"
            kind = {"required": "missing_required", "additionalProperties": "extra_fields"}.get(word, "type_errors")
            out[kind].append(name if word == "required" else where)
    elif isinstance(schema, type) and hasattr(schema, "model_validate"):
        out["total_fields"] = len(schema.model_fields)
        try:
            schema.model_validate(x)
        except ValueError as why:
            for e in why.errors():
                kind = {"missing": "missing_required", "extra_forbidden": "extra_fields"}.get(e["type"], "type_errors")
                out[kind].append(".".join(map(str, e["loc"])) or "$")
    else:
        raise TypeError("a schema is a dict or a pydantic model")
    out["valid"] = not (out["type_errors"] or out["missing_required"] or out["extra_fields"])
    out["type_error_rate"] = len(out["type_errors"]) / out["total_fields"] if out["total_fields"] else None
    return out


_VARIANT = {
    "string": "STRING.*", "boolean": "BOOLEAN", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)", "integer": "(BIGINT|TINYINT|SMALLINT|INT|DECIMAL\\(\\d+,0\\))",
    "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID",
}
_COLUMN_WORDS = frozenset("type enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern required properties additionalProperties title description default $schema".split())


def column(document: Column, schema: dict) -> Column:
    """Whether a variant obeys a schema of types, enumerations, bounds, lengths, patterns and nested properties."""
    if unknown := set(schema) - _COLUMN_WORDS:
        raise ValueError(f"only parsed documents can be tested for {', '.join(sorted(unknown))}")
    kind = F.schema_of_variant(document)
    tests: list[Column] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        tests.append(kind.rlike("^(" + "|".join(_VARIANT[k] for k in kinds) + ")$"))
    as_text, as_number = F.try_variant_get(document, "$", "string"), F.try_variant_get(document, "$", "double")
    is_text, is_number = kind.rlike("^STRING"), kind.rlike("^" + _VARIANT["number"] + "$")
    for word in ("enum", "const"):
        if word in schema:
            values = schema[word] if word == "enum" else [schema[word]]
            texts = [v for v in values if isinstance(v, str)]
            numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
            bools = [v for v in values if isinstance(v, bool)]
            test = (is_text & as_text.isin(texts)) | (is_number & as_number.isin(numbers)) | ((kind == "BOOLEAN") & F.try_variant_get(document, "$", "boolean").isin(bools))
            tests.append((test | (kind == "VOID")) if None in values else test)
    for word, test in (("minimum", lambda m: as_number >= m), ("maximum", lambda m: as_number <= m), ("exclusiveMinimum", lambda m: as_number > m), ("exclusiveMaximum", lambda m: as_number < m)):
        if word in schema:
            tests.append(~is_number | test(schema[word]))
    for word, test in (("minLength", lambda m: F.length(as_text) >= m), ("maxLength", lambda m: F.length(as_text) <= m), ("pattern", lambda p: as_text.rlike(p))):
        if word in schema:
            tests.append(~is_text | test(schema[word]))
    is_object, keys = kind.rlike("^OBJECT"), F.json_object_keys(F.to_json(document))
    for name in schema.get("required", ()):
        tests.append(~is_object | F.array_contains(keys, name))
    for name, own in schema.get("properties", {}).items():
        tests.append(~is_object | ~F.array_contains(keys, name) | column(F.try_variant_get(document, f"$['{name}']", "variant"), own))
    if schema.get("additionalProperties", True) is False:
        tests.append(~is_object | (F.size(F.array_except(keys, F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>"))) == 0))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out
