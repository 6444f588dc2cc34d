"""JSON schemas as column expressions: the Spark type of a schema, and the first path of a text that breaks it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds that a simplified schema is without.
LENGTHS = ("minItems", "maxItems", "minLength", "maxLength")
#: What the kinds of a variant are called, by JSON type.
KINDS = {"object": "^OBJECT<", "array": "^ARRAY<", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "integer": r"^(?:BIGINT|DECIMAL.*|DOUBLE)$", "number": r"^(?:BIGINT|DECIMAL.*|DOUBLE)$"}


def simplify(schema: object) -> object:
    """The schema without bounds on lengths, which a caller checks by itself."""
    if isinstance(schema, dict):
        return {k: simplify(v) for k, v in schema.items() if k not in LENGTHS}
    return [simplify(x) for x in schema] if isinstance(schema, list) else schema


def spark_type(schema: dict) -> str:
    """The type that values of the schema are read as."""
    kind = schema["type"]
    if kind == "object":
        return "struct<" + ", ".join(f"`{name}`: {spark_type(inner)}" for name, inner in schema.get("properties", {}).items()) + ">"
    if kind == "array":
        return f"array<{spark_type(schema['items'])}>"
    return {"string": "string", "boolean": "boolean", "integer": "bigint", "number": "double", "null": "void"}[kind]


def first_failure(text: Column, schema: dict) -> Column:
    """The first path of a JSON text that breaks the schema, in the schema's order, `$` for the whole; null if all is well.

    Known are type, properties, required, additionalProperties (false), items, minItems, maxItems, minLength,
    maxLength, minimum, maximum, pattern and enum. A null text and one that isn't JSON fail as a whole.
    """
    value = F.try_parse_json(text)
    return F.coalesce(F.when(value.isNull(), "$"), _failure(value, schema, F.lit("$")))


def _failure(value: Column, schema: dict, path: Column) -> Column:
    kind = F.schema_of_variant(value)
    checks: list[Column] = [F.when(value.isNull() | ~F.coalesce(kind.rlike(KINDS[schema["type"]]), F.lit(False)), path)]
    as_type = lambda t: F.try_variant_get(value, "$", t)

    def bad(condition: Column) -> None:
        checks.append(F.when(condition, path))

    if schema["type"] == "object":
        properties, names = schema.get("properties", {}), F.map_keys(as_type("map<string, variant>"))
        for name, inner in properties.items():
            found, at = F.try_variant_get(value, f"$['{name}']", "variant"), F.concat(path, F.lit(f".{name}"))
            there = F.array_contains(names, name)
            checks.append(F.when(there, _failure(found, inner, at)).otherwise(F.when(F.lit(name in schema.get("required", [])), at)))
        if schema.get("additionalProperties") is False:
            other = F.array_sort(F.array_except(names, F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")))
            checks.append(F.when(F.size(other) > 0, F.concat(path, F.lit("."), F.get(other, F.lit(0)))))
    elif schema["type"] == "array":
        items = as_type("array<variant>")
        if "minItems" in schema:
            bad(F.size(items) < schema["minItems"])
        if "maxItems" in schema:
            bad(F.size(items) > schema["maxItems"])
        if "items" in schema:
            inner = F.transform(items, lambda x, i: _failure(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            checks.append(F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0)))
    elif schema["type"] == "string":
        string = as_type("string")
        if "minLength" in schema:
            bad(F.length(string) < schema["minLength"])
        if "maxLength" in schema:
            bad(F.length(string) > schema["maxLength"])
        if "pattern" in schema:
            bad(~string.rlike(schema["pattern"]))
        if "enum" in schema:
            bad(~string.isin(*schema["enum"]))
    elif schema["type"] in ("integer", "number"):
        number = as_type("double")
        if schema["type"] == "integer":
            bad(number != F.floor(number))
        if "minimum" in schema:
            bad(number < schema["minimum"])
        if "maximum" in schema:
            bad(number > schema["maximum"])
    return F.coalesce(*checks)
