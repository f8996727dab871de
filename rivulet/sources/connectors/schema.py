"""Typed schemas `name:type[?], ...` and the strict binding of JSON payloads to them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import ParseError
from rivulet.functions.scalar import json_path

#: The types of a schema and the Spark types that hold them.
TYPES = {"text": "string", "bigint": "bigint", "double": "double", "boolean": "boolean", "timestamptz": "timestamp", "jsonb": "string"}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = False


def parse(text: str) -> list[Field]:
    out, seen = [], set()
    for part in text.split(","):
        name, colon, kind = (x.strip() for x in part.partition(":"))
        nullable = kind.endswith("?")
        kind = kind.removesuffix("?").strip().lower()
        if not colon or not _IDENTIFIER.match(name):
            raise ParseError(f"bad field {part.strip()!r}: name:type is expected")
        if kind not in TYPES:
            raise ParseError(f"unknown type {kind!r} of {name}", hint=", ".join(TYPES))
        if name.lower() in seen:
            raise ParseError(f"field {name} stands twice")
        seen.add(name.lower())
        out.append(Field(name, kind, nullable))
    return out


def _bound(f: Field, payload: Column) -> tuple[Column, Column]:
    """(value, error): the error is null for a value that fits, and for a null that may be."""
    doc = F.try_parse_json(payload)
    path = json_path(f.name)
    v = F.try_variant_get(doc, path, "variant")
    kind = F.schema_of_variant(v)
    text = F.get_json_object(payload, path)
    missing = v.isNull() | F.is_variant_null(v)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    if f.type == "text":
        ok, value = (kind == "STRING") | number, text
    elif f.type == "bigint":
        value = text.try_cast("bigint")
        ok = number & value.isNotNull() & ~text.rlike("[.eE]")
    elif f.type == "double":
        ok, value = number, text.try_cast("double")
    elif f.type == "boolean":
        ok, value = kind == "BOOLEAN", text.try_cast("boolean")
    elif f.type == "timestamptz":
        value = F.when(text.rlike(_RFC3339), text.try_cast("timestamp"))
        ok = (kind == "STRING") & value.isNotNull()
    else:
        ok, value = F.lit(True), F.to_json(v)
    ok = F.coalesce(ok, F.lit(False))
    error = F.when(missing, F.lit(None) if f.nullable else F.lit(f"missing: {f.name}")).when(~ok, F.concat(F.lit(f"type: {f.name} is no {f.type}, but "), F.lower(kind)))
    return F.when(~missing & ok, value).cast(TYPES[f.type]), error.cast("string")


def bind(rows: DataFrame, schema: str | list[Field], payload: str = "payload") -> DataFrame:
    """`rows` with a column for each field and `error`: the first field that does not fit, or null.

    Unlike from_json this says why a record is poison: a bigint needs an integer, a double a number, text a string or
    number, timestamptz an RFC 3339 string; what is missing or null needs a nullable field.
    """
    fields = parse(schema) if isinstance(schema, str) else schema
    p = F.col(payload)
    whole = F.when(F.try_parse_json(p).isNull(), F.lit("payload is not JSON")).when(~F.schema_of_variant(F.try_parse_json(p)).startswith("OBJECT"), F.lit("payload is no object"))
    bound = {f.name: _bound(f, p) for f in fields}
    error = F.coalesce(whole, *[e for _, e in bound.values()])
    return rows.withColumns({name: v for name, (v, _) in bound.items()} | {"error": error})
