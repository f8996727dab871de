"""Scalar functions. All stay inside generated code; none runs Python on rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.errors import ParseError, PlanError
from rivulet.functions.interval import spark_interval


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def subject_part(subject: Column | str, index: int | Column) -> Column:
    """The dot-separated part at the 1-based index; null out of range."""
    i = index if isinstance(index, Column) else F.lit(index)
    return F.when(i >= 1, F.try_element_at(F.split(_col(subject), "[.]"), i.cast("int")))


def subject_regex(pattern: str) -> str:
    """A subject pattern as a regular expression: * is one token, > at the end one or more, '' everything."""
    if not pattern:
        return "(?s).*"
    parts = []
    for token in pattern.split("."):
        if token == ">":
            parts.append(".*")
            break
        parts.append("[^.]*" if token == "*" else re.escape(token))
    return "(?s)^" + "\\.".join(parts) + "\\z"


def subject_matches(subject: Column | str, pattern: str) -> Column:
    s = _col(subject)
    return F.when(s.isNotNull(), s.rlike(subject_regex(pattern)))


def json_path(*keys: str) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)


def json_text(payload: Column | str, *keys: str) -> Column:
    """payload -> key ->> key: text of a field; null if missing, JSON null, or not an object."""
    return F.get_json_object(_col(payload), json_path(*keys))


def json_get(payload: Column | str, *keys: str) -> Column:
    """payload -> key: the field as JSON text. Strings keep their quotes so that the result is JSON again."""
    v = F.try_variant_get(F.try_parse_json(_col(payload)), json_path(*keys), "variant")
    return F.to_json(v)


_TYPES = {
    "smallint": "bigint", "int": "bigint", "integer": "bigint", "bigint": "bigint", "int2": "bigint", "int4": "bigint", "int8": "bigint", "long": "bigint",
    "float": "double", "double": "double", "double precision": "double", "decimal": "double", "real": "double", "numeric": "double", "float4": "double", "float8": "double",
    "text": "string", "varchar": "string", "char": "string", "string": "string", "bool": "boolean", "boolean": "boolean", "json": "json", "jsonb": "json",
    "timestamp": "timestamp", "timestamptz": "timestamp", "date": "date",
}


def safe_cast(value: Column | str, type_name: str) -> Column:
    """CAST and :: that give null where a value does not fit. All integers are BIGINT, all fractions DOUBLE."""
    name = re.sub(r"\s*\(.*\)\s*$", "", type_name.strip().lower())
    name = re.sub(r"\s+", " ", name)
    if name not in _TYPES:
        raise PlanError(f"unknown type {type_name!r}")
    kind = _TYPES[name]
    c = _col(value)
    if kind == "json":
        return F.when(F.try_parse_json(c.cast("string")).isNotNull(), c.cast("string"))
    return c.try_cast(kind)


def as_bigint(c: Column | str) -> Column:
    return safe_cast(c, "bigint")


def as_double(c: Column | str) -> Column:
    return safe_cast(c, "double")


def as_text(c: Column | str) -> Column:
    return safe_cast(c, "text")


def as_boolean(c: Column | str) -> Column:
    return safe_cast(c, "boolean")


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Division in doubles; null on division by zero."""
    return F.try_divide(_col(a).try_cast("double"), _col(b).try_cast("double"))


def safe_mod(a: Column | str, b: Column | str) -> Column:
    return F.try_mod(_col(a), _col(b))


def like(value: Column | str, pattern: str) -> Column:
    """LIKE without regard to case."""
    return _col(value).ilike(pattern)


def length(c: Column | str) -> Column:
    """Length in bytes."""
    return F.octet_length(_col(c).cast("string")).cast("bigint")


def concat(*parts: Column | str) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *[_col(p).cast("string") for p in parts])


def substring(value: Column | str, start: int | Column, count: int | Column | None = None) -> Column:
    """Characters from the 1-based start; a start below 1 is 1, one beyond the end gives ''."""
    s, i = _col(value), start if isinstance(start, Column) else F.lit(start)
    first = F.greatest(i, F.lit(1)).cast("int")
    n = F.char_length(s) if count is None else F.greatest(count if isinstance(count, Column) else F.lit(count), F.lit(0)).cast("int")
    return F.substring(s, first, n)


def trim(c: Column | str) -> Column:
    """Trims Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Half away from zero; BIGINT for no digits."""
    out = F.round(_col(c), digits)
    return out.try_cast("bigint") if digits <= 0 else out


def header(name: str, headers: Column | str = "headers") -> Column:
    return F.try_element_at(_col(headers), F.lit(name))


def tumbling(ts: Column | str, size: str) -> Column:
    """Start of the tumbling window of the given size that holds `ts`, aligned to the epoch; use it in GROUP BY."""
    try:
        return F.window(_col(ts), spark_interval(size))["start"]
    except ParseError as e:
        raise PlanError(f"bad window size: {e.message}") from e
