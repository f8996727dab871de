"""Functions of the query dialect as Spark columns."""

from rivulet.functions.scalar import (
    as_bigint,
    as_boolean,
    as_double,
    as_text,
    concat,
    header,
    json_get,
    json_text,
    length,
    like,
    round_half_up,
    safe_cast,
    safe_div,
    safe_mod,
    subject_matches,
    subject_part,
    substring,
    trim,
    tumbling,
)

__all__ = [
    "as_bigint", "as_boolean", "as_double", "as_text", "concat", "header", "json_get", "json_text", "length", "like", "round_half_up", "safe_cast",
    "safe_div", "safe_mod", "subject_matches", "subject_part", "substring", "trim", "tumbling",
]
