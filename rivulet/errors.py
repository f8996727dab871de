"""Structured errors: a kind, a message, and where known a position and a hint."""

from __future__ import annotations

import re
from contextlib import contextmanager


class StreamError(Exception):
    kind = "EXECUTION_ERROR"

    def __init__(self, message: str, *, line: int | None = None, column: int | None = None, hint: str | None = None):
        super().__init__(message)
        self.message, self.line, self.column, self.hint = message, line, column, hint

    def to_dict(self) -> dict:
        out = {"error": self.kind, "message": self.message}
        return out | {k: v for k in ("line", "column", "hint") if (v := getattr(self, k)) is not None}


class ParseError(StreamError):
    kind = "PARSE_ERROR"


class Unsupported(StreamError):
    kind = "UNSUPPORTED"


class PlanError(StreamError):
    kind = "PLAN_ERROR"


class ExecutionError(StreamError):
    kind = "EXECUTION_ERROR"


class StorageError(StreamError):
    kind = "STORAGE_ERROR"


_AT = re.compile(r"line (\d+),? pos (\d+)")


@contextmanager
def translated():
    """Spark's own errors as the kinds above, with the position that Spark reports."""
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    try:
        yield
    except ParseException as e:
        at = _AT.search(str(e))
        raise ParseError(str(e).split("\n\n")[0], line=int(at[1]) if at else None, column=int(at[2]) + 1 if at else None) from e
    except AnalysisException as e:
        at = _AT.search(str(e))
        raise PlanError(str(e).split("\n\n")[0], line=int(at[1]) if at else None, column=int(at[2]) + 1 if at else None) from e
    except PySparkException as e:
        raise ExecutionError(str(e).split("\n\n")[0]) from e
