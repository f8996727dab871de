"""SQL text for external databases: identifiers, typed tables, insert and upsert, incremental reads, error classes."""

from __future__ import annotations

from dataclasses import dataclass

from rivulet.errors import Unsupported
from rivulet.sources.connectors.schema import Field

#: The fields of a sink without a schema: the record as it is.
BLOB = [Field("offset", "bigint"), Field("subject", "text"), Field("key", "text", True), Field("value", "jsonb")]
#: How each database writes the types of a schema.
COLUMN_TYPES = {
    "postgres": {"text": "TEXT", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "timestamptz": "TIMESTAMPTZ", "jsonb": "JSONB"},
    "mysql": {"text": "TEXT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamptz": "DATETIME(6)", "jsonb": "JSON"},
    "mssql": {"text": "NVARCHAR(MAX)", "bigint": "BIGINT", "double": "FLOAT", "boolean": "BIT", "timestamptz": "DATETIMEOFFSET", "jsonb": "NVARCHAR(MAX)"},
    "sqlite": {"text": "TEXT", "bigint": "INTEGER", "double": "REAL", "boolean": "INTEGER", "timestamptz": "TEXT", "jsonb": "TEXT"},
}
#: SQLSTATE classes by what they mean for a record.
DUPLICATE = ("23505", "23000")
POISON_CLASSES = ("22", "23", "42")


@dataclass(frozen=True)
class Dialect:
    name: str

    def __post_init__(self):
        if self.name not in COLUMN_TYPES:
            raise Unsupported(f"database {self.name!r}", hint=", ".join(COLUMN_TYPES))

    def quote(self, name: str) -> str:
        if self.name == "mysql":
            return "`" + name.replace("`", "``") + "`"
        if self.name == "mssql":
            return "[" + name.replace("]", "]]") + "]"
        return '"' + name.replace('"', '""') + '"'

    def table(self, name: str) -> str:
        return ".".join(self.quote(p) for p in name.split("."))

    def mark(self, k: int) -> str:
        return {"postgres": f"${k}", "mssql": f"@P{k}"}.get(self.name, "?")

    def create(self, table: str, fields: list[Field], key: list[str]) -> str:
        def kind(f: Field) -> str:
            # Text that is part of a key needs a length in these two.
            if f.name in key and f.type in ("text", "jsonb"):
                return {"mysql": "VARCHAR(255)", "mssql": "NVARCHAR(450)"}.get(self.name, COLUMN_TYPES[self.name][f.type])
            return COLUMN_TYPES[self.name][f.type]

        columns = [f"{self.quote(f.name)} {kind(f)}{'' if f.nullable else ' NOT NULL'}" for f in fields]
        columns += [f"PRIMARY KEY ({', '.join(self.quote(k) for k in key)})"] if key else []
        text = f"({', '.join(columns)})"
        if self.name == "mssql":
            return f"IF OBJECT_ID(N'{table}', N'U') IS NULL CREATE TABLE {self.table(table)} {text}"
        return f"CREATE TABLE IF NOT EXISTS {self.table(table)} {text}"

    def insert(self, table: str, fields: list[Field]) -> str:
        names, marks = ", ".join(self.quote(f.name) for f in fields), ", ".join(self.mark(k + 1) for k in range(len(fields)))
        return f"INSERT INTO {self.table(table)} ({names}) VALUES ({marks})"

    def upsert(self, table: str, fields: list[Field], key: list[str]) -> str:
        """Insert, or update the columns outside the key where the key is there."""
        q = self.quote
        rest = [f.name for f in fields if f.name not in key]
        if self.name == "mssql":
            marks = ", ".join(f"{self.mark(k + 1)} AS {q(f.name)}" for k, f in enumerate(fields))
            update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
            return (
                f"MERGE {self.table(table)} WITH (HOLDLOCK) AS t USING (SELECT {marks}) AS s ON {' AND '.join(f't.{q(k)} = s.{q(k)}' for k in key)}{update}"
                f" WHEN NOT MATCHED THEN INSERT ({', '.join(q(f.name) for f in fields)}) VALUES ({', '.join('s.' + q(f.name) for f in fields)});"
            )
        if self.name == "mysql":
            sets = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest) or f"{q(key[0])} = {q(key[0])}"
            return f"{self.insert(table, fields)} ON DUPLICATE KEY UPDATE {sets}"
        sets = ", ".join(f"{q(c)} = excluded.{q(c)}" for c in rest)
        return f"{self.insert(table, fields)} ON CONFLICT ({', '.join(q(k) for k in key)}) DO {f'UPDATE SET {sets}' if sets else 'NOTHING'}"

    def move(self, table: str, stage: str, fields: list[Field], key: list[str], replace: bool = True) -> str:
        """All rows of `stage` to `table`; those with a known key replace the old ones or, without `replace`, are passed over."""
        q = self.quote
        names = ", ".join(q(f.name) for f in fields)
        rest = [f.name for f in fields if f.name not in key] if replace else []
        if self.name == "mssql":
            update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
            return (
                f"MERGE {self.table(table)} WITH (HOLDLOCK) AS t USING {self.table(stage)} AS s ON {' AND '.join(f't.{q(k)} = s.{q(k)}' for k in key)}{update}"
                f" WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join('s.' + q(f.name) for f in fields)});"
            )
        insert = f"INSERT INTO {self.table(table)} ({names}) SELECT {names} FROM {self.table(stage)}"
        if self.name == "mysql":
            return f"{insert} ON DUPLICATE KEY UPDATE {', '.join(f'{q(c)} = VALUES({q(c)})' for c in rest) or f'{q(key[0])} = {self.table(table)}.{q(key[0])}'}"
        # The condition that is always true tells SQLite that ON does not belong to a join.
        sets = ", ".join(f"{q(c)} = excluded.{q(c)}" for c in rest)
        return f"{insert} WHERE 1 = 1 ON CONFLICT ({', '.join(q(k) for k in key)}) DO {f'UPDATE SET {sets}' if sets else 'NOTHING'}"

    def poll(self, table: str, columns: list[str], tracking: str, limit: int) -> str:
        """The rows after a cursor value (the one mark), oldest first, at most `limit`."""
        names = ", ".join(self.quote(c) for c in columns) if columns else "*"
        tail = f"FROM {self.table(table)} WHERE {self.quote(tracking)} > {self.mark(1)} ORDER BY {self.quote(tracking)}"
        return f"SELECT TOP ({limit}) {names} {tail}" if self.name == "mssql" else f"SELECT {names} {tail} LIMIT {limit}"


def classify(sqlstate: str | None) -> str:
    """duplicate, poison or transient."""
    if sqlstate in DUPLICATE:
        return "duplicate"
    return "poison" if sqlstate and sqlstate[:2] in POISON_CLASSES else "transient"


def cdc_changes(capture: str) -> str:
    """The SQL Server function that lists the changes between two log positions (two marks)."""
    return f"SELECT * FROM cdc.fn_cdc_get_all_changes_{capture}(@P1, @P2, N'all update old') ORDER BY __$start_lsn, __$seqval"


#: SQL Server's operation codes.
CDC_OPERATIONS = {1: "delete", 2: "insert", 3: "update_before", 4: "update_after"}
