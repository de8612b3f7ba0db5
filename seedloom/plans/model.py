"""The relational schema: tables, columns, keys and constraints, and readers for it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnModel:
    name: str
    type_name: str
    size: int | None = None
    digits: int | None = None
    nullable: bool = True
    identity: bool = False
    default: str | None = None
    ordinal: int = 1
    vendor_type: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """Columns that refer, in order, to the parent's key columns."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class ColumnConstraint:
    """Allowed values, or a numeric range with its inclusivity."""

    values: tuple[str, ...] = ()
    least: float | None = None
    least_inclusive: bool = True
    most: float | None = None
    most_inclusive: bool = True


@dataclass(frozen=True)
class TableModel:
    name: str
    columns: tuple[ColumnModel, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    constraints: dict[str, ColumnConstraint] = field(default_factory=dict)

    def column(self, name: str) -> ColumnModel:
        """By name, letter case apart."""
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"{self.name} has no column {name}")

    def written(self) -> tuple[ColumnModel, ...]:
        """Columns that are filled: those the database numbers itself are not."""
        return tuple(c for c in self.columns if not c.identity)

    def insert(self, quote: str = '"', schema: str | None = None) -> str:
        """The INSERT with a place for each filled column."""
        q = lambda x: quote + x.replace(quote, 2 * quote) + quote
        names = [q(c.name) for c in self.written()]
        table = (q(schema) + "." if schema else "") + q(self.name)
        return f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})"


@dataclass(frozen=True)
class SchemaModel:
    tables: tuple[TableModel, ...]
    name: str | None = None
    catalog: str | None = None
    product: str = ""

    def table(self, name: str) -> TableModel:
        for t in self.tables:
            if t.name.lower() == name.lower():
                return t
        raise KeyError(f"no table {name}")


#: SQL type names, the type they stand for.
ALIASES = {
    "int": "INTEGER", "int4": "INTEGER", "integer": "INTEGER", "serial": "INTEGER", "mediumint": "INTEGER", "int8": "BIGINT", "bigint": "BIGINT", "bigserial": "BIGINT", "int2": "SMALLINT", "smallint": "SMALLINT", "smallserial": "SMALLINT", "tinyint": "TINYINT",
    "decimal": "DECIMAL", "numeric": "NUMERIC", "real": "REAL", "float4": "REAL", "float": "FLOAT", "double": "DOUBLE", "double precision": "DOUBLE", "float8": "DOUBLE",
    "char": "CHAR", "character": "CHAR", "bpchar": "CHAR", "varchar": "VARCHAR", "character varying": "VARCHAR", "string": "VARCHAR", "text": "LONGVARCHAR", "longtext": "LONGVARCHAR", "nchar": "NCHAR", "nvarchar": "NVARCHAR",
    "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "datetime": "TIMESTAMP", "timestamptz": "TIMESTAMP_WITH_TIMEZONE", "timestamp with time zone": "TIMESTAMP_WITH_TIMEZONE", "time with time zone": "TIME_WITH_TIMEZONE",
    "bytea": "BINARY", "binary": "BINARY", "varbinary": "VARBINARY", "blob": "BLOB", "clob": "CLOB", "boolean": "BOOLEAN", "bool": "BOOLEAN", "bit": "BIT", "xml": "SQLXML",
    "uuid": "OTHER", "json": "OTHER", "jsonb": "OTHER", "inet": "OTHER", "cidr": "OTHER", "macaddr": "OTHER", "macaddr8": "OTHER", "interval": "OTHER", "varbit": "OTHER", "bit varying": "OTHER",
}


def _split(body: str) -> list[str]:
    """Items of a list by the commas that stand in no parentheses or quotes."""
    out, depth, quoted, at = [], 0, "", 0
    for i, c in enumerate(body):
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"`":
            quoted = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(body[at:i].strip())
            at = i + 1
    return [x for x in [*out, body[at:].strip()] if x]


def _bare(name: str) -> str:
    return name.strip().split(".")[-1].strip('"`[] ')


def _names(text: str) -> tuple[str, ...]:
    return tuple(_bare(re.split(r"\s", x.strip())[0]) for x in text.split(","))


def _closed(text: str, start: int) -> int:
    """The place after the parenthesis that closes the one at start."""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i + 1
    raise ValueError("a parenthesis isn't closed")


_COLUMN = re.compile(r"\s*([\"`\w]+)\s+((?:double precision|character varying|bit varying|timestamp with time zone|time with time zone|\w+))\s*(?:\(([^)]*)\))?\s*(\[\])?(.*)", re.I | re.S)


def parse_ddl(text: str) -> SchemaModel:
    """CREATE TABLE statements and ALTER TABLE ... ADD FOREIGN KEY: columns, keys, single-column checks; enum types as value sets."""
    from .constraints import parse_check

    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    enums = {_bare(m[1]).lower(): tuple(x.strip().strip("'").replace("''", "'") for x in _split(m[2])) for m in re.finditer(r"create\s+type\s+([\w.\"]+)\s+as\s+enum\s*\((.*?)\)", text, re.I | re.S)}
    tables: dict[str, dict] = {}
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", text, re.I):
        body = text[m.end() : _closed(text, m.end() - 1) - 1]
        t = tables[_bare(m[1])] = {"columns": [], "pk": (), "fks": [], "checks": {}}
        for item in _split(body):
            rest = re.sub(r"^constraint\s+\S+\s+", "", item, flags=re.I)
            low = rest.lower()
            if low.startswith("primary key"):
                t["pk"] = _names(re.search(r"\((.*?)\)", rest, re.S)[1])
            elif low.startswith("foreign key"):
                f = re.match(r"foreign\s+key\s*\((.*?)\)\s*references\s+([\w.\"`]+)\s*(?:\((.*?)\))?", rest, re.I | re.S)
                t["fks"].append((_names(f[1]), _bare(f[2]), _names(f[3]) if f[3] else ()))
            elif low.startswith("check"):
                _add_check(t, rest, parse_check)
            elif (m_ := re.match(r"(?:unique|index|key|exclude|inverted|fulltext)\b\s*([\w\"`]*)", low)) and not (_bare(m_[1]) in ALIASES or _bare(m_[1]) in enums):
                continue  # an index; a column may have such a name, but then a type follows
            else:
                _add_column(t, item, enums, parse_check)
    for m in re.finditer(r"alter\s+table\s+(?:only\s+)?([\w.\"`]+)\s+add\s+(?:constraint\s+\S+\s+)?foreign\s+key\s*\((.*?)\)\s*references\s+([\w.\"`]+)\s*(?:\((.*?)\))?", text, re.I | re.S):
        tables[_bare(m[1])]["fks"].append((_names(m[2]), _bare(m[3]), _names(m[4]) if m[4] else ()))
    made = []
    for name, t in tables.items():
        fks = tuple(ForeignKey(c, p, r or tables.get(p, {"pk": ()})["pk"], f"{name}_fk{i + 1}") for i, (c, p, r) in enumerate(t["fks"]))
        made.append(TableModel(name, tuple(t["columns"]), t["pk"], fks, t["checks"]))
    return SchemaModel(tuple(made))


def _add_check(t: dict, text: str, parse) -> None:
    """A table check counts where it names a single column."""
    at = text.index("(")
    body = text[at : _closed(text, at)]
    names = {c.name for c in t["columns"] if re.search(rf"\b{re.escape(c.name)}\b", body, re.I)}
    found = parse(body)
    if len(names) == 1 and found is not None:
        t["checks"].setdefault(names.pop(), found)


def _add_column(t: dict, item: str, enums: dict, parse) -> None:
    m = _COLUMN.match(item)
    if not m:
        raise ValueError(f"can't read the column {item!r}")
    name, kind, args, array, rest = _bare(m[1]), m[2].lower(), m[3], m[4], m[5] or ""
    numbers = [int(x) for x in (args or "").split(",") if x.strip().isdigit()]
    low = rest.lower()
    known = ALIASES.get(kind, "VARCHAR" if kind in enums else "OTHER")
    vendor = ("_" + {"integer": "int4", "int": "int4", "bigint": "int8", "smallint": "int2", "varchar": "text", "string": "text"}.get(kind, kind)) if array else kind
    size = numbers[0] if numbers else None
    t["columns"].append(
        ColumnModel(name, "ARRAY" if array else known, size, numbers[1] if len(numbers) > 1 else 0 if numbers and known in ("DECIMAL", "NUMERIC") else None, "not null" not in low and "primary key" not in low, "serial" in kind or "auto_increment" in low or "identity" in low or "autoincrement" in low, (re.search(r"default\s+('[^']*'|\S+)", rest, re.I) or [None, None])[1], len(t["columns"]) + 1, vendor)
    )
    if "primary key" in low:
        t["pk"] = (name,)
    if r := re.search(r"references\s+([\w.\"`]+)\s*(?:\((.*?)\))?", rest, re.I):
        t["fks"].append(((name,), _bare(r[1]), _names(r[2]) if r[2] else ()))
    if c := re.search(r"check\s*\(", rest, re.I):
        found = parse(rest[c.end() - 1 : _closed(rest, c.end() - 1)])
        if found is not None:
            t["checks"][name] = found
    if kind in enums:  # an enum wins over a check
        t["checks"][name] = ColumnConstraint(values=enums[kind])


_SPARK = [(T.StringType, "VARCHAR"), (T.LongType, "BIGINT"), (T.IntegerType, "INTEGER"), (T.ShortType, "SMALLINT"), (T.ByteType, "TINYINT"), (T.DoubleType, "DOUBLE"), (T.FloatType, "REAL"), (T.BooleanType, "BOOLEAN"), (T.DateType, "DATE"), (T.TimestampNTZType, "TIMESTAMP"), (T.TimestampType, "TIMESTAMP_WITH_TIMEZONE"), (T.BinaryType, "BINARY")]


def table_from_struct(name: str, schema: T.StructType, primary_key: tuple[str, ...] = (), foreign_keys: tuple[ForeignKey, ...] = ()) -> TableModel:
    """A table from a DataFrame's schema; a field's metadata may hold size, digits, identity and sql_type."""
    columns = []
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, T.DecimalType):
            kind, size, digits = "DECIMAL", f.dataType.precision, f.dataType.scale
        elif isinstance(f.dataType, T.ArrayType):
            kind, size, digits = "ARRAY", None, None
        else:
            kind, size, digits = next((k for c, k in _SPARK if isinstance(f.dataType, c)), "OTHER"), None, None
        meta = f.metadata or {}
        vendor = meta.get("sql_type", ("_text" if isinstance(getattr(f.dataType, "elementType", None), T.StringType) else "_int4") if kind == "ARRAY" else None)
        columns.append(ColumnModel(f.name, kind, meta.get("size", size), meta.get("digits", digits), f.nullable, bool(meta.get("identity")), None, i + 1, vendor))
    return TableModel(name, tuple(columns), primary_key, foreign_keys)
