"""Which generator a column of a type gets, by dialect."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import generators as g
from .model import ColumnModel

Factory = Callable[[ColumnModel], g.Gen]


class UnsupportedTypeError(ValueError):
    """A column's type has no generator."""


def _text(c: ColumnModel) -> g.Gen:
    return g.string(min(c.size or 10, 2000))


def _decimal(c: ColumnModel) -> g.Gen:
    return g.double() if c.size is None else g.decimal(c.size, c.digits or 0)


def _bits(c: ColumnModel) -> g.Gen:
    return g.bit() if c.size in (None, 1) else g.bit_string(c.size)


def _binary(c: ColumnModel) -> g.Gen:
    return g.binary(min(c.size or 25, 25))


def _typed(gen: g.Gen, sql_type: str) -> Factory:
    return lambda c: gen if gen.kind != "null" else g.null(sql_type)


DEFAULT: dict[str, Factory] = {
    "BIT": _bits, "TINYINT": lambda c: g.short(0, 255), "SMALLINT": lambda c: g.short(), "INTEGER": lambda c: g.integer(), "BIGINT": lambda c: g.long(),
    "FLOAT": lambda c: g.single(), "REAL": lambda c: g.single(), "DOUBLE": lambda c: g.double(), "NUMERIC": _decimal, "DECIMAL": _decimal,
    **dict.fromkeys(("CHAR", "VARCHAR", "LONGVARCHAR", "NCHAR", "NVARCHAR", "LONGNVARCHAR"), _text),
    "DATE": lambda c: g.date(), "TIME": lambda c: g.time(), "TIME_WITH_TIMEZONE": lambda c: g.time(), "TIMESTAMP": lambda c: g.timestamp(), "TIMESTAMP_WITH_TIMEZONE": lambda c: g.timestamp(),
    **dict.fromkeys(("BINARY", "VARBINARY", "LONGVARBINARY"), _binary), "BLOB": lambda c: g.null("BINARY"), "CLOB": lambda c: g.null(), "NCLOB": lambda c: g.null(), "STRUCT": lambda c: g.null(), "BOOLEAN": lambda c: g.boolean(),
}

_POSTGRES_OTHER: dict[str, Factory] = {
    "uuid": lambda c: g.uuid(), "json": lambda c: g.jsonb(), "jsonb": lambda c: g.jsonb(), "inet": lambda c: g.inet(), "cidr": lambda c: g.cidr(), "macaddr": lambda c: g.mac(), "macaddr8": lambda c: g.mac(8),
    "interval": lambda c: g.interval(), "varbit": lambda c: g.bit_string(c.size or 1), "bit varying": lambda c: g.bit_string(c.size or 1),
}
_ARRAYS: dict[str, Factory] = {"_text": lambda c: g.string_array(), "_varchar": lambda c: g.string_array(), **dict.fromkeys(("_int2", "_int4", "_int8"), lambda c: g.integer_array())}


def _named(table: dict[str, Factory], kind: str) -> Factory:
    def pick(c: ColumnModel) -> g.Gen:
        found = table.get((c.vendor_type or "").lower())
        if found is None:
            raise UnsupportedTypeError(f"{kind} column {c.name} of type {c.vendor_type} has no generator")
        return found(c)

    return pick


_POSTGRES = DEFAULT | {
    "OTHER": _named(_POSTGRES_OTHER, "OTHER"), "ARRAY": _named(_ARRAYS, "ARRAY"), "SQLXML": lambda c: g.xml(),
    "BIT": lambda c: g.boolean() if (c.vendor_type or "").lower() == "bool" else _bits(c),
}
_MYSQL = DEFAULT | {"LONGVARCHAR": lambda c: g.jsonb() if (c.vendor_type or "").lower() == "json" else g.string(min(c.size or 2000, 2000)), "OTHER": _named({"json": lambda c: g.jsonb()}, "OTHER")}
_H2 = DEFAULT | {
    "TINYINT": lambda c: g.short(0, 127), "BINARY": lambda c: g.uuid() if (c.vendor_type or "").lower() == "uuid" else _binary(c),
    "OTHER": _named({"json": lambda c: g.jsonb(), "uuid": lambda c: g.uuid()}, "OTHER"),
}
DIALECTS = {"default": DEFAULT, "postgres": _POSTGRES, "cockroach": _POSTGRES, "mysql": _MYSQL, "mariadb": _MYSQL, "h2": _H2, "sqlite": DEFAULT, "derby": DEFAULT}


def extended(name: str, base: str = "default", **factories: Factory) -> str:
    """A dialect of its own: that of base with other factories for some types, by type name. Its name, for use wherever a dialect is named."""
    if base not in DIALECTS:
        raise KeyError(f"no dialect {base}")
    if name in DIALECTS:
        raise ValueError(f"there is a dialect {name} already")
    DIALECTS[name] = DIALECTS[base] | {k.upper(): f for k, f in factories.items()}
    return name


def detect(product: str) -> str:
    """The dialect of a database by its product's name; the order matters."""
    low = product.lower()
    return next((d for d in ("cockroach", "mariadb", "mysql", "postgres", "sqlite", "h2") if d in low), "default")


def default_generator(column: ColumnModel, dialect: str = "default") -> g.Gen:
    found = DIALECTS[dialect].get(column.type_name)
    if found is None:
        raise UnsupportedTypeError(f"column {column.name} of type {column.type_name} has no generator")
    return found(column)
