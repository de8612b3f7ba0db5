"""A live database's schema by its JDBC driver's metadata, its catalog's value rules, and loading without order.

Metadata has some rows for each column of a schema, read by one connection of
the driver; rows of data only move by Spark's own JDBC reader and writer.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import SparkSession

from ..plans import constraints
from ..plans.dialects import detect
from ..plans.model import ColumnConstraint, ColumnModel, ForeignKey, SchemaModel, TableModel

#: Java.sql.Types, the names under which this library knows them.
TYPES = {
    -7: "BIT", -6: "TINYINT", 5: "SMALLINT", 4: "INTEGER", -5: "BIGINT", 6: "FLOAT", 7: "REAL", 8: "DOUBLE", 2: "NUMERIC", 3: "DECIMAL", 1: "CHAR", 12: "VARCHAR", -1: "LONGVARCHAR", 91: "DATE", 92: "TIME", 93: "TIMESTAMP",
    -2: "BINARY", -3: "VARBINARY", -4: "LONGVARBINARY", 1111: "OTHER", 2002: "STRUCT", 2003: "ARRAY", 2004: "BLOB", 2005: "CLOB", 16: "BOOLEAN", -15: "NCHAR", -9: "NVARCHAR", -16: "LONGNVARCHAR", 2011: "NCLOB", 2009: "SQLXML", 2013: "TIME_WITH_TIMEZONE", 2014: "TIMESTAMP_WITH_TIMEZONE",
}

#: Single-column CHECK rules and enum labels by dialect: table, column, rule or label; schema stands for the placeholder.
CATALOG_SQL = {
    "postgres": {
        "checks": "SELECT c.relname, a.attname, pg_get_constraintdef(k.oid) FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace s ON s.oid = c.relnamespace "
        "JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = k.conkey[1] WHERE k.contype = 'c' AND array_length(k.conkey, 1) = 1 AND s.nspname = {schema}",
        "labels": "SELECT c.relname, a.attname, l.enumlabel FROM pg_enum l JOIN pg_attribute a ON a.atttypid = l.enumtypid JOIN pg_class c ON c.oid = a.attrelid "
        "JOIN pg_namespace s ON s.oid = c.relnamespace WHERE a.attnum > 0 AND NOT a.attisdropped AND s.nspname = {schema} ORDER BY 1, 2, l.enumsortorder",
    },
    "mysql": {
        "checks": "SELECT t.table_name, '', k.check_clause FROM information_schema.check_constraints k JOIN information_schema.table_constraints t "
        "ON t.constraint_schema = k.constraint_schema AND t.constraint_name = k.constraint_name WHERE k.constraint_schema = {schema}",
        "labels": "SELECT table_name, column_name, column_type FROM information_schema.columns WHERE data_type = 'enum' AND table_schema = {schema} ORDER BY 1, 2",
    },
    "h2": {
        "checks": "SELECT t.table_name, '', k.check_clause FROM information_schema.check_constraints k JOIN information_schema.table_constraints t "
        "ON t.constraint_schema = k.constraint_schema AND t.constraint_name = k.constraint_name WHERE k.constraint_schema = {schema}",
    },
    "derby": {
        "checks": "SELECT t.tablename, '', k.checkdefinition FROM sys.syschecks k JOIN sys.sysconstraints c ON c.constraintid = k.constraintid JOIN sys.systables t ON t.tableid = c.tableid "
        "JOIN sys.sysschemas s ON s.schemaid = t.schemaid WHERE s.schemaname = {schema}",
    },
}
CATALOG_SQL["cockroach"], CATALOG_SQL["mariadb"] = CATALOG_SQL["postgres"], CATALOG_SQL["mysql"]

#: Connection properties by which a session doesn't enforce foreign keys, and a query that gives a value that shows it.
UNORDERED = {
    "postgres": ({"options": "-c session_replication_role=replica"}, "SHOW session_replication_role", "replica"),
    "mysql": ({"sessionVariables": "foreign_key_checks=0,unique_checks=0"}, "SELECT @@foreign_key_checks", "0"),
    "mariadb": ({"sessionVariables": "foreign_key_checks=0,unique_checks=0"}, "SELECT @@foreign_key_checks", "0"),
}


@contextmanager
def connected(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> Iterator:
    """A java.sql.Connection of the driver, closed at the end."""
    jvm, own = spark._jvm, dict(properties or {})
    if driver := own.pop("driver", None):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    props = jvm.java.util.Properties()
    for k, v in own.items():
        props.setProperty(k, str(v))
    connection = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        yield connection
    finally:
        connection.close()


def _rows(found, *names: str | int) -> list[tuple]:
    out = []
    try:
        while found.next():
            out.append(tuple(found.getString(n) for n in names))
    finally:
        found.close()
    return out


def query(connection, sql: str, columns: int) -> list[tuple]:
    """All rows of a small query, as text."""
    statement = connection.createStatement()
    try:
        return _rows(statement.executeQuery(sql), *range(1, columns + 1))
    finally:
        statement.close()


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def columns_of(meta, catalog: str | None, schema: str | None, table: str) -> tuple[ColumnModel, ...]:
    """In the order of their positions; digits only of decimal types."""
    names = ("COLUMN_NAME", "DATA_TYPE", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE", "IS_AUTOINCREMENT", "COLUMN_DEF", "ORDINAL_POSITION", "TYPE_NAME")
    out = []
    for name, kind, size, digits, nullable, identity, default, at, vendor in _rows(meta.getColumns(catalog, schema, table, None), *names):
        type_name = TYPES.get(int(kind), "OTHER")
        own = _number(digits) if type_name in ("NUMERIC", "DECIMAL") else None
        out.append(ColumnModel(name, type_name, _number(size), own, (nullable or "").upper() != "NO", (identity or "").upper() == "YES", default, int(at), vendor))
    return tuple(sorted(out, key=lambda c: c.ordinal))


def primary_key(meta, catalog: str | None, schema: str | None, table: str) -> tuple[str, ...]:
    """By the columns' numbers within the key."""
    found = _rows(meta.getPrimaryKeys(catalog, schema, table), "KEY_SEQ", "COLUMN_NAME")
    return tuple(name for _, name in sorted((int(n), name) for n, name in found))


def foreign_keys(meta, catalog: str | None, schema: str | None, table: str) -> tuple[ForeignKey, ...]:
    """One for each name, as the driver lists them; columns by their numbers within the key."""
    by_name: dict[str, list[tuple]] = {}
    for name, n, own, parent, of in _rows(meta.getImportedKeys(catalog, schema, table), "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"):
        by_name.setdefault(name or f"{table}_{parent}", []).append((int(n), own, parent, of))
    made = []
    for name, rows in by_name.items():
        rows.sort()
        made.append(ForeignKey(tuple(r[1] for r in rows), rows[0][2], tuple(r[3] for r in rows), name))
    return tuple(made)


def enum_labels(column_type: str) -> tuple[str, ...]:
    """Labels of a type written as enum('a','b')."""
    return tuple(v.replace("''", "'") for v in re.findall(r"'((?:[^']|'')*)'", column_type))


def value_rules(connection, dialect: str, schema: str | None, columns: Mapping[str, list[str]]) -> dict[str, dict[str, ColumnConstraint]]:
    """Table -> column -> allowed values or range, from the catalog; labels of an enum win over a check.

    columns: table -> its column names. Checks of other forms, or on more columns, are passed over with a warning.
    """
    out: dict[str, dict[str, ColumnConstraint]] = {t: {} for t in columns}
    sql = CATALOG_SQL.get(dialect)
    if sql is None:
        return out
    quoted = "'" + (schema or "").replace("'", "''") + "'"
    labels: dict[tuple[str, str], list[str]] = {}
    if "labels" in sql:
        for table, column, label in query(connection, sql["labels"].format(schema=quoted), 3):
            if table in out:
                labels.setdefault((table, column), []).extend(enum_labels(label) if label.lower().startswith("enum(") else [label])
    for (table, column), values in labels.items():
        out[table][column] = ColumnConstraint(values=tuple(values))
    for table, column, rule in sorted(query(connection, sql["checks"].format(schema=quoted), 3)):
        if table not in out:
            continue
        bare = re.sub(r"'(?:[^']|'')*'", "''", rule)
        named = [column] if column else [c for c in columns[table] if re.search(rf"(?<!\w){re.escape(c)}(?!\w)", bare, re.I)]
        found = constraints.parse_check(rule) if len(named) == 1 else None
        if found is None:
            warnings.warn(f"the check {rule} of {table} is not honored", stacklevel=2)
        else:
            out[table].setdefault(named[0], found)
    return out


def dialect_of(connection) -> str:
    product = connection.getMetaData().getDatabaseProductName()
    return "derby" if "derby" in product.lower() else detect(product)


def database_schema(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None, schema: str | None = None) -> SchemaModel:
    """All tables of a database's schema (the connection's own unless given): columns, keys, enum labels and single-column checks."""
    with connected(spark, url, properties) as connection:
        meta = connection.getMetaData()
        catalog, own = connection.getCatalog(), schema or connection.getSchema()
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        names = sorted(r[0] for r in _rows(meta.getTables(catalog, own, None, kinds), "TABLE_NAME"))
        columns = {n: columns_of(meta, catalog, own, n) for n in names}
        rules = value_rules(connection, dialect_of(connection), own or catalog, {n: [c.name for c in cs] for n, cs in columns.items()})
        tables = tuple(TableModel(n, columns[n], primary_key(meta, catalog, own, n), foreign_keys(meta, catalog, own, n), rules[n]) for n in names)
        return SchemaModel(tables, own, catalog, meta.getDatabaseProductName())


def unordered_properties(spark: SparkSession, url: str, dialect: str, properties: Mapping[str, str] | None = None) -> dict[str, str] | None:
    """Properties with which a connection's session doesn't enforce foreign keys; None, with a warning, where it can't be turned off.

    They hold for the connections of one write only: no session flag outlives it, so there is nothing to restore.
    A connection of the driver tries first, since a role may lack the right.
    """
    known = UNORDERED.get(dialect)
    if known is None:
        warnings.warn(f"{dialect} can't load without order; tables go parents first", stacklevel=2)
        return None
    extra, probe, shown = known
    both = {**(properties or {}), **extra}
    try:
        with connected(spark, url, both) as connection:
            ((value,),) = query(connection, probe, 1)
    except Exception as e:  # the driver's own exception classes differ
        warnings.warn(f"foreign keys can't be turned off ({e}); tables go parents first", stacklevel=2)
        return None
    if value.lower() != shown:
        warnings.warn("foreign keys stay on; tables go parents first", stacklevel=2)
        return None
    return both


def with_rules(schema: SchemaModel, rules: Mapping[str, Mapping[str, ColumnConstraint]]) -> SchemaModel:
    """The schema with more constraints, which win over those it has."""
    low = {t.lower(): r for t, r in rules.items()}
    return replace(schema, tables=tuple(replace(t, constraints={**t.constraints, **low.get(t.name.lower(), {})}) for t in schema.tables))
