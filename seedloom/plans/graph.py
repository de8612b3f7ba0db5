"""The foreign-key graph: order, levels, root keys, a picture."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .model import SchemaModel


class CycleError(ValueError):
    """Tables refer to one another in a circle."""


def edges(schema: SchemaModel) -> list[tuple[str, str]]:
    """(child, parent) pairs; a table's references to itself are left out, with a warning: its rows may refer to later ones."""
    for t in schema.tables:
        if any(f.parent.lower() == t.name.lower() for f in t.foreign_keys):
            warnings.warn(f"{t.name} refers to itself; such rows are not ordered", stacklevel=2)
    return sorted({(t.name, schema.table(f.parent).name) for t in schema.tables for f in t.foreign_keys if f.parent.lower() != t.name.lower()})


def levels(names: Iterable[str], pairs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Tables by level: each after all of its parents. Raises CycleError with the tables of a circle."""
    left, pairs, out = list(names), list(pairs), []
    while left:
        ready = sorted(n for n in left if not any(c == n and p in left for c, p in pairs))
        if not ready:
            raise CycleError(f"a circle of references: {', '.join(sorted(left))}")
        out.append(ready)
        left = [n for n in left if n not in ready]
    return out


def order(schema: SchemaModel) -> list[str]:
    return [n for level in levels([t.name for t in schema.tables], edges(schema)) for n in level]


def root_key(schema: SchemaModel, table: str, column: str) -> tuple[str, str]:
    """The table and column where the values of a foreign-key column come from, by way of keys that are themselves references.

    Of several keys on one column the first decides. A column without a key is its own root.
    """
    seen: set[tuple[str, str]] = set()
    here = (schema.table(table).name, schema.table(table).column(column).name)
    while here not in seen:
        seen.add(here)
        t = schema.table(here[0])
        step = next(((f.parent, f.parent_columns[f.columns.index(c)]) for f in t.foreign_keys for c in f.columns if c.lower() == here[1].lower() and len(f.parent_columns) == len(f.columns)), None)
        if step is None:
            return here
        here = (schema.table(step[0]).name, schema.table(step[0]).column(step[1]).name)
    return here


def dot(schema: SchemaModel) -> str:
    """The graph in the DOT language."""
    lines = [f'  "{t.name}";' for t in schema.tables] + [f'  "{c}" -> "{p}";' for c, p in edges(schema)]
    return "digraph schema {\n" + "\n".join(lines) + "\n}\n"


def levels_frame(spark: SparkSession, pairs: list[tuple[str, str]], names: list[str]) -> DataFrame:
    """table_name, level by a recursive query, for schemas that are data themselves."""
    known, edges_ = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(pairs, "child string, parent string")
    # frames as parameters: no view has a name that another caller could take
    return spark.sql(
        """
        WITH RECURSIVE walk(name, level) AS (
            SELECT name, 0 FROM {known} WHERE name NOT IN (SELECT child FROM {edges})
            UNION ALL
            SELECT e.child, w.level + 1 FROM walk w JOIN {edges} e ON e.parent = w.name
        )
        SELECT name AS table_name, CAST(max(level) AS INT) AS level FROM walk GROUP BY name
        """,
        known=known,
        edges=edges_,
    )


def root_frame(spark: SparkSession, refs: list[tuple[str, str]]) -> DataFrame:
    """column_name, root_name of reference chains (from, to), 'table.column' each."""
    return spark.sql(
        """
        WITH RECURSIVE walk(src, dst) AS (
            SELECT src, dst FROM {refs}
            UNION ALL
            SELECT w.src, r.dst FROM walk w JOIN {refs} r ON r.src = w.dst
        )
        SELECT src AS column_name, dst AS root_name FROM walk WHERE dst NOT IN (SELECT src FROM {refs})
        """,
        refs=spark.createDataFrame(refs, "src string, dst string"),
    )
