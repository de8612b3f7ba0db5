"""Filling a schema: every table as a DataFrame whose columns are functions of its row index.

Tables need no order and no barrier: a foreign key is the formula of its root
key at row index % rows of the root table, so it meets its parent by construction.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import wraps
from inspect import signature

from pyspark.sql import DataFrame, SparkSession

from ..functions import generators as g
from ..functions.seeds import column_seed
from . import graph
from .model import SchemaModel, TableModel
from .registry import Registry, resolve


ROW = "__row"


@dataclass(frozen=True)
class TableConfig:
    """Rows, generators of columns, and where a table's rows aren't a plain range, its source.

    source(spark) gives id, the row index, and columns that rows names: column -> expression of its row index.
    """

    rows: int | None = None
    columns: Mapping[str, g.Gen] = field(default_factory=dict)
    source: Callable[[SparkSession], DataFrame] | None = None
    row_of: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class FillConfig:
    seed: int = 0
    default_rows: int = 1000
    tables: Mapping[str, TableConfig] = field(default_factory=dict)
    registry: Registry | None = None
    dialect: str | None = None
    partitions: int | None = None

    def of(self, table: str) -> TableConfig:
        return next((c for n, c in self.tables.items() if n.lower() == table.lower()), TableConfig())

    def rows(self, table: str) -> int:
        own = self.of(table).rows
        return self.default_rows if own is None else own


def fill_table(spark: SparkSession, schema: SchemaModel, table: TableModel, config: FillConfig) -> DataFrame:
    from .dialects import detect

    dialect = config.dialect or detect(schema.product)
    own = config.of(table.name)
    made = {}
    for c in table.written():
        if c.name in own.columns or not any(c.name in f.columns for f in table.foreign_keys):
            of, column, at = table, c, own.row_of.get(c.name)
        else:
            name, root = graph.root_key(schema, table.name, c.name)
            of = schema.table(name)
            column, at = of.column(root), f"({ROW} % {max(1, config.rows(of.name))})"
        gen = resolve(column, config.of(of.name).columns, config.registry, of.constraints.get(column.name), dialect).gen
        seed = column_seed(config.seed, column.name, of.name, schema.name, schema.catalog, column.type_name, column.ordinal)
        made[c.name] = (gen, seed, at) if at else (gen, seed)
    rows = own.source(spark) if own.source else spark.range(0, config.rows(table.name), 1, config.partitions)
    rows = rows.withColumnRenamed("id", ROW)  # tables may have an id of their own
    return g.with_columns(rows, ROW, made).select(*(f"`{n}`" for n in made)) if made else rows.select()


def fill(spark: SparkSession, schema: SchemaModel, config: FillConfig = FillConfig()) -> dict[str, DataFrame]:
    """A DataFrame for each table, parents first. Raises CycleError where tables refer to one another in a circle."""
    return {name: fill_table(spark, schema, schema.table(name), config) for name in graph.order(schema)}


@dataclass(frozen=True)
class Filled:
    """A fluent front end for tests: Filled(ddl).rows(50).seed(7).table("t", TableConfig(...)).views(spark)."""

    ddl: str
    config: FillConfig = FillConfig(default_rows=100)

    def rows(self, n: int) -> Filled:
        return replace(self, config=replace(self.config, default_rows=n))

    def seed(self, n: int) -> Filled:
        return replace(self, config=replace(self.config, seed=n))

    def dialect(self, name: str) -> Filled:
        return replace(self, config=replace(self.config, dialect=name))

    def registry(self, registry: Registry) -> Filled:
        return replace(self, config=replace(self.config, registry=registry))

    def table(self, name: str, config: TableConfig) -> Filled:
        return replace(self, config=replace(self.config, tables={**self.config.tables, name: config}))

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        from .model import parse_ddl

        return fill(spark, parse_ddl(self.ddl), self.config)

    def views(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The frames, each also a temporary view of its table's name."""
        made = self.frames(spark)
        for name, df in made.items():
            df.createOrReplaceTempView(name)
        return made

    def __call__(self, test: Callable) -> Callable:
        """As a decorator: the test gets the tables as its argument `tables`, besides `spark`."""

        @wraps(test)
        def run(spark, *args, **kwargs):
            return test(spark, *args, tables=self.views(spark), **kwargs)

        kept = [p for n, p in signature(test).parameters.items() if n != "tables"]
        run.__signature__ = signature(test).replace(parameters=kept)
        return run


def synth_tables(spark: SparkSession, ddl: str, rows: int = 100, seed: int = 0, **tables: TableConfig) -> dict[str, DataFrame]:
    """Tables for tests: temporary views of all tables of a DDL script."""
    return Filled(ddl, FillConfig(seed, rows, tables)).views(spark)
