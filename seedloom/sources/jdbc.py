"""Databases by JDBC: writing tables, reading a schema, URL parameters."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .database import unordered_properties
from .files import together
from ..plans.model import SchemaModel, parse_ddl, table_from_struct

#: The drivers' parameters that make one statement of a batch.
BATCH_PARAMETER = {"postgres": "reWriteBatchedInserts", "cockroach": "reWriteBatchedInserts", "mysql": "rewriteBatchedStatements", "mariadb": "rewriteBatchedStatements"}


def parameter(url: str, name: str) -> str | None:
    """A URL parameter's value, name in any letter case."""
    _, _, query = url.partition("?")
    for item in query.split("&"):
        key, _, value = item.partition("=")
        if key and key.lower() == name.lower():
            return value
    return None


def has_parameter(url: str, name: str, value: str) -> bool:
    found = parameter(url, name)
    return found is not None and found.lower() == value.lower()


def with_parameter(url: str, name: str, value: str) -> str:
    """The URL with a parameter, unless it has one of that name."""
    if parameter(url, name) is not None:
        return url
    return url + ("&" if "?" in url and not url.endswith(("?", "&")) else "" if url.endswith(("?", "&")) else "?") + f"{name}={value}"


def batch_hint(url: str, dialect: str) -> str | None:
    """What to add to the URL so that batches go as one statement; None where nothing is missing."""
    name = BATCH_PARAMETER.get(dialect)
    return None if name is None or has_parameter(url, name, "true") else f"{name}=true"


def write_table(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, batch: int = 1000, partitions: int | None = None, dialect: str = "default") -> None:
    """Append by JDBC, `batch` rows a statement; each partition is a transaction, so `partitions` sets how often is committed.

    Not atomic across partitions: load into a staging table where that matters.
    """
    if (hint := batch_hint(url, dialect)) is not None:
        warnings.warn(f"the URL lacks {hint}; inserts are slower without it", stacklevel=2)
    out = df if partitions is None else df.repartition(partitions)
    out.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **(properties or {})).mode("append").save()


def commit_partitions(rows: int, batch: int = 1000, strategy: str = "per_partition", every: int = 1, partitions: int | None = None) -> int | None:
    """How many transactions a table's rows are written in: partitions for write_table.

    per_table: one, so the table is there whole or not at all (a single task writes it); every_n_batches: one for each
    `every` batches; per_partition: as many as given, or as the table has.
    """
    if every < 1 or batch < 1:
        raise ValueError("batches and commits need a row or more")
    match strategy:
        case "per_table":
            return 1
        case "every_n_batches":
            return max(1, -(-rows // (every * batch)))
        case "per_partition":
            return partitions
    raise ValueError(f"no commit strategy {strategy}")


def write_tables(tables: Mapping[str, DataFrame], url: str, levels: Sequence[Sequence[str]] | None = None, at_once: int = 8, unordered: bool = False, dialect: str = "default", properties: Mapping[str, str] | None = None, **options) -> None:
    """Tables into a database, level by level, those of one level at the same time; one by one in the given order without levels.

    unordered: all at once with foreign keys not enforced in the sessions that write, where the
    database and the role allow it, else as before. A table is a transaction for each of its partitions.
    """
    own = properties
    if unordered and tables:
        spark = next(iter(tables.values())).sparkSession
        found = unordered_properties(spark, url, dialect, properties)
        if found is not None:
            own, levels = found, [list(tables)]
    waves = [[n] for n in tables] if levels is None else levels
    for wave in waves:
        together(at_once, [lambda n=n: write_table(tables[n], url, n, own, dialect=dialect, **options) for n in wave if n in tables])


def catalog_schema(spark: SparkSession, database: str | None = None) -> SchemaModel:
    """All tables of a Spark database with their columns; keys are declared elsewhere, Spark's catalog holds none."""
    found = [t for t in spark.catalog.listTables(database) if t.tableType != "VIEW"]
    return SchemaModel(tuple(table_from_struct(t.name, spark.table(f"`{t.name}`" if t.isTemporary else f"`{database or spark.catalog.currentDatabase()}`.`{t.name}`").schema) for t in found), database)


def ddl_schema(text: str) -> SchemaModel:
    return parse_ddl(text)
