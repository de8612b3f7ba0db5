"""Generated rows as an unbounded stream: an extension, made possible by values that depend on the row index alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.generators import Gen, with_columns


def stream(spark: SparkSession, columns: Mapping[str, tuple[Gen, int]], rows_per_second: int = 1000, partitions: int | None = None) -> DataFrame:
    """timestamp (of arrival), value (the row index) and the columns; the same values as a batch of these rows has."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    if partitions is not None:
        source = source.option("numPartitions", partitions)
    return with_columns(source.load(), "value", columns)
