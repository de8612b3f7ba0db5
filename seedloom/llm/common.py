"""Shared ground of the operators: tables, shared storage, words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids up to which a written table of them is broadcast: some tens of bytes each.
MOST_IDS = 500_000


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can see.

    A local session without that setting, as in tests, has all its tasks in one machine, and takes its temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """At most so many rows in an Arrow batch, for what is computed inside: one of whole texts stands in the JVM several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as decimal text (null for a null id)."""
    return F.crc32(doc_id.cast("string"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other code point unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii_bytes(raw: bytes) -> bytes:
    """bytes.lower() changes A-Z only, so it is right on UTF-8."""
    return raw.lower()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def ids_fit(ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast if its rows are few enough."""
    return F.broadcast(ids) if ids.count() <= most else ids
