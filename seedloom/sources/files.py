"""Files: separated text, Parquet, descriptors of generators."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generators import DESCRIBED, Gen, with_columns

#: kind -> separator, extension
KINDS = {"csv": (",", "csv"), "tsv": ("\t", "txt"), "pipe": ("|", "txt")}


def rendered(df: DataFrame) -> DataFrame:
    """Columns that separated text can't hold, as text: arrays as {a,b}, bytes as [1, 2]; nulls stay."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "null"), F.lit("}")))
        elif isinstance(f.dataType, T.BinaryType):
            pairs = F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.pmod(F.conv(F.substring(F.hex(c), 2 * i + 1, F.lit(2)), 16, 10).cast("int") + 128, F.lit(256)) - 128)
            c = F.when(F.length(c) == 0, F.lit("[]")).when(c.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda x: x.cast("string")), ", "), F.lit("]")))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_text(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """A folder of files with a header each; quotes as RFC 4180 has them."""
    separator, extension = KINDS[kind]
    rendered(df).write.option("extension", extension).mode(mode).option("header", True).option("sep", separator).option("escape", '"').option("emptyValue", '""').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").csv(path)


def read_text(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "csv") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", KINDS[kind][0]).option("escape", '"').option("multiLine", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists", at_once: int = 8) -> None:
    """Parquet folders by table, up to `at_once` at the same time: no table waits for another.

    Small tables' jobs fill the gaps of large ones. If one fails, the others are finished, and its error is raised.
    """
    base = path.rstrip("/")
    together(at_once, [lambda n=n, df=df: df.write.mode(mode).parquet(f"{base}/{n}.parquet") for n, df in tables.items()])


def together(at_once: int, jobs: Sequence[Callable[[], None]]) -> None:
    """Run jobs in up to `at_once` threads; raise the first error when all have ended."""
    if at_once < 1:
        raise ValueError("at least one job runs at a time")
    with ThreadPoolExecutor(max_workers=min(at_once, max(1, len(jobs)))) as pool:
        wait(started := [pool.submit(j) for j in jobs])
    for f in started:
        f.result()


def generate(spark: SparkSession, columns: Mapping[str, tuple[Gen, int]], rows: int = 1000, partitions: int | None = None) -> DataFrame:
    """A flat table of generated columns: name -> (generator, seed)."""
    return with_columns(spark.range(0, rows, 1, partitions).toDF("__row"), "__row", columns).select(*columns)


def descriptor(columns: Mapping[str, tuple[Gen, int]], rows: int = 1000) -> str:
    """YAML that says how a flat table is generated, in YAML's JSON form, so that any reader of either takes it."""
    items = [{"name": n, "type": g.kind, "seed": seed, **g.params} for n, (g, seed) in columns.items()]
    return json.dumps({"rows": rows, "columns": items}, indent=2, default=str) + "\n"


def from_descriptor(text: str) -> tuple[dict[str, tuple[Gen, int]], int]:
    """The columns and the number of rows that descriptor() has written. Raises ValueError for a type that a descriptor can't carry."""
    found = json.loads(text)
    columns = {}
    for item in found["columns"]:
        own = {k: v for k, v in item.items() if k not in ("name", "type", "seed")}
        make = DESCRIBED.get(item["type"])
        if make is None:
            raise ValueError(f"no column can be made from a descriptor's type {item['type']}")
        columns[item["name"]] = (make(**own), item["seed"])
    return columns, found["rows"]
