"""Keys of children, their global positions, and permutations within groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .generators import child_count, with_columns
from .mixing import FIRST, GAMMA, SECOND, with_mixed

#: Parents of one block of the two-pass prefix sum.
BLOCK = 1 << 16


def with_child_count(df: DataFrame, row: str, least: int, most: int, seed: int, name: str = "cnt") -> DataFrame:
    """df with the number of children of each row. No shuffle."""
    return with_columns(df, row, {name: (child_count(least, most, seed), seed)})


def expanded(df: DataFrame, count: str, position: str = "line_no", start: int = 1) -> DataFrame:
    """A row for each child, numbered from start within its parent; parents without children give none. No shuffle."""
    some = df.filter(F.col(count) > 0)
    return some.select("*", F.explode(F.sequence(F.lit(start), (F.col(count) + F.lit(start - 1)).cast("int"))).alias(position))


def total(spark: SparkSession, parents: int, least: int, most: int, seed: int) -> DataFrame:
    """One row, total: the sum of all child counts; in closed form where every parent has as many."""
    if least == most:
        return spark.sql(f"SELECT CAST({parents * least} AS BIGINT) AS total")
    counted = with_child_count(spark.range(parents), "id", least, most, seed)
    return counted.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total"))


def lines(spark: SparkSession, parents: int, least: int, most: int, seed: int) -> DataFrame:
    """parent, position (from 0) and id: the child's index among all children.

    Where counts differ, indexes come from a prefix sum in two passes: totals
    of blocks of parents are summed up in one small table (a row for 65,536
    parents), and each block is summed up by itself.
    """
    if least == most:
        return spark.range(parents * most).selectExpr(f"id DIV {most} AS parent", f"CAST(id % {most} AS INT) AS position", "id") if most else spark.range(0).selectExpr("id AS parent", "CAST(id AS INT) AS position", "id")
    counted = with_child_count(spark.range(parents).withColumnRenamed("id", "parent"), "parent", least, most, seed).withColumn("block", F.expr(f"parent DIV {BLOCK}"))
    totals = counted.groupBy("block").agg(F.sum("cnt").alias("held"))
    before = totals.select("block", (F.sum("held").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))
    within = F.sum("cnt").over(Window.partitionBy("block").orderBy("parent").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt")
    placed = counted.withColumn("within", within).join(before, "block")
    return expanded(placed, "cnt", "position", 0).select("parent", "position", (F.col("before") + F.col("within") + F.col("position")).alias("id"))


def ranked_permutation(df: DataFrame, row: str, size: int, seed: int, name: str, start: int = 0) -> DataFrame:
    """A permutation of [start, start + size) for each run of `size` rows, by the rank of a mixed row index within the run."""
    mixed = with_mixed(df.withColumn("__group", F.expr(f"({row}) DIV {size}")), {"__mixed": f"{row} + {seed}L"})
    rank = F.row_number().over(Window.partitionBy("__group").orderBy("__mixed", F.expr(row)))
    return mixed.withColumn(name, (rank + F.lit(start - 1)).cast("int")).drop("__group", "__mixed")


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def permuted(rows: np.ndarray, size: int, seed: int, start: int = 0) -> np.ndarray:
    """The permuted place of each row index: four Feistel rounds keyed by the group, walked until the value lies within it."""
    if not 1 <= size <= 1 << 30:
        raise ValueError("a group holds 1 to 2**30 rows")
    half = np.uint64(((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    with np.errstate(over="ignore"):
        keys = _mixed((rows // size).astype(np.uint64) + np.uint64(seed & ((1 << 64) - 1)) + np.uint64(GAMMA))
        out = (rows % size).astype(np.uint64)
        todo = np.arange(len(rows))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for step in range(1, 5):
                salt = np.uint64((step * FIRST) & ((1 << 64) - 1))
                left, right = right, left ^ (_mixed(right * np.uint64(GAMMA) + keys[todo] + salt) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= size]
    return (out.astype(np.int64) + start).astype(np.int32)


def keyed_permutation(df: DataFrame, row: str, size: int, seed: int, name: str, start: int = 0) -> DataFrame:
    """As ranked_permutation, without a shuffle: each row's place is computed from its index alone, in Arrow batches."""

    @F.pandas_udf("int")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permuted(rows.to_numpy(np.int64), size, seed, start))

    return df.withColumn(name, place(F.expr(row).cast("bigint")))


def wrapped_key(df: DataFrame, row: str, name: str, parents: int, start: int = 0) -> DataFrame:
    """A foreign key that runs over the parents' keys and starts again after the last."""
    return df.withColumn(name, F.expr(f"CAST({start} + ({row}) % {parents} AS BIGINT)"))


def zipf_column(df: DataFrame, row: str, name: str, size: int, exponent: float, seed: int, start: int = 1) -> DataFrame:
    """Zipf ranks of large tables (up to 50,000,000 ranks).

    The cumulative table is made in each Python worker from size and exponent
    and kept for its later batches: nothing is broadcast.
    """
    from .mixing import with_draws

    @F.pandas_udf("int")
    def search(draws: pd.Series) -> pd.Series:
        unit = (draws.to_numpy(np.int64) // 1024) * 1.1102230246251565e-16
        return pd.Series((start + np.searchsorted(_cdf(size, exponent)[:-1], unit, side="right")).astype(np.int32))

    drawn = with_draws(df, row, {"__draw": (seed, 0)})
    return drawn.withColumn(name, search("__draw")).drop("__draw")


_TABLES: dict[tuple[int, float], np.ndarray] = {}


def _cdf(size: int, exponent: float) -> np.ndarray:
    if not 1 <= size <= 50_000_000 or exponent < 0:
        raise ValueError("a Zipf distribution takes 1 to 50,000,000 ranks and an exponent of 0 or more")
    if (size, exponent) not in _TABLES:
        _TABLES.clear()
        weights = np.arange(1, size + 1, dtype=np.float64) ** -exponent
        _TABLES[size, exponent] = np.cumsum(weights / weights.sum())
    return _TABLES[size, exponent]
