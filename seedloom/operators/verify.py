"""Checks of data, each a DataFrame: rows that break a rule, or figures to compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.constraints import predicate
from ..plans.model import ColumnConstraint


def row_count(df: DataFrame, expected: int) -> DataFrame:
    """n_rows, expected, matches."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(expected).cast("bigint").alias("expected"), (F.col("n_rows") == expected).alias("matches"))


def domain_violations(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows with a value (not null) that isn't allowed."""
    return df.filter(~F.col(column).isin(list(allowed)))


def pattern_violations(df: DataFrame, column: str, like: str) -> DataFrame:
    return df.filter(~F.col(column).like(like))


def constant_violations(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) != F.lit(value))


def range_violations(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Rows with a value outside [least, most] in any of the columns."""
    broken = [~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]
    return df.filter(_any(broken))


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def null_violations(df: DataFrame, condition: str, column: str, null: bool) -> DataFrame:
    """Rows for which the condition holds and the column is not null (null=True) or null (null=False)."""
    return df.filter(F.expr(condition) & (F.col(column).isNotNull() if null else F.col(column).isNull()))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key and n_rows of keys that stand more than once; counted before the shuffle as far as possible."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Child rows whose key (child column: parent column) has no parent; a key with a null refers to nothing."""
    keys = parent.select(*(F.col(p).alias(f"__{i}") for i, p in enumerate(pairs.values())))
    whole = child.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in pairs))
    return whole.join(keys, [whole[c] == keys[f"__{i}"] for i, c in enumerate(pairs)], "left_anti")


def count_disagreements(parent: DataFrame, child: DataFrame, on: Mapping[str, str], stored: str) -> DataFrame:
    """Parent key, stored and actual counts where they differ. Children are counted before the join."""
    held = child.groupBy(*on.values()).agg(F.count(F.lit(1)).alias("actual")).select(*(F.col(c).alias(p) for p, c in on.items()), "actual")
    both = parent.select(*on, F.col(stored).cast("bigint").alias("stored")).join(held, list(on), "left")
    return both.select(*on, "stored", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual")).filter("stored <> actual")


def joined_violations(parent: DataFrame, child: DataFrame, on: Mapping[str, str], condition: str) -> DataFrame:
    """Rows of the equi-join of both for which a further condition holds."""
    left = parent.alias("p")
    right = child.alias("c")
    return left.join(right, [F.col(f"p.{a}") == F.col(f"c.{b}") for a, b in on.items()]).filter(condition)


def enumeration_mismatches(df: DataFrame, position: str, column: str, expected: DataFrame) -> DataFrame:
    """Rows whose value differs from the one expected at their position: expected has (position, value)."""
    want = expected.toDF("__at", "__value")
    return df.join(want, F.col(position) == F.col("__at")).filter(f"NOT (`{column}` <=> __value)").drop("__at", "__value")


def conformance(df: DataFrame, constraints: Mapping[str, ColumnConstraint]) -> DataFrame:
    """column_name, violations for each constraint, in one pass."""
    counts = df.agg(*(F.sum(F.when(~F.expr(predicate(f"`{c}`", k)), 1).otherwise(0)).cast("bigint").alias(c) for c, k in constraints.items()))
    pairs = ", ".join(f"'{c}', `{c}`" for c in constraints)
    return counts.selectExpr(f"stack({len(constraints)}, {pairs}) AS (column_name, violations)").selectExpr("column_name", "coalesce(violations, 0L) AS violations")


def variety(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n_<column>: distinct values of each column, one group by a time so that none is expanded over the others."""
    frames = [df.select(c).distinct().agg(F.count(c).alias(f"n_{c}")) for c in columns]
    out = frames[0]
    for f in frames[1:]:  # one row each
        out = out.join(F.broadcast(f))
    return out


def without_temporal(df: DataFrame) -> DataFrame:
    """df without its date and time columns, for comparisons of runs at different times."""
    moving = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, moving)))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: columns, only_left, only_right. One shuffle on all columns."""
    cols = left.columns
    a = left.select(*cols, F.lit(1).alias("__l"), F.lit(0).alias("__r"))
    b = right.select(*cols, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    both = a.unionAll(b).groupBy(*cols).agg((F.sum("__l") - F.sum("__r")).alias("__d")).filter("__d <> 0")
    return both.selectExpr(*(f"`{c}`" for c in cols), "greatest(__d, 0L) AS only_left", "greatest(-__d, 0L) AS only_right")


def checksum(df: DataFrame) -> DataFrame:
    """n_rows and an order-free sum of row hashes: equal for equal tables, without a shuffle of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def digest(df: DataFrame) -> DataFrame:
    """As checksum(), of the first 60 bits of the MD5 of each row's dump: any engine that has MD5 can compute it."""
    bits = F.conv(F.substring(F.md5(_line(df)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def beyond(df: DataFrame, column: str, threshold) -> DataFrame:
    """The rows above a threshold."""
    return df.filter(F.col(column) > F.lit(threshold))


def projection_differences(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """differences() of some columns, as between runs with other seeds or at other times."""
    return differences(left.select(*columns), right.select(*columns))


def _line(df: DataFrame) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in df.columns))


def dump(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One line of text for each row, columns parted by |, nulls as \\N, in order."""
    return df.orderBy(*(order or df.columns)).select(_line(df).alias("line"))
