"""Counter-based draws: every value is a pure function of a seed and a row index.

draw(seed, row, j) = mix64(mix64(seed + j) + row), mix64 being the splitmix64
step. It needs 64-bit arithmetic that wraps; Spark's ANSI mode raises instead, and
takes its mode when a DataFrame is analysed, so draws are built under `wrapping`.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The splitmix64 constants.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_ALL = (1 << 64) - 1


def signed(v: int) -> int:
    """The 64-bit two's complement value of v."""
    v &= _ALL
    return v - (1 << 64) if v >> 63 else v


def mix64(v: int) -> int:
    """The splitmix64 step on a Python integer, signed."""
    z = (v + GAMMA) & _ALL
    z = ((z ^ (z >> 30)) * FIRST) & _ALL
    z = ((z ^ (z >> 27)) * SECOND) & _ALL
    return signed(z ^ (z >> 31))


@contextmanager
def wrapping(spark: SparkSession):
    """ANSI mode off while a DataFrame with wrapping arithmetic is built."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def draw_base(seed: int, j: int) -> int:
    """What is added to the row index before mixing."""
    return mix64(seed + j)


def with_mixed(df: DataFrame, mixed: dict[str, str]) -> DataFrame:
    """df with a column for each name: mix64 of a bigint expression.

    Each round is a projection of its own, so that a round's result is computed
    once though the next one uses it twice.
    """
    if not mixed:
        return df
    with wrapping(df.sparkSession):
        keep = [f"`{c}`" for c in df.columns]
        df = df.selectExpr(*keep, *(f"({e}) + {signed(GAMMA)}L AS `{n}`" for n, e in mixed.items()))
        for shift, factor in ((30, FIRST), (27, SECOND)):
            df = df.selectExpr(*keep, *(f"(`{n}` ^ shiftrightunsigned(`{n}`, {shift})) * {signed(factor)}L AS `{n}`" for n in mixed))
        return df.selectExpr(*keep, *(f"`{n}` ^ shiftrightunsigned(`{n}`, 31) AS `{n}`" for n in mixed))


def with_draws(df: DataFrame, row: str, seeds: dict[str, tuple]) -> DataFrame:
    """df with non-negative 63-bit draws, a column for each name: (seed, draw number), or those and a row expression of its own."""
    keep = [f"`{c}`" for c in df.columns]
    out = with_mixed(df, {n: f"{s[2] if len(s) > 2 else row} + {draw_base(s[0], s[1])}L" for n, s in seeds.items()})
    return out.selectExpr(*keep, *(f"shiftrightunsigned(`{n}`, 1) AS `{n}`" for n in seeds)) if seeds else df


# --- the same for DuckDB, in arithmetic of 128 bits ---


def duck_mixed(source: str, mixed: dict[str, str], tag: str = "m") -> str:
    """A chain of CTEs on `source` that ends in `{tag}`: its columns, and for each name the signed mix64 of an expression."""
    top = "18446744073709551616::HUGEINT"
    first = ", ".join(f"((((({e})::HUGEINT + {GAMMA}::HUGEINT) % {top}) + {top}) % {top})::UBIGINT AS {n}" for n, e in mixed.items())
    steps = [f"{tag}0 AS (SELECT *, {first} FROM {source})"]
    for i, (shift, factor) in enumerate(((30, FIRST), (27, SECOND))):
        change = ", ".join(f"(xor({n}, {n} >> {shift})::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS {n}" for n in mixed)
        steps.append(f"{tag}{i + 1} AS (SELECT * REPLACE ({change}) FROM {tag}{i})")
    last = ", ".join(f"CASE WHEN xor({n}, {n} >> 31) >= 9223372036854775808 THEN (xor({n}, {n} >> 31)::HUGEINT - {top})::BIGINT ELSE xor({n}, {n} >> 31)::BIGINT END AS {n}" for n in mixed)
    return ", ".join([*steps, f"{tag} AS (SELECT * REPLACE ({last}) FROM {tag}2)"])


def duck_draws(source: str, row: str, seeds: dict[str, tuple[int, int]], tag: str = "m") -> str:
    """As with_draws: CTEs that end in `{tag}`."""
    if not seeds:
        return f"{tag} AS (SELECT * FROM {source})"
    chain = duck_mixed(source, {n: f"{row}::HUGEINT + ({draw_base(s, j)})" for n, (s, j) in seeds.items()}, f"{tag}x")
    half = ", ".join(f"CASE WHEN {n} < 0 THEN (({n}::HUGEINT + 18446744073709551616::HUGEINT) // 2)::BIGINT ELSE {n} // 2 END AS {n}" for n in seeds)
    return f"{chain}, {tag} AS (SELECT * REPLACE ({half}) FROM {tag}x)"
