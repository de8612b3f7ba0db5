"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Far more rounds than any graph of this size has needed.
MOST_ROUNDS = 60
ROWS_IN_FILE = 500_000


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (a > b) hung on the least neighbour of each node; both: of larger neighbours, else of smaller ones."""
    if both:
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = sym.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges (a, b): root is the smallest node of its component.

    Edges with a null or with equal ends are ignored. Each round is written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = written(now, "components")
    # later rounds have no more edges: files of a fair size for them
    files = max(6, now.count() // ROWS_IN_FILE)
    before = None
    for _ in range(MOST_ROUNDS):
        last, now = now, written(_stars(_stars(now, True), False).coalesce(files), "components")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
