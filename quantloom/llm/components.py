"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, join_hubs, materialize


#: Edge tables of fewer rows are joined by plain joins: one node has no more of them than a task can take.
PLAIN = 1 << 20


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    return edges.join(least.drop("n"), "u") if n < PLAIN else join_hubs(edges, materialize(least, "least"), ["u"], n)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _joined(both, least, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _joined(e, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge table (u, v): the component's smallest node.

    Every step keeps at most one row for each edge; aggregates combine before they are shuffled, and
    in large tables the edges of a node with very many are joined in place. Each round is written to the shared folder
    (the one before is deleted), so a lost executor costs one round at most. Self-loops and repeated
    edges do no harm; an empty table gives an empty table. The result is a written table.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = materialize(e, "edges")
    before = _mark(e)
    while True:
        new = materialize(_small_star(_large_star(e, before[0]).distinct(), before[0]).distinct(), "edges")
        now = _mark(new)
        discard(e)
        e = new
        if now == before:
            break
        before = now
    out = materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    discard(e)
    return out
