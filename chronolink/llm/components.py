"""Distributed union-find over an edge table: alternating large-star and small-star steps.

Nodes are long integers. Every step is a grouped minimum, which combines before
its shuffle, and a join on the node that Spark may split where a node has very
many edges. Small tables are dealt to as many tasks as their edges fill, so that
a step over few edges costs few tasks. Edges only ever live in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolink.llm.common import release, store


#: Edges of one task; tables that fill fewer tasks than the session's shuffle partitions are dealt to as many as they fill.
TASK_EDGES = 100_000


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """rows dealt by a to parts tasks; None leaves this to Spark, which then splits hot nodes too."""
    return rows.repartition(parts, "a") if parts else rows


def _star(edges: DataFrame, large: bool, parts: int | None) -> DataFrame:
    """One step over edges (a > b): connects neighbours of each node to the smallest of its neighbourhood.

    large: neighbours above the node; else the node itself and those below it.
    The result is dealt by a, so a small step after a large one moves no rows first.
    """
    if large:
        both = _dealt(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), parts)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select("a", F.col("m").alias("b")))
    return _dealt(out.where(F.col("a") != F.col("b")), parts).distinct()


def _parts(edges: int, spark: SparkSession) -> int | None:
    parts = edges // TASK_EDGES + 1
    return parts if parts < int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge table with columns a and b.

    Nodes that stand alone have no row. An empty table gives no rows; repeated
    edges, self-edges and either direction are allowed; edges with nulls are
    no edges. The result reads one stored table.
    """
    first = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    now = store(first.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    parts, state = _parts(now.count(), edges.sparkSession), None
    for _ in range(most_steps):
        before, now = now, store(_star(_star(now, True, parts), False, parts), "edges")
        release(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    else:
        raise RuntimeError("components() has not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", F.col("b").alias("component")).distinct())
