"""Incremental ingestion: new edge files update per-key profiles, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EDGE = "src long, dst long, time double"


def deltas(batch: DataFrame) -> DataFrame:
    """src, dst, n, first_time, last_time of a batch of edges."""
    return batch.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def pair_profile(spark: SparkSession, profile_path: str) -> DataFrame:
    """The pairs' counts and times over all batches so far: partial aggregates merged on read."""
    parts = spark.read.schema("src long, dst long, n long, first_time double, last_time double, batch long").parquet(profile_path)
    return parts.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


def follow_edges(spark: SparkSession, source: str, profile_path: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet edge files as they appear; each micro-batch writes its partial aggregates under its own number, so a retried batch replaces itself."""
    stream = spark.readStream.schema(EDGE).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        deltas(batch).write.mode("overwrite").parquet(f"{profile_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
