"""Edge logs, histories, queries and vectors from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arithmetic candidates per query, beside the positives and the recent past.
CANDIDATES = 10
RECENT = 3
#: A dictionary of at most so many event types is broadcast; one of more is joined by shuffling events.
TYPES_BROADCAST = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def edges_buy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts of their orders; times in seconds from the first."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return spark.sql(
        """SELECT o_custkey AS src, l_partkey AS dst, unix_timestamp(o_orderdate) - (SELECT min(unix_timestamp(o_orderdate)) FROM {orders}) AS time
        FROM {orders} JOIN {items} ON o_orderkey = l_orderkey""",
        orders=orders,
        items=items,
    )


def edges_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and coded event types; few destinations, many repetitions."""
    events = read_table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    # a shuffle by event type would move all events, once per reader, to a task per type
    few = events.select("event_type").distinct().limit(TYPES_BROADCAST + 1).count() <= TYPES_BROADCAST
    hint = "/*+ BROADCAST(t) */" if few else ""
    return spark.sql(
        f"""SELECT {hint} e.user_id AS src, CAST(t.dst AS BIGINT) AS dst, (unix_micros(CAST(e.ts AS TIMESTAMP)) - (SELECT min(unix_micros(CAST(ts AS TIMESTAMP))) FROM {{events}})) / 1000000 AS time
        FROM {{events}} e JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS dst FROM (SELECT DISTINCT event_type FROM {{events}}) d) t
        ON t.event_type = e.event_type""",
        events=events,
    )


#: The same relations for DuckDB.
SQL_EDGES_BUY = """SELECT o_custkey AS src, l_partkey AS dst, CAST(epoch(o_orderdate) AS BIGINT) - (SELECT min(CAST(epoch(o_orderdate) AS BIGINT)) FROM orders) AS time
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
SQL_EDGES_EVT = """SELECT e.user_id AS src, CAST(t.dst AS BIGINT) AS dst, (epoch_us(e.ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000000 AS time
FROM events e JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS dst FROM (SELECT DISTINCT event_type FROM events) d) t ON t.event_type = e.event_type"""

# History is what lies before nine tenths of the time span. Queries ask, for every (source, time) after it,
# about its positives, recent destinations and arithmetic candidates; what is offered twice counts once.
CUTOFF = "SELECT floor(0.9 * max(time)) AS cutoff FROM {edges}"
HISTORY = "SELECT src, dst, time FROM {edges} WHERE time < (SELECT cutoff FROM {cutoff})"
FUTURE = "SELECT src, dst, time FROM {edges} WHERE time >= (SELECT cutoff FROM {cutoff})"
ASKED = "SELECT DISTINCT src, time FROM {future}"
ASKED_INSIDE = "SELECT DISTINCT src, time FROM {edges} WHERE time >= (SELECT cutoff FROM {cutoff}) / 2"
POSITIVES_INSIDE = "SELECT e.src, e.time, e.dst FROM {edges} e WHERE e.time >= (SELECT cutoff FROM {cutoff}) / 2"
OFFERED = f"""
SELECT src, time, dst AS cand, 1 AS label FROM {{positives_of}}
UNION ALL SELECT a.src, a.time, (a.src * 31 + k.k * 97 + CAST(floor(a.time / 86400) AS BIGINT)) % ((SELECT max(dst) FROM {{edges}}) + 1) AS cand, 0 AS label FROM {{asked}} a CROSS JOIN {{ks}} k
UNION ALL SELECT a.src, a.time, r.dst AS cand, 0 AS label FROM {{asked}} a JOIN (
  SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY max(time) DESC, dst DESC) AS rn FROM {{history}} GROUP BY src, dst) h WHERE rn <= {RECENT}) r ON r.src = a.src
"""
QUERIES = """
SELECT qid, src, time, cand, label, CAST(row_number() OVER (PARTITION BY qid ORDER BY (cand * 7919) % 10007, cand) - 1 AS BIGINT) AS pos FROM (
  SELECT CAST(src AS BIGINT) * 1000000000 + CAST(floor(time) AS BIGINT) AS qid, src, time, cand, max(label) AS label FROM {offered} GROUP BY src, time, cand) g
"""
POSITIVES_OF = "SELECT e.src, e.time, e.dst FROM {edges} e WHERE e.time >= (SELECT cutoff FROM {cutoff})"
KS = " UNION ALL ".join(f"SELECT {k} AS k" for k in range(CANDIDATES))

RELATIONS = {
    "cutoff": CUTOFF, "history": HISTORY, "future": FUTURE, "asked": ASKED, "positives_of": POSITIVES_OF, "ks": KS, "offered": OFFERED, "queries": QUERIES,
}


#: Queries inside history, where the strict time bound decides: the whole log is history.
INSIDE = {"history": "SELECT src, dst, time FROM {edges}", "asked": ASKED_INSIDE, "positives_of": POSITIVES_INSIDE}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, dim, x: the components of the embeddings table."""
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return table.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


SQL_VECTORS = """SELECT vec_id AS id, CAST(i - 1 AS BIGINT) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM (
SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e"""
