"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups, largest first, enter the open shard with the tightest remaining
capacity that still holds them; remaining capacities stand in a balanced search
tree. The capacity is the smallest for which the wanted number of shards is
enough, so shards come out near equal.

Groups of one size are interchangeable, so the packing needs only the histogram
of group sizes, and places as many groups of a size as fit into the tightest
shard at once. A table of B bytes has at most sqrt(2 B) distinct sizes (14
million for 100 TB), which bounds what the driver gets; the groups themselves
stay distributed and find their shard by their rank among those of their size.
Ranks are counted per size and hash bucket, with offsets from bucket counts, so
no task holds all groups of a common size or all rows of a shard.

Defined results: null texts count as empty, size 1; equal texts share a shard
and repeated rows keep a slot each; a group larger than the even share gets a
shard of its own and the rest is spread evenly; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolink.llm.common import store


class CapacityTree:
    """Open shards by remaining capacity in a balanced search tree (a treap).

    The tightest fit, insertion and removal take logarithmic time.
    """

    def __init__(self):
        self._root = None
        self._state = 88172645463325252

    def _priority(self) -> int:
        x = self._state
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        self._state = x
        return x

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def add(self, remaining: int, shard: int) -> None:
        key = (remaining, shard)
        low, high = self._split(self._root, key)
        self._root = self._merge(self._merge(low, (key, self._priority(), None, None)), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the shard with the least remaining capacity of at least size."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        least, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self._root = self._merge(low, rest)
        return least[0]


def pack(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit decreasing over (size, count) pairs; returns (size, count, shard) runs.

    Groups larger than the capacity get a shard each. With most, the shards at
    hand are the first most ones; None if they aren't enough.
    """
    tree, opened, runs = CapacityTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        while count:
            found = tree.take_tightest(size) if size <= capacity else None
            if found is None:
                if most is not None and opened == most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            remaining, shard = found
            n = count if size == 0 else min(count, remaining // size)
            runs.append((size, n, shard))
            tree.add(remaining - n * size, shard)
            count -= n
    return runs


def pack_evenly(histogram: list[tuple[int, int]], shards: int, tolerance: float = 1e-4) -> list[tuple[int, int, int]]:
    """pack() at the smallest capacity, within tolerance, for which so many shards are enough."""
    total = sum(s * c for s, c in histogram)
    low = -(-total // shards)
    step, high = max(1, int(low * tolerance)), low
    best = pack(histogram, high, shards)
    while best is None:
        low, high, step = high, high + step, step * 2
        best = pack(histogram, high, shards)
    while high - low > max(1, int(low * tolerance)):
        mid = (low + high) // 2
        found = pack(histogram, mid, shards)
        if found is None:
            low = mid
        else:
            best, high = found, mid
    return best


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str, rows: int, bucket_rows: int = 100_000) -> DataFrame:
    """df with a gapless rank from 0 among the rows of equal by columns, without one task for a large group.

    Rows are dealt to hash buckets by the order columns; ranks within a bucket
    are shifted by the counts of the buckets before it.
    """
    buckets = max(1, -(-rows // bucket_rows))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__bucket").orderBy(*order)
    out = dealt.withColumn(name, F.row_number().over(within).cast("long") - 1)
    joined = out.join(counts, [*by, "__bucket"])
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__bucket", "__before")


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    Law: bytes. A size is the text's UTF-8 bytes plus 1.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = store(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(whole).cast("long") + 1).alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.xxhash64(whole).alias("__same"),
        ),
        "shard-rows",
    )
    groups = store(rows.groupBy("__same", "text_crc32", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("__group")), "shard-groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("__group").agg(F.count(F.lit(1))).collect()]
    ends: dict[int, list[int]] = {}
    homes: dict[int, list[int]] = {}
    for size, n, shard in pack_evenly(histogram, shards):
        upto = ends.setdefault(size, [])
        upto.append(n + (upto[-1] if upto else 0))
        homes.setdefault(size, []).append(shard)
    plan = spark.createDataFrame([(s, ends[s], homes[s]) for s in ends], "__group long, __ends array<long>, __homes array<int>")
    n_groups = sum(c for _, c in histogram)
    placed = (
        ranked(groups, ["__group"], [F.col("__same"), F.col("text_crc32"), F.col("size")], "__rank", n_groups)
        .join(plan, "__group")
        .select(
            "__same", "text_crc32", "size",
            F.element_at("__homes", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))) + 1).alias("shard"),
        )
    )
    homed = store(rows.join(placed, ["__same", "text_crc32", "size"]), "shard-homed")
    out = ranked(homed, ["shard"], [F.col("doc_id"), F.col("__same")], "slot", rows.count())
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
