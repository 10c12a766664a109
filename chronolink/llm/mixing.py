"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of each source form a stream: all its documents in a hashed order,
over and over, up to the source's target. The stream is cut into blocks. The
output shards are the leaves of a binary tree; at each inner node the exact
block quotas of all sources are divided between the two halves by a
multivariate-hypergeometric draw, so every shard gets its share of blocks and a
random, exactly conserved mix. Each shard draws its quota of disjoint blocks in
a permuted order and shuffles locally.

A source may hold a third of all rows, so positions in a stream are sums per
hash bucket plus offsets of the buckets before it, never one window over a
source. What reaches the driver is a row per source.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own and comes last; repeated rows are documents of
their own, in the order of their sizes;
targets that no words can meet (all sizes 0) are 0; an empty table gives no
rows; other columns are ignored, or kept by mix_documents.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolink.llm.common import WORD, store

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight, none above most times its size; the excess is shared again by weight."""
    total, left, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        per = total / sum(weights[i] for i in left)
        full = {i for i in left if weights[i] * per > most * sizes[i]}
        for i in full or left:
            out[i] = most * float(sizes[i]) if full else weights[i] * per
            total -= out[i] if full else 0.0
        if not full:
            break
        left -= full
    return out


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among draws without replacement: inversion outwards from the mode, in steps of the order of the standard deviation."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    left = rng.random()
    p_up = p_down = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    up = down = mode
    left -= p_up
    while left > 0 and (up < high or down > low) and max(p_up, p_down) > 1e-300:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, left = up + 1, left - p_up
            if left <= 0:
                return up
        else:
            p_up = 0.0
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, left = down - 1, left - p_down
            if left <= 0:
                return down
        else:
            p_down = 0.0
    return mode


def split_quotas(quotas: list[int], shards: int, seed: int = 0) -> list[list[int]]:
    """Block quotas per shard and source: a recursive multivariate-hypergeometric division.

    Shards get equal numbers of blocks, within one; columns add up to quotas.
    """
    rng = random.Random(seed)

    def descend(q: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [q]
        total = sum(q)
        draws, left, rest = total * (n // 2) // n, [], total
        for x in q:
            taken = _hypergeometric(rng, x, rest - x, draws)
            left.append(taken)
            draws, rest = draws - taken, rest - x
        return descend(left, n // 2) + descend([a - b for a, b in zip(q, left)], n - n // 2)

    return descend(list(quotas), shards)


def _planned(docs: DataFrame, shards: int, text: str, source: str, key: str, seed: int, block_words: int, same: bool, bucket_rows: int) -> DataFrame:
    """With same a hash of all columns as __same; then __id, __size, source_size, target, __words, __start and the tree's plan for every row.

    __start is the row's place in its source's stream; __words the stream's
    length; __blocks, __stride and __ends say which shard draws which block.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    keep = ["__same"] if same else []
    whole = [F.xxhash64(*docs.columns).alias("__same")] if same else []
    rows = docs.select(*whole, F.col(key).alias("__id"), F.col(source).alias("__source"), size.alias("__size"), order.alias("__order"))
    rows = store(rows, "mix-rows")
    n = rows.count()
    digits = 0
    while n > bucket_rows * 16**digits and digits < 8:
        digits += 1
    rows = rows.withColumn("__bucket", F.substring("__order", 1, digits))
    sums = store(rows.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum")), "mix-sums")
    sizes = sums.groupBy("__source").agg(F.sum("__sum")).collect()
    sizes = sorted(((r[0], r[1]) for r in sizes), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    wanted = targets([s for _, s in sizes], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    words = [min(math.floor(t + 0.5), MOST_REPEATS * s) for (_, s), t in zip(sizes, wanted)]
    quotas = [-(-w // block_words) for w in words]
    ends = _ends(split_quotas(quotas, shards, seed), len(sizes))
    spark = docs.sparkSession
    kind = docs.schema[source].dataType.simpleString()
    plan = spark.createDataFrame(
        [(s, z, float(t), w, q, _stride(q, seed + i), e) for i, ((s, z), t, w, q, e) in enumerate(zip(sizes, wanted, words, quotas, ends))],
        f"__source {kind}, source_size long, target double, __words long, __blocks long, __stride long, __ends array<long>",
    )
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    offsets = offsets.join(F.broadcast(plan), offsets["__source"].eqNullSafe(plan["__source"])).drop(plan["__source"])  # a row per source
    within = Window.partitionBy("__source", "__bucket").orderBy("__order", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__upto", F.sum("__size").over(within))
    offsets = offsets.withColumnsRenamed({"__source": "__s", "__bucket": "__b"})
    joined = placed.join(offsets, placed["__source"].eqNullSafe(F.col("__s")) & (placed["__bucket"] == F.col("__b")))
    start = F.col("__before") + F.col("__upto") - F.col("__size")
    return joined.select(*keep, "__id", "__source", "__size", "source_size", "target", "__words", start.alias("__start"), "__blocks", "__stride", "__ends")


def _ends(leaves: list[list[int]], sources: int) -> list[list[int]]:
    """Per source the running sums of its quotas over the shards."""
    out, total = [[] for _ in range(sources)], [0] * sources
    for leaf in leaves:
        for i, n in enumerate(leaf):
            total[i] += n
            out[i].append(total[i])
    return out


def _shard(block: Column, seed: int) -> Column:
    """The shard that draws a block: blocks in permuted order fill the shards' quotas in turn."""
    permuted = F.pmod(block * F.col("__stride") + seed, F.col("__blocks"))
    return F.size(F.filter("__ends", lambda e: e <= permuted))


def mix_blocks(
    docs: DataFrame, shards: int = 16, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42, block_words: int = 4096, bucket_rows: int = 50_000
) -> DataFrame:
    """doc_id, size, source_size, target, pieces of every row.

    pieces: the stretches of the row's copies in its source's stream that shards
    draw, as (copy, block, words, shard); a row that no shard draws has none.
    """
    rows = _planned(docs, shards, text, source, key, seed, block_words, False, bucket_rows)
    low = lambda copy: F.col("__start") + copy * F.col("source_size")
    high = lambda copy: F.least(low(copy) + F.col("__size"), F.col("__words"))

    def piece(copy: Column, block: Column) -> Column:
        n = F.least(high(copy), (block + 1) * block_words) - F.greatest(low(copy), block * block_words)
        return F.struct(copy.cast("int").alias("copy"), block.alias("block"), n.alias("words"), _shard(block, seed).alias("shard"))

    def of_copy(copy: Column) -> Column:
        blocks = F.sequence(F.floor(low(copy) / block_words), F.floor((high(copy) - 1) / block_words))
        return F.transform(blocks, lambda block: piece(copy, block))

    copies = F.filter(F.array(*[F.lit(i).cast("long") for i in range(MOST_REPEATS)]), lambda copy: high(copy) > low(copy))
    pieces = F.flatten(F.transform(copies, of_copy))
    return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", pieces.alias("pieces"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: taken adds up the words that the tree's shards draw."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return mix_blocks(docs, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("pieces").cast("long").alias("n_pieces"))


def mix_documents(
    docs: DataFrame, shards: int = 16, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42, block_words: int = 4096, bucket_rows: int = 50_000
) -> DataFrame:
    """The mix: docs' rows, each as often as its taken words make whole documents (to the nearest), with mix_shard.

    A copy belongs to the block of its source's stream in which it starts, and
    goes to the shard that draws the block; rows come in a hashed order within
    each shard.
    """
    spark = docs.sparkSession
    planned = _planned(docs, shards, text, source, key, seed, block_words, True, bucket_rows)
    low = lambda copy: F.col("__start") + copy * F.col("source_size")
    left = lambda copy: F.least(F.col("__size"), F.col("__words") - low(copy))
    copies = F.filter(F.array(*[F.lit(i).cast("long") for i in range(MOST_REPEATS)]), lambda copy: (F.col("__size") > 0) & (2 * left(copy) >= F.col("__size")))
    drawn = planned.withColumn("__copy", F.explode(copies))
    block = F.floor(low(F.col("__copy")) / block_words)
    drawn = drawn.select("__id", "__same", "__copy", _shard(block, seed).alias("mix_shard"), F.xxhash64("__id", "__copy", F.lit(seed)).alias("__shuffled"))
    draws = drawn.groupBy("__id", "__same").agg(F.collect_list(F.struct("mix_shard", "__shuffled")).alias("__draws"), F.count_if(F.col("__copy") == 0).alias("__rows"))
    draws = store(draws, "mix-draws").withColumnsRenamed({"__id": "__draw_id", "__same": "__draw_same"})
    rows = docs.withColumn("__same", F.xxhash64(*docs.columns))
    if draws.where("__rows > 1").limit(1).count():  # rows that are equal in all columns are drawn together
        rows = rows.dropDuplicates([key, "__same"])
    out = rows.join(draws.hint("merge"), rows[key].eqNullSafe(F.col("__draw_id")) & (F.col("__same") == F.col("__draw_same")))
    out = out.select(*[rows[c] for c in docs.columns], F.explode("__draws").alias("__draw"))
    out = out.select(*docs.columns, F.col("__draw.mix_shard").alias("mix_shard"), F.col("__draw.__shuffled").alias("__shuffled"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(parts, "mix_shard", F.pmod("__shuffled", F.lit(parts))).sortWithinPartitions("mix_shard", "__shuffled")
    return out.drop("__shuffled")


def _stride(blocks: int, seed: int) -> int:
    """A multiplier without common divisor with blocks, near the golden section: block * stride permutes the blocks."""
    stride = max(1, int(blocks * 0.6180339887) + seed % 7)
    while blocks and math.gcd(stride, blocks) != 1:
        stride += 1
    return stride
