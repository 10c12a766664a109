"""Substring dedup over a log-structured index of window fingerprints.

A passage repeats if a window of so many consecutive words starts in a document
with a smaller id too. Storing a hash of each window would outgrow the corpus,
so each window is represented by the least of the hashes of the half-length
windows inside it (its anchor): equal windows have equal anchors, and a text
has an anchor for about every thirteenth word.

The index holds sorted, immutable runs of anchor hashes, one per batch of
documents. Each new batch is merge-joined with every run; two runs of the same
level are compacted into one of the next, so a batch meets logarithmically many
runs. Anchors that a batch shares with history, or within itself, are hits.

Only windows whose anchor is a hit are then fingerprinted themselves, over 128
bits of all their words, and verified: a window goes if its smallest document
id is below its own. What finds hits and repeated documents without moving
texts is a Bloom filter of bounded size; its false positives cost time only.

Defined results: null and empty texts have no words; texts shorter than a
window lose nothing; a repetition within one document stays; rows that repeat an
id are one document for the comparison; rows with a null id
are cut against no one and cut no one; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolink.llm.common import WORD, shared_dir, store

_find = re.compile(WORD.encode()).findall
#: Odd multipliers of the two polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, list[np.ndarray]] = {}


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n of both multipliers and of their inverses, modulo 2^64."""
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASES[0], pow(_BASES[0], -1, 1 << 64), _BASES[1], pow(_BASES[1], -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            known = 1
            while known < size:
                step = np.uint64(pow(base, known, 1 << 64))
                p[known : 2 * known] = p[:known] * step
                known *= 2
            out.append(p)
        _powers[size] = out
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes per word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), np.uint64).reshape(-1, 2)


def window_hashes(hashes: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hash of each window of width words, independent of its place."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    tables = _power_tables(n)
    up, down = tables[2 * which], tables[2 * which + 1]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window's anchor; which windows begin a new anchor."""
    half = window // 2
    parts = window_hashes(hashes[:, 0], half, 0)
    span = window - half + 1
    if len(parts) < span:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least = np.lib.stride_tricks.sliding_window_view(parts, span).min(1)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    return least, new


class Bloom:
    """A Bloom filter over 64-bit keys as a bit array of bounded size."""

    def __init__(self, bits: np.ndarray, probes: int = 4):
        self.bits, self.probes = bits, probes
        self.mask = np.uint64(len(bits) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for i in range(self.probes):
            at = (keys >> np.uint64(13 * i)) & self.mask
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def of(keys: DataFrame, column: str, count: int, most_bits: int = 1 << 27, probes: int = 4) -> Bloom:
        """Of a column of well-mixed longs; at most most_bits bits (16 MB), gathered as words by a grouped OR."""
        bits = 1 << 12
        while bits < min(16 * count, most_bits):
            bits *= 2
        places = F.array(*[F.shiftrightunsigned(column, 13 * i).bitwiseAND(F.lit(bits - 1)) for i in range(probes)])
        at = keys.select(F.explode(places).alias("at"))
        one = F.expr("shiftleft(1L, cast(at & 63 as int))")
        words = at.select(F.shiftright("at", 6).alias("w"), one.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
        out = np.zeros(bits // 64, np.uint64)
        got = words.toArrow()
        out[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
        return Bloom(out, probes)


def _text_hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode()) >> 1


def _document_hashes(text: str | None) -> np.ndarray:
    return word_hashes(_find((text or "").encode()))


class WindowIndex:
    """Sorted immutable runs of anchor hashes with the smallest id of each.

    Runs are tables bucketed and sorted by hash in the shared folder, so joins
    with them merge without a shuffle of the run.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.runs: list[tuple[int, str]] = []
        self._made: list[str] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run_{level}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{shared_dir(self.spark)}/{name}").format("parquet").saveAsTable(name)
        self._made.append(name)
        return name

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Appends a batch (columns h and id) as a run; returns tables of the hashes it shares, within itself or with history."""
        rows = batch.repartition(self.buckets, "h").groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        name = self._write(rows, 0)
        new = self.spark.table(name)
        shared = new.where(F.col("first") < F.col("last")).select("h")
        for _, run in self.runs:
            shared = shared.union(new.join(self.spark.table(run).select("h").hint("merge"), "h").select("h"))
        hits = store(shared.distinct(), "shared-anchors")
        self.runs.append((0, name))
        self._compact()
        return [hits]

    def _compact(self) -> None:
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs.pop(), self.runs.pop()
            both = self.spark.table(a).union(self.spark.table(b))
            merged = both.repartition(self.buckets, "h").groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            self.runs.append((level + 1, self._write(merged, level + 1)))

    def close(self) -> None:
        """Forgets the tables' names; their files stay in the shared folder."""
        for name in self._made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """h, id: anchor hashes of each document, without repetition next to each other."""

    def run(batches):
        for batch in batches:
            found, ids = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                least, new = anchors(_document_hashes(text), window)
                if len(least):
                    own = np.unique(least[new])
                    found.append(own)
                    ids.append(np.full(len(own), i, np.int64))
            if found:
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "id"])

    return docs.mapInArrow(run, "h long, id long")


def _window_rows(docs: DataFrame, window: int, bloom) -> DataFrame:
    """a, b, id, at: fingerprint and start of the windows whose anchor is a hit.

    at has the start in its low 32 bits and the text's hash above them, as an id may stand on several texts.
    """

    def run(batches):
        hits: Bloom = bloom.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            rows = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = _document_hashes(text)
                least, new = anchors(hashes, window)
                if not len(least):
                    continue
                begin = np.flatnonzero(new)
                hit = hits.has(least[begin])
                if not hit.any():
                    continue
                at = np.flatnonzero(hit[np.cumsum(new) - 1])
                which = _text_hash(text) << 32
                for o, x in zip(out, (window_hashes(hashes[:, 0], window, 0)[at], window_hashes(hashes[:, 1], window, 1)[at], np.full(len(at), i), at + which)):
                    o.append(x)
                rows += len(at)
                if rows > 200_000:
                    yield _batch(out)
                    out, rows = [[], [], [], []], 0
            if rows:
                yield _batch(out)

    return docs.mapInArrow(run, "a long, b long, id long, at long")


def _batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    a, b, i, at = (np.concatenate(o) for o in out)
    columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(i.astype(np.int64)), pa.array(at.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "id", "at"])


def repeated_windows(docs: DataFrame, window: int = 50, batches: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, at: starts of the windows that start in a document with a smaller id too. docs arrive in batches by id."""
    spark = docs.sparkSession
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bounds = source.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("id") > bound).cast("int")
    found = store(_anchor_rows(source, window).withColumn("batch", batch), "anchors")
    index = WindowIndex(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = []
    for i in range(batches):
        hits += index.add(found.where(F.col("batch") == i).select("h", "id"))
    index.close()
    shared = hits[0]
    for h in hits[1:]:
        shared = shared.union(h)
    bloom = spark.sparkContext.broadcast(Bloom.of(shared, "h", shared.count()))  # at most 16 MB
    # read twice: computing these rows again takes less than keeping half the corpus' size on disk
    windows = _window_rows(source, window, bloom)
    least = windows.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where(F.col("least") < F.col("most"))
    return windows.join(least.select("a", "b", "least"), ["a", "b"]).where(F.col("id") > F.col("least")).select("id", "at")


def _kept(text: str | None, starts: np.ndarray | None, window: int) -> tuple[int, int, str]:
    """Number of words, number removed, kept words joined by a blank."""
    words = _find((text or "").encode())
    n = len(words)
    if starts is None or not len(starts):
        return n, 0, b" ".join(words)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    gone = np.cumsum(edge[:n]) > 0
    return n, int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone)])


def remove_repeats(docs: DataFrame, window: int = 50, batches: int = 4, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or kept_sha256) of every row of docs."""
    spark = docs.sparkSession
    starts = repeated_windows(docs, window, batches, text, key).groupBy("id").agg(F.collect_set("at").alias("starts"))
    starts = store(starts, "repeats")
    mixed = starts.select(F.xxhash64("id").alias("h"))
    bloom = spark.sparkContext.broadcast(Bloom.of(mixed, "h", starts.count()))  # at most 16 MB
    name = "kept_sha256" if digests else "kept_text"
    schema = f"doc_id long, n_words long, n_removed long, {name} string"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("long")).alias("h"))

    def cut(batches, untouched):
        for batch in batches:
            if untouched:
                keep = ~bloom.value.has(batch.column(2).to_numpy().view(np.uint64))
                batch = batch.filter(pa.array(keep))
            found = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                s = None
                if not untouched and batch.column(2)[i].is_valid:
                    s = batch.column(2)[i].values.to_numpy()
                    s = (s & 0xFFFFFFFF)[s >> 32 == _text_hash(t or "")]
                n, gone, kept = _kept(t, s, window)
                found.append((n, gone, hashlib.sha256(kept).hexdigest() if digests else kept.decode()))
            columns = [batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", name])

    def touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.value.has(batch.column(2).to_numpy().view(np.uint64))))

    whole = rows.mapInArrow(lambda b: cut(b, True), schema)
    some = rows.mapInArrow(touched, rows.schema).join(starts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return whole.union(some.select("doc_id", "text", "starts").mapInArrow(lambda b: cut(b, False), schema))
