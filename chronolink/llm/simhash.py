"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within 3 bits must meet in a common variant. The whole word would
need variants of two changed bits, 2,081 of them, as half of the odd radius
rounds up. Instead each third of the word is left out in turn: of three
differing bits, at least one lies in the third that is left out for some choice,
so two remain at most, and the variants within half of that, one changed bit,
meet: 132 variants of 42 or 43 bits per distinct fingerprint.

Variants are shuffled as keys. Within the rows of a key, a point is the key
with a value for the missing third. A point is near to a fingerprint that
differs from it by one bit at most, and far from one that differs by two.
Whatever is near to a point is linked with all that is near or far (1 + 2 bits),
so a star from one near fingerprint joins them all: no pairs are listed within
a group of copies, however large, and no link is lost. The stars of a partition
shrink to a forest before a distributed union-find joins them.

Equal fingerprints are one node from the start. Defined results: null and empty
texts have fingerprint 0, linked like any other; texts with one or two words
have one shingle; repeated rows are members like others; rows whose id is null
have a fingerprint and belong to the component of the rest of their group;
an empty table gives no rows; other columns are ignored, or kept by
drop_near_duplicates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolink.llm.common import WORD, store
from chronolink.llm.components import components

_find = re.compile(WORD.encode()).findall
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Bits of the three parts of a fingerprint, lowest first.
PARTS = ((0, 22), (22, 43), (43, 64))
RADIUS = 3


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 of each shingle of lower-cased words, repeats included."""
    words = _find((text or "").encode().translate(_LOWER))
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: -width]]]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprints(texts: list[str | None], width: int = 3, block: int = 1 << 16) -> np.ndarray:
    """Fingerprints as uint64: a bit is 1 if set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        hashes = np.array(shingle_hashes(t, width), np.uint64)
        if not len(hashes):
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), block):
            part = hashes[at : at + block]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = fingerprints(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {key_type}, fp long")


def _variants(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per part left out: (part, keys, fingerprints). The part's bits of a key are 0."""
    for part, (low, high) in enumerate(PARTS):
        missing = np.uint64(((1 << high) - 1) ^ ((1 << low) - 1))
        flips = np.array([0, *[1 << b for b in range(64) if not low <= b < high]], np.uint64)
        rest = fps & ~missing
        yield part, (rest[:, None] ^ flips[None, :]).ravel(), np.repeat(fps, len(flips))


def variant_rows(fps: DataFrame) -> DataFrame:
    """part, key, fp: all variants of each distinct fingerprint."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 4096):
                for part, keys, who in _variants(own[at : at + 4096]):
                    columns = [pa.array(np.full(len(keys), part, np.int8)), pa.array(keys.view(np.int64)), pa.array(who.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "part byte, key long, fp long")


def _stars(group: np.ndarray, near: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all in a group (equal rows of group) with one near fingerprint, where there is one."""
    order = np.lexsort((fp, ~near, *group))
    group, near, fp = [g[order] for g in group], near[order], fp[order]
    first = np.ones(len(fp), bool)
    first[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in group])
    head = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
    real = near[head] & (fp[head] != fp)
    return fp[head][real], fp[real]


def _links(part: int, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of one part, all of keys with several fingerprints."""
    low, high = PARTS[part]
    missing = np.uint64(((1 << high) - 1) ^ ((1 << low) - 1))
    value = fp & missing
    bits = np.array([1 << b for b in range(low, high)], np.uint64)
    # near: the key with the fingerprint's own value; far: one bit of the value changed
    points = np.concatenate([value, (value[:, None] ^ bits).ravel()])
    keys = np.concatenate([key, np.repeat(key, len(bits))])
    who = np.concatenate([fp, np.repeat(fp, len(bits))])
    near = np.zeros(len(who), bool)
    near[: len(fp)] = True
    found = [_stars((points, keys), near, who)]
    # all three differing bits in the missing part: near by one bit, far by two in the same half
    same = (fp & ~missing) == key
    key, fp, value = key[same], fp[same], value[same]
    half = len(bits) // 2
    pairs = np.array([a | b for h in (bits[:half], bits[half:]) for i, a in enumerate(h) for b in h[:i]], np.uint64)
    points = np.concatenate([value, (value[:, None] ^ bits).ravel(), (value[:, None] ^ pairs).ravel()])
    keys = np.concatenate([key, np.repeat(key, len(bits)), np.repeat(key, len(pairs))])
    who = np.concatenate([fp, np.repeat(fp, len(bits)), np.repeat(fp, len(pairs))])
    near = np.arange(len(who)) < len(fp) * (1 + len(bits))
    found.append(_stars((points, keys), near, who))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) with the same components as the links (a, b)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (before == root).all():
            break
    member = root != np.arange(len(nodes))
    return nodes[root[member]], nodes[member]


def _partition_links(batches) -> Iterator[pa.RecordBatch]:
    """Links within one partition of variant rows, as a forest; keys are whole in a partition."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
    if not rows:
        return
    part, key, fp = (np.concatenate(c) for c in zip(*rows))
    key, fp = key.view(np.uint64), fp.view(np.uint64)
    found = []
    for p in range(len(PARTS)):
        k, f = key[part == p], fp[part == p]
        order = np.argsort(k, kind="stable")
        k, f = k[order], f[order]
        several = np.zeros(len(k), bool)
        several[1:] = k[1:] == k[:-1]
        several[:-1] |= several[1:]
        k, f = k[several], f[several]
        if not len(k):
            continue
        cuts = [0]
        while cuts[-1] < len(k):  # pieces of whole keys, so that expansion stays small
            end = min(len(k), cuts[-1] + 200_000)
            cuts.append(int(np.searchsorted(k, k[end - 1], "right")))
        for start, end in zip(cuts, cuts[1:]):
            found.append(_forest(*_links(p, k[start:end], f[start:end])))
    if found:
        a, b = _forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def fingerprint_links(fps: DataFrame, partitions: int | None = None) -> DataFrame:
    """a, b: a forest with the components of all fingerprints within 3 bits. fps: distinct column fp."""
    n = partitions or int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return variant_rows(fps).repartition(n, "part", "key").mapInArrow(_partition_links, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest doc_id reachable) of every row."""
    rows = store(fingerprint_documents(docs, text, key), "simhash-rows")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(fingerprint_links(groups))
    groups = groups.join(linked, groups["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    groups = store(groups, "simhash-groups")
    ids = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = groups.join(ids, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without near-duplicates: of each component the rows of the smallest id stay, one of them if it is repeated."""
    columns = docs.columns
    stay = near_duplicates(docs, text, key).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    classes = store(stay.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")), "simhash-stay")
    classes = classes.hint("merge")  # it grows with docs, so it is not broadcast at any size
    kept = docs.join(classes, docs[key].eqNullSafe(classes["component_id"]), "left_semi")
    if classes.where("n > 1").limit(1).count():  # texts move only where ids repeat
        kept = kept.dropDuplicates([key])
    return kept.select(*columns)
