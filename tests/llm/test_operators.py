"""The training-data operators against brute force, on small fixtures with nulls, empties, ties and repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolink.llm import ann, bpe, components, line_dedup, lm, mixing, pu_classifier, quality_rules, sharding, simhash, substring_dedup, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice(["an", "the", "re", "on", "is", "ou", "té"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text[, source]); with a column whose name clashes with internal ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumn("size", F.lit("x")).withColumn("id", F.lit(1)).withColumn("h", F.lit(2.0))


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


# --- BPE ---
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_bpe_agrees_with_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    path, rng = vocabulary(), random.Random(1)
    theirs, own = tokenizers.Tokenizer.from_file(path), bpe.TrieBpe(path, cache_entries=300)
    texts = ["", " ", "  ", "a  b", "a   b", " a \n b", "a  \n", "x<|endoftext|> y <|endoftext|>", "don't we'll", "a" * 5000, "\x1c a\x85 b　 c", "😀 ñ 中文\x00", "no" * 2000 + "  "]
    texts += ["".join(rng.choice("ab 1'\n\té中s!😀") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, got, want in zip(texts, own.encode_batch(texts), theirs.encode_batch(texts, add_special_tokens=False)):
        assert got[0] == ",".join(map(str, want.ids)), repr(text)
        assert got[2] == len(want.ids)
        assert got[1].decode("utf-8", "replace") == theirs.decode(want.ids, skip_special_tokens=False)
        assert own.decode(own.encode(text)) == text


def test_bpe_documents(spark):
    docs = frame(spark, [(1, "the end"), (2, None), (3, ""), (1, "the end"), (None, "x")])
    found = bpe.encode_documents(docs, vocabulary(), digests=True)
    rows = found.collect()
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == 0 and by[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and by[2].token_ids == []
    assert by[1].decoded == "the end" and by[1].decoded_sha256 == hashlib.sha256(b"the end").hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode_documents(found, vocabulary()).collect()}
    assert back[1] == "the end" and back[3] == ""
    assert bpe.encode_documents(docs.limit(0), vocabulary()).count() == 0


# --- nearest neighbours ---
def brute_nearest(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 100 == 0:
            all_d = sorted((float(np.sqrt(((ok[q] - ok[i]) ** 2).sum())), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))
            out[q] = all_d[:k]
    return out


def test_nearest_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(1500)]
    hot = [float(np.float32(x)) for x in rng.normal(size=16)]
    rows += [(2000 + i, hot) for i in range(300)]
    rows += [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] * 16), (5400, [None] * 16), (None, hot), (5500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ids", F.lit(0))
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, F.col("vec_id") % 100 == 0, 10, shard_rows=400).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
    want = brute_nearest(rows, 10)
    assert set(got) == {q for q in want if want[q]}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.97
    assert [i for _, i in got[2000]] == list(range(2001, 2011)) and got[2000][0][0] == 0.0
    assert all(abs(got[q][0][0] - want[q][0][0]) < 1e-9 for q in want if want[q])
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- components, SimHash ---
def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(80)]
    df = spark.createDataFrame([(b, a) for a, b in links] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    want = union_find({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got or sum(n in p and p[0] != p[1] for p in links) == 0 for n in want)
    assert components.components(df.limit(0)).count() == 0


def test_fingerprint_links_are_exact(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, *centres}
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {c ^ 0b111 for c in centres} | {c ^ (0b111 << 40) for c in centres} | {c ^ (1 << 3 | 1 << 30 | 1 << 60) for c in centres}
    fps = sorted(fps)
    want = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(df).collect()]
    assert union_find(fps, found) == want


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = prose(rng, 200)
    rows = [(1, base), (2, base.upper()), (3, base + " extra"), (4, prose(rng, 150)), (5, None), (6, ""), (7, "one two"), (8, "ONE two"), (4, prose(random.Random(9), 20)), (None, base)]

    def fp(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{fp(t):016x}") for i, t in rows)
    fps = sorted({fp(t) for _, t in rows})
    root = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp(t)]] = min(i, least.get(root[fp(t)], i))
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least[root[fp(t)]]) for i, t in rows)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect() if r.doc_id is not None)
    assert kept == sorted(set(least.values()))


# --- line dedup ---
def jaccard(a, b, n=5):
    x, y = {a[i : i + n] for i in range(len(a) - n + 1)}, {b[i : i + n] for i in range(len(b) - n + 1)}
    return len(x & y) / len(x | y) if x | y else 0


def test_line_classes(spark):
    rng = random.Random(4)
    lines = [prose(rng, 30) for _ in range(40)]
    near = [x[:80] + "qqq" + x[83:] for x in lines[:20]]
    rows = [(i, "\n".join([lines[i], "", lines[(i * 3) % 40], near[i % 20], "short", "  "])) for i in range(40)] + [(100, None), (101, ""), (102, "\n\n"), (3, "short")]
    got = line_dedup.line_classes(frame(spark, rows)).collect()
    every = {(i, k): t for i, text in rows for k, t in enumerate((text or "").split("\n")) if WORD.search(t)}
    texts = sorted(set(every.values()))
    root = union_find(texts, [(a, b) for i, a in enumerate(texts) for b in texts[:i] if min(len(a), len(b)) >= 10 and jaccard(a, b) >= 0.8])
    first = {}
    for at in sorted(every):
        first.setdefault(root[every[at]], at)
    want = {at: first[root[t]] for at, t in every.items()}
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == want[r.doc_id, r.line_no]) for r in got)
    docs = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    assert docs[100].text is None and docs[102].text == "\n\n"
    assert docs[39].text == "\n".join(t for k, t in enumerate(rows[39][1].split("\n")) if not t.strip() or want[39, k] == (39, k))
    assert docs[39].n_chars == len(docs[39].text)
    assert line_dedup.line_classes(frame(spark, rows).limit(0)).count() == 0


def test_short_lines_urls_and_scripts_without_blanks(spark):
    rng = random.Random(5)
    han = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n)) for n in range(13, 41, 3)]
    pairs = [("Continue reading", "Continue reading."), ("Privacy Policy", "Privacy Policy."), ("https://example.com/page/12345", "https://example.com/page/12346")]
    pairs += [("Contact us", "Contact us!"), ("aaaaaaaaaa", "a" * 30), ("abcdefabcd", "abcdef" * 4)] + [(x, x[:-1] + "\u3042") for x in han]
    lines = [x for p in pairs for x in p]
    root = union_find(lines, [(a, b) for i, a in enumerate(lines) for b in lines[:i] if jaccard(a, b) >= 0.8])
    assert all(root[a] == root[b] for a, b in pairs)
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {i: lines.index(next(y for y in lines if root[y] == root[x])) for i, x in enumerate(lines)}


def test_lines_of_a_template_unlike_their_leader(spark):
    rng = random.Random(6)
    head = prose(rng, 12)
    lines = [x for k in range(30) for own in [prose(rng, rng.randint(3, 5))] for x in (f"{head} {own}", f"{head} {own[:-4]}{rng.randint(1000, 9999)}")]
    root = union_find(lines, [(a, b) for i, a in enumerate(lines) for b in lines[:i] if jaccard(a, b) >= 0.8])
    # lines of one sketch: the smallest is like 1 to 9 only; the others are like the one before them
    wide = spark.createDataFrame([(i, f"{i:03d}") for i in range(200)], "id long, line string").withColumn("sketch", F.array(F.lit(1), F.lit(2)).cast("array<long>"))
    near = lambda p: p.where("(a = 0 and b < 10) or (a > 0 and b = a + 1)").select("a", "b")
    kept, line_dedup._verified = line_dedup._verified, lambda p, _: near(p)
    try:
        found = {r.node: r.component for r in line_dedup._all_links(wide, lambda _: wide).collect()}
    finally:
        line_dedup._verified = kept
    assert found == dict.fromkeys(range(200), 0)
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {i: lines.index(next(y for y in lines if root[y] == root[x])) for i, x in enumerate(lines)}


def test_wide_bands_with_few_links_lose_none(spark):
    """200 lines of one band, of which only the last are alike, and no leader is."""
    wide = spark.createDataFrame([(i, f"{i:03d}") for i in range(200)], "id long, line string").withColumn("sketch", F.array(F.lit(1), F.lit(2)).cast("array<long>"))
    kept, line_dedup._verified = line_dedup._verified, lambda p, _: p.where("a in (150, 160) and b = a + 1").select("a", "b")
    try:
        found = {r.node: r.component for r in line_dedup._all_links(wide, lambda _: wide).collect()}
    finally:
        line_dedup._verified = kept
    assert found == {150: 150, 151: 150, 160: 160, 161: 160}


def test_folds_rule_out_no_similar_pair(spark):
    """The bound before verification passes every pair at 0.8 or more and stops most others; empty tables give none."""
    rng = random.Random(9)
    lines = []
    for n in (8, 12, 30, 80, 200, 600):
        for _ in range(6):
            x = (prose(rng, n) + "x" * n)[:n]
            cuts = [0, 1, max(1, n // 40), max(1, n // 12), n // 3]
            lines += [x] + [x[c:] + "q7" for c in cuts] + [x[: n // 2] + "z" * c + x[n // 2 + c :] for c in cuts]
    lines = sorted(set(lines) | {"aaaaaaaa", "a" * 300, "abc"})
    folded = line_dedup._folded(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    every = [(a, b) for b in range(len(lines)) for a in range(b)]
    pairs = spark.createDataFrame(every, "a long, b long")
    got = {(r.a, r.b) for r in line_dedup._possible_pairs(pairs, folded).collect()}
    alike = {(a, b) for a, b in every if jaccard(lines[a], lines[b]) >= 0.8}
    assert alike and alike <= got
    assert len(got) < len(every) / 4
    assert line_dedup._possible_pairs(pairs.limit(0), folded).count() == 0


def test_line_recall_by_length(spark):
    """Edited copies of lines of all lengths, at 0.8 or more: nearly all found, and what is joined follows real links."""
    rng = random.Random(8)

    def edited(line):
        x = list(line)
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            at = rng.choice([rng.randrange(len(x)), len(x) - 1, 0])
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "Z", "7 ", "ab"])
            x = x or ["q"]
        return "".join(x)

    spans = [(8, 14), (14, 25), (25, 45), (45, 70), (70, 120), (120, 250), (250, 600), (2000, 3000)]
    pairs, classes = [], []
    for k, (low, high) in enumerate(spans):
        while classes.count(k) < (150 if high < 2000 else 20):
            a = prose(rng, high // 4)[: rng.randint(low, high - 1)].strip()
            b = edited(a).strip()
            if a != b and min(len(a), len(b)) >= 8 and 0.8 <= jaccard(a, b):
                pairs.append((a, b))
                classes.append(k)
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    got = {}
    for r in line_dedup.line_classes(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.class_doc_id, r.class_line_no))
    for k in range(len(spans)):
        own = [len(got[i]) == 1 for i, c in enumerate(classes) if c == k]
        assert sum(own) >= 0.95 * len(own), (spans[k], sum(own), len(own))
    whole = sorted({x for p in pairs[-170:] for x in p})  # the longest: no accidental likeness
    root = union_find(whole, [(a, b) for i, a in enumerate(whole) for b in whole[:i] if jaccard(a, b) >= 0.8])
    classes_of = defaultdict(set)
    for r in line_dedup.line_classes(frame(spark, [(i, x) for i, x in enumerate(whole)])).collect():
        classes_of[r.class_doc_id].add(root[whole[r.doc_id]])
    assert all(len(x) == 1 for x in classes_of.values())


# --- sharding ---
def brute_pack(sizes, capacity):
    left, home = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= s]
        if fits and s <= capacity:
            k = min(fits)[1]
        else:
            k = len(left)
            left.append(max(capacity, s))
        left[k] -= s
        home.append((s, k))
    return Counter(home)


def test_packing_is_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        runs = sharding.pack(list(Counter(sizes).items()), 70)
        got = Counter()
        for s, n, k in runs:
            got[s, k] += n
        assert got == brute_pack(sizes, 70)


def test_shard_documents(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(300)] + [(500 + i, "copy of a text") for i in range(50)] + [(900, None), (901, ""), (1, "again"), (1, "again"), (None, "é")]
    got = sharding.shard_documents(frame(spark, rows), 8).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    assert len({r.shard for r in got if r.doc_id and 500 <= r.doc_id < 550}) == 1
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(8))
    sums = [sum(r.size for r in rs) for rs in by.values()]
    assert max(sums) - min(sums) < 0.1 * sum(sums) / 8 + 60
    assert sharding.shard_documents(frame(spark, rows).limit(0), 8).count() == 0


# --- mixing ---
def test_mix_plan(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 50)), rng.choice(["b", "a", "ç", "z"])) for i in range(400)] + [(500, None, "a"), (501, "x y z", None), (502, "w " * 30, None)]
    rows.append(rows[1])
    got = mixing.mix_plan(frame(spark, rows), bucket_rows=50).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    taken, source = Counter(), {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r.size and abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order) and abs(sum(want.values()) - sum(size.values())) < 1e-6
    again = mixing.mix_plan(frame(spark, rows).repartition(7), bucket_rows=50).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    mixed = mixing.mix_documents(frame(spark, rows), shards=4, block_words=64)
    assert "text" in mixed.columns and set(r[0] for r in mixed.select("mix_shard").distinct().collect()) <= {0, 1, 2, 3}
    assert mixing.mix_plan(frame(spark, rows).limit(0)).count() == 0


def test_quotas_are_conserved():
    for shards in (1, 3, 8):
        leaves = mixing.split_quotas([50, 0, 7000, 13], shards, 3)
        assert [sum(c) for c in zip(*leaves)] == [50, 0, 7000, 13] and min(map(min, leaves)) >= 0
        assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 2


def test_blocks_are_disjoint_and_fill_the_quotas(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 400)), rng.choice(["a", "a", "a", "b", None])) for i in range(150)]
    got = mixing.mix_blocks(frame(spark, rows), shards=5, seed=3, block_words=64, bucket_rows=40).collect()
    source = {i: s for i, _, s in rows}
    words, homes, target = Counter(), defaultdict(set), {}
    for r in got:
        target[source[r.doc_id]] = r.target
        assert len({(p.copy, p.block) for p in r.pieces}) == len(r.pieces)
        for p in r.pieces:
            assert 0 < p.words <= 64
            words[source[r.doc_id], p.block] += p.words
            homes[source[r.doc_id], p.block].add(p.shard)
    order = ["a", "b", None]
    whole = [int(target[s] + 0.5) for s in order]
    for s, n in zip(order, whole):  # every block once, by one shard, full but for the last
        assert {k for x, k in words if x == s} == set(range(-(-n // 64)))
        assert all(words[s, k] == min(64, n - 64 * k) and len(homes[s, k]) == 1 for k in range(-(-n // 64)))
    quotas = mixing.split_quotas([-(-n // 64) for n in whole], 5, 3)
    for shard, leaf in enumerate(quotas):
        assert leaf == [sum(h == {shard} for (x, _), h in homes.items() if x == s) for s in order]


def test_hypergeometric_draws_are_exact():
    rng = random.Random(10)
    for good, bad, draws in ((5, 7, 6), (30, 3, 20), (1, 9, 5)):
        n = 20_000
        seen = Counter(mixing._hypergeometric(rng, good, bad, draws) for _ in range(n))
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert abs(seen[k] - n * p) < 5 * (n * p * (1 - p)) ** 0.5 + 1
    big = [mixing._hypergeometric(rng, 3 * 10**9, 10**9, 2 * 10**9) for _ in range(40)]
    sd = (2e9 * 0.75 * 0.25 * 0.5) ** 0.5
    assert abs(sum(big) / 40 - 1.5e9) < 5 * sd / 40**0.5 and len(set(big)) > 30


# --- statistics, rules, classifier ---
def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(10)
    texts = [None, "", " \n\t", "a", "x\x0by\x0cz", "# $ é|", "a b c d e f g h " * 3, "a " * 30, "l one\nl one\n\nl two\nl one"] + [prose(rng, 40) + " " + "u v w x y z a b c d " * rng.randint(0, 3) + "  % &" for _ in range(30)]
    got = {r.doc_id: r for r in text_stats.with_statistics(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t), repr(t)


def quality_fixture(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = prose(rng, rng.randint(40, 90))
        if bad:
            text = " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in text.split()) if i % 2 else " | ".join(text.split())
        rows.append((i, text))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad), 0))
    return frame(spark, rows + [(1000, None), (1001, "")]), spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    docs, labels = quality_fixture(spark)
    judged, rules = quality_rules.judge(docs, labels)
    assert rules
    kept = {r.doc_id: r.kept for r in judged.collect()}
    right = sum(kept[i] == (i % 5 != 0) for i in range(600))
    assert right / 600 > 0.97 and not kept[1000] and not kept[1001]
    assert quality_rules.keep_documents(docs, labels).columns == docs.columns
    _, none = quality_rules.judge(docs, labels.limit(0))
    assert none == []


def test_kept_documents_are_those_judged_so_with_very_long_texts(spark):
    docs, labels = quality_fixture(spark)[:2]
    rng = random.Random(77)
    long = [(900, prose(rng, 20_000)), (901, "\n".join(prose(rng, 400) for _ in range(50))), (902, prose(rng, 9) + " " + "word " * 20_000)]
    docs = docs.unionByName(frame(spark, long).select(*docs.columns))
    judged, rules = quality_rules.judge(docs, labels)
    kept = quality_rules.keep_documents(docs, labels)
    assert rules and kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in judged.where("kept").collect())
    assert {900, 901} <= {r.doc_id for r in kept.collect()} and 902 not in {r.doc_id for r in kept.collect()}
    # the filter reads stored statistics: nothing that splits texts is part of the plan
    assert "split(" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_pu_classifier(spark):
    docs, labels = quality_fixture(spark)
    got = pu_classifier.score_documents(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) / len(held) > 0.9
    assert {r.score for r in pu_classifier.score_documents(docs, labels.limit(0)).collect()} == {0.5}


# --- language model ---
def test_lm_probabilities_add_up():
    rng = np.random.default_rng(0)
    model = lm.Mixer.fresh(rng.integers(0, 5, (2, lm.SLOTS)).astype(np.float32))
    model.learn([b"the", b"then", b"an", lm.END] * 30, 0.02)
    # all first bytes: their probabilities sum to 1
    total = 0.0
    for b in range(256):
        bits = lm.Bits([bytes([b])])
        p = 1.0
        for so_far, slots, bit in bits.rounds():
            one = model.predict(*model.inputs([s[:1] for s in slots]), so_far[:1])[-1][0]
            p *= one if bit[0] else 1 - one
        total += p
    assert abs(total - 1) < 1e-9


def test_lm_learns_from_all_words(spark, monkeypatch):
    """the tasks that learn weights get every distinct training word, in a table of many words too."""
    words = spark.range(100_000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS word", "IF(id % 10 = 0, 0L, 1L) AS c")
    monkeypatch.setattr(lm, "slot_counts", lambda *_: np.zeros((2, lm.SLOTS), np.float32))
    learned = []
    average = np.average
    monkeypatch.setattr(np, "average", lambda x, axis=None, weights=None: (learned.extend(weights), average(x, axis=axis, weights=weights))[1])
    lm.train_mixer(words, 90_000)
    assert sum(learned) == 90_000


def test_lm_scores(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(5, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "zzqx jjkw"), (3, "The THE the"), (None, "an")]
    got = lm.score_documents(frame(spark, rows), head_words=20).collect()
    assert len(got) == len(rows)
    import math
    import zlib

    def toks(t):
        return lm.tokens(t) + [lm.END]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        ws = toks(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    text = dict(rows)
    outs = [r for r in got if r.held_out and r.n_tokens > 5]
    n_bytes = sum(len(text[r.doc_id].encode()) + 1 for r in outs)
    bits = -sum(r.score for r in outs) / math.log10(2) / n_bytes
    assert all(r.score < 0 for r in got) and bits < 2.5  # seven syllables and blanks: about 1.4 at best, 8 with nothing learned


# --- substring dedup ---
def brute_removed(rows, width):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - width + 1):
            w = tuple(ws[k : k + width])
            if i is not None:
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - width + 1):
            if i is not None and first[tuple(ws[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), " ".join(kept)))
    return Counter(out)


def test_remove_repeats(spark):
    rng = random.Random(13)
    passages = [prose(rng, n) for n in (50, 51, 64, 120, 49)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randint(0, 80))]
        if i % 3:
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 30))]
        if i % 7 == 0:
            parts += ["same " * 130]
        rows.append((i, " \n".join(parts)))
    rows += [(90, rows[1][1]), (91, rows[1][1]), (92, None), (93, ""), (94, passages[0]), (5, passages[3]), (None, passages[3])]
    got = substring_dedup.remove_repeats(frame(spark, rows), 50).collect()
    assert Counter(map(tuple, got)) == brute_removed(rows, 50)
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0), 50).count() == 0


def test_lm_makes_inputs_once_for_many_batches(spark, monkeypatch):
    """op8: counts of slots are those of every bit of every word, and learning looks slots up for thousands of words at once, not for 64."""
    import numpy as np

    from chronolink.llm import lm

    words = [f"w{i % 701}x{i}".encode() for i in range(2000)] + [lm.END]
    got = lm.slot_counts(spark.createDataFrame([(bytearray(w), 1) for w in words], "word binary, c long"), 2)
    want = np.zeros((2, lm.SLOTS))
    for _, slots, bit in lm.Bits(words).rounds():
        for s in slots:
            np.add.at(want, (bit.astype(int), s), 1)
    assert (got == want).all()
    model, calls, inputs = lm.Mixer.fresh(got), [], lm.Mixer.inputs
    monkeypatch.setattr(lm.Mixer, "inputs", lambda *a: calls.append(1) or inputs(*a))
    first, again = model.learn(words, 0.02), model.learn(words, 0.02)
    assert again < first and len(calls) == 16
    assert [len(x) for x in lm._stretches([b"a" * 9, b"b" * 300, b"c", b"d"], 3, 50)] == [1, 1, 2]
