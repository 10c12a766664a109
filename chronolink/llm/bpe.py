"""BPE encoding and decoding by depth-first traversal of a trie of words.

Byte-pair encoding has an optimal-substructure property: the last token of the
encoding of a byte string is the one vocabulary entry t that ends the string
and stays separate from the last token of what precedes t. So the encodings of
all prefixes of a word need one token each, and words with a common prefix
share these. The distinct new words of a batch form a trie; sorted, they list
it in depth-first order, and the path from the root is a stack of last tokens
that is cut back to the common prefix before it is extended. Each shared prefix
is computed once.

Texts are cut at blanks into chunks, chunks by the tokenizer's pattern into
words. Chunks repeat heavily, so their ids are kept in a dictionary of bounded
size that is emptied when full; that changes no result.

Defined results: a null text counts as empty; an empty text has no ids; a
special token's string inside a text becomes that token; repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import filterfalse

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others are numbered from
    256 upwards in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TrieBpe:
    """Encoder and decoder for one byte-level BPE vocabulary file.

    cache_entries bounds each of the dictionaries kept between batches.
    """

    def __init__(self, path: str, cache_entries: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter_byte = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {
            i: bytes(letter_byte[c] for c in token) for token, i in vocab.items() if all(c in letter_byte for c in token)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        ids = {b: i for i, b in self.token_bytes.items() if i not in self.special.values()}
        self.ids = ids
        self.rank: dict[tuple[int, int], int] = {}
        born: dict[int, int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = ids[self.token_bytes[left] + self.token_bytes[right]]
            self.rank[left, right] = n
            if whole not in born:
                born[whole], halves[whole] = n, (left, right)
        self._edge: list[dict[int, list[tuple[int, int]]]] = [{}, {}]
        self._born, self._halves = born, halves
        self._apart: dict[int, bool] = {}
        self._strs = {i: str(i) for i in self.token_bytes}
        self._token_len = {i: len(b) for i, b in self.token_bytes.items()}
        #: Length of the longest token that ends with two given bytes, 1 at least.
        self._tail_len = [1] * 65536
        for b in ids:
            if len(b) > 1:
                self._tail_len[b[-2] << 8 | b[-1]] = max(self._tail_len[b[-2] << 8 | b[-1]], len(b))
        self._split = regex.compile(PATTERN).findall
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._limit = cache_entries
        self._bare: dict[str, tuple[str, bytes, int]] = {}
        self._spaced: dict[str, tuple[str, bytes, int] | None] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces of a token along one edge (0: left, 1: right), each with the rank of the merge that takes it up."""
        known = self._edge[side].get(token)
        if known is None:
            known, piece, taken = [], token, _NEVER
            while True:
                known.append((piece, taken))
                if piece not in self._halves:
                    break
                taken = self._born[piece]
                piece = self._halves[piece][side]
            self._edge[side][token] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay two tokens.

        They don't if some piece at the right edge of the left token and some
        piece at the left edge of the right token would be merged before either
        piece is taken up on its own side; of equal ranks the leftmost is first.
        """
        rank, edge = self.rank.get, self._spine(right, 0)
        for a, a_taken in self._spine(left, 1):
            for b, b_taken in edge:
                r = rank((a, b))
                if r is not None and r < a_taken and r <= b_taken:
                    return False
        return True

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct word, by one depth-first pass over their trie."""
        get, known, tail_len, token_len = self.ids.get, self._apart, self._tail_len, self._token_len
        if len(known) > 2 * self._limit:
            known.clear()
        known_get = known.get
        out: dict[bytes, list[int]] = {}
        path, before = [-1], b""
        for word in sorted(words):
            n, k = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                k += 1
            del path[k + 1 :]
            for end in range(k + 1, n + 1):
                start = end - tail_len[word[end - 2] << 8 | word[end - 1]] if end > 1 else 0
                for start in range(start if start > 0 else 0, end):
                    t = get(word[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        break
                    pair = path[start] << 20 | t
                    fits = known_get(pair)
                    if fits is None:
                        fits = known[pair] = self.apart(path[start], t)
                    if fits:
                        break
                path.append(t)
            found, end = [], n
            while end:
                t = path[end]
                found.append(t)
                end -= token_len[t]
            found.reverse()
            out[word] = found
            before = word
        return out

    def _learn(self, chunks: set[str], into: dict, lead: str) -> None:
        """Adds chunks to a dictionary as (ids as text, decoded bytes, number of ids); lead stands before each.

        Chunks after a blank that begin with white space get None: there the text can't be cut.
        """
        split, strs, token_bytes = self._split, self._strs, self.token_bytes
        single, several = {}, []
        for c in chunks:
            if lead and (not c or c[0].isspace()):
                into[c] = None
                continue
            ws = split(lead + c)
            if len(ws) == 1:
                single[c] = ws[0].encode()
            else:
                several.append((c, [w.encode() for w in ws]))
        distinct = set(single.values())
        for _, ws in several:
            distinct.update(ws)
        done = {
            w: (",".join([strs[i] for i in ids]), b"".join([token_bytes[i] for i in ids]), len(ids))
            for w, ids in self.encode_words(list(distinct)).items()
        }
        for c, w in single.items():
            into[c] = done[w]
        for c, ws in several:
            found = [done[w] for w in ws]
            into[c] = (",".join([x[0] for x in found]), b"".join([x[1] for x in found]), sum([x[2] for x in found]))

    def _look_up(self, chunks: list[list[str]], known: dict, lead: str) -> list[list]:
        """Values of lists of chunks; the chunks that aren't known yet are encoded together."""
        missing: set[str] = set()
        for cs in chunks:
            missing.update(filterfalse(known.__contains__, cs))
        if len(known) + len(missing) > self._limit:
            known.clear()
            missing = {c for cs in chunks for c in cs}
        if missing:
            self._learn(missing, known, lead)
        return [list(map(known.__getitem__, cs)) for cs in chunks]

    def encode_batch(self, texts: list[str]) -> list[tuple[str, bytes, int]]:
        """Per text: decimal ids joined by commas, the bytes they decode to, their number.

        A text is cut at special tokens, then at blanks.
        """
        where: list[list[int]] = []
        segments: list[str] = []
        for text in texts:
            at, own = 0, []
            for m in self._special.finditer(text) if self._special else ():
                own += [len(segments), -1 - self.special[m.group()]]
                segments.append(text[at : m.start()])
                at = m.end()
            own.append(len(segments))
            segments.append(text[at:] if at else text)
            where.append(own)
        cut = [s.split(" ") for s in segments]
        firsts = self._look_up([[c[0]] for c in cut], self._bare, "")
        values = [a + b for a, b in zip(firsts, self._look_up([c[1:] for c in cut], self._spaced, " "))]
        whole = [i for i, v in enumerate(values) if None in v]
        for i, v in zip(whole, self._look_up([self._split(segments[i]) for i in whole], self._bare, "")):
            values[i] = v
        out = []
        for own in where:
            found = []
            for i in own:
                if i >= 0:
                    found += values[i]
                else:
                    found.append((self._strs[-1 - i], self.token_bytes[-1 - i], 1))
            out.append((",".join([x[0] for x in found if x[2]]), b"".join([x[1] for x in found]), sum([x[2] for x in found])))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_batch([text])[0][0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_models: dict[str, TrieBpe] = {}


def model(path: str) -> TrieBpe:
    """The encoder for a file, kept for the life of a Python worker."""
    if path not in _models:
        _models[path] = TrieBpe(path)
    return _models[path]


def _groups(texts: list[str], most_chars: int) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > most_chars:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = True, digests: bool = False, group_chars: int = 8_000_000) -> DataFrame:
    """One row per row of docs: key, n_tokens, then token_ids and decoded, or their digests.

    path is the vocabulary file, which every executor must have. group_chars
    bounds the characters that are encoded together.
    """
    extra = [("token_ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())] if ids else []
    extra += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] if digests else []
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [x for g in _groups(texts, group_chars) for x in encoder.encode_batch(g)]
            columns = [batch.column(0), pa.array([x[2] for x in found], pa.int64())]
            if ids:
                columns.append(pa.array([[int(i) for i in x[0].split(",")] if x[2] else [] for x in found], pa.list_(pa.int32())))
                columns.append(pa.array([x[1].decode("utf-8", "replace") for x in found], pa.string()))
            if digests:
                columns.append(pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in found]))
                columns.append(pa.array([hashlib.sha256(x[1].decode("utf-8", "replace").encode()).hexdigest() for x in found]))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", *(n for n, _, _ in extra)])

    schema = f"`{key}` {key_type}, n_tokens long" + "".join(f", {n} {t}" for n, t, _ in extra)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """key and decoded text of arrays of ids; a null array decodes to the empty text."""
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches):
        decoder = model(path)
        for batch in batches:
            texts = [decoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {key_type}, decoded string")
