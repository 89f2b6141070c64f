"""Byte-level BPE, text to ids and back, with a two-tier lookup.

Text is cut into pre-tokens by a pattern. The distinct pre-tokens of a batch go to the first tier together: a minimal
perfect hash over the vocabulary gives each a slot, and the token stored there is compared byte by byte, so a pre-token
that is a token itself gets its id at once. Those that are none go to the second tier: their bytes are a linked list,
and a heap of neighbouring pairs by (rank, place) merges the lowest rank, leftmost first, until no pair is a token.
Decoding gathers each id's bytes from one flat array.

Rows are encoded where they are read: nothing is shuffled. A worker's memory is one vocabulary, the pre-tokens of
``CHARS`` characters of text, and at most twice ``REMEMBERED`` results of the second tier: when that many are new, the older ones
that have not been met since are forgotten. Texts of Latin-1 alone are cut by the standard library's faster ``re``, for
which the pattern's classes are written out.

Null or empty text: no ids, decoded to no bytes. Bytes that are no UTF-8 count as U+FFFD. Rows with equal or null ids
are encoded row by row; further columns are left out. An id that the vocabulary lacks, or null ids, decode to null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from priorline.llm.common import id_text, mixed, remembered

#: Results of the second tier that a worker remembers between batches.
REMEMBERED = 400_000
#: Characters of text whose pre-tokens are resolved together, and most pre-tokens of one text at once.
CHARS, AT_ONCE = 2 << 20, 400_000


class PerfectHash:
    """A minimal perfect hash of byte strings: each of n keys has a slot of its own below n.

    Keys are hashed into a bit array of twice their number; those alone at their bit stay, the others go on to the next,
    smaller array. A key's slot is the number of set bits before its own.
    """

    def __init__(self, keys: list[bytes]) -> None:
        left = hashed(keys)
        if len(np.unique(left)) < len(left):
            raise ValueError("keys are equal, or equal in 64 bits of hash")
        self.sizes: list[int] = []
        bits = []
        while len(left):
            size = 2 * len(left)
            at = self._places(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits
        self.size = len(keys)

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(hashes + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hashed key; of anything else some slot, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_, start = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = self._places(hashes[open_], level, size) + start
            hit = self.bits[at]
            out[open_[hit]] = self.before[at[hit]]
            open_, start = open_[~hit], start + size
        return out


def hashed(keys: list[bytes]) -> np.ndarray:
    """64 bits of each byte string, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, keys), np.uint64, len(keys))


class Vocabulary:
    """Tokens with their ranks, and what both tiers and the decoder look up."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.tokens: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(hashed(tokens)).tolist(), strict=True):
            self.tokens[slot] = token
        self.byte_id = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.byte_id:
            raise ValueError("a byte is no token of this vocabulary")
        #: Two neighbouring ids -> the id of the token that both make.
        self.pairs: dict[int, int] = {}
        self.end = max(ranks.values()) + 1
        self.shift = self.end.bit_length()
        self.four = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << self.shift | b] = rank
        by_id = sorted((r, t) for t, r in ranks.items())
        self.ids = np.array([r for r, _ in by_id], np.int64)
        self.lengths = np.array([len(t) for _, t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.packed = [self.four[ranks[t]] for t in self.tokens]
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.dense = bool((self.ids == np.arange(len(self.ids))).all())

    def merge(self, word: bytes) -> bytes:
        """Second tier: ids of one pre-token, merged pair by pair over its linked bytes."""
        shift, pair, byte_id, four = self.shift, self.pairs.get, self.byte_id, self.four
        ids: list[int | None] = [byte_id[b] for b in word]
        ids.append(self.end)  # makes no token with anything
        follows, leads = list(range(1, len(ids) + 1)), list(range(-1, len(word)))
        due = [pair(a << shift | b) for a, b in zip(ids, ids[1:])]
        due.append(None)
        heap = [rank << 32 | i for i, rank in enumerate(due) if rank is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if due[i] != rank:
                continue  # the pair has changed since
            gone = follows[i]
            after = follows[i] = follows[gone]
            ids[i], ids[gone], due[gone] = rank, None, None
            leads[after] = i
            new = due[i] = pair(rank << shift | ids[after])
            if new is not None:
                heappush(heap, new << 32 | i)
            before = leads[i]
            if before >= 0:
                new = due[before] = pair(ids[before] << shift | rank)
                if new is not None:
                    heappush(heap, new << 32 | before)
        ids.pop()
        return b"".join([four[x] for x in ids if x is not None])

    def resolve(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each distinct pre-token, four bytes each."""
        words, merged = list(words), self.merged
        as_bytes = [w.encode() for w in words]
        slots = self.hash.slots(hashed(as_bytes)).tolist()
        tokens, packed, out = self.tokens, self.packed, {}
        for word, key, slot in zip(words, as_bytes, slots, strict=True):
            if slot >= 0 and tokens[slot] == key:
                out[word] = packed[slot]
                continue
            ids = merged.get(key)
            if ids is None:
                ids = self.older.get(key) or self.merge(key)
                if len(key) < 64:
                    if len(merged) >= REMEMBERED:
                        self.older, self.merged = merged, {}
                        merged = self.merged
                    merged[key] = ids
            out[word] = ids
        return out

    def decode(self, packed: bytes) -> bytes | None:
        """The bytes of ids; None where one is unknown or they are cut."""
        if len(packed) % 4:
            return None
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        at = ids if self.dense else np.searchsorted(self.ids, ids)
        if at.max() >= len(self.ids) or (not self.dense and (self.ids[at] != ids).any()):
            return None
        parts = []
        for k in range(0, len(at), 1 << 20):
            part = at[k : k + (1 << 20)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            parts.append(self.flat[np.repeat(self.starts[part] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of ``path``, one for each worker process."""
    return remembered(("byte_bpe", path), lambda: Vocabulary(read_ranks(path)))


def narrow(pattern: str) -> re.Pattern:
    r"""``pattern`` for texts of code points below 256, in the standard library's terms: \p{L}, \p{N} and \s are written out."""
    every = list(map(chr, range(256)))
    members = {name: "".join(map(re.escape, (c for c in every if regex.match(name, c)))) for name in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        inside = (inside or part == "[") and part != "]"
        out.append(part if part not in members else members[part] if inside else f"[{members[part]}]")
    return re.compile("".join(out))


class Cutter:
    """Pre-tokens of a text: the matches of a pattern."""

    def __init__(self, pattern: str) -> None:
        self.wide, self.latin = regex.compile(pattern), narrow(pattern)

    def of(self, text: str) -> re.Pattern:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide
        return self.latin

    def finditer(self, text: str):
        return self.of(text).finditer(text)

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)


def encode_texts(texts: list[str], vocab: Vocabulary, pattern) -> Iterator[bytes]:
    """Ids of each text, in order, as little-endian unsigned 32-bit numbers; ``pattern`` finds the pre-tokens."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHARS:  # on its own, a stretch of pre-tokens at a time
            found, out = pattern.finditer(texts[at]), []
            while stretch := [m.group() for m in islice(found, AT_ONCE)]:
                out.append(b"".join(map(vocab.resolve(set(stretch)).__getitem__, stretch)))
            yield b"".join(out)
            at += 1
            continue
        until, chars = at, 0
        while until < len(texts) and chars + len(texts[until]) <= CHARS:
            chars += len(texts[until])
            until += 1
        cut = [pattern.findall(t) for t in texts[at:until]]
        ids = vocab.resolve(set().union(*cut))
        for words in cut:
            yield b"".join(map(ids.__getitem__, words))
        at = until


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text.

    ``ranks_path`` is read by each worker; every match of ``pattern`` is encoded on its own, without special tokens.
    """
    docs = id_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches):
        vocab, cut = vocabulary(ranks_path), Cutter(pattern)
        for batch in batches:
            held, rows, begun = [], 0, 0
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for ids in encode_texts(texts, vocab, cut):
                held.append(ids)
                rows += len(ids)
                if rows > 16 << 20 or begun + len(held) == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begun, len(held)), pa.array(held, pa.binary())], names=["doc_id", "ids"])
                    begun, held, rows = begun + len(held), [], 0

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, ranks_path: str) -> DataFrame:
    """``rows`` (doc_id, ids) with ``decoded``, the bytes that the ids stand for."""
    rows = rows.select("doc_id", "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        vocab = vocabulary(ranks_path)
        for batch in batches:
            out, begun, size = [], 0, 0
            for k, ids in enumerate(batch.column("ids")):
                out.append(None if not ids.is_valid else vocab.decode(ids.as_py()))
                size += len(out[-1] or b"")
                if size > 16 << 20 or k == batch.num_rows - 1:
                    part = batch.slice(begun, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])
                    begun, out, size = begun + len(out), [], 0

    return rows.mapInArrow(run, schema)
