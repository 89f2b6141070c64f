"""Best-fit packing by sum of squares.

Documents become token pieces of at most ``capacity`` tokens; pieces are placed whole into sequences of ``capacity``.
Each piece goes where the sum over residual gaps of (number of open sequences with that gap) squared becomes smallest
[Csirik et al., the sum-of-squares algorithm]; among equal choices it takes the tightest gap, and a new sequence last.
Pieces come in falling length, so that the small ones close what the large ones leave.

Packing needs lengths only. Pieces are dealt at random into shards of about ``shard_pieces``, each packed in one task;
sequences that keep a gap above ``slack`` are opened again and their pieces packed in a next round, until one shard is
left or a round closes under a tenth of its pieces. So no task ever holds more than a few shards' lengths, and the loss is a few sequences in all, not for each task.

Null or empty text: one piece that holds the end token alone. Rows with equal or null ids are packed row by row.
"""

from __future__ import annotations

import math
import os
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import durable, id_text, passages, remembered, rows_of

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 8192
#: Words and word parts whose ids a worker remembers between rows.
REMEMBERED = (400_000, 400_000)

#: Words of these characters alone take the short way: one code point each in either case and already composed.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
#: The split of the vocabulary's pre-tokenizer, for such words in lower case.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

def _byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte: itself where it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _tokenizer(path: str):
    """The tokenizer of ``path``, its model, and the ids of words and word parts known so far; one for each worker process."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return own, own.model, {}, {}

    return remembered(("tokenizer", path), make)


LETTERS = _byte_letters()
#: Latin-1 letters as the model sees their UTF-8 bytes.
AS_BYTES = {c: "".join(LETTERS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _ids(word: bytes, path: str) -> bytes:
    """Ids of one word. Simple words are split here and merged by the model; all others go through the whole tokenizer."""
    tokenizer, model, _, parts = _tokenizer(path)
    text = word.decode()
    if not SIMPLE.match(text) or "<|" in text:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    out = []
    for part in SPLIT.findall(text.lower()):
        ids = parts.get(part)
        if ids is None:
            seen = part if part.isascii() else part.translate(AS_BYTES)
            ids = parts[part] = b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(seen))
        out.append(ids)
    return b"".join(out)


def encode(text: bytes, path: str, remembered: tuple[int, int] = REMEMBERED) -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space before it merges, so the ids of a text are those of its blank-separated words in a
    row; each distinct word is encoded once for as long as it is remembered.
    """
    _, _, known, parts = _tokenizer(path)
    out = []
    for passage in passages(text):
        words = passage.split()
        new = set(words).difference(known)
        if len(known) + len(new) > remembered[0]:
            known.clear()
            new = set(words)
        if len(parts) > remembered[1]:
            parts.clear()
        for word in new:
            known[word] = _ids(word, path)
        out.append(b"".join(map(known.__getitem__, words)))
    return b"".join(out)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) for every document; only those longer than ``capacity`` are cut."""
    docs = id_text(docs)
    kind = docs.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            at, piece, start, ids = [], [], [], []
            held = 0
            for row in range(len(texts)):
                whole = encode(texts[row].as_py(), tokenizer_path, remembered) + end
                for k, b in enumerate(range(0, len(whole), 4 * capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(b // 4)
                    ids.append(whole[b : b + 4 * capacity])
                held += len(whole)
                if held > 8 << 20 or row == len(texts) - 1:
                    held = 0
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "piece", "start", "length", "ids"],
                    )
                    at, piece, start, ids = [], [], [], []

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the order given, and each sequence's final gap."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; full ones are not counted
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    big = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # Change of the sum of squares for each gap g >= s: one open sequence less at g, one more at g - s.
        after = 2 * count[: capacity + 1 - s] + 1
        after[0] = 0
        before = count[s:]
        change = np.where(before > 0, after - 2 * before + 1, big)
        best = int(change.argmin())  # the first smallest: the tightest gap
        fresh = 0 if s == capacity else 2 * int(count[capacity - s]) + 1
        if change[best] <= fresh and before[best] > 0:
            gap = best + s
            k = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap = capacity
            k = len(gaps)
            gaps.append(capacity)
        where[i] = k
        offset[i] = capacity - gap
        gaps[k] = gap - s
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(k)
    return where, offset, np.array(gaps, np.int64)


def _packed(pieces: DataFrame, shards: int, level: int, capacity: int, slack: int) -> DataFrame:
    """One round: sequence_id, offset and whether the sequence stays open, for the pieces (row, length) of each shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        where, offset, gaps = sum_of_squares(group["length"].to_numpy(), capacity)
        first = (level << 52) + (int(group["shard"].iloc[0]) << 20)
        return group.assign(sequence_id=where + first, offset=offset, open=gaps[where] > slack)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    return dealt.groupBy("shard").applyInPandas(run, f"{kinds}, sequence_id long, offset long, open boolean").drop("shard")


#: Pieces whose places are broadcast: 24 bytes each.
BROADCAST_PIECES = 1_000_000
#: A round that closes a smaller part of its pieces is the last.
WORTH_A_ROUND = 0.1


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, slack: int = 8) -> DataFrame:
    """``pieces`` (any columns, with a ``length`` from 1 to ``capacity``) with sequence_id and offset added.

    Every piece is placed once; a sequence's pieces fill it from 0 without gaps. Only row numbers and lengths go through
    the rounds; the other columns, ids included, are joined once at the end. Columns named sequence_id or offset are
    replaced.
    """
    own = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]).alias("piece"))
    rows = durable(own.select(F.monotonically_increasing_id().alias("row"), "piece"), "pieces")
    left = rows.select("row", F.col("piece.length").cast("long").alias("length"))
    rounds, level, n = [], 0, rows_of(rows)
    while True:
        shards = max(1, math.ceil(n / shard_pieces))
        packed = durable(_packed(left, shards, level, capacity, slack), "packed")
        rounds.append(packed)
        left = packed.where("open").select("row", "length")
        n, before = (left.count(), n) if shards > 1 else (0, n)
        if shards == 1 or n > (1 - WORTH_A_ROUND) * before:
            break
        level += 1
    closed = [p if p is rounds[-1] else p.where("not open") for p in rounds]
    placed = reduce(DataFrame.unionByName, closed).select("row", "sequence_id", "offset")
    # Beside few pieces their places are sent to the pieces, which then stay where they are.
    placed = F.broadcast(placed) if rows_of(rows) <= BROADCAST_PIECES else placed
    return rows.join(placed, "row").select("piece.*", "sequence_id", "offset")
