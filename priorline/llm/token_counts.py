"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

The vocabulary is that of a public tokenizer file; a piece's log probability is that of its rank under Zipf's law. A
pre-token is a blank-separated word behind the piece mark. Its count is that of the most probable split into pieces,
among equally probable ones that with the fewest. A character that no piece covers stands for its UTF-8 bytes, each one
token, at a score below all pieces.

The best score of a prefix depends on the prefix alone, so the forward scores of a set of pre-tokens are those of its
trie's nodes. A worker's new distinct words are inserted in sorted order, which is the trie's depth-first order: only
the path from the root to the current node is held, each node is computed once however many words pass it, and the
terminal's count is stored with the word.

Null or empty text counts 0 words and 0 tokens. Rows are counted one by one, whatever their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from priorline.llm.common import id_text, passages, remembered

MARK = "▁"
#: Words whose counts a worker remembers.
REMEMBERED = 700_000
#: Log probability by which an uncovered character lies below the rarest piece.
UNKNOWN = 10.0


class Unigram:
    """Pieces with log probabilities; lengths of the pieces that end with each character."""

    def __init__(self, pieces: Iterable[str]) -> None:
        ranked = list(dict.fromkeys(pieces))
        norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        self.score = {p: -math.log(r + 1) - norm for r, p in enumerate(ranked)}
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN
        ends: dict[str, set[int]] = {}
        for p in ranked:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(own) for c, own in ends.items()}

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word, the trie's nodes computed once each."""
        out = {}
        score, lengths, unknown = self.score, self.lengths, self.unknown
        best, count, before = [0.0], [0], ""
        for word in sorted(words):
            text = MARK + word
            shared = 0
            limit = min(len(text), len(before))
            while shared < limit and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                last = text[end - 1]
                top, least = best[end - 1] + unknown, count[end - 1] + len(last.encode())
                for n in lengths.get(last, ()):
                    if n > end:
                        break
                    s = score.get(text[end - n : end])
                    if s is not None:
                        s += best[end - n]
                        if s > top or (s == top and count[end - n] + 1 < least):
                            top, least = s, count[end - n] + 1
                best.append(top)
                count.append(least)
            out[word] = count[-1]
            before = text
        return out


def model(path: str) -> tuple[Unigram, dict[bytes, int]]:
    """The model of a vocabulary file and the counts known so far; one for each worker process."""

    def make():
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i)))
        return Unigram(own.id_to_piece(i) for i in plain), {}

    return remembered(("pieces", path), make)


def count(text: bytes, path: str) -> tuple[int, int]:
    """Words and tokens of one text."""
    unigram, known = model(path)
    n_words = n_tokens = 0
    for part in passages(text):
        words = part.split()
        n_words += len(words)
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        if new:
            named = {w.decode(): w for w in new}
            known.update((named[w], n) for w, n in unigram.counts(named).items())
        n_tokens += sum(map(known.__getitem__, words))
    return n_words, n_tokens


def learn(texts: list[bytes], path: str) -> None:
    """Count the new words of many texts in one walk of their trie."""
    unigram, known = model(path)
    new: set[bytes] = set()
    for text in texts:
        for part in passages(text):
            new |= set(part.split()).difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    if len(new) <= REMEMBERED:
        named = {w.decode(): w for w in new}
        known.update((named[w], n) for w, n in unigram.counts(named).items())


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_tokens for every row."""
    docs = id_text(docs)

    def run(batches):
        for batch in batches:
            out, held, size = [], [], 0
            texts = batch.column("text").cast(pa.binary())
            for row in range(len(batch)):
                held.append(texts[row].as_py())
                size += len(held[-1])
                if size > 4 << 20 or row == len(batch) - 1:
                    learn(held, vocabulary)
                    out += [count(t, vocabulary) for t in held]
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
