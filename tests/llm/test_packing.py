from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from priorline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text: str) -> bytes:
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_words_apart_equal_the_whole(text):
    assert packing.encode(text.encode(), PATH) == ids(text)


def test_words_apart_on_odd_texts():
    for text in ("don't I'LL <|endoftext|>x", "á ́b \xa0c\x85d\x1ce", "ΣΑΣ İ ﬁ 12 3٣ !!??\n's", "", " \n", "x" * 9000, "été ÀÉÎ ß straße 'RE"):
        assert packing.encode(text.encode(), PATH) == ids(text)


def check(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_sum_of_squares_is_the_brute_force_choice():
    rng = random.Random(1)
    capacity = 20
    lengths = [rng.randint(1, 20) for _ in range(150)]
    where, offset, gaps = packing.sum_of_squares(np.array(lengths), capacity)
    held: list[int] = []  # gaps by sequence
    for s, k, o in zip(lengths, where, offset, strict=True):
        def squares(gaps_):
            return sum(c * c for c in (gaps_.count(g) for g in set(gaps_) if g > 0))

        options = {held[i] - s: squares([*held[:i], held[i] - s, *held[i + 1 :]]) for i in range(len(held)) if held[i] >= s and held[i] > 0}
        fresh = squares([*held, capacity - s])
        got = held[k] - s if k < len(held) else None
        if got is None:
            assert not options or fresh < min(options.values())
            held.append(capacity - s)
            assert o == 0
        else:
            best = min(options.values())
            assert options[got] == best <= fresh and got == min(g for g, v in options.items() if v == best)
            assert o == capacity - held[k]
            held[k] = got
    assert held == gaps.tolist()


def test_documents(spark):
    texts = ["one two three", None, "", "word " * 9000, "one two three", "a"]
    docs = spark.createDataFrame([(i % 5, t, i, "x") for i, t in enumerate(texts)] + [(None, "b", 9, "x")], "doc_id long, text string, sequence_id int, ids string")
    pieces = packing.tokenized_pieces(docs, PATH)
    packed = packing.pack(pieces).collect()
    assert check(packed, 4096) == 3
    got = sorted((zlib.crc32(bytes(r.ids)), r.start, r.piece, r.length) for r in packed)
    want = []
    for t in [*texts, "b"]:
        whole = ids(t or "") + np.array([1], "<u4").tobytes()
        want += [(zlib.crc32(whole[b : b + 16384]), b // 4, b // 16384, len(whole[b : b + 16384]) // 4) for b in range(0, len(whole), 16384)]
    assert got == sorted(want)


def test_many_shards_pack_as_close_as_one(spark):
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5, 1.2, 6000).astype(int) + 1, 4096)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    n = check(packing.pack(df, shard_pieces=500).collect(), 4096)
    assert n <= np.ceil(lengths.sum() / 4096) * 1.01 + 1


def test_empty(spark):
    assert packing.pack(packing.tokenized_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0
