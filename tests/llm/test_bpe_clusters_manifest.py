"""Byte-level BPE against its library, clustering and manifest against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from priorline.llm import bisectors, byte_bpe, merkle

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(RANKS))


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash_gives_each_key_a_slot_and_knows_strangers(vocab):
    tokens = vocab.tokens
    assert sorted(vocab.hash.slots(byte_bpe.hashed(tokens)).tolist()) == list(range(len(tokens)))
    strangers = [b"not a token %d" % i for i in range(500)]
    assert all(s < 0 or tokens[s] != w for s, w in zip(vocab.hash.slots(byte_bpe.hashed(strangers)), strangers))
    assert byte_bpe.PerfectHash([]).slots(byte_bpe.hashed([b"x"])).tolist() == [-1]
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_encoding_equals_the_library_on_random_texts(vocab, library):
    rnd, cut = random.Random(5), byte_bpe.Cutter(PATTERN)
    parts = ["a", "b", "é", "\n", " ", "  ", " ", "漢字", "😀", "'s", "'LL", "1", "٣", "½", "\x1c", "\x00", "the", "ing", "_", "́", "<|endoftext|>", "zürich", "�"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(50))) for _ in range(800)]
    got = list(byte_bpe.encode_texts(texts, vocab, cut))
    assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [vocab.decode(g) for g in got] == [t.encode() for t in texts]


def test_latin_texts_are_cut_as_all_others():
    cutter, rnd = byte_bpe.Cutter(PATTERN), random.Random(2)
    assert cutter.of("é\x85") is cutter.latin and cutter.of("é漢") is cutter.wide
    for _ in range(4000):
        text = "".join(chr(rnd.choice([rnd.randrange(256), rnd.randrange(128), 32, 39, 0xA0])) for _ in range(rnd.randrange(30)))
        assert cutter.latin.findall(text) == cutter.wide.findall(text)


def test_forgotten_results_are_made_again(vocab, monkeypatch):
    words = [f" zxqv{i:03d}k" for i in range(40)]
    want = [vocab.merge(w.encode()) for w in words]
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 7)
    vocab.merged, vocab.older = {}, {}
    for _ in range(3):
        assert [vocab.resolve({w})[w] for w in words] == want and len(vocab.merged) <= 7 and len(vocab.older) <= 7


@pytest.mark.parametrize("text", ["ab" * 70_000, "x " * 300, " " * 3000, "a1!" * 5000, "é" * 4001])
def test_long_pretokens_equal_the_library(vocab, library, text):
    assert ids(next(byte_bpe.encode_texts([text], vocab, byte_bpe.Cutter(PATTERN)))) == library.encode_ordinary(text)


def test_very_long_text_goes_in_stretches(vocab, library, monkeypatch):
    text = "Lorem ipsum 123 dolor, sit amet. " * 300
    monkeypatch.setattr(byte_bpe, "CHARS", 500)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 70)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    got = list(byte_bpe.encode_texts(["one two", text, "", "thréééé"], vocab, byte_bpe.Cutter(PATTERN)))
    assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in ("one two", text, "", "thréééé")]


def test_encoded_and_decoded_rows(spark, library):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (None, "x", 6), (2, None, 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, PATTERN), RANKS).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=key) == sorted(((i, (t or "").encode()) for i, t, _ in rows), key=key)
    assert {ids(r.ids)[0] for r in back if r.doc_id == 1} == {library.encode_ordinary("Hello")[0]}
    none = byte_bpe.decoded(byte_bpe.encoded(docs.where("false"), RANKS, PATTERN), RANKS)
    assert none.columns == ["doc_id", "ids", "decoded"] and none.collect() == []


def test_unknown_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00")), (2, bytearray(b"\x01")), (3, None)], "doc_id long, ids binary")
    assert [r.decoded for r in byte_bpe.decoded(rows, RANKS).collect()] == [None, None, None]


def plain_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in named[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        cents = [[sum(col) // len(own[c]) for col in zip(*own[c])] if c in own else x for c, x in enumerate(cents)]
    out = [(i, near(x)[1], near(x)[0]) for i, x in kept]
    per = {c: sum(d for _, q, d in out if q == c) for _, c, _ in out}
    return sorted(((i is None, i or 0, c, d, per[c], sum(per.values()), tuple(map(str, cents[c]))) for i, c, d in out))


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    # Few values a component: many ties and equal vectors.
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 0.001]) for _ in range(3)]) for i in range(120)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(200, 260)] + [(7, [0.25, 0.0, 0.0]), (7, [0.25, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 1.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0]), (905, [])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    got = bisectors.clustered(df, k=7, rounds=3, size=3).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == plain_clusters(rows, 7, 3, 3)


def test_clusters_of_huge_components(spark):
    rows = [(1, [3e38, 0.0]), (2, [3e38, 1.0]), (3, [-3e38, 0.0]), (4, [-1.0, 2.0]), (5, [-1.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in bisectors.clustered(df, k=3, rounds=2, size=2).collect()}
    assert len(got) == 5 and got[4].cluster == got[5].cluster
    with_centroid = {i: [int(v) for v in r.centroid] for i, r in got.items()}
    exact = {i: sum((math.floor(256 * float(np.float32(v))) - c) ** 2 for v, c in zip(x, with_centroid[i])) for i, x in rows}
    assert all(got[i].distance == (d if d < 2**63 else None) for i, d in exact.items())


def test_fewer_vectors_than_clusters_and_none(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [5.0])], "vec_id long, embedding array<float>")
    assert {(r.distance, r.inertia) for r in bisectors.clustered(df, k=40, rounds=5, size=1).collect()} == {(0, 0)}
    assert bisectors.clustered(df.where("false"), k=40, rounds=5, size=1).collect() == []
    assert bisectors.clustered(df.withColumn("vec_id", F.lit(None).cast("long")), size=1).collect() == []


def test_large_tables_of_bisectors_are_made_as_they_are_met(monkeypatch):
    rnd = np.random.default_rng(1)
    cents, x = rnd.integers(-9, 9, (12, 4)), rnd.integers(-9, 9, (500, 4))
    whole = bisectors.Bisectors(cents).winners(x)
    monkeypatch.setattr(bisectors, "TABLE", 1)
    assert (bisectors.Bisectors(cents).winners(x) == whole).all()
    assert (((x[:, None, :] - cents) ** 2).sum(axis=2).argmin(axis=1) == whole).all()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Proofs and roots of rows (tree, key, text), built whole in memory."""

    def grow(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def up(levels, at):
        path = []
        for nodes in levels[:-1]:
            run = at // 8 * 8
            path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
            at //= 8
        return path

    leaf = lambda r: sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    trees = {}
    for r in rows:
        trees.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, leaf(r)))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {t: grow([x[2] for x in sorted(trees[t])]) for t in order}
    last = grow([grown[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for at, (some, key, own) in enumerate(sorted(trees[t])):
            out.append((key if some else None, own, grown[t][-1][0], last[-1][0], up(grown[t], at) + up(last, k)))
    return out


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9), (64, 65, 7), (700, 2, 1, 130)])
def test_manifest_equals_brute_force(spark, sizes):
    names = [None, "é", "a", "-", "zz"]
    rows = [(names[t], k, f"text {t} {k}") for t, n in enumerate(sizes) for k in range(n)]
    rows += [(None, None, "x"), (None, None, "x"), ("a", 3, None), ("a", 3, None), ("", 5, "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, doc_id long, text string, tree string").repartition(6)
    leaf = merkle.row_digest(F.col("lang"), F.col("doc_id"), F.col("text"))
    got = merkle.proofs(df, leaf, F.col("lang"), F.col("doc_id"), touched=F.when(F.col("doc_id") == 3, merkle.row_digest(F.lit("other"))))
    got = got.withColumn("folded", merkle.folded(F.coalesce("touched", "leaf"), F.col("path"))).withColumn("digest", merkle.proof_digest(F.col("path"))).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[4])
    assert sorted(((r.key, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got), key=key) == sorted(plain_manifest(rows), key=key)
    for r in got:
        assert (r.folded == r.root) == (r.key != 3)
        assert r.digest == sha(*[a + b for a, b in r.path])


def test_manifest_of_an_empty_table_and_of_one_row(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, lang string")
    one = merkle.proofs(df, merkle.row_digest(F.col("doc_id")), F.col("lang"), F.col("doc_id")).collect()[0]
    assert one.leaf == one.subroot == one.root == sha("1:1") and one.path == []
    assert merkle.proofs(df.where("false"), merkle.row_digest(F.col("doc_id")), F.col("lang"), F.col("doc_id")).collect() == []
    with pytest.raises(ValueError):
        merkle.proofs(df, F.lit("x"), F.col("lang"), F.col("doc_id"), root=F.lit(1))
