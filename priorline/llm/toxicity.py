"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word enters as its own vector (for words of the training sample) beside the mean vector of its hashed character
n-grams, so inflected and unseen words are read by their parts. Two gated recurrent units run over a window of
``WINDOW`` words, one in each direction; attention pools their states, and a logistic unit scores the window. A text's
score is the highest among all its windows, which overlap by ``WINDOW - STRIDE`` words and cover it to the end.

Training sees labelled rows only, at most ``TRAIN_EACH`` of each label and none longer than ``TRAIN_CHARS``: those
with the smallest id hashes, so equal tables give equal models. Labels belong to texts, so a text learns through its
highest window (after two rounds through all of them). What is broadcast is the model, whose size the parameters fix.

Projections of words through the input weights are computed once for each distinct word of a worker, not for each use.

Null or empty text: one window of no words, whose score is the model's bias. Without labels of both kinds the score is
the rate of toxic labels in the sample, or 0. Rows are scored one by one; a labelled id with several rows trains with
the smallest of its texts, and the larger of its labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorline.llm.common import bounded_batches, collected, id_text, remembered

WINDOW, STRIDE = 64, 48
#: Decay of parameters at each step, in learning rates.
DECAY = 0.1
#: Most training rows without and with the toxic label.
TRAIN_EACH = (4500, 1500)
TRAIN_CHARS = 20_000
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 12
NGRAMS = (3, 4, 5)
CHAR_BUCKETS = 1 << 14
VOCABULARY = 20_000
#: Training steps to aim for, and the fewest and most rounds through the sample.
STEPS, ROUNDS = 280, (6, 20)
#: Words whose projections a worker remembers.
REMEMBERED = 150_000
EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def plain(word: str) -> str:
    """Lower case without signs at its ends; a word of signs alone stays."""
    word = word.lower()
    return word if word.isalnum() else EDGE.sub("", word) or word


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rising row numbers and buckets of all character n-grams of ``^word$``; words of like length are hashed together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    rows, found = [], []
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        codes = np.full((len(at), width + 2), 94, np.uint64)
        if width:
            codes[:, 1:-1] = np.array([words[i] for i in at], f"<U{width}").view(np.uint32).reshape(len(at), width)
        codes[:, -1] = 36
        for n in NGRAMS:
            if width + 2 < n:
                continue
            h = np.full((len(at), width + 3 - n), n, np.uint64)
            for k in range(n):
                h = (h ^ codes[:, k : codes.shape[1] - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append((h % np.uint64(CHAR_BUCKETS)).astype(np.int64).ravel())
            rows.append(np.repeat(at, h.shape[1]))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows_, found_ = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows_, kind="stable")
    return rows_[order], found_[order]


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by their number in ``at``."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name; every array is float32."""

    def __init__(self, words: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) * (1 / shape[0]) ** 0.5).astype(np.float32)
        self.known = {w: i + 1 for i, w in enumerate(words)}
        self.p = {"word": np.zeros((len(words) + 1, WORD_DIM), np.float32), "char": np.zeros((CHAR_BUCKETS, CHAR_DIM), np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": draw(d, 3 * h), f"u{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": draw(2 * h), "out": draw(2 * h), "bias": np.full(1, -1.0, np.float32)}

    def features(self, ids: np.ndarray, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of words from their vocabulary ids and n-gram buckets (by rising row), and each word's n-gram count."""
        count = np.maximum(np.bincount(rows, minlength=len(ids)), 1).astype(np.float32)
        chars = np.zeros((len(ids), CHAR_DIM), np.float32)
        if len(rows):
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            chars[rows[first]] = np.add.reduceat(self.p["char"][found], first, axis=0)
        return np.concatenate([self.p["word"][ids], chars / count[:, None]], axis=1), count

    def features_of(self, words: list[str]) -> np.ndarray:
        """Input vectors of distinct words."""
        return self.features(np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words)), *ngram_buckets(words))[0]

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.p[f"w{side}"] + self.p[f"c{side}"] for side in "fb"}

    def run(self, table: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows; ids (steps, windows) index ``table``, -1 after a window's end."""
        steps, n = ids.shape
        h = HIDDEN
        mask = (ids >= 0).astype(np.float32)
        full = bool(mask.all())
        states = np.empty((steps, n, 2 * h), np.float32)
        gates = {}
        for s, side in enumerate("fb"):
            u = self.p[f"u{side}"]
            state = np.zeros((n, h), np.float32)
            kept = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                a = table[side][ids[t]]
                g = state @ u
                rz = sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
                new = np.tanh(a[:, 2 * h :] + rz[:, :h] * g[:, 2 * h :])
                nxt = new + rz[:, h:] * (state - new)
                if not full:
                    nxt *= mask[t][:, None]
                if keep:
                    kept.append((t, state, rz, new, g[:, 2 * h :]))
                state = nxt
                states[t, :, s * h : (s + 1) * h] = state
            gates[side] = kept
        e = states @ self.p["att"]
        if not full:
            e = np.where(mask > 0, e, np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=0))
        if not full:
            alpha *= mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (ids, mask, states, gates, alpha, pooled)) if keep else logit

    def back(self, memo: tuple, d_logit: np.ndarray, n_words: int) -> tuple[dict, dict]:
        """Gradients of the parameters above the table, and of the table's rows."""
        ids, mask, states, gates, alpha, pooled = memo
        h, p = HIDDEN, self.p
        grad = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["att"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = alpha[:, :, None] * d_pooled + d_e[:, :, None] * p["att"]
        tables, real = {}, ids >= 0
        for s, side in enumerate("fb"):
            u, d_u = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
            d_inputs = np.empty((*ids.shape, 3 * h), np.float32)
            carry = np.zeros_like(states[0, :, :h])
            for t, before, rz, new, gn in reversed(gates[side]):
                d = (carry + d_states[t, :, s * h : (s + 1) * h]) * mask[t][:, None]
                r, z = rz[:, :h], rz[:, h:]
                d_new = d * (1 - z) * (1 - new * new)
                d_a = np.concatenate([d_new * gn * r * (1 - r), d * (before - new) * z * (1 - z), d_new], axis=1)
                d_g = d_a.copy()
                d_g[:, 2 * h :] *= r
                d_u += before.T @ d_g
                carry = d * z + d_g @ u.T
                d_inputs[t] = d_a
            grad[f"u{side}"] = d_u
            tables[side] = summed(ids[real], d_inputs[real], n_words)
        return grad, tables


def windows_of(n: int) -> Iterator[tuple[int, int]]:
    """[start, end) of the windows over n words: each starts STRIDE after the last, and the last one ends at n."""
    start = 0
    while True:
        yield start, min(n, start + WINDOW)
        if start + WINDOW >= n:
            return
        start += STRIDE


def laid_out(ids: np.ndarray, spans: list[tuple[int, int]], width: int) -> np.ndarray:
    """Window spans of a flat id array as (steps, windows), -1 after each end."""
    at = np.array(spans, np.int64).reshape(-1, 2)
    place = at[:, 0] + np.arange(width)[:, None]
    inside = place < at[:, 1]
    return np.where(inside, ids[np.where(inside, place, 0)] if len(ids) else -1, -1)


class Adam:
    def __init__(self, rate: float = 0.01) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, grad: dict) -> None:
        self.t += 1
        for k, g in grad.items():
            m = self.m.setdefault(k, np.zeros_like(p[k]))
            v = self.v.setdefault(k, np.zeros_like(p[k]))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= self.rate * ((m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8) + DECAY * p[k])


def train(texts: list[str], labels: list[int], batch: int = 128, seed: int = 7) -> Network:
    """A network fitted on whole texts with one label each."""
    number: dict[str, int] = {}
    split = [np.fromiter((number.setdefault(plain(w), len(number)) for w in t.split()), np.int32) for t in texts]
    words = list(number)
    seen = np.zeros(len(words), np.int64)
    for own in split:
        seen[np.unique(own)] += 1
    often = np.flatnonzero(seen > 2)
    kept = [words[i] for i in sorted(often.tolist(), key=lambda i: (-seen[i], words[i]))[:VOCABULARY]]
    net = Network(kept, seed)
    vocabulary = np.fromiter((net.known.get(w, 0) for w in words), np.int64, len(words))
    parts, grams = [], []
    for at in range(0, len(words), 20_000):  # a part of the words at a time: the driver has little room
        rows, found = ngram_buckets(words[at : at + 20_000])
        parts.append(found.astype(np.int32))
        grams.append(np.bincount(rows, minlength=len(words[at : at + 20_000])))
    buckets = np.concatenate(parts) if parts else np.empty(0, np.int32)
    n_grams = np.concatenate(grams) if grams else np.empty(0, np.int64)
    first_gram = np.r_[0, np.cumsum(n_grams)]
    del parts, grams, number
    rng = np.random.default_rng(seed)
    adam = Adam()
    y = np.array(labels, np.float32)
    rounds = min(max(STEPS // -(-len(split) // batch), ROUNDS[0]), ROUNDS[1])
    for r in range(rounds):
        adam.rate = 0.01 if r < rounds * 2 // 3 else 0.003
        order = rng.permutation(len(split))
        for b in range(0, len(order), batch):
            docs = order[b : b + batch]
            distinct, ids = np.unique(np.concatenate([split[i] for i in docs]), return_inverse=True)
            spans, owner, at = [], [], 0
            for k, i in enumerate(docs):
                for a, e in windows_of(len(split[i])):
                    spans.append((at + a, at + e))
                    owner.append(k)
                at += len(split[i])
            owner = np.array(owner)
            own = n_grams[distinct]
            rows = np.repeat(np.arange(len(distinct)), own)
            found = buckets[np.repeat(first_gram[distinct] - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())]
            word_ids = vocabulary[distinct]
            x, count = net.features(word_ids, rows, found)
            table = net.projected(x)
            grid = laid_out(ids, spans, WINDOW)
            if r >= 2:
                logit = net.run(table, grid)
                top = np.lexsort((-logit, owner))
                pick = top[np.r_[True, owner[top][1:] != owner[top][:-1]]]
            else:
                pick = np.arange(len(spans))
            logit, memo = net.run(table, grid[:, pick], keep=True)
            share = 1 / np.bincount(owner[pick], minlength=len(docs))[owner[pick]]
            d = ((sigmoid(logit) - y[docs][owner[pick]]) * share / len(docs)).astype(np.float32)
            grad, tables = net.back(memo, d, len(distinct))
            d_x = np.zeros_like(x)
            for side in "fb":
                grad[f"w{side}"] = x.T @ tables[side]
                grad[f"c{side}"] = tables[side].sum(axis=0)
                d_x += tables[side] @ net.p[f"w{side}"].T
            grad["word"] = summed(word_ids, d_x[:, :WORD_DIM], len(net.p["word"]))
            grad["word"][0] = 0
            grad["char"] = summed(found, (d_x[:, WORD_DIM:] / count[:, None])[rows], CHAR_BUCKETS)
            adam.step(net.p, grad)
    return net


class Scorer:
    """A network with the projections of the words it has met; one for each worker process."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = {side: np.zeros((1, 3 * HIDDEN), np.float32) for side in "fb"}  # places after a window's end read the last row
        self.used = 0

    def learn(self, words: set[str]) -> None:
        if self.used + len(words) > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self.at]
        for part in range(0, len(new), 20_000):
            self._append(new[part : part + 20_000])

    def _append(self, new: list[str]) -> None:
        table = self.net.projected(self.net.features_of([plain(w) for w in new]))
        if self.used + len(new) > len(self.table["f"]):
            room = max(2 * len(self.table["f"]), self.used + len(new), 1 << 14)
            for side in "fb":
                grown = np.zeros((room, 3 * HIDDEN), np.float32)
                grown[: self.used] = self.table[side][: self.used]
                self.table[side] = grown
        for side in "fb":
            self.table[side][self.used : self.used + len(new)] = table[side]
        self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """The highest window probability of each text."""
        flat = [w for words in texts for w in words]
        try:
            ids = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        except KeyError:
            self.learn({w for w in flat if w not in self.at})
            if any(w not in self.at for w in flat):  # the memory was emptied meanwhile
                self.learn(set(flat))
            ids = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        spans, owner, at = [], [], 0
        for k, words in enumerate(texts):
            for a, e in windows_of(len(words)):
                spans.append((at + a, at + e))
                owner.append(k)
            at += len(words)
        owner = np.array(owner, np.int64)
        length = np.array([e - a for a, e in spans])
        best = np.full(len(texts), -np.inf, np.float32)
        for low, width in ((-1, 16), (16, 32), (32, 48), (48, WINDOW)):
            own = np.flatnonzero((length > low) & (length <= width))
            for b in range(0, len(own), 2048):
                part = own[b : b + 2048]
                logit = self.net.run(self.table, laid_out(ids, [spans[i] for i in part], width))
                np.maximum.at(best, owner[part], logit)
        return sigmoid(best.astype(np.float64))


def held_out(id_col: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, each: tuple[int, int] = TRAIN_EACH, chars: int = TRAIN_CHARS) -> Network | float:
    """A network from the labelled rows that are not held out; a bare rate where one label is missing."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        some = own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each[label])
        picked = some if picked is None else picked.unionByName(some)
    rows = id_text(docs).where(F.length("text") <= chars).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = [int(r["toxic"]) for r in rows]
    if not y or min(y) == max(y):
        return float(sum(y) / len(y)) if y else 0.0
    texts = [r["text"] for r in rows]
    del rows
    net = train(texts, y)
    del texts
    collected(docs.sparkSession)  # training takes more of the driver's memory than all that follows
    return net


def _scores(texts, net: Network | float) -> np.ndarray:
    """Scores of an Arrow column of texts; nulls count as empty."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    scorer = remembered(("toxicity", id(net)), lambda: Scorer(net))
    out, held, n = [], [], 0
    for row in range(len(texts)):
        held.append((texts[row].as_py() or "").split())
        n += len(held[-1])
        if n > 100_000 or row == len(texts) - 1:
            out.append(scorer.score(held))
            held, n = [], 0
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id and score for every row."""
    docs = id_text(docs)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), sent.value), pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def below(docs: DataFrame, net: Network | float, limit: float) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they were."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(batch.schema.names.index("text")), sent.value) < limit))

    return docs.mapInArrow(run, docs.schema)
