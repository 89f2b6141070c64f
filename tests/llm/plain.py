"""Plain versions of the operators, one document or pair after another, that tests hold the engine against."""

from __future__ import annotations

import math
import re

import numpy as np

from priorline.llm import toxicity

MASK = (1 << 64) - 1


def ngram_buckets(word: str) -> list[int]:
    """Hash buckets of the character n-grams of ``^word$``, one after another."""
    codes, found = [94, *map(ord, word), 36], []
    for n in toxicity.NGRAMS:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = ((h ^ c) * 0x9E3779B97F4A7C15) & MASK
                h ^= h >> 29
            found.append(h % toxicity.CHAR_BUCKETS)
    return found


def _cell(p: dict, side: str, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One step of a gated recurrent unit, gate by gate."""
    h = toxicity.HIDDEN
    a, g = x @ p[f"w{side}"] + p[f"c{side}"], state @ p[f"u{side}"]
    reset, keep = (1 / (1 + np.exp(-(a[k : k + h] + g[k : k + h]))) for k in (0, h))
    new = np.tanh(a[2 * h :] + reset * g[2 * h :])
    return (1 - keep) * new + keep * state


def toxicity_score(net: toxicity.Network, text: str | None) -> float:
    """The highest chance over all windows, each word read in both directions in turn, in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    words = [toxicity.plain(w) for w in (text or "").split()]
    inputs = []
    for w in words:
        grams = ngram_buckets(w)
        chars = sum((p["char"][b] for b in grams), np.zeros(toxicity.CHAR_DIM)) / max(1, len(grams))
        inputs.append(np.concatenate([p["word"][net.known.get(w, 0)], chars]))
    best, start = -math.inf, 0
    while True:
        part = inputs[start : start + toxicity.WINDOW]
        states = {}
        for side, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            state = np.zeros(toxicity.HIDDEN)
            for i in order:
                state = _cell(p, side, part[i], state)
                states[side, i] = state
        both = [np.concatenate([states["f", i], states["b", i]]) for i in range(len(part))]
        pooled = np.zeros(2 * toxicity.HIDDEN)
        if both:
            e = np.array([s @ p["att"] for s in both])
            alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            pooled = sum(x * s for x, s in zip(alpha, both, strict=True))
        best = max(best, pooled @ p["out"] + p["bias"][0])
        if start + toxicity.WINDOW >= len(words):
            return 1 / (1 + math.exp(-best))
        start += toxicity.STRIDE


def grams(text: str | None) -> set:
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def holds_item(text: str | None, items: list[set]) -> bool:
    own = grams(text)
    return any(q and 100 * len(q & own) >= 80 * len(q) for q in items)
