"""BagMinHash signatures of word-shingle multisets, vectorised over batches of texts.

A multiset gives each shingle a weight, its multiplicity. A shingle of weight
w runs a Poisson process over (0, w]; its points in time fall on random
slots, and a slot's signature is its first point of all. Two signatures agree
in a slot with the probability of the weighted Jaccard similarity, without
bias, as both hold the same first point just where the union's first point
lies below both weights.

Weights are discretised to integers and their axis is split into a hierarchy of
dyadic intervals (0,1], (1,2], (2,4], (4,8] ...; a shingle runs one process
for each interval that begins below its weight, seeded by (shingle,
interval), so equal shingles run equal processes in all texts. Points of the last
interval that lie above the weight are thinned out. A process ends as soon as its time
passes the largest slot of its text, which is what makes large bags quick.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle; bands and rows of a signature.
SHINGLE, BANDS, ROWS = 5, 28, 8
SLOTS = BANDS * ROWS
#: Words of which a worker remembers the hash, and shingles that one vectorised step takes.
CACHE_WORDS, STEP_SHINGLES = 400_000, 400_000

_WORD = re.compile(r"\w+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
_words: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from the top 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h += mix(words[i : n - k + 1 + i]) * _POWERS[i]
    return mix(h + np.uint64(k))


def bag(words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their multiplicities."""
    return np.unique(shingles(words, k), return_counts=True)


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(intersection, union) of two bags, as multisets."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    inter = int(np.minimum(one[1][i], two[1][j]).sum())
    return inter, int(one[1].sum() + two[1].sum()) - inter


def digest(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    """128-bit digest of a bag: equal bags have equal digests."""
    h = xxhash.xxh3_128()
    h.update(b[0].tobytes())
    h.update(b[1].astype(np.int64).tobytes())
    return h.digest()


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Time of the first point of each slot: [text, slot]; inf in all slots of an empty bag."""
    n = len(bags)
    out = np.full((n, slots), np.inf)
    sizes = [len(b[0]) for b in bags]
    if not sum(sizes):
        return out
    doc = np.repeat(np.arange(n), sizes)
    h = np.concatenate([b[0] for b in bags])
    w = np.concatenate([b[1] for b in bags]).astype(np.int64)
    # Processes: the first interval of each shingle, then those of heavier ones.
    docs, seeds, low, span, limit = [doc], [mix(h ^ _GOLD)], [np.zeros(len(h), np.int64)], [np.ones(len(h), np.int64)], [w]
    start = 1
    heavy = w > 1
    while heavy.any():
        docs.append(doc[heavy])
        seeds.append(mix(h[heavy] + np.uint64(start * int(_GOLD) % (1 << 64))))
        low.append(np.full(int(heavy.sum()), start, np.int64))
        span.append(np.full(int(heavy.sum()), start, np.int64))
        limit.append(w[heavy])
        start *= 2
        heavy = w > start
    docs, seeds, low, span, limit = (np.concatenate(x) for x in (docs, seeds, low, span, limit))
    t = np.zeros(len(docs))
    done = np.zeros(len(docs), dtype=np.uint64)
    flat = out.reshape(-1)
    while len(docs):
        r = int(min(128, max(1, 30_000 // len(docs))))
        no = done[:, None] + np.arange(1, r + 1, dtype=np.uint64)
        x = mix(seeds[:, None] + no * _GOLD)
        times = t[:, None] + np.cumsum(-np.log(uniform(x)) / (slots * span[:, None]), axis=1)
        y = mix(x ^ _M1)
        slot = ((y >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        at = docs[:, None] * slots + slot.astype(np.int64)
        ok = times < flat[at]
        partial = limit < low + span
        if partial.any():
            place = low[:, None] + 1 + ((y & np.uint64(0xFFFFFFFF)) * span[:, None].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            ok &= ~partial[:, None] | (place <= limit[:, None])
        np.minimum.at(flat, at[ok], times[ok])
        t, done = times[:, -1], done + np.uint64(r)
        live = t < out.max(axis=1)[docs]
        docs, seeds, low, span, limit, t, done = (v[live] for v in (docs, seeds, low, span, limit, t, done))
    return out


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per text and band, different between bands."""
    bits = signature.view(np.uint64).reshape(len(signature), n_bands, rows)
    h = np.zeros((len(signature), n_bands), dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64) * _GOLD
    for i in range(rows):
        h = mix(h + bits[:, :, i] * _POWERS[i])
    return h.view(np.int64)
