"""BagMinHash signatures of shingle multisets, vectorised over whole blocks of documents.

A shingle of weight w (its count) owns the weight axis up to w. The axis is cut into the dyadic intervals [0,1), [1,2),
[2,4), [4,8) ...; each (shingle, interval) has a Poisson process whose rate is the interval's width. Its points come in
order of time, seeded by shingle and interval alone: each has a slot of the signature and a weight cell. An interval that
lies below w counts whole; in the one that w cuts, the points' cells decide, which splits it down to single weights.
A slot's value is the time of its first point: two documents agree in a slot with probability their weighted Jaccard
similarity. Times beyond the largest slot value don't matter, so only points up to a limit are made: the limit that fills
all slots almost surely, tripled for documents where it didn't.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, scan_words

SLOTS, ROWS = 128, 4
SHINGLE = 5
#: Bits of a shingle's number; the rest of 64 hold the document's place in its block.
KEY_BITS = 50
BLOCK_DOCS = 1 << (64 - KEY_BITS)
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of a block, by document and shingle; and the word count of each text.

    A shingle is ``size`` consecutive words; a text of fewer words, but not none, is one shingle.
    """
    words, _, _, first = scan_words(raw, offs)
    n, total = len(offs) - 1, len(words)
    n_words = np.diff(first)
    if not total:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, n_words
    doc = np.repeat(np.arange(n), n_words)
    left = np.repeat(first[1:], n_words) - np.arange(total)  # words from here to the text's end
    with np.errstate(over="ignore"):
        value = mix64(words + _G)
        for k in range(1, size):
            ahead = np.minimum(np.arange(total) + k, total - 1)
            value = value * _G + np.where(left > k, mix64(words[ahead] + _G * np.uint64(k + 1)), np.uint64(k))
        value = mix64(value)
    begins = (left >= size) | (np.arange(total) == first[:-1][doc])
    key = (doc[begins].astype(np.uint64) << np.uint64(KEY_BITS)) | (value[begins] >> np.uint64(64 - KEY_BITS))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(KEY_BITS)).astype(np.int64), key & np.uint64((1 << KEY_BITS) - 1), count, n_words


def _points(out: np.ndarray, doc: np.ndarray, seed: np.ndarray, rate: np.ndarray, low: np.ndarray, weight: np.ndarray, limit: np.ndarray, slots: int) -> None:
    """Lower the slots of ``out`` to the points of all processes up to their document's limit."""
    time, step = np.zeros(len(seed)), 0
    flat = out.reshape(-1)
    while len(seed):
        step += 1
        with np.errstate(over="ignore"):
            draw = mix64(seed + _G * np.uint64(2 * step))
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / rate
        keep = time <= limit[doc]
        seed, doc, rate, low, weight, time = (x[keep] for x in (seed, doc, rate, low, weight, time))
        with np.errstate(over="ignore"):
            draw = mix64(seed + _G * np.uint64(2 * step + 1))
        cell = low + (draw >> np.uint64(32)).astype(np.int64) % rate.astype(np.int64)
        ok = cell < weight
        np.minimum.at(flat, doc[ok] * slots + (draw[ok] % np.uint64(slots)).astype(np.int64), time[ok])


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots) first times; rows of documents without shingles are infinite."""
    out = np.full((n, slots), np.inf)
    total = np.bincount(doc, weights=count, minlength=n)
    limit = slots * (np.log(slots) + 5) / np.maximum(total, 1)
    live = total > 0
    while True:
        parts = []
        own = live[doc]
        d, s, c = doc[own], shingle[own], count[own]
        low, width, level = 0, 1, 0
        while len(d):
            with np.errstate(over="ignore"):
                parts.append((d, mix64(s * _G + np.uint64(level)), np.full(len(d), float(width)), np.full(len(d), low), c))
            low, width, level = low + width, max(1, low + width), level + 1
            more = c > low
            d, s, c = d[more], s[more], c[more]
        if parts:
            d, seed, rate, low_, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            _points(out, d, seed, rate, low_, c, limit, slots)
        live = live & np.isinf(out).any(1)
        if not live.any():
            return out
        out[live] = np.inf
        limit = np.where(live, limit * 3, limit)


def compact(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of first times: 16-bit slot values to compare, and 64-bit band keys of ``ROWS`` slots each."""
    n, slots = times.shape
    with np.errstate(over="ignore"):
        mixed = mix64(np.ascontiguousarray(times).view(np.uint64) + _G * np.arange(1, slots + 1, dtype=np.uint64))
        bands = mixed.reshape(n, slots // ROWS, ROWS)
        key = np.zeros((n, slots // ROWS), np.uint64)
        for k in range(ROWS):
            key = mix64(key * _G + bands[:, :, k])
    return (mixed >> np.uint64(48)).astype(np.uint16), key.view(np.int64)


def overlaps(one: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the lesser counts of a sorted multiset (keys, counts) with each of several, which lie behind one another from ``starts`` on (none is empty)."""
    if not len(keys) or not len(one[0]):
        return np.zeros(len(starts), np.int64)
    at = np.minimum(np.searchsorted(one[0], keys), len(one[0]) - 1)
    least = np.where(one[0][at] == keys, np.minimum(one[1][at], counts), 0).astype(np.int64)
    return np.add.reduceat(least, starts)
