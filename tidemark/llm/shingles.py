"""Word shingles of whole texts as 64-bit hashes, for blocks of texts at once.

A word is a run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text; everything
else separates words. A text of fewer words than a shingle has one shingle of all its words; one without words has
none.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.array([chr(i).isalnum() or i == 95 or i > 127 for i in range(256)])
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers[kind][:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has."""
    coded = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    up = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), dtype=np.uint64)
    before = np.where(start > 0, up[start - 1], np.uint64(0))
    found = mix((up[end - 1] - before) * _power("down", _INVERSE, len(data))[start])
    limits = np.cumsum([len(x) + 1 for x in coded])
    return found, np.diff(np.searchsorted(start, limits), prepend=0)


def shingles(found: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each text, repeats included, and the index of the text of each."""
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(found))  # words from here to the end of the text
    first = left == np.repeat(counts, counts)
    take = (left >= n) | first
    at, left = np.flatnonzero(take), left[take]
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        has = left > j
        total += np.where(has, found[np.minimum(at + j, len(found) - 1)], np.uint64(j + 1)) * np.uint64(0xD6E8FEB86659FD93 + 2 * j * 0x9E3779B1)
        total = mix(total)
    return total, text[at]


def weighted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) keys in order (text in the upper 20 bits), and how often each occurs."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.sort((text.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(np.concatenate([first, [len(key)]]))


def shared_with(one: np.ndarray, weight: np.ndarray, hashes: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weight that each of several texts shares with one. one, weight: its distinct shingles in order and how often each occurs; hashes, weights: theirs, text i's from ``ends[i]`` to ``ends[i + 1]``."""
    if not len(one) or not len(hashes):
        return np.zeros(len(ends) - 1, np.int64)
    at = np.minimum(np.searchsorted(one, hashes), len(one) - 1)
    sums = np.concatenate([[0], np.cumsum(np.where(one[at] == hashes, np.minimum(weight[at], weights), 0))])
    return np.diff(sums[ends])


def overlaps(left: list[str], right: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts: weight of what their shingle counts share, weight of the left, of the right."""
    both, size = [], ([], [])
    for pair in zip(left, right, strict=True):
        (a, wa), (b, wb) = (weighted(*shingles(*words([t]), n)) for t in pair)
        both.append(int(shared_with(a, wa, b, wb, np.array([0, len(b)]))[0]))
        for x, w in zip(size, (wa, wb), strict=True):
            x.append(int(w.sum()))
    return np.array(both, np.int64), np.array(size[0], np.int64), np.array(size[1], np.int64)


def jaccard(left: list[str], right: list[str], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle counts of each pair of texts; 0 where neither has a word."""
    both, a, b = overlaps(left, right, n)
    return np.where(a + b > 0, both / np.maximum(a + b - both, 1), 0.0)
