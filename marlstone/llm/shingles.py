"""Word shingles of UTF-8 texts as sorted 64-bit hashes, vectorised over bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased.
A word's hash is a polynomial in its bytes' random values; five word hashes,
weighted by place and mixed, make a shingle's.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_MASK = (1 << 64) - 1


def _random(seed: int, n: int) -> list[int]:
    """splitmix64 numbers, the same on every machine."""
    out = []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


_VALUE = np.array(_random(7, 256), np.uint64)
_VALUE[65:91] = _VALUE[97:123]


def alphabet(separators) -> tuple[np.ndarray, np.ndarray]:
    """(value, part of a word) of every byte."""
    value, is_word = _VALUE.copy(), np.ones(256, bool)
    value[separators] = 0
    is_word[separators] = False
    return value, is_word


#: Words between white space; words of letters and digits, as all other ASCII separates.
SPACED = alphabet([0x20, *range(0x09, 0x0E)])
ALNUM = alphabet([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_PLACE = np.array([x | 1 for x in _random(11, SIZE + 1)], np.uint64)
_BASE = _random(13, 1)[0] | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 17
with np.errstate(over="ignore"):
    _POWER = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(_BLOCK, _BASE, np.uint64))))
    _INVERSE = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(_BLOCK, _UNBASE, np.uint64))))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _words(raw: np.ndarray, off: np.ndarray, kind=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, n + 1 offsets into them) of texts that fill at most one block."""
    value, is_word = kind
    a, z = int(off[0]), int(off[-1])
    if a == z:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    b = raw[a:z]
    word = is_word[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = off[:-1][np.diff(off) > 0] - a
    start[inner] = word[inner]  # a text starts a word of its own
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    h = np.add.reduceat(value[b] * _POWER[: len(b)], at) * _INVERSE[at]
    return h, np.searchsorted(at, off - a)


def _long_words(raw: np.ndarray, kind=SPACED) -> np.ndarray:
    """Word hashes of one text of any length, block by block; a word may reach over blocks."""
    value, is_word = kind
    parts: list[np.ndarray] = []
    open_, length = 0, 0  # hash and length so far of the word that the last block ended in
    for a in range(0, len(raw), _BLOCK):
        b = raw[a : a + _BLOCK]
        word = is_word[b]
        head = int(np.argmin(word)) if not word.all() else len(b)
        if length:
            part = int((value[b[:head]] * _POWER[:head]).sum(dtype=np.uint64)) if head else 0
            open_ = (open_ + part * pow(_BASE, length, 1 << 64)) & _MASK
            length += head
            if head == len(b):
                continue
            parts.append(np.array([open_], np.uint64))
            open_, length = 0, 0
            b = b[head:]
        h, _ = _words(b, np.array([0, len(b)]), kind)
        if len(h) and is_word[b[-1]]:
            tail = ~is_word[b]
            length = int(np.argmax(tail[::-1])) if tail.any() else len(b)
            open_, h = int(h[-1]), h[:-1]
        parts.append(h)
    if length:
        parts.append(np.array([open_], np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_runs(raw: np.ndarray, off: np.ndarray, kind=SPACED):
    """Yields (first text, word hashes, n + 1 offsets into them) of runs of texts; a text longer than a block is a run of its own."""
    with np.errstate(over="ignore"):
        i, n = 0, len(off) - 1
        while i < n:
            j = int(np.searchsorted(off, off[i] + _BLOCK, "right")) - 1
            if j <= i:
                w = _long_words(raw[off[i] : off[i + 1]], kind)
                yield i, w, np.array([0, len(w)])
                i += 1
            else:
                yield i, *_words(raw, off[i : j + 1], kind)
                i = j


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n <= ``SIZE`` words."""
    with np.errstate(over="ignore"):
        if len(w) < n:
            return np.zeros(0, np.uint64)
        out = w[: len(w) - n + 1] * _PLACE[0]
        for j in range(1, n):
            out += w[j : len(w) - n + 1 + j] * _PLACE[j]
        return mix(out + _PLACE[SIZE] * np.uint64(n))


def _few(w: np.ndarray) -> np.ndarray:
    """A text of fewer words than a shingle has: the whole as one."""
    if not len(w):
        return np.zeros(0, np.uint64)
    return mix(np.array([(w * _PLACE[: len(w)]).sum(dtype=np.uint64) + _PLACE[SIZE] * np.uint64(len(w))], np.uint64))


def shingle_sets(raw: np.ndarray, off: np.ndarray):
    """Yields the sorted distinct shingle hashes (uint64) of every text."""
    with np.errstate(over="ignore"):
        for _, w, at in word_runs(raw, off):
            own = grams(w, SIZE)
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if z - a < SIZE:
                    yield _few(w[a:z])
                    continue
                u = np.sort(own[a : z - SIZE + 1])
                keep = np.empty(len(u), bool)
                keep[0] = True
                np.not_equal(u[1:], u[:-1], out=keep[1:])
                yield u[keep]
