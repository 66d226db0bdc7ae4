"""64-bit word and word-shingle hashes of whole texts, as numpy arrays.

Words are maximal runs of "word bytes" in the UTF-8 text.  A word's hash is a
polynomial over its bytes modulo 2**64 followed by a bit mixer, taken from one
prefix sum over the text, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _class(*, space_only: bool) -> np.ndarray:
    table = np.ones(256, bool)
    if space_only:
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:  # ASCII letters (lower case), ASCII digits and every non-ASCII byte
        table[:128] = False
        table[0x30:0x3A] = True
        table[0x61:0x7B] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACE_WORDS = _class(space_only=True)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased.
ALNUM_WORDS = _class(space_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16, 2 * len(_POW))
        base, inv = np.full(size, _R), np.full(size, _R_INV)
        base[0] = inv[0] = 1
        _POW, _INV = np.multiply.accumulate(base), np.multiply.accumulate(inv)
    return _POW, _INV


def spans(data: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte positions of the words of `data`."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word_bytes[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes | None, word_bytes: np.ndarray = SPACE_WORDS) -> np.ndarray:
    """One uint64 for each word of `data`, A-Z lower-cased; null: none."""
    if not data:
        return np.zeros(0, np.uint64)
    data = data.lower()
    start, end = spans(data, word_bytes)
    return hash_spans(data, start, end)


def hash_spans(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in text order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    last = len(words) - n + 1
    out = words[:last] * _STEP[0]
    for k in range(1, n):
        out = out + words[k : k + last] * _STEP[k]
    return mix(out ^ np.uint64(n))


def shingle_set(data: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle; no words: empty."""
    words = word_hashes(data, SPACE_WORDS)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))
