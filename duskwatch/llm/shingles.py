"""Word shingles of whole texts, hashed in numpy over Arrow buffers.

A batch of texts is handled as one byte array: A-Z is lower-cased by table, words are maximal
runs of bytes other than space and 0x09-0x0D, a word's hash is a polynomial over its bytes and a
shingle's hash mixes the hashes of its consecutive words.  Nothing here loops over words or
characters in Python, and nothing looks at more than one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the row offsets into them (null: empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch, and the row offsets into these hashes."""
    data, off = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = off[1:-1][off[1:-1] < len(data)]
    first[cuts] |= word[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    index = np.cumsum(first, dtype=np.int64) - 1
    at = np.flatnonzero(word)
    place = at - starts[index[at]]
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = _U(_BASE)
    powers = np.multiply.accumulate(powers)
    value = np.zeros(len(data), np.uint64)
    value[at] = _BYTE[data[at]] * powers[place]
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, off)


def shingle_hashes(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a row, and the row offsets.

    A text of fewer than ``size`` words, but at least one, has its whole word sequence as its
    only shingle; a text without words has none.
    """
    words, off = word_hashes(texts)
    n = np.diff(off)
    rows = len(n)
    full = np.maximum(n - size + 1, 0)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1] * _PLACES[0]
        for k in range(1, size):
            rolled = rolled + words[k : len(words) - size + 1 + k] * _PLACES[k]
        row = np.repeat(np.arange(rows), full)
        start = np.repeat(off[:-1], full) + np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        grams = mix(rolled[start])
    else:
        row, grams = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            whole[has] += words[off[short[has]] + k] * _PLACES[32 + k]
        row, grams = np.concatenate([row, short]), np.concatenate([grams, mix(whole + n[short].astype(np.uint64))])
        order = np.argsort(row, kind="stable")
        row, grams = row[order], grams[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        grams[a:b].sort()
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        row, grams = row[keep], grams[keep]
    return grams, np.searchsorted(row, np.arange(rows + 1))


def minhash(grams: np.ndarray, off: np.ndarray, coordinates: int, seed: int = 7) -> np.ndarray:
    """Signatures (rows x coordinates, uint32) of non-empty rows; empty rows are all zero."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(1, 2**63, coordinates, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
    out = np.zeros((len(off) - 1, coordinates), np.uint32)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for k in range(coordinates):
            v = ((grams ^ b[k]) * a[k]) >> _U(32)
            out[some, k] = np.minimum.reduceat(v, off[some]).astype(np.uint32)
    return out
