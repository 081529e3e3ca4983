"""Words of whole texts as 64-bit hashes, in numpy over Arrow buffers, and a linear scorer on them.

A batch of texts is one byte array (A-Z lower-cased by table).  A word is a maximal run of word
bytes; its hash is a polynomial over its bytes, so hashes of whole words, of prefixes and of shapes
cost a few vector operations and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.shingles import _BASE, _BYTE, _SPACE, _U, mix, text_bytes

#: Bytes of letter words: ASCII letters and digits, and all of UTF-8's multi-byte characters.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Bytes of white-space separated words.
NON_SPACE = ~_SPACE
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 200
_MEANT = np.arange(256, dtype=np.uint8)
_MEANT[65:91] = _MEANT[97:123]
#: Digits that stand for letters.
for _digit, _letter in zip(b"013457", b"oieast"):
    _MEANT[_digit] = _letter


class Words:
    """The words of a batch: ``off`` are row offsets into every array of hashes."""

    def __init__(self, texts: pa.Array, inner: np.ndarray = NON_SPACE):
        data, rows = text_bytes(texts)
        self.data = data
        word = inner[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = rows[1:-1][rows[1:-1] < len(data)]
        first[cuts] |= word[cuts]
        self.starts = np.flatnonzero(first)
        self.off = np.searchsorted(self.starts, rows)
        self._at = np.flatnonzero(word)
        self._bytes = data[self._at]
        self._first = np.searchsorted(self._at, self.starts)
        self._place = self._at - np.repeat(self.starts, np.diff(np.append(self._first, len(self._at))))
        powers = np.full(int(self._place.max(initial=0)) + 1, _U(_BASE))
        powers[0] = 1
        self._powers = np.multiply.accumulate(powers)

    def __len__(self) -> int:
        return len(self.starts)

    def _sum(self, value: np.ndarray) -> np.ndarray:
        return mix(np.add.reduceat(value, self._first)) if len(self) else np.zeros(0, np.uint64)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``prefix`` bytes (another hash than the word's)."""
        value = _BYTE[self._bytes] * self._powers[self._place]
        if prefix is None:
            return self._sum(value)
        value[self._place >= prefix] = 0
        return mix(self._sum(value) + _U(prefix))

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self._first, len(self._at)))

    def shapes(self) -> np.ndarray:
        """Hash of each word's run of byte classes: upper, lower, digit, other letters, the rest itself."""
        kind = _CLASS[self._bytes]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (self._place[1:] == 0)
        place = np.cumsum(new) - 1
        place = place - np.repeat(place[self._first], self.lengths()) if len(self) else place
        value = np.where(new, (kind.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(77)) * self._powers[place], _U(0))
        return self._sum(value)

    def meant(self) -> np.ndarray:
        """Hash of each word as it is meant: digits that look like letters read as such, repeated letters once."""
        letter = _MEANT[self._bytes]
        new = np.ones(len(letter), bool)
        new[1:] = (letter[1:] != letter[:-1]) | (self._place[1:] == 0)
        place = np.cumsum(new) - 1
        place = place - np.repeat(place[self._first], self.lengths()) if len(self) else place
        return mix(self._sum(np.where(new, _BYTE[letter] * self._powers[place], _U(0))) + _U(101))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The words that have another after them in their text, and the hash of both."""
        h, rows = self.hashes(), self.rows()
        at = np.flatnonzero(rows[1:] == rows[:-1])
        return at, mix(h[at] * _U(3) + h[at + 1] + _U(202))

    def any(self, flags: np.ndarray) -> np.ndarray:
        """Which words have a flagged byte; ``flags`` is over the words' bytes."""
        return np.add.reduceat(flags.astype(np.int64), self._first) > 0 if len(self) else np.zeros(0, bool)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def bounded_sample(rows: DataFrame, total: int, sample_rows: int) -> DataFrame:
    """``text`` of about ``sample_rows`` of ``total`` rows ``doc_id, text``, by a hash of both.

    Equal rows are taken once, so that neither null ids nor a document that fills a third of the table
    can lengthen the sample; they meet after each task has reduced its own.
    """
    span = 1 << 31
    keyed = rows.select("text", F.xxhash64("doc_id", "text").alias("key"))
    return keyed.where(F.pmod("key", F.lit(span)) < int(span * min(1.0, sample_rows / max(total, 1)))).dropDuplicates(["key"]).select("text")


def train_linear(sample: DataFrame, size: int, parts: int = 4, rounds: int = 150, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on rows ``ids array<int>, x array<float>, target double``.

    ``size`` is the number of features, targets may be soft.  The sample is dealt to ``parts``
    tasks; each fits its share (Adam on the full gradient) and the weights are averaged by rows, so
    the driver gets ``parts`` vectors of ``size`` numbers.  Returns weights and bias.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares = [pdf for pdf in batches if len(pdf)]
        if not shares:
            return
        pdf = pd.concat(shares, ignore_index=True)
        n = len(pdf)
        row = np.repeat(np.arange(n), pdf["ids"].map(len))
        ids = np.concatenate([*pdf["ids"], np.zeros(0, np.int32)]).astype(np.int64)
        x = np.concatenate([*pdf["x"], np.zeros(0)]).astype(np.float64)
        y = pdf["target"].to_numpy(np.float64)
        w = np.zeros(size + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            z = w[size] + np.bincount(row, w[ids] * x, n)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.append(np.bincount(ids, error[row] * x, size) + decay * w[:size], error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        yield pd.DataFrame({"n": [n], "w": [w.tolist()]})

    fits = sample.repartition(parts).mapInPandas(fit, "n long, w array<double>").collect()
    if not fits:
        return np.zeros(size), 0.0
    total = sum(f["n"] for f in fits)
    w = sum(np.array(f["w"]) * f["n"] for f in fits) / total
    return w[:size], float(w[size])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
