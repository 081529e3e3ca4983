"""Quality classifier: a weak-label model and the linear scorer it trains.

1. Nine heuristic labellers look at each whole text and vote good, bad or nothing.  They overlap: each
   fault is seen by several of them.
2. Documents are counted by their vote pattern (at most 3^9 patterns, whatever the corpus), and
   expectation-maximisation over these counts fits a latent-class model: good documents, and as many
   kinds of bad ones as there are labellers, since a document mostly has one fault.  It estimates the
   shares of the classes and, in each, every labeller's rate of bad votes among those it casts; so a
   labeller that often calls good documents bad is found out and loses its say.  No label is read.
3. The posterior of a document's pattern is its label for training a linear scorer on hashed words,
   hashed word shapes and repeated neighbours, fitted on a sample of about ``SAMPLE_ROWS``
   documents (chosen by a hash of id and text, equal rows once; the bound is a parameter).
4. Every document is scored; one is kept if its score is at least ``MIN_SCORE``.

Defined cases: a text that is null or has no words gets no votes and the scorer's bias; very long texts
are looked at whole; null and repeated ids are rows like others; a score equal to the limit is kept;
other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import table
from duskwatch.llm.hashed_words import Words, bounded_sample, mix, sigmoid, train_linear
from duskwatch.llm.near_dup import _chunks

SAMPLE_ROWS = 10_000
BUCKETS = 1 << 14
MIN_SCORE = 0.5
#: A labeller votes bad above the first limit and good up to the second, on texts of at least so
#: many words: (name, bad above, good up to, least words).
LABELLERS = (
    ("equal neighbours", 0.10, 0.03, 12),
    ("capitals among letters", 0.30, 0.12, 12),
    ("words ending in two exclamation marks", 0.05, 0.0, 12),
    ("symbols for each word", 0.10, 0.02, 12),
    ("words in repeated 3-word windows", 0.50, 0.15, 30),
    ("repeated words", 0.85, 0.60, 60),
    ("words of over 25 bytes", 0.20, 0.05, 12),
    ("words without a letter", 0.20, 0.03, 12),
    ("words ending in a symbol", 0.08, 0.02, 12),
)
GOOD, BAD, NONE = 0, 1, 2
LENIENT = 50.0
_U = np.uint64


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What the labellers look at (rows x labellers), and the words of each text."""
    w = Words(texts)
    h, rows, n_rows = w.hashes(), w.rows(), len(texts)
    n = np.diff(w.off)
    per = np.maximum(n, 1)
    count = lambda r, weights=None: np.bincount(r, weights, n_rows)
    b, byte_row = w._bytes, np.repeat(rows, w.lengths())
    lower, upper = (b >= 97) & (b < 123), (b >= 65) & (b < 91)
    high = b >= 128
    last = w._first + w.lengths() - 1
    bang = (b == 33).astype(np.int8)
    bangs = bang[last] & bang[np.maximum(last - 1, 0)] & (w.lengths() > 1) if len(w) else np.zeros(0)
    symbol = np.isin(b, np.frombuffer(b"#*$%&|<>", np.uint8))
    ends = symbol[last] if len(w) else np.zeros(0)
    letter = np.add.reduceat((lower | upper | high).astype(np.int64), w._first) > 0 if len(w) else np.zeros(0, bool)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    key = mix(h + rows.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    again = len(np.unique(key)) and count(rows[np.unique(key, return_index=True)[1]])
    tri = np.zeros(len(h), np.uint64)
    inside = np.zeros(len(h), bool)
    if len(h) > 2:
        tri[:-2] = mix(key[:-2] + key[1:-1] * _U(3) + key[2:] * _U(7))
        inside[:-2] = rows[:-2] == rows[2:]
    _, place, often = np.unique(tri[inside], return_inverse=True, return_counts=True)
    windows = np.flatnonzero(inside)[often[place] > 1] if inside.any() else np.zeros(0, np.int64)
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[windows + k] = True
    out = np.stack(
        [
            count(rows[same]) / per,
            count(byte_row[upper]) / np.maximum(count(byte_row[upper | lower | high]), 1),
            count(rows, bangs) / per,
            count(byte_row[symbol]) / per,
            count(rows[covered[: len(h)]]) / per,
            1 - again / per,
            count(rows[w.lengths() > 25]) / per,
            count(rows[~letter]) / per,
            count(rows, ends) / per,
        ],
        axis=1,
    )
    return out, n


def vote_codes(texts: pa.Array) -> np.ndarray:
    """The vote pattern of each text as a number in base 3."""
    x, n = measures(texts)
    bad, good, least = (np.array([r[k] for r in LABELLERS]) for k in (1, 2, 3))
    votes = np.where(x > bad, BAD, np.where(x <= good, GOOD, NONE))
    votes[n[:, None] < least] = NONE
    return votes @ (3 ** np.arange(len(LABELLERS)))


def features(texts: pa.Array, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of what the scorer sees: shares of a text's words.

    Features: hashed words and hashed shapes (``n`` buckets together), and two for equal
    neighbours (no, yes).
    """
    w = Words(texts)
    h, rows = w.hashes(), w.rows()
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    ids = np.concatenate([(h % _U(n)).astype(np.int64), (mix(w.shapes() + _U(5)) % _U(n)).astype(np.int64), n + same])
    row = np.tile(rows, 3)
    key, counts = np.unique(row * (n + 2) + ids, return_counts=True)
    row, ids = key // (n + 2), key % (n + 2)
    return row, ids, 4 * counts / np.diff(w.off)[row]


def label_model(patterns: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation.

    Also returns the share of each class (good documents first, then one kind of bad ones for each
    labeller) and the rates (class x labeller) of bad votes among all votes; that a labeller abstains says
    nothing.  Estimation starts from kinds that one labeller mostly sees and the others now and then.
    Rates are smoothed by a vote each way, and on good documents by ``LENIENT`` good votes to one bad.
    """
    k = len(LABELLERS)
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[c] for c in codes.tolist()], np.float64)
    votes = codes[:, None] // 3 ** np.arange(k) % 3
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    rates = np.vstack([np.full(k, 0.02), np.full((k, k), 0.1) + 0.6 * np.eye(k)])
    shares = start = np.r_[1 - 0.02 * k, np.full(k, 0.02)]
    bads, goods = np.ones((k + 1, 1)), np.ones((k + 1, 1))
    goods[0] = LENIENT
    posterior = np.zeros((len(codes), k + 1))
    for _ in range(rounds):
        log = bad @ np.log(rates).T + good @ np.log(1 - rates).T + np.log(shares)
        posterior = np.exp(log - log.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
        weight = posterior * n[:, None]
        before, rates = rates, (weight.T @ bad + bads) / (weight.T @ (bad + good) + bads + goods)
        shares = (weight.sum(0) + start) / (n.sum() + 1)
        if np.abs(rates - before).max() < 1e-9:
            break
    return dict(zip(codes.tolist(), posterior[:, 0].tolist())), shares, rates


class Model:
    """Posteriors of vote patterns, and the weights and bias of the scorer they trained."""

    def __init__(self, posterior: dict[int, float], weights: np.ndarray, bias: float, buckets: int):
        self.posterior, self.weights, self.bias, self.buckets = posterior, weights, bias, buckets

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, ids, x = features(texts, self.buckets)
        return sigmoid(self.bias + np.bincount(row, self.weights[ids] * x, len(texts)))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model:
    """Vote on every document, estimate the label model, train the scorer on a bounded sample."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.concatenate([vote_codes(part.column(0)) for part in _chunks(batch, 0)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], ["votes"])

    counts = rows.select("text").mapInArrow(vote, "votes int").groupBy("votes").count().collect()
    posterior, _, _ = label_model({r["votes"]: r["count"] for r in counts})
    total = sum(r["count"] for r in counts)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 0):
                texts = part.column(0)
                row, ids, x = features(texts, buckets)
                off = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                target = [posterior[c] for c in vote_codes(texts).tolist()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(pa.array(off), pa.array(x.astype(np.float32))), pa.array(target, pa.float64())], ["ids", "x", "target"])

    some = bounded_sample(rows, total, sample_rows)
    return Model(posterior, *train_linear(some.mapInArrow(sampled, "ids array<int>, x array<float>, target double"), buckets + 2), buckets)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE, **options) -> DataFrame:
    """One row per document: ``doc_id, votes, posterior, score, kept``.

    ``votes`` is the pattern's number, ``posterior`` the label model's probability of good and
    ``score`` the scorer's.
    """
    model = fit(docs, doc_id, text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                s = model.scores(part.column(1))
                codes = vote_codes(part.column(1)).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.int32()), pa.array([model.posterior[c] for c in codes], pa.float64()), pa.array(s), pa.array(s >= min_score)], ["doc_id", "votes", "posterior", "score", "kept"])

    return rows.mapInArrow(score, f"doc_id {kind}, votes int, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE, **options) -> DataFrame:
    """The documents that are kept, with all their columns and without a join."""
    model = fit(docs, doc_id, text, **options)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, at):
                yield part.filter(pa.array(model.scores(part.column(at)) >= min_score))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
