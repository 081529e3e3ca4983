"""Toxicity by weak supervision.

1. Lexicons.  On labelled training documents (bounded: about ``LABELLED_ROWS`` of each label, by hash of
   the id), four kinds of terms are counted by document: words, word beginnings of 4, 5 and 6 bytes,
   words as they are meant (``1d1oooot`` is ``idiot``) and pairs of neighbours.  Of each kind, those that
   are frequent in toxic and rare in other documents become a lexicon.
2. Voters (``VOTERS``).  Five lexicon voters: one for each kind, and one with a fixed list of insults.
   Eight pattern voters read the text itself: stretched letters, words spelled out with separators, words
   with letters masked, words shouted amid small letters, a lexicon's word near a second-person word, a
   lexicon's word before an exclamation mark, several different words of lexicons, one of them repeated.  Each votes
   toxic or not on every whole text.
3. Label model.  All documents are counted by vote pattern (at most 2^13).  Expectation-
   maximisation over these counts estimates each voter's accuracy on either class, starting from
   the training documents' rates, and the voters' correlations within a class; voters that repeat
   each other share their weight: a vote counts 1 / (1 + the sum of its positive correlations).
4. Classifier.  The posterior of a document's pattern is its label for fitting a logistic
   regression on the presence of ``FEATURES`` words and word beginnings, from a sample of about
   ``SAMPLE_ROWS`` training documents.  Its features are exact 64-bit hashes, so a long text does
   not collide its way to a score.

Labels are read for training documents only: those with crc32(doc_id as text) mod 5 <> 0.  Nothing
but the text enters a score.  Defined cases: null and empty texts have no words and get the
classifier's bias; very long texts are read whole; null ids are never training documents, are not held
out, and rows with them are scored like others; of several labels of one id the largest counts; equal
rows are learned from once; terms of equal counts go by their hash; extra columns are not read; without
toxic labels there is no learned lexicon and every score is near 0; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import table, written
from duskwatch.llm.hashed_words import LETTERS, Words, bounded_sample, sigmoid, train_linear
from duskwatch.llm.near_dup import _chunks

LABELLED_ROWS, SAMPLE_ROWS = 4_000, 10_000
LEXICON, FEATURES = 100, 2_000
WORD, STEM, MEANT, PAIR = KINDS = range(4)
PREFIXES = (4, 5, 6)
VOTERS = ("word", "stem", "meant", "pair", "insult", "stretched", "spelled out", "masked", "shouted", "addressed", "exclaimed", "several", "repeated")
#: Common insults and words that address the reader, in four languages; fixed values.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "scum", "imbecile", "worthless", "pathetic", "idiota", "estúpido", "imbécil", "dummkopf", "trottel", "abschaum", "versager", "crétin", "connard", "débile", "minable")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "vous", "votre", "ton", "tú", "usted", "vosotros", "ti")
NEAR = 3
#: A lexicon has at most LEXICON entries of its kind; an entry is in at least this share of toxic training documents, and that many
#: times as frequent (smoothed) in them as in others.
LEAST_SHARE, LEAST_DOCS, LEAST_LIFT = 0.01, 8.0, 30.0
_U = np.uint64


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 5 (null for null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 5


def _kinds(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each kind of terms: its number, the words that begin one, and the terms' hashes."""
    every = np.arange(len(w))
    yield WORD, every, w.hashes()
    for prefix in PREFIXES:
        some = np.flatnonzero(w.lengths() >= prefix)
        yield STEM, some, w.hashes(prefix)[some]
    yield MEANT, every, w.meant()
    yield PAIR, *w.pairs()


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind and hash of every distinct term of each text."""
    w = Words(texts, LETTERS)
    rows = w.rows()
    row, kind, term = (np.concatenate(x) for x in zip(*[(rows[at], np.full(len(at), k), h) for k, at, h in _kinds(w)]))
    order = np.lexsort((term, kind, row))
    row, kind, term = row[order], kind[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (term[1:] != term[:-1])
    return row[new], kind[new], term[new]


def _places(known: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are known, and their places in ``known`` (ascending)."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, term), len(known) - 1)
    found = np.flatnonzero(known[at] == term)
    return found, at[found]


def hits(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in ``known`` (ascending hashes) of the distinct known words and word beginnings of each text."""
    w = Words(texts, LETTERS)
    rows, keys = w.rows(), [np.zeros(0, np.int64)]
    for kind, at, h in _kinds(w):
        if kind in (WORD, STEM):
            found, place = _places(known, h)
            keys.append(rows[at[found]] * max(len(known), 1) + place)
    key = np.unique(np.concatenate(keys))
    return key // max(len(known), 1), key % max(len(known), 1)


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, toxic`` of about ``rows`` training documents of each label, by a hash of the id; equal rows once."""
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0))
    train = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    span = 1 << 31
    limit = reduce(lambda c, k: c.when(F.col("toxic") == k, int(span * min(1.0, rows / counts[k]))), counts, F.when(F.lit(False), 0))
    some = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < limit)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("key", F.xxhash64("doc_id", "text")).dropDuplicates(["key"])
    # An id that many different texts share could still bring any number of rows.
    found = written(found.select("text", "toxic", "key"), "labelled")
    n = found.count()
    return found.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(span)) < int(span * min(1.0, 4 * rows / max(n, 1)))).select("text", "toxic")


def _term_counts(marked: DataFrame, target: str, kinds: tuple[int, ...]) -> DataFrame:
    """``kind, term, toxic, clean``: weight of documents with each term, from ``text`` and a target in 0..1."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 0):
                row, kind, term = terms(part.column(0))
                some = np.isin(kind, kinds)
                row, kind, term = row[some], kind[some], term[some]
                y = np.asarray(part.column(1), np.float64)[row]
                order = np.lexsort((term, kind))
                new = np.ones(len(order), bool)
                new[1:] = (term[order][1:] != term[order][:-1]) | (kind[order][1:] != kind[order][:-1])
                group, first = np.cumsum(new) - 1, order[new]
                toxic, clean = (np.bincount(group, v[order], len(first)) for v in (y, 1 - y))
                yield pa.RecordBatch.from_arrays([pa.array(kind[first].astype(np.int32)), pa.array(term[first].view(np.int64)), pa.array(toxic), pa.array(clean)], ["kind", "term", "toxic", "clean"])

    counted = marked.select("text", F.col(target).cast("double").alias("y")).mapInArrow(split, "kind int, term long, toxic double, clean double")
    return counted.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Lexicons:
    """Known terms (hashes ascending) and the kind of each."""

    def __init__(self, kind: np.ndarray, term: np.ndarray):
        order = np.argsort(term)
        self.kind, self.term = kind[order], term[order]


def lexicons(labelled: DataFrame, size: int = LEXICON) -> Lexicons:
    """Of each kind of terms at most ``size`` that speak for a toxic document, the most frequent first."""
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = totals["n"], totals["t"] or 0
    if not t or t == n:
        return Lexicons(np.zeros(0, np.int64), np.zeros(0, np.uint64))
    lift = ((F.col("toxic") + 0.5) / (t + 1)) / ((F.col("clean") + 0.5) / (n - t + 1))
    best = _term_counts(labelled, "toxic", tuple(KINDS)).where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * t)) & (lift >= LEAST_LIFT))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("toxic"), "term"))
    rows = best.withColumn("rank", rank).where(F.col("rank") <= size).select("kind", "term").collect()
    return Lexicons(np.array([r["kind"] for r in rows], np.int64), np.array([r["term"] for r in rows], np.int64).view(np.uint64))


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(Words(pa.array(words), LETTERS).hashes())


def _after(w: Words) -> np.ndarray:
    """The byte after each word, and 0 at the end of the batch."""
    ends = w.starts + w.lengths()
    return np.r_[w.data, np.uint8(0)][ends]


def votes(texts: pa.Array, known: Lexicons) -> np.ndarray:
    """Vote pattern of each text, one bit for each of ``VOTERS`` (1: toxic)."""
    w = Words(texts, LETTERS)
    rows, size, n_rows = w.rows(), w.lengths(), len(texts)
    own = np.zeros((n_rows, len(VOTERS)), bool)
    vote = lambda name, words: own.__setitem__((rows[words], VOTERS.index(name)), True)
    named = np.zeros(len(w), bool)
    for kind, at, h in _kinds(w):
        found, place = _places(known.term, h)
        right = known.kind[place] == kind
        found = at[found[right]]
        vote(VOTERS[kind], found)
        if kind != PAIR:
            named[found] = True
    plain = w.hashes()
    insult, _ = _places(_hashes(INSULTS), plain)
    vote("insult", insult)
    named[insult] = True

    b, place = w._bytes, w._place
    lower = np.where((b >= 65) & (b < 91), b + 32, b)
    same = np.zeros(len(b), bool)
    same[2:] = (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2]) & (place[2:] >= 2) & (lower[2:] >= 97) & (lower[2:] < 123)
    vote("stretched", np.flatnonzero(w.any(same)))
    inner = rows[1:] == rows[:-1]
    gap = w.starts[1:] - (w.starts[:-1] + size[:-1])
    after = _after(w)
    joint = inner & (gap == 1) & np.isin(after[:-1], np.frombuffer(b".-_*", np.uint8)) & (size[1:] == 1) & (size[:-1] == 1)
    vote("spelled out", np.flatnonzero(joint[1:] & joint[:-1]))
    stars = np.cumsum(np.r_[0, w.data == 42])
    masked = inner & (gap <= 3) & (stars[w.starts[1:]] - stars[w.starts[:-1] + size[:-1]] == gap)
    vote("masked", np.flatnonzero(masked))
    upper, small = (b >= 65) & (b < 91), (b >= 97) & (b < 123)
    ups = np.add.reduceat(upper.astype(np.int64), w._first) if len(w) else np.zeros(0, np.int64)
    byte_row = np.repeat(rows, size)
    calm = 2 * np.bincount(byte_row[upper], minlength=n_rows) < np.bincount(byte_row[small], minlength=n_rows)
    vote("shouted", np.flatnonzero((ups == size) & (size >= 4) & calm[rows]))
    you = np.zeros(len(w) + 1, np.int64)
    you[1:][_places(_hashes(SECOND_PERSON), plain)[0]] = 1
    you = np.cumsum(you)
    at = np.flatnonzero(named)
    low, high = np.maximum(at - NEAR, w.off[rows[at]]), np.minimum(at + NEAR + 1, w.off[rows[at] + 1])
    vote("addressed", at[you[high] > you[low]])
    vote("exclaimed", at[after[at] == 33])
    # Words of a lexicon, each once, and how often each occurs.
    order = at[np.lexsort((plain[at], rows[at]))]
    new = np.ones(len(order), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (plain[order][1:] != plain[order][:-1])
    own[:, VOTERS.index("several")] = np.bincount(rows[order[new]], minlength=n_rows) >= 2
    vote("repeated", order[~new])
    return own @ (1 << np.arange(len(VOTERS)))


def label_model(patterns: dict[int, float], seen: dict[int, tuple[float, float]], rounds: int = 50) -> tuple[dict[int, float], dict]:
    """Posterior of toxic for each vote pattern, and the model.

    ``patterns`` counts all documents, ``seen`` training documents (clean, toxic); rates start from
    the latter.  The model has ``rates`` (class x voter), ``correlation`` (class x voter x voter),
    ``weight`` of each voter, and ``share`` of toxic documents.
    """
    codes = np.array(sorted(set(patterns) | set(seen)), np.int64)
    bits = (codes[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
    n = np.array([patterns.get(c, 0.0) for c in codes.tolist()])
    start = np.array([seen.get(c, (0.0, 0.0)) for c in codes.tolist()]).reshape(-1, 2).T
    share = (start[1].sum() + 0.5) / (start.sum() + 50)
    weight = np.ones(len(VOTERS))
    p = [start[0], start[1]]
    posterior = np.zeros(len(codes))
    for step in range(rounds):
        rates = np.array([(q @ bits + 0.1) / (q.sum() + 1) for q in p])
        correlation = []
        for q, r in zip(p, rates):
            both = (bits * q[:, None]).T @ bits / max(q.sum(), 1e-9) - np.outer(r, r)
            correlation.append(both / np.sqrt(np.outer(r * (1 - r), r * (1 - r))))
        shared = np.clip(np.mean(correlation, 0), 0, 1)
        np.fill_diagonal(shared, 0)
        weight = 1 / (1 + shared.sum(1))
        log = [bits @ (weight * np.log(r)) + (1 - bits) @ (weight * np.log(1 - r)) for r in rates]
        posterior = sigmoid(log[1] - log[0] + np.log(share / (1 - share)))
        p = [n * (1 - posterior) + start[0], n * posterior + start[1]]
        share = float(np.clip((n @ posterior + 0.5) / (n.sum() + 1), 1e-4, 1 - 1e-4))
    return dict(zip(codes.tolist(), posterior.tolist())), {"rates": rates, "correlation": np.array(correlation), "weight": weight, "share": share}


class Model:
    """The lexicons, posteriors of vote patterns, and the classifier; ``labels`` tells of the label model."""

    def __init__(self, posterior, prior, known, vocabulary, weights, bias, labels):
        self.posterior, self.prior, self.known = posterior, prior, known
        self.vocabulary, self.weights, self.bias, self.labels = vocabulary, weights, bias, labels

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, at = hits(texts, self.vocabulary)
        return sigmoid(self.bias + np.bincount(row, self.weights[at], len(texts)))

    def posteriors(self, texts: pa.Array) -> list[float]:
        return [self.posterior.get(c, self.prior) for c in votes(texts, self.known).tolist()]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled_rows: int = LABELLED_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Build lexicons, estimate the label model, fit the classifier."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    labelled = _labelled(rows, labels.select("doc_id", "toxic"), labelled_rows)
    known = lexicons(labelled)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 0):
                codes = votes(part.column(0), known)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), *part.columns[1:]], ["code", *part.schema.names[1:]])

    counts = {r["code"]: float(r["count"]) for r in rows.select("text").mapInArrow(vote, "code int").groupBy("code").count().collect()}
    seen = {r["code"]: (float(r["c"]), float(r["t"])) for r in labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(vote, "code int, toxic int").groupBy("code").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).collect()}
    posterior, about = label_model(counts, seen)
    prior = posterior.get(0, 0.0)

    def weakly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 0):
                target = [posterior.get(c, prior) for c in votes(part.column(0), known).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(target, pa.float64())], ["text", "target"])

    sample = bounded_sample(rows.where(fold("doc_id") != 0), int(sum(counts.values()) * 0.8), sample_rows)
    weak = written(sample.mapInArrow(weakly, "text string, target double"), "weak")
    gain = F.col("toxic") - F.col("clean") * prior
    chosen = _term_counts(weak, "target", (WORD, STEM)).where("toxic >= 2").orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1)), F.desc(gain), "term").limit(FEATURES)
    vocabulary = np.sort(np.array([r["term"] for r in chosen.collect()], np.int64).view(np.uint64))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 0):
                row, at = hits(part.column(0), vocabulary)
                off = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(off, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(np.ones(len(at), np.float32))), part.column(1)], ["ids", "x", "target"])

    weights, bias = train_linear(weak.mapInArrow(featured, "ids array<int>, x array<float>, target double"), max(1, len(vocabulary)), parts=1, rounds=300, decay=2e-5)
    return Model(posterior, prior, known, vocabulary, weights, bias, about)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, weak_posterior``."""
    model = fit(docs, labels, doc_id, text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                texts = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(texts)), pa.array(model.posteriors(texts), pa.float64())], ["doc_id", "score", "weak_posterior"])

    scored = rows.mapInArrow(score, f"doc_id {kind}, score double, weak_posterior double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "weak_posterior")


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = 0.5, **options) -> DataFrame:
    """The documents scored below the limit, with all their columns and without a join."""
    model = fit(docs, labels, doc_id, text, **options)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, at):
                yield part.filter(pa.array(model.scores(part.column(at)) < limit))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
