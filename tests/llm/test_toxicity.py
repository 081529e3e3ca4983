"""Toxicity: held-out accuracy, folds, the label model on drawn votes, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from duskwatch.llm import toxicity as x
from duskwatch.llm.common import written


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = written(x.query(spark, d), "toxic").join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.96
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.01 * len(rows)


def lexicons(**words):
    """Lexicons of given entries, each as the operator would hash it."""
    kind, term = [], []
    for name, entries in words.items():
        k = getattr(x, name.upper())
        for e in entries:
            w = x.Words(pa.array([e]), x.LETTERS)
            h = {x.WORD: lambda: w.hashes(), x.STEM: lambda: w.hashes(len(e.encode())), x.MEANT: lambda: w.meant(), x.PAIR: lambda: w.pairs()[1]}[k]()
            kind.append(k)
            term.append(h[0])
    return x.Lexicons(np.array(kind), np.array(term, np.uint64))


LEXICON = {"word": ["scum"], "stem": ["worth"], "meant": ["idiot"], "pair": ["go away"]}


def meant(word):
    word = "".join(dict(zip("013457", "oieast")).get(c, c) for c in word.lower())
    return "".join(c for c, before in zip(word, [None, *word]) if c != before)


def plain_votes(text):
    """The voters in plain Python."""
    text = text or ""
    found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w, _, _ in found]
    entry = {i: [] for i in range(len(words))}
    for i, w in enumerate(words):
        entry[i] += ["word"] * (w in LEXICON["word"]) + ["stem"] * any(len(w.encode()) >= p and w.startswith(e) for p in (5,) for e in LEXICON["stem"]) + ["meant"] * (meant(w) in LEXICON["meant"])
        if i + 1 < len(words) and f"{w} {words[i + 1]}" in LEXICON["pair"]:
            entry[i].append("pair")
    named = [i for i, w in enumerate(words) if set(entry[i]) - {"pair"} or w in x.INSULTS]
    all_entries = [e for own in entry.values() for e in own]  # one entry of each kind
    all_named = [words[i] for i in named]
    ups, downs = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    vote = {k: k in all_entries for k in ("word", "stem", "meant", "pair")}
    vote["insult"] = any(w in x.INSULTS for w in words)
    vote["stretched"] = re.search(r"(?i)([a-z])\1\1", text) is not None
    gaps = [(len(found[i][0].encode()), len(found[i + 1][0].encode()), text[found[i][2] : found[i + 1][1]]) for i in range(len(found) - 1)]
    joint = [a == b == 1 and g in (".", "-", "_", "*") for a, b, g in gaps]
    vote["spelled out"] = any(p and q for p, q in zip(joint, joint[1:]))
    vote["masked"] = any(g in ("*", "**", "***") for _, _, g in gaps)
    vote["shouted"] = 2 * ups < downs and any(re.fullmatch("[A-Z]{4,}", w) for w, _, _ in found)
    vote["addressed"] = any(w in x.SECOND_PERSON for i in named for w in words[max(0, i - 3) : i + 4])
    vote["exclaimed"] = any(text[found[i][2] : found[i][2] + 1] == "!" for i in named)
    vote["several"], vote["repeated"] = len(set(all_named)) >= 2, len(all_named) > len(set(all_named))
    return vote


def test_voters_agree_with_plain_python():
    rng = random.Random(2)
    pool = ["scum", "Scum!", "worthless", "worth", "wort", "1d1000t", "idiOOT", "go away", "go", "away", "you", "Vous", "s.c.u.m", "a-b-c", "a.b", "f**k", "f****k", "x*y", "LOUD", "HEY", "sooo", "so", "plain", "words", "of", "no", "harm", "É", "naïve", "moron!", "12", "¡tú!"]
    texts = [None, "", " "] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = x.votes(pa.array(texts), lexicons(**LEXICON))
    seen = Counter()
    for code, text in zip(got.tolist(), texts):
        want = plain_votes(text)
        assert {v: bool(code >> i & 1) for i, v in enumerate(x.VOTERS)} == want, text
        seen.update(v for v, yes in want.items() if yes)
    assert set(seen) == set(x.VOTERS)


def test_terms_and_hits_agree_with_plain_python():
    texts = ["Scum, scum! scummy", None, "", "ab", "naïve naïve 1d1oot", "one two one two"]
    row, kind, term = x.terms(pa.array(texts))
    got = Counter(zip(row.tolist(), kind.tolist()))
    known = np.sort(np.unique(term[(kind == x.WORD) | (kind == x.STEM)]))
    found = Counter(x.hits(pa.array(texts), known)[0].tolist())
    for r, text in enumerate(texts):
        words = [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\uffff]+", text or "")]
        stems = {(p, w.encode()[:p]) for w in words for p in x.PREFIXES if len(w.encode()) >= p}
        want = [len(set(words)), len(stems), len({meant(w) for w in words}), len(set(zip(words, words[1:])))]
        assert [got[r, k] for k in x.KINDS] == want, text
        assert found[r] == want[0] + want[1]


def test_the_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(3000)] + [(i, "same") for i in range(6, 500)] + [(6, "same")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    assert x._labelled(docs, labels, 20).count() < 160
    assert x._labelled(docs.where("doc_id > 5"), labels, 10**6).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(6, 500))


def test_label_model_finds_classes_and_correlated_voters():
    rng = np.random.default_rng(5)
    toxic = rng.random(20_000) < 0.1
    vote = rng.random((20_000, len(x.VOTERS))) < np.where(toxic[:, None], 0.6, 0.02)
    vote[:, 1] = vote[:, 0]
    codes = vote @ (1 << np.arange(len(x.VOTERS)))
    count = dict(zip(*(a.tolist() for a in np.unique(codes, return_counts=True))))
    seen = {}
    for c, t in zip(codes[:300].tolist(), toxic[:300]):
        a, b = seen.get(c, (0.0, 0.0))
        seen[c] = (a + (not t), b + t)
    posterior, model = x.label_model(count, seen)
    assert np.mean([(posterior[c] > 0.5) == t for c, t in zip(codes.tolist(), toxic)]) > 0.99
    assert abs(model["share"] - 0.1) < 0.01 and abs(model["rates"][1][3] - 0.6) < 0.05
    assert max(model["weight"][:2]) < min(model["weight"][2:])


def test_nulls_no_labels_and_empty_tables(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert x.score_toxicity(docs_of([]), labels).count() == 0
    rows = x.score_toxicity(docs_of([(1, None), (None, "a"), (2, "b"), (2, "b")]), labels).collect()
    assert len(rows) == 4 and {r["predicted"] for r in rows} == {0} and not any(r["held_out"] for r in rows if r["doc_id"] is None)
