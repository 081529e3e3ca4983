"""License scans: phrases, and an exact set-similarity join of text blocks with notices.

A text's words are cut into overlapping blocks (``BLOCK`` words, a new one every ``STRIDE``), so
that any passage of up to STRIDE words lies whole in some block.  A block matches a template if it
contains at least ``threshold`` of the template's distinct words.  The join that finds all such
pairs is exact and never compares a block with every template:

* template words are ordered by how many documents contain them, rarest first (one pass over the
  corpus counts them; the vocabulary is that of the templates, so its size is fixed);
* with o = ceil(threshold * size), a match must share one of the template's first size - o + 1
  words (prefix filter); documents without any such word are skipped, whole;
* a block needs at least o words of the vocabulary (length filter), and at the shared word's places
  in both orders enough words must remain to reach o (positional filter);
* what passes is verified by intersecting the two sets.

Everything is built from DataFrame functions.  Defined cases: a null text is empty (no words, no
labels, score 0, first_word and last_word null); a null or repeated id is a row like others, and equal
texts are scored alike; of equally rare template words the alphabet decides, which changes no result; texts
of any length are read whole, block by block; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, after A-Z has been lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of well-known public licenses, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
BLOCK, STRIDE = 64, 32
THRESHOLD = 0.8


def normal_words(text: Column | str) -> Column:
    """The words of a text in order, joined by single blanks ('' if there are none)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def _words(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by number of rows of ``words`` (an array column) that contain it, rarest first.

    Only counts of vocabulary words reach the driver; the vocabulary is the templates'.
    """
    counts = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("w")).groupBy("w").count().collect()
    seen = {r["w"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def match_blocks(rows: DataFrame, keys: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keys, block, template, containment`` for every block and template that match.

    ``rows`` has the keys and ``normal``, the words joined by blanks.
    """
    spark = rows.sparkSession
    sets = {name: sorted(set(text.split())) for name, text in templates}
    vocabulary = sorted(set().union(*sets.values()))
    arrays = rows.select(*keys, _words(F.col("normal")).alias("words"))
    order = {w: i for i, w in enumerate(word_order(arrays.select("words"), vocabulary))}
    index = []
    for name, words in sets.items():
        ranked = sorted(words, key=order.__getitem__)
        need = _needed(len(ranked), threshold)
        index += [(w, i, name, len(ranked), need, ranked) for i, w in enumerate(ranked[: len(ranked) - need + 1])]
    rare = sorted({entry[0] for entry in index})
    ordered = _strings(sorted(order, key=order.__getitem__))
    some = arrays.where(F.arrays_overlap("words", _strings(rare)))
    starts = F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {STRIDE}").cast("int"))
    blocks = some.select(*keys, F.posexplode(F.transform(starts, lambda b: F.array_intersect(ordered, F.slice("words", b * STRIDE + 1, BLOCK)))).alias("block", "tokens"))
    tokens = blocks.where(F.arrays_overlap("tokens", _strings(rare))).select("*", F.posexplode("tokens").alias("j", "word"))
    prefixes = spark.createDataFrame(index, "word string, i int, template string, size int, need int, template_words array<string>")
    n = F.size("tokens")
    hits = tokens.join(F.broadcast(prefixes), "word").where((n >= F.col("need")) & (F.least(F.col("size") - F.col("i"), n - F.col("j")) >= F.col("need")))
    common = F.size(F.array_intersect("tokens", "template_words"))
    return hits.where(common >= F.col("need")).select(*keys, "block", "template", (common / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places where a phrase's words stand consecutively; ``first_word`` and
    ``last_word`` are the smallest and largest start among them.  ``labels`` adds the templates
    that match a block; ``score`` is the best containment, 1 where a phrase stands.  A phrase of several
    words must not overlap itself (such as "a b a"), since its places are counted one after the other.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), normal_words(text).alias("normal"))
    words = F.when(F.col("normal") == "", 0).otherwise(F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit(""))) + 1)
    edge = {p: rf"(?<![^ ]){p}(?![^ ])" for p in phrases}
    anything = rf"(?<![^ ])(?:{'|'.join(phrases)})(?![^ ])"
    places = {p: F.size(F.regexp_extract_all("normal", F.lit(e), F.lit(0))) for p, e in edge.items()}
    found = F.col("normal").rlike(anything)
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    base = rows.select(
        "doc_id",
        "text_key",
        words.cast("long").alias("n_words"),
        F.when(found, sum(places.values(), F.lit(0))).otherwise(0).cast("long").alias("n_base"),
        F.when(found, blanks(F.regexp_extract("normal", rf"(?s)^(.*?){anything}", 1))).cast("long").alias("first_word"),
        F.when(found, blanks(F.regexp_extract("normal", rf"(?s)^(.*){anything}", 1))).cast("long").alias("last_word"),
        F.when(found, F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col("normal").rlike(edge[p]), F.lit(label)) for p, label in phrases.items()])))))
        .otherwise(F.array().cast("array<string>"))
        .alias("base"),
    )
    keys = ["doc_id", "text_key"]
    matches = match_blocks(rows, keys, templates, threshold).groupBy(*keys).agg(F.collect_set("template").alias("more"), F.max("containment").alias("best"))
    matches = matches.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "more", "best")
    joined = base.join(matches, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The same by brute force: every block against every template.
SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda w: w <> '') AS w FROM documents),
phrase(p, label) AS (VALUES {", ".join(f"({_sql_list(p.split())}, '{label}')" for p, label in PHRASES.items())}),
template(t, label) AS (VALUES {", ".join(f"({_sql_list(sorted(set(t.split())))}, '{label}')" for label, t in TEMPLATES)}),
r AS (SELECT row_number() OVER () AS k, doc_id, w FROM d),
place AS (
  SELECT k, label, unnest(list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + len(p) - 1) = p)) AS i FROM r, phrase WHERE list_has_all(w, p)),
base AS (SELECT k, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list_distinct(list(label))) AS labels FROM place GROUP BY k),
block AS (SELECT k, list_distinct(list_slice(w, b * {STRIDE} + 1, b * {STRIDE} + {BLOCK})) AS s FROM (SELECT k, w, unnest(range(0, (len(w) - 1) // {STRIDE} + 1)) AS b FROM r WHERE len(w) > 0)),
hit AS (SELECT k, label, len(list_intersect(s, t)) / len(t) AS c FROM block, template WHERE len(list_intersect(s, t)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
more AS (SELECT k, list(DISTINCT label) AS labels, max(c) AS best FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM r LEFT JOIN base USING (k) LEFT JOIN more USING (k)
"""
