"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with a list.

The longest rule that fits a url gives its verdict.  Where none fits, the url is blocked if its
canonical form is on a list:

* the list is brought to canonical form, once each, and counted, which sets the filter's size;
* the filter is a table of blocks of 8 words of 32 bits; an entry's hash picks the block and one bit
  in each word, so that grouping by block with ``bit_or`` builds it and one row answers a question;
* urls meet the filter by block and only those with all 8 bits set go on to an exact hash join with the
  list, which removes false positives; the others skip that join and its shuffle.

At 16 bits an entry about 1 in 1,000 unlisted urls goes on.  The filter is broadcast up to
``BROADCAST_BLOCKS`` (list entries beyond 16 million) and joined by a shuffle from there on; the exact
join is broadcast only where Spark finds the list below its threshold.  A url that fills a third of the
table is no hot key before the exact join, where Spark splits the larger side of a skewed join.

Canonical form: scheme, user, default port, a final dot and a leading www. or m. of the host go; repeated
slashes of the path count once and final ones go; parameters are sorted, tracking ones and the fragment go.

Everything is built from DataFrame functions.  Defined cases: a null url, or one without ``://``, has an empty
host and path, fits no rule, has no canonical form and is allowed; empty and null list entries list nothing;
null or repeated page ids are rows like others; urls of any length are read whole; other columns are not
read; an empty table gives no rows and an empty list blocks nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import table, written
from duskwatch.llm.licenses import LOWER, UPPER

#: Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of hosts whose pages the query lists.
LISTED_HOSTS = r"(^|[.-])(spam|pills|casino|bets|ads|adult)([.-]|$)"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
HOST_EDGES = (r"(?s)^.*@", r":(80|443)$", r"\.$", r"^(www|m)\.")
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
WORDS, BLOCK_BITS, BITS_PER_ENTRY = 8, 256, 16
BROADCAST_BLOCKS = 1 << 20


def split_url(url: Column | str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both '' for null and where ``://`` is missing."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def canonical(url: Column | str) -> Column:
    """Canonical form of a url, null for null and where ``://`` is missing."""
    host, path = split_url(url)
    for edge in HOST_EDGES:
        host = F.regexp_replace(host, edge, "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    parameters = F.filter(F.split(F.regexp_extract(url, URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(parameters), "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, query))


def verdict_of_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together, then host), as text, and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks))


def _bits(entry: Column) -> list[Column]:
    """An entry's bit in each word of its block: 5 bits of a second hash for each."""
    h = F.xxhash64(entry, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(WORDS)]


def blocks_for(entries: int) -> int:
    return max(1, math.ceil(entries * BITS_PER_ENTRY / BLOCK_BITS))


def bloom_filter(listed: DataFrame, entry: str, blocks: int) -> DataFrame:
    """``block, w0 .. w7``: a row for each block that some entry sets bits in."""
    keyed = listed.select(_block(F.col(entry), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col(entry)))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def with_possible(rows: DataFrame, entry: str, bloom: DataFrame, blocks: int, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Adds ``possible``: false only where ``entry`` is certainly not in the filter (or null)."""
    side = bloom.select(F.col("block").alias("_block"), *[F.col(f"w{k}").alias(f"_w{k}") for k in range(WORDS)])
    side = F.broadcast(side) if blocks <= broadcast_blocks else side.hint("merge")
    met = rows.join(side, F.when(F.col(entry).isNotNull(), _block(F.col(entry), blocks)) == F.col("_block"), "left")
    hit = F.lit(True)
    for k, bit in enumerate(_bits(F.col(entry))):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(bit) == bit)
    return met.withColumn("possible", F.coalesce(hit & F.col(entry).isNotNull(), F.lit(False))).drop("_block", *[f"_w{k}" for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", listed_url: str = "url", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, canonical, possible, listed``.

    ``listed`` holds urls (``listed_url``) of any form; ``possible`` tells what the filter let pass and
    ``listed`` what the exact join confirmed.
    """
    entries = written(listed.select(canonical(listed_url).alias("entry")).where("entry is not null").distinct(), "listed")
    blocks = blocks_for(entries.count())
    host, path = split_url(url)
    rule, says = verdict_of_rules(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), canonical(url).alias("canonical"))
    rows = with_possible(rows.withColumns({"rule": rule, "_says": says}), "canonical", bloom_filter(entries, "entry", blocks), blocks, broadcast_blocks)
    passed = rows.where("possible").join(entries.hint("shuffle_hash") if blocks > broadcast_blocks else entries, F.col("canonical") == F.col("entry"), "left")
    judged = passed.withColumn("listed", F.col("entry").isNotNull()).drop("entry").unionByName(rows.where("not possible").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("_says", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "possible", "listed")


def listed_pages(pages: DataFrame, hosts: str = LISTED_HOSTS) -> DataFrame:
    """``url`` of the pages whose host has one of the listed words."""
    return pages.where(split_url("url")[0].rlike(hosts)).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_pages(pages)).drop("possible")


def _canonical_sql() -> str:
    host = "host"
    for edge in HOST_EDGES:
        host = f"regexp_replace({host}, '{edge}', '')"
    path = "regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract(url, '{URL}', 3), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')))"
    return f"CASE WHEN contains(url, '://') THEN {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


#: The same without a filter: every url against every rule and the whole list.
SQL = f"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, row_number() OVER () AS k FROM pages),
r(says, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
c AS (SELECT *, {_canonical_sql()} AS canonical FROM u),
fit AS (SELECT k, max_by(says, length(h || p)) AS says, max_by(h || p, length(h || p)) AS rule FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
l AS (SELECT DISTINCT canonical AS entry FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}') AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical, entry IS NOT NULL AS listed
FROM c LEFT JOIN fit USING (k) LEFT JOIN l ON canonical = entry
"""
