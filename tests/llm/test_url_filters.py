"""URL filters: given pages in SQL, hand-made urls, and the filter's promises."""

import pytest

from duskwatch.llm import url_filters as uf
from tests.llm.oracle import connect, same

URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.COM/en/x", "https://www.example.com/en/x", "https://a.www.example.com/en/", "http://notexample.com/en/", "http://example.com", "http://example.com?x=/en/", "http://b.net/es/1", "http://b.net/ES/1", "net/es/",
    "http://b.net/fr/2?u=http://example.com/en/", "x://y://z.net/fr/", "http://spam-farm.example.org/en/1?utm_source=feed", "https://www.spam-farm.example.org//en//1/#top", "http://m.spam-farm.example.org/en/1?b=2&a=1", "http://user@spam-farm.example.org:80/en/1?a=1&b=2&ref=x",
    "http://spam-farm.example.org/en/1?a=1&b=3", "http://ÀB.example.org/É", "http://h.org/" + "ab/" * 200_000, "http://é.net/fr/\nline?q#f", "http://adult.net", "http://madult.net",
]


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(i, u, "h", "x", True, "w") for i, u in rows], "page_id long, url string, host string, rule string, listed boolean, entry string")


def test_given_pages_agree_with_sql(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert same(uf.judge(pages, uf.listed_pages(pages)).drop("possible"), connect(pages=pages), uf.SQL) == 50


@pytest.mark.parametrize("broadcast_blocks", [uf.BROADCAST_BLOCKS, 0])
def test_made_up_urls_agree_with_sql(pages_of, broadcast_blocks):
    pages = pages_of([*enumerate(URLS), (None, "http://b.net/es/"), (3, "http://b.net/es/"), (3, "http://b.net/es/")])
    out = uf.judge(pages, uf.listed_pages(pages), broadcast_blocks=broadcast_blocks)
    assert same(out.drop("possible"), connect(pages=pages), uf.SQL) == len(URLS) + 3
    assert out.where("listed and not possible").count() == 0


def test_worked_examples(pages_of):
    out = {r["page_id"]: r for r in uf.judge(pages_of(enumerate(URLS)), pages_of([(0, URLS[15]), (0, URLS[18]), (0, None), (0, "")])).collect()}
    rules = {i: (out[i]["rule"], out[i]["verdict"]) for i in out}
    assert rules[4] == ("example.com/en/", "block") and rules[5] == rules[6] == ("www.example.com/en/", "allow") and rules[7] == ("com/", "allow")
    assert rules[8] == rules[9] == rules[0] == rules[12] == (None, "allow")
    assert rules[10] == ("net/es/", "block") and rules[11] == (None, "allow") and rules[13] == ("net/fr/", "block") and out[14]["host"] == "y:"
    assert [out[i]["verdict"] for i in range(15, 20)] == ["block", "block", "block", "block", "allow"]
    assert out[15]["canonical"] == "spam-farm.example.org/en/1" and out[17]["canonical"] == out[18]["canonical"] == "spam-farm.example.org/en/1?a=1&b=2"


def test_longest_rule_wins_whatever_the_order(pages_of):
    rules = (("block", "a.b", "/"), ("allow", "b", "/x/"), ("block", "b", "/x/y/"))
    urls = [(0, "s://a.b/x/"), (1, "s://b/x/y/"), (2, "s://a.b/x/y/"), (3, "s://c/")]
    for given in (rules, rules[::-1]):
        got = {r["page_id"]: r["rule"] for r in uf.judge(pages_of(urls), pages_of([]), given).collect()}
        assert got == {0: "a.b/", 1: "b/x/y/", 2: "b/x/y/", 3: None}


def test_the_filter_loses_nothing_and_passes_few(spark):
    listed = spark.range(20_000).selectExpr("concat('l', id) as e")
    others = spark.range(50_000).selectExpr("concat('o', id) as e")
    blocks = uf.blocks_for(20_000)
    bloom = uf.bloom_filter(listed, "e", blocks)
    assert uf.with_possible(listed, "e", bloom, blocks).where("not possible").count() == 0
    assert uf.with_possible(others, "e", bloom, blocks).where("possible").count() < 250


def test_one_hot_url_and_empty_tables(spark, pages_of):
    hot = spark.range(3000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://www.hot.org/', concat('http://h.org/', id)) as url")
    assert uf.judge(hot, pages_of([(0, "https://hot.org")]), broadcast_blocks=0).where("verdict = 'block'").count() == 1000
    assert uf.judge(pages_of([]), pages_of([])).count() == 0
    assert uf.judge(hot, pages_of([])).where("possible or verdict = 'block'").count() == 0
