import re

import pytest
from pyspark.sql import functions as F

from clustervitals.llm import queries, urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://WWW.Example.COM/en/1", "http://a.example.com/en/2?x=1#y", "https://a.b.net/es/#a?b",
    "http://xnet/es/", "net://net/fr/3", "http://net", "http://a.com", "http://a.com?q=/", "HTTP://ÄB.com/é x\n/y", "a://b://c/d",
    "http://example.com/english/", "http://wwwexample.com/en/1", "http://example.org/en/5.html?page=2&ref=x",
]


def test_parts_and_given_rules(spark):
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(URLS + URLS)], "page_id int, url string, host string")
    got = urls.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for row in got:
        host, path = plain_parts(URLS[row.page_id % len(URLS)])
        rule, verdict = plain_rule(host, path, queries.URL_RULES)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or row.verdict) and row.verdict in ("allow", "block")


def test_mined_rules_equal_counts(spark):
    labelled = [(f"http://h{k % 3}.org/{'bad' if k % 4 == 0 else 'fine'}/{k}?x=1", "block" if k % 4 == 0 else "allow") for k in range(80)]
    labelled += [("http://h0.org/bad/1", "allow")]
    labels = spark.createDataFrame(labelled, "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://new.org/bad/7"), (2, "http://new.org/fine/7"), (3, "ftp://x"), (4, None)], "page_id int, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, [], labels=labels).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    assert got[1].confidence == pytest.approx(20 / 21) and got[2].confidence == 1
    assert "path:bad" in got[1].mined_rule and got[3].mined_rule is None
    url = F.col("url")
    tokens = labels.select(urls.tokens_of(url, urls.host_of(url), urls.path_of(url)).alias("t"), "verdict")
    plain = [(set(r.t), r.verdict) for r in tokens.collect()]
    rules = urls.mine_rules(tokens, "t", "verdict").collect()
    assert rules
    for r in rules:
        held = [v for t, v in plain if t >= set(r.antecedent)]
        assert r.confidence == pytest.approx(held.count(r.verdict) / len(held)) and r.confidence >= urls.MIN_CONFIDENCE
        assert r.support == pytest.approx(held.count(r.verdict) / len(plain))
        assert sum(r.key in t for t, _ in plain) == min(sum(x in t for t, _ in plain) for x in r.antecedent)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id int, url string")
    assert urls.judge_urls(empty, queries.URL_RULES).collect() == []


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in queries.table(spark, sf_dir, "pages").collect()}
    got = queries.QUERIES["op3_url_rules"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = plain_parts(pages[r.page_id])
        rule, verdict = plain_rule(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
