"""URL filters against a plain Python reading."""

import random
import re

from textmill.llm.queries import QUERIES, URL_RULES
from textmill.llm.url_filter import alias_key, judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(url, rules):
    host, path = split(url)
    fit = [(-len(h + p), v != "allow", h + p, v) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit)[2:] if fit else (None, None)


def judged(spark, rows, rules):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {x.page_id: x for x in judge_urls(df.repartition(3), r).collect()}


def test_rules_equal_python(spark):
    r = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "a.b.net", "net", "xnet", "EXAMPLE.com", "example.com.", "", "münchen.net", "a..net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/9", "/es/?q=/en/", "?x=http://net/es/", "#top", "/EN/", "//en/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "", "://", "a://b://") for h in hosts for p in paths]
    rows = [(i, u, None) for i, u in enumerate([None, "", *urls, *r.sample(urls, 50)])]
    got = judged(spark, rows, URL_RULES)
    assert len(got) == len(rows)
    for i, u, _ in rows:
        rule, verdict = rule_of(u, URL_RULES)
        assert (got[i].host, got[i].path) == split(u), u
        assert (got[i].rule, got[i].verdict) == (rule, verdict or "allow"), u


def test_blocks_reach_aliases(spark):
    def link(u):
        return f'<head><link rel="canonical" href="{u}"></head>'

    rows = [
        (1, "http://a.org/1", link("http://bad.net/es/1")),            # alias of a blocked url that is no page
        (2, "https://b.org/2", "<meta http-equiv='refresh' content='0; url=http://a.org/1'>"),
        (3, "http://b.org/2?utm_source=feed#top", None),                # same page as 2
        (4, "http://x.com/ok", link("http://a.org/1")),                 # allowed by a rule
        (5, "http://c.org/5", link("/6")), (6, "http://c.org/6", link("7")), (7, "http://c.org/7", ""),
        (8, "http://d.org/8", '<link href="//e.net/fr/8" rel=canonical>'),
        (9, "http://f.org/9", "<p>canonical</p> refresh <link rel='stylesheet' href='http://bad.net/es/1'>"),
        (10, "http://c.org/5", None), (11, None, link("http://bad.net/es/1")),
    ]
    got = judged(spark, rows, URL_RULES)
    assert {i for i, x in got.items() if x.verdict == "block"} == {1, 2, 3, 8}
    assert got[4].rule == "com/" and got[1].rule is None
    more = judged(spark, rows, URL_RULES + [("c.org", "/7", "block")])
    assert {i for i, x in more.items() if x.verdict == "block"} == {1, 2, 3, 5, 6, 7, 8, 10}


def test_only_declared_links_count(spark):
    bad = "http://bad.net/es/1"

    def link(u, rel="canonical"):
        return f'<link href="{u}" rel="{rel}">'

    blocked = [
        link(bad, "shortlink Canonical"), f"<LINK REL = 'canonical'\nHREF={bad}>", f'<link title="a > b" rel=canonical href="{bad}"/>',
        link("http://bad.net/x/../es/./1"), link("http&#58;//bad.net&#x2f;es/1"), "<!-- a --> " + link(bad) + " <!-- b -->",
        f'<script>var a = "<!--";</script>{link(bad)}', f'<meta content="0;URL=\'{bad}\'" http-equiv="Refresh">',
    ]
    free = [
        f"<!-- {link(bad)} -->", f"<script>var x = '{link(bad)}';</script>", f"<!-- {link(bad)}", f"<style>{link(bad)}</style>",
        f"<textarea>{link(bad)}</textarea><title>{link(bad)}</title>", f"<template>{link(bad)}</template>", link(bad, "canonical-x"),
        f'<link data-rel="canonical" href="{bad}">', f'<meta name="refresh" content="0; url={bad}">', link("#top"),
        link("http://bad.net/es/../1"),
    ]
    rows = [(i, f"http://h.org/a/{i}", h) for i, h in enumerate(blocked + free)]
    rows += [(100, "http://y.net/fr/q", None), (101, "http://y.net/a/b/c", link("../../fr/q")), (102, "http://y.net/q?x=1", link("?x=2")),
             (103, "http://y.net/q?x=2", link("/fr/./z/../q"))]
    got = judged(spark, rows, URL_RULES)
    assert {i for i, x in got.items() if x.verdict == "block"} == {*range(len(blocked)), 100, 101, 102, 103}


def test_long_rule_lists_join_by_shuffle(spark, monkeypatch):
    from textmill.llm import url_filter
    rules = URL_RULES + [("com", "/", "block"), ("example.com", "/en/", "block")]
    rows = [(i, f"http://{h}.com/{p}", None) for i, (h, p) in enumerate((h, p) for h in ("a", "example", "www.example") for p in ("", "en/", "x"))]
    want = judged(spark, rows, rules)
    monkeypatch.setattr(url_filter, "MAX_RULES", 0)
    assert judged(spark, rows, rules) == want


def test_alias_key(spark):
    df = spark.createDataFrame([("HTTP://A.org/x?utm_source=f&b=1&gclid=2#t",), ("no scheme",), (None,)], "u string")
    assert [r[0] for r in df.select(alias_key(df.u)).collect()] == ["//a.org/x?b=1", "no scheme", None]


def test_odd_tables(spark):
    rows = [(1, "http://a.com/", None), (1, "http://a.com/", None), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows],
                               "page_id long, url string, html string, host string, spread string")
    r = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = judge_urls(df, r)
    assert got.columns == ["page_id", "url", "html", "spread", "host", "path", "rule", "verdict"]
    assert sorted(x.host for x in got.collect()) == ["", "a.com", "a.com"]
    assert judge_urls(df.limit(0), r).count() == 0 and judge_urls(df, r.limit(0)).where("rule IS NULL").count() == 3


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op4_url_filter"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        rule, verdict = rule_of(pages[r.page_id].url, URL_RULES)
        assert (r.host, r.path, r.rule) == (*split(pages[r.page_id].url), rule)
        assert r.verdict == verdict or rule is None
