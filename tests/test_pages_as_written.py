"""Pages as authors write them: quoted brackets, unclosed links, references, relative addresses."""

import pytest
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.functions.columns import first_of_each, last_per_key
from stackscan.operators import frontier
from stackscan.operators.evidence import extract_evidence
from stackscan.plans import scan

URL = "https://s.org/dir/page?q#f"


def evidence(spark, html):
    return extract_evidence(spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")).collect()[0]


@pytest.mark.parametrize("html,links", [
    ('<a href="/open">Open<p>x</p><a title="a > b" href="/gt">Gt</a>', [("https://s.org/open", "openx"), ("https://s.org/gt", "gt")]),
    ('<a href="/last">Rest <b>of it', [("https://s.org/last", "rest of it")]),
    ('<a href="../up">U &#38; &eacute; &#x41;&#233; &amp;lt;</a>', [("https://s.org/up", "u & é aé &lt;")]),
    ('<base href="/x/"><a href="y">Y</a><a href="./z/../w?q=../v#t">W</a>', [("https://s.org/x/y", "y"), ("https://s.org/x/w?q=../v#t", "w")]),
    ('<a href="HTTP://Ex.ORG:80/A/./b/..">Z</a><a href="//H.org:443">h</a>', [("http://ex.org/A/", "z"), ("https://h.org/", "h")]),
    ('<a href="mailto:x@y.org">m</a><a>none</a><a name=n>n</a><a href=#top>t</a>', [("mailto:x@y.org", "m"), ("https://s.org/dir/page?q#top", "t")]),
    ('<a href="/a">A</a><!-- <a href="/b">B</a> --><script>"<a href=/c>"</script>', [("https://s.org/a", "a")]),
])
def test_links(spark, html, links):
    assert [tuple(x) for x in evidence(spark, html).links] == links


def test_quoted_brackets_in_tags(spark):
    row = evidence(spark, '<meta name="generator" content="a > b WordPress 6.1"><body data-x="a>b" class="wp-x" id=q>')
    assert row.meta == {"generator": "a > b WordPress 6.1"} and row.version_info == {"wordpress": "6.1"}
    assert (row.dom.body_classes, row.dom.body_id) == ("wp-x", "q")
    assert [s.src for s in evidence(spark, '<script data-a="1>0" src="../j.js"></script>').scripts] == ["https://s.org/j.js"]


@pytest.mark.parametrize("url,want", [
    ("https://a.org", "https://a.org/"), ("HTTPS://u:P@A.org:443/x/../../y/.", "https://u:P@a.org/y/"), ("http://a.org:8080/..?q", "http://a.org:8080/?q"),
    ("ftp://A.org/../x", "ftp://A.org/../x"), ("https://a.org/a..b/...", "https://a.org/a..b/..."), ("mailto:A@b", "mailto:A@b")])
def test_canonical_addresses(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.normal(F.col("u"))).first()[0] == want


def test_first_and_last_of_each(spark):
    items = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("b", 5)],), (None,), ([],)], "x array<struct<key:string,value:int>>")
    firsts = [r[0] for r in items.select(F.transform(first_of_each(F.col("x"), "key"), lambda e: e["value"])).collect()]
    assert firsts == [[1, 2, 4], None, []]
    assert items.select(last_per_key(F.col("x"))).first()[0] == {"a": 3, "c": 4, "b": 5}


def test_pages_with_very_many_links(spark):
    links = spark.range(1).select(F.lit(1).alias("page_id"), F.lit(URL).alias("url"), F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.struct(
        F.concat(F.lit("https://s.org/student/"), (i % 20_000).cast("string")).alias("href"), F.lit("x").alias("text"))).alias("links"))
    rows = frontier.strategic_links(links, ["page_id"])
    assert rows.count() == 20_000


def test_latest_answer_decides_about_derived_pages(spark):
    candidates = spark.createDataFrame([("s", 0, "p", 0, "u"), ("s", 0, "p", 1, "v")], "site string, prefix_ord int, prefix string, variant int, candidate string")
    log = spark.createDataFrame([("u", 1, 200), ("u", 2, 500), ("v", 1, 404), ("v", 3, 403)], "url string, fetched_at int, status int")
    assert [r.candidate for r in frontier.reachable_derived(candidates, log).collect()] == ["v"]


def test_an_excluded_main_page_means_no_scan(spark):
    rows = [("s", "https://s.org/admin", 0), ("s", "https://s.org/x", 1), ("t", "https://t.org/", 0), ("t", "https://t.org/admin", 1), ("t", "https://t.org/y", 2)]
    chosen = scan.pages_in_budget(spark.createDataFrame(rows, "site string, url string, page_ord int"))
    assert sorted(r.url for r in chosen.collect()) == ["https://t.org/", "https://t.org/y"]
